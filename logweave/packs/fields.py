"""Named fragments and filterable fields that rule packs are written with."""

from __future__ import annotations

# Building blocks, from RFC 1035 (names), RFC 791 and RFC 4291 (addresses) and
# RFC 5322 (mail).
FRAGMENTS = {
    "LABEL": r"[0-9A-Za-z]+(?:-+[0-9A-Za-z]+)*",
    "DNSNAME": r"${LABEL}(?:\.${LABEL})*",
    "OCTET": r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])",
    "IPV4": r"${OCTET}(?:\.${OCTET}){3}",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:${IPV4}|[0-9A-Fa-f]{0,4})",
    "ATOM": r"[-!#$%&'*+/=?^_`{|}~0-9A-Za-z]+",
    "NAME": r"${ATOM}(?:\.${ATOM})*",
    "QUOTED": r'"[\x01-\x7f]*"',
    "MAILBOX": r"(?:${NAME}|${QUOTED})?(?:@(?:${DNSNAME}|\[(?:${IPV4}|${IPV6})\]))*",
    "number": r"[0-9]+",
    "text": r".+",
    "word": r"\S+",
    # Postfix: hexadecimal short ids or long ones in base 52
    "queue": r"[0-9A-Za-z]{5,20}",
}

# Fields that a filter can name.
FIELDS = {
    "user": r"(?:${NAME}|)",
    "mail": r"${MAILBOX}",
    "from": r"${MAILBOX}",
    "rcpt": r"${MAILBOX}",
    "client": r"(?:${DNSNAME}|${IPV4}|${IPV6}|${DNSNAME}\[(?:${IPV4}|${IPV6})\])",
    "pid": r"[0-9]+",
    "uid": r"[0-9]+",
    "msgid": r"[\x01-\x7f]*",
}
