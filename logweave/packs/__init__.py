"""Rule packs for common daemons."""


def shipped():
    """All rule packs, enabled or not."""
    from logweave.packs import asa, barracuda, crond, dovecot, ntpd, postfix, sshd

    return [m.APP for m in (asa, barracuda, crond, dovecot, ntpd, postfix, sshd)]


def default_sections():
    """Sections of the default report."""
    from logweave.operators.reports import Section

    return [
        Section("login", "Logins"),
        Section("mail", "Mail report"),
        Section("network", "Network"),
        Section("command", "System commands"),
        Section("query", "Database lookups"),
    ]
