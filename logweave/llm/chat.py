"""Chat formatting of heterogeneous records.

A record is JSON in any of several layouts: a message, lists of messages under different names, or prompt,
instruction and answer fields.  Those of its nested field paths that some mapping knows are hashed into a
fingerprint, and the fingerprint selects a declarative mapping to canonical turns; other paths are ignored.  Turns are then written in one template in which control
strings inside texts are escaped, so the template can be read back without loss.

Every step but the reading back is done per record, without moving it.  A conversation may have any number
of records: formatted text stays one row per turn, and a task that reads a conversation back holds one batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """``turns``: of each turn the list it is in (or ""), its role (``=name`` for a fixed one, else a field)
    and its text's field.  ``paths`` must be there; ``optional`` ones need not, and a turn whose text is missing
    then is none."""

    paths: frozenset[str]
    turns: tuple[tuple[str, str, str], ...]
    optional: frozenset[str] = frozenset()

    @property
    def path_sets(self) -> list[frozenset[str]]:
        """Each set of paths that the mapping is for."""
        out = [self.paths]
        for path in sorted(self.optional):
            out += [paths | {path} for paths in out]
        return out


def _layout(paths: str, *turns: tuple[str, str, str], optional: str = "") -> Mapping:
    return Mapping(frozenset(paths.split()), turns, frozenset(optional.split()))


_SYSTEM = ("", "=system", "system")


MAPPINGS = [
    _layout("role content", ("", "role", "content")),
    _layout("from value", ("", "from", "value")),
    _layout("messages[].role messages[].content", ("messages", "role", "content")),
    _layout("conversations[].from conversations[].value", ("conversations", "from", "value")),
    _layout("prompt completion", _SYSTEM, ("", "=user", "prompt"), ("", "=assistant", "completion"), optional="system"),
    _layout("prompt response", _SYSTEM, ("", "=user", "prompt"), ("", "=assistant", "response"), optional="system"),
    _layout("instruction output", _SYSTEM, ("", "=user", "instruction"), ("", "=assistant", "output"), optional="system"),
    _layout("instruction input output", ("", "=system", "instruction"), ("", "=user", "input"), ("", "=assistant", "output")),
    _layout("system", _SYSTEM),
    _layout("prompt", ("", "=user", "prompt")),
    _layout("response", ("", "=assistant", "response")),
]
#: Names of roles in layouts that say who a turn is from.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(value, path: str = "") -> set[str]:
    """Paths of all leaves; the elements of a list share one.  Null and empty values are leaves."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{path}.{k}" if path else k) for k, v in value.items()))
    if isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
        return set().union(*(paths_of(v, path + "[]") for v in value))
    return {path}


def schema_fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_BY_FINGERPRINT = {schema_fingerprint(paths): m for m in MAPPINGS for paths in m.path_sets}
_KNOWN = frozenset().union(*(m.paths | m.optional for m in MAPPINGS))


def canonical_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Fingerprint of a record and its turns.

    None if it is null, no JSON, nested deeper than the interpreter follows, or of unknown layout.  What is no
    object in a list of turns is no turn.  Halves of surrogate pairs that stand alone become U+FFFD.
    """
    try:
        value = json.loads(record) if record is not None else None
        if not isinstance(value, dict):
            return None, []
        found = schema_fingerprint(paths_of(value) & _KNOWN)
        mapping = _BY_FINGERPRINT.get(found)
        return found, _turns(value, mapping) if mapping else []
    except (ValueError, RecursionError):
        return None, []


def _turns(value: dict, mapping: Mapping) -> list[tuple[str, str]]:
    out = []
    for where, role, text in mapping.turns:
        for one in value[where] if where else [value]:
            if not isinstance(one, dict) or (text in mapping.optional and text not in one):
                continue
            name = role[1:] if role.startswith("=") else _text(one.get(role))
            out.append((ROLES.get(name, name) if role == "from" else name, _text(one.get(text))))
    return out


def _text(value) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return _LONE.sub("\ufffd", text)


_LONE = re.compile("[\ud800-\udfff]")


# The template.  A turn is an opening mark, its text, a closing mark; a role without marks of its own is
# named in the mark.
_OPEN = {"user": "[INST] ", "assistant": "<s> ", "system": "<<SYS>> "}
_CLOSE = {"user": " [/INST]", "assistant": " </s>", "system": " <</SYS>>"}
_OTHER_OPEN, _OTHER_NAMED, _OTHER_CLOSE = "<<ROLE>> ", " <<TEXT>> ", " <</ROLE>>"
_CONTROL = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>"]
_TO_ESCAPE = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})" for c in _CONTROL))
_MARKS = re.compile(r"(\\.)|" + "|".join(f"({re.escape(c)})" for c in _CONTROL), re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each backslash and each control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its escaped text begins and ends there."""
    body = escape(text)
    if role in _OPEN:
        head, tail = _OPEN[role], _CLOSE[role]
    else:
        head, tail = f"{_OTHER_OPEN}{escape(role)}{_OTHER_NAMED}", _OTHER_CLOSE
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from formatted text."""
    out, at, role, opened = [], 0, None, 0
    roles = {v.strip(): k for k, v in _OPEN.items()}
    while m := _MARKS.search(formatted, at):
        at = m.end()
        mark = m[0]
        if m[1] is not None:
            continue
        if mark in roles and role is None:
            role, opened = roles[mark], at + 1
        elif mark == _OTHER_OPEN.strip() and role is None:
            role, opened = mark, at + 1
        elif mark == _OTHER_NAMED.strip() and role == _OTHER_OPEN.strip():
            role, opened = "=" + unescape(formatted[opened : m.start() - 1]), at + 1
        elif role is not None and mark == (_CLOSE.get(role) or _OTHER_CLOSE).strip():
            out.append((role.removeprefix("=") if role not in _OPEN else role, unescape(formatted[opened : m.start() - 1])))
            role = None
        else:
            raise ValueError(f"{mark} does not belong there")
    return out


_SEGMENT = (
    "key long, place long, part int, layout string, formatted string, loss_from int, loss_to int"
)


def format_chats(records: DataFrame, key: str, place: str, record: str) -> DataFrame:
    """One row per turn: ``key``, ``place``, ``part`` (turn in the record), ``layout`` (fingerprint),
    ``formatted`` text, and the code points ``loss_from`` to ``loss_to`` of it that the loss counts, null
    unless the turn is the assistant's.

    A conversation's text is its rows' texts in order of place and part, with nothing between.  A record
    that is null, no JSON or of unknown layout gives one row with null ``formatted``; an empty list of
    turns gives one too.  Null texts and roles are empty.  Repeated rows stay.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[] for _ in range(7)]
            for k, p, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                layout, turns = canonical_turns(r)
                for i, (role, text) in enumerate(turns or [(None, None)]):
                    formatted, begin, end = format_turn(role, text) if turns else (None, None, None)
                    loss = (begin, end) if role == "assistant" else (None, None)
                    for column, value in zip(out, (k, p, i, layout, formatted, *loss), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            names = [x.split()[0] for x in _SEGMENT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    rows = records.selectExpr(f"cast(`{key}` AS bigint) AS key", f"cast(`{place}` AS bigint) AS place", f"`{record}` AS record")
    return rows.mapInArrow(run, _SEGMENT).withColumnRenamed("key", key)


_DIGEST = "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame, key: str) -> DataFrame:
    """Per conversation what its formatted text says: turns, text under the loss mask, and length.

    Rows move once, to a task per group of conversations, and are read in order of place, part and text; a
    hash takes them in one after the other, so a long conversation needs no more memory than a short one.
    Records without turns add nothing; a conversation of none but those has 0 turns.
    """
    spark = segments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.select(F.col(key).alias("key"), "place", "part", "formatted", "loss_from", "loss_to")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "place", "part", "formatted")
    return rows.mapInArrow(_read, _DIGEST).withColumnRenamed("key", key)


class _Reading:
    def __init__(self, key):
        self.key, self.turns, self.loss, self.length = key, 0, 0, 0
        self.of_turns, self.of_loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str | None, begin: int | None, end: int | None) -> None:
        if formatted is None:
            return
        self.length += len(formatted)
        for role, text in parse(formatted):
            self.turns += 1
            self.of_turns.update(f"{role}\n{text}\n".encode())
        if begin is not None:
            text = unescape(formatted[begin:end])
            self.loss += len(text)
            self.of_loss.update(text.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.of_turns.hexdigest(), self.loss, self.of_loss.hexdigest(), self.length


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Reading | None = None
    for batch in rows:
        out = []
        for key, *segment in zip(*(batch.column(c).to_pylist() for c in ("key", "formatted", "loss_from", "loss_to")), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.row())
                now = _Reading(key)
            now.add(*segment)
        yield _digests(out)
    if now is not None:
        yield _digests([now.row()])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in _DIGEST.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(columns, kinds, strict=True)], list(names)
    )


def records_of_turns(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns as JSON records, in the layouts that sources use for one turn; which one, the row's turn says.

    Null roles and texts are empty.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    other = {v: k for k, v in (("human", "user"), ("gpt", "assistant"))}
    named = F.when(role == "user", other["user"]).when(role == "assistant", other["assistant"]).otherwise(role)
    flat = F.to_json(F.struct(role.alias("role"), text.alias("content")))
    shared = F.to_json(F.struct(named.alias("from"), text.alias("value")))
    listed = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    nested = F.to_json(F.struct(F.array(F.struct(named.alias("from"), text.alias("value"))).alias("conversations")))
    field = (
        F.when(role == "user", F.to_json(F.struct(text.alias("prompt"))))
        .when(role == "assistant", F.to_json(F.struct(text.alias("response"))))
        .when(role == "system", F.to_json(F.struct(text.alias("system"))))
        .otherwise(flat)
    )
    kind = F.coalesce(F.pmod(F.col(turn) + F.col(key), F.lit(5)), F.lit(0))
    own = role.isin(*ROLES)  # a role that is another's name elsewhere keeps its own
    record = F.when(own | (kind == 0), flat).when(kind == 1, shared).when(kind == 2, listed).when(kind == 3, nested).otherwise(field)
    return turns.select(F.col(key).alias(key), F.col(turn).alias(turn), record.alias("record"))
