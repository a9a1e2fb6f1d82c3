"""Replacing field values: tokens, names of addresses, names of user ids (M1-M5)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.regex import compute_once, expand, sql_text, to_java
from logweave.operators.headers import BUILT_IN, HEADER_COLUMNS, HeaderFormat
from logweave.operators.joins import BROADCAST_ROWS, HOT_ROWS, join_checked, join_counted, row_hash, stage
from logweave.operators.ordered import number_rows
from logweave.operators.rules import App, bind_rules
from logweave.packs.fields import FIELDS, FRAGMENTS

# Fields whose values may hold an address, or a user id.
ADDRESS_FIELDS = ("client", "mail", "from", "rcpt", "user")
UID_FIELDS = ("user", "uid")
# Fields beyond the broadcast limit that are looked up one after another; more are looked up at once.
JOINED_FIELDS = 2
# Columns that are made from the text of a line.
_MADE = [*HEADER_COLUMNS, "format", "format_app", "event_ts", "app", "rule", "thread", "matched", "full_match"]


def base_field(name: str) -> str:
    """``client2`` belongs to the field ``client``."""
    return re.match(r"[A-Za-z_]+", name)[0]


def group_names(apps: Iterable[App]) -> list[str]:
    """All group names of some packs."""
    names = (g.name for a in apps for r in bind_rules(a) for g in r.regex.groups)
    return list(dict.fromkeys(names))


def _maskable(apps: Iterable[App]) -> set[str]:
    apps = list(apps)
    return set(FIELDS).union({"host", "thread", "uid"}, *(a.fields for a in apps))


def token_table(parsed: DataFrame, apps: Iterable[App], width: int = 4) -> DataFrame:
    """``base, value, token``: one token like ``USER_0007`` per distinct field value.

    Values are numbered by their order within a base field.  Numbers beyond
    ``width`` digits get longer, so two values never share a token.
    """
    return _tokens(parsed, apps, width).select("base", "value", "token")


def _tokens(parsed: DataFrame, apps: Iterable[App], width: int) -> DataFrame:
    """The tokens with ``uses``, the number of values that each is written for."""
    apps = list(apps)
    maskable = _maskable(apps)
    wanted = [n for n in group_names(apps) if base_field(n) in maskable]
    pairs = [F.struct(F.lit("host").alias("base"), F.col("host").alias("value"))]
    for name in wanted:
        pairs.append(
            F.struct(F.lit(base_field(name)).alias("base"), F.col("fields")[name].alias("value"))
        )
    values = (
        parsed.filter("matched")
        .select(F.inline(F.array(*pairs)))
        .filter(F.col("value").isNotNull())
        .groupBy("base", "value")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    number = F.col("_no").cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    token = F.concat(F.upper("base"), F.lit("_"), padded).alias("token")
    return number_rows(values, ["base"], ["value"], "_no").select("base", "value", token, "uses")


@dataclass(frozen=True)
class _Key:
    """What a field is looked up by: ``value`` among the values of ``base``."""

    base: str
    value: Column


def _looked_up(
    df: DataFrame,
    keys: dict[str, _Key],
    table: DataFrame,
    rows: int,
    broadcast_rows: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``_v_<name>`` for every field: the ``name`` that ``table`` has for its key, or null.

    ``table`` has one row per (``base``, ``value``).  If its ``rows`` may be broadcast,
    each field is looked up where the line is.  Otherwise all fields are looked up
    at once: a line becomes one entry for itself and one for each of its keys,
    entries are shuffled to the table by key, and once more by line to be put
    together.  ``uses`` in the table, if there, tells which keys are hot.
    """
    if rows <= broadcast_rows:
        for name, key in keys.items():
            df = df.withColumn(f"_k_{name}", key.value)
            of_base = table.filter(F.col("base") == key.base) if "base" in table.columns else table
            side = of_base.select(F.col("value").alias(f"_k_{name}"), F.col("name").alias(f"_v_{name}"))
            df = df.join(F.broadcast(side), f"_k_{name}", "left")
        return df.drop(*[f"_k_{n}" for n in keys])
    columns = [F.col(c) for c in df.columns]
    found = [
        F.struct(F.lit(n).alias("field"), F.lit(k.base).alias("base"), k.value.cast("string").alias("value"))
        for n, k in keys.items()
    ]
    # lines are numbered once, in a table: numbers made again need not be the same
    df = stage(df.select(F.monotonically_increasing_id().alias("_id"), F.struct(*columns).alias("_line"), F.array(*found).alias("_keys")))
    line = F.struct(
        F.lit(None).cast("string").alias("field"), F.lit("").alias("base"), F.col("_id").cast("string").alias("value"), F.col("_line").alias("line")
    )
    keys_of = F.transform(
        F.filter("_keys", lambda k: k["value"].isNotNull()),
        lambda k: F.struct(k["field"].alias("field"), k["base"].alias("base"), k["value"].alias("value"), F.lit(None).cast(df.schema["_line"].dataType).alias("line")),
    )
    entries = df.select("_id", F.inline(F.concat(F.array(line), keys_of)))
    hot = table.select("base", "value", F.ceil(F.col("uses") / hot_rows).cast("int").alias("_salts")) if "uses" in table.columns else None
    if hot is None:
        counts = entries.filter("field IS NOT NULL").groupBy("base", "value").agg(F.count(F.lit(1)).alias("uses"))
        hot = counts.select("base", "value", F.ceil(F.col("uses") / hot_rows).cast("int").alias("_salts"))
    # at most one row for each ``hot_rows`` entries
    hot = F.broadcast(stage(hot.filter("_salts > 1")))
    salt = F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1))).cast("int")
    entries = entries.join(hot, ["base", "value"], "left").withColumn("_salt", salt).drop("_salts")
    names = table.select("base", F.col("value").cast("string").alias("value"), "name").join(hot, ["base", "value"], "left")
    names = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    met = entries.join(names, ["base", "value", "_salt"], "left")
    pair = F.when(F.col("name").isNotNull(), F.struct("field", "name"))
    whole = met.groupBy("_id").agg(F.first("line", ignorenulls=True).alias("_line"), F.map_from_entries(F.collect_list(pair)).alias("_names"))
    return whole.select("_line.*", *[F.col("_names")[n].alias(f"_v_{n}") for n in keys])


def _looked_up_by_size(
    df: DataFrame,
    keys: dict[str, _Key],
    table: DataFrame,
    sizes: dict[str, int],
    broadcast_rows: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``_looked_up`` with only those fields shuffled whose base has too many rows (``sizes``) to be broadcast.

    Up to ``JOINED_FIELDS`` of these take a join each, which moves the columns that
    are asked for once; the table must have ``uses``.
    """
    large = {n: k for n, k in keys.items() if sizes.get(k.base, 0) > broadcast_rows}
    if len(large) > JOINED_FIELDS:
        df = _looked_up(df, large, table, max(sizes.values()), broadcast_rows, hot_rows)
    else:
        # what a line came with tells it apart; other columns need not be made for that
        came = row_hash(df, [c for c in _MADE if c in df.columns])
        for name, key in large.items():
            of_base = table.filter(F.col("base") == key.base).withColumn("_k", F.col("value").cast("string"))
            side = of_base.select("_k", F.col("name").alias(f"_v_{name}"))
            counts = of_base.select("_k", F.col("uses").alias("count"))
            df = join_counted(df.withColumn("_k", key.value.cast("string")), side, ["_k"], "left", counts, came, hot_rows).drop("_k")
    small = {n: k for n, k in keys.items() if n not in large}
    return _looked_up(df, small, table, 0, broadcast_rows) if small else df


def _with_fields(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace values of the ``fields`` map (and ``host`` and ``thread``) that are present."""
    if not new:
        return df

    def pick(key, value):
        out = value
        for name, replacement in new.items():
            if name != "host":
                out = F.when((key == name) & value.isNotNull(), replacement).otherwise(out)
        return out

    df = df.withColumn("fields", F.transform_values("fields", pick))
    if "thread" in new:
        df = df.withColumn("thread", F.col("fields")["thread"])
    if "host" in new:
        df = df.withColumn("host", new["host"])
    return df


def mask_fields(
    parsed: DataFrame, apps: Iterable[App], width: int = 4, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Replace field values and the host of matched lines by tokens.

    The lines are kept in shared storage: they are read twice, for the values that
    get tokens and to write these, and the rules need run only once.
    """
    apps = list(apps)
    parsed = stage(parsed)
    maskable = _maskable(apps)
    names = [n for n in group_names(apps) if base_field(n) in maskable] + ["host"]
    tokens = stage(_tokens(parsed, apps, width).withColumnRenamed("token", "name"))
    # one row per base field
    sizes = dict(tokens.groupBy("base").count().collect())
    keys = {}
    for name in names:
        if base_field(name) in sizes:
            value = F.col("host") if name == "host" else F.col("fields")[name]
            keys[name] = _Key(base_field(name), F.when(F.col("matched"), value))
    new = {n: F.col(f"_v_{n}") for n in keys}
    new["host"] = F.coalesce(F.col("_v_host"), F.col("host")) if "host" in keys else F.col("host")
    found = _looked_up_by_size(parsed, keys, tokens, sizes, broadcast_rows) if keys else parsed
    return _with_fields(found, new).drop(*[f"_v_{n}" for n in keys])


def address_pattern() -> str:
    return to_java(expand("(?:${IPV4}|${IPV6})", FRAGMENTS)).pattern


def _address_names(names: DataFrame) -> DataFrame:
    return names.filter("address is not null").select(F.col("address").cast("string").alias("value"), "name")


def _user_names(users: DataFrame) -> DataFrame:
    return users.filter("uid is not null").select(F.col("uid").cast("bigint").cast("string").alias("value"), "name")


def _used(parsed: DataFrame, keys: Iterable[_Key]) -> DataFrame:
    """``value, uses``: the distinct values that lines are looked up by."""
    values = parsed.select(F.explode(F.array(*[k.value for k in keys])).alias("value"))
    return values.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("uses"))


def _address_key(value: Column) -> Column:
    return F.regexp_replace(F.regexp_substr(value, F.lit(address_pattern())), r"(?i)\A::ffff:", "")


def _address_written(value: Column, name: Column) -> Column:
    """A value with the name in place of its first address."""
    found = F.regexp_substr(value, F.lit(address_pattern()))
    start = F.instr(value, found)
    replaced = F.concat(
        F.substring(value, F.lit(1), start - 1), name, F.substring(value, start + F.length(found), F.length(value))
    )
    return F.when(name.isNull() | F.startswith(value, name), value).otherwise(replaced)


def _user_key(value: Column) -> Column:
    return F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast("bigint").cast("string"))


def _user_written(value: Column, name: Column) -> Column:
    number = _user_key(value)
    return F.coalesce(name, F.when(number.isNotNull(), F.concat(F.lit("uid="), number)), value)


def _name_values(parsed: DataFrame, addresses: tuple[list[str], DataFrame | None], users: tuple[list[str], DataFrame | None], broadcast_rows: int) -> DataFrame:
    """Write names for the values of fields: some by address, some by user id, all looked up at once."""
    keys, new, tables, sizes = {}, {}, [], {}
    sides = (("address", addresses, _address_names, _address_key, _address_written), ("uid", users, _user_names, _user_key, _user_written))
    for base, (groups, table), names, key, written in sides:
        if table is None or not groups:
            continue
        own = {}
        for g in groups:
            value = F.col("fields")[g]
            own[g] = _Key(base, key(value))
            new[g] = written(value, F.col(f"_v_{g}"))
        keys |= own
        # one name per value, or lines would multiply
        first = F.min("name").alias("name")
        # the rows that there may be; they are not counted further than it matters
        sizes[base] = table.limit(broadcast_rows + 1).count()
        if sizes[base] <= broadcast_rows:
            some = names(table).groupBy("value").agg(first).withColumn("uses", F.lit(None).cast("bigint"))
        else:
            # lines hold few of many values, as a rule: only names of those are kept
            used = join_checked(names(table), _used(parsed, own.values()), ["value"], "inner", broadcast_rows=broadcast_rows, hot_rows=None)
            some = stage(used.groupBy("value").agg(first, F.max("uses").alias("uses")))
            sizes[base] = some.count()
        tables.append(some.withColumn("base", F.lit(base)))
    if not keys:
        return parsed
    table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return _with_fields(_looked_up_by_size(parsed, keys, table, sizes, broadcast_rows), new).drop(*[f"_v_{n}" for n in keys])


def name_addresses(
    parsed: DataFrame, apps: Iterable[App], names: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Write host names for addresses: ``names`` has the columns ``address, name``.

    The first address in a client, mail or user value is replaced; an IPv4 address
    written as IPv6 (``::ffff:``) is looked up as IPv4.  Unknown ones stay.  Of
    several names the first in order counts.
    """
    groups = [n for n in group_names(list(apps)) if base_field(n) in ADDRESS_FIELDS]
    return _name_values(parsed, (groups, names), ([], None), broadcast_rows)


def name_uids(
    parsed: DataFrame, apps: Iterable[App], users: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Write user names for numeric ids: ``users`` has the columns ``uid, name``.

    An id without a name becomes ``uid=N``; what is not a number stays.  Of several
    names the first in order counts.
    """
    groups = [n for n in group_names(list(apps)) if base_field(n) in UID_FIELDS]
    return _name_values(parsed, ([], None), (groups, users), broadcast_rows)


def map_fields(
    parsed: DataFrame,
    apps: Iterable[App],
    mask: bool = False,
    addresses: DataFrame | None = None,
    users: DataFrame | None = None,
    width: int = 4,
) -> DataFrame:
    """Apply one mapping per field: tokens before address names before user names.

    A ``user`` value falls to the address names when both are given.
    """
    apps = list(apps)
    if mask:
        return mask_fields(parsed, apps, width)
    groups = group_names(apps)
    by_address = [g for g in groups if base_field(g) in ADDRESS_FIELDS] if addresses is not None else []
    by_uid = [g for g in groups if base_field(g) in UID_FIELDS and g not in by_address] if users is not None else []
    return _name_values(parsed, (by_address, addresses), (by_uid, users), BROADCAST_ROWS)


#: Names whose values are withheld where they stand as ``name=value`` outside the groups of a rule; those of the
#: server itself (``lip``) are not.
NAMED = "user|ruser|login|logname|owner|client|host|rhost|addr|from|to|rcpt|orig_to|mail|uid|euid|auid|rip"


def withhold_named(text: Column) -> Column:
    """Hide the values of ``name=value`` that are no tokens: what a rule took no notice of may still tell who it was."""
    value = r"""(?:<[^>]*>|"[^"]*"|'[^']*'|[^\s,;()\[\]<>"']+)"""
    token = r"""[<"']?[A-Z][A-Z_]*_[0-9]{2,}(?![0-9A-Za-z])"""
    return F.regexp_replace(text, rf"(?i)(?<![\w.-])({NAMED})=(?-i:(?!{token})){value}", "$1=?")


def rewrite_raw(
    mapped: DataFrame,
    apps: Iterable[App],
    formats: tuple[HeaderFormat, ...] = BUILT_IN,
) -> DataFrame:
    """Write mapped host and field values into ``raw`` and ``message`` in place of the old ones.

    The line is cut at its groups by the same patterns that found them, in one run
    for the header and one for the rule, and put together around the new values.
    Of nested groups the outermost is written.
    """
    rules = {f"{r.app}/{r.name}": r.pattern for a in apps for r in bind_rules(a)}
    df = _put_together(
        mapped, "message", rules, "concat_ws('/', app, rule)", "fields", "_message", anchored=False
    )
    df = df.withColumn("_values", F.expr("map('host', host, 'message', _message)"))
    headers = {f.name: f.pattern for f in formats}
    df = _put_together(df, "raw", headers, "format", "_values", "_raw", anchored=True, only=frozenset({"host", "message"}))
    changed = F.when(F.col("matched"), F.col("_raw")).otherwise(F.col("raw"))
    message = F.when(F.col("matched"), F.col("_message")).otherwise(F.col("message"))
    return df.withColumns({"raw": changed, "message": message}).drop("_raw", "_values", "_message")


def _put_together(
    df: DataFrame, column: str, patterns: dict[str, str], which: str, values: str, name: str, anchored: bool, only: frozenset[str] | None = None
) -> DataFrame:
    """Add ``name``: the text of ``column`` with new values for the groups of a pattern, on matched lines.

    ``which`` is the label of the pattern of a row, ``values`` a map by group name, that
    has ``only`` some of the groups if these are given.
    """
    cuts, names = [], []
    for label, pattern in patterns.items():
        regex = to_java(pattern, pieces=True, only=only)
        numbers = "\n".join(f"${i}" for _, i in regex.pieces)
        cuts.append(
            f"WHEN {sql_text(label)} THEN split(regexp_replace({column}, "
            f"{sql_text(regex.cutting(anchored))}, {sql_text(numbers)}), '\n', -1)"
        )
        pieces = ", ".join(sql_text(n or "") for n, _ in regex.pieces)
        names.append(f"WHEN {sql_text(label)} THEN array({pieces})")
    df = df.withColumn("_which", F.expr(f"CASE WHEN matched THEN {which} END"))
    df = compute_once(df, "_cut", f"CASE _which {' '.join(cuts)} END", apart=True)
    new = (
        f"array_join(zip_with(_cut, CASE _which {' '.join(names)} END,"
        f" (old, n) -> CASE WHEN n = '' THEN old ELSE coalesce({values}[n], old) END), '')"
    )
    return df.withColumn(name, F.expr(f"CASE WHEN _cut IS NULL THEN {column} ELSE {new} END")).drop("_cut", "_which")
