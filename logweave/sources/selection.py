"""Which files a list of paths and globs means.

Paths may name files, folders or globs; ``*``, ``?`` and ``[...]`` stay within one segment of a path and
``{a,b}`` is one of its parts.  All requests are put into a trie of their segments.  Branches of the trie that
go on alike are listed by one glob, so a hundred thousand paths become a few globs, which Spark lists in
parallel; the listing may hold more than was asked for.  What each request means is then an equi-join of the
files with the requests, on the part of a request before its first glob.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.joins import stage

#: Names of one glob; beyond, a last segment is listed whole and a folder takes several globs.
NAMES = 64
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?(.*)", re.S)


def plain_name(path: Column) -> Column:
    """A listed path as lines name it: local ones lose the scheme."""
    return F.regexp_replace(path, r"\Afile:/+", "/")


def without_braces(glob: str) -> list[str]:
    """The globs without ``{a,b}`` that a glob stands for."""
    depth, begin, cuts, i = 0, -1, [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "\\":
            i += 1
        elif ch == "{":
            if not depth:
                begin, cuts = i, [i]
            depth += 1
        elif ch == "," and depth == 1:
            cuts.append(i)
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                cuts.append(i)
                parts = [glob[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
                return [g for part in dict.fromkeys(parts) for g in without_braces(glob[:begin] + part + glob[i + 1 :])]
        i += 1
    return [glob]


def _is_glob(segment: str) -> bool:
    return re.search(r"(?<!\\)(?:\\\\)*[*?\[]", segment) is not None


def _unescaped(segment: str) -> str:
    return re.sub(r"\\(.)", r"\1", segment, flags=re.S)


def segment_to_java(segment: str) -> str:
    """What one segment of a glob matches, as a Java pattern that never goes over a ``/``."""
    out, i = [], 0
    while i < len(segment):
        ch = segment[i]
        close = segment.find("]", i + 2) if ch == "[" else -1
        if ch == "\\" and i + 1 < len(segment):
            i += 1
            out.append(_quoted(segment[i]))
        elif ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            inside = segment[i + 1 : close]
            negate = inside[0] in "!^"
            text = "".join(c if c == "-" else _quoted(c) for c in inside[negate:])
            out.append(f"[^/{text}]" if negate else f"[{text}]")
            i = close
        else:
            out.append(_quoted(ch))
        i += 1
    return "".join(out)


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch


@dataclass(frozen=True)
class Request:
    """A path or glob, cut into segments; ``given`` is its place in the list of what was asked for."""

    given: int
    segments: tuple[str, ...]

    @property
    def fixed(self) -> int:
        """Segments before the first glob."""
        return next((k for k, s in enumerate(self.segments) if _is_glob(s)), len(self.segments))

    @property
    def prefix(self) -> str:
        return "/".join(map(_unescaped, self.segments[: self.fixed]))

    @property
    def regex(self) -> str | None:
        if self.fixed == len(self.segments):
            return None
        return rf"(?s)\A{'/'.join(map(segment_to_java, self.segments))}\z"


def requests_of(spark: SparkSession, paths: list[str]) -> list[Request]:
    """Requests with full paths, as the file systems write them."""
    roots: dict[str, tuple[str, str]] = {}

    def root(scheme: str) -> tuple[str, str]:
        """The root of a file system and its working folder; one look-up for each."""
        if scheme not in roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{scheme}/")
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            roots[scheme] = fs.makeQualified(path).toString().rstrip("/"), fs.getWorkingDirectory().toString()
        return roots[scheme]

    out = []
    for given, path in enumerate(paths):
        for glob in without_braces(path):
            scheme, rest = _SCHEME.fullmatch(glob).groups()
            base, folder = root(scheme or "")
            whole = base if rest.startswith("/") else folder
            parts = [s for s in rest.split("/") if s not in ("", ".")]
            out.append(Request(given, (*whole.rstrip("/").split("/"), *parts)))
    return out


def covering_globs(paths: Iterable[tuple[str, ...]]) -> list[str]:
    """A few globs that list at least what paths of segments mean, each file as seldom as possible."""
    trie: dict = {}
    for segments in paths:
        node = trie
        for segment in segments:
            node = node.setdefault(segment, {})
        node[None] = None
    return [glob.removeprefix("/") for glob in _globs_below(trie)]


def _globs_below(node: dict) -> list[str]:
    """Globs of a branch, each with a ``/`` in front; what lies below a path asked for is listed with it."""
    if None in node:
        return [""]
    alike: dict[tuple[str, ...], list[str]] = {}
    for segment, child in node.items():
        alike.setdefault(tuple(sorted(_globs_below(child))), []).append(segment)
    out = []
    for rests, names in alike.items():
        if rests == ("",) and len(names) > NAMES:
            names = ["*"]
        for k in range(0, len(names), NAMES):
            some = sorted(names[k : k + NAMES])
            part = some[0] if len(some) == 1 else "{" + ",".join(re.sub(r"(?<!\\),", r"\\,", s) for s in some) + "}"
            out += [f"/{part}{rest}" for rest in rests]
    return out


class Selection:
    """The files that ``paths`` mean: those named or matched, and those directly in folders named or matched
    (with ``recursive``, anywhere below).

    ``matches`` has a row (``path``, ``file_mtime``, ``given``) for each file and each of ``paths`` that means
    it, by its place in the list.  Hidden files, whose names start with ``_`` or ``.``, are none.
    """

    def __init__(self, spark: SparkSession, paths: str | Iterable[str], recursive: bool = False):
        self.spark, self.recursive = spark, recursive
        self.paths = list(dict.fromkeys([paths] if isinstance(paths, str) else paths))
        self.requests = requests_of(spark, self.paths)

    @cached_property
    def globs(self) -> list[str]:
        """Globs that have files or folders; one look-up for each."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        out = []
        for glob in covering_globs(r.segments for r in self.requests):
            path = jvm.org.apache.hadoop.fs.Path(glob if "/" in glob else f"{glob}/")
            hits = path.getFileSystem(conf).globStatus(path)
            if hits is not None and len(hits):
                out.append(glob)
        return out

    @cached_property
    def listed(self) -> DataFrame:
        """``path`` and ``file_mtime`` of all files that the globs list; one that two globs list comes twice."""
        if not self.globs:
            return self.spark.createDataFrame([], "path string, file_mtime timestamp")
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return stage(reader.load(self.globs).select("path", F.col("modificationTime").alias("file_mtime")))

    @cached_property
    def matches(self) -> DataFrame:
        if not self.requests:
            return self.listed.selectExpr("path", "file_mtime", "0 AS given")
        asked = [(r.given, len(r.segments), r.fixed, r.prefix, r.regex) for r in self.requests]
        requests = self.spark.createDataFrame(asked, "given int, depth int, fixed int, prefix string, regex string")
        shapes = sorted({(len(r.segments), r.fixed) for r in self.requests})
        shapes = F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(f).alias("fixed")) for d, f in shapes))
        segments, size = F.split("path", "/"), F.col("size")
        near = (lambda s: s["depth"] <= size) if self.recursive else (lambda s: s["depth"].isin(size, size - 1))
        # a file as what may have been asked for: itself, and the folders above it
        part = lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")
        files = self.listed.distinct().withColumn("size", F.size(segments))
        files = files.withColumn("shape", F.explode(F.filter(shapes, near))).select(
            "path", "file_mtime", F.col("shape.depth").alias("depth"), F.col("shape.fixed").alias("fixed"),
            part(F.col("shape.fixed")).alias("prefix"), part(F.col("shape.depth")).alias("asked"),
        )
        # the requests come from the driver, which holds them in any case
        found = files.join(F.broadcast(requests), ["depth", "fixed", "prefix"])
        found = found.filter(F.col("regex").isNull() | F.expr("rlike(asked, regex)"))
        return stage(found.select("path", "file_mtime", "given").distinct())

    @cached_property
    def missing(self) -> list[str]:
        """The paths that mean no file, in their order."""
        found = {r.given for r in self.matches.select("given").distinct().collect()}
        return [path for k, path in enumerate(self.paths) if k not in found]

    @property
    def found(self) -> list[str]:
        missing = set(self.missing)
        return [path for path in self.paths if path not in missing]

    def to_read(self) -> list[str]:
        """Paths for a recursive reader that give each file once.

        They are the globs, if those list nothing else, and the files otherwise; Spark's driver holds the
        files of a scan in any case.
        """
        files = self.matches.select("path").distinct()
        if self.listed.count() == files.count():
            return self.globs
        return [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.path) for r in files.orderBy("path").toLocalIterator()]
