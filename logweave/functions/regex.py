"""Python regular expressions as Java ones, and template expansion.

Users write patterns in Python syntax; Spark evaluates them with
java.util.regex.  The two dialects differ in group names, in the meaning of
``$``, ``.``, ``\\w`` and ``\\b``, and in character classes.  ``to_java`` walks the
tree that Python's own ``re`` parser produces and prints every node in a Java
spelling with the same meaning, so nothing depends on the spelling in the
source pattern.  All of this runs on the driver while a plan is being built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # before Python 3.11
    import sre_constants as rc
    import sre_parse as rp

# Python's idea of these classes for str patterns, spelled for Java.
WORD = r"\p{L}\p{N}_"
ASCII_WORD = "0-9A-Z_a-z"
_CLASSES = {
    rc.CATEGORY_DIGIT: (r"\p{Nd}", "0-9"),
    rc.CATEGORY_SPACE: (r"\t-\r\x1c-\x20\x85\p{Z}", r"\t-\r\x20"),
    rc.CATEGORY_WORD: (WORD, ASCII_WORD),
}
_ATOMIC = getattr(rc, "ATOMIC_GROUP", None)
_POSSESSIVE = getattr(rc, "POSSESSIVE_REPEAT", None)
# A plain dot is used only around printed patterns, which spell their own.
_ANY_DOT = "(?s)"
_NEGATED = {
    rc.CATEGORY_NOT_DIGIT: rc.CATEGORY_DIGIT,
    rc.CATEGORY_NOT_SPACE: rc.CATEGORY_SPACE,
    rc.CATEGORY_NOT_WORD: rc.CATEGORY_WORD,
}


def expand(template: str, names: dict[str, str]) -> str:
    """Replace every ``${name}`` by its (expanded) text; all else is untouched."""

    def fill(text: str, open_names: tuple[str, ...]) -> str:
        def one(match: re.Match) -> str:
            name = match.group(1)
            if name in open_names:
                raise ValueError(f"circular reference: {' -> '.join((*open_names, name))}")
            if name not in names:
                raise ValueError(f"unknown name ${{{name}}} in {template!r}")
            return fill(names[name], (*open_names, name))

        return re.sub(r"\$\{(\w+)\}", one, text)

    return fill(template, ())


@dataclass(frozen=True)
class Group:
    """Where a named group ends up in the Java pattern.

    ``guard`` is the group around the optional part the group sits in (None if
    it always takes part): an empty guard means the group took no part.
    """

    name: str
    index: int
    guard: int | None = None


@dataclass(frozen=True)
class JavaRegex:
    source: str
    body: str
    flags: str
    groups: tuple[Group, ...]
    pieces: tuple[tuple[str | None, int], ...] = ()
    literal: str | None = None

    @property
    def pattern(self) -> str:
        """For ``rlike``: found anywhere."""
        return self.flags + self.body

    def cutting(self, anchored: bool = False) -> str:
        """With ``pieces``: consumes the whole input, text around the match included."""
        head = r"\A()" if anchored else r"\A(.*?)"
        return f"{_ANY_DOT}{self.flags}{head}{self.body}(.*)\\z"

    def test(self, col: Column) -> Column:
        """True where the pattern is found; a plain substring test comes first
        when some text must occur in every match."""
        found = col.rlike(self.pattern)
        return F.contains(col, F.lit(self.literal)) & found if self.literal else found

    def test_sql(self, column: str) -> str:
        """The same as SQL text."""
        found = f"rlike({column}, {sql_text(self.pattern)})"
        return f"contains({column}, {sql_text(self.literal)}) AND {found}" if self.literal else found


@dataclass
class _Printer:
    ignore_case: bool
    ascii: bool
    multiline: bool
    dotall: bool
    split: bool = False
    count: int = 0
    numbers: dict[int, int] = field(default_factory=dict)
    guards: dict[int, int | None] = field(default_factory=dict)
    pieces: list[tuple[int | None, int]] = field(default_factory=list)

    # -- leaves --------------------------------------------------------------
    @staticmethod
    def char(code: int) -> str:
        ch = chr(code)
        if not ch.isprintable():
            return f"\\x{{{code:x}}}"
        return "\\" + ch if ch in r"\^$.|?*+()[]{}-&~#" else ch

    def category(self, cat) -> str:
        return _CLASSES[cat][1 if self.ascii else 0]

    def one_of(self, items) -> str:
        negate, parts = "", []
        for op, arg in items:
            if op is rc.NEGATE:
                negate = "^"
            elif op is rc.LITERAL:
                parts.append(self.char(arg))
            elif op is rc.RANGE:
                parts.append(f"{self.char(arg[0])}-{self.char(arg[1])}")
            elif arg in _NEGATED:
                parts.append(f"[^{self.category(_NEGATED[arg])}]")
            else:
                parts.append(self.category(arg))
        if len(items) == 1 and items[0][1] in _NEGATED:
            return parts[0]
        return f"[{negate}{''.join(parts)}]"

    def at(self, where) -> str:
        word = f"[{ASCII_WORD if self.ascii else WORD}]"
        if where is rc.AT_BEGINNING and self.multiline:
            return r"(?:\A|(?<=\n))"
        if where in (rc.AT_BEGINNING, rc.AT_BEGINNING_STRING):
            return r"\A"
        if where is rc.AT_END and self.multiline:
            return r"(?=\n|\z)"
        if where is rc.AT_END:
            return r"(?=\n?\z)"
        if where is rc.AT_END_STRING:
            return r"\z"
        if where is rc.AT_BOUNDARY:
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        return f"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"

    # -- structure -----------------------------------------------------------
    def open(self) -> int:
        self.count += 1
        return self.count

    def sequence(self, nodes, guard, named) -> str:
        """Print nodes; in split mode each stretch without named groups is captured."""
        if not self.split:
            return "".join(self.node(op, arg, guard, named) for op, arg in nodes)
        out, run, number = [], [], 0
        for op, arg in nodes:
            if _has_named(op, arg, named):
                if run:
                    out.append(f"({''.join(run)})")
                    self.pieces.append((None, number))
                    run = []
                out.append(self.node(op, arg, guard, named))
            else:
                if not run:
                    number = self.open()
                run.append(self.plain(op, arg, named))
        if run:
            out.append(f"({''.join(run)})")
            self.pieces.append((None, number))
        return "".join(out)

    def plain(self, op, arg, named) -> str:
        was, self.split = self.split, False
        try:
            return self.node(op, arg, None, named)
        finally:
            self.split = was

    def node(self, op, arg, guard, named) -> str:
        if op is rc.LITERAL:
            return self.char(arg)
        if op is rc.NOT_LITERAL:
            return f"[^{self.char(arg)}]"
        if op is rc.ANY:
            return "(?s:.)" if self.dotall else r"[^\n]"
        if op is rc.IN:
            return self.one_of(arg)
        if op is rc.AT:
            return self.at(arg)
        if op is rc.BRANCH:
            inner = []
            for branch in arg[1]:
                if any(_has_named(o, a, named) for o, a in branch) and not self.split:
                    own = self.open()
                    inner.append(f"({self.sequence(branch, own, named)})")
                else:
                    inner.append(self.sequence(branch, guard, named))
            return f"(?:{'|'.join(inner)})"
        if op is rc.SUBPATTERN:
            return self.group(arg, guard, named)
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, _POSSESSIVE):
            return self.repeat(op, arg, guard, named)
        if op is _ATOMIC:
            return f"(?>{self.sequence(arg, guard, named)})"
        if op in (rc.ASSERT, rc.ASSERT_NOT):
            sign = "=" if op is rc.ASSERT else "!"
            ahead = "" if arg[0] > 0 else "<"
            return f"(?{ahead}{sign}{self.sequence(arg[1], guard, named)})"
        if op is rc.GROUPREF:
            return f"(?:\\{self.numbers[arg]})"
        if op is rc.FAILURE:
            return r"(?!)"
        raise ValueError(f"regular expression construct not supported: {op}")

    def group(self, arg, guard, named) -> str:
        number, on, off, body = arg
        flags = "i" if on & re.IGNORECASE else ""
        flags += "-i" if off & re.IGNORECASE else ""
        if (on | off) & ~(re.IGNORECASE | re.UNICODE):
            raise ValueError("only the i flag may change inside a pattern")
        if number is None:
            return f"(?{flags}:{self.sequence(body, guard, named)})"
        own = self.numbers[number] = self.open()
        self.guards[number] = guard
        if self.split and number in named:
            self.pieces.append((number, own))
            was, self.split = self.split, False
            inner = self.sequence(body, guard, named)
            self.split = was
        else:
            # also where only parts of it are wanted: it may be referred to
            inner = self.sequence(body, guard, named)
        return f"({inner})"

    def repeat(self, op, arg, guard, named) -> str:
        low, high, item = arg
        body_named = any(_has_named(o, a, named) for o, a in item)
        if self.split and body_named and high != 1:
            raise ValueError("a named group inside a repetition cannot be rewritten in place")
        if low == 0 and body_named and not self.split:
            own = self.open()
            body = f"({self.sequence(item, own, named)})"
        else:
            body = self.sequence(item, guard, named)
            if len(item) != 1 or item[0][0] not in (rc.LITERAL, rc.NOT_LITERAL, rc.IN, rc.ANY):
                body = f"(?:{body})"
        span = f"{{{low},}}" if high is rc.MAXREPEAT else f"{{{low},{high}}}"
        span = f"{{{low}}}" if low == high else span
        span = {"{1}": "", "{0,}": "*", "{1,}": "+", "{0,1}": "?"}.get(span, span)
        return body + span + {rc.MIN_REPEAT: "?", _POSSESSIVE: "+"}.get(op, "")


def _has_named(op, arg, named) -> bool:
    """Does this node contain a named group?"""
    if op is rc.SUBPATTERN:
        return arg[0] in named or any(_has_named(o, a, named) for o, a in arg[3])
    if op is rc.BRANCH:
        return any(_has_named(o, a, named) for branch in arg[1] for o, a in branch)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, _POSSESSIVE):
        return any(_has_named(o, a, named) for o, a in arg[2])
    if op in (rc.ASSERT, rc.ASSERT_NOT):
        return any(_has_named(o, a, named) for o, a in arg[1])
    if op is _ATOMIC:
        return any(_has_named(o, a, named) for o, a in arg)
    return False


def _required_text(nodes) -> str:
    """The longest text that every match must contain."""
    best, run = "", ""
    for op, arg in nodes:
        if op is rc.LITERAL:
            run += chr(arg)
            best = max(best, run, key=len)
            continue
        run = ""
        inner = ""
        if op is rc.SUBPATTERN and not (arg[1] | arg[2]):
            inner = _required_text(arg[3])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            inner = _required_text(arg[2])
        best = max(best, inner, key=len)
    return best


#: Capitals as small letters; and the letters beyond ASCII that equal an ASCII letter when case is ignored.
FOLDED = {chr(c): chr(c + 32) for c in range(65, 91)} | {"\u017f": "s", "\u212a": "k", "\u0130": "i", "\u0131": "i"}


def required_texts(pattern: str, ignore_case: bool = False, least: int = 3) -> list[str] | None:
    """Texts of ``least`` letters or more of which every match holds one; None if there are none such.

    With ``ignore_case`` they are in ASCII, written as ``FOLDED`` has it, and so must be the text searched.
    """
    tree = rp.parse(pattern, re.IGNORECASE if ignore_case else 0)
    if not ignore_case and tree.state.flags & re.IGNORECASE:
        return None

    def indexed(text: str) -> str:
        if not ignore_case:
            return text
        folded = "".join(FOLDED.get(c, c) for c in text)
        # of equally long ones the last
        return max(reversed(re.split(r"[^\x00-\x7f]+", folded)), key=len)

    def best(found: list[list[str]]) -> list[str] | None:
        found = [texts for texts in (sorted({indexed(t) for t in texts}) for texts in found) if min(map(len, texts)) >= least]
        return max(found, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)

    def of(nodes) -> list[str] | None:
        found, run = [], ""
        nodes = list(_flat(nodes))
        for op, arg in nodes:
            if op is rc.LITERAL:
                run += chr(arg)
                continue
            inner = None
            if op is rc.BRANCH:
                found.append([run + _leading(branch) for branch in arg[1]])
                each = [of(branch) for branch in arg[1]]
                inner = [t for texts in each for t in texts] if all(each) else None
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, _POSSESSIVE) and arg[0] > 0:
                inner = of(arg[2])
            elif op is _ATOMIC:
                inner = of(arg)
            found += [[run], *([inner] if inner else [])]
            run = ""
        return best([*found, [run]])

    return of(tree)


def whole_word(pattern: str) -> str | None:
    """The text of a pattern that is a plain text between two word boundaries; None for any other.

    Where that text is made of word characters alone, the pattern is found where the text is a whole word.
    """
    tree = rp.parse(pattern)
    nodes = list(_flat(tree))
    boundary, inner = (rc.AT, rc.AT_BOUNDARY), nodes[1:-1]
    if tree.state.flags & (re.IGNORECASE | re.ASCII) or len(nodes) < 3 or not nodes[0] == nodes[-1] == boundary:
        return None
    return "".join(chr(arg) for _, arg in inner) if all(op is rc.LITERAL for op, _ in inner) else None


def _flat(nodes):
    """Nodes with those of groups that change no flag in their place."""
    for op, arg in nodes:
        if op is rc.SUBPATTERN and not (arg[1] | arg[2]):
            yield from _flat(arg[3])
        else:
            yield op, arg


def _leading(nodes) -> str:
    """The text that all matches begin with."""
    out = ""
    for op, arg in _flat(nodes):
        if op is not rc.LITERAL:
            break
        out += chr(arg)
    return out


@lru_cache(maxsize=4096)
def to_java(pattern: str, ignore_case: bool = False, pieces: bool = False, only: frozenset[str] | None = None) -> JavaRegex:
    """Translate a Python pattern.

    With ``pieces`` the text between named groups is captured too, so that a
    matched string can be put together again around changed group values.  If
    ``only`` some groups may change, the others belong to the text between.
    """
    try:
        tree = rp.parse(pattern, re.IGNORECASE if ignore_case else 0)
    except re.error as err:
        raise ValueError(f"invalid pattern {pattern!r}: {err}") from None
    flags = tree.state.flags
    names = {number: name for name, number in tree.state.groupdict.items()}
    printer = _Printer(
        ignore_case=bool(flags & re.IGNORECASE),
        ascii=bool(flags & re.ASCII),
        multiline=bool(flags & re.MULTILINE),
        dotall=bool(flags & re.DOTALL),
        split=pieces,
        count=1 if pieces else 0,  # group 1 holds the text before the match
    )
    named = {number for number, name in names.items() if only is None or name in only}
    body = f"(?:{printer.sequence(tree, None, named)})"
    groups = tuple(
        Group(names[n], printer.numbers[n], printer.guards[n])
        for n in sorted(names)
        if n in printer.numbers
    )
    literal = "" if printer.ignore_case else _required_text(tree)
    if pieces:
        printer.pieces = [(None, 1), *printer.pieces, (None, printer.open())]
    return JavaRegex(
        source=pattern,
        body=body,
        flags="(?iu)" if printer.ignore_case else "",
        groups=groups,
        pieces=tuple((names.get(n) if n else None, i) for n, i in printer.pieces),
        literal=literal if len(literal) > 2 else None,
    )


def sql_text(text: str) -> str:
    """A SQL string literal; raw ones need no escapes, whatever the session settings."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' not in text:
        return f'r"{text}"'
    return "concat(" + ", '\"', ".join(f'r"{part}"' for part in text.split('"')) + ")"


def captures_sql(
    column: str, regexes: list[tuple[JavaRegex, str]], anchored: bool = False
) -> str:
    """SQL for the lines written by the first regex that matches, as an array.

    Each regex comes with what it writes for a match, one value per line with
    ``$n`` for its groups.  The values are split again; a log line holds no line
    feed, so the split is exact, and a text that holds one has already been
    rewritten and is left alone by the regexes that follow.  Without a match the
    array has one element.  Each regex runs once.
    """
    for i, (regex, written) in enumerate(regexes):
        unchanged = r"(?![^\n]*\n)" if i else ""
        head = r"\A" + unchanged + ("" if anchored else ".*?")
        whole = f"{_ANY_DOT}{regex.flags}{head}{regex.body}.*\\z"
        column = f"regexp_replace({column}, {sql_text(whole)}, {sql_text(written)})"
    return f"split({column}, '\n', -1)"


def compute_once(df, name: str, value: Column, apart: bool = False):
    """Add a column that later filters and projections cannot evaluate again.

    Catalyst copies the definition of a projected column into every filter
    pushed below it.  A one-element ``explode`` stops that for this column only,
    while filters on other columns still reach the scan.  A value of many patterns
    is computed ``apart`` from the generated code around it: in there it would make
    a method so long that the JVM only interprets it.
    """
    value = F.expr(value) if isinstance(value, str) else value
    # no code is generated for a lambda
    values = F.transform(F.array(F.lit(0)), lambda _: value) if apart else F.array(value)
    return df.select("*", F.explode(values).alias(name))
