r"""Grammars as data: a GBNF file becomes Column expressions, one that says whether a text is in its language, one that gives its fields.

Rules are `name ::= expression` of literals, classes, `.`, groups, `|` and `* + ? {m,n}`; `#` starts a comment. Rules are
put in where they are named, so what is left is regular; a rule that names itself, directly or through others, isn't and is refused
by name, as is a rule that no line defines. An expression is written as a Java pattern over code points, and as a deterministic
automaton whose table Spark folds over a text's characters. Both know the same language. The pattern is the faster one,
but where a repeated part can itself be split in several ways it backtracks without bound, so `conforms` asks
it only where what is repeated is a single character, and the automaton otherwise.

Fields are the parts of a text that a rule stands for, in order, where the rule is named outside of repetitions and choices.
A field is named by the word before a colon that ends the literal before it (`"GOAL: " line` is `goal`), else by its rule;
names that come twice are numbered. Where a text can be read in several ways, earlier parts take as much as they can.

Null texts give null. A text that doesn't conform has no fields: null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 0x10FFFF
TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<rule>[A-Za-z][A-Za-z0-9-]*)(?=\s*::=)|(?P<is>::=)|(?P<name>[A-Za-z][A-Za-z0-9-]*)|(?P<text>"(?:\\.|[^"\\])*")"""
    r"""|(?P<set>\[(?:\\.|[^\]\\])*\])|(?P<times>[*+?]|\{\d+(?:,\d*)?\})|(?P<mark>[()|.])""",
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))|(.)", re.DOTALL)
NAMED = {"n": "\n", "r": "\r", "t": "\t"}


class GrammarError(ValueError):
    pass


@dataclass(frozen=True)
class Chars:
    """One character of some ranges of code points."""

    ranges: tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Parts:
    """One after another."""

    of: tuple


@dataclass(frozen=True)
class Choice:
    of: tuple


@dataclass(frozen=True)
class Repeated:
    of: object
    least: int
    most: int | None


@dataclass(frozen=True)
class Named:
    """What a rule stands for where it is named."""

    rule: str
    of: object = None


def _characters(text: str) -> Iterator[tuple[int, bool]]:
    """Code points of a literal or class, and whether each was escaped."""
    for two, four, eight, escaped, plain in ESCAPE.findall(text):
        number = two or four or eight
        yield (int(number, 16) if number else ord(NAMED.get(escaped, escaped) if escaped else plain)), not plain


def _class(text: str) -> Chars:
    found = list(_characters(text[1:-1]))
    outside = bool(found) and found[0] == (ord("^"), False)
    found = found[1:] if outside else found
    ranges, k = [], 0
    while k < len(found):
        wide = k + 2 < len(found) and found[k + 1] == (ord("-"), False)
        ranges.append((found[k][0], found[k + 2 if wide else k][0]))
        k += 3 if wide else 1
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    if outside:
        edges = [-1, *[x for r in merged for x in r], LAST + 1]
        merged = [[a + 1, b - 1] for a, b in zip(edges[::2], edges[1::2], strict=True) if a + 1 <= b - 1]
    if not merged:
        raise GrammarError(f"the class {text} holds no character")
    return Chars(tuple((a, b) for a, b in merged))


def parse(text: str) -> dict[str, object]:
    """The rules of a grammar, by name."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise GrammarError(f"line {text.count(chr(10), 0, at) + 1}: cannot read {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    rules: dict[str, object] = {}
    k = 0

    def choice() -> object:
        nonlocal k
        found = [parts()]
        while k < len(tokens) and tokens[k] == ("mark", "|"):
            k += 1
            found.append(parts())
        return found[0] if len(found) == 1 else Choice(tuple(found))

    def parts() -> object:
        nonlocal k
        found: list = []
        while k < len(tokens):
            kind, said = tokens[k]
            if kind in ("rule", "is") or said in ("|", ")"):
                break
            k += 1
            if kind == "times":
                if not found:
                    raise GrammarError(f"{said} repeats nothing")
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(said) or _times(said)
                found[-1] = Repeated(found[-1], least, most)
            elif kind == "text":
                letters = tuple(Chars(((c, c),)) for c, _ in _characters(said[1:-1]))
                found.append(letters[0] if len(letters) == 1 else Parts(letters))
            elif kind == "set":
                found.append(_class(said))
            elif kind == "name":
                found.append(Named(said))
            elif said == ".":
                found.append(Chars(((0, LAST),)))
            else:
                found.append(choice())
                if k >= len(tokens) or tokens[k][1] != ")":
                    raise GrammarError("a group isn't closed")
                k += 1
        return found[0] if len(found) == 1 else Parts(tuple(found))

    while k < len(tokens):
        if tokens[k][0] != "rule" or k + 1 >= len(tokens):
            raise GrammarError(f"a rule was expected at {tokens[k][1]!r}")
        name = tokens[k][1]
        if name in rules:
            raise GrammarError(f"rule {name!r} is there twice")
        k += 2
        rules[name] = choice()
    return rules


def _times(said: str) -> tuple[int, int | None]:
    least, comma, most = said[1:-1].partition(",")
    return int(least), (int(most) if most else None) if comma else int(least)


def _put_in(node: object, rules: dict[str, object], within: tuple[str, ...]) -> object:
    """node with rules in the place of their names."""
    if isinstance(node, Named):
        if node.rule in within:
            raise GrammarError(f"rule {node.rule!r} is recursive ({' -> '.join((*within, node.rule))}): only regular grammars can be compiled")
        if node.rule not in rules:
            raise GrammarError(f"rule {node.rule!r} is not defined")
        return Named(node.rule, _put_in(rules[node.rule], rules, (*within, node.rule)))
    if isinstance(node, (Parts, Choice)):
        return type(node)(tuple(_put_in(x, rules, within) for x in node.of))
    return Repeated(_put_in(node.of, rules, within), node.least, node.most) if isinstance(node, Repeated) else node


@dataclass
class Grammar:
    """A regular grammar; `root` is the rule that a whole text has to match."""

    text: str
    root: str = "root"
    tree: object = field(init=False)

    def __post_init__(self) -> None:
        self.tree = _put_in(Named(self.root), parse(self.text), ())

    # -- pattern ------------------------------------------------------------------------------------------------------

    @cached_property
    def fields(self) -> list[str]:
        return [name for name, _ in self._fields]

    @cached_property
    def _fields(self) -> list[tuple[str, Named]]:
        """The innermost rules named outside of repetitions and choices, with their fields' names."""
        found: list[tuple[str, Named]] = []

        def walk(node: object, before: list[str]) -> bool:
            if isinstance(node, Named):
                at = len(found)
                label = re.search(r"([A-Za-z_][A-Za-z0-9_]*):\s*\Z", "".join(before))
                before.clear()
                if not walk(node.of, before):
                    found.insert(at, (label.group(1).lower() if label else node.rule.replace("-", "_"), node))
                return True
            if isinstance(node, Parts):
                return any([walk(x, before) for x in node.of])
            if isinstance(node, Chars) and len(node.ranges) == 1 and node.ranges[0][0] == node.ranges[0][1]:
                before.append(chr(node.ranges[0][0]))
            else:
                before.clear()
            return False

        walk(self.tree, [])
        names = [n for n, _ in found]
        return [(f"{n}_{names[: k + 1].count(n)}" if names.count(n) > 1 else n, node) for k, (n, node) in enumerate(found)]

    def _java(self, node: object, held: list[Named]) -> str:
        if isinstance(node, Chars):
            return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in node.ranges) + "]"
        if isinstance(node, Parts):
            return "".join(self._java(x, held) for x in node.of)
        if isinstance(node, Choice):
            return "(?:" + "|".join(self._java(x, held) for x in node.of) + ")"
        if isinstance(node, Repeated):
            return f"(?:{self._java(node.of, held)}){{{node.least},{'' if node.most is None else node.most}}}" if not isinstance(node.of, Chars) else f"{self._java(node.of, held)}{{{node.least},{'' if node.most is None else node.most}}}"
        inner = self._java(node.of, held)
        return f"({inner})" if any(node is h for h in held) else f"(?:{inner})"

    @cached_property
    def pattern(self) -> str:
        """A Java pattern of whole texts with a group for each field."""
        return rf"\A{self._java(self.tree, [n for _, n in self._fields])}\z"

    @cached_property
    def plain(self) -> bool:
        """Whether only single characters are repeated, so the pattern needs no unbounded backtracking."""

        def of(node: object) -> bool:
            if isinstance(node, Repeated):
                return isinstance(node.of, Chars) or node.most == 1 and of(node.of)
            return all(of(x) for x in node.of) if isinstance(node, (Parts, Choice)) else of(node.of) if isinstance(node, Named) else True

        return of(self.tree)

    # -- automaton ----------------------------------------------------------------------------------------------------

    @cached_property
    def automaton(self) -> tuple[list[int], list[list[int]], list[bool]]:
        """(first code points of the kinds of characters, the next state of each state by kind or -1, which states accept); it starts in 0."""
        steps: list[list[tuple[Chars, int]]] = []
        free: list[list[int]] = []

        def state() -> int:
            steps.append([])
            free.append([])
            return len(steps) - 1

        def build(node: object, at: int) -> int:
            """The state after node from state `at` on."""
            if isinstance(node, Chars):
                end = state()
                steps[at].append((node, end))
                return end
            if isinstance(node, Named):
                return build(node.of, at)
            if isinstance(node, Parts):
                for x in node.of:
                    at = build(x, at)
                return at
            end = state()
            if isinstance(node, Choice):
                for x in node.of:
                    begin = state()
                    free[at].append(begin)
                    free[build(x, begin)].append(end)
                return end
            for _ in range(node.least):
                at = build(node.of, at)
            if node.most is None:
                loop = state()
                free[at].append(loop)
                free[build(node.of, loop)].append(loop)
                free[loop].append(end)
                return end
            free[at].append(end)
            for _ in range(node.most - node.least):
                at = build(node.of, at)
                free[at].append(end)
            return end

        def closed(found: set[int]) -> frozenset[int]:
            todo = list(found)
            while todo:
                for x in free[todo.pop()]:
                    if x not in found:
                        found.add(x)
                        todo.append(x)
            return frozenset(found)

        first = state()
        last = build(self.tree, first)
        firsts = sorted({0} | {x for s in steps for c, _ in s for a, b in c.ranges for x in (a, b + 1) if x <= LAST})
        begin = closed({first})
        number, table, todo = {begin: 0}, [], [begin]
        while todo:
            here = todo.pop(0)
            moves: list[set[int]] = [set() for _ in firsts]
            for s in here:
                for c, end in steps[s]:
                    for a, b in c.ranges:
                        for k, lo in enumerate(firsts):
                            if a <= lo <= b:
                                moves[k].add(end)
            row = []
            for m in moves:
                there = closed(m) if m else None
                if there and there not in number:
                    number[there] = len(number)
                    todo.append(there)
                row.append(number[there] if there else -1)
            table.append(row)
        return firsts, table, [last in s for s in number]


def in_language(x: Column, grammar: Grammar) -> Column:
    """Whether the automaton accepts the text: its table folded over the characters, in linear time."""
    firsts, table, accepts = grammar.automaton
    flat = F.split(F.lit(",".join(str(s) for row in table for s in row)), ",").cast("array<int>")  # one literal, folded when planned
    width = len(firsts)

    def kind(c: Column, low: int, high: int) -> Column:
        """The kind of a character by bisection: texts compare as their code points do."""
        if high - low == 1:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(c < F.lit(chr(firsts[mid])), kind(c, low, mid)).otherwise(kind(c, mid, high))

    said = F.split(F.lit(",".join(str(int(a)) for a in accepts)), ",").cast("array<int>")

    def fold(letters: Column, next_: Column) -> Column:
        step = lambda s, c: F.when((s < 0) | (c == ""), s).otherwise(F.get(next_, s * width + kind(c, 0, width)))
        return F.aggregate(letters, F.lit(0), step, lambda s: F.when(s < 0, F.lit(False)).otherwise(F.get(said, s) == 1))

    # The table and the characters are bound once, not once a character.
    bound = F.array(F.struct(F.split(x, "").alias("letters"), flat.alias("next")))
    return F.when(x.isNotNull(), F.get(F.transform(bound, lambda b: fold(b["letters"], b["next"])), F.lit(0)))


def conforms(x: Column, grammar: Grammar) -> Column:
    return x.rlike(grammar.pattern) if grammar.plain else in_language(x, grammar)


def fields(x: Column, grammar: Grammar) -> Column:
    """struct of the fields, as they stand in the text; null where it doesn't conform."""
    found = [F.regexp_extract(x, grammar.pattern, k + 1).alias(n) for k, n in enumerate(grammar.fields)]
    return F.when(conforms(x, grammar), F.struct(*found))
