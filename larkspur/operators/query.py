"""The keyword query grammar.

``a b`` either; ``a AND b``, ``a OR b``, ``NOT a``, ``+a`` must and ``-a`` must not occur; ``"a phrase"`` as it
stands; ``( )`` groups; ``a^2`` weighs more; ``content:a`` names the one indexed field; ``[a TO c]`` any token
between, ``{a TO c}`` without the ends, ``*`` for an open end.

A query is a tree: a leaf is a phrase (of one token or more) or a range, a group holds children that must, may or must
not match. A group matches if all of the first and none of the last do, and one of the second where there are no first.
A query with an open bracket or quote, with an operator that has nothing to bind, with a group that holds nothing
positive, or with another field is malformed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<sign>[+-])(?=[^\s+-])|(?P<field>[A-Za-z_][A-Za-z_0-9]*):(?=\S)|(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|[\[{](?P<range>[^\[\]{}]*)(?P<end>[\]}])|\^(?P<boost>\d+(?:\.\d+)?)|(?P<word>[^\s()"^\[\]{}]+)|(?P<bad>\S))')
FIELD = "content"


@dataclass
class Leaf:
    tokens: list[str]
    weight: float = 1.0

    def matches(self, joined: Column, tokens: Column) -> Column:
        return F.contains(joined, F.lit(f" {' '.join(self.tokens)} "))


@dataclass
class Range:
    """Tokens from ``low`` to ``high`` (None: open); ``closed``: whether the ends belong to it."""

    low: str | None
    high: str | None
    closed: tuple[bool, bool]
    weight: float = 1.0

    def matches(self, joined: Column, tokens: Column) -> Column:
        def inside(t: Column) -> Column:
            low = F.lit(True) if self.low is None else (t >= self.low if self.closed[0] else t > self.low)
            return low & (F.lit(True) if self.high is None else (t <= self.high if self.closed[1] else t < self.high))

        return F.exists(tokens, inside)


@dataclass
class Group:
    must: list = field(default_factory=list)
    may: list = field(default_factory=list)
    must_not: list = field(default_factory=list)

    def matches(self, joined: Column, tokens: Column) -> Column:
        def each(parts: list) -> list[Column]:
            return [p.matches(joined, tokens) for p in parts]

        out = [*each(self.must), *(~x for x in each(self.must_not))]
        if not self.must:
            out.append(reduce(lambda a, b: a | b, each(self.may)))
        return reduce(lambda a, b: a & b, out)

    def leaves(self, weight: float = 1.0) -> list[tuple[Leaf | Range, float]]:
        """Positive leaves with their weights."""
        out = []
        for p in self.must + self.may:
            out += p.leaves(weight * getattr(p, "weight", 1.0)) if isinstance(p, Group) else [(p, weight * p.weight)]
        return out

    weight: float = 1.0


@dataclass
class Parsed:
    root: Group | None
    #: weight of each token that scores
    terms: dict[str, float] = field(default_factory=dict)
    ranges: list[tuple[Range, float]] = field(default_factory=list)

    def condition(self, tokens: Column) -> Column:
        """Whether an array of tokens matches."""
        if self.root is None:
            return F.lit(False)
        if not self.root.must and not self.root.must_not and all(isinstance(p, Leaf) and len(p.tokens) == 1 for p in self.root.may):
            return F.lit(True)  # any of them: exactly what scores
        return self.root.matches(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), tokens)

    def constant(self, tokens: Column) -> Column:
        """What ranges score: their weight where they match."""
        return reduce(lambda a, b: a + b, [F.when(r.matches(tokens, tokens), F.lit(w)).otherwise(0.0) for r, w in self.ranges], F.lit(0.0))


class _Malformed(Exception):
    pass


class _Reader:
    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, str, str]] = []
        at = 0
        while at < len(text) and text[at:].strip():
            m = _TOKEN.match(text, at)
            at = m.end()
            self.items.append((m.lastgroup if m.lastgroup != "end" else "range", m[m.lastgroup] if m.lastgroup != "end" else m["range"], m["end"] and text[m.start("range") - 1] + m["end"] or ""))
        self.at = 0

    def peek(self) -> tuple[str, str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("", "", "")

    def group(self, inner: bool) -> Group | None:
        """Up to the closing bracket, or the end; None if nothing in it has a token."""
        found: list[tuple[str, object]] = []  # sign, part (None: no token)
        links: list[str] = []  # what stands before each part but the first: AND, OR or nothing
        link, negate = "", False
        while True:
            kind, value, _ = self.peek()
            if kind == "" or kind == "close":
                if (kind == "close") != inner or link or negate:
                    raise _Malformed
                self.at += kind == "close"
                break
            if kind == "word" and value in ("AND", "OR"):
                if not found or link or negate:
                    raise _Malformed
                link = value
                self.at += 1
                continue
            if kind == "word" and value == "NOT":
                if negate:
                    raise _Malformed
                negate = True
                self.at += 1
                continue
            sign, part = self.part()
            if part is None and (sign or link or negate):
                raise _Malformed
            if part is not None:
                if found:
                    links.append(link)
                found.append(("-" if negate or sign == "-" else sign, part))
            link, negate = "", False
        if not found:
            return None
        return self.combine(found, links)

    def combine(self, found: list[tuple[str, object]], links: list[str]) -> Group:
        if "OR" in links and "AND" in links:  # AND binds closer
            parts, here, held = [], [found[0]], []
            for link, f in zip(links, found[1:], strict=True):
                if link == "AND":
                    here.append(f)
                    held.append(link)
                else:
                    parts.append((here, held))
                    here, held = [f], []
            parts.append((here, held))
            found = [h[0] if len(h) == 1 else ("", self.combine(h, x)) for h, x in parts]
            links = [""] * (len(found) - 1)
        out = Group()
        for i, (sign, part) in enumerate(found):
            bound = "AND" in (links[i - 1] if i else "", links[i] if i < len(links) else "")
            (out.must_not if sign == "-" else out.must if sign == "+" or bound else out.may).append(part)
        if not out.must and not out.may:
            raise _Malformed
        return out

    def part(self) -> tuple[str, Leaf | Range | Group | None]:
        from .bm25 import _py_tokens

        kind, value, ends = self.peek()
        sign = ""
        if kind == "sign":
            sign = value
            self.at += 1
            kind, value, ends = self.peek()
        if kind == "field":
            if value != FIELD:
                raise _Malformed
            self.at += 1
            kind, value, ends = self.peek()
        self.at += 1
        if kind == "open":
            part = self.group(True)
        elif kind in ("word", "phrase"):
            tokens = _py_tokens(value)
            part = Leaf(tokens) if tokens else None
        elif kind == "range":
            m = re.fullmatch(r"\s*(\S+)\s+TO\s+(\S+)\s*", value)
            if not m:
                raise _Malformed
            low, high = (None if x == "*" else x.lower() for x in m.groups())
            part = Range(low, high, (ends[0] == "[", ends[1] == "]"))
        else:
            raise _Malformed
        if self.peek()[0] == "boost":
            if part is not None:
                part.weight = float(self.peek()[1])
            self.at += 1
        return sign, part


def parse(query: str) -> Parsed | None:
    """None if malformed."""
    try:
        root = _Reader(query).group(False)
    except _Malformed:
        return None
    out = Parsed(root)
    for leaf, weight in root.leaves() if root else []:
        if isinstance(leaf, Range):
            out.ranges.append((leaf, weight))
        else:
            for t in leaf.tokens:
                out.terms[t] = out.terms.get(t, 0.0) + weight
    return out
