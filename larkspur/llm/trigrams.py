"""Boolean trigram queries of regular expressions.

A query says which trigrams a text must hold, in lower case, if the expression matches in it. It is a set of
clauses, of which one must hold; a clause is a set of trigrams, all of which must occur. ``ANY`` has an empty
clause: nothing is mandatory.

The expression's parsed tree is walked once. Of each part four things are known: ``exact``, all strings that it
can match, if they are few; strings one of which every match begins with, and ends with; and the query of what
is certain inside. Parts that stand beside each other contribute the trigrams across their border as well.
What grows too large is given up, which makes a query weaker, never wrong.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from re import _constants as kind
from re import _parser as parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings of a set, clauses of a query and characters of a class, beyond which they are given up.
MANY, CLAUSES, WIDE = 64, 64, 8


class Part(NamedTuple):
    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: Query


EMPTY = Part(frozenset([""]), frozenset([""]), frozenset([""]), ANY)
UNKNOWN = Part(None, frozenset([""]), frozenset([""]), ANY)


def least(query: Query) -> Query:
    """Without clauses that hold another clause."""
    return frozenset(c for c in query if not any(o < c for o in query))


def both(a: Query, b: Query) -> Query:
    out = least(frozenset(x | y for x, y in product(a, b)))
    return out if len(out) <= CLAUSES else min(a, b, key=len)


def either(a: Query, b: Query) -> Query:
    out = least(a | b)
    return out if len(out) <= CLAUSES else ANY


def certain(strings: frozenset[str]) -> Query:
    """The query of a text that holds one of these strings."""
    out = least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))
    return out if len(out) <= CLAUSES else ANY


def of_strings(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings, ANY) if len(strings) <= MANY else UNKNOWN


def shortened(strings: set[str], end: bool) -> frozenset[str]:
    """At most MANY strings that the given ones end, or begin, with."""
    size = max(map(len, strings), default=0)
    out = frozenset(strings)
    while len(out) > MANY:
        size -= 1
        out = frozenset(s[max(0, len(s) - size) :] if end else s[:size] for s in out)
    return out


def settled(p: Part) -> Part:
    """What the strings say goes into the query, as the part stops being exact."""
    if p.exact is None:
        return p
    return Part(None, p.prefix, p.suffix, both(p.query, certain(p.exact)))


def beside(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MANY:
        return of_strings(frozenset(x + y for x, y in product(a.exact, b.exact)))
    prefix = {x + y for x, y in product(a.exact, b.prefix)} if a.exact is not None else a.prefix
    suffix = {x + y for x, y in product(a.suffix, b.exact)} if b.exact is not None else b.suffix
    border = {x[-2:] + y[:2] for x, y in product(a.suffix, b.prefix)}
    a, b = settled(a), settled(b)
    # strings that a part begins or ends with are certain too, and may be cut short below
    known = both(both(a.query, b.query), both(certain(a.suffix), certain(b.prefix)))
    return Part(None, shortened(prefix, False), shortened(suffix, True), both(known, certain(frozenset(border))))


def one_of(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MANY:
        return of_strings(a.exact | b.exact)
    a, b = settled(a), settled(b)
    return Part(None, shortened(a.prefix | b.prefix, False), shortened(a.suffix | b.suffix, True), either(whole(a), whole(b)))


def whole(p: Part) -> Query:
    """The query of a part that stands alone."""
    p = settled(p)
    return both(p.query, both(certain(p.prefix), certain(p.suffix)))


def _letters(items: list) -> Part:
    """A class of characters."""
    out: set[str] = set()
    for what, value in items:
        if what is kind.LITERAL:
            out.add(chr(value).lower())
        elif what is kind.RANGE and value[1] - value[0] < 128:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:  # a negation, a category or a wide range
            return UNKNOWN
        if len(out) > WIDE:
            return UNKNOWN
    return of_strings(frozenset(out)) if all(c.isascii() for c in out) else UNKNOWN


def _part(what: object, value: object) -> Part:
    if what is kind.LITERAL:
        return of_strings(frozenset([chr(value).lower()])) if value < 128 else UNKNOWN
    if what is kind.IN:
        return _letters(value)
    if what is kind.SUBPATTERN:
        return _parts(value[-1])
    if what is kind.ATOMIC_GROUP:
        return _parts(value)
    if what is kind.BRANCH:
        first, *rest = map(_parts, value[1])
        for p in rest:
            first = one_of(first, p)
        return first
    if what in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
        low, high, inner = value
        p = _parts(inner)
        if low == 0:
            return one_of(EMPTY, p) if high == 1 else UNKNOWN
        out = EMPTY
        for _ in range(min(low, 3)):
            out = beside(out, p)
        if high == low <= 3:
            return out
        # more may stand between the first and the last of them
        out = settled(out)
        return Part(None, out.prefix, out.suffix, whole(out))
    if what in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
        return EMPTY
    return UNKNOWN  # any character, a negated literal, a back reference


def _parts(items: object) -> Part:
    out = EMPTY
    for what, value in items:
        out = beside(out, _part(what, value))
    return out


def query(pattern: str) -> Query:
    """The trigram query of a regular expression (syntax that Python and Java share)."""
    return whole(_parts(parser.parse(pattern)))
