"""Literals that every match of a regex must hold, and one pattern that finds many literals in a single pass."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from re import _parser as parser

from pyspark.sql import Column, functions as F

#: Literals are at least that long, and alternatives at most that many.
SHORTEST, MOST = 3, 64

# Letters beyond ASCII that a case-insensitive regex takes for ASCII ones.
_FOLDED, _PLAIN = "ſıİK", "siik"


def fold(text: Column) -> Column:
    """Text as the literals are compared with it: lower case, and look-alikes of ASCII letters under case folding as those."""
    return F.lower(F.translate(text, _FOLDED, _PLAIN))


def _has_nested_class(regex: str) -> bool:
    inside, i = False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif inside:
            if c == "[" or regex.startswith("&&", i):
                return True
            inside = c != "]"
        elif c == "[":
            inside = True
            i += 1 if regex.startswith("^", i + 1) else 0
            i += 1 if regex.startswith("]", i + 1) else 0
        i += 1
    return False


def required_literals(regex: str) -> frozenset[str] | None:
    """A set of lower-case ASCII strings one of which is in every (folded) text that matches; None if none can be told.

    Patterns that this library's parser reads otherwise than the JVM, or not at all, give None.
    """
    plain = re.sub(r"\[:\w+:\]", r"\\w\\s", regex)
    if _has_nested_class(plain):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = parser.parse(plain)
    except (re.error, OverflowError, RecursionError, Warning):
        return None
    return _required(tree)


def _choices(op, value) -> frozenset[str] | None:
    """The strings that one item can be, if they are few."""
    if op is parser.LITERAL:
        return frozenset([chr(value).lower()]) if value < 128 else None
    if op is parser.IN:
        out: set[str] = set()
        for kind, x in value:
            if kind is parser.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is parser.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                out.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is parser.SUBPATTERN:
        return _whole(value[3])
    if op is parser.BRANCH:
        parts = [_whole(b) for b in value[1]]
        return frozenset().union(*parts) if all(p is not None for p in parts) and sum(map(len, parts)) <= MOST else None
    if op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
        return frozenset([""])
    return None


def _whole(items) -> frozenset[str] | None:
    out = frozenset([""])
    for op, value in items:
        own = _choices(op, value)
        if own is None or len(own) * len(out) > MOST:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _inner(op, value) -> frozenset[str] | None:
    """What an item that is not just a few strings requires."""
    if op is parser.SUBPATTERN:
        return _required(value[3])
    if op is parser.ATOMIC_GROUP:
        return _required(value)
    if op is parser.BRANCH:
        parts = [_required(b) for b in value[1]]
        if any(p is None for p in parts) or sum(map(len, parts)) > MOST:
            return None
        return frozenset().union(*parts)
    if op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] >= 1:
        return _required(value[2])
    return None


def _required(items) -> frozenset[str] | None:
    found: list[frozenset[str]] = []
    run = frozenset([""])
    for op, value in items:
        own = _choices(op, value)
        if own is not None and len(own) * len(run) <= MOST:
            run = frozenset(a + b for a in run for b in own)
            continue
        found.append(run)
        run = own if own is not None else frozenset([""])
        inner = None if own is not None else _inner(op, value)
        if inner is not None:
            found.append(inner)
    found.append(run)
    fit = [f for f in found if f and min(map(len, f)) >= SHORTEST]
    return max(fit, key=lambda f: (min(map(len, f)), -len(f))) if fit else None


def _trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}
    return root


def _pattern(node: dict) -> str:
    branches = [re.escape(c) + _pattern(child) for c, child in sorted(node.items()) if c]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
    return body + "?" if "" in node else body


def literals_in(folded: Column, words: Sequence[str]) -> Column:
    """The distinct words that begin somewhere in a folded text; of those that begin at one place the longest.

    One pass over the text by a prefix tree of all words.
    """
    if not words:
        return F.expr("cast(array() as array<string>)")
    second = {w[:2] for w in words}
    first = "".join(re.escape(c) for c in sorted({w[0] for w in second}))
    then = "".join(re.escape(c) for c in sorted({w[1] for w in second}))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=[{first}][{then}])(?=({_pattern(_trie(words))}))"), F.lit(1)))


def any_of(found: Column, words: frozenset[str], all_words: Iterable[str]) -> Column:
    """True if ``literals_in`` found one of ``words``, by itself or inside a longer word."""
    holding = sorted(w for w in all_words if any(own in w for own in words))
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in holding]))
