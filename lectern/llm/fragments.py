"""Fragments of two tokenisations of one text, an associative monoid, and the units that they are made of.

A fragment stands for a range of a text's bytes: the tokens of A and of B that end in it. Where both end at
one byte a group closes. What comes before the first such byte is the open prefix, what comes after the
last one the open suffix, and in between lie closed groups. Two neighbours compose into the fragment of
both ranges: suffix and prefix meet in one group. NONE is the neutral element.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Factor of A's id in the code of an id pair.
B_IDS = 1 << 24

#: (ids, ends) of A and of B, ends as byte offsets in the text.
Open = tuple[list[int], list[int], list[int], list[int]]
NOTHING: Open = ([], [], [], [])


@dataclass
class Fragment:
    #: Both tokenisations give back the bytes of the range.
    sound: bool = True
    #: A group closes in the range; if not, all tokens are in prefix.
    cut: bool = False
    prefix: Open = NOTHING
    suffix: Open = NOTHING
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    #: The closed groups between prefix and suffix, as text.
    closed: str = ""
    #: Code of each linked id pair in them and how many links it has.
    links: dict[int, int] = field(default_factory=dict)


NONE = Fragment()


def shown(group: Open) -> str:
    return ",".join(map(str, group[0])) + "|" + ",".join(map(str, group[2]))


def linked(group: Open) -> list[int]:
    """Codes of the pairs that overlap: one at every byte where a token of either ends."""
    a, a_ends, b, b_ends = group
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append(a[i] * B_IDS + b[j])
        x, y = a_ends[i], b_ends[j]
        i += x <= y
        j += y <= x
    return out


def _with(links: dict[int, int], *more: dict[int, int]) -> dict[int, int]:
    out = dict(links)
    for one in more:
        for code, n in one.items():
            out[code] = out.get(code, 0) + n
    return out


def counted(codes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for code in codes:
        out[code] = out.get(code, 0) + 1
    return out


def _joined(left: Open, right: Open) -> Open:
    return tuple(x + y for x, y in zip(left, right))


def of_tokens(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> Fragment:
    """The fragment of the tokens that end in a range."""
    both = sorted(set(a_ends) & set(b_ends))
    n_a, n_b = len(a), len(b)
    if not both:
        return Fragment(prefix=(a, a_ends, b, b_ends), n_a=n_a, n_b=n_b)
    at_a = np.searchsorted(a_ends, both, "right").tolist()
    at_b = np.searchsorted(b_ends, both, "right").tolist()
    group = lambda i, j, k, m: (a[i:j], a_ends[i:j], b[k:m], b_ends[k:m])
    groups = [group(*x) for x in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:])]
    codes = [code for g in groups for code in linked(g)]
    return Fragment(
        True, True, group(0, at_a[0], 0, at_b[0]), group(at_a[-1], n_a, at_b[-1], n_b),
        n_a, n_b, len(groups), ";".join(map(shown, groups)), counted(codes),
    )


def compose(left: Fragment, right: Fragment) -> Fragment:
    sound, n_a, n_b = left.sound and right.sound, left.n_a + right.n_a, left.n_b + right.n_b
    if not right.cut:
        if not left.cut:
            return Fragment(sound, prefix=_joined(left.prefix, right.prefix), n_a=n_a, n_b=n_b)
        suffix = _joined(left.suffix, right.prefix)
        return Fragment(sound, True, left.prefix, suffix, n_a, n_b, left.n_groups, left.closed, left.links)
    if not left.cut:
        prefix = _joined(left.prefix, right.prefix)
        return Fragment(sound, True, prefix, right.suffix, n_a, n_b, right.n_groups, right.closed, right.links)
    middle = _joined(left.suffix, right.prefix)
    closed = ";".join(x for x in (left.closed, shown(middle), right.closed) if x)
    links = _with(left.links, counted(linked(middle)), right.links)
    n_groups = left.n_groups + 1 + right.n_groups
    return Fragment(sound, True, left.prefix, right.suffix, n_a, n_b, n_groups, closed, links)


@dataclass
class Whole:
    """What a text's fragment is in the end."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    links: dict[int, int] = field(default_factory=dict)


def finish(f: Fragment) -> Whole:
    """Of the fragment of a whole text, where both tokenisations end together; an unsound one has no tokens."""
    if not f.sound or not f.cut:
        return Whole()
    groups = ";".join(x for x in (shown(f.prefix), f.closed) if x)
    return Whole(f.n_a, f.n_b, f.n_groups + 1, groups, _with(f.links, counted(linked(f.prefix))))


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at a single space between two characters that are surely not white space.

    A's pre-tokenizer parts words there, and no piece of B goes on with a space after another character, so that
    units are tokenised apart exactly as together. Other borders would do, too; a longer unit costs only time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ascii_ = (data > 0x20) & (data < 0x7F)
    # leads of characters from U+00C0 to U+07FF and U+4000 to U+9FFF, none of them white space
    two, three = (data >= 0xC3) & (data <= 0xDF), (data >= 0xE4) & (data <= 0xE9)
    last = ascii_.copy()
    last[1:] |= two[:-1]
    last[2:] |= three[:-2]
    first = ascii_ | two | three
    starts = np.zeros(n, bool)
    starts[1:-1] = (data[1:-1] == 0x20) & last[:-2] & first[2:]
    inside = offsets[(offsets < n)]
    starts[inside] = True
    return np.flatnonzero(starts)
