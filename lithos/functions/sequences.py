"""Alignment of sequences: longest common subsequences by bit vectors, and patience line diffs."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterable, Sequence
from itertools import accumulate

#: Both texts of at most so many bytes are compared by code points, others by lines.
SCALAR_BYTES = 4096
_lines = re.compile(r"[^\n]*\n|[^\n]+").findall


def line_units(text: str) -> list[str]:
    """Lines with their terminators."""
    return _lines(text)


#: Bits of rows that an alignment keeps at once; larger blocks are divided.
ROW_BITS = 1 << 28


def _prefix_lengths(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[int]:
    """Length of the longest common subsequence of ``new`` with every prefix of ``old``; one row of bits."""
    places: dict[Hashable, int] = {}
    for i, unit in enumerate(old):
        places[unit] = places.get(unit, 0) | 1 << i
    full = (1 << len(old)) - 1
    row = full
    for unit in new:
        if hit := row & places.get(unit, 0):
            row = ((row + hit) | (row - hit)) & full
    return [0, *accumulate(bit == "0" for bit in reversed(format(row, f"0{len(old)}b")))] if old else [0]


def common_units(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence, ascending.

    Equal ends are matched first. In between, bit ``i`` of row ``j`` is clear
    where taking ``old[i]`` lengthens the best subsequence with the first ``j``
    of ``new``; walking the rows back gives the pairs, the latest ones first.
    """
    a, b = 0, 0
    n, m = len(old), len(new)
    while a < min(n, m) and old[a] == new[a]:
        a += 1
    while b < min(n, m) - a and old[n - 1 - b] == new[m - 1 - b]:
        b += 1
    head = [(i, i) for i in range(a)]
    tail = [(n - b + i, m - b + i) for i in range(b)]
    x, y = old[a : n - b], new[a : m - b]
    if not x or not y:
        return head + tail
    if len(x) * len(y) > ROW_BITS and len(y) > 1:
        # halve the new units and part the old ones where the lengths of both sides' subsequences are greatest together
        half = len(y) // 2
        before, after = _prefix_lengths(x, y[:half]), _prefix_lengths(x[::-1], y[half:][::-1])[::-1]
        cut = max(range(len(x) + 1), key=lambda i: before[i] + after[i])
        left, right = common_units(x[:cut], y[:half]), common_units(x[cut:], y[half:])
        return head + [(a + i, a + j) for i, j in left] + [(a + cut + i, a + half + j) for i, j in right] + tail
    places: dict[Hashable, int] = {}
    for i, unit in enumerate(x):
        places[unit] = places.get(unit, 0) | 1 << i
    full = (1 << len(x)) - 1
    row, rows = full, []
    for unit in y:
        hit = row & places.get(unit, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    middle = []
    i, j = len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if rows[j] >> i & 1:
            i -= 1  # old[i] adds nothing here
        elif j and not rows[j - 1] >> i & 1:
            j -= 1  # it did so already without new[j]
        else:
            middle.append((a + i, a + j))
            i -= 1
            j -= 1
    return head + middle[::-1] + tail


def units_of(old: str, new: str) -> tuple[Sequence[str], Sequence[str]]:
    """Code points if both texts are small, else lines."""
    if max(len(old.encode()), len(new.encode())) <= SCALAR_BYTES:
        return old, new
    return line_units(old), line_units(new)


def similarity(old: str, new: str) -> int:
    """floor(100 * bytes in common units / bytes of the larger text); 100 for two empty texts."""
    largest = max(len(old.encode()), len(new.encode()))
    if not largest:
        return 100
    x, y = units_of(old, new)
    return 100 * sum(len(x[i].encode()) for i, _ in common_units(x, y)) // largest


def common_length(old: Sequence[Hashable], new: Sequence[Hashable]) -> int:
    """Length of a longest common subsequence, without the pairs."""
    places: dict[Hashable, int] = {}
    for i, unit in enumerate(old):
        places[unit] = places.get(unit, 0) | 1 << i
    full = (1 << len(old)) - 1
    row = full
    for unit in new:
        if hit := row & places.get(unit, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(old) - row.bit_count()


def _counted(texts: Iterable[str | None], mode: str, known: dict[tuple[str, str], Counter]) -> list[Counter]:
    out = []
    for t in texts:
        if (mode, t or "") not in known:
            known[mode, t or ""] = Counter((t or "") if mode == "scalar" else line_units(t or ""))
        out.append(known[mode, t or ""])
    return out


def shared_bytes(old: Sequence[str | None], new: Sequence[str | None], modes: Sequence[str]) -> list[int]:
    """For each pair the most bytes that units can share by their counts; a text that several pairs name is counted once."""
    known: dict[tuple[str, str], Counter] = {}
    out = []
    for a, b, mode in zip(old, new, modes, strict=True):
        x, y = _counted((a, b), mode, known)
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        out.append(sum(len(u.encode()) * min(n, large[u]) for u, n in small.items() if u in large))
    return out


def scores_at_least(old: Sequence[str | None], new: Sequence[str | None], least: int) -> list[int | None]:
    """``similarity_at_least`` of every pair; equal pairs of texts are scored once, and a text that several pairs name is counted once."""
    known: dict[tuple[str, str], int | None] = {}
    sizes: dict[str, int] = {}
    counts: dict[tuple[str, str], Counter] = {}
    out = []
    for a, b in zip((a or "" for a in old), (b or "" for b in new), strict=True):
        if (a, b) not in known:
            for t in (a, b):
                if t not in sizes:
                    sizes[t] = len(t.encode())
            largest = max(sizes[a], sizes[b])
            mode = "scalar" if largest <= SCALAR_BYTES else "line"
            x, y = _counted((a, b), mode, counts)
            bound = sum(len(u.encode()) * min(n, y[u]) for u, n in x.items() if u in y)
            known[a, b] = None if largest and 100 * bound // largest < least else similarity_at_least(a, b, least, bounded=True)
        out.append(known[a, b])
    return out


def similarity_at_least(old: str, new: str, least: int, bounded: bool = False) -> int | None:
    """The score if it reaches ``least``; bounds by unit counts (unless ``bounded`` says that it was met) and by the length of the subsequence come first."""
    largest = max(len(old.encode()), len(new.encode()))
    if not largest:
        return 100
    x, y = units_of(old, new)
    if not bounded and 100 * sum(len(u.encode()) * n for u, n in (Counter(x) & Counter(y)).items()) // largest < least:
        return None
    n = common_length(x, y)
    sizes = [sorted((len(u.encode()) for u in z), reverse=True) for z in (x, y)]
    most = min(sum(z[:n]) for z in sizes)
    if 100 * most // largest < least:
        return None
    if not n or sizes[0][0] == sizes[1][0] == 1:
        return 100 * n // largest  # no unit has more than one byte
    score = similarity(old, new)
    return score if score >= least else None


def patience(old: Sequence[Hashable], new: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Matched index pairs of a patience diff: units unique on both sides anchor it, the gaps are aligned by longest common subsequence."""
    out: list[tuple[int, int]] = []
    work = [(0, len(old), 0, len(new))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and old[a0] == new[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and old[a1 - 1] == new[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(old[a0:a1]), Counter(new[b0:b1])
        at_b = {new[j]: j for j in range(b0, b1) if count_b[new[j]] == 1}
        pairs = [(i, at_b[old[i]]) for i in range(a0, a1) if count_a[old[i]] == 1 and old[i] in at_b]
        anchors = _increasing(pairs)
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common_units(old[a0:a1], new[b0:b1])]
            continue
        for i, j in [*anchors, (a1, b1)]:
            work.append((a0, i, b0, j))
            if i < a1:
                out.append((i, j))
            a0, b0 = i + 1, j + 1
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, in order of the first, whose second rises."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back[n] = at[k - 1] if k else -1
        tops[k : k + 1] = [j]
        at[k : k + 1] = [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def aligned_rows(old: str, new: str) -> list[tuple[str, int | None, str | None, int | None, str | None]]:
    """(kind, old number, old text, new number, new text) for each row; kinds are equal, change, delete, add.

    Lines count from 1 and lose their terminators for display. In a replaced
    block the first lines pair up as changes; the rest are deletes, then adds.
    """
    a, b = line_units(old), line_units(new)
    out: list[tuple[str, int | None, str | None, int | None, str | None]] = []
    i = j = 0
    for x, y in [*patience(a, b), (len(a), len(b))]:
        both = min(x - i, y - j)
        out += [("change", i + n + 1, a[i + n].rstrip("\r\n"), j + n + 1, b[j + n].rstrip("\r\n")) for n in range(both)]
        out += [("delete", n + 1, a[n].rstrip("\r\n"), None, None) for n in range(i + both, x)]
        out += [("add", None, None, n + 1, b[n].rstrip("\r\n")) for n in range(j + both, y)]
        if x < len(a):
            out.append(("equal", x + 1, a[x].rstrip("\r\n"), y + 1, b[y].rstrip("\r\n")))
        i, j = x + 1, y + 1
    return out


def unified(old: str, new: str, radius: int = 3) -> str:
    """Unified hunks: ``@@ -a,n +b,m @@``, a length of 1 left out, an empty side as ``0,0``."""
    a, b = line_units(old), line_units(new)
    edits: list[tuple[str, int, int, str]] = []
    i = j = 0
    for x, y in [*patience(a, b), (len(a), len(b))]:
        edits += [("-", n, j, a[n]) for n in range(i, x)]
        edits += [("+", x, n, b[n]) for n in range(j, y)]
        if x < len(a):
            edits.append((" ", x, y, a[x]))
        i, j = x + 1, y + 1
    changed = [n for n, e in enumerate(edits) if e[0] != " "]
    groups: list[list[int]] = []
    for n in changed:
        if groups and n - radius <= groups[-1][1] + radius + 1:
            groups[-1][1] = n
        else:
            groups.append([n, n])
    out = []
    for first, last in groups:
        part = edits[max(0, first - radius) : last + radius + 1]
        sides = []
        for drop, k in (("+", 1), ("-", 2)):
            own = [e for e in part if e[0] != drop]
            start = (own[0][k] + 1) if own else 0
            sides.append(f"{start},{len(own)}" if len(own) != 1 else f"{start}")
        out.append(f"@@ -{sides[0]} +{sides[1]} @@\n")
        for mark, _, _, line in part:
            out.append(mark + line + ("" if line.endswith("\n") else "\n\\ No newline at end of file\n"))
    return "".join(out)


def emphasis(old: str, new: str) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """The byte range on each side between the common prefix and the common suffix; None where it is empty."""
    n = 0
    while n < min(len(old), len(new)) and old[n] == new[n]:
        n += 1
    m = 0
    while m < min(len(old), len(new)) - n and old[-1 - m] == new[-1 - m]:
        m += 1
    out = []
    for s in (old, new):
        a, b = len(s[:n].encode()), len(s[: len(s) - m].encode())
        out.append((a, b) if b > a else None)
    return out[0], out[1]


def fuzzy(needle: str, haystack: str) -> int | None:
    """Score of ``needle`` as a subsequence, found greedily from the left; None if it is none, 0 if it is empty.

    A hit has 10 points, 25 more right behind the last hit or at the start, 10
    more at the start, after a sign or after a capital, less a sixteenth of the
    length.
    """
    score, at, previous, length = 0, 0, -1, len(haystack)
    for c in needle.lower():
        while at < length and haystack[at].lower()[:1] != c:
            at += 1
        if at == length:
            return None
        score += 10 - length // 16
        if at - 1 == previous:
            score += 25
        if at == 0 or not haystack[at - 1].isalnum() or haystack[at - 1].isupper():
            score += 10
        previous = at
        at += 1
    return score
