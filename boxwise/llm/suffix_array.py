"""Suffix arrays by induced sorting, and permuted longest common prefixes."""

from __future__ import annotations


def suffix_array(s: list[int], top: int) -> list[int]:
    """Start positions of the suffixes of ``s`` (values 0 to top) in order.

    Suffixes are classed as smaller (S) or larger (L) than their successor; the
    leftmost S ones of each run are sorted by inducing, named, sorted recursively
    where names repeat, and all others are induced from them in two passes."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        small[i] = small[i + 1] if a == b else a < b
    sizes = [0] * (top + 2)
    for c in s:
        sizes[c + 1] += 1
    for c in range(top + 1):
        sizes[c + 1] += sizes[c]
    heads, tails = sizes[:-1], sizes[1:]

    def induced(seeds: list[int]) -> list[int]:
        out = [-1] * n
        free = tails[:]
        for i in reversed(seeds):
            c = s[i]
            free[c] -= 1
            out[free[c]] = i
        free = heads[:]
        c = s[n - 1]  # the last suffix is larger than the empty one after it
        out[free[c]] = n - 1
        free[c] += 1
        for i in out:
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                out[free[c]] = i - 1
                free[c] += 1
        free = tails[:]
        for at in range(n - 1, -1, -1):
            i = out[at]
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                free[c] -= 1
                out[free[c]] = i - 1
        return out

    starts = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if not starts:
        return induced([])
    end = {a: b for a, b in zip(starts, starts[1:] + [n])}
    names, name, before = {}, -1, None
    for i in induced(starts):
        if i in end:
            part = s[i:end[i] + 1]
            if part != before or end[i] == n:
                name += 1
            before = part if end[i] < n else None
            names[i] = name
    if name + 1 == len(starts):
        ordered = sorted(starts, key=names.__getitem__)
    else:
        ordered = [starts[i] for i in suffix_array([names[i] for i in starts], name)]
    return induced(ordered)


def permuted_prefixes(s: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """(common prefix of each suffix with the one before it in order, that one's
    position or -1), by position in the text: one pass, as the prefix shrinks by
    at most one from a position to the next."""
    n = len(s)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    out = [0] * n
    same = 0
    for i in range(n):
        j = before[i]
        if j < 0:
            same = 0
            continue
        while i + same < n and j + same < n and s[i + same] == s[j + same]:
            same += 1
        out[i] = same
        if same:
            same -= 1
    return out, before


def longest_matches(s: list[int], order: list[int]) -> list[int]:
    """Per position, the longest prefix its suffix shares with any other suffix."""
    up, before = permuted_prefixes(s, order)
    best = up[:]
    for i, j in enumerate(before):
        if j >= 0 and up[i] > best[j]:
            best[j] = up[i]
    return best
