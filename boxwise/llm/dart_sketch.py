"""Word shingles and DartMinHash sketches of one text, in numpy.

Every element of a weighted set owns a plane (weight, rank) on which darts fall
as a Poisson process of one dart per unit of area, drawn from hashes of the
element: equal elements get equal darts in every text. A set throws the darts
below its elements' weights in order of rank; each dart has a hashed coordinate,
and a coordinate of the sketch keeps its earliest dart. Two sets agree in a
coordinate with a probability equal to their weighted Jaccard similarity. The
work is proportional to the number of elements and darts, not to their product.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Fixed values of the published 64-bit finalizer.
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
# P(N <= n) of a Poisson variable of mean 1
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 16.0)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * (1.0 / (1 << 53))


class Shingler:
    """Distinct hashed shingles of a text and how often each occurs. Words are
    the lower-cased parts between white space; a text of fewer words than a
    shingle is one shingle, a text without words has none."""

    def __init__(self, words: int = 5, cache: int = 1_000_000):
        import xxhash
        self.words, self.limit, self.digest = words, cache, xxhash.xxh3_64_intdigest
        self.cache: dict[str, int] = {}

    def sequence(self, words: list[str]) -> np.ndarray:
        cache, digest = self.cache, self.digest
        if len(cache) > self.limit:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = digest(w)
            out.append(h)
        return np.array(out, U)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, U), np.empty(0, np.int64)
        h = self.sequence(words)
        n = min(self.words, len(h))
        size = len(h) - n + 1
        out = np.full(size, U(n))
        for i in range(n):
            out = out * GOLDEN + (h[i:i + size] ^ (out >> U(29)))
        return np.unique(mixed(out), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray | None, limits: np.ndarray, coordinates: int):
    """(element, rank, coordinate, identity) of the darts of rank up to their
    element's limit, elements being numbered by position.

    The plane of an element is cut into cells of area 1: columns [0,1), [1,2),
    [2,4), [4,8), ... of the weight, and in each column rank steps of the inverse
    width. A cell's darts depend on the element and the cell alone."""
    out = []
    top = 1.0 if weights is None else float(weights.max())
    column, low, width = 0, 0.0, 1.0
    while low < top:
        high = 1.0 / width
        own = np.arange(len(elements)) if weights is None else np.flatnonzero(weights > low)
        steps = np.ceil(limits[own] / high).astype(np.int64)
        element = np.repeat(own, steps)
        step = np.arange(len(element)) - np.repeat(np.cumsum(steps) - steps, steps)
        cell = mixed(elements[element] + GOLDEN * (step * 64 + (1 + column * 1_000_003)).astype(U))
        times = np.searchsorted(POISSON, unit(cell), side="right")
        at = np.repeat(np.arange(len(cell)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        dart = mixed(cell[at] + GOLDEN * (nth + 1).astype(U))
        element = element[at]
        rank = (step[at] + unit(mixed(dart ^ MIX1))) * high
        keep = rank <= limits[element]
        if weights is not None:
            keep &= low + unit(mixed(dart ^ MIX2)) * width <= weights[element]
        dart = dart[keep]
        out.append((element[keep], rank[keep], (mixed(dart ^ GOLDEN) % U(coordinates)).astype(np.int64), dart))
        column, low, width = column + 1, low + width, (1.0 if column == 0 else width * 2)
    return tuple(np.concatenate(x) for x in zip(*out))


def sketches(sets: list[np.ndarray], coordinates: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """A row for each of the sets (none of them empty): the identity of the
    earliest dart of every coordinate. ``weights`` None: all 1. A set's rank limit
    doubles until each coordinate has a dart, which leaves the earliest as they are."""
    out = np.zeros((len(sets), coordinates), U)
    totals = np.array([float(len(s)) for s in sets] if weights is None else [float(w.sum()) for w in weights])
    limits = coordinates * (np.log(coordinates) + 2) / np.maximum(totals, 1e-300)
    todo = np.arange(len(sets))
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), [len(sets[t]) for t in todo])
        element, rank, coord, name = darts(
            np.concatenate([sets[t] for t in todo]), None if weights is None else np.concatenate([weights[t] for t in todo]),
            limits[todo][owner], coordinates)
        place = owner[element] * coordinates + coord
        order = np.argsort(rank, kind="stable")[::-1]
        first, found = np.zeros(len(todo) * coordinates, U), np.zeros(len(todo) * coordinates, bool)
        first[place[order]] = name[order]
        found[place] = True
        done = found.reshape(-1, coordinates).all(1)
        out[todo[done]] = first.reshape(-1, coordinates)[done]
        todo = todo[~done]
        limits[todo] *= 2
    return out


def sketch(elements: np.ndarray, coordinates: int, weights: np.ndarray | None = None) -> np.ndarray:
    return sketches([elements], coordinates, None if weights is None else [weights])[0]


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    parts = signature.reshape(-1, rows)
    out = np.arange(1, len(parts) + 1, dtype=np.uint64)
    for i in range(rows):
        out = mixed(out * GOLDEN + parts[:, i])
    return out.view(np.int64)
