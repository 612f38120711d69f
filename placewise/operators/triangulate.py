"""Delaunay triangulation of one point set: insertion with exact predicates.

A predicate is evaluated in doubles and trusted where it exceeds its rounding error; else it is repeated in
integers, to which all coordinates are scaled without loss. So lines, grids, circles and far points need no
tolerance while building. Points are inserted in rounds of doubling size, along a Hilbert curve of their ranks in each, and are
found by a walk; outside of the hull every edge has a triangle with the vertex GHOST.
"""

from __future__ import annotations

import math

import numpy as np

GHOST = -1
# rounding error of the predicates in doubles, as shares of the sums of their terms' absolute values
_ORIENT_ERROR, _CIRCLE_ERROR = 4 * 2.0**-53, 12 * 2.0**-53
#: What underflow may add, for coordinates scaled to at most 1.
_TINY = 1e-290


def _integers(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """The coordinates times one power of two that makes all of them whole."""
    parts = [[math.frexp(v) for v in a.tolist()] for a in (x, y)]
    least = min((e for own in parts for m, e in own if m), default=0) - 53
    return tuple([int(m * 2**53) << (e - 53 - least) if m else 0 for m, e in own] for own in parts)


def _hilbert(x: np.ndarray, y: np.ndarray, bits: int = 10) -> np.ndarray:
    """Place on a Hilbert curve of whole coordinates below 2 ** bits."""
    x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    side = 1 << (bits - 1)
    while side:
        rx, ry = (x & side) > 0, (y & side) > 0
        out += side * side * ((3 * rx) ^ ry)
        turn = ~ry & rx
        x[turn], y[turn] = side - 1 - (x[turn] & (side - 1)), side - 1 - (y[turn] & (side - 1))
        x[~turn] &= side - 1
        y[~turn] &= side - 1
        swap = ~ry
        x[swap], y[swap] = y[swap].copy(), x[swap].copy()
        side >>= 1
    return out


def _order(x: np.ndarray, y: np.ndarray) -> list[int]:
    n = len(x)
    rank = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable") * 1024 // max(1, n)
    place = _hilbert(rank(x), rank(y))
    mixed, out, end = np.random.default_rng(1).permutation(n), [], n
    while end:
        begin = end // 2 if end > 64 else 0
        own = mixed[begin:end]
        out.append(own[np.argsort(place[own], kind="stable")])
        end = begin
    return np.concatenate(out[::-1]).tolist() if out else []


class Triangulation:
    """Triangles of distinct finite points. apex[(a, b)] is the third corner of the triangle to the left of a -> b."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.apex: dict[tuple[int, int], int] = {}
        top = max(float(np.abs(x).max()), float(np.abs(y).max()), 0.0) if len(x) else 0.0
        down = -math.frexp(top)[1] if top else 0
        self.x, self.y = np.ldexp(x, down).tolist(), np.ldexp(y, down).tolist()
        self._x, self._y = x, y
        self._whole: tuple[list[int], list[int]] | None = None
        order = _order(x, y)
        self.line = self._begin(order)
        for p in order if not self.line else ():
            if p not in self.first:
                self._insert(p)

    # ---- predicates

    def _int(self) -> tuple[list[int], list[int]]:
        if self._whole is None:
            self._whole = _integers(self._x, self._y)
        return self._whole

    def side(self, a: int, b: int, c: int) -> int | float:
        """Above 0 if c is to the left of a -> b, below 0 if to the right."""
        x, y = self.x, self.y
        left, right = (x[a] - x[c]) * (y[b] - y[c]), (y[a] - y[c]) * (x[b] - x[c])
        det = left - right
        if abs(det) > _ORIENT_ERROR * (abs(left) + abs(right)) + _TINY:
            return det
        x, y = self._int()
        return (x[a] - x[c]) * (y[b] - y[c]) - (y[a] - y[c]) * (x[b] - x[c])

    def in_circle(self, a: int, b: int, c: int, d: int) -> int | float:
        """Above 0 if d is within the circle through a, b, c (counter-clockwise), 0 if on it."""
        for exact in (False, True):
            x, y = self._int() if exact else (self.x, self.y)
            ax, ay, bx, by, cx, cy = x[a] - x[d], y[a] - y[d], x[b] - x[d], y[b] - y[d], x[c] - x[d], y[c] - y[d]
            a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            det = a2 * (bx * cy - cx * by) + b2 * (cx * ay - ax * cy) + c2 * (ax * by - bx * ay)
            if exact or abs(det) > _CIRCLE_ERROR * (a2 * (abs(bx * cy) + abs(cx * by)) + b2 * (abs(cx * ay) + abs(ax * cy)) + c2 * (abs(ax * by) + abs(bx * ay))) + _TINY:
                return det
        raise AssertionError

    # ---- building

    def _add(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b

    def _begin(self, order: list[int]) -> list[int]:
        """Make the first triangle; or, if all points are on one line, return them in its order."""
        self.first: set[int] = set()
        for k in range(2, len(order)):
            turn = self.side(order[0], order[1], order[k])
            if turn:
                a, b, c = (order[0], order[1], order[k]) if turn > 0 else (order[1], order[0], order[k])
                self.first, self.last = {a, b, c}, (a, b)
                self._add(a, b, c)
                for p, q in ((b, a), (c, b), (a, c)):
                    self._add(p, q, GHOST)
                return []
        return sorted(order, key=lambda p: (self._x[p], self._y[p]))

    def _conflict(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether p is within the circle of a triangle; of one with GHOST, beyond its edge or on it."""
        if a == GHOST:
            a, b, c = b, c, a
        elif b == GHOST:
            a, b, c = c, a, b
        if c != GHOST:
            return self.in_circle(a, b, c, p) > 0
        turn = self.side(a, b, p)
        if turn:
            return turn > 0
        x, y = self._x, self._y
        low, high = sorted(((x[a], y[a]), (x[b], y[b])))
        return low < (x[p], y[p]) < high

    def _find(self, p: int) -> tuple[int, int, int]:
        """The triangle that holds p, or one with GHOST beyond whose edge it lies."""
        a, b = self.last
        c = self.apex[a, b]
        if c == GHOST:
            a, b = b, a
            c = self.apex[a, b]
        while True:
            if self.side(a, b, p) < 0:
                a, b = b, a
            elif self.side(b, c, p) < 0:
                a, b = c, b
            elif self.side(c, a, p) < 0:
                a, b = a, c
            else:
                return a, b, c
            c = self.apex[a, b]
            if c == GHOST:
                return a, b, c

    def _insert(self, p: int) -> None:
        a, b, c = self._find(p)
        apex = self.apex
        for e in ((a, b), (b, c), (c, a)):
            del apex[e]
        rim, todo = [], [(a, b), (b, c), (c, a)]
        while todo:
            a, b = todo.pop()
            c = apex.get((b, a))
            if c is None:  # the triangle beyond is gone as well
                continue
            if self._conflict(b, a, c, p):
                del apex[b, a], apex[a, c], apex[c, b]
                todo += [(a, c), (c, b)]
            else:
                rim.append((a, b))
        for a, b in rim:
            self._add(a, b, p)
            if a != GHOST and b != GHOST:
                self.last = (a, b)

    # ---- results

    def _on_one_circle(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether the four points are co-circular, or would be but for the rounding of their coordinates. Of flat triangles
        rounding says nothing: they count as they are."""
        if self.in_circle(a, b, c, d) >= 0:
            return True
        x, y = self.x, self.y
        unit = 2.0**-53 * max(abs(v[p]) for v in (x, y) for p in (a, b, c, d))
        (ax, ay), (bx, by), (cx, cy) = ((x[p] - x[d], y[p] - y[d]) for p in (a, b, c))
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        bc, ca, ab = bx * cy - cx * by, cx * ay - ax * cy, ax * by - bx * ay
        span = abs(ax) + abs(ay) + abs(bx) + abs(by) + abs(cx) + abs(cy)
        if min(abs(self.side(a, b, c)), abs(ab)) < 1024 * unit * span:
            return False
        det = a2 * bc + b2 * ca + c2 * ab
        slopes = [2 * ax * bc - b2 * cy + c2 * by, 2 * bx * ca - c2 * ay + a2 * cy, 2 * cx * ab - a2 * by + b2 * ay,
                  2 * ay * bc + b2 * cx - c2 * bx, 2 * by * ca + c2 * ax - a2 * cx, 2 * cy * ab + a2 * bx - b2 * ax]
        return abs(det) <= 4 * unit * (sum(map(abs, slopes)) + abs(sum(slopes[:3])) + abs(sum(slopes[3:])))

    def edges(self) -> list[tuple[int, int]]:
        """Edges (a, b), a < b, that every Delaunay triangulation of the points has: none between co-circular choices."""
        if self.line:
            return sorted((min(p), max(p)) for p in zip(self.line, self.line[1:], strict=False))
        out = []
        for (a, b), c in self.apex.items():
            if a < b and a != GHOST:
                d = self.apex[b, a]
                if c == GHOST or d == GHOST or not self._on_one_circle(a, b, c, d):
                    out.append((a, b))
        return sorted(out)

    def triangles(self) -> list[tuple[int, int, int]]:
        """Triangles a < b < c all of whose sides are among edges()."""
        kept = set(self.edges())
        out = set()
        for (a, b), c in self.apex.items():
            if GHOST not in (a, b, c):
                i, j, k = sorted((a, b, c))
                if (i, j) in kept and (j, k) in kept and (i, k) in kept:
                    out.add((i, j, k))
        return sorted(out)
