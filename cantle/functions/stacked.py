"""Metrics of many pairs of valid polygons at once: numpy kernels over polygons of like sizes.

A polygon column comes as Arrow lists (parts, rings, points). Its edges are laid out as rows of equal width, filled up by a
polygon's first edge, which counts nothing in sums and changes no least or greatest value. The same metrics as
``operators.geometry.compare_valid``, where they are explained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cantle.functions import polygon as pg

#: Pairs of edges, or of points and edges, looked at together.
PAIRS = 1 << 16
#: Edges that are laid out together.
EDGES = 1 << 19


class Edges:
    """All edges of a polygon column, with each row's first one and number; ``turn`` is -1 where a ring runs the wrong way."""

    def __init__(self, column: pa.Array):
        size = lambda lists: pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts, column = size(column), column.flatten()
        rings, column = size(column), column.flatten()
        points, column = size(column), column.flatten()
        x, y = (c.to_numpy(zero_copy_only=False) for c in column.flatten())
        row = np.repeat(np.repeat(np.arange(len(parts)), parts), rings)
        shell = np.zeros(len(points), bool)
        shell[(np.cumsum(rings) - rings)[rings > 0]] = True
        row, shell, points = row[points > 0], shell[points > 0], points[points > 0]
        first = np.cumsum(points) - points
        after = np.arange(1, len(x) + 1)
        after[first + points - 1] = first
        self.ax, self.ay, self.bx, self.by = x, y, x[after], y[after]
        # near the ring's own first point, which keeps digits where coordinates are large
        x0, y0 = np.repeat(x[first], points), np.repeat(y[first], points)
        cross = (x - x0) * (self.by - y0) - (self.bx - x0) * (y - y0)
        left = np.add.reduceat(cross, first) >= 0 if len(first) else np.zeros(0, bool)
        self.turn = np.repeat(np.where(left == shell, 1.0, -1.0), points)
        self.count = np.bincount(row, points, len(parts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def laid(self, rows: np.ndarray, width: int) -> Laid:
        at = np.arange(width)
        held = at < self.count[rows][:, None]
        place = self.first[rows][:, None] + np.where(held, at, 0)
        return Laid(self.ax[place], self.ay[place], self.bx[place], self.by[place], np.where(held, self.turn[place], 0.0))


class Laid:
    """Edges as rows: from (ax, ay) to (bx, by), with their direction (1 or -1; 0 for what fills up)."""

    def __init__(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, turn: np.ndarray):
        self.ax, self.ay, self.bx, self.by, self.turn = ax, ay, bx, by, turn

    def shift(self, x: np.ndarray, y: np.ndarray) -> None:
        self.ax, self.bx, self.ay, self.by = self.ax - x, self.bx - x, self.ay - y, self.by - y

    def area(self) -> np.ndarray:
        return np.abs((self.turn * (self.ax * self.by - self.bx * self.ay)).sum(1)) / 2

    def sizes(self) -> np.ndarray:
        return np.abs(self.turn) * np.hypot(self.bx - self.ax, self.by - self.ay)

    def spaced(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n points of each row at equal distances along its edges (see ``planar.spaced``)."""
        size = self.sizes()
        end = np.cumsum(size, 1)
        start, total = np.c_[np.zeros(len(end)), end[:, :-1]], end[:, -1:]
        low, high = (np.ceil(n * (e / total)).astype(np.int64) for e in (start, end))
        edge = np.repeat(np.arange(size.size), (high - low).ravel()).reshape(len(size), n)
        size, start = np.maximum(size.ravel(), 1e-300)[edge], start.ravel()[edge]
        t = (np.arange(n) / n * total - start) / size
        ax, ay, bx, by = (v.ravel()[edge] for v in (self.ax, self.ay, self.bx, self.by))
        return ax + t * (bx - ax), ay + t * (by - ay)


def _steps(rows: int, p: int, q: int) -> Iterator[tuple[slice, slice]]:
    """Blocks of rows and of the first side's p, of about PAIRS pairs each."""
    many, some = max(1, PAIRS // (p * q)), max(1, PAIRS // q)
    for i in range(0, rows, many):
        for j in range(0, p, some):
            yield slice(i, i + many), slice(j, j + some)


def common_area(a: Laid, b: Laid) -> np.ndarray:
    """The area that both rows' polygons share (see ``planar.common_area``)."""

    def spans(e: Laid) -> list[np.ndarray]:
        right, wide = e.ax < e.bx, e.bx - e.ax
        slope = np.divide(e.by - e.ay, wide, out=np.zeros_like(wide), where=wide != 0)
        return [np.minimum(e.ax, e.bx), np.maximum(e.ax, e.bx), np.where(right, e.ay, e.by), slope, e.turn * np.sign(wide)]

    total = np.zeros(len(a.ax))
    p, q = spans(a), spans(b)
    for i, j in _steps(*a.ax.shape, b.ax.shape[1]):
        l0, r0, y0, m0, s0 = (v[i, j, None] for v in p)
        l1, r1, y1, m1, s1 = (v[i, None, :] for v in q)
        left, wide = np.maximum(l0, l1), np.minimum(r0, r1)
        wide -= left
        d = m0 * (left - l0) + (y0 - y1) - m1 * (left - l1)
        part = pg.gaps(d, d + (m0 - m1) * wide)
        part *= np.maximum(wide, 0.0)
        part *= s1
        total[i] += (part.sum(2) * s0[:, :, 0]).sum(1)
    return np.maximum(0.0, total * -0.5)


def nearest(x: np.ndarray, y: np.ndarray, e: Laid) -> np.ndarray:
    """From each of a row's points to the row's nearest edge."""
    out = np.empty(x.shape)
    dx, dy = e.bx - e.ax, e.by - e.ay
    square = dx * dx + dy * dy
    ux, uy = (np.divide(v, square, out=np.zeros_like(v), where=square > 0) for v in (dx, dy))
    for i, j in _steps(*x.shape, dx.shape[1]):
        px, py = x[i, j, None] - e.ax[i, None, :], y[i, j, None] - e.ay[i, None, :]
        t = px * ux[i, None, :]
        t += py * uy[i, None, :]
        np.maximum(t, 0.0, out=t)
        np.minimum(t, 1.0, out=t)
        px -= t * dx[i, None, :]
        t *= dy[i, None, :]
        py -= t
        px *= px
        py *= py
        px += py
        out[i, j] = px.min(2)
    return np.sqrt(out)


def _chains(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One side of the hull of each row's sorted points, and the number of its points."""
    kept, top = np.zeros_like(z), np.zeros(len(z), np.int64)
    every = np.arange(len(z))
    for p in z.T:
        open_ = every[top >= 2]
        while len(open_):
            a, b = kept[open_, top[open_] - 2], kept[open_, top[open_] - 1]
            u, v = b - a, p[open_] - a
            open_ = open_[~(u.real * v.imag > u.imag * v.real)]
            top[open_] -= 1
            open_ = open_[top[open_] >= 2]
        kept[every, top] = p
        top += 1
    return kept, top


def hulls(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The convex hull of each row's points, counter-clockwise from the leftmost, then lowest, filled up by its last point; and its size."""
    z = np.sort(x + 1j * y, axis=1)
    (low, n), (high, m) = _chains(z), _chains(z[:, ::-1])
    n, m = np.maximum(n - 1, 1), m - 1  # each chain ends where the other starts
    size = np.where(z[:, 0] == z[:, -1], 1, n + m)
    at = np.minimum(np.arange(int(size.max(initial=1))), size[:, None] - 1)
    row = np.arange(len(z))[:, None]
    out = np.where(at < n[:, None], low[row, np.minimum(at, low.shape[1] - 1)], high[row, np.clip(at - n[:, None], 0, high.shape[1] - 1)])
    return out, size


def least_boxes(hull: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray]:
    """The rectangle of least area around each hull, as ``planar.least_box`` has it."""
    width = hull.shape[1]
    after = np.where(np.arange(width) + 1 < size[:, None], np.minimum(np.arange(width) + 1, width - 1), 0)
    way = np.take_along_axis(hull, after, 1) - hull
    way = way / np.maximum(np.hypot(way.real, way.imag), 1e-300)
    low_s, high_s, low_t, high_t = (np.empty(hull.shape) for _ in range(4))
    for i, j in _steps(*hull.shape, width):
        ux, uy, x, y = way.real[i, j, None], way.imag[i, j, None], hull.real[i, None, :], hull.imag[i, None, :]
        s, t = x * ux + y * uy, y * ux - x * uy
        low_s[i, j], high_s[i, j], low_t[i, j], high_t[i, j] = s.min(2), s.max(2), t.min(2), t.max(2)
    area = (high_s - low_s) * (high_t - low_t)
    area[np.arange(width) >= size[:, None]] = np.inf
    best, row = np.zeros(len(hull), np.int64), np.arange(len(hull))
    for k in range(1, width):
        best = np.where(area[:, k] < area[row, best] - 1e-12, k, best)
    u, s0, s1, t0, t1 = (v[row, best] for v in (way, low_s, high_s, low_t, high_t))
    corner = u * (s0 + 1j * t0)
    return {"area": area[row, best], "corner": corner, "u": u, "along": s1 - s0, "across": t1 - t0}


def _around(box: dict[str, np.ndarray]) -> Laid:
    """A box's edges, counter-clockwise."""
    c, u = box["corner"], box["u"]
    z = np.stack([c, c + u * box["along"], c + u * (box["along"] + 1j * box["across"]), c + u * 1j * box["across"]], 1)
    w = np.roll(z, -1, 1)
    return Laid(z.real, z.imag, w.real, w.imag, np.ones(z.shape))


def _angle(box: dict[str, np.ndarray]) -> np.ndarray:
    along = np.degrees(np.angle(box["u"]))
    return np.mod(np.where(box["along"] >= box["across"], along, along + 90.0), 180.0)


def _overlap(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    union = a + b - common
    return np.where(union > 1e-12, common / np.maximum(union, 1e-12), 0.0)


def _relative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) / np.maximum(b, 1e-12)


def _metrics(p: Laid, q: Laid, samples: int) -> dict[str, np.ndarray]:
    x0, y0 = p.ax.min(1, keepdims=True), p.ay.min(1, keepdims=True)
    p.shift(x0, y0)
    q.shift(x0, y0)
    areas, lengths = [e.area() for e in (p, q)], [e.sizes().sum(1) for e in (p, q)]
    boxes = [least_boxes(*hulls(e.ax, e.ay)) for e in (p, q)]
    turn = np.abs(_angle(boxes[0]) - _angle(boxes[1])) % 180.0
    sides = lambda f: [f(b["along"], b["across"]) for b in boxes]
    far, mean = [], []
    for e, other in ((p, q), (q, p)):
        x, y = e.spaced(samples)
        d = nearest(np.c_[x, e.ax], np.c_[y, e.ay], other)
        mean.append(d[:, :samples].mean(1))
        far.append(d[:, samples:].max(1))
    return {
        "outline_iou": _overlap(common_area(p, q), *areas),
        "mean_boundary_distance": (mean[0] + mean[1]) / 2,
        "hausdorff_distance": np.maximum(*far),
        "perimeter_relative_error": _relative(*lengths),
        "area_relative_error": _relative(*areas),
        "minimum_rectangle_iou": _overlap(common_area(*map(_around, boxes)), *[b["area"] for b in boxes]),
        "minimum_rectangle_angle_error_deg": np.minimum(turn, 180.0 - turn),
        "minimum_rectangle_long_error": _relative(*sides(np.maximum)),
        "minimum_rectangle_short_error": _relative(*sides(np.minimum)),
    }


def metrics(a: pa.Array, b: pa.Array, samples: int = 128) -> dict[str, np.ndarray]:
    """The nine metrics of each row's two polygons; all infinite where a side is null or empty."""
    p, q = Edges(a), Edges(b)
    out = {m: np.full(len(p.count), np.inf) for m in pg.METRICS}
    whole = np.flatnonzero((p.count > 0) & (q.count > 0))
    # rows of like widths together, each width a multiple of an eighth of its power of two
    wide = [w + -w % np.maximum(1 << np.maximum(np.floor(np.log2(np.maximum(w, 1))).astype(np.int64) - 2, 0), 1) for w in (p.count[whole], q.count[whole])]
    order = np.lexsort(wide)
    whole, wide = whole[order], [w[order] for w in wide]
    cuts = np.flatnonzero((np.diff(wide[0]) != 0) | (np.diff(wide[1]) != 0)) + 1
    for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(whole)], strict=True):
        if i == j:
            continue
        most = max(1, EDGES // int(wide[0][i] + wide[1][i] + samples))
        for k in range(i, j, most):
            rows = whole[k : min(k + most, j)]
            for m, found in _metrics(p.laid(rows, int(wide[0][i])), q.laid(rows, int(wide[1][i])), samples).items():
                out[m][rows] = found
    return out
