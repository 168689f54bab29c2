"""Sequential kernels: hulls, circles, covers, line simplification.

Each runs on one group, or on partitions whose partial results are small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import dropped, staged


def hull_points(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the smallest; collinear points are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def _part_hull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    corners: list[tuple[float, float]] = []
    for frame in frames:
        corners = hull_points(corners + list(zip(frame.x, frame.y, strict=True)))
    yield pd.DataFrame(corners, columns=["x", "y"])


def hull(points: DataFrame) -> DataFrame:
    """(corner, x, y) of the convex hull: each partition's hull, then the hull of their corners."""
    parts = points.select("x", "y").mapInPandas(_part_hull, "x double, y double")

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        corners = hull_points(list(zip(frame.x, frame.y, strict=True)))
        return pd.DataFrame([(i, x, y) for i, (x, y) in enumerate(corners)], columns=["corner", "x", "y"])

    return parts.groupBy().applyInPandas(last, "corner int, x double, y double")


def smallest_circle(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    """(x, y, radius) of the smallest circle around the points: move-to-front on the hull's corners."""

    def by_two(a, b):
        x, y = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
        return x, y, max(math.hypot(a[0] - x, a[1] - y), math.hypot(b[0] - x, b[1] - y))

    def by_three(a, b, c):
        ax, ay, bx, by = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (ax * by - ay * bx)
        if d == 0:
            return max((by_two(a, b), by_two(a, c), by_two(b, c)), key=lambda k: k[2])
        x = (by * (ax * ax + ay * ay) - ay * (bx * bx + by * by)) / d
        y = (ax * (bx * bx + by * by) - bx * (ax * ax + ay * ay)) / d
        return a[0] + x, a[1] + y, math.hypot(x, y)

    def holds(circle, p):
        return math.hypot(p[0] - circle[0], p[1] - circle[1]) <= circle[2] * (1 + 1e-12) + 1e-9

    pts = hull_points(points)
    if not pts:
        return math.nan, math.nan, math.nan
    circle = (*pts[0], 0.0)
    for i, p in enumerate(pts):
        if holds(circle, p):
            continue
        circle = (*p, 0.0)
        for j, q in enumerate(pts[:i]):
            if holds(circle, q):
                continue
            circle = by_two(p, q)
            for r in pts[:j]:
                if not holds(circle, r):
                    circle = by_three(p, q, r)
    return circle


def enclosing_circle(points: DataFrame) -> DataFrame:
    """(x, y, radius), in whole centimetres, of the smallest circle around the points; needs only the hull's corners."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[round(v * 100) for v in smallest_circle(list(zip(frame.x, frame.y, strict=True)))]], columns=["x_cm", "y_cm", "radius_cm"])

    return hull(points).groupBy().applyInPandas(one, "x_cm long, y_cm long, radius_cm long")


#: Pairs of a radius graph that one task can hold.
KERNEL_PAIRS = 5_000_000


def greedy_cover(n: int, events: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(centres, their uncovered neighbours when picked) of 0..n-1 under the pairs (a, b), in the order of a greedy cover.

    Greedy takes the vertex with the most uncovered neighbours, then the most events, then
    the smaller number.  A pick changes nothing beyond two steps, so every vertex
    that is first within two steps can be picked at once, and the picks are sorted at the end.
    A vertex of weight w is w of them at one place, of which one is picked and covers the others.
    """
    weight = np.ones(n, np.int64) if weight is None else weight
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    open_ = np.ones(n, bool)
    centres, degrees = [], []
    while open_.any():
        live = open_[src] & open_[dst]
        src, dst = src[live], dst[live]
        degree = np.bincount(src, weights=weight[dst], minlength=n).astype(np.int64) + weight - 1
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), -events, -degree))] = np.arange(n)
        place[~open_] = n
        one = place.copy()
        np.minimum.at(one, src, place[dst])
        two = one.copy()
        np.minimum.at(two, src, one[dst])
        picked = open_ & (place == two)
        centres.append(np.flatnonzero(picked))
        degrees.append(degree[picked])
        open_ &= ~picked
        open_[dst[picked[src]]] = False
    if not centres:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, degree = np.concatenate(centres), np.concatenate(degrees)
    order = np.lexsort((found, -events[found], -degree))
    return found[order], degree[order]


def cover(stops: DataFrame, pairs: DataFrame) -> DataFrame:
    """(stop_id, events, degree) of the centres of a greedy radius cover; degree is what they newly cover, and
    their order is degree, then events, both descending, then the smaller id.

    A graph of at most KERNEL_PAIRS pairs goes through one task's arrays, a larger one through
    rounds of joins; both pick every vertex that is first within two steps.
    A column weight says how many stops of one place a row stands for.
    """
    stops = stops.select("stop_id", "events", (F.col("weight") if "weight" in stops.columns else F.lit(1)).cast("long").alias("weight"))
    links, links_at = staged(pairs.select("a", "b"), "pairs")
    if links.count() > KERNEL_PAIRS:
        return _cover_rounds(stops, links)
    kind = dict(stops.dtypes)["stop_id"]

    def one(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("stop_id").reset_index(drop=True)
        at = pd.Index(nodes.stop_id)
        events = nodes.events.to_numpy(np.int64)
        centres, degree = greedy_cover(len(nodes), events, at.get_indexer(edges.a), at.get_indexer(edges.b), nodes.weight.to_numpy(np.int64))
        return pd.DataFrame({"stop_id": nodes.stop_id.to_numpy()[centres], "events": events[centres], "degree": degree})

    return stops.groupBy().cogroup(links.groupBy()).applyInPandas(one, f"stop_id {kind}, events long, degree long")


def _cover_rounds(stops: DataFrame, links: DataFrame) -> DataFrame:
    """cover() by joins: each round picks the vertices that are first within two steps and takes them and their neighbours out."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both, at = staged(ends.join(stops.select(F.col("stop_id").alias("b"), "weight"), "b"), "ends")
    left, left_at = staged(stops, "open")
    done = None
    while not left.isEmpty():
        degree = both.groupBy(F.col("a").alias("stop_id")).agg(F.sum("weight").alias("degree"))
        keyed = left.join(degree, "stop_id", "left").select("stop_id", F.struct((1 - F.col("weight") - F.coalesce("degree", F.lit(0))).alias("d"), (-F.col("events")).alias("e"), "stop_id").alias("key"))
        ranked, ranked_at = staged(keyed, "keys")
        one = _least(ranked, both, "key")
        two = _least(one, both, "key").withColumnRenamed("key", "least")
        picked, _ = staged(ranked.join(two, "stop_id").filter("key = least").select("stop_id", (-F.col("key.e")).alias("events"), (-F.col("key.d")).alias("degree")), "centres")
        done = picked if done is None else done.unionByName(picked)
        gone = picked.select("stop_id").unionByName(both.join(picked.select(F.col("stop_id").alias("a")), "a", "left_semi").select(F.col("b").alias("stop_id"))).distinct()
        gone, _ = staged(gone, "covered")
        left, new_at = staged(left.join(gone, "stop_id", "left_anti"), "open")
        kept = both.join(gone.withColumnRenamed("stop_id", "a"), "a", "left_anti").join(gone.withColumnRenamed("stop_id", "b"), "b", "left_anti")
        both, both_at = staged(kept, "ends")
        dropped(stops.sparkSession, at, left_at, ranked_at)
        at, left_at = both_at, new_at
    return done if done is not None else stops.select("stop_id", "events", (F.col("weight") - 1).alias("degree"))


def _least(rows: DataFrame, both: DataFrame, value: str) -> DataFrame:
    """The smallest value of each vertex and its neighbours."""
    near = both.select("a", "b").join(rows.withColumnRenamed("stop_id", "b"), "b").select(F.col("a").alias("stop_id"), value)
    return rows.unionByName(near).groupBy("stop_id").agg(F.min(value).alias(value))


def rdp(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay within ``tolerance`` after simplification (Ramer, Douglas, Peucker; a stack)."""
    n = len(x)
    keep = np.zeros(n, bool)
    if n:
        keep[[0, -1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        length2 = dx * dx + dy * dy
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        t = np.clip((px * dx + py * dy) / length2, 0, 1) if length2 else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """(line_id, n_points, n_kept, kept: the sequence numbers that stay) of each line."""
    whole = lines.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).select("line_id", F.col("p.seq").alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            masks = [rdp(np.asarray(x), np.asarray(y), tolerance) for x, y in zip(frame.x, frame.y, strict=True)]
            kept = [",".join(map(str, np.asarray(s)[m])) for s, m in zip(frame.seq, masks, strict=True)]
            yield pd.DataFrame({"line_id": frame.line_id, "n_points": [len(m) for m in masks], "n_kept": [int(m.sum()) for m in masks], "kept": kept})

    kind = lines.schema["line_id"].dataType.simpleString()
    return whole.mapInPandas(run, f"line_id {kind}, n_points int, n_kept int, kept string")


def chained(segments: list[tuple[int, list[tuple[float, float]]]], gap: float = 0.0) -> list[tuple[list[int], float]]:
    """Segments (id, points) joined end to end into lines: (ids in order, length), the longest line first."""
    left = dict(sorted(segments))
    out = []
    while left:
        key = next(iter(left))
        line, ids = list(left.pop(key)), [key]
        grown = True
        while grown:
            grown = False
            for k, pts in list(left.items()):
                for end, add in ((True, pts), (True, pts[::-1]), (False, pts), (False, pts[::-1])):
                    tip, near = (line[-1], add[0]) if end else (line[0], add[-1])
                    if math.hypot(tip[0] - near[0], tip[1] - near[1]) <= gap:
                        line = line + add[1:] if end else add[:-1] + line
                        ids = [*ids, k] if end else [k, *ids]
                        del left[k]
                        grown = True
                        break
                if grown:
                    break
        out.append((ids, sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def representative(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """A point that stands for a ring: its centroid if inside, else the middle of the widest stretch at the centroid's height."""
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)
    if not twice:
        return ring[0]
    cx = sum((a[0] + b[0]) * (a[0] * b[1] - b[0] * a[1]) for a, b in edges) / (3 * twice)
    cy = sum((a[1] + b[1]) * (a[0] * b[1] - b[0] * a[1]) for a, b in edges) / (3 * twice)
    cuts = sorted((b[0] - a[0]) * (cy - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges if (a[1] > cy) != (b[1] > cy))
    if sum(c > cx for c in cuts) % 2:
        return cx, cy
    spans = list(zip(cuts[::2], cuts[1::2], strict=False))
    left, right = max(spans, key=lambda s: s[1] - s[0]) if spans else (cx, cx)
    return (left + right) / 2, cy


def along(line: list[tuple[float, float]], stops: list[tuple[float, float]], leash: float) -> list[float | None]:
    """Distances along a line at which stops stand: for each the nearest place not before the last one; None beyond the leash."""
    at, total = [], 0.0
    for a, b in zip(line, line[1:], strict=False):
        at.append(total)
        total += math.dist(a, b)
    out: list[float | None] = []
    last = 0.0
    for s in stops:
        best: tuple[float, float] | None = None
        for start, a, b in zip(at, line, line[1:], strict=False):
            length = math.dist(a, b)
            t = 0.0 if not length else max(0.0, min(1.0, ((s[0] - a[0]) * (b[0] - a[0]) + (s[1] - a[1]) * (b[1] - a[1])) / length**2))
            t = max(t, min(1.0, (last - start) / length)) if length and last > start else t
            if start + length < last:
                continue
            d = math.dist(s, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if best is None or d < best[0] - 1e-9:
                best = (d, start + t * length)
        if best is None or best[0] > leash:
            out.append(None if line[1:] or math.dist(s, line[0]) > leash else 0.0)
            continue
        last = best[1]
        out.append(last)
    return out
