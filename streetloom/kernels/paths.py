"""Shortest paths and simplification in plain Python, for tasks that hold one bounded piece of a graph."""

from __future__ import annotations

import heapq
import math


def adjacency(edges) -> dict[int, list[tuple[int, float]]]:
    """Neighbours of undirected edges (u, v, length)."""
    out: dict[int, list[tuple[int, float]]] = {}
    for u, v, d in edges:
        out.setdefault(u, []).append((v, d))
        out.setdefault(v, []).append((u, d))
    return out


def within(graph: dict, source: int, cutoff: float, target: int | None = None) -> dict[int, float]:
    """Distances from source up to cutoff; ends early once target is settled."""
    done: dict[int, float] = {}
    heap = [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = d
        if v == target:
            break
        for w, e in graph.get(v, ()):
            if w not in done and d + e <= cutoff:
                heapq.heappush(heap, (d + e, w))
    return done


def simplify(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Ramer, Douglas and Peucker's selection of vertices, without recursion."""
    keep = [False] * len(line)
    if not line:
        return []
    keep[0] = keep[-1] = True
    spans = [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        far, at = tolerance, -1
        for i in range(a + 1, b):
            x, y = line[i]
            t = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / n)) if n else 0.0
            d = math.hypot(x - ax - t * dx, y - ay - t * dy)
            if d > far:
                far, at = d, i
        if at >= 0:
            keep[at] = True
            spans += [(a, at), (at, b)]
    return [p for p, k in zip(line, keep, strict=True) if k]


def crossing(p, q, r, s) -> bool:
    """Whether segments pq and rs cross at a point inside both."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0
