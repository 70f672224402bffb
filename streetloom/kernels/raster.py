"""Binary images: burning corridors, closing, filling holes, thinning."""

from __future__ import annotations

import numpy as np


def burn(segments: np.ndarray, joints: np.ndarray, x0: float, y0: float, shape: tuple[int, int], res: float, half: float) -> np.ndarray:
    """Pixels (rows go down from y0) whose centre lies within `half` of a segment, beside it, or of an inner vertex.

    segments: (n, 4) of ax, ay, bx, by; joints: (m, 2), the vertices where a line goes on, which get round joins."""
    out = np.zeros(shape, bool)

    def window(lo_x, hi_x, lo_y, hi_y):
        c0, c1 = int(max(0, np.floor((lo_x - half - x0) / res))), int(min(shape[1], np.ceil((hi_x + half - x0) / res) + 1))
        r0, r1 = int(max(0, np.floor((y0 - hi_y - half) / res))), int(min(shape[0], np.ceil((y0 - lo_y + half) / res) + 1))
        if c0 >= c1 or r0 >= r1:
            return None
        return r0, r1, c0, c1, x0 + (np.arange(c0, c1) + 0.5) * res, (y0 - (np.arange(r0, r1) + 0.5) * res)[:, None]

    for ax, ay, bx, by in segments:
        if (w := window(min(ax, bx), max(ax, bx), min(ay, by), max(ay, by))) is None:
            continue
        r0, r1, c0, c1, px, py = w
        dx, dy = bx - ax, by - ay
        n = np.hypot(dx, dy)
        if n == 0:
            continue
        along = ((px - ax) * dx + (py - ay) * dy) / n
        across = np.abs((px - ax) * dy - (py - ay) * dx) / n
        out[r0:r1, c0:c1] |= (along >= 0) & (along <= n) & (across <= half)
    for jx, jy in joints:
        if (w := window(jx, jx, jy, jy)) is not None:
            r0, r1, c0, c1, px, py = w
            out[r0:r1, c0:c1] |= (px - jx) ** 2 + (py - jy) ** 2 <= half * half
    return out


def _around(a: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of each pixel, clockwise from north; outside counts as unset."""
    p = np.pad(a, 1)
    h, w = a.shape
    return [p[1 + r : 1 + r + h, 1 + c : 1 + c + w] for r, c in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]


def close(mask: np.ndarray, iterations: int) -> np.ndarray:
    """Dilate and then erode by 3 x 3, each `iterations` times; outside the image counts as unset."""
    for _ in range(iterations):
        mask = mask | np.logical_or.reduce(_around(mask))
    for _ in range(iterations):
        mask = mask & np.logical_and.reduce(_around(mask))
    return mask


def fill_holes(mask: np.ndarray, most: int) -> np.ndarray:
    """Set background regions (4-connected) of at most `most` pixels, at the border or not."""
    empty = ~mask
    label = np.where(empty, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:  # smallest label of each region, with runs along rows and columns swept at once
        before = label
        for axis in (0, 1):
            for flip in (False, True):
                label = _sweep(label, empty, axis, flip)
        if (label == before).all():
            break
    ids, counts = np.unique(label[empty], return_counts=True)
    small = ids[counts <= most]
    return mask | (empty & np.isin(label, small))


def _sweep(label: np.ndarray, empty: np.ndarray, axis: int, flip: bool) -> np.ndarray:
    """Running minimum of labels along runs of background pixels."""
    a, e = (np.flip(label, axis), np.flip(empty, axis)) if flip else (label, empty)
    if axis == 0:
        a, e = a.T, e.T
    # Runs are told apart by adding a falling offset that makes the running minimum start anew at each wall.
    run = np.cumsum(~e, axis=1)
    big = a.max() + 1
    shifted = np.where(e, a, big) - run * (big + 1)
    out = np.minimum.accumulate(shifted, axis=1) + run * (big + 1)
    out = np.where(e, np.minimum(out, a), a)
    if axis == 0:
        out = out.T
    return np.flip(out, axis) if flip else out


def without_stairs(mask: np.ndarray) -> np.ndarray:
    """Drop the corner pixels of stairs, whose two neighbours touch each other, so that a line has two neighbours everywhere.

    The published condition of Holt, Stewart, Clint and Perrott (1987), first for corners open to the north, then south."""
    mask = mask.copy()
    for flip in (False, True):
        n, ne, e, se, s, sw, w, nw = _around(np.flipud(mask) if flip else mask)
        corner = n & ((e & ~ne & ~sw & (~w | ~s)) | (w & ~nw & ~se & (~e | ~s)))
        mask &= ~(np.flipud(corner) if flip else corner)
    return mask


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by the two-pass parallel algorithm of Zhang and Suen (1984), without its stairs."""
    mask = mask.copy()
    while True:
        changed = False
        for first in (True, False):
            n = _around(mask)
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(np.int8) for i in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            a, b = (north & east & south, east & south & west) if first else (north & east & west, north & south & west)
            gone = mask & (count >= 2) & (count <= 6) & (turns == 1) & ~a & ~b
            if gone.any():
                mask &= ~gone
                changed = True
        if not changed:
            return without_stairs(mask)


def skeleton_keys(mask: np.ndarray, row0: int, col0: int, width: int) -> np.ndarray:
    rows, cols = np.nonzero(mask)
    return (rows + row0).astype(np.int64) * width + cols + col0
