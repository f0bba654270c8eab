"""Douglas-Peucker simplification of lines of (lon, lat), in metres."""

import numpy as np

METRES = 111_320.0  # of a degree of latitude


def _off(flat: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the points between a and b to the segment from a to b."""
    line, own = flat[b] - flat[a], flat[a + 1 : b] - flat[a]
    square = float(line @ line)
    along = np.clip(own @ line / square, 0.0, 1.0) if square else np.zeros(len(own))
    return np.hypot(*(own - along[:, None] * line).T)


def kept(points: np.ndarray, metres: float, least: int = 0) -> np.ndarray:
    """Which points of a line stay: its ends, and the farthest of every stretch that strays from its chord by more than metres.
    least: how many points between the ends stay anyhow, the farthest ones first. A closed line is
    halved at the point that lies farthest from its ends, which stays."""
    flat = points * [np.cos(np.radians(points[:, 1].mean())), 1.0] * METRES
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    if len(points) > 2 and (points[0] == points[-1]).all():
        far = int(np.argmax(((flat - flat[0]) ** 2).sum(1)))
        keep[far] = True
        todo = [(0, far), (far, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        off = _off(flat, a, b)
        k = int(np.argmax(off))
        if off[k] > metres:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    while keep.sum() - 2 < min(least, len(points) - 2):
        at = np.flatnonzero(keep)
        spans = [(float(off.max()), a, a + 1 + int(np.argmax(off))) for a, b in zip(at, at[1:]) if b - a > 1 for off in [_off(flat, a, b)]]
        keep[max(spans, key=lambda s: (s[0], -s[1]))[2]] = True
    return keep


def simplify_ring(points: np.ndarray, metres: float) -> np.ndarray:
    """A closed ring alone; four positions at least stay."""
    return points if len(points) <= 4 else points[kept(points, metres, 2)]
