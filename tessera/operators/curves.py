"""Smooth outlines: corner-keeping subdivision, cuts, and least-squares cubics.  Points are complex numbers."""

from __future__ import annotations

import math

import numpy as np

FIT_ERROR = 10.0  # of an outline's fitted curves
OUTSET = 8.0
BLOCK, LEAST_BLOCK = 200, 50
ROUNDS = 8

Cubic = tuple[complex, complex, complex, complex]


def direction(v: complex) -> float:
    """Angle in (-pi, pi]; a zero below the axis counts as below, no direction as no number."""
    n = abs(v)
    if n == 0:
        return math.nan
    a = math.acos(max(-1.0, min(1.0, v.real / n)))
    return -a if math.copysign(1.0, v.imag) < 0 else a


def turn(a: float, b: float) -> float:
    """From angle a to angle b, in (-pi, pi]."""
    d = b + 2 * math.pi - a if a > b else b - a
    return d - 2 * math.pi if d > math.pi else d


def turns(points: list[complex]) -> list[float]:
    """The turn at each point of a ring."""
    n = len(points)
    return [turn(direction(points[i] - points[i - 1]), direction(points[(i + 1) % n] - points[i])) for i in range(n)]


def corners_of(ring: list[complex], threshold: float) -> list[bool]:
    return [abs(t) >= threshold for t in turns(ring)]


def subdivided(ring: list[complex], corners: list[bool], length: float) -> tuple[list[complex], list[bool], bool]:
    """One pass of the four-point scheme over a ring; a corner stands in for the point beyond it. Last: whether all segments are short."""
    n, out, flags, done = len(ring), [], [], True
    for i in range(n):
        out.append(ring[i])
        flags.append(corners[i])
        j = (i + 1) % n
        a, b = ring[i], ring[j]
        size = abs(a - b)
        if size <= length:
            continue
        before, after = ring[i - 1], ring[(j + 1) % n]
        if abs(before - a) / size >= 2 or abs(after - b) / size >= 2 or (corners[i] and corners[j]):
            continue
        middle = (a + b) / 2
        away = middle - ((a if corners[i] else before) + (b if corners[j] else after)) / 2
        new = middle + away / OUTSET if abs(away) / OUTSET >= np.finfo(float).eps else middle
        out.append(new)
        flags.append(False)
        done &= abs(a - new) <= length and abs(b - new) <= length
    return out, flags, done


def smoothed(ring: list[complex], corner: float, length: float, rounds: int) -> list[complex]:
    flags = corners_of(ring, corner)
    for _ in range(rounds):
        ring, flags, done = subdivided(ring, flags, length)
        if done:
            break
    return ring


def cuts_of(ring: list[complex], threshold: float) -> list[int]:
    """Points where the sense of turning changes, or the turns since the last cut add up to ``threshold``."""
    out, total, sense = [], 0.0, None
    for i, t in enumerate(turns(ring)):
        now = math.copysign(1.0, t) > 0
        cut = sense is not None and now != sense
        sense = now
        total += t
        if cut or abs(total) >= threshold:
            out.append(i)
            total = 0.0
    return out


def unit(v: complex) -> complex:
    return v / abs(v) if v else 0j


def dots(a: np.ndarray, b: np.ndarray | complex) -> np.ndarray:
    return a.real * np.real(b) + a.imag * np.imag(b)


def at(c: Cubic, t: np.ndarray) -> np.ndarray:
    u = 1 - t
    return u**3 * c[0] + 3 * t * u * u * c[1] + 3 * t * t * u * c[2] + t**3 * c[3]


def best_cubic(p: np.ndarray, t: np.ndarray, start: complex, end: complex) -> Cubic:
    """Least squares over the lengths of the two handles; a third of the chord each where there is no good answer."""
    u = 1 - t
    b1, b2 = 3 * t * u * u, 3 * t * t * u
    left = p - (p[0] * (u**3 + b1) + p[-1] * (b2 + t**3))
    c00, c01, c11 = (b1 * b1).sum() * abs(start) ** 2, (b1 * b2).sum() * float(dots(np.array([start]), end)[0]), (b2 * b2).sum() * abs(end) ** 2
    x0, x1 = (b1 * dots(left, start)).sum(), (b2 * dots(left, end)).sum()
    det = c00 * c11 - c01 * c01
    one, two = ((x0 * c11 - x1 * c01) / det, (c00 * x1 - c01 * x0) / det) if abs(det) >= 1e-4 else (0.0, 0.0)
    chord = abs(p[0] - p[-1])
    if one < 1e-6 * chord or two < 1e-6 * chord:
        one = two = chord / 3
    return complex(p[0]), complex(p[0] + start * one), complex(p[-1] + end * two), complex(p[-1])


def nearer(p: np.ndarray, t: np.ndarray, c: Cubic) -> np.ndarray:
    """One Newton step of each point's parameter."""
    d = [3 * (b - a) for a, b in zip(c, c[1:])]
    e = [2 * (b - a) for a, b in zip(d, d[1:])]
    u = 1 - t
    off, first, second = at(c, t) - p, u * u * d[0] + 2 * t * u * d[1] + t * t * d[2], u * e[0] + t * e[1]
    below = dots(first, first) + dots(off, second)
    step = np.divide(dots(off, first), below, out=np.zeros_like(t), where=below != 0)
    return np.where(below == 0, t, np.clip(t - step, 0, 1))


def cubics(p: np.ndarray, start: complex, end: complex, error: float) -> list[Cubic]:
    """Schneider's fit: improve the parameters while that helps, else cut at the worst point."""
    if len(p) <= 2:
        v = p[1] - p[0]
        return [(complex(p[0]), complex(p[0] + v * 0.33), complex(p[0] + v * 0.66), complex(p[1]))]
    run = np.concatenate([[0.0], np.cumsum(np.abs(np.diff(p)))])
    t = run / run[-1] if run[-1] else np.zeros(len(p))
    t = nearer(p, t, best_cubic(p, t, start, end))
    worst = math.inf
    for k in range(ROUNDS):
        if k:
            t = nearer(p, t, c)
        c = best_cubic(p, t, start, end)
        gap = np.abs(at(c, t) - p)
        split, now = int(gap.argmax()), float(gap.max())
        if now <= error or (k and now > 0.95 * worst):
            break
        worst = now
    if now <= error:
        return [c]
    split = min(max(split, 1), len(p) - 2)
    middle = unit(complex(p[split - 1] - p[split + 1]) / 2)
    return cubics(p[: split + 1], start, middle, error) + cubics(p[split:], -middle, end, error)


def chain(points: list[complex], error: float = FIT_ERROR) -> list[Cubic]:
    """Cubics along ``points``, joined at their ends, the outer ends kept; long runs are fitted in blocks."""
    if len(points) < 2:
        return []
    dense: list[complex] = []
    for a, b in zip(points, points[1:]):
        n = max(1, math.ceil(abs(b - a) / error))
        dense += [a + (b - a) * k / n for k in range(n)]
    p = np.array([*dense, points[-1]])
    block = BLOCK
    while len(p) >= BLOCK and block > LEAST_BLOCK and len(p) % block < LEAST_BLOCK:
        block -= 1
    found: list[Cubic] = []
    for lo in range(0, len(p), block):
        part = p[lo : lo + block]
        if len(part) < 2:
            continue
        after = p[lo : lo + block + 1] if lo + block + 1 < len(p) else part
        found += cubics(part, unit(complex(part[1] - part[0])), unit(complex(after[-2] - after[-1])), error)
    ends = [points[0], *((a[3] + b[0]) / 2 for a, b in zip(found, found[1:])), points[-1]]
    return [retracted((a, c[1], c[2], b)) for a, b, c in zip(ends, ends[1:], found)]


def retracted(c: Cubic) -> Cubic:
    """Handles that cross are pulled back to where they meet."""
    a, b, d, e = c
    one = turn(direction(a - e), direction(b - a))
    two = turn(direction(b - a), direction(d - b))
    if math.isnan(one) or math.isnan(two) or (math.copysign(1, one) > 0) == (math.copysign(1, two) > 0):
        return c
    v, w = b - a, e - d
    below = v.real * w.imag - v.imag * w.real
    across = (d - a).real * w.imag - (d - a).imag * w.real
    if abs(below) < 1e-7:
        if abs(across) >= 1e-7:
            return c
        meet = (a + b) / 2
    else:
        meet = a + v * (across / below)
    return a, meet, meet, e


def spline(points: list[tuple[int, int]], corner: float, length: float, rounds: int, splice: float) -> list[complex]:
    """A closed lattice outline as 1 + 3n points of n cubics."""
    ring = smoothed([complex(x, y) for x, y in points[:-1]], corner, length, rounds)
    n = len(ring)
    if n <= 1:
        return []
    if n == 2:
        return [ring[0], ring[1], ring[1], ring[1]]
    cuts = cuts_of(ring, splice) or [0]
    if len(cuts) == 1:
        cuts.append((cuts[0] + n // 2) % n)
    out: list[complex] = []
    for i, lo in enumerate(cuts):
        hi = cuts[(i + 1) % len(cuts)]
        part = ring[lo : hi + 1] if lo < hi else ring[lo:] + ring[: hi + 1]
        for c in chain(part):
            out += [*c[:1], *c[1:]] if not out else c[1:]
    return out


# --- fewer cubics ----------------------------------------------------------------------------


def leaving(c: Cubic) -> complex:
    """Unit tangent at a cubic's start; zero for a cubic that is a point."""
    return next((unit(p - c[0]) for p in c[1:] if abs(p - c[0]) >= 1e-9), 0j)


def arriving(c: Cubic) -> complex:
    return next((unit(c[3] - p) for p in (c[2], c[1], c[0]) if abs(c[3] - p) >= 1e-9), 0j)


def bend(before: Cubic, after: Cubic) -> float:
    """Angle between two cubics that meet; a straight angle where one is a point."""
    a, b = arriving(before), leaving(after)
    return math.acos(max(-1.0, min(1.0, a.real * b.real + a.imag * b.imag))) if a and b else math.pi


def samples(run: list[Cubic], tolerance: float) -> np.ndarray:
    """Points about a pixel apart, closer for a small tolerance; the ends exactly."""
    gap = min(1.0, max(0.25, tolerance))
    parts = [np.array([run[0][0]])]
    for c in run:
        n = min(512, max(1, math.ceil(sum(abs(b - a) for a, b in zip(c, c[1:])) / gap)))
        parts.append(at(c, np.arange(1, n + 1) / n))
    return np.concatenate(parts)


def simplified(curves: list[Cubic], tolerance: float, corner: float, closed: bool) -> list[Cubic]:
    """Smooth runs between corners fitted anew within ``tolerance``, where that takes fewer cubics; a ring is opened at its sharpest joint."""
    if tolerance <= 0 or len(curves) < 2:
        return curves
    if closed:
        bends = [bend(curves[k - 1], c) for k, c in enumerate(curves)]
        seam = bends.index(max(bends))
        curves = curves[seam:] + curves[:seam]
    cuts = [0, *(k for k in range(1, len(curves)) if bend(curves[k - 1], curves[k]) >= corner), len(curves)]
    out: list[Cubic] = []
    for lo, hi in zip(cuts, cuts[1:]):
        run = curves[lo:hi]
        start, end = leaving(run[0]), arriving(run[-1])
        if len(run) > 1 and start and end:
            fit = cubics(samples(run, tolerance), start, -end, tolerance)
            if len(fit) < len(run):
                fit[0] = (run[0][0], *fit[0][1:])
                fit[-1] = (*fit[-1][:3], run[-1][3])
                run = fit
        out += run
    return out


def thinned_chain(points: list[complex], tolerance: float, corner: float) -> list[complex]:
    """``simplified`` over 1 + 3n points."""
    curves = [tuple(points[k : k + 4]) for k in range(0, len(points) - 3, 3)]
    out = simplified(curves, tolerance, corner, points[0] == points[-1])  # type: ignore[arg-type]
    return [out[0][0], *(p for c in out for p in c[1:])] if out else points
