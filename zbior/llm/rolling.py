"""Rolling hashes over many texts at once, as numpy operations on the concatenated code points."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts (one more entry for the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return points, starts


def gear(points: np.ndarray, window: int = 64) -> np.ndarray:
    """At each position the gear hash of the ``window`` (a power of two, up to 64) code points that end there.

    h = (h << 1) + g[c] forgets what was shifted out, so the hash of a window is the sum of its shifted
    gears; doubling builds it in log2(window) steps. Positions before a full window hold what there is.
    """
    with np.errstate(over="ignore"):
        h = mix((points.astype(_U) + _U(1)) * _GOLD)
        width = 1
        while width < window:
            longer = h.copy()
            longer[width:] += h[:-width] << _U(width)
            h, width = longer, width * 2
    return h


def polynomial(values: np.ndarray, window: int) -> np.ndarray:
    """At each position the hash of the ``window`` values that start there (the last ones are incomplete)."""
    base, done, out = _GOLD | _U(1), 0, np.zeros(len(values), _U)
    power, h, width, factor = window, mix(values.astype(_U) + _U(1)), 1, base
    with np.errstate(over="ignore"):
        while power:
            if power & 1:
                # out covers `done` values; append the next `width`
                shifted = np.zeros_like(h)
                if done < len(h):
                    shifted[: len(h) - done] = h[done:]
                out, done = out * factor + shifted, done + width
            power >>= 1
            if power:
                longer = h * factor
                longer[: len(h) - width if len(h) > width else 0] += h[width:]
                h, factor, width = longer, factor * factor, width * 2
    return out


def sliding(values: np.ndarray, window: int, least: bool, ahead: bool) -> np.ndarray:
    """Minimum (or maximum) of ``window`` values from each position on (or up to it); edges see fewer."""
    pick = np.minimum if least else np.maximum
    out, width = values, 1
    while width < window:
        step = min(width, window - width)
        moved = out.copy()
        if step < len(out):
            if ahead:
                moved[:-step] = pick(out[:-step], out[step:])
            else:
                moved[step:] = pick(out[step:], out[:-step])
        out, width = moved, width + step
    return out
