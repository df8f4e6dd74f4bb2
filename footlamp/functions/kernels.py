"""Vectorised kernels over packed frames.

One frame is one row, so a filter that returns a frame stays inside the task that read it: Arrow hands a
batch of packed arrays to numpy and takes packed arrays back. Spark does the partitioning; each helper
here is a few array operations on one frame. Borders: mirrored without repetition for weighted sums,
repeated for gradients of the edge detector, ignored for morphology.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type objects, because a type name can only be parsed once a session exists.
RETURNS = {
    "double": T.DoubleType(),
    "array<double>": T.ArrayType(T.DoubleType()),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<boolean>": T.ArrayType(T.BooleanType()),
}


def frame_udf(fn: Callable[..., np.ndarray | float], returns: str) -> Callable[..., Column]:
    """Wrap ``fn(img, ...)`` on 2-D arrays as ``udf(array, ..., w, h)`` on packed columns.

    A null frame (no previous frame, say) is passed as None.
    """
    packed, kind = returns.startswith("array"), RETURNS[returns]

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        *arrays, w, h = columns
        out = []
        for *row, i, j in zip(*arrays, w, h):
            result = fn(*[None if a is None else np.asarray(a).reshape(j, i) for a in row])
            out.append(result.ravel() if packed else result)
        return pd.Series(out, dtype=object if packed else float)

    return run


# Weighted sums ------------------------------------------------------------------------------------


def mirrored(img: np.ndarray, r: int) -> np.ndarray:
    return np.pad(img, r, mode="reflect")


def weighted_sum(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlate with a small odd kernel."""
    k = np.asarray(kernel, dtype=np.float64)
    r = k.shape[0] // 2
    src = mirrored(img.astype(np.float64), r)
    h, w = img.shape
    out = np.zeros((h, w))
    for dy, dx in np.argwhere(k != 0):
        out += k[dy, dx] * src[dy : dy + h, dx : dx + w]
    return out


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    d = np.arange(size) - size // 2
    line = np.exp(-(d**2) / (2 * sigma * sigma))
    line /= line.sum()
    return np.outer(line, line)


def box_mean(img: np.ndarray, size: int) -> np.ndarray:
    return weighted_sum(img, np.full((size, size), 1.0 / (size * size)))


def bilateral(img: np.ndarray, d: int, sigma: float) -> np.ndarray:
    """Mean weighted by distance and by difference in value, over a disc of diameter ``d``."""
    r = d // 2
    h, w = img.shape
    img = img.astype(np.float64)
    src = mirrored(img, r)
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            far = dy * dy + dx * dx
            if far > r * r:
                continue
            near = src[r + dy : r + dy + h, r + dx : r + dx + w]
            k = np.exp(-far / (2 * sigma * sigma)) * np.exp(-((near - img) ** 2) / (2 * sigma * sigma))
            total += k * near
            weight += k
    return total / weight


# Edges --------------------------------------------------------------------------------------------

# Tangents of 22.5 and 67.5 degrees.
TAN_LOW = 0.41421356237309503
TAN_HIGH = 2.414213562373095


def edges(img: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges: gradient, maximum across the gradient direction, then growth from strong pixels."""
    src = np.pad(img.astype(np.int64), 1, mode="edge")
    h, w = img.shape

    def s(dy, dx):
        return src[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    gx = (s(-1, 1) + 2 * s(0, 1) + s(1, 1)) - (s(-1, -1) + 2 * s(0, -1) + s(1, -1))
    gy = (s(1, -1) + 2 * s(1, 0) + s(1, 1)) - (s(-1, -1) + 2 * s(-1, 0) + s(-1, 1))
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)

    def n(dy, dx):
        return m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]

    ax, ay = np.abs(gx), np.abs(gy)
    flat = ay < TAN_LOW * ax
    steep = ay > TAN_HIGH * ax
    same = (gx < 0) == (gy < 0)
    across = np.where(same, np.maximum(n(-1, -1), n(1, 1)), np.maximum(n(-1, 1), n(1, -1)))
    peak = np.where(
        flat,
        (mag > n(0, -1)) & (mag >= n(0, 1)),
        np.where(steep, (mag > n(-1, 0)) & (mag >= n(1, 0)), mag > across),
    )
    weak = peak & (mag > low)
    return grow(weak & (mag > high), weak)


def grow(seed: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Spread ``seed`` over 8-connected ``allowed`` pixels until nothing changes."""
    full = np.ones((3, 3), dtype=bool)
    while True:
        wider = seed | (dilate(seed, full) & allowed)
        if (wider == seed).all():
            return seed
        seed = wider


def edge_share(img: np.ndarray, low: float = 50, high: float = 150) -> float:
    return float(edges(img, low, high).mean())


# Morphology ---------------------------------------------------------------------------------------


def ellipse(size: int) -> np.ndarray:
    """Filled ellipse in a square of odd side."""
    r = size // 2
    rows = np.abs(np.arange(size) - r)
    half = np.rint(r * np.sqrt((r * r - rows * rows) / (r * r))).astype(int)
    return rows[None, :] <= half[:, None]


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = kernel.shape[0] // 2
    src = np.pad(mask, r, constant_values=False)
    h, w = mask.shape
    out = np.zeros((h, w), dtype=bool)
    for dy, dx in np.argwhere(kernel):
        out |= src[dy : dy + h, dx : dx + w]
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return ~dilate(~mask, kernel)


def opened(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(mask, kernel), kernel)


def closed(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return erode(dilate(mask, kernel), kernel)


def motion(img: np.ndarray, prev: np.ndarray | None, threshold: float) -> np.ndarray:
    """Changed pixels without specks, widened by one pixel; no earlier frame means no motion."""
    if prev is None:
        return np.zeros(img.shape, dtype=bool)
    k = ellipse(3)
    raw = np.abs(img.astype(np.int64) - prev) / 255.0 > threshold
    return dilate(closed(opened(raw, k), k), k)


def label_regions(mask: np.ndarray) -> np.ndarray:
    """Smallest pixel position of each 8-connected region; -1 outside."""
    h, w = mask.shape
    big = h * w
    labels = np.where(mask, np.arange(big).reshape(h, w), big)
    while True:
        src = np.pad(labels, 1, constant_values=big)
        low = labels
        for dy in range(3):
            for dx in range(3):
                low = np.minimum(low, src[dy : dy + h, dx : dx + w])
        low = np.where(mask, low, big)
        # follow the label of the label, which halves the number of rounds on long regions
        flat = np.append(low.ravel(), big)
        low = np.minimum(low, flat[low])
        if (low == labels).all():
            return np.where(mask, labels, -1)
        labels = low


# Temporal -----------------------------------------------------------------------------------------

# Keeps a weighted mean of equal integers from truncating to the integer below.
TRUNC_GUARD = 1e-6


def truncated(value: np.ndarray) -> np.ndarray:
    return np.floor(value + TRUNC_GUARD).astype(np.int64)


def motion_recent(img: np.ndarray, prev: np.ndarray | None, prev2: np.ndarray | None, threshold: float) -> np.ndarray:
    """Motion against the last two frames, closed; with one earlier frame just its mask."""
    if prev2 is None:
        return motion(img, prev, threshold)
    both = motion(img, prev, threshold) | motion(img, prev2, threshold)
    return closed(both, ellipse(5))


def lock_static(img: np.ndarray, moving: np.ndarray, background: np.ndarray) -> np.ndarray:
    wide = dilate(dilate(moving.astype(bool), ellipse(7)), ellipse(7))
    return np.where(wide, img, background)


def smooth_static(img: np.ndarray, prev: np.ndarray | None, threshold: float, alpha: float) -> np.ndarray:
    if prev is None:
        return img
    mixed = truncated((1 - alpha) * img + alpha * prev)
    return np.where(motion(img, prev, threshold), img, mixed)


def three_tap(img: np.ndarray, prev: np.ndarray | None, nxt: np.ndarray | None) -> np.ndarray:
    if prev is None or nxt is None:
        return img
    return truncated(0.15 * prev + 0.70 * img + 0.15 * nxt)


# Similarity and motion ----------------------------------------------------------------------------


def ssim(a: np.ndarray, b: np.ndarray, win: int = 7, span: float = 255.0) -> float:
    """Mean structural similarity over all complete ``win`` x ``win`` windows, sample covariance."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = win * win

    def means(img):
        acc = np.pad(img.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (acc[win:, win:] - acc[:-win, win:] - acc[win:, :-win] + acc[:-win, :-win]) / n

    ma, mb = means(a), means(b)
    fix = n / (n - 1)
    va, vb, cov = fix * (means(a * a) - ma * ma), fix * (means(b * b) - mb * mb), fix * (means(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    top = (2 * ma * mb + c1) * (2 * cov + c2)
    return float((top / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def block_shift(img: np.ndarray, prev: np.ndarray | None, block: int, reach: int) -> np.ndarray:
    """Displacement (dy, dx) of each block with the least absolute difference to the earlier frame.

    Only shifts that keep the block inside the frame compete; ties go to the smaller shift, then to
    raster order.
    """
    h, w = img.shape
    ny, nx = h // block, w // block
    best = np.full((ny, nx), np.inf)
    shift = np.zeros((ny, nx, 2))
    if prev is None:
        return shift
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    cur = img[: ny * block, : nx * block].astype(np.int64)
    top, left = np.arange(ny) * block, np.arange(nx) * block
    for dy, dx in sorted(steps, key=lambda s: (abs(s[0]) + abs(s[1]), s)):
        ys = np.clip(np.arange(ny * block) + dy, 0, h - 1)
        xs = np.clip(np.arange(nx * block) + dx, 0, w - 1)
        cost = np.abs(cur - prev[np.ix_(ys, xs)]).reshape(ny, block, nx, block).sum((1, 3)).astype(float)
        ok_y = (top + dy >= 0) & (top + block + dy <= h)
        ok_x = (left + dx >= 0) & (left + block + dx <= w)
        cost[~(ok_y[:, None] & ok_x[None, :])] = np.inf
        better = cost < best
        best[better] = cost[better]
        shift[better] = (dy, dx)
    return shift


# Tone and size ------------------------------------------------------------------------------------


def equalise_tiles(img: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited equalisation per tile, blended between the four nearest tile centres."""
    h, w = img.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    big = np.pad(img, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect").astype(np.int64)
    area = th * tw
    limit = max(1, int(clip * area / 256))
    curves = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(big[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + extra // 256
            left = extra % 256
            if left:
                step = max(256 // left, 1)
                hist[np.arange(left) * step] += 1
            curves[i, j] = np.clip(np.floor(hist.cumsum() * (255.0 / area) + 0.5), 0, 255)
    fy, fx = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    last = tiles - 1
    y1, x1 = np.clip(y0 + 1, 0, last)[:, None], np.clip(x0 + 1, 0, last)[None, :]
    y0, x0 = np.clip(y0, 0, last)[:, None], np.clip(x0, 0, last)[None, :]
    v = img.astype(np.int64)
    upper = curves[y0, x0, v] * (1 - ax) + curves[y0, x1, v] * ax
    lower = curves[y1, x0, v] * (1 - ax) + curves[y1, x1, v] * ax
    return np.floor(upper * (1 - ay) + lower * ay + 0.5)


def axis_weights(n: int, scale: int, method: str) -> np.ndarray:
    """(n * scale) x n matrix of interpolation weights along one axis; borders repeat."""
    pos = (np.arange(n * scale) + 0.5) / scale - 0.5
    base = np.floor(pos).astype(int)
    taps = np.arange(-1, 3) if method == "cubic" else np.arange(-3, 5)
    d = np.abs(pos[:, None] - (base[:, None] + taps))
    if method == "cubic":
        a = -0.75
        k = np.where(
            d <= 1,
            (a + 2) * d**3 - (a + 3) * d**2 + 1,
            np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0.0),
        )
    else:
        k = np.sinc(d) * np.sinc(d / 4) * (d < 4)
        k = k / k.sum(1, keepdims=True)
    out = np.zeros((n * scale, n))
    np.add.at(out, (np.arange(n * scale)[:, None], np.clip(base[:, None] + taps, 0, n - 1)), k)
    return out


def tone_curve(img: np.ndarray, clip: float, tiles: int, gamma: float) -> np.ndarray:
    flat = equalise_tiles(img, clip, tiles)
    return truncated(np.power(flat / 255.0, 1.0 / gamma) * 255.0)


def sharpen_soft(img: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Blend of a frame with its unsharp mask, each step held in 0..255."""
    soft = weighted_sum(img, gaussian_kernel(7, sigma))
    unsharp = np.clip(1.5 * img - 0.5 * soft, 0, 255)
    return np.clip(0.7 * img + 0.3 * unsharp, 0, 255)


def resample(img: np.ndarray, scale: int, method: str) -> np.ndarray:
    h, w = img.shape
    return axis_weights(h, scale, method) @ img.astype(np.float64) @ axis_weights(w, scale, method).T
