"""Images prepared for a text recogniser: enlarged, evened out, inverted, in black and white.

Small crops (an upper back) as numpy arrays, height x width x (b, g, r); whole-number grey and Otsu
levels as in ``colour``. An image library's rounding may differ by one.
"""

from __future__ import annotations

import numpy as np

#: Enlargement, the cubic kernel's slope, and the limit and tiles of the contrast step.
ENLARGE, SLOPE, CLIP_LIMIT, TILES = 3, -0.75, 3.0, 8


def gray(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def _kernel(x: np.ndarray) -> np.ndarray:
    """Weights of the cubic convolution at distance x."""
    x, a = np.abs(x), SLOPE
    near, far = (a + 2) * x**3 - (a + 3) * x**2 + 1, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def _stretched(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    centre = (np.arange(n * ENLARGE) + 0.5) / ENLARGE - 0.5
    first = np.floor(centre).astype(int)
    out = 0.0
    for k in range(-1, 3):
        weight = _kernel(centre - (first + k))
        shape = [-1 if d == axis else 1 for d in range(image.ndim)]
        out = out + np.take(image, np.clip(first + k, 0, n - 1), axis=axis) * weight.reshape(shape)
    return out


def enlarged(image: np.ndarray) -> np.ndarray:
    """Three times as large by cubic convolution; border pixels repeat."""
    wide = _stretched(_stretched(image.astype(float), 0), 1)
    return np.clip(np.floor(wide + 0.5), 0, 255).astype(np.uint8)


def evened(level: np.ndarray) -> np.ndarray:
    """Contrast-limited adaptive equalisation: each tile's clipped histogram gives a curve, and a pixel's level is
    that of the four curves around it, weighted by how near their tiles are."""
    height, width = level.shape
    rows, columns = -(-height // TILES), -(-width // TILES)
    padded = np.pad(level, ((0, rows * TILES - height), (0, columns * TILES - width)), "reflect" if min(height, width) > TILES else "edge")
    limit = max(1, int(CLIP_LIMIT * rows * columns / 256))
    curves = np.empty((TILES, TILES, 256))
    for y in range(TILES):
        for x in range(TILES):
            counts = np.bincount(padded[y * rows : (y + 1) * rows, x * columns : (x + 1) * columns].ravel(), minlength=256)
            over = int(np.maximum(counts - limit, 0).sum())
            counts = np.minimum(counts, limit) + over // 256
            if rest := over % 256:
                counts[np.arange(rest) * max(1, 256 // rest) % 256] += 1
            curves[y, x] = np.clip(np.floor(np.cumsum(counts) * 255.0 / (rows * columns) + 0.5), 0, 255)
    at = [(np.arange(n) / size - 0.5) for n, size in ((height, rows), (width, columns))]
    low = [np.floor(a).astype(int) for a in at]
    part = [a - f for a, f in zip(at, low, strict=True)]
    tile = lambda k, step: np.clip(low[k] + step, 0, TILES - 1)
    out = 0.0
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (part[0] if dy else 1 - part[0])[:, None] * (part[1] if dx else 1 - part[1])[None, :]
            out = out + weight * curves[tile(0, dy)[:, None], tile(1, dx)[None, :], level]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def split_level(level: np.ndarray) -> int:
    """The grey level that splits the pixels best: the largest variance between the classes, the least of ties."""
    counts = np.bincount(level.ravel(), minlength=256).astype(float)
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    below = n * (n[-1] - n)
    apart = total * n[-1] - n * total[-1]
    return int(np.argmax(np.divide(apart**2, below, out=np.zeros(256), where=below > 0)))


def variants(crop: np.ndarray) -> list[np.ndarray]:
    """The crop, enlarged, evened out, that inverted, and both in black and white. An empty crop has none."""
    if crop.size == 0:
        return []
    large = enlarged(crop)
    even = evened(gray(large))
    inverse = 255 - even
    split = [np.where(x > split_level(x), 255, 0).astype(np.uint8) for x in (even, inverse)]
    return [crop, large, *(np.repeat(x[..., None], 3, axis=2) for x in (even, inverse, *split))]
