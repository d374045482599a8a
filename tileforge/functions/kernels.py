"""NumPy kernels over one tile, without Spark. Arrays are [rows, columns, bands]."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def grid(data, h: int, w: int, bands: int) -> np.ndarray:
    return np.asarray(data, np.float64).reshape(h, w, bands)


def chunks(data, labels, h: int, w: int, bands: int, chunk: int, stride: int, output: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    image, truth = grid(data, h, w, bands), np.asarray(labels, np.int32).reshape(h, w)
    edge = (chunk - output) // 2
    for r, y in enumerate(range(0, h - chunk + 1, stride)):
        for c, x in enumerate(range(0, w - chunk + 1, stride)):
            inner = truth[y + edge : y + edge + output, x + edge : x + edge + output]
            yield r, c, image[y : y + chunk, x : x + chunk].reshape(-1).astype(np.float32), inner.reshape(-1)


def mirror(at: np.ndarray, size: int) -> np.ndarray:
    """Indices mirrored at the edges, which are not repeated."""
    if size == 1:
        return np.zeros_like(at)
    p = np.mod(at, 2 * size - 2)
    return np.where(p < size, p, 2 * size - 2 - p)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the centre, nearest pixel, mirrored outside."""
    h, w = image.shape[:2]
    y, x = np.mgrid[:h, :w]
    cy, cx, a = (h - 1) / 2, (w - 1) / 2, np.radians(degrees)
    sy = np.cos(a) * (y - cy) - np.sin(a) * (x - cx) + cy
    sx = np.sin(a) * (y - cy) + np.cos(a) * (x - cx) + cx
    return image[mirror(np.floor(sy + 0.5).astype(int), h), mirror(np.floor(sx + 0.5).astype(int), w)]


def run_model(model: Callable[[np.ndarray], np.ndarray], image: np.ndarray, patch: tuple[int, int] | None = None, batch_bytes: int = 8 << 20) -> np.ndarray:
    """The model's output for a tile. ``model`` takes [n, h, w, bands] and gives [n, h', w', classes].

    Without ``patch`` the tile goes in whole. With it the tile is cut into patches of that size at a stride of the output's
    size, scored in batches of about ``batch_bytes``, and put together.
    """
    if patch is None:
        return model(image[None])[0]
    ph, pw = patch
    probe = model(image[None, :ph, :pw])[0]
    oh, ow, k = probe.shape
    rows, cols = (image.shape[0] - ph) // oh + 1, (image.shape[1] - pw) // ow + 1
    out = np.empty((rows * oh, cols * ow, k))
    at = [(r, c) for r in range(rows) for c in range(cols)]
    step = max(1, batch_bytes // max(1, ph * pw * image.shape[2] * 8))
    for first in range(0, len(at), step):
        part = at[first : first + step]
        done = model(np.stack([image[r * oh : r * oh + ph, c * ow : c * ow + pw] for r, c in part]))
        for (r, c), d in zip(part, done):
            out[r * oh : (r + 1) * oh, c * ow : (c + 1) * ow] = d
    return out


def gaussian(sigma: float, reach: float = 4.0) -> np.ndarray:
    k = int(reach * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    return g / g.sum()


def convolve(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis of a plane, only where the kernel fits."""
    n = image.shape[axis] - len(kernel) + 1
    out = 0.0
    for k, g in enumerate(kernel):
        out = out + g * np.take(image, np.arange(k, k + n), axis=axis)
    return out


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of a plane with edges reflected (the edge pixel is repeated)."""
    g = gaussian(sigma)
    k = len(g) // 2
    return convolve(convolve(np.pad(image, k, mode="symmetric"), g, 0), g, 1)


def near_sums(planes: list[np.ndarray], reach: int, block: int = 128) -> list[np.ndarray]:
    """The sums of the cells around each within ``reach``, by inverse distance: for each row offset a product with a band of weights.

    Columns go in blocks, so that the band is no wider than a block and its margins. Planes have one size.
    """
    h, w = planes[0].shape
    block = min(block, w)
    around = [np.pad(p, ((reach, reach), (reach, reach + -w % block))) for p in planes]
    out = [np.zeros((h, w + -w % block)) for _ in planes]
    dx = np.arange(block + 2 * reach)[:, None] - reach - np.arange(block)
    for dy in range(-reach, reach + 1):
        far = np.hypot(dy, dx)
        band = np.divide(1.0, far, out=np.zeros(far.shape), where=(far > 0) & (far <= reach))
        for a, o in zip(around, out):
            for x in range(0, w, block):
                o[:, x : x + block] += a[reach + dy : reach + dy + h, x : x + block + 2 * reach] @ band
    return [o[:, :w] for o in out]


def fill_gaps(image: np.ndarray, reach: int = 16) -> np.ndarray:
    """NaN cells from valid cells within ``reach``, by inverse distance; then one 3 x 3 mean over what was filled.

    A cell without a valid neighbour in reach stays NaN. The smoothing reads filled and valid cells and changes filled ones only.
    """
    gaps = np.isnan(image)
    if not gaps.any() or gaps.all():
        return image.copy()
    y, x = np.nonzero(gaps)

    def gathered(plane: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int, weight: Callable[[float], float]) -> np.ndarray:
        """Weighted means of the valid cells around each (y, x), one offset at a time, so that memory grows with the gaps only."""
        around = np.pad(plane, reach, constant_values=np.nan)
        total, weights = np.zeros(len(y)), np.zeros(len(y))
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                w = weight(np.hypot(dy, dx))
                if w > 0:
                    v = around[y + reach + dy, x + reach + dx]
                    ok = ~np.isnan(v)
                    total[ok] += w * v[ok]
                    weights[ok] += w
        return np.divide(total, weights, out=np.full(len(y), np.nan), where=weights > 0)

    out = image.copy()
    if np.isinf(image).any():  # zero times infinite is no number
        out[y, x] = gathered(image, y, x, reach, lambda far: 1 / far if 0 < far <= reach else 0.0)
    else:
        total, weights = near_sums([np.nan_to_num(image), (~gaps).astype(float)], reach)
        out[y, x] = np.divide(total[y, x], weights[y, x], out=np.full(len(y), np.nan), where=weights[y, x] > 0)
    filled = ~np.isnan(out[y, x])
    y, x = y[filled], x[filled]
    smooth = out.copy()
    smooth[y, x] = gathered(out, y, x, 1, lambda far: 1.0)
    return smooth


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each cell to the nearest true cell; infinite where there is none. A few planes of memory."""
    h, w = mask.shape
    column = np.full((h, w), np.inf)
    far = np.full(w, np.inf)
    for rows in (range(h), range(h - 1, -1, -1)):
        far[:] = np.inf
        for y in rows:
            far = np.where(mask[y], 0, far + 1)
            column[y] = np.minimum(column[y], far)
    squares = column**2
    out = squares.copy()
    for d in range(1, w):
        if d * d >= out.max():
            break
        out[:, d:] = np.minimum(out[:, d:], squares[:, :-d] + d * d)
        out[:, :-d] = np.minimum(out[:, :-d], squares[:, d:] + d * d)
    return np.sqrt(out)


def surface_loss(truth: np.ndarray, p: np.ndarray) -> float:
    """Mean of p * d0 + (1 - p) * d1, where d0 and d1 are the signed distances to the boundary of the masks truth == 0 and truth == 1.

    A mask that is empty has distance 0. What the measure asks for is its own: it grows where a right score is far inside.
    """

    def signed(mask: np.ndarray) -> np.ndarray:
        if not mask.any():
            return np.zeros(mask.shape)
        out = distance_to(mask)
        inner = np.where(mask, distance_to(~mask) - 1, 0.0) if not mask.all() else np.zeros(mask.shape)
        return out * ~mask - inner * mask

    t = truth > 0.5
    return float((p * signed(~t) + (1 - p) * signed(t)).mean())


#: Weights of the five scales.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(a: np.ndarray, b: np.ndarray, peak: float = 4.0, size: int = 11, sigma: float = 1.5) -> float:
    """Multi-scale structural similarity of two planes, or of two images of some bands: the mean over bands.

    One filter size serves all scales: ``size``, or for tiles whose smallest scale is less than that, the smaller side's
    sixteenth part (1 at least). A plane with an odd side repeats its last row or column before it is halved.
    """
    a, b = (z if z.ndim == 3 else z[:, :, None] for z in (a, b))
    side = min(*a.shape[:2], *b.shape[:2])
    n = size if side / 2 ** (len(SCALE_WEIGHTS) - 1) >= size else max(1, int(side / 2 ** (len(SCALE_WEIGHTS) - 1)))
    g = np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / sigma) ** 2)
    g /= g.sum()

    def mean(z: np.ndarray) -> np.ndarray:
        return convolve(convolve(z, g, 0), g, 1)

    score = 1.0
    for k, weight in enumerate(SCALE_WEIGHTS):
        ma, mb = mean(a), mean(b)
        va, vb, cov = mean(a * a) - ma * ma, mean(b * b) - mb * mb, mean(a * b) - ma * mb
        c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
        contrast = (2 * cov + c2) / (va + vb + c2)
        last = k == len(SCALE_WEIGHTS) - 1
        value = ((2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * contrast if last else contrast).mean(axis=(0, 1))
        score = score * np.maximum(value, 0.0) ** weight
        if not last:
            a, b = (halved(z) for z in (a, b))
    return float(np.mean(score))


def halved(z: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 cells."""
    z = np.pad(z, [(0, z.shape[0] % 2), (0, z.shape[1] % 2), (0, 0)][: z.ndim], mode="symmetric")
    return z.reshape(z.shape[0] // 2, 2, z.shape[1] // 2, 2, *z.shape[2:]).mean(axis=(1, 3))


def ms_ssim_mse(a: np.ndarray, b: np.ndarray, peak: float = 4.0) -> float:
    """The loss 1 - MS-SSIM plus the mean square error."""
    return 1 - ms_ssim(a, b, peak) + float(((a - b) ** 2).mean())
