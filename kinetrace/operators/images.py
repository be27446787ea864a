"""Pixel operators over Arrow batches of images, their random draws seeded by a key that views share.

A row holds path, frame, height, width, image (RGB bytes, row by row) and, where an operator uses one, mask (bytes, one a
pixel).  An operator is a function (image, mask, generator) -> (image, mask) on arrays (h, w, 3) and (h, w) or None.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Op = Callable[[np.ndarray, "np.ndarray | None", np.random.Generator], "tuple[np.ndarray, np.ndarray | None]"]


def _window(size: int, fraction: float) -> int:
    return max(1, int(size * fraction))


def _both(image: np.ndarray, mask: np.ndarray | None, f: Callable[[np.ndarray], np.ndarray]):
    return f(image), None if mask is None else f(mask)


def _fraction(fraction: float) -> float:
    if not 0 < fraction <= 1:
        raise ValueError("a crop keeps a share above 0, 1 at most")
    return fraction


def centre_crop(fraction: float = 0.9) -> Op:
    """The middle of an image: a share of its height and width, a pixel at least."""
    share = _fraction(fraction)

    def run(image, mask, _):
        h, w = _window(image.shape[0], share), _window(image.shape[1], share)
        y, x = (image.shape[0] - h) // 2, (image.shape[1] - w) // 2
        return _both(image, mask, lambda a: a[y : y + h, x : x + w])

    return run


def random_crop(fraction: float = 0.9) -> Op:
    """A crop of that size at a drawn place."""
    share = _fraction(fraction)

    def run(image, mask, rng):
        h, w = _window(image.shape[0], share), _window(image.shape[1], share)
        y, x = int(rng.integers(image.shape[0] - h + 1)), int(rng.integers(image.shape[1] - w + 1))
        return _both(image, mask, lambda a: a[y : y + h, x : x + w])

    return run


def padded(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Black around an image, half before and the rest after."""
    up, left = height - a.shape[0], width - a.shape[1]
    if up < 0 or left < 0:
        raise ValueError("an image is larger than what it is padded to")
    out = np.zeros((height, width, *a.shape[2:]), a.dtype)
    out[up // 2 : up // 2 + a.shape[0], left // 2 : left // 2 + a.shape[1]] = a
    return out


def letterbox() -> Op:
    """Pads to a square."""
    return lambda image, mask, _: _both(image, mask, lambda a: padded(a, max(a.shape[:2]), max(a.shape[:2])))


def _weights(n: int, m: int) -> np.ndarray:
    """Triangle filter from n to m samples, wide enough to average where m is less: (m, n)."""
    scale = n / m
    reach = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    away = np.abs(np.arange(n)[None] + 0.5 - centre[:, None]) / reach
    w = np.maximum(0.0, 1 - away)
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with antialiasing; masks (two dimensions) take the nearest pixel."""
    if image.shape[:2] == (height, width):
        return image
    if image.ndim == 2:
        rows = np.minimum(((np.arange(height) + 0.5) * image.shape[0] / height).astype(int), image.shape[0] - 1)
        cols = np.minimum(((np.arange(width) + 0.5) * image.shape[1] / width).astype(int), image.shape[1] - 1)
        return image[rows[:, None], cols]
    out = np.tensordot(_weights(image.shape[0], height), image.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_weights(image.shape[1], width), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resize_pad(height: int, width: int) -> Op:
    """Scales to fit and pads the rest, half before."""

    def run(image, mask, _):
        scale = min(height / image.shape[0], width / image.shape[1])
        h, w = max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale))
        return _both(image, mask, lambda a: padded(resized(a, h, w), height, width))

    return run


def shortest_edge(size: int) -> Op:
    """Scales so that the shorter side has ``size`` pixels."""

    def run(image, mask, _):
        scale = size / min(image.shape[:2])
        return _both(image, mask, lambda a: resized(a, round(image.shape[0] * scale), round(image.shape[1] * scale)))

    return run


def _among(mask: np.ndarray, values: Sequence[int]) -> np.ndarray:
    """Where a mask of bytes has one of the values, looked up in a table."""
    table = np.zeros(256, bool)
    table[[v for v in values if 0 <= v < 256]] = True
    return table[mask]


def background_noise(values: Sequence[int] = (0,), p: float = 1.0) -> Op:
    """Random pixels where the mask has one of the values; without a mask nothing changes."""

    def run(image, mask, rng):
        noise, hit = rng.integers(0, 256, image.shape, np.uint8), rng.random() < p
        if mask is None or not hit:
            return image, mask
        return np.where(_among(mask, values)[..., None], noise, image), mask

    return run


def mask_tint(values: Sequence[int], alpha: tuple[float, float] = (0.3, 1.0), p: float = 0.5) -> Op:
    """One drawn colour over the pixels whose mask has one of the values, at a drawn strength."""

    def run(image, mask, rng):
        colour, share, hit = rng.integers(0, 256, 3).astype(np.float32), rng.uniform(*alpha), rng.random() < p
        if mask is None or not hit:
            return image, mask
        mixed = np.clip(image * (1 - share) + colour * share, 0, 255).astype(np.uint8)
        return np.where(_among(mask, values)[..., None], mixed, image), mask

    return run


def chained(*ops: Op) -> Op:
    def run(image, mask, rng):
        for op in ops:
            image, mask = op(image, mask, rng)
        return image, mask

    return run


def as_bytes(image: np.ndarray) -> np.ndarray:
    """Floating images in [0, 1] to bytes; bytes as they are."""
    return (255 * image).astype(np.uint8) if np.issubdtype(image.dtype, np.floating) else image


def training_pipeline(edge: int, fraction: float, target: tuple[int, int], noise: Sequence[int] = (), tint: Sequence[int] = ()) -> Op:
    """Square, scaled, noise and tint where asked for, a random crop, and the target size."""
    extra = [*([background_noise(noise)] if noise else []), *([mask_tint(tint)] if tint else [])]
    return chained(letterbox(), shortest_edge(edge), *extra, random_crop(fraction), resize_pad(*target))


def evaluation_pipeline(edge: int, fraction: float, target: tuple[int, int]) -> Op:
    return chained(letterbox(), shortest_edge(edge), centre_crop(fraction), resize_pad(*target))


class _Draws:
    """A generator that is seeded with the first draw, which costs more than most operators do; many draw nothing."""

    def __init__(self, *seed: int):
        self._seed, self._own = seed, None

    def __getattr__(self, name: str):
        if self._own is None:
            self._own = np.random.default_rng(self._seed)
        return getattr(self._own, name)


def byte_sums(images: pa.Array) -> np.ndarray:
    """Sum of the bytes of each image of a binary column, over its buffer; of none, 0."""
    offsets = np.frombuffer(images.buffers()[1], np.int32)[images.offset : images.offset + len(images) + 1]
    filled = offsets[1:] > offsets[:-1]
    out = np.zeros(len(images), np.int64)
    if filled.any():
        data = np.frombuffer(images.buffers()[2], np.uint8)[: offsets[-1]]
        out[filled] = np.add.reduceat(data, offsets[:-1][filled], dtype=np.int64)
    return out


_SCHEMA = "path string, frame long, height int, width int, image binary, mask binary"


def transformed(images: DataFrame, op: Op, key: str = "frame", seed: int = 0) -> DataFrame:
    """Images with an operator applied.  All rows of one ``key`` (a number) draw alike, so views of a step agree."""
    has = "mask" in images.columns

    def run(batches):
        for batch in batches:
            rows = []
            for path, frame, h, w, image, mask, draw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                pixels = np.frombuffer(image, np.uint8).reshape(h, w, 3)
                own = None if mask is None else np.frombuffer(mask, np.uint8).reshape(h, w)
                out, own = op(pixels, own, _Draws(seed, draw))
                rows.append((path, frame, *out.shape[:2], np.ascontiguousarray(out).tobytes(), None if own is None else np.ascontiguousarray(own).tobytes()))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "frame", "height", "width", "image", "mask"])

    mask = F.col("mask") if has else F.lit(None).cast("binary")
    own = images.select("path", F.col("frame").cast("long").alias("frame"), "height", "width", "image", mask.alias("mask"), F.abs(F.col(key).cast("long")).alias("draw"))
    return own.mapInArrow(run, _SCHEMA)
