"""Normalisation of vectors by statistics arrays, and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rotations import sin_cos

CLIP = 5.0


def _each(x: Column, a: Column, b: Column, f) -> Column:
    """f(x_i, a_i, b_i) of three arrays."""
    return F.zip_with(x, F.arrays_zip(a.alias("a"), b.alias("b")), lambda v, s: f(v, s["a"], s["b"]))


def _clip(x: Column, bound: float) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def minmax(x: Column, low: Column, high: Column, clip: bool = False) -> Column:
    """To [-1, 1]; 0 where low and high are close; beyond the bounds only clipped if asked."""
    close = lambda a, b: F.abs(b - a) <= 1e-8 + 1e-5 * F.abs(b)
    return _each(x, low, high, lambda v, a, b: F.when(close(a, b), 0.0).otherwise(_clip(2 * (v - a) / (b - a) - 1, 1.0) if clip else 2 * (v - a) / (b - a) - 1))


def from_minmax(x: Column, low: Column, high: Column) -> Column:
    return _each(x, low, high, lambda v, a, b: (_clip(v, 1.0) + 1) / 2 * (b - a) + a)


def mean_std(x: Column, mean: Column, std: Column) -> Column:
    """z-scores, the raw value where std is 0, clipped to +-CLIP in any case."""
    return _each(x, mean, std, lambda v, m, s: _clip(F.when(s == 0, v).otherwise((v - m) / s), CLIP))


def from_mean_std(x: Column, mean: Column, std: Column) -> Column:
    return _each(x, mean, std, lambda v, m, s: F.when(s == 0, v).otherwise(v * s + m))


def bounds(stats: dict[str, Column], use_percentiles: bool) -> tuple[Column, Column]:
    return (stats["q01"], stats["q99"]) if use_percentiles else (stats["min"], stats["max"])


def normalize_state(key: str, x: Column, stats: dict[str, Column], *, sin_cos_keys=(), mean_std_keys=(), pass_through=(), use_percentiles=False, clip_outliers=True) -> Column:
    """In this order: sine and cosine, z-score, as it is, min-max; a key without statistics is an error."""
    if key in sin_cos_keys:
        return sin_cos(x)
    if key in pass_through:
        return x
    if not stats:
        raise KeyError(f"no statistics for {key}")
    if key in mean_std_keys:
        return mean_std(x, stats["mean"], stats["std"])
    return minmax(x, *bounds(stats, use_percentiles), clip=clip_outliers)


def denormalize_state(key: str, x: Column, stats: dict[str, Column], *, sin_cos_keys=(), mean_std_keys=(), pass_through=(), use_percentiles=False) -> Column:
    if key in sin_cos_keys:
        raise ValueError(f"{key} was encoded by sine and cosine, which can't be undone")
    if key in pass_through:
        return x
    if not stats:
        raise KeyError(f"no statistics for {key}")
    if key in mean_std_keys:
        return from_mean_std(x, stats["mean"], stats["std"])
    return from_minmax(x, *bounds(stats, use_percentiles))


def normalize_action(x: Column, stats: dict[str, Column], how: str = "minmax", *, use_percentiles=False) -> Column:
    """``skip``, ``minmax``, ``meanstd``, or ``xyz``: z-scores for the first three values, the rest as it is."""
    if how == "skip":
        return x
    if how == "minmax":
        return minmax(x, *bounds(stats, use_percentiles))
    if how == "xyz":
        first = mean_std(F.slice(x, 1, 3), F.slice(stats["mean"], 1, 3), F.slice(stats["std"], 1, 3))
        return F.concat(first, F.slice(x, F.lit(4), F.size(x) - 3))
    return mean_std(x, stats["mean"], stats["std"])


def denormalize_action(x: Column, stats: dict[str, Column], how: str = "minmax", *, use_percentiles=False) -> Column:
    if how == "skip":
        return x
    if how == "minmax":
        return from_minmax(x, *bounds(stats, use_percentiles))
    if how == "xyz":
        first = from_mean_std(F.slice(x, 1, 3), F.slice(stats["mean"], 1, 3), F.slice(stats["std"], 1, 3))
        return F.concat(first, F.slice(x, F.lit(4), F.size(x) - 3))
    return from_mean_std(x, stats["mean"], stats["std"])
