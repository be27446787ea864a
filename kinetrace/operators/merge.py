"""Statistics of several datasets as those of their weighted mixture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The probabilities of known points of each dataset's distribution.
KNOTS = (("min", 0.0), ("q01", 0.01), ("q02", 0.02), ("q98", 0.98), ("q99", 0.99), ("max", 1.0))
ASKED = (("q01", 0.01), ("q02", 0.02), ("q98", 0.98), ("q99", 0.99))


def normalised(weights: DataFrame, weight: str = "weight", keys: Sequence[str] = ()) -> DataFrame:
    """Weights over their sum, in each group; a negative one, or none above 0, is an error.  A group has a row per dataset."""
    total = F.sum(weight).over(W.partitionBy(*keys))
    least = F.min(weight).over(W.partitionBy(*keys))
    ok = F.when((least < 0) | (total <= 0), F.raise_error(F.lit("weights must be 0 or more with a sum above 0"))).otherwise(F.col(weight) / total)
    return weights.withColumn(weight, ok)


def merge_moments(stats: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """Mean sum(w m), deviation sqrt(sum(w (s^2 + m^2)) - mean^2), least and greatest; weights are normalised per group."""
    out = normalised(stats.withColumn("w_", F.col(weight)), "w_", keys)
    out = out.groupBy(*keys).agg(
        F.sum(F.col("w_") * F.col("mean")).alias("mean"),
        F.sum(F.col("w_") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))).alias("square_"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return out.withColumn("std", F.sqrt(F.greatest(F.col("square_") - F.col("mean") * F.col("mean"), F.lit(0.0)))).select(*keys, "mean", "std", "min", "max")


def merge_quantiles(stats: DataFrame, keys: Sequence[str], dataset: str = "dataset", weight: str = "weight") -> DataFrame:
    """q01, q02, q98, q99 of the mixture of piecewise-linear distributions through each dataset's knots.

    All knots of a group make a grid; each dataset's distribution is interpolated at every grid point (0 left, 1
    right), weighted and summed, made monotone with ends 0 and 1, and inverted linearly.  Groups hold at most six
    points a dataset.  Null, NaN or descending knots are errors.
    """
    keys = list(keys)
    values = [F.col(n) for n, _ in KNOTS]
    fine = F.lit(True)
    for v in values:
        fine = fine & v.isNotNull() & ~F.isnan(v)
    for a, b in zip(values[:-1], values[1:], strict=True):
        fine = fine & (a <= b)
    own = normalised(stats.withColumn("w_", F.col(weight)), "w_", keys)
    points = F.array(*[F.struct(F.col(n).cast("double").alias("x"), F.lit(p).alias("p")) for n, p in KNOTS])
    own = own.withColumn("k_", F.when(fine, points).otherwise(F.raise_error(F.lit("knots must ascend without nulls"))))
    # Equal x keep the greatest p.
    own = own.withColumn("k_", F.filter("k_", lambda k: F.col("k_")["x"].isNotNull() & (k["p"] == F.array_max(F.transform(F.filter(F.col("k_"), lambda o: o["x"] == k["x"]), lambda o: o["p"])))))
    grid = own.select(*keys, F.explode("k_").alias("g")).select(*keys, F.col("g.x").alias("x")).distinct()
    below = F.element_at(F.filter("k_", lambda k: k["x"] <= F.col("x")), -1)
    above = F.element_at(F.filter("k_", lambda k: k["x"] > F.col("x")), 1)
    met = grid.join(own.select(*keys, "k_", "w_"), keys)
    first, last = F.col("k_")[0], F.element_at("k_", -1)
    inner = F.try_add(F.lit(0.0), F.col("lo")["p"] + (F.col("x") - F.col("lo")["x"]) / (F.col("hi")["x"] - F.col("lo")["x"]) * (F.col("hi")["p"] - F.col("lo")["p"]))
    met = met.withColumn("lo", F.when(F.col("x") >= first["x"], below)).withColumn("hi", F.when(F.col("x") < last["x"], above))
    cdf = F.when(F.col("x") >= last["x"], 1.0).when(F.col("x") < first["x"], 0.0).otherwise(inner)
    mixed = met.groupBy(*keys, "x").agg(F.sum(F.col("w_") * cdf).alias("f"))
    w = W.partitionBy(*keys).orderBy("x")
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    rank = F.row_number().over(w)
    mixed = mixed.withColumn("r_", rank).withColumn("n_", n).withColumn("g_", F.max("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    mixed = mixed.withColumn("g_", F.when(F.col("r_") == 1, 0.0).when(F.col("r_") == F.col("n_"), 1.0).otherwise(F.col("g_")))
    mixed = mixed.withColumn("g0_", F.lag("g_").over(w)).withColumn("x0_", F.lag("x").over(w))
    out = []
    for name, p in ASKED:
        line = F.when(F.col("g_") == F.col("g0_"), F.col("x")).otherwise(F.col("x0_") + (F.lit(p) - F.col("g0_")) / (F.col("g_") - F.col("g0_")) * (F.col("x") - F.col("x0_")))
        hit = F.when((F.col("n_") == 1), F.col("x")).when((F.col("g_") >= p) & (F.col("g0_") < p), line)
        out.append(F.min(hit).alias(name))
    return mixed.groupBy(*keys).agg(*out)


def checked_merge(per_dataset: dict[str, dict], weights: dict[str, float]) -> None:
    """What can't be merged is an error: datasets without statistics, other keys or shapes, statistics that are missing."""
    from .stats import MERGED, missing_stats

    lacking = sorted(d for d, s in per_dataset.items() if not s)
    if lacking:
        raise ValueError(f"no statistics of {lacking}")
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be 0 or more with a sum above 0")
    present = {d: "relative_action" in s for d, s in per_dataset.items()}
    if any(present.values()) and not all(present.values()):
        raise ValueError(f"statistics of relative actions must be there for all datasets or for none: {present}")
    first = next(iter(per_dataset.values()))
    shape = lambda v: (len(v), len(v[0]) if v and isinstance(v[0], list) else 0)
    for d, s in per_dataset.items():
        for modality, keys in first.items():
            if set(s.get(modality, {})) != set(keys):
                raise ValueError(f"{d} has other keys of {modality}")
            gone = missing_stats(s[modality], MERGED)
            if gone:
                raise ValueError(f"{d} lacks {gone} of {modality}")
            for key, own in keys.items():
                if any(shape(s[modality][key][n]) != shape(own[n]) for n in MERGED):
                    raise ValueError(f"{modality} {key} of {d} has another shape")


def long_stats(spark: SparkSession, per_dataset: dict[str, dict], weights: dict[str, float]) -> DataFrame:
    """dataset, weight, modality, key, t (-1 without steps), dim and the merged statistics, a row for each value of a file."""
    from .stats import MERGED

    rows = []
    for d, s in per_dataset.items():
        for modality, keys in s.items():
            for key, own in keys.items():
                steps = own["mean"] if isinstance(own["mean"][0], list) else [own["mean"]]
                for t in range(len(steps)):
                    value = lambda n, i, t=t, own=own: float(own[n][t][i] if isinstance(own[n][0], list) else own[n][i])
                    rows += [(d, float(weights[d]), modality, key, t if isinstance(own["mean"][0], list) else -1, i, *[value(n, i) for n in MERGED]) for i in range(len(steps[t]))]
    return spark.createDataFrame(rows, "dataset string, weight double, modality string, key string, t int, dim int, " + ", ".join(f"{n} double" for n in MERGED))


def merge_by_embodiment(spark: SparkSession, datasets: dict[str, tuple[str, float, dict]]) -> dict:
    """tag -> modality -> key -> statistics, merged over the datasets (name -> tag, weight, statistics) of each embodiment.

    Moments and percentiles of all embodiments are merged in one plan; the result is as large as one statistics file a tag.
    """
    groups: dict[str, dict[str, tuple[float, dict]]] = {}
    for name, (tag, weight, stats) in datasets.items():
        groups.setdefault(tag, {})[name] = (weight, stats)
    long = None
    for tag, own in groups.items():
        checked_merge({d: s for d, (_, s) in own.items()}, {d: w for d, (w, _) in own.items()})
        part = long_stats(spark, {d: s for d, (_, s) in own.items()}, {d: w for d, (w, _) in own.items()}).withColumn("tag", F.lit(tag))
        long = part if long is None else long.unionByName(part)
    if long is None:
        return {}
    keys = ["tag", "modality", "key", "t", "dim"]
    both = merge_moments(long, keys).join(merge_quantiles(long, keys), keys)
    out: dict = {}
    for r in both.orderBy(*keys).collect():
        own = out.setdefault(r.tag, {}).setdefault(r.modality, {}).setdefault(r.key, {})
        for n in ("mean", "std", "min", "max", "q01", "q02", "q98", "q99"):
            if r.t < 0:
                own.setdefault(n, []).append(r[n])
            else:
                steps = own.setdefault(n, [])
                if len(steps) <= r.t:
                    steps.append([])
                steps[r.t].append(r[n])
    return out
