"""Quality of trajectories, predictions and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def open_loop_error(df: DataFrame, truth: str, predicted: str, episode: str = "episode") -> DataFrame:
    """mse and mae of an episode, over its steps and dimensions."""
    away = F.zip_with(truth, predicted, lambda a, b: a - b)
    own = df.select(episode, F.explode(away).alias("d"))
    return own.groupBy(episode).agg(F.avg(F.col("d") * F.col("d")).alias("mse"), F.avg(F.abs("d")).alias("mae"))


def mean_over_episodes(errors: DataFrame) -> DataFrame:
    """Every episode counts the same, however long."""
    return errors.agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def intra_acceleration(chunk: Column) -> Column:
    """Mean size of second differences within a chunk of three rows or more."""
    at = F.sequence(F.lit(1), F.size(chunk) - 2)
    second = F.transform(at, lambda t: norm(F.transform(F.arrays_zip(F.get(chunk, t + 1).alias("a"), F.get(chunk, t).alias("b"), F.get(chunk, t - 1).alias("c")), lambda z: z["a"] - 2 * z["b"] + z["c"])))
    return F.when(F.size(chunk) >= 3, _sum(second) / (F.size(chunk) - 2))


def boundary_jumps(chunks: DataFrame, executed: int, chunk: str = "chunk", episode: str = "episode", order: str = "frame") -> DataFrame:
    """Distance from a chunk's last executed row to the next chunk's first."""
    after = F.lead(F.col(chunk)[0]).over(W.partitionBy(episode).orderBy(order))
    return chunks.withColumn("jump", norm(F.zip_with(after, F.col(chunk)[executed - 1], lambda a, b: a - b)))


def momentum(chunks: DataFrame, executed: int, chunk: str = "chunk", episode: str = "episode", order: str = "frame") -> DataFrame:
    """Cosine of the last executed move and the next chunk's first."""
    if executed < 2:
        raise ValueError("a move needs two executed rows")
    w = W.partitionBy(episode).orderBy(order)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    own = chunks.withColumn("u_", less(F.col(chunk)[executed - 1], F.col(chunk)[executed - 2])).withColumn("v_", less(F.lead(F.col(chunk)[1]).over(w), F.lead(F.col(chunk)[0]).over(w)))
    return own.withColumn("momentum", _sum(F.zip_with("u_", "v_", lambda a, b: a * b)) / (norm(F.col("u_")) * norm(F.col("v_")) + 1e-8)).drop("u_", "v_")


def rollouts(steps: DataFrame, env: str = "env", order: str = "step", done: str = "done") -> DataFrame:
    """An environment's steps cut after each done: rollout, length, success (ever), reward, q_score (max), progress (last), valid (always)."""
    w = W.partitionBy(env).orderBy(order)
    own = steps.withColumn("rollout", F.coalesce(F.sum(F.col(done).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.groupBy(env, "rollout").agg(
        F.count("*").alias("length"), F.bool_or("success").alias("success"), F.sum("reward").alias("reward"), F.max("q_score").alias("q_score"),
        F.max_by("progress", order).alias("progress"), F.bool_and("valid").alias("valid"), F.bool_or(done).alias("complete"),
    )


def success_rate(rolls: DataFrame) -> DataFrame:
    """Over complete and valid rollouts."""
    return rolls.where("complete and valid").agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("length").alias("mean_length"))


def multi_step(steps: DataFrame, n: int, how: str = "sum", env: str = "env", order: str = "step") -> DataFrame:
    """Steps in groups of n, rewards by max, min, mean or sum, up to the first done of a group."""
    own = steps.withColumn("group", F.floor(F.col(order) / n))
    over = F.coalesce(F.max(F.col("done").cast("int")).over(W.partitionBy(env, "group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reward = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[how]("reward")
    return own.withColumn("o_", over).where("o_ = 0").groupBy(env, "group").agg(reward.alias("reward"), F.bool_or("done").alias("done"), F.count("*").alias("steps"))


def token_accuracy(logits_argmax: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of labels that the prediction one place before hits, ignored labels aside."""
    pairs = F.arrays_zip(F.slice(logits_argmax, F.lit(1), F.size(logits_argmax) - 1).alias("p"), F.slice(labels, F.lit(2), F.size(labels) - 1).alias("l"))
    kept = F.filter(pairs, lambda z: z["l"] != ignore)
    return F.when(F.size(kept) > 0, F.size(F.filter(kept, lambda z: z["p"] == z["l"])) / F.size(kept))


def masked_loss(predicted: Column, noise: Column, action: Column, mask: Column) -> Column:
    """Masked mean square of predicted velocity less (action - noise)."""
    z = F.arrays_zip(predicted.alias("p"), noise.alias("n"), action.alias("a"), mask.alias("m"))
    total = F.aggregate(z, F.lit(0.0), lambda s, x: s + (x["p"] - (x["a"] - x["n"])) * (x["p"] - (x["a"] - x["n"])) * x["m"])
    return total / (_sum(mask) + 1e-6)


def ramp_weights(overlap: int, frozen: int, rate: float) -> list[float]:
    """How strongly each step of an overlap follows the new chunk: not at all while frozen, then up an exponential ramp
    (1 - exp(-rate t)) / (1 - exp(-rate)) whose ends, 0 and 1, are left out."""
    import math

    free = overlap - frozen
    top = max(1 - math.exp(-rate), 1e-8)
    return [0.0] * frozen + [(1 - math.exp(-rate * (i + 1) / (free + 1))) / top for i in range(free)]


def ramped(old: Column, new: Column, frozen: int, rate: float, overlap: int) -> Column:
    """The first ``overlap`` values of two chunks blended: the old one's while frozen, then more and more of the new one's."""
    weights = F.array(*[F.lit(float(w)) for w in ramp_weights(overlap, frozen, rate)])
    return F.transform(weights, lambda w, i: (1 - w) * F.get(old, i) + w * F.get(new, i))



def latencies(runs: DataFrame, baseline: str, mode: str = "mode", seconds: str = "seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """Median seconds of each mode, their rate, and how many times faster than the baseline mode they are."""
    own = runs.groupBy(*by, mode).agg(F.median(seconds).alias("median"), F.count("*").alias("runs")).withColumn("hz", 1 / F.col("median"))
    base = F.max(F.when(F.col(mode) == baseline, F.col("median"))).over(W.partitionBy(*by))
    return own.withColumn("speed_up", base / F.col("median"))


def open_loop_report(df: DataFrame, truth: str, predicted: str, seconds: str, episode: str = "episode") -> DataFrame:
    """Errors of each episode beside the median and the sum of its inference times (null where none was made)."""
    times = df.groupBy(F.col(episode).alias("e_")).agg(F.median(seconds).alias("median_seconds"), F.sum(seconds).alias("total_seconds"))
    return open_loop_error(df, truth, predicted, episode).join(times, F.col(episode) == F.col("e_")).drop("e_")


def chunk_errors(frames: DataFrame, chunks: DataFrame, horizon: int, truth: str, chunk: str = "chunk", episode: str = "episode", frame: str = "frame") -> DataFrame:
    """mse and mae of an episode whose prediction is asked for every ``horizon`` frames, the first ``horizon`` rows of a
    chunk standing for the frames from its own on."""
    asked = chunks.where(F.col(frame) % horizon == 0).select(F.col(episode).alias("e_"), F.col(frame).alias("f_"), F.posexplode(F.slice(chunk, 1, horizon)).alias("t_", "p_"))
    met = frames.join(asked, (F.col(episode) == F.col("e_")) & (F.col(frame) == F.col("f_") + F.col("t_")))
    return open_loop_error(met, truth, "p_", episode)


def agreement(a: Column, b: Column) -> Column:
    """Cosine and mean absolute difference of two vectors, as a struct."""
    from kinetrace.functions.rotations import cosine, l1

    return F.struct(cosine(a, b).alias("cosine"), l1(a, b).alias("l1"))


def checks(config: dict, rules: dict[str, tuple[str, object]]) -> list[tuple[str, str, str]]:
    """(name, PASS or FAIL, what was found) of rules name -> (dotted path, wanted value); numbers must be finite."""
    import math

    out = []
    for name, (path, wanted) in rules.items():
        value: object = config
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        fine = value == wanted and not (isinstance(value, float) and not math.isfinite(value))
        out.append((name, "PASS" if fine else "FAIL", repr(value)))
    return out
