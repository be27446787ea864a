"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, maybe_broadcast

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII space and \\t-\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) for a key: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3) -> DataFrame:
    """Word targets of sources.

    ``sizes`` has one row per source (source, source_size).  Sources ordered by code point, null last, weigh
    ``weights`` repeating and share all words; a target stops at ``most`` times its source's size and the excess is
    shared again by weight until none is above.  That fixed point is min(most * size, weight * level); the level is
    read off running sums in the order of most * size / weight, so no loop is needed.  The two one-partition windows
    see one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * most
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full", F.sum(limit).over(by_ratio))
        .withColumn("full_weight", F.sum("weight").over(by_ratio))
    )
    # The level if exactly the sources before this one (by ratio) are full.
    left = F.col("all_weight") - F.col("full_weight") + F.col("weight")
    level = (F.col("total") - F.col("full") + limit) / left
    ranked = ranked.withColumn("level", level).withColumn("here", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    first = F.first("here", ignorenulls=True).over(W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumn("water", first)
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), limit.cast("double")).otherwise(F.col("weight") * F.col("water"))
    return ranked.select("source", "source_size", target.alias("target"))


#: Bins in which the order of a source is laid out; only rows of the bin that holds the cut are ranked.
BINS = 1 << 12
#: Classes of importance for each doubling.
STEPS = 16
_LEAST = -(2**63)


def source_rates(classes: DataFrame, most: int) -> DataFrame:
    """source, source_size, target, rate, odds of sources from their classes of importance.

    ``classes`` has (source, class, size, imp_size, source_size, target).  A document expects min(most, rate * importance)
    copies; the rate is the level at which expected words reach the target, read off running sums over the classes from
    the highest importance down, since those reach ``most`` first (null: all do).  odds: those of the mean fraction of a
    copy, by which the order of a source is spread evenly over the bins.
    """
    limit = F.col("size") * most
    order = W.partitionBy("source").orderBy("ratio", "class").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("source")
    own = classes.withColumn("ratio", F.when(F.col("imp_size") > 0, limit / F.col("imp_size")).otherwise(F.lit(float("inf"))))
    own = own.withColumn("full", F.sum(limit).over(order) - limit).withColumn("left", F.sum("imp_size").over(whole) - F.sum("imp_size").over(order) + F.col("imp_size"))
    level = F.when(F.col("left") > 0, (F.col("target") - F.col("full")) / F.col("left"))
    own = own.withColumn("level", level).withColumn("here", F.when(F.col("level") < F.col("ratio"), F.col("level")))
    own = own.withColumn("rate", F.first("here", ignorenulls=True).over(W.partitionBy("source").orderBy("ratio", "class").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    mean = F.when(F.col("size") > 0, F.col("imp_size") / F.col("size")).otherwise(F.lit(0.0))
    expected = expected_copies(F.col("rate"), mean, most)
    part = expected - F.floor(expected)
    sums = own.groupBy("source", "source_size", "target", "rate").agg(F.sum(F.when(part > 0, part * F.col("size"))).alias("taken"), F.sum(F.when(part > 0, F.col("size"))).alias("asked"))
    p = F.greatest(F.least(F.coalesce(F.col("taken") / F.col("asked"), F.lit(0.5)), F.lit(1 - 1e-9)), F.lit(1e-9))
    return sums.select("source", "source_size", "target", "rate", (p / (1 - p)).alias("odds"))


def expected_copies(rate: Column, importance: Column, most: int) -> Column:
    return F.when(importance > 0, F.when(rate.isNull(), F.lit(float(most))).otherwise(F.least(rate * importance, F.lit(float(most))))).otherwise(F.lit(0.0))


def pareto_mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    importance: str | Callable[[Column], Column] | None = None,
    seed: int = 7,
    bins: int = BINS,
    keep: bool = False,
    work: Workspace | None = None,
) -> DataFrame:
    """Copies of each document in a mix of sources at target weights: doc_id, size, source, source_size, target, copies, taken.

    Each document expects ``rate * importance`` copies, at most ``most``, with the rate at which the source's expected
    words reach its target; ``importance`` is a non-negative column, or a function of the size in words, by default 1.
    Whole copies are certain; the fraction left is an inclusion probability p.  Documents of a source are ranked by
    (u / (1 - u)) / (p / (1 - p)) with u a seeded hash of doc_id and text (Pareto order sampling), and a sample of fixed
    size in words is cut from the top of that order: the prefix whose words come nearest to what whole copies leave of the
    target.  A source's taken words therefore miss its target by half a document at most, unless importances of 0 forbid it.

    No task ranks a source: words are summed over ``bins`` of the order, and only rows of the bin in which the cut falls are
    put in order.  Rows for which nothing is left to chance (p = 0) take no part in that.  Each row is then judged by itself
    against its source's cut, so with ``keep`` the columns of docs stay and copies and taken are added to them.

    Null text counts 0 words, documents of 0 words take 0, very long texts count whole; a null source is a source of its own;
    null doc_ids are rows like any other.  Ties of rank go by doc_id, null first; rows equal in doc_id and text stand or fall
    together.  An empty table gives an empty result; without ``keep`` other columns are not read, with it the names copies and
    taken must be free.
    """
    work = work or Workspace(docs.sparkSession, "mix")
    size = word_count(F.col(text))
    draw = uniform(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))), seed)

    def measured(*more: Column) -> DataFrame:
        given = F.col(importance).cast("double") if isinstance(importance, str) else F.lit(1.0)
        own = docs.select(*more, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), draw.alias("u"), given.alias("given"))
        own = own.withColumn("imp", importance(F.col("size")).cast("double") if callable(importance) else F.col("given")).drop("given")
        return own.withColumn("imp", F.when(F.col("imp") > 0, F.col("imp")).otherwise(F.lit(0.0)))

    slim = work.write(measured(), "sizes")
    kind = F.when(F.col("imp") > 0, F.floor(F.log2("imp") * STEPS)).otherwise(F.lit(_LEAST))
    classes = work.write(slim.groupBy("source", kind.alias("class")).agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("imp")).alias("imp_size")), "classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = work.write(targets.select(F.col("source").alias("s"), "source_size", "target"), "targets")
    rates = work.write(source_rates(classes.join(maybe_broadcast(targets), F.col("source").eqNullSafe(F.col("s"))).drop("s"), most).withColumnRenamed("source", "s"), "rates")

    def placed(rows: DataFrame) -> DataFrame:
        """Adds whole copies, the key of the order and its bin; both are null where nothing is left to chance."""
        rows = rows.withColumn("expected_", expected_copies(F.col("rate"), F.col("imp"), most)).withColumn("whole_", F.floor("expected_"))
        p = F.col("expected_") - F.col("whole_")
        odds = (F.col("u") / (1 - F.col("u"))) * (1 - p) / p
        rows = rows.withColumn("key_", F.when((p > 0) & (F.col("size") > 0), odds))
        even = F.col("key_") * F.col("odds")
        return rows.withColumn("bin_", F.when(F.col("key_").isNotNull(), F.least(F.floor(even / (1 + even) * bins), F.lit(bins - 1))))

    met = placed(slim.join(maybe_broadcast(rates), F.col("source").eqNullSafe(F.col("s"))))
    pieces = work.write(met.groupBy("s", F.col("bin_").alias("bin")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole_")).alias("certain")), "pieces")
    certain = F.sum("certain").over(W.partitionBy("s"))
    ends = F.sum(F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(0)).over(W.partitionBy("s").orderBy("bin"))
    cuts = pieces.select("s", "bin", "words", certain.alias("certain"), ends.alias("end")).join(rates.select(F.col("s").alias("s2"), "target"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    over = cuts.where("bin is not null and end > target - certain").groupBy("s", "target", "certain").agg(F.min(F.struct("bin", (F.col("end") - F.col("words")).alias("before"))).alias("cut"))
    over = work.write(over.select(F.col("s").alias("cs"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"), (F.col("target") - F.col("certain")).alias("room")), "cuts")

    def tied(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long"), F.lit(_LEAST))

    def cut(rows: DataFrame) -> DataFrame:
        return rows.join(maybe_broadcast(over), F.col("s").eqNullSafe(F.col("cs")), "left").drop("cs")

    edge = cut(met).where("bin_ = cut_bin").groupBy("s", "before", "room", "key_", tied("doc_id").alias("id_")).agg(F.sum("size").alias("words"))
    start = F.col("before") + F.coalesce(F.sum("words").over(W.partitionBy("s").orderBy("key_", "id_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = edge.withColumn("start", start).where(2 * F.col("start") + F.col("words") <= 2 * F.col("room")).groupBy("s").agg(F.max(F.struct("key_", "id_")).alias("last"))
    last = work.write(last.select(F.col("s").alias("ls"), F.col("last.key_").alias("last_key"), F.col("last.id_").alias("last_id")), "last")

    rows = measured(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")) if keep else slim
    rows = cut(placed(rows.join(maybe_broadcast(rates), F.col("source").eqNullSafe(F.col("s"))))).join(maybe_broadcast(last), F.col("s").eqNullSafe(F.col("ls")), "left")
    within = (F.col("key_") < F.col("last_key")) | ((F.col("key_") == F.col("last_key")) & (tied("doc_id") <= F.col("last_id")))
    extra = F.when(F.col("key_").isNull(), False).when(F.col("cut_bin").isNull() | (F.col("bin_") < F.col("cut_bin")), True).when(F.col("bin_") == F.col("cut_bin"), F.coalesce(within, F.lit(False))).otherwise(False)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole_") + extra.cast("int")).otherwise(F.lit(0)).cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    if keep:
        return rows.select("row_.*", "copies", "taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
