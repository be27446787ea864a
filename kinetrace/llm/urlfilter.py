"""URL filter by the ratio of two character language models (DataFrame functions only).

URLs that allow rules fit train one model, those that block rules fit another.  Both are variable-order Markov models
over characters: P_k(c | last k-1 characters) = (n(context, c) + s * P_{k-1}) / (n(context) + s), up to order 5, P_0
uniform.  Other URLs are judged by the mean log ratio per character against a threshold calibrated on labelled URLs
that trained neither model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, partitions

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
STRENGTH = 3.0
ALPHABET = 256.0
#: Width of the histogram cells among whose bounds the threshold is sought.
CELL = 0.01


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty for null or no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _grams(text: str) -> Column:
    """Every character of the text and the end, each behind the ORDER - 1 characters before it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col(text), F.lit("\x03"))
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER))))


def log_ratios(texts: DataFrame, counted: DataFrame, work: Workspace) -> DataFrame:
    """gram, ratio: log P(accepted) - log P(rejected) of the last character of every gram of ``texts`` (gram).

    ``counted`` has (gram, accepted, rejected) of the training URLs.  Each order is summed from the one above, which has
    been written, so the corpus is read once and no order is summed twice; probabilities are then built from order 1 upwards.
    """
    level = texts.select("gram").distinct().withColumn("accepted", F.lit(0)).withColumn("rejected", F.lit(0)).unionByName(counted)
    levels = []
    for k in range(ORDER, 0, -1):
        level = work.write(level.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), f"order-{k}")
        levels.append((k, level))
        level = level.withColumn("gram", F.substring("gram", 2, ORDER))
    lower = None
    for k, level in reversed(levels):
        context = level.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("accepted").alias("all_accepted"), F.sum("rejected").alias("all_rejected"))
        level = level.withColumn("context", F.substring("gram", 1, k - 1)).join(context, "context")
        if lower is None:
            level = level.withColumn("pa", F.lit(1 / ALPHABET)).withColumn("pr", F.lit(1 / ALPHABET))
        else:
            level = level.join(lower.withColumnRenamed("gram", "tail"), F.substring("gram", 2, ORDER) == F.col("tail"))
        lower = level.select(
            "gram",
            ((F.col("accepted") + STRENGTH * F.col("pa")) / (F.col("all_accepted") + STRENGTH)).alias("pa"),
            ((F.col("rejected") + STRENGTH * F.col("pr")) / (F.col("all_rejected") + STRENGTH)).alias("pr"),
        )
    return lower.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def threshold(scores: DataFrame) -> float:
    """The bound of a histogram cell that splits labelled scores (score, accepted) best: the mean of both classes' hit rates.

    Ties go to the bound next to 0.  One class alone, or none: 0.  The histogram has a row for each cell of CELL width;
    scores lie within +-log(ALPHABET * counts), so a few thousand rows come to the driver whatever the input.
    """
    cells = scores.groupBy(F.floor(F.col("score") / CELL).alias("cell")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum(F.lit(1) - F.col("accepted").cast("long")).alias("r")).collect()
    a, r = sum(x.a for x in cells), sum(x.r for x in cells)
    if not a or not r:
        return 0.0
    best, kept, let = None, a, r
    for x in sorted(cells, key=lambda x: x.cell):
        key = (kept / a + (r - let) / r, -abs(x.cell))
        if best is None or key > best[0]:
            best = (key, x.cell * CELL)
        kept, let = kept - x.a, let - x.r
    return best[1]


def judge_urls(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, work: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row.

    The rule's verdict where one fits; else allow if the mean log ratio per character of what follows :// (the whole
    url without one; empty for null) reaches the threshold.  Labelled URLs whose first MD5 byte is divisible by 5 calibrate and the
    rest train, all of them.  Distinct URLs are scored once; joins are plain equi-joins that split large keys.
    Without labelled URLs of a class, the models are uniform or one-sided and the threshold is 0.  URLs are read whole,
    however long; repeated rows and null ids are rows like any other; equal thresholds go to the one next to 0; an empty
    table gives an empty result; other columns are not read.
    """
    work = work or Workspace(pages.sparkSession, "urls")
    host, path = url_parts(F.col(url))
    at = F.locate("://", F.col(url))
    rest = F.coalesce(F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise(F.col(url)), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("holds", F.conv(F.substring(F.md5("rest"), 1, 2), 16, 10).cast("int") % 5 == 0)
    rows = work.write(rows, "rows")
    # Few bytes of distinct URLs become many grams: they are dealt out before that, by number, which coalescing leaves alone.
    spread = lambda df: df.repartition(partitions(pages.sparkSession), "rest")
    training = rows.where("given is not null and not holds").groupBy("rest", (F.col("given") == "allow").cast("long").alias("yes")).agg(F.count("*").alias("n"))
    counted = spread(training).select(_grams("rest").alias("gram"), "yes", "n").groupBy("gram").agg(F.sum(F.col("yes") * F.col("n")).alias("accepted"), F.sum((1 - F.col("yes")) * F.col("n")).alias("rejected"))
    texts = rows.where("given is null or holds").select("rest").distinct()
    grams = work.write(spread(texts).select("rest", _grams("rest").alias("gram")).groupBy("rest", "gram").agg(F.count("*").alias("times")), "grams")
    ratios = work.write(log_ratios(grams, counted, work), "ratios")
    scores = grams.join(ratios, "gram").groupBy("rest").agg((F.sum(F.round(F.col("ratio"), 9) * F.col("times")) / F.sum("times")).alias("score"))
    scores = work.write(scores.withColumn("score", F.round("score", 6)), "scores")
    judged = work.write(rows.join(scores, "rest", "left"), "judged")
    limit = threshold(judged.where("given is not null and holds").select("score", (F.col("given") == "allow").alias("accepted")))
    assert math.isfinite(limit)
    own = F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score")
