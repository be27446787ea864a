"""Queries that check declarations, derived from the events, against one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.operators.constraints import Rule, facts, judged

from .registry import query
from .views import EVENTS, events

RULES = (
    Rule("counts add up to the length", "sum", "episodes/{id}:counts.*", "episodes/{id}:length"),
    Rule("kinds are known", "refers", "episodes/{id}:kinds[*]", "catalogue:kinds[*]"),
    Rule("as many counts as kinds", "count", "episodes/{id}:counts.*", "episodes/{id}:n_kinds"),
    Rule("means are no more than the top", "at_most", "episodes/{id}:stats.*.mean", "episodes/{id}:stats.top"),
    Rule("lengths are in range", "between", "episodes/{id}:length", low=60, high=75),
    Rule("statistics are finite", "finite", "episodes/{id}:stats.**"),
    Rule("version", "equal", "episodes/{id}:version", "catalogue:version"),
    Rule("first kind", "one_of", "episodes/{id}:kinds[0]", values=("add_to_cart", "click")),
)


@query("""
k AS (SELECT episode, kind, count(*) AS n, avg(k) AS m FROM ep GROUP BY ALL),
e AS (SELECT episode, sum(n) AS length, count(*) AS kinds, max(m) AS top, min(kind) AS first FROM k GROUP BY episode),
r AS (SELECT 'counts add up to the length' AS rule, episode, true AS passed, kinds AS checked FROM e UNION ALL SELECT 'kinds are known', e.episode, bool_and(kind <> 'purchase'), count(*) FROM e JOIN k ON k.episode = e.episode GROUP BY e.episode
  UNION ALL SELECT 'as many counts as kinds', episode, true, kinds FROM e UNION ALL SELECT 'means are no more than the top', episode, top <= 50, kinds FROM e
  UNION ALL SELECT 'lengths are in range', episode, length BETWEEN 60 AND 75, 1 FROM e UNION ALL SELECT 'statistics are finite', episode, true, kinds + 1 FROM e
  UNION ALL SELECT 'version', episode, episode % 10 <> 3, 1 FROM e UNION ALL SELECT 'first kind', episode, first IN ('add_to_cart', 'click'), 1 FROM e)
----SELECT rule, '{"id":"' || episode || '"}' AS key, passed, CAST(checked AS BIGINT) AS checked FROM r
""", EVENTS)
def declaration_audit(spark, sf) -> DataFrame:
    """A file an episode and a catalogue, with faults: a kind that the catalogue lacks, versions, lengths, means above the top."""
    df = events(spark, sf)
    each = df.groupBy("episode", "kind").agg(F.count("*").alias("n"), F.avg("k").alias("m")).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("kind", "n", "m"))).alias("k"), F.sum("n").alias("length"))
    body = F.struct(
        F.col("length"), F.transform("k", lambda x: x["kind"]).alias("kinds"), F.map_from_entries(F.transform("k", lambda x: F.struct(x["kind"], x["n"]))).alias("counts"), F.size("k").alias("n_kinds"),
        F.when(F.col("episode") % 10 == 3, "v2").otherwise("v1").alias("version"),
    )
    stats = F.concat(F.lit('{"top": 50.0'), F.concat_ws("", F.transform("k", lambda x: F.concat(F.lit(', "'), x["kind"], F.lit('": '), F.to_json(F.struct(x["m"].alias("mean")))))), F.lit("}"))
    text = F.concat(F.expr("substr(b, 1, length(b) - 1)"), F.lit(', "stats": '), F.col("s"), F.lit("}"))
    files = each.select(F.concat(F.lit("episodes/"), F.col("episode").cast("string")).alias("file"), F.to_json(body).alias("b"), stats.alias("s")).select("file", text.alias("body"))
    catalogue = df.where("kind <> 'purchase'").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).select(F.lit("catalogue").alias("file"), F.to_json(F.struct("kinds", F.lit("v1").alias("version"))).alias("body"))
    return judged(facts(files.unionByName(catalogue)), RULES).drop("evidence")
