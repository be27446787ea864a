"""Queries of mixtures built from dataset directories: one robot with a clutch, one with terminal frames, one with neither."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.schema import RAW_ENGAGED, RAW_LINKED, ActionSpec, ModalitySpec, Registry, Representation
from kinetrace.sources import experiment, factory, lerobot, sinks
from kinetrace.sources.storage import shared_folder

from .registry import query, r6
from .views import EVENTS, events

_OFFSETS = {"clutch": (0, 2, 4), "terminal": (1, 2, 3), "plain": (0, 1, 2, 3)}
_TAGS = {"clutch": "cmr_versius", "terminal": "ucsd_dvrk", "plain": "ucb_dvrk"}


def _registry() -> Registry:
    own = Registry()
    for name, tag in _TAGS.items():
        own.register(tag, {"state": ModalitySpec(("arm",)), "action": ModalitySpec(("arm",), _OFFSETS[name], (ActionSpec(Representation.RELATIVE),))})
    return own


def _written(spark: SparkSession, sf: str) -> dict[str, str]:
    """Name -> path of three datasets: episodes by their number modulo 3."""
    df, out = events(spark, sf), {}
    for i, name in enumerate(_OFFSETS):
        root = f"{shared_folder(spark)}/mixture-{uuid.uuid4().hex[:12]}/{name}"
        raw = [F.lit(0.0)] * 22
        raw[0], raw[RAW_ENGAGED["left"]], raw[RAW_ENGAGED["right"]] = F.col("value"), F.col("engaged").cast("double"), (F.col("kind") == "purchase").cast("double")
        raw[RAW_LINKED["left"]], raw[RAW_LINKED["right"]] = F.col("linked").cast("double"), F.floor(F.col("k") / 80).cast("double")
        own = df.where(F.col("episode") % 3 == i)
        frames = own.select(F.array(*raw).alias("observation.state"), F.array(F.col("value") * 2).alias("action"), F.col("frame").alias("frame_index"), F.col("episode").alias("episode_index"), F.lit(0).cast("long").alias("task_index"), F.col("done").alias("next.done"))
        features = {"observation.state": {"dtype": "float64", "shape": [22]}, "action": {"dtype": "float64", "shape": [1]}} | ({"next.done": {"dtype": "bool", "shape": [1]}} if name == "terminal" else {})
        keys = {"arm": {"start": 0, "end": 1}} | ({"hapticengaged_left": {"start": 16, "end": 17}, "hapticengaged_right": {"start": 17, "end": 18}} if name == "clutch" else {})
        info = {"chunks_size": 100, "data_path": "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", "features": features, "splits": {"held": "30:59"}}
        episodes = frames.groupBy("episode_index").agg(F.array(F.lit("go")).alias("tasks"), F.count("*").alias("length"))
        sinks.write_dataset(frames, episodes, spark.createDataFrame([(0, "go")], "task_index long, task string"), info, {"state": keys, "action": {"arm": {"start": 0, "end": 1}}}, root)
        out[name] = root
    return out


#: Anchors of the three datasets; episodes of the split "held" are left out.
_ANCHORS = """
o AS (SELECT *, kind = 'purchase' AS other, k // 80 AS l2 FROM ep WHERE episode NOT BETWEEN 30 AND 59),
x AS (SELECT *, min(CASE WHEN done THEN frame END) OVER (PARTITION BY episode) AS first,
    [lead(linked, 0) OVER w, lead(linked, 2) OVER w, lead(linked, 4) OVER w] AS la, [lead(l2, 0) OVER w, lead(l2, 2) OVER w, lead(l2, 4) OVER w] AS lb,
    [lead(engaged OR other, 0) OVER w, lead(engaged OR other, 2) OVER w, lead(engaged OR other, 4) OVER w] AS es
  FROM o WINDOW w AS (PARTITION BY episode ORDER BY frame)),
an AS (SELECT 'clutch' AS dataset, episode, frame, value FROM x WHERE episode % 3 = 0 AND frame + 4 < length AND len(list_distinct(la)) = 1 AND len(list_distinct(lb)) = 1 AND list_contains(es, true)
  UNION ALL SELECT 'terminal', episode, frame, value FROM x WHERE episode % 3 = 1 AND frame + 3 < length AND (first IS NULL OR frame + 3 < first)
  UNION ALL SELECT 'plain', episode, frame, value FROM x WHERE episode % 3 = 2 AND frame + 3 < length)"""


@query("SELECT dataset, nullif(dataset, 'plain') AS filter, episode, frame FROM an", EVENTS, _ANCHORS)
def mixture_anchors(spark, sf) -> DataFrame:
    """The anchors that a factory's shards hold: each dataset's own filter has been at work."""
    paths = _written(spark, sf)
    groups = [{"paths": [path], "tag": _TAGS[name], "mix_ratio": 1.0, "exclude_splits": ["held"]} for name, path in paths.items()]
    mixture = factory.build(spark, experiment.from_dict({"datasets": groups, "shard_size": 256, "sampling_rate": 0.2}), _registry())
    kinds = {r.dataset: r["filter"] for r in mixture.datasets.collect()}
    parts = [mixture.plans[path].where("shard is not null").select(F.lit(name).alias("dataset"), F.lit(kinds[path]).cast("string").alias("filter"), "episode", "frame") for name, path in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
d(dataset, t, d) AS (VALUES ('clutch', 0, 0), ('clutch', 1, 2), ('clutch', 2, 4), ('terminal', 0, 1), ('terminal', 1, 2), ('terminal', 2, 3), ('plain', 0, 0), ('plain', 1, 1), ('plain', 2, 2), ('plain', 3, 3)),
l AS (SELECT an.dataset, 'state' AS part, 0 AS t, an.value AS x FROM an
  UNION ALL SELECT an.dataset, 'action', d.t, b.value * 2 FROM an JOIN d ON d.dataset = an.dataset JOIN ep b ON b.episode = an.episode AND b.frame = an.frame + d.d
  UNION ALL SELECT an.dataset, 'relative_action', d.t, b.value * 2 - an.value FROM an JOIN d ON d.dataset = an.dataset JOIN ep b ON b.episode = an.episode AND b.frame = an.frame + d.d)
----SELECT dataset, part, CAST(t AS INTEGER) AS t, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.98), 6) AS q98 FROM l GROUP BY ALL
""", EVENTS, _ANCHORS)
def mixture_statistics(spark, sf) -> DataFrame:
    """What each dataset adds to a mixture's statistics: those of its filtered anchors."""
    known, rows = _registry(), []
    for name, path in _written(spark, sf).items():
        data = lerobot.TrajectoryDataset(spark, path)
        made = factory.temporal(data, known.specs[_TAGS[name]], _TAGS[name], factory.chosen(data, [], ["held"]))
        for part, own in made.items():
            steps = [own["arm"]] if part == "state" else [{n: v[t] for n, v in own["arm"].items()} for t in range(len(own["arm"]["mean"]))]
            rows += [(name, part, t, *[float(s[n][0]) for n in ("mean", "std", "q01", "q98")]) for t, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "dataset string, part string, t int, mean double, std double, q01 double, q98 double")
    return df.select("dataset", "part", "t", *[r6(c).alias(c) for c in ("mean", "std", "q01", "q98")])
