"""Cross-checks of configurations: the leaves of many JSON files as rows, and rules between them judged in one pass.

A rule compares what stands at one pattern of places with what stands at another, or with fixed values.  Places are written
``file:path.of.keys[index]``.  In patterns ``*`` stands for one name or index, ``**`` for anything, and ``{name}`` for a name
that both sides share: the rule is judged for each of its values.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a rule may ask of the left side's values: given the right side's, or fixed ones.
KINDS = ("equal", "at_most", "between", "one_of", "refers", "sum", "count", "finite", "present")


@dataclass(frozen=True)
class Rule:
    """equal: every left value is the right one (or the one of ``values``).  at_most: no number exceeds the least right one (or
    ``high``).  between: numbers lie within low and high.  one_of: values are some of ``values``.  refers: values occur on the
    right.  sum: numbers add up to the right's (or ``high``).  count: as many as the right number says (or ``high``).
    finite: numbers are finite.  present: there is a value."""

    name: str
    kind: str
    left: str
    right: str | None = None
    values: tuple[str, ...] = ()
    low: float = -math.inf
    high: float = math.inf

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is no kind of rule")
        if self.kind == "refers" and self.right is None:
            raise ValueError(f"{self.name} refers to nothing")
        if self.right is not None and (own := names_of(self.right)) and own != names_of(self.left):
            raise ValueError(f"the sides of {self.name} share no {sorted(set(own) ^ set(names_of(self.left)))}")


def names_of(pattern: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", pattern)))


def regex_of(pattern: str) -> str:
    """A pattern of places as a regular expression, its names as named groups, a repeated name as a reference to the first."""
    out, seen = "", set()
    for piece in re.split(r"(\{\w+\}|\*\*|\*)", pattern):
        if piece == "**":
            out += ".*"
        elif piece == "*":
            out += r"[^.\[\]:/]+"
        elif piece.startswith("{"):
            name = piece[1:-1]
            out += rf"\k<{name}>" if name in seen else rf"(?<{name}>[^.\[\]:/]+)"
            seen.add(name)
        else:
            out += re.sub(r"([^\w/])", r"\\\1", piece)
    return f"^{out}$"


def leaves(value, at: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of a JSON value's leaves; empty objects and lists have none."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{at}.{k}" if at else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{at}[{i}]")
    else:
        yield at, value


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, values, numbers = [], [], []
        for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for path, value in leaves(json.loads(body)):
                places.append(f"{file}:{path}")
                values.append(value if isinstance(value, str) else None if value is None else json.dumps(value))
                numbers.append(float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(values, pa.string()), pa.array(numbers, pa.float64())], names=["place", "value", "number"])


def facts(files: DataFrame, name: str = "file", body: str = "body") -> DataFrame:
    """place, value (as text), number of every leaf of JSON files, one a row."""
    return files.select(name, body).mapInArrow(_flattened, "place string, value string, number double")


def read_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """file (its path below root, without .json) and body of all files of a folder tree."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    bare = re.sub(r"^\w+:/*(?=/)", "", root.rstrip("/")) + "/"
    at = F.col("_metadata.file_path")
    below = F.regexp_replace(F.substring(at, F.locate(bare, at) + len(bare), F.length(at)), r"\.json$", "")
    return df.select(below.alias("file"), F.col("value").alias("body"))


def _marks(rule: int, side: str, pattern: str) -> Column:
    names, regex = names_of(pattern), regex_of(pattern)
    order = re.findall(r"\(\?<(\w+)>", regex)
    found = [F.regexp_extract("place", regex, order.index(n) + 1) for n in names]
    key = F.to_json(F.struct(*[c.alias(n) for c, n in zip(found, names, strict=True)])) if names else F.lit("{}")
    return F.when(F.col("place").rlike(regex), F.struct(F.lit(rule).alias("rule"), F.lit(side).alias("side"), key.alias("key"), F.lit(bool(names) or side == "left").alias("own")))


def judged(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, key, passed, checked, evidence: every rule for each of its keys.

    Facts are read once: each is marked with the rules whose sides it meets, values of a rule and key are counted, and rules are
    judged on sums over them.  A right side without names holds for all keys.  A rule whose left side nothing meets fails with
    nothing checked.  The evidence is what the sides came to, and for values that are wrong one by one, the first place.
    """
    marks = [m for i, r in enumerate(rules) for m in (_marks(i, "left", r.left), *([_marks(i, "right", r.right)] if r.right else []))]
    met = facts.select("*", F.explode(F.array_compact(F.array(*marks))).alias("m")).select("place", "value", "number", "m.*")
    left, right = F.col("side") == "left", F.col("side") == "right"
    by_value = met.groupBy("rule", "key", "own", "value", "number").agg(F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.min(F.when(left, F.col("place"))).alias("place"))

    # Right sides that hold for all keys: their values, and what they amount to, a row a rule.
    shared = by_value.where(~F.col("own"))
    known = shared.select(F.col("rule").alias("rule_"), F.col("value").alias("value_")).distinct().withColumn("known", F.lit(True))
    wide = shared.groupBy(F.col("rule").alias("rule_s")).agg(F.sum("r").alias("rn_s"), F.sum(F.col("number") * F.col("r")).alias("rsum_s"), F.min("number").alias("rmin_s"), F.min("value").alias("rfirst_s"), F.max("value").alias("rlast_s"))
    own = by_value.where("own").join(known, (F.col("rule") == F.col("rule_")) & F.col("value").eqNullSafe(F.col("value_")), "left").drop("rule_", "value_")

    def wrong_alone(i: int, rule: Rule) -> Column:
        fine = {
            "between": F.col("number").between(rule.low, rule.high) & ~F.isnan("number"),
            "one_of": F.col("value").isin(*rule.values),
            "refers": (F.col("r") > 0) | F.col("known"),
            "finite": F.col("number").isNotNull() & ~F.isnan("number") & (F.abs("number") != math.inf),
            "present": F.col("value").isNotNull(),
            "equal": F.col("value").isin(*rule.values) if rule.right is None else F.lit(True),
            "at_most": F.col("number") <= rule.high if rule.right is None else F.lit(True),
        }.get(rule.kind, F.lit(True))
        return (F.col("rule") == i) & (F.col("l") > 0) & ~F.coalesce(fine, F.lit(False))

    alone = F.lit(False)
    for i, rule in enumerate(rules):
        alone = alone | wrong_alone(i, rule)
    l, r = F.col("l"), F.col("r")
    sums = own.withColumn("wrong", alone).groupBy("rule", "key").agg(
        F.sum("l").alias("ln"), F.sum(F.col("number") * l).alias("lsum"), F.max(F.when(l > 0, F.col("number"))).alias("lmax"), F.min(F.when(l > 0, F.col("value"))).alias("lfirst"), F.max(F.when(l > 0, F.col("value"))).alias("llast"),
        F.sum("r").alias("rn"), F.sum(F.col("number") * r).alias("rsum"), F.min(F.when(r > 0, F.col("number"))).alias("rmin"), F.min(F.when(r > 0, F.col("value"))).alias("rfirst"), F.max(F.when(r > 0, F.col("value"))).alias("rlast"),
        F.min(F.when(F.col("wrong"), F.struct("place", "value"))).alias("first"),
    )
    sums = sums.join(wide, F.col("rule") == F.col("rule_s"), "left")
    given = lambda n: F.when(F.col("rn") > 0, F.col(n)).otherwise(F.col(f"{n}_s"))
    named = facts.sparkSession.createDataFrame([(i, rule.name, rule.kind, rule.right is not None, float(rule.high)) for i, rule in enumerate(rules)], "rule_n int, name string, kind string, sided boolean, high double")
    out = named.join(sums, F.col("rule_n") == F.col("rule"), "left")
    number = F.when(F.col("sided"), given("rsum")).otherwise(F.col("high"))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))
    together = (
        F.when((F.col("kind") == "equal") & F.col("sided"), (F.col("lfirst") == given("rfirst")) & (F.col("llast") == given("rlast")) & (given("rfirst") == given("rlast")))
        .when((F.col("kind") == "at_most") & F.col("sided"), F.col("lmax") <= given("rmin"))
        .when(F.col("kind") == "sum", near(F.col("lsum"), number))
        .when(F.col("kind") == "count", near(F.col("ln").cast("double"), number))
        .otherwise(F.lit(True))
    )
    checked = F.coalesce("ln", F.lit(0).cast("long"))
    passed = (checked > 0) & F.col("first").isNull() & F.coalesce(together, F.lit(False))
    side = lambda n, total, a, b: F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(" values"), F.coalesce(F.concat(F.lit(", sum "), total.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", "), a, F.lit(" to "), b), F.lit("")))
    evidence = F.when(F.col("first").isNotNull(), F.concat(F.col("first.place"), F.lit(" is "), F.coalesce("first.value", F.lit("null")))).otherwise(
        F.concat_ws("; right: ", side(F.col("ln"), F.col("lsum"), F.col("lfirst"), F.col("llast")), F.when(F.col("sided"), side(given("rn"), given("rsum"), given("rfirst"), given("rlast"))))
    )
    return out.select(F.col("name").alias("rule"), F.coalesce("key", F.lit("{}")).alias("key"), passed.alias("passed"), checked.alias("checked"), evidence.alias("evidence"))
