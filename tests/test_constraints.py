"""Rules over several JSON files: each kind held, broken, and without anything to hold."""

import json
import re

import pytest

from kinetrace.operators.constraints import Rule, facts, judged, leaves, read_files, regex_of

FILES = {
    "model": {"horizon": 16, "dims": 7, "tags": ["a", "b"], "class": "P"},
    "robots/a/config": {"action": {"offsets": [0, 1, 2], "keys": ["x", "y"], "sizes": {"x": 3, "y": 4}}, "state": {"keys": ["x", "y"]}, "mean": [0.5, 1.5], "rep": "RELATIVE"},
    "robots/b/config": {"action": {"offsets": list(range(20)), "keys": ["x"], "sizes": {"x": 3, "y": 5}}, "state": {"keys": ["y"]}, "mean": [0.5, float("nan")], "rep": "sideways", "none": None},
    "robots/c/config": {"action": {"keys": [], "sizes": {}}, "state": {"keys": ["x"]}, "mean": [], "rep": None},
}
RULES = [
    Rule("horizon", "at_most", "robots/{tag}/config:action.offsets[*]", "model:horizon"),
    Rule("dims", "sum", "robots/{tag}/config:action.sizes.*", "model:dims"),
    Rule("keys", "refers", "robots/{tag}/config:action.keys[*]", "robots/{tag}/config:state.keys[*]"),
    Rule("same first", "equal", "robots/{tag}/config:action.keys[0]", "robots/{tag}/config:state.keys[0]"),
    Rule("finite", "finite", "robots/{tag}/config:**mean[*]"),
    Rule("forms", "one_of", "robots/{tag}/config:rep", values=("RELATIVE", "ABSOLUTE")),
    Rule("class", "equal", "model:class", values=("P",)),
    Rule("tags", "count", "model:tags[*]", high=3),
    Rule("spread", "between", "robots/{tag}/config:action.sizes.*", low=3, high=4),
    Rule("there", "present", "model:nothing"),
    Rule("no null", "present", "robots/{tag}/config:none"),
]


def verdicts(spark, files, rules):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in files.items()], "file string, body string").repartition(3)
    return {(r.rule, json.loads(r.key).get("tag")): r for r in judged(facts(df), rules).collect()}


def test_rules(spark):
    got = verdicts(spark, FILES, RULES)
    want = {
        ("horizon", "a"): True, ("horizon", "b"): False, ("dims", "a"): True, ("dims", "b"): False, ("keys", "a"): True, ("keys", "b"): False, ("keys", "c"): False,
        ("same first", "a"): True, ("same first", "b"): False, ("same first", "c"): False, ("finite", "a"): True, ("finite", "b"): False, ("forms", "a"): True, ("forms", "b"): False, ("forms", "c"): False,
        ("class", None): True, ("tags", None): False, ("spread", "a"): True, ("spread", "b"): False, ("there", None): False, ("no null", "b"): False,
    }
    assert {k: r.passed for k, r in got.items()} == want
    assert got["spread", "b"].evidence == "robots/b/config:action.sizes.y is 5" and got["finite", "b"].evidence.startswith("robots/b/config:mean[1]")
    assert got["dims", "b"].evidence == "2 values, sum 8.0, 3 to 5; right: 1 values, sum 7.0, 7 to 7" and got["tags", None].checked == 2
    assert got["keys", "c"].checked == got["there", None].checked == 0
    assert set(verdicts(spark, {}, RULES[:1])) == {("horizon", None)}


def test_files_of_a_folder(spark, tmp_path):
    for name, value in FILES.items():
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"c/{name}.json").write_text(json.dumps(value, indent=2))
    assert {r.file for r in read_files(spark, f"{tmp_path}/c").collect()} == set(FILES)
    assert judged(facts(read_files(spark, f"{tmp_path}/c")), RULES).where("passed").count() == 8


def test_patterns():
    regex = regex_of("a/{x}:b.{x}[*].**")
    python = re.compile(regex.replace("(?<", "(?P<").replace(r"\k<x>", "(?P=x)"))
    assert python.match("a/q:b.q[3].deep.er[0]") and not python.match("a/q:b.r[3].deep") and not python.match("a/q/r:b.q[3].d")
    assert dict(leaves({"a": [1, {"b": None}], "c": {}})) == {"a[0]": 1, "a[1].b": None}
    for bad in (dict(kind="odd", left="x"), dict(kind="refers", left="x"), dict(kind="sum", left="{a}:x", right="{b}:y")):
        with pytest.raises(ValueError):
            Rule("bad", **bad)
