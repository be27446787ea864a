"""Language identification and toxicity: held-out accuracy, restoration and edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrace.llm.langid import EVIDENCE, LETTERS, LanguageModel, Predictor, grams, identify, letter_runs
from kinetrace.llm.queries import op8_language_id
from kinetrace.llm.toxicity import _A, CharModel, Restorer, _char_counts, drop_toxic, fold, toxicity_scores

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(4000).cache()


def test_language_accuracy(spark, docs):
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.98 and 0 <= r.lo <= r.hi <= 1


def test_language_edges(spark):
    rows = [(1, "the the and", "en", 0), (2, "der die das", "de", 0), (3, None, "en", 0), (4, "123 !!", "en", 0), (None, "the and", None, 0), (6, "", "de", 0), (7, "the " * 50_000, None, 0), (7, "the " * 50_000, None, 0)]
    got = identify(spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, score int")).collect()
    assert len(got) == 24
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(3, "und"), (4, "und"), (6, "und"), (7, "en"), (None, "en")} <= by
    none = identify(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).first()
    assert none.lang_pred == "und" and none.score == 0.0
    assert identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def brute_languages(rows):
    """op8 by plain counting: fit on rows with a language that aren't held out, then word first, longest n-gram else."""
    words = lambda text: re.findall(r"[a-zäöüñéß]+", text.lower())  # noqa: E731  the fixture's letters
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    langs = sorted({lang for i, text, lang in rows if lang is not None and text is not None and words(text) and not held(i)})
    counts = [{}, {}]
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            for word in words(text):
                for kind, units in ((0, [word]), (1, grams(word))):
                    for u in units:
                        counts[kind].setdefault(u, dict.fromkeys(langs, 0))[lang] += 1
    totals = [{lang: sum(c[lang] for c in own.values()) for lang in langs} for own in counts]
    kept = [{u: c for u, c in own.items() if sum(c.values()) > 1} for own in counts]
    log = lambda kind, u: np.array([math.log((kept[kind][u][x] + 0.5) / (totals[kind][x] + 0.5 * len(kept[kind]) + 1)) for x in langs])
    out = []
    for i, text, _ in rows:
        tokens = [w for t in (text or "").split() if (w := words(t))]
        total = np.zeros(len(langs))
        for parts in tokens:
            found = []
            for word in parts:
                if word in kept[0]:
                    found.append(log(0, word))
                    continue
                framed = f"^{word}$"
                for a in range(len(framed)):
                    best = next((framed[a : a + k] for k in range(4, 0, -1) if framed[a : a + k] in kept[1]), None)
                    found.append(log(1, best) if best else np.array([math.log(0.5 / (totals[1][x] + 1)) for x in langs]))
            total += sum(found) * max(2.0, len(found) / LETTERS) / max(2.0, len(found))
        if not tokens or not langs:
            out.append((i, held(i), "und", 0.0))
            continue
        total *= min(1.0, EVIDENCE / len(tokens))
        p = np.exp(total - total.max())
        out.append((i, held(i), langs[int(total.argmax())], float(p.max() / p.sum())))
    return sorted(out, key=str)


def test_languages_of_a_table_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    own = {"en": ["the", "and", "house", "running", "with"], "de": ["der", "und", "häuser", "laufend", "mit"], "es": ["el", "y", "año", "corriendo", "con"]}
    rows = [(i, " ".join(rng.choice(own[lang]) + rng.choice(["", "", ",", "s", "-x", "7"]) for _ in range(rng.randrange(1, 60))), lang) for i in range(80) for lang in [rng.choice(list(own))]]
    rows += [(900 + i, f"unseen{w} {w}", None) for i, w in enumerate(("housing", "läufer", "años", "zzz"))] + [(None, "the house", "en"), (5000, "", "de"), (5001, None, "en"), (5002, "12 !", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op8_language_id(spark, str(tmp_path)).collect()), key=str)
    for (i, held, lang, score), want in zip(got, brute_languages(rows), strict=True):
        assert (i, held, lang) == want[:3] and score == pytest.approx(want[3], abs=1e-4)


def test_numerals_are_no_letters(spark):
    assert letter_runs("½ ② ² a½b ⅷx é") == ["a", "b", "x", "é"]
    rows = [(1, "the and", "en"), (2, "der und", "de"), (3, "½ ② ²", None), (4, "the½", None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")).collect()}
    assert (got[3].lang_pred, got[3].score) == ("und", 0.0) and got[4].lang_pred == "en"


def test_toxicity_accuracy(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out")
    hit = {(r.toxic, r.predicted): r.n for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    right, wrong = hit.get((1, 1), 0), hit.get((1, 0), 0)
    # About a sixth of the toxic labels stand on texts without any toxic word.
    assert right > 3 * wrong and hit.get((0, 1), 0) <= 0.01 * hit[0, 0]


def counted(texts):
    total = np.zeros(_A**4, np.int64)
    for b in _char_counts([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]):
        total[b.column(0).to_numpy()] += b.column(1).to_numpy()
    return total


@pytest.fixture(scope="module")
def restorer(docs):
    return Restorer(CharModel(counted([r.text for r in docs.select("text").collect()])))


def test_restoration(restorer):
    r = restorer
    for token, want in {"1d10t": "idiot", "tr@sh": "trash", "stuuupid": "stupid", "i.d.i.o.t": "idiot", "m0r0n,": "moron", "$cum": "scum", "cl0wn": "clown", "hello": "hello", "be%%%": "be"}.items():
        assert r.text(token) == [want], token
    assert "idiot" in r.text("you i d i o t") and r.text("a a a a") == ["a"] * 4


def test_letters_set_apart(restorer):
    r = restorer
    for token, want in {"m.0.r.0.n": "moron", "i.d.1.o.t": "idiot", "i_d_i_o_t": "idiot", "m!0!r!0!n": "moron", "st" + "u" * 30 + "pid": "stupid", "$.c.u.m,": "scum"}.items():
        assert r.text(token) == [want], token
    for text, want in {"you are a m o r o n": "moron", "a m . o . r . o . n": "moron", "so m  o  r  o  n": "moron", "i _ d _ i _ o _ t": "idiot", "you i - d 1 . o   t": "idiot", "y o u i d i o t": "idiot", "such a m 0 r 0 n, you": "moron", "y o u a r e s u c h a b i g m o r o n a n d a n i d i o t": "idiot"}.items():
        assert want in r.text(text), (text, r.text(text))
    assert r.text("1.0.5") == ["1.0.5"] and r.text("x" * 200) != [""]
    assert len(r.decode("ab1d" * 20_000, breaks=True)) >= 60_000


def test_viterbi_equals_enumeration(restorer):
    """The decoded word is the cheapest of all that the lattice spells, by model and channel together."""

    def cost(letters, channel):
        a = b = c = 0
        for x in [*letters, " "]:
            d = fold(x)
            channel -= float(restorer.log[a, b, c, d])
            a, b, c = b, c, d
        return channel

    for word in ("1d10t", "b00k", "aa11", "4+7", "s0oo", "é1a", "x!y", "5ß0"):
        for breaks in (False, True):
            lattice = restorer.lattice(word)
            paths = itertools.product(*(restorer.with_breaks(lattice) if breaks else lattice))
            best = min(cost("".join(t for t, _ in path), sum(k for _, k in path)) for path in paths)
            got = restorer.decode(word, breaks)
            spelled = [sum(k for _, k in path) for path in itertools.product(*(restorer.with_breaks(lattice) if breaks else lattice)) if "".join(t for t, _ in path) == got]
            assert abs(cost(got, min(spelled)) - best) < 1e-4, (word, breaks, got)


def test_characters_fold_alike_in_bytes_and_text():
    texts = ["Ünï çode", "жизнь мир", "中文字 ab", "a—b “c” …", "x" * 5, ""]
    want = {}
    for t in texts:
        codes = [fold(c.lower()) for c in t]
        codes = [c for i, c in enumerate(codes) if c or not i or codes[i - 1]]
        for i in range(len(codes) - 3):
            key = ((codes[i] * _A + codes[i + 1]) * _A + codes[i + 2]) * _A + codes[i + 3]
            want[key] = want.get(key, 0) + 1
    got = np.zeros(_A**4, np.int64)
    for t in texts:
        got += counted([t])
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want


def test_spread_letters_take_linear_time(restorer):
    import time

    began = time.perf_counter()
    restorer.text("! " * 20_000 + "x. " * 2_000 + "a" + "!" * 20_000 + "b")
    assert time.perf_counter() - began < 20


def test_language_equals_brute_force():
    """Evidence of a text, word by word and n-gram by n-gram."""
    words = {"the": np.array([9.0, 1]), "der": np.array([0.0, 8])}
    pieces = {g: np.array([i % 3 + 1.0, i % 5 + 0.0]) for i, g in enumerate(sorted({g for w in ("there", "wieder", "thing") for g in grams(w)}))}
    totals = np.array([[50.0, 40], [300.0, 200]])
    model = LanguageModel(["a", "b"], words, pieces, totals)

    def row(table, unit, kind):
        return np.log((table[unit] + 0.5) / (totals[kind] + 0.5 * len(table) + 1))

    def evidence(word):
        if word in words:
            return row(words, word, 0)
        text, out = f"^{word}$", []
        for i in range(len(text)):
            hit = next((text[i : i + k] for k in (4, 3, 2, 1) if text[i : i + k] in pieces), None)
            out.append(row(pieces, hit, 1) if hit else np.log(0.5 / (totals[1] + 1)))
        return sum(out) * max(2.0, len(out) / LETTERS) / max(2.0, len(out))

    for text in ("The der thing", "wieder, there!", "qqq x " * 40, "therewiederthing" * 50 + "q", "the " * 30):
        parts = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        total = sum(evidence(w) for w in parts) * min(1.0, 25 / len(text.split()))
        lang, score = Predictor(model).predict(text)
        p = np.exp(total - total.max())
        assert lang == "ab"[int(np.argmax(total))] and abs(score - p.max() / p.sum()) < 1e-4, text


def test_a_text_without_blanks_is_read_to_its_end(spark):
    rows = [(i, "der die und ist nicht auch ein", "de") for i in range(1, 30)] + [(100 + i, "the and that with from this", "en") for i in range(1, 30)]
    texts = [(1000, "qx" * 40 + "dieundistnichtauchein" * 300), (1001, "qx" * 40 + "theandthatwithfromthis" * 300)]
    got = identify(spark.createDataFrame(rows + [(i, t, None) for i, t in texts], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in got.where("doc_id >= 1000").collect()} == {1000: "de", 1001: "en"}


def test_toxicity_edges(spark):
    rows = [(i if i < 60 else 1000 + i, f"{['clean words', 'you', 'such', ''][i % 4]} number {i} here", "x", 1) for i in range(240)] + [(100 + i, f"you {i} idiot" if i % 2 else f"such {i} moron words", "x", 1) for i in range(60)] + [(None, "you 1d10t idiot", "x", 1), (300, None, "x", 1), (301, "", "x", 1), (302, "fine " * 100_000, "x", 1), (303, "such 1d10t", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(i if i < 60 else 1000 + i, 0) for i in range(240)] + [(100 + i, 1) for i in range(60)] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(df, labels).collect()}
    assert len(got) == 305
    assert got[100].predicted == 1 and got[None].predicted == 1 and got[303].predicted == 1
    assert not any(got[i].predicted for i in (0, 5, 300, 301, 302))
    kept = drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60)) | set(range(1060, 1240)) | {300, 301, 302}
    assert toxicity_scores(df.limit(0), labels).collect() == []
    assert {r.score for r in toxicity_scores(df, labels.limit(0)).collect()} == {0.5}


def test_toxicity_where_all_toxic_rows_are_one_sentence(spark):
    rows = [(i, f"clean words number {i} here", "x", 1) for i in range(60)] + [(100 + i, f"you are an idiot and a moron {i}", "x", 1) for i in range(60)] + [(None, "you 1d10t idiot", "x", 1), (300, None, "x", 1), (301, "", "x", 1), (302, "fine " * 100_000, "x", 1), (303, "such an 1d10t", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score int")
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(df, labels).collect()}
    # The sentence's words share its weight, so a part of it ranks above clean texts, but needn't pass 0.5.
    assert all(got[i].predicted for i in range(100, 160))
    assert not any(got[i].predicted for i in (*range(60), 300, 301, 302))
    assert min(got[None].score, got[303].score) > max(got[i].score for i in (*range(60), 300, 301, 302))


def brute_toxicity(rows, labels):
    """op10 by plain counting: features of restored words, their information on the label, a dense logistic regression."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    restorer = Restorer(CharModel(counted([t or "" for _, t in rows])))
    marks = {}
    for i, x in labels:
        if i is not None and x is not None and not held(i):
            marks[i] = max(x, marks.get(i, 0))
    found = [{f for w in restorer.text(t or "") if w for f in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k))} for _, t in rows]
    sample = [(f, marks[i]) for (i, _), f in zip(rows, found, strict=True) if i in marks]
    n = [sum(x == y for _, y in sample) for x in (0, 1)]
    kept = []
    for feature in sorted(set().union(*found)):
        c = [sum(feature in f and x == y for f, y in sample) for x in (0, 1)]
        if not c[1]:
            continue
        cells = [(c[x], n[x], sum(c)) for x in (0, 1)] + [(n[x] - c[x], n[x], sum(n) - sum(c)) for x in (0, 1)]
        if sum(k * math.log(k * sum(n) / (m * total)) for k, m, total in cells if k) >= 7.5:
            kept.append(feature)
    x = np.array([[f in own for f in kept] + [True] for own, _ in sample], float)
    y = np.array([mark for _, mark in sample], float)
    w, m, v = np.zeros(len(kept) + 1), 0.0, 0.0
    w[-1] = math.log((n[1] + 1) / (n[0] + 1))
    shrink = np.array([0.3] * len(kept) + [0.0])
    for step in range(1, 401):
        g = (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + shrink * w) / len(sample)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = [sum(a for a, f in zip(w, kept, strict=False) if f in own) + w[-1] for own in found]
    return kept, sorted(((i, held(i), 1 / (1 + math.exp(-a))) for (i, _), a in zip(rows, z, strict=True)), key=str)


def test_toxicity_of_a_table_equals_brute_force(spark, tmp_path, monkeypatch):
    from kinetrace.llm import toxicity
    from kinetrace.llm.queries import op10_toxicity

    monkeypatch.setattr(toxicity, "HELD", 60)
    rng = random.Random(12)
    plain, bad = ["house", "river", "walking", "number", "the", "and", "holiday"], ["idiot", "moron", "1d10t", "m0r0n,", "stuuupid", "i.d.i.o.t"]
    rows, labels = [], []
    for i in range(260):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randrange(1, 30)) + (rng.choices(bad, k=2) if toxic else ["polite"] if rng.random() < 0.7 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] if rng.random() < 0.9 else [(i, None)]
    rows += [(None, "you i d i o t"), (300, None), (301, ""), (302, "polite " * 3000), (4, "a second text of one id, moron")]
    labels += [(None, 1), (7, 0), (7, 1), (9999, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, want = brute_toxicity(rows, labels)
    assert "polite" not in kept and {"idiot", "moron"} <= set(kept)
    got = sorted((tuple(r) for r in op10_toxicity(spark, str(tmp_path)).collect()), key=lambda r: str((r[0], r[1])))
    want.sort(key=lambda r: str(r[:2]))
    by = lambda r: (str(r[:2]), r[2])
    for (i, own, score, predicted), (j, held, expected) in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert (i, own, predicted) == (j, held, int(score >= 0.5)) and score == pytest.approx(expected, abs=1e-6)
