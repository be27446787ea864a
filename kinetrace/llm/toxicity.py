"""Toxicity by noisy-channel deobfuscation.

Words that look disguised - look-alike digits and signs, letters set apart, stretched letters - become lattices of the
letters that may be meant.  Viterbi search under a character 4-gram model (counted over all texts) and fixed channel costs
decodes them, letters set apart also into several words; the restored text is then scored by a logistic regression over words and word beginnings.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .words import slices, trimmed

#: Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Channel costs in nats.
COST_LOOKALIKE, COST_DROP_LOOKALIKE, COST_DROP_SIGN, COST_SQUEEZE = 0.5, 6.0, 0.2, 1.0
#: Labelled rows that the classifier is fitted on at most, on average over hash seeds.
SAMPLE = 20_000
#: Information, in nats over the sample, that a feature must give on the label; 2 * 7.5 is about the 0.9999 quantile of a
#: chi-squared variable.  Every feature of toxic rows that does is kept, however rare.
GAIN = 7.5

#: Folded characters: 0 for no letter, a-z (without their accents), then other letters in OTHERS classes by code point.
OTHERS = 8
_A = 27 + OTHERS


def fold(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if ord(c) >= 0x800:
        return 0 if 0x2000 <= ord(c) < 0x3000 else 27 + ord(c) % OTHERS
    base = unicodedata.normalize("NFD", c.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27 + ord(c) % OTHERS if base.isalpha() else 0


_CODE = np.array([fold(chr(c)) for c in range(0x800)])
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’¿¡…–—"
_NO_LETTERS = "".join(c for c in _PUNCTUATION if c not in LOOKALIKES)
_LETTER = re.compile(r"[^\W\d_]")
_DISGUISED = re.compile(r"[^\W\d_][0134578@$!|+]|[0134578@$!|+][^\W\d_]|([^\W\d_])\1\1")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Letters set apart in a token: by any signs, by signs that stand for no letter, or all by the same sign.
_APART = (
    re.compile(r"(?:[a-z](?:[^\w\s]|_){1,2}){2,}[a-z]"),
    re.compile(r"(?:[a-z0134578@$!|+](?:[^\w\s@$!|+]|_){1,2}){2,}[a-z0134578@$!|+]"),
    re.compile(r"[a-z0134578@$!|+]([^\w\s]|_)(?:[a-z0134578@$!|+]\1)+[a-z0134578@$!|+]"),
)
#: Letters and look-alikes of a text that blanks, signs that stand for no letter, or a mix of both set apart.
_SINGLES = re.compile(r"(?<![^\s(\"'])[a-z0134578@$!|+](?:(?:[\s_]|[^\w\s@$!|+]){1,5}+[a-z0134578@$!|+](?![^\W_])){2,}+")


def spread_out(text: str) -> list[str]:
    """Letters set apart over several tokens; those within one are a word's matter."""
    return [m.group() for m in _SINGLES.finditer(text) if len(m.group().split()) > 1]


def _codes(data: np.ndarray) -> np.ndarray:
    """Folded characters of UTF-8 bytes."""
    at = np.flatnonzero((data < 0x80) | (data >= 0xC0))
    if not len(at):
        return at
    lead = data[at].astype(np.int64)
    after = data[np.minimum(at + 1, len(data) - 1)].astype(np.int64) & 0x3F
    last = data[np.append(at[1:], len(data)) - 1].astype(np.int64)
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | after, 0))
    return np.where(lead < 0xE0, _CODE[np.minimum(point, 0x7FF)], np.where(lead == 0xE2, 0, 27 + last % OTHERS))


def _char_counts(batches):
    """4-grams of folded characters (a-z, other letters, anything else) over whole texts: index, count."""
    total = np.zeros(_A**4, np.int64)
    for batch in batches:
        for _, _, data, _ in slices(batch.column(0)):
            c = _codes(data)
            # Runs of anything else count once.
            c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))] if len(c) else c
            if len(c) > 3:
                total += np.bincount(((c[:-3] * _A + c[1:-2]) * _A + c[2:-1]) * _A + c[3:], minlength=_A**4)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 16):
        some = at[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])


class CharModel:
    """Interpolated character 4-grams: log P(d | a, b, c) for folded characters."""

    def __init__(self, counts: np.ndarray, strength: float = 2.0):
        n4 = counts.reshape(_A, _A, _A, _A).astype(np.float64)
        p = np.full(_A, 1 / _A)
        for n in (n4.sum((0, 1, 2)), n4.sum((0, 1)), n4.sum(0), n4):
            p = (n + strength * p) / (n.sum(-1, keepdims=True) + strength)
        self.log = np.log(p).astype(np.float32)


def apart(token: str) -> str:
    """The letters and look-alikes of a token that sets them apart; else nothing."""
    if not _LETTER.search(token):
        return ""
    if _APART[0].fullmatch(token):
        return "".join(c for c in token if c.isalpha())
    if _APART[1].fullmatch(token):
        return "".join(c for c in token if c.isalpha() or c in LOOKALIKES)
    return token[::2] if _APART[2].fullmatch(token) else ""


class Restorer:
    """Decodes disguised words; everything else is left as it is."""

    def __init__(self, model: CharModel):
        self.log = model.log

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each stretch of the word: the strings it may stand for, with channel costs."""
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            run = j - i
            if c.isalpha():
                options = [(c * min(run, 2), 0.0 if run <= 2 else COST_SQUEEZE)]
                if run > 1:
                    options.append((c, COST_SQUEEZE))
                out.append(options)
            elif c in LOOKALIKES:
                options = [(x * k, COST_LOOKALIKE * run) for x in LOOKALIKES[c] for k in ({1, min(run, 2)})]
                out.append([*options, ("", COST_DROP_LOOKALIKE)])
            else:
                out.append([("", COST_DROP_SIGN)])
            i = j
        return out

    @staticmethod
    def with_breaks(lattice: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
        """A word may end after each letter, except the last."""
        out = []
        for options in lattice:
            doubled = [(f"{t[0]} {t[1]}", cost) for t, cost in options if len(t) == 2]
            out.append(options + doubled + [(t + " ", cost) for t, cost in options + doubled if t])
        return [*out[:-1], [o for o in out[-1] if not o[0].endswith(" ")]] if out else out

    def decode(self, word: str, breaks: bool = False) -> str:
        """The best path: a state for each last three characters."""
        paths: dict = {(0, 0, 0): (0.0, None)}
        log = self.log
        lattice = self.lattice(word)
        for options in self.with_breaks(lattice) if breaks else lattice:
            after: dict = {}
            for (a, b, c), (cost, path) in paths.items():
                for letters, channel in options:
                    x, y, z, k = a, b, c, cost + channel
                    for letter in letters:
                        d = fold(letter)
                        k -= float(log[x, y, z, d])
                        x, y, z = y, z, d
                    if (x, y, z) not in after or k < after[(x, y, z)][0]:
                        after[(x, y, z)] = (k, (path, letters))
            paths = after
        _, path = min(((cost - float(log[a, b, c, 0]), path) for (a, b, c), (cost, path) in paths.items()), key=lambda x: x[0], default=(0, None))
        out = []
        while path:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """A token without punctuation around it, restored if it looks disguised; several words where letters are set apart."""
        core = token.strip(_PUNCTUATION)
        # Letters side by side, with no sign that may be one: only stretched ones can be a disguise.
        if len(core) > 1 and core.isalpha() and "$" not in token and "@" not in token:
            return self.decode(core) if _STRETCHED.search(core) else core
        letters = apart(token.strip(_NO_LETTERS)) or apart(core)
        if letters:
            return self.decode(letters, breaks=True)
        # Signs at an end may be letters if one or two stand there.
        at = token.find(core) if core else 0
        tail = token[at + len(core) :]
        if tail and len(tail) <= 2 and set(tail) <= set("$@"):
            core += tail
        head = token[:at]
        if head and len(head) <= 2 and set(head) <= set("$@"):
            core = head + core
        return self.decode(core) if _LETTER.search(core) and _DISGUISED.search(core) else core

    def text(self, text: str) -> list[str]:
        """Words of the restored text; letters set apart over several tokens are decoded besides."""
        text = text.lower()
        words = [w for t in text.split() for w in self.word(t).split(" ")]
        return words + [w for run in spread_out(text) for w in self.joined(run)]

    def joined(self, run: str) -> list[str]:
        letters = "".join(c for c in run if c.isalpha() or c in LOOKALIKES)
        return self.decode(letters, breaks=True).split() if len({c for c in letters if c.isalpha()}) > 1 else []


def features(words: str) -> list[str]:
    """Each word and, marked, its beginnings of 4 to 6 characters."""
    return [f for word in words.split(" ") if word for f in (word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) >= k))]


class TokenFeatures(dict):
    """Ids of the kept features of a token; a bounded cache."""

    def __init__(self, restorer: Restorer, kept: dict[str, int]):
        super().__init__()
        self.restorer, self.kept = restorer, kept

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 75_000:
            self.clear()
        got = self.of(self.restorer.word(token))
        if len(token) <= 64:
            self[token] = got
        return got

    def of(self, word: str) -> tuple[int, ...]:
        return tuple(self.kept[f] for f in features(word) if f in self.kept)

    def of_text(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.lower()
        found = {f for token in set(text.split()) for f in self[token]}
        for run in spread_out(text):
            for w in self.restorer.joined(run):
                found.update(self.of(w))
        return sorted(found)


#: Features that a task counts before it hands on what it has.
HELD = 200_000


def _document_counts(model: CharModel):
    """feature, toxic, n: in how many documents of each class a feature stands, in parts that sum up."""

    def run(batches):
        restorer, words = Restorer(model), {}
        counts: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def parts():
            for toxic, own in enumerate(counts):
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array([toxic] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], names=["feature", "toxic", "n"])
                    own.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text, found = (text.as_py() or "").lower(), set()
                for token in set(text.split()):
                    if token not in words:
                        if len(words) > 100_000:
                            words.clear()
                        words[token] = features(restorer.word(token))
                    found.update(words[token])
                for run in spread_out(text):
                    found.update(f for w in restorer.joined(run) for f in features(w))
                own = counts[toxic]
                for f in found:
                    own[f] = own.get(f, 0) + 1
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield from parts()
        yield from parts()

    return trimmed(run)


def information(a: Column, n1: int, b: Column, n0: int) -> Column:
    """Nats that a feature gives on the label: a of n1 toxic documents and b of n0 others have it."""
    out = F.lit(0.0)
    for x, y in ((a, b), (F.lit(n1) - a, F.lit(n0) - b)):
        p = (x + y) / F.lit(float(n1 + n0))
        for part, n in ((x, n1), (y, n0)):
            out = out + F.when(part > 0, part * F.ln(part / F.lit(float(n)) / p)).otherwise(0.0)
    return out


def _sample_features(model: CharModel, kept: dict[str, int]):
    def run(batches):
        tokens = TokenFeatures(Restorer(model), kept)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.of_text(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32())), batch.column(1)], names=["found", "toxic"])

    return trimmed(run)


def fit_logistic(rows: list[list[int]], labels: np.ndarray, n: int, penalty: float = 0.3, steps: int = 400) -> np.ndarray:
    """Weights and, last, the bias of an L2-penalised logistic regression on sparse binary rows (Adam, full batches)."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(doc) else np.zeros(0, np.int64)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[col], len(rows)) + w[n]
        away = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(col, away[doc], n) + penalty * w[:n], away.sum()) / max(1, len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class ToxicityModel:
    """A character model, kept features and their weights: a few megabytes, whatever the input."""

    def __init__(self, chars: CharModel, kept: dict[str, int], weights: np.ndarray):
        self.chars, self.kept, self.weights = chars, kept, weights

    def scorer(self):
        tokens = TokenFeatures(Restorer(self.chars), self.kept)
        w = self.weights

        def score(text: str | None) -> float:
            z = w[-1] + sum(w[f] for f in tokens.of_text(text))
            return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))

        return score


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, work: Workspace, *, sample: int = SAMPLE) -> ToxicityModel:
    """Character counts over all texts; the classifier on at most about ``sample`` labelled rows that aren't held out.

    labels (doc_id, toxic): null labels and ids are left out, several labels of one doc_id count as their maximum.
    Rows are taken by hash of doc_id below a bound, so reruns agree.  Without labelled rows, all scores are 0.5.
    """
    texts = docs.select(F.col("doc_id"), F.col("text"))
    counts = texts.select("text").mapInArrow(_char_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(_A**4, np.int64)
    total[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
    chars = CharModel(total)
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("id")))
    own = work.write(own, "labels")
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # Bounded by ``sample`` rows.
    rows = work.write(texts.join(F.broadcast(own), F.col("doc_id") == F.col("id")).select("text", "toxic"), "sample")
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        bias = 0.0 if n1 == n0 else math.log((n1 + 1) / (n0 + 1))
        return ToxicityModel(chars, {}, np.array([bias]))
    counted = rows.mapInArrow(_document_counts(chars), "feature string, toxic int, n long")
    with_label = lambda x: F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0))
    counted = counted.groupBy("feature").agg(with_label(1).alias("a"), with_label(0).alias("b"))
    # Words of clean rows alone are left out: that a text lacks them, as an empty one does, says nothing of toxicity.
    told = counted.where("a > 0").where(information(F.col("a"), n1, F.col("b"), n0) >= GAIN).select("feature").toArrow()
    kept = {f: i for i, f in enumerate(sorted(told.column("feature").to_pylist()))}
    table = rows.mapInArrow(_sample_features(chars, kept), "found array<int>, toxic int").toArrow()
    weights = fit_logistic(table.column("found").to_pylist(), table.column("toxic").to_numpy().astype(float), len(kept))
    return ToxicityModel(chars, kept, weights)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Whole texts are read.  Null and empty texts get the score of a text without features.  Null ids count as not held out
    and have no label; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "toxicity")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit_toxicity(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), work)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = texts.mapInArrow(trimmed(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", work: Workspace | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below 0.5; nulls, repeats and empty tables as in toxicity_scores."""
    work = work or Workspace(docs.sparkSession, "toxicity")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model, at = fit_toxicity(texts, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), work), docs.columns.index(text)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            keep = [score(t.as_py()) < 0.5 for t in batch.column(at)]
            yield batch if all(keep) else batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
