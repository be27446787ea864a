"""Language identification by words first, character n-grams where a word is unknown.

A known word counts with its log frequency in each language.  An unknown word is read as character n-grams: at each
place the longest known one, from ORDER characters down to one, counts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, maybe_broadcast
from .toxicity import held_out

#: Labelled rows of each language that the model is fitted on at most, on average over hash seeds.  All units that stand
#: in them twice or more are kept.
SAMPLE = 5_000
ORDER = 4
#: Letters of an unknown word that count as much as a known word.
LETTERS = 8
#: Tokens whose evidence a score counts in full; longer texts are averaged to this many.
EVIDENCE = 25
_RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters, as str.isalpha tells them: of numerals such as ½ and ② the pattern alone would take for letters none is one."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ("".join(c if c.isalpha() else " " for c in run).split() if not run.isalpha() else (run,))]


def grams(word: str):
    text = f"^{word}$"
    for k in range(1, ORDER + 1):
        for i in range(len(text) - k + 1):
            yield text[i : i + k]


def _counts(batches):
    """lang, kind (0 word, 1 n-gram), unit, n."""
    seen: dict[tuple[str, str], int] = {}

    def rows():
        units: dict[tuple[str, int, str], int] = {}
        for (lang, word), n in seen.items():
            units[lang, 0, word] = units.get((lang, 0, word), 0) + n
            for g in grams(word):
                units[lang, 1, g] = units.get((lang, 1, g), 0) + n
        seen.clear()
        items = list(units.items())
        for i in range(0, len(items), 1 << 16):
            some = items[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in some]), pa.array([k[1] for k, _ in some], pa.int32()), pa.array([k[2] for k, _ in some]), pa.array([n for _, n in some], pa.int64())],
                names=["lang", "kind", "unit", "n"],
            )

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for word in letter_runs((text.as_py() or "").lower()):
                seen[lang, word] = seen.get((lang, word), 0) + 1
            if len(seen) > 200_000:
                yield from rows()
    yield from rows()


class LanguageModel:
    """Log frequencies of words and n-grams by language: one table, a row each; row 0 is nothing, row 1 an unknown character."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], pieces: dict[str, np.ndarray], totals: np.ndarray):
        """words and pieces: counts by language; totals: (2, languages) sums over all units, kept or not."""
        self.langs = langs
        rows = [np.zeros(len(langs)), np.log(0.5 / (totals[1] + 1)) if langs else np.zeros(0)]
        self.words, self.grams = {}, {}
        for ids, counts, total in ((self.words, words, totals[0]), (self.grams, pieces, totals[1])):
            for unit, n in counts.items():
                ids[unit] = len(rows)
                rows.append(np.log((n + 0.5) / (total + 0.5 * len(counts) + 1)))
        self.table = np.array(rows, np.float32).reshape(len(rows), len(langs))

    def rows(self, word: str) -> list[int]:
        """A known word's row, or at each place of ^word$ that of the longest known n-gram."""
        known = self.words.get(word)
        if known is not None:
            return [known]
        text, get, out = f"^{word}$", self.grams.get, []
        for i in range(len(text)):
            row = get(text[i : i + ORDER])
            if row is None:
                for k in range(ORDER - 1, 0, -1):
                    row = get(text[i : i + k])
                    if row is not None:
                        break
            out.append(1 if row is None else row)
        return out


class Predictor(dict):
    """Places of tokens in a table of evidence; a bounded cache, filled for all new tokens of a text at once."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.clear()
        # Place 0: a token without letters.
        self.table = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.size = 1
        self.waiting: list[list[int]] = []

    def __missing__(self, token: str) -> int:
        parts = letter_runs(token.lower())
        place = 0
        if parts:
            rows = self.model.rows(parts[0])
            for p in parts[1:]:
                rows = rows + self.model.rows(p)
            self.waiting.append(rows)
            place = self.size
            self.size += 1
        if len(token) <= 64:
            self[token] = place
        return place

    def _fill(self) -> None:
        """An unknown word's n-grams count as much as two units together, or as one for every LETTERS of them if that is more."""
        while self.size > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        lengths = np.array([len(r) for r in self.waiting])
        flat = np.fromiter((x for r in self.waiting for x in r), np.int64, int(lengths.sum()))
        sums = np.add.reduceat(self.model.table[flat], np.cumsum(lengths) - lengths, axis=0)
        self.table[self.size - len(lengths) : self.size] = sums * (np.maximum(2.0, lengths / LETTERS) / np.maximum(2.0, lengths))[:, None]
        self.waiting = []

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return "und", 0.0
        if self.size > 120_000 or len(self) > 150_000:
            self._reset()
        at = np.fromiter(map(self.__getitem__, text.split()), np.int64)
        if self.waiting:
            self._fill()
        at = at[at > 0]
        if not len(at):
            return "und", 0.0
        total = self.table[at].sum(0, dtype=np.float64) * min(1.0, EVIDENCE / len(at))
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.model.langs[best], float(p[best] / p.sum())


def fit_languages(docs: DataFrame, work: Workspace, *, sample: int = SAMPLE) -> LanguageModel:
    """Fits on (doc_id, text, lang): rows with a lang that aren't held out, about ``sample`` of each lang at most, by hash.

    Units of that bounded sample, and one row for each language, come to the driver.
    """
    own = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = own.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") > sample)
    # Rows of a language pass with a chance that its number of rows gives.
    own = own.join(maybe_broadcast(work.write(sizes, "sizes")), "lang", "left")
    chance = F.coalesce(F.lit(sample) / F.col("rows"), F.lit(1.0))
    own = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < chance * (1 << 30))
    counted = own.select("text", "lang").mapInArrow(_counts, "lang string, kind int, unit string, n long").groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n"))
    counted = work.write(counted, "counts")
    totals = counted.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in totals})
    place = {x: i for i, x in enumerate(langs)}
    sums = np.zeros((2, len(langs)))
    for r in totals:
        sums[r.kind, place[r.lang]] = r.n
    tables = []
    for kind in (0, 1):
        by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
        units = counted.where(F.col("kind") == kind).groupBy("unit").agg(F.sum("n").alias("all"), by_lang.alias("by")).where("all > 1").select("unit", "by").toArrow()
        table = {}
        for unit, by in zip(units.column("unit").to_pylist(), units.column("by").to_pylist(), strict=True):
            row = np.zeros(len(langs))
            for lang, n in by:
                row[place[lang]] = n
            table[unit] = row
        tables.append(table)
    return LanguageModel(langs, *tables, sums)


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", work: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; lang is read of training rows only.

    Whole texts are read, runs of letters without blanks as long as they are.  Null text, text without letters, or no
    training rows: und with score 0.  Score is the posterior under equal priors, evidence averaged to EVIDENCE tokens if
    there are more; ties go to the first language by name.  Null ids count as not held out; repeated rows are predicted
    each; an empty table gives an empty result; other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "langid")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit_languages(texts, work)

    def run(batches):
        predictor = Predictor(model)
        for batch in batches:
            got = [predictor.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
