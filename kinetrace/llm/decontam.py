"""Benchmark decontamination by spaced-seed hashing.

Each fixed mask reads three words of a window and ignores the rest, so a hash hit survives substitutions at the ignored
places.  Enough masks are taken for every hit to hold one: of m matching words within L, some three that follow each
other stand within (L - 1) // ((m - 1) // 2) + 1 words.  Hashes of test windows are joined with those of every training
window; around a hit, text and item are laid on the hit's diagonal and the matching words are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, filesystem
from .mixing import word_count
from .words import U64, hashed, slices, windows, word_bounds, word_hashes

#: Words that an item needs to be looked for, unless shorter ones are asked for, which count only where all their words match.
MIN_ITEM = 8
#: Matching words that make a hit; 80 % of an item's words if that is less.
MIN_MATCH = 13
#: Consecutive words of an item that hold them.
EXTENT = 60
SUBSTITUTION = 3


def needed(length: int) -> int:
    return length if length < MIN_ITEM else min(MIN_MATCH, -(-length * 4 // 5))


def reach(length: int) -> int:
    """The span of the masks that items of a length need."""
    return (min(length, EXTENT) - 1) // ((needed(length) - 1) // 2)


#: Fixed masks, by span: the first word, the last and one between.
MASKS = tuple((0, a, b) for b in range(2, reach(EXTENT) + 1) for a in range(1, b))
#: Words of benchmark items that one pass over the documents holds if each word starts three masks; more take more passes.
PASS_WORDS = 2_000_000
#: Item words that are laid beside texts at once.
CHUNK = 1 << 20


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    edge = np.cumsum(sizes)
    return np.repeat(starts - (edge - sizes), sizes) + np.arange(edge[-1] if len(edge) else 0)


class Benchmark:
    """Hashed windows of some items."""

    def __init__(self, items: list[tuple[int | None, str | None]], shortest: int = MIN_ITEM):
        column = pa.array([t for _, t in items], pa.string())
        self.ids, self.words = [x for x, _ in items], []
        for _, _, data, offsets in slices(column):
            starts, ends, first = word_bounds(data, offsets)
            hashes = word_hashes(data, starts, ends)
            self.words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.flat)) - self.begin[item]
        self.need = np.array([needed(n) for n in self.size], np.int64)
        spans = np.array([reach(n) if n >= max(3, shortest) else 0 for n in self.size], np.int64)
        #: Of each mask: its sorted keys, and the item and the place of each.
        self.tables = []
        for mask in MASKS:
            got = windows(self.flat, mask)
            n = len(got)
            at = np.flatnonzero((spans[item[:n]] >= mask[-1]) & (place[:n] + mask[-1] < self.size[item[:n]]))
            if len(at):
                at = at[np.argsort(got[at], kind="stable")]
                self.tables.append((mask, got[at], item[at].astype(np.int32), place[at].astype(np.int32)))
        bits = min(27, max(16, int(len(self.flat)).bit_length() + 6))
        self.shift = U64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.flat >> self.shift).astype(np.int64)] = True

    def overlaps(self, words: np.ndarray, item: int, diagonals) -> tuple[int, int, int] | None:
        """(start, end, matches) of the best stretch on some diagonals (text place less item place), if long enough.

        A diagonal's stretch is the best-scoring one (a match +1, a substitution -3) or, where that is too short, the
        EXTENT words of the item with the most matches, from the first to the last.
        """
        own = self.words[item]
        need, best = int(self.need[item]), None
        for d in diagonals:
            low, high = max(0, -d), min(len(own), len(words) - d)
            same = own[low:high] == words[low + d : high + d]
            run = np.concatenate(([0], np.cumsum(np.where(same, 1, -SUBSTITUTION))))
            least = np.minimum.accumulate(run)
            end = int(np.argmax(run - least))
            start = int(np.argmin(run[: end + 1]))
            matches = int(same[start:end].sum())
            if matches < need:
                total = np.concatenate(([0], np.cumsum(same)))
                ends = np.arange(1, len(total))
                starts = np.maximum(0, ends - EXTENT)
                at = int(np.argmax(total[ends] - total[starts]))
                inside = np.flatnonzero(same[starts[at] : ends[at]]) + starts[at]
                matches = len(inside)
                start, end = (int(inside[0]), int(inside[-1]) + 1) if matches else (0, 0)
            if matches >= need and (best is None or matches > best[2]):
                best = (low + d + start, low + d + end, matches)
        return best

    def seeded(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and diagonal (from the document's first word) of each seed that they share, once each."""
        known = self.known[(words >> self.shift).astype(np.int64)]
        none = np.zeros(0, np.int64)
        found = [(none, none, none)]
        for mask, keys, items, places in self.tables:
            n = len(words) - mask[-1]
            if n <= 0:
                continue
            at = np.flatnonzero(known[:n] & known[mask[1] : mask[1] + n] & known[mask[2] :])
            if not len(at):
                continue
            got = hashed([words[at + i] for i in mask], mask)
            low = np.searchsorted(keys, got, "left")
            hit = keys[np.minimum(low, len(keys) - 1)] == got
            at, low = at[hit], low[hit]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + mask[-1] < first[doc + 1]
            at, low, doc = at[inside], low[inside], doc[inside]
            if not len(at):
                continue
            count = np.searchsorted(keys, keys[low], "right") - low
            of = _ranges(low, count)
            at, doc = np.repeat(at, count), np.repeat(doc, count)
            found.append((doc, items[of].astype(np.int64), at - first[doc] - places[of]))
        doc, item, diagonal = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((diagonal, item, doc))
        doc, item, diagonal = doc[order], item[order], diagonal[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
        return doc[fresh], item[fresh], diagonal[fresh]

    def matching(self, words: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Whether EXTENT consecutive words of the item hold matches enough on the diagonal."""
        low = np.maximum(0, -diagonal)
        size = np.minimum(self.size[item], first[doc + 1] - first[doc] - diagonal) - low
        same = self.flat[_ranges(self.begin[item] + low, size)] == words[_ranges(first[doc] + low + diagonal, size)]
        total = np.concatenate(([0], np.cumsum(same)))
        begin = np.cumsum(size) - size
        ends = np.arange(1, len(total))
        starts = np.maximum(np.repeat(begin, size), ends - EXTENT)
        return np.maximum.reduceat(total[ends] - total[starts], begin) >= self.need[item]

    def scan(self, column: pa.Array):
        """(row, item, start, end, matches): items found in each text."""
        if not self.tables:
            return
        for row, _, data, offsets in slices(column):
            starts, ends, first = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            doc, item, diagonal = self.seeded(words, first)
            block = np.cumsum(self.size[item]) // CHUNK
            hits: dict[tuple[int, int], list[int]] = {}
            for some in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(block)) + 1):
                if len(some):
                    some = some[self.matching(words, first, doc[some], item[some], diagonal[some])]
                for d, i, x in zip(doc[some].tolist(), item[some].tolist(), diagonal[some].tolist(), strict=True):
                    hits.setdefault((d, i), []).append(x)
            for (d, i), diagonals in hits.items():
                yield row + d, i, *self.overlaps(words[first[d] : first[d + 1]], i, diagonals)


def _passes(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Folders of written items, 3 * PASS_WORDS masked windows a pass at most on average: a stated query set in blocks.

    Items never come to the driver; a worker reads those of the pass at hand.
    """
    work = Workspace(benchmark.sparkSession, "benchmark")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null")
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    n = max(1, -(-total * len(MASKS) // (3 * PASS_WORDS)))
    items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).write.partitionBy("pass").parquet(f"{work.path}/items")
    return [f"{work.path}/items/pass={i}" for i in range(n)]


#: The items of the last pass that this worker has read.
_READ: dict[tuple[str, int], Benchmark] = {}


def _read(path: str, shortest: int) -> Benchmark:
    if (path, shortest) not in _READ:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, folder = filesystem(path)
        items: list = []
        # A pass that no item falls into has no folder.
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            table = pq.read_table(folder, filesystem=fs, partitioning=None, columns=["item_id", "text"])
            items = list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        _READ.clear()
        _READ[path, shortest] = Benchmark(items, shortest)
    return _READ[path, shortest]


_SPANS = "doc_id long, item_id long, start_word int, end_word int, matches int, item_words int"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shortest: int = MIN_ITEM) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, start_word, end_word, matches, item_words.

    An item is found, always, where MIN_MATCH words within EXTENT consecutive ones of it match on one diagonal, or 80 % of
    the item's words if that is less.  Items of fewer than MIN_ITEM words are looked for only from ``shortest`` words on
    (three at least), and found where all their words stand.  Documents never move; each pass reads a bounded block of items
    from the shared folder.  Texts are read whole, however long.  Null and empty texts hold nothing; null ids are kept; of
    equal diagonals the first counts; repeated rows give repeated rows; empty tables give an empty result; other columns
    are not read.
    """

    def scan(path: str):
        def run(batches):
            bench = _read(path, shortest)
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, item, start, end, matches in bench.scan(batch.column(1)):
                    rows.append((ids[i].as_py(), bench.ids[item], start, end, matches, len(bench.words[item])))
                if rows:
                    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                    names = ["doc_id", "item_id", "start_word", "end_word", "matches", "item_words"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return run

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for path in _passes(benchmark, item_id, item_text):
        found = texts.mapInArrow(scan(path), _SPANS)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", shortest: int = MIN_ITEM) -> DataFrame:
    """The rows of docs, all columns as they are, in whose text no item is found; what is found as in contaminated_spans."""

    def keep(path: str, at: int):
        def run(batches):
            bench = _read(path, shortest)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, *_ in bench.scan(batch.column(at)):
                    clean[i] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        return run

    for path in _passes(benchmark, item_id, item_text):
        docs = docs.mapInArrow(keep(path, docs.columns.index(text)), docs.schema)
    return docs
