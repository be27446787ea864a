"""Substring dedup by collinear chaining: passages that repeat across documents, exactly or with edits.

Seeds are the word k-mers whose hash falls in one part of SAMPLE, whatever stands around them, so what edits leave whole
seeds both sides alike.  Documents that share a seed are joined through the one with the smallest id, never pairwise.  The
seeds that a document shares with such a partner are chained: in order of places in both, each adds its words less a gap
cost linear in both gaps, the best predecessor being found in a Fenwick tree of prefix maxima.  Chains are then aligned word
by word, which fixes their ends and their identity.

Exact repeats don't hang on seeds: every MIN_WORDS-gram of a document is joined with the same gram of the document with
the smallest id that holds it.  Grams travel in runs of one minimizer, which equal grams have in common.

Where smaller ids hold parts of an edited passage only, all its seeds lead to them and none to a document that holds it
whole.  So a second turn takes the places whose seeds other documents share but that no passage covers, and links each seed
there with one FAR words on: holders of a part too short to be a passage seldom hold both.  Holders of such a link meet the
smallest of them and the one before them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, maybe_broadcast, partitions
from .words import U64, Buckets, gathered, mix, rolled, slices, trimmed, windows, word_bounds, word_hashes

#: Words of a seed; one in SAMPLE of them counts.
K, SAMPLE = 5, 2
#: Words by whose least hash runs of grams are dealt out.
RUN_K = 8
MIN_WORDS = 50
#: An aligned passage needs this share of its words to match.
IDENTITY = 0.8
GAP_COST = 0.05
MAX_GAP = 40
#: Words that a chain must span before it is aligned.
MIN_SPAN = 16
MARGIN = 64
#: Roles of a document that travel with its text at once.
LIST = 200
#: Words of a cell; places that no passage covers are told by cells.
CELL = 16
#: A seed is linked with one of the seeds so many words on, in each of these ranges.
FAR = ((24, 40), (40, 64))
#: Gaps and their cost in chains of links.
FAR_GAP, FAR_COST = 64, 0.02
_KINDS = (np.uint64, np.int64, np.int32)
#: Links, documents, places of both seeds.
_LINK_KINDS = (np.uint64, np.int64, np.int32, np.int32)
#: Steps between the anchors of an exact run.
STEP = 21
#: Documents, places, lengths of runs; the first 48 bits of their grams in two parts.
_RUN_KINDS = (np.int64, np.int32, np.int32, np.uint32, np.uint16)


def _seeds(buckets: int):
    def run(batches):
        packed = Buckets(buckets, _KINDS)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, to, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                grams = windows(word_hashes(data, starts, ends), range(K))
                if not len(grams):
                    continue
                # Documents that are shorter than the shorter side of a passage hold none.
                at = np.flatnonzero(grams % U64(1 << 32) < U64((1 << 32) // SAMPLE))
                doc = np.searchsorted(first, at, "right") - 1
                ok = (at + K <= first[doc + 1]) & (np.diff(first)[doc] >= MIN_WORDS * IDENTITY)
                at, doc = at[ok], doc[ok]
                keys = grams[at]
                # The n-th place of a seed in a document meets n-th places only, so repeats cost no products.
                order = np.lexsort((at, keys, doc))
                keys, at, doc = keys[order], at[order], doc[order]
                if len(keys):
                    run = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))))
                    turn = np.arange(len(keys)) - np.repeat(run, np.diff(np.append(run, len(keys))))
                    keys = np.where(turn > 0, mix(keys ^ mix(turn.astype(np.uint64), 31), 32), keys)
                packed.add(mix(keys), keys, ids[row:to][doc].astype(np.int64), (at - first[doc]).astype(np.int32))
                if packed.full():
                    yield from packed.batch("keys", "docs", "places")
        yield from packed.batch("keys", "docs", "places")

    return trimmed(run)


def _anchors(batches):
    """Occurrences of a seed in other documents, each with the one in the document of the smallest id."""
    for keys, docs, places in gathered(batches, _KINDS):
        order = np.lexsort((places, docs, keys))
        keys, docs, places = keys[order], docs[order], places[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))
        keys, docs, places = keys[fresh], docs[fresh], places[fresh]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(at, len(keys)))
        hub = np.repeat(at, size)
        other = np.flatnonzero(hub != np.arange(len(keys)))
        for i in range(0, len(other), 1 << 16):
            some = other[i : i + (1 << 16)]
            yield _anchor_batch(docs[some], docs[hub[some]], places[some], places[hub[some]], np.zeros(len(some), np.int32))


def _anchor_batch(doc, hub, p, q, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(hub), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(n, pa.int32())], names=["doc", "hub", "p", "q", "n"])


def _links(buckets: int):
    """Texts with their open cells to links: bucket, link, document, places of its two seeds."""

    def run(batches):
        packed = Buckets(buckets, _LINK_KINDS)
        for batch in batches:
            ids, cells = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for row, to, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                some = cells.slice(row, to - row)
                packed.add(*_linked(words, first, some.flatten().to_numpy(), np.diff(some.offsets.to_numpy()), ids[row:to]))
                if packed.full():
                    yield from packed.batch("links", "docs", "ps", "rs")
        yield from packed.batch("links", "docs", "ps", "rs")

    return trimmed(run)


def _linked(words: np.ndarray, first: np.ndarray, cells: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple:
    """Hash for the bucket, links, documents and places of both seeds, of seeds within MARGIN words of open cells.

    ``cells`` holds each document's cells (``counts`` of them) one after another; ``first`` the documents' first words.
    """
    grams = windows(words, range(K))
    row = np.repeat(np.arange(len(counts)), counts)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.maximum(first[row] + cells * CELL - MARGIN, first[row]), 1)
    np.add.at(edge, np.minimum(first[row] + (cells + 1) * CELL + MARGIN, first[row + 1]), -1)
    doc = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + K <= first[doc + 1]
    seed = inside & (np.cumsum(edge)[: len(grams)] > 0) & (grams % U64(1 << 32) < U64((1 << 32) // SAMPLE))
    at = np.flatnonzero(seed)
    none = ~U64(0)
    # A seed is linked with that of the range whose hash with it is least, so both sides of a passage choose alike.
    after = np.concatenate((np.where(seed, grams, U64(0)), np.zeros(FAR[-1][1], np.uint64)))
    end = first[doc[at] + 1]
    out = []
    for salt, (low, high) in enumerate(FAR):
        best, far = np.full(len(at), none), np.zeros(len(at), np.int64)
        for step in range(low, high):
            other = after[at + step]
            both = np.where((other > 0) & (at + step < end), mix(grams[at] ^ (other << U64(1)), 41 + salt), none)
            less = both < best
            best, far = np.where(less, both, best), np.where(less, step, far)
        ok = best < none
        out.append((best[ok], at[ok], at[ok] + far[ok]))
    links, p, r = (np.concatenate(x) for x in zip(*out, strict=True))
    own = np.searchsorted(first, p, "right") - 1
    return mix(links), links, ids[own].astype(np.int64), (p - first[own]).astype(np.int32), (r - first[own]).astype(np.int32)


def _meetings(batches):
    """Holders of a link, each with the smallest of them and the one before it: anchors of both seeds."""
    for links, docs, ps, rs in gathered(batches, _LINK_KINDS):
        order = np.lexsort((ps, docs, links))
        links, docs, ps, rs = links[order], docs[order], ps[order], rs[order]
        fresh = np.concatenate(([True], (links[1:] != links[:-1]) | (docs[1:] != docs[:-1])))
        links, docs, ps, rs = links[fresh], docs[fresh], ps[fresh], rs[fresh]
        at = np.flatnonzero(np.concatenate(([True], links[1:] != links[:-1])))
        hub = np.repeat(at, np.diff(np.append(at, len(links))))
        every = np.arange(len(links))
        own = np.flatnonzero(hub != every)
        later = own[hub[own] != own - 1]
        x, y = np.concatenate((own, later)), np.concatenate((hub[own], later - 1))
        for i in range(0, len(x), 1 << 15):
            a, b = x[i : i + (1 << 15)], y[i : i + (1 << 15)]
            pair = lambda c, d: np.concatenate((c, d))
            yield _anchor_batch(pair(docs[a], docs[a]), pair(docs[b], docs[b]), pair(ps[a], rs[a]), pair(ps[b], rs[b]), np.zeros(2 * len(a), np.int32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span :][:n])


def _grams(buckets: int):
    """All MIN_WORDS-grams, in runs of consecutive ones with one minimizer: bucket of it, documents, places, lengths, grams."""

    def run(batches):
        held: list[tuple] = []

        def out():
            docs, places, counts, bucket, grams = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(bucket, kind="stable")
            begin = np.cumsum(counts) - counts
            docs, places, counts, bucket, begin = (x[order] for x in (docs, places, counts, bucket, begin))
            edge = np.concatenate(([0], np.cumsum(counts)))
            grams = grams[np.repeat(begin - edge[:-1], counts) + np.arange(edge[-1])]
            cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            packed = [[x[a:b].astype(k).tobytes() for a, b in spans] for x, k in zip((docs, places, counts), _RUN_KINDS, strict=False)]
            low, high = (grams >> U64(32)).astype(np.uint32), (grams >> U64(16)).astype(np.uint16)
            packed += [[x[edge[a] : edge[b]].tobytes() for a, b in spans] for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), *[pa.array(x, pa.binary()) for x in packed]], names=["bucket", "docs", "places", "counts", "low", "high"])

        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, to, data, offsets in slices(batch.column(1)):
                starts, ends, first = word_bounds(data, offsets)
                words = word_hashes(data, starts, ends)
                if len(words) < MIN_WORDS:
                    continue
                grams, least = rolled(words, MIN_WORDS), _least(windows(words, range(RUN_K)), MIN_WORDS - RUN_K + 1)
                at = np.arange(len(grams))
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + MIN_WORDS <= first[doc + 1]
                at, doc, grams, least = at[inside], doc[inside], grams[inside], least[inside]
                if not len(at):
                    continue
                begin = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
                counts = np.diff(np.append(begin, len(at)))
                held.append((ids[row:to][doc[begin]].astype(np.int64), at[begin] - first[doc[begin]], counts, (least[begin] % np.uint64(buckets)).astype(np.int64), grams))
                size += len(at)
                if size >= 1 << 19:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return trimmed(run)


def _exact(batches):
    """Runs of equal grams: each occurrence of a gram with one in the document of the smallest id that holds it."""
    for docs, places, counts, low, high in gathered(batches, _RUN_KINDS):
        grams = low.astype(np.uint64) << U64(16) | high
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        some = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        if not len(some):
            continue
        edge = np.cumsum(counts)
        of = np.searchsorted(edge, some, "right")
        g, doc, place = grams[some], docs[of], places[of] + some - (edge[of] - counts[of])
        order = np.lexsort((place, doc, g))
        g, doc, place = g[order], doc[order], place[order]
        # Rows that repeat a doc_id give an occurrence once.
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
        g, doc, place = g[fresh], doc[fresh], place[fresh]
        new = np.concatenate(([True], g[1:] != g[:-1]))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hub = doc[at][group]
        holds = np.bincount(group, hub == doc).astype(np.int64)
        begin = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))
        turn = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
        # The source's occurrences are met in turn, over and over, so that runs of one repeated word stay on few diagonals.
        q = place[at[group] + turn % holds[group]]
        other = np.flatnonzero(hub != doc)
        doc, hub, p, q = doc[other], hub[other], place[other], q[other]
        if not len(p):
            continue
        order = np.lexsort((p, p - q, hub, doc))
        doc, hub, p, q = doc[order], hub[order], p[order], q[order]
        begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hub[1:] != hub[:-1]) | (np.diff(p) != 1) | (np.diff(q) != 1))))
        n = np.diff(np.append(begin, len(p))) + MIN_WORDS - 1
        for i in range(0, len(begin), 1 << 16):
            x = begin[i : i + (1 << 16)]
            yield _anchor_batch(doc[x], hub[x], p[x], q[x], n[i : i + (1 << 16)])


def merged(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact runs (places in both, words), those that meet or overlap on a diagonal put together."""
    d = p.astype(np.int64) - q
    order = np.lexsort((p, d))
    p, q, n, d = p[order], q[order], n[order], d[order]
    begin = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] > p[:-1] + n[:-1]))))
    return p[begin], q[begin], np.maximum.reduceat(p + n, begin) - p[begin]


def _ladder(n: int) -> np.ndarray:
    """Offsets of anchors over an exact run: its first and last K words and every STEP between."""
    return np.append(np.arange(0, n - K, STEP), n - K)


def chains(p: np.ndarray, q: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Best collinear chains of anchors (p ascending), as index arrays; each anchor is used once at most.

    score(i) = K + max(0, max over j with p_j < p_i and q_j < q_i of score(j) - gap_cost * (p_i - p_j + q_i - q_j)).
    With score(j) + gap_cost * (p_j + q_j) stored at q_j's rank, the maximum is a prefix query of a Fenwick tree.
    Anchors of one p are queried before any of them is stored.
    """
    n = len(p)
    ranks = np.searchsorted(np.unique(q), q) + 1
    size = int(ranks.max())
    best, who = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    pl, rl = p.tolist(), ranks.tolist()
    place = (gap_cost * (p + q.astype(np.int64))).tolist()
    i = 0
    while i < n:
        j = i
        while j < n and pl[j] == pl[i]:
            top, at, r = float("-inf"), -1, rl[j] - 1
            while r > 0:
                if best[r] > top:
                    top, at = best[r], who[r]
                r -= r & -r
            gain = top - place[j]
            score[j], back[j] = (K + gain, at) if gain > 0 else (float(K), -1)
            j += 1
        for x in range(i, j):
            value, r = score[x] + place[x], rl[x]
            while r <= size:
                if value > best[r]:
                    best[r], who[r] = value, x
                r += r & -r
        i = j
    out, used = [], [False] * n
    for end in sorted(range(n), key=lambda x: (-score[x], x)):
        path, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(x)
            x = back[x]
        if len(path) < 2:
            continue
        at = np.array(path[::-1])
        cut = np.flatnonzero((np.diff(p[at]) > max_gap) | (np.diff(q[at]) > max_gap)) + 1
        out += [c for c in np.split(at, cut) if len(c) > 1]
    return out


_ANCHOR = "doc long, hub long, p int, q int, n int"
_CHAIN = "doc long, hub long, chain long, p0 int, p1 int, q0 int, q1 int, ps array<int>, qs array<int>"


def paired_chains(p: np.ndarray, q: np.ndarray, n: np.ndarray, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains (places in both) of a pair's seeds (n = 0) and exact runs (n words).

    Runs lend the chains anchors at their ends and between.  One that no chain holds from end to end is a chain of its
    own, unless other such runs cover its words.
    """
    runs = np.stack(merged(p[n > 0], q[n > 0], n[n > 0]), 1).tolist() if (n > 0).any() else []
    rungs = [(_ladder(c) + a, _ladder(c) + b) for a, b, c in runs]
    points = np.unique(np.concatenate([np.stack((p[n == 0], q[n == 0]), 1), *[np.stack(r, 1) for r in rungs]]), axis=0)
    p, q = points[:, 0], points[:, 1]
    out = []
    for c in chains(p, q, gap_cost, max_gap) if len(p) > 1 else []:
        if p[c[-1]] - p[c[0]] + K >= MIN_SPAN and q[c[-1]] - q[c[0]] + K >= MIN_SPAN:
            out.append((p[c], q[c]))
    if not runs:
        return out
    holder = {x: i for i, (ps, qs) in enumerate(out) for x in zip(ps.tolist(), qs.tolist(), strict=True)}
    ends = [((a, b), (a + c - K, b + c - K)) for a, b, c in runs]
    left = sorted((a, -c, i) for i, ((a, _, c), (x, y)) in enumerate(zip(runs, ends, strict=True)) if holder.get(x, -1) != holder.get(y, -2))
    # Of runs that overlap, the one that reaches farthest from within the words covered so far is next.
    covered, at = -1, 0
    while at < len(left):
        within, best = max(covered, left[at][0]), (covered, -1)
        while at < len(left) and left[at][0] <= within:
            best = max(best, (left[at][0] - left[at][1], left[at][2]))
            at += 1
        if best[0] > covered:
            covered = best[0]
            out.append(rungs[best[1]])
    return out


def _chain(batches, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP):
    """Anchors sorted by (doc, hub, p, q) to chains.  A pair's anchors are held together: as many as a text has seeds."""
    held: list[tuple] = []
    key, count = None, 0

    def close():
        if not held:
            return
        p, q, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if len(p) < 2 and not n.any():
            return
        for ps, qs in paired_chains(p, q, n, gap_cost, max_gap):
            yield (*key, int(ps[0]), int(ps[-1]) + K, int(qs[0]), int(qs[-1]) + K, ps.tolist(), qs.tolist())

    def batch_of(rows):
        from pyspark import TaskContext

        nonlocal count
        base = (TaskContext.get().partitionId() << 36) + count
        count += len(rows)
        doc, hub, p0, p1, q0, q1, ps, qs = zip(*rows, strict=True)
        ints = [pa.array(x, pa.int32()) for x in (p0, p1, q0, q1)]
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(hub, pa.int64()), pa.array(np.arange(base, base + len(rows))), *ints, pa.array(ps, pa.list_(pa.int32())), pa.array(qs, pa.list_(pa.int32()))], names=names)

    names = ["doc", "hub", "chain", "p0", "p1", "q0", "q1", "ps", "qs"]
    rows: list[tuple] = []
    for batch in batches:
        doc, hub, p, q, n = (batch.column(i).to_numpy() for i in range(5))
        if not len(doc):
            continue
        at = np.concatenate(([0], np.flatnonzero((doc[1:] != doc[:-1]) | (hub[1:] != hub[:-1])) + 1, [len(doc)]))
        for a, b in zip(at[:-1], at[1:], strict=True):
            if (doc[a], hub[a]) != key:
                rows += close()
                key = (int(doc[a]), int(hub[a]))
            held.append((p[a:b], q[a:b], n[a:b]))
        if len(rows) > 5000:
            yield batch_of(rows)
            rows = []
    rows += close()
    if rows:
        yield batch_of(rows)


def _stretches(batches):
    """Texts with their roles to the hashed words around each chain: chain, side, first place, words."""
    for batch in batches:
        roles = batch.column(1).to_pylist()
        out: list[tuple] = []
        for row, to, data, offsets in slices(batch.column(0)):
            starts, ends, first = word_bounds(data, offsets)
            words = word_hashes(data, starts, ends)
            for i in range(to - row):
                own = words[first[i] : first[i + 1]]
                for r in roles[row + i]:
                    a = max(0, r["a"] - MARGIN)
                    out.append((r["chain"], r["side"], a, own[a : r["b"] + MARGIN].tobytes()))
                    if len(out) >= 2000:
                        yield _stretch_batch(out)
                        out = []
        if out:
            yield _stretch_batch(out)


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chain", "side", "a", "words"])


def _grown(same: np.ndarray) -> tuple[int, int]:
    """How far an end extends over (mis)matches, scores +1 and -2, dropping out at 8 below the best: length, matches."""
    if not len(same):
        return 0, 0
    run = np.cumsum(np.where(same, 1, -2))
    out = np.flatnonzero(run < np.maximum.accumulate(np.maximum(run, 0)) - 8)
    run = run[: out[0]] if len(out) else run
    if not len(run) or run.max() <= 0:
        return 0, 0
    n = int(np.argmax(run)) + 1
    return n, int(same[:n].sum())


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence of two gaps (of MAX_GAP words at most)."""
    if len(x) == len(y):
        equal = int((x == y).sum())
        if equal >= len(x) - 1 or not len(x):
            return equal
    row = [0] * (len(y) + 1)
    ys = y.tolist()
    for a in x.tolist():
        diagonal = 0
        for j, b in enumerate(ys, 1):
            keep = row[j]
            row[j] = diagonal + 1 if a == b else max(row[j], row[j - 1])
            diagonal = keep
    return row[-1]


def align(x: np.ndarray, y: np.ndarray, ps: np.ndarray, qs: np.ndarray, grow: bool = True) -> tuple[int, int, int, int, int]:
    """(start, end) in x, (start, end) in y, matching words: a chain's anchors, the gaps between and both ends grown."""
    p, q = int(ps[0]), int(qs[0])
    matches, end_p, end_q = 0, p, q
    for a, b in zip(ps.tolist(), qs.tolist(), strict=True):
        gap_p, gap_q = a - end_p, b - end_q
        if gap_p > 0 and gap_q > 0:
            matches += _common(x[end_p:a], y[end_q:b])
        skip = max(0, -min(gap_p, gap_q))
        matches += max(0, K - skip)
        end_p, end_q = a + K, b + K
    if not grow:
        return p, end_p, q, end_q, matches
    n = min(p, q)
    left, more = _grown((x[p - n : p] == y[q - n : q])[::-1])
    matches += more
    n = min(len(x) - end_p, len(y) - end_q)
    right, more = _grown(x[end_p : end_p + n] == y[end_q : end_q + n])
    return p - left, end_p + right, q - left, end_q + right, matches + more


def _kept(s: int, e: int, t: int, f: int, matches: int) -> bool:
    long = max(e - s, f - t)
    return min(e - s, f - t) >= MIN_WORDS * IDENTITY and long >= MIN_WORDS and matches >= IDENTITY * long


def aligned(x: np.ndarray, y: np.ndarray, ps: np.ndarray, qs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The alignments of a chain: the whole, or if too few words of it match its best parts.

    A part's score is that of its matches at 1 - IDENTITY each less IDENTITY for each other word.
    """
    whole = align(x, y, ps, qs)
    if _kept(*whole):
        return [whole]
    out, todo = [], [(0, len(ps))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        best, score, begin, span = 0.0, 0.0, lo, (lo, lo)
        for i in range(lo, hi):
            if i > lo:
                gap = align(x, y, ps[i - 1 : i + 1], qs[i - 1 : i + 1], False)
                score += gap[4] - K - IDENTITY * (max(gap[1] - gap[0], gap[3] - gap[2]) - K)
            if i == lo or score <= 0:
                score, begin = K * (1 - IDENTITY), i
            if score > best:
                best, span = score, (begin, i + 1)
        a, b = span
        for grow in (True, False):
            part = align(x, y, ps[a:b], qs[a:b], grow)
            if _kept(*part):
                out.append(part)
                break
        todo += [(lo, a), (b, hi)]
    return out


def _align(batches):
    """Both stretches of each chain, sorted by (chain, side), to aligned passages."""
    waiting = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            chain, side, a, words, doc, hub, ps, qs = row
            if side == 0:
                waiting = row
                continue
            if waiting is None or waiting[0] != chain:
                continue
            a0, x, y = waiting[2], np.frombuffer(waiting[3], np.uint64), np.frombuffer(words, np.uint64)
            for s, e, t, f, matches in aligned(x, y, np.array(waiting[6]) - a0, np.array(waiting[7]) - a):
                out.append((waiting[4], s + a0, e + a0, waiting[5], t + a, f + a, matches))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "matches"])


_PASSAGE = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int, matches int"


def _own_ids(texts: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """Texts with ids that stand for one text each, and for the ids made for that: id, doc_id (None if there are none).

    Where a doc_id has several texts, that of the least hash keeps it and the others get ids of their own, above 2^62.
    """
    hashed = texts.withColumn("h", F.xxhash64("text"))
    several = work.write(hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id", "low"), "several")
    if not several.take(1):
        return texts, None
    own = F.when(F.col("low").isNull() | (F.col("h") == F.col("low")), F.col("doc_id")).otherwise(F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 2))
    told = hashed.join(maybe_broadcast(several), "doc_id", "left").select(own.alias("id"), "doc_id", "text")
    made = work.write(told.where(F.col("id") >= F.lit(1 << 62)).select("id", "doc_id").distinct(), "made")
    return told.select(F.col("id").alias("doc_id"), "text"), made


def _passages(texts: DataFrame, anchors: DataFrame, work: Workspace, turn: str, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> DataFrame:
    """The aligned passages of all pairs that have anchors, written."""
    parts = partitions(texts.sparkSession)
    # A pair's anchors go to one task, in order; there are as many as the document has seeds at most.
    paired = anchors.repartition(parts, "doc", "hub").sortWithinPartitions("doc", "hub", "p", "q")
    chain = work.write(paired.mapInArrow(partial(_chain, gap_cost=gap_cost, max_gap=max_gap), _CHAIN), f"{turn}_chains")
    roles = chain.select("chain", F.lit(0).alias("side"), F.col("doc").alias("id"), F.col("p0").alias("a"), F.col("p1").alias("b")).union(
        chain.select("chain", F.lit(1).alias("side"), F.col("hub").alias("id"), F.col("q0").alias("a"), F.col("q1").alias("b"))
    )
    # A source of many passages has its roles in lists of about LIST, so that its text isn't sent for each.
    many = work.write(roles.groupBy("id").agg(F.ceil(F.count("*") / LIST).cast("int").alias("lists")).where("lists > 1"), f"{turn}_many")
    dealt = roles.join(maybe_broadcast(many), "id", "left").withColumn("list", F.pmod(F.xxhash64("chain"), F.coalesce("lists", F.lit(1)))).repartition(parts, "id", "list")
    listed = dealt.groupBy("id", "list").agg(F.collect_list(F.struct("chain", "side", "a", "b")).alias("roles"))
    listed = work.write(listed.select("id", "roles"), f"{turn}_roles")
    met = texts.join(maybe_broadcast(listed), F.col("doc_id") == F.col("id")).select("text", "roles")
    stretches = met.mapInArrow(_stretches, "chain long, side int, a int, words binary")
    both = stretches.join(chain.select("chain", "doc", "hub", "ps", "qs"), "chain").select("chain", "side", "a", "words", "doc", "hub", "ps", "qs")
    both = both.repartition(parts, "chain").sortWithinPartitions("chain", "side", "a")
    found = work.write(both.mapInArrow(_align, _PASSAGE), f"{turn}_found")
    work.drop(f"{turn}_chains", f"{turn}_roles")
    return found


def _open_cells(anchors: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """doc, cells: cells of each document that anchors touch but no passage of it covers, at least two side by side.
    """
    cell = lambda c: F.floor(F.col(c) / CELL)
    last = F.when(F.col("n") > 0, F.col("p") + F.col("n") - 1).otherwise(F.col("p"))
    touched = anchors.select("doc", F.explode(F.sequence(cell("p"), F.floor(last / CELL))).alias("cell")).distinct()
    # Cells count as covered from half on.
    covered = found.select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.floor((F.col("start_word") + CELL // 2) / CELL), F.floor((F.col("end_word") - CELL // 2) / CELL))).alias("cell")).distinct()
    order = W.partitionBy("doc").orderBy("cell")
    beside = (F.col("cell") - F.lag("cell").over(order) == 1) | (F.lead("cell").over(order) - F.col("cell") == 1)
    cells = touched.join(covered, ["doc", "cell"], "left_anti").withColumn("beside", beside).where("beside")
    return work.write(cells.groupBy("doc").agg(F.sort_array(F.collect_list("cell")).alias("cells")), "open")


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, start_word, end_word, source_doc_id, source_start, source_end, matches: passages that stand in another document.

    A passage has MIN_WORDS words or more, IDENTITY of them matching; its source is the document of the smallest id
    among those that share its seeds or MIN_WORDS equal words of it, or where these hold too little of it to be a passage, the
    smallest or the next smaller of those that share its links, so a passage of n documents gives n - 1 rows or a few
    more, not n * n.  Every stretch of MIN_WORDS or more equal words is found, wherever it stands and as often as it
    does; edited passages are found by seeds, with a chance that the README states by edits.  Places count words from 0,
    ends exclusive.

    Texts are read whole, however long.  Null or empty texts, texts of fewer than MIN_WORDS words and null ids take no part.
    Rows that repeat a doc_id and its text count once; different texts of one doc_id are documents of their own, but what
    they share with each other is not reported, and of them the text of the least hash goes by the id's order and the
    others last.  Repeats within a document are not looked for.  Of sources that tie the smallest id counts.  An empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "passages")
    parts = partitions(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    texts, made = _own_ids(texts, work)
    packed = texts.mapInArrow(_seeds(2 * parts), "bucket int, keys binary, docs binary, places binary").repartition(parts, "bucket")
    grams = texts.mapInArrow(_grams(4 * parts), "bucket int, docs binary, places binary, counts binary, low binary, high binary").repartition(parts, "bucket")
    anchors = work.write(packed.mapInArrow(_anchors, _ANCHOR), "anchors").union(work.write(grams.mapInArrow(_exact, _ANCHOR), "runs"))
    found = _passages(texts, anchors, work, "first")
    open_cells = _open_cells(anchors, found, work)
    work.drop("anchors", "runs")
    if open_cells.take(1):
        bound = texts.join(maybe_broadcast(open_cells), F.col("doc_id") == F.col("doc")).select("doc_id", "text", "cells")
        links = bound.mapInArrow(_links(2 * parts), "bucket int, links binary, docs binary, ps binary, rs binary").repartition(parts, "bucket")
        met = work.write(links.mapInArrow(_meetings, _ANCHOR), "met")
        found = found.union(_passages(texts, met, work, "second", FAR_COST, FAR_GAP))
    if made is not None:
        back = lambda df, c: df.join(maybe_broadcast(made.select(F.col("id").alias(c), F.col("doc_id").alias("own_"))), c, "left").withColumn(c, F.coalesce("own_", c)).drop("own_")
        found = back(back(found, "doc_id"), "source_doc_id").where("doc_id <> source_doc_id").select(found.columns)
    # Rows that repeat a doc_id give a passage once.
    once = W.partitionBy("doc_id", "start_word", "end_word", "source_doc_id").orderBy("source_start", "source_end")
    return found.withColumn("row", F.row_number().over(once)).where("row = 1").drop("row")
