"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles.  Two kinds of sketches are XORs over the set:

* a bit sketch, in which every shingle flips one bit, so that the Hamming distance of two sketches never exceeds the
  sets' symmetric difference; it has about two bits a shingle, and the halves of a longer sketch XOR to a shorter one;
* part sketches: a size band [2^j, 2^(j+1)) cuts the hash space into parts, and a part's sketch is the XOR of the 64-bit
  hashes in it.

With similarity of at least t, a set of n differs from a partner by n (1/t - 1) shingles at most, and each damages one
part.  So of the non-empty parts, put in an order that both sets share, the first d + 1 = floor(n (1/t - 1)) + 1 hold one
sketch in common: the pigeonhole join loses no link.  The order is rarest first: sketches are counted over all sets, and a
set with more than d sketches of its own has no partner and goes.  A set within 1/t above a band's lower end also emits the
sketches of the band below.

Sets that share a part sketch meet that of the least fingerprint among them, which gives one candidate an entry.  What
these and their bit sketches can't rule out is verified on the sets themselves, and links make components.  Sketches
whose holders still lie in several components are then searched for links across components, bit sketch by bit sketch,
in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Workspace, maybe_broadcast, partitions
from .components import components
from .words import U64, Buckets, gathered, mix, slices, trimmed, windows, word_bounds, word_hashes

#: Least bits of a bit sketch.
BITS = 512
#: Bands below 2^SMALL cut the hash space finely enough that a part holds a shingle or two.
SMALL, FINE = 6, 16
#: Part sketches that a task packs at once.
CHUNK = 1 << 18
#: Pairs of a class that are verified in the first turn, and how many times more in each one after.
MOST, MORE = 16, 16
#: Times that groups are asked for pairs across components, two a set, before all such pairs are compared.
TURNS = 2
#: Sets that are compared with each other in one go.
BLOCK = 2048
HUB = 256


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) for every row; no words: empty; fewer than k words: the sequence as one."""
    for row, to, data, offsets in slices(column):
        starts, ends, first = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = windows(words, range(k))
        for i in range(to - row):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield row + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield row + i, mix(windows(words[a:b], range(b - a)), 100 + int(b - a))
            else:
                yield row + i, np.zeros(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """A sum and an XOR over the set, as signed 64-bit numbers: equal sets have equal ones."""
    if not len(hashes):
        return 0, 0
    two = np.array([mix(hashes, 21).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(hashes, 22))], np.uint64).view(np.int64)
    return int(two[0]), int(two[1])


def bit_sketch(hashes: np.ndarray) -> bytes:
    """The parity of each bit; the number of bits is that of the size band."""
    bits = max(BITS, 1 << len(hashes).bit_length())
    odd = (np.bincount((hashes & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to so many: bits that a shorter sketch doesn't tell apart are XORed."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def spread(percent: int) -> int:
    """log2 of a band's parts for each 2^j of its sizes: enough that non-empty parts outnumber damaged ones.

    With a load of x shingles a part, (1 - exp(-x)) / x parts a shingle are non-empty and 1/t - 1 are damaged at most;
    a set that emits over the band below has a load of 2.5 at most before it is spread.
    """
    if not 60 <= percent <= 100:
        raise ValueError("a similarity from 60 to 100 %")
    for s in range(16):
        load = 2.5 / 2**s
        if (1 - np.exp(-load)) / load >= 1.3 * (100 - percent) / percent:
            return s
    raise AssertionError(percent)


def part_keys(hashes: np.ndarray, percent: int, wider: int) -> list[np.ndarray]:
    """For each band over which a set emits: the hashed sketches of all its non-empty parts."""
    n = len(hashes)
    band = n.bit_length() - 1
    out = []
    for j in [band] + [band - 1] * (band > 0 and n * percent < 100 << band):
        part = hashes >> U64(64 - (j + (wider if j >= SMALL else FINE)))
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        xor = np.bitwise_xor.reduceat(mix(hashes, 7), at)
        out.append(mix(xor ^ mix(part[at], 2000 + j), 3000 + j))
    return out


def _first(k: int):
    """A document's size, fingerprint and bit sketch."""

    def run(batches):
        for batch in batches:
            rows = [(len(hashes), *fingerprint(hashes), bit_sketch(hashes)) for _, hashes in shingle_sets(batch.column(1), k)]
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n", "f1", "f2", "sketch"])

    return trimmed(run)


# Counting.  A unit is a set over one of its bands; a chunk holds the units of which a task packs the sketches at once.  kind 0
# rows hold a chunk's sketches of one bucket: 40 bits of each, its first unit in the chunk and how often the chunk has it.
# kind 1 rows hold the chunk's units (fingerprint, sketches, damage) and the further units of sketches that repeat in it.
_PACKED = "kind int, bucket int, chunk long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"
_NAMES = ["kind", "bucket", "chunk", "c0", "c1", "c2", "c3", "c4"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _sketches(buckets: int, k: int, percent: int, wider: int):
    """All part sketches of each set, once a task, packed for counting."""

    def run(batches):
        from pyspark import TaskContext

        chunk, seen = TaskContext.get().partitionId() << 24, set()
        units, keys, count = [], [], 0

        def packed():
            nonlocal chunk, count
            every, unit = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            order = np.argsort(every, kind="stable")
            every, unit = every[order], unit[order].astype("<u4")
            new = np.concatenate(([True], every[1:] != every[:-1]))
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at, len(every))), 65535)
            short = _short(every, buckets)
            own = [np.array(x, t).tobytes() for x, t in zip(zip(*units, strict=True), ("<i8", "<u4", "<u4"), strict=True)]
            rows = [(1, int(chunk % buckets), chunk, *own, unit[~new].tobytes(), short[~new].astype("<u8").tobytes())]
            bucket, part, first = (every[at] % U64(buckets)).astype(np.int64), short[at] & U64((1 << 40) - 1), unit[at]
            order = np.lexsort((first, bucket))
            bucket, part, first, times = bucket[order], part[order], first[order], times[order]
            bounds = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                i, j = bounds[b], bounds[b + 1]
                rows.append((0, int(b), chunk, (part[i:j] & U64(0xFFFFFFFF)).astype("<u4").tobytes(), (part[i:j] >> U64(32)).astype(np.uint8).tobytes(), first[i:j].tobytes(), times[i:j].astype("<u2").tobytes(), None))
            units.clear()
            keys.clear()
            chunk, count = chunk + 1, 0
            return _rows(rows)

        for batch in batches:
            known = batch.column(0).is_valid().to_pylist()
            for i, hashes in shingle_sets(batch.column(1), k):
                n = len(hashes)
                if not n or not known[i]:
                    continue
                tag = (n, *fingerprint(hashes))
                if tag in seen:
                    continue
                seen.add(tag)
                for own in part_keys(hashes, percent, wider):
                    units.append((tag[1], len(own), n * (100 - percent) // percent))
                    keys.append(own)
                    count += len(own)
                if count >= CHUNK:
                    yield packed()
        if count:
            yield packed()

    return trimmed(run)


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A sketch as its bucket and the first 40 bits of it: what tells sketches apart from here on."""
    return (keys % U64(buckets)) << U64(40) | keys >> U64(24)


def _counted(buckets: int):
    """Sketches that several units hold go back to their chunks, with their count; rows of units pass."""

    def run(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for kind, bucket, chunk, *columns in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if kind == 1:
                    yield _rows([(1, chunk % buckets, chunk, *columns)])
                else:
                    held.setdefault(bucket, []).append((chunk, *columns[:4]))
        back = Buckets(buckets, (np.uint64, np.uint32, np.uint64, np.uint32))
        for bucket in list(held):
            chunks, *columns = zip(*held.pop(bucket), strict=True)
            low, high, unit, times = (np.frombuffer(b"".join(x), t) for x, t in zip(columns, ("<u4", np.uint8, "<u4", "<u2"), strict=True))
            chunk = np.repeat(np.array(chunks, np.uint64), [len(x) // 4 for x in columns[0]])
            part = high.astype(np.uint64) << U64(32) | low
            order = np.argsort(part)
            part = part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            total = np.add.reduceat(times[order].astype(np.int64), at)
            count = np.repeat(total, np.diff(np.append(at, len(part))))
            some = count > 1
            back.add(chunk[order][some], chunk[order][some], unit[order][some], part[some] | U64(bucket) << U64(40), np.minimum(count[some], 2**32 - 1))
            if back.full():
                yield from _returned(back)
        yield from _returned(back)

    return trimmed(run)


def _returned(back: Buckets):
    rows = [(0, b, None, *columns, None) for b, *columns in back.take()]
    if rows:
        yield _rows(rows)


# An entry says that a set (its fingerprint f1) emits a key.  Keys of more than 2^hot sets are dealt in 2^salts parts by the
# set's last bits, so no task gathers all holders of one.
_ENTRY = (np.uint64, np.uint64, np.uint8)


def _salt(sets: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return sets & ((U64(1) << salts.astype(np.uint64)) - U64(1))


def _where(keys: np.ndarray, sets: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(_salt(sets, salts), 41), 42)


def _entries(buckets: int, hot: int):
    """The d + 1 rarest sketches of each unit, less those that it alone holds."""

    def run(batches):
        packed, units, held = Buckets(buckets, _ENTRY), {}, {}
        for batch in batches:
            for kind, bucket, chunk, *columns in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if kind == 1:
                    units.setdefault(bucket, []).append((chunk, *columns))
                else:
                    held.setdefault(bucket, []).append(columns[:4])
        for bucket, own in units.items():
            columns = zip(*held.pop(bucket, [(b"", b"", b"", b"")]), strict=True)
            chunks, unit, key, count = (np.frombuffer(b"".join(x), t) for x, t in zip(columns, ("<u8", "<u4", "<u8", "<u4"), strict=True))
            order = np.lexsort((key, chunks))
            chunks, unit, key, count = (x[order] for x in (chunks, unit, key, count))
            for chunk, *fields in own:
                sets, sizes, damage, more, again = (np.frombuffer(x, t) for x, t in zip(fields, ("<u8", "<u4", "<u4", "<u4", "<u8"), strict=True))
                a, b = np.searchsorted(chunks, np.array([chunk, chunk + 1], np.uint64))
                u, x, c = unit[a:b], key[a:b], count[a:b]
                if len(again):
                    u, x, c = np.concatenate((u, more)), np.concatenate((x, again)), np.concatenate((c, c[np.searchsorted(x, again)]))
                shared = np.bincount(u, minlength=len(sets))
                left = damage.astype(np.int64) + 1 - (sizes.astype(np.int64) - shared)
                at = np.flatnonzero(left[u] > 0)
                at = at[np.lexsort((x[at], c[at], u[at]))]
                begin = np.flatnonzero(np.concatenate(([True], u[at][1:] != u[at][:-1]))) if len(at) else at
                rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                at = at[rank < left[u[at]]]
                salts = np.maximum(0, np.ceil(np.log2(np.maximum(c[at], 1))).astype(np.int64) - hot).astype(np.uint8)
                packed.add(_where(x[at], sets[u[at]], salts), x[at], sets[u[at]], salts)
            if packed.full():
                yield from packed.batch("keys", "sets", "salts")
        yield from packed.batch("keys", "sets", "salts")

    return trimmed(run)


def _grouped(keys: np.ndarray, sets: np.ndarray, salts: np.ndarray, *more: np.ndarray):
    """Distinct entries in the order of their groups, and the group of each."""
    salt = _salt(sets, salts)
    order = np.lexsort((sets, salt, keys))
    keys, sets, salts, salt, *more = (x[order] for x in (keys, sets, salts, salt, *more))
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (salt[1:] != salt[:-1])))[: len(keys)]
    fresh = new | np.concatenate(([True], sets[1:] != sets[:-1]))[: len(keys)]
    return (np.cumsum(new) - 1)[fresh], *(x[fresh] for x in (keys, sets, salts, *more))


def _members(buckets: int):
    """Entries of groups of two sets or more, and all of salted keys, each with its group's least set; packed by set."""

    def run(batches):
        packed = Buckets(buckets, (np.uint64, np.uint64, np.uint64, np.uint8))
        for keys, sets, salts in gathered(batches, _ENTRY):
            group, keys, sets, salts = _grouped(keys, sets, salts)
            if not len(group):
                continue
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            size = np.diff(np.append(first, len(group)))
            keep = (size[group] > 1) | (salts > 0)
            packed.add(sets[keep], keys[keep], sets[keep], sets[first][group][keep], salts[keep])
            if packed.full():
                yield from packed.batch("keys", "sets", "hubs", "salts")
        yield from packed.batch("keys", "sets", "hubs", "salts")

    return trimmed(run)


def _stars(batches):
    """a, b: each set with the least ones of its groups, once; a, key: the least ones of a salted key's parts."""
    for keys, sets, hubs, salts in gathered(batches, (np.uint64, np.uint64, np.uint64, np.uint8)):
        pairs = np.unique(np.stack((hubs, sets), 1)[hubs != sets], axis=0)
        some = (salts > 0) & (hubs == sets)
        n = int(some.sum())
        a = np.concatenate((pairs[:, 0], sets[some])).view(np.int64)
        b = pa.chunked_array([pa.array(pairs[:, 1].view(np.int64)), pa.nulls(n, pa.int64())]).combine_chunks()
        key = pa.chunked_array([pa.nulls(len(pairs), pa.int64()), pa.array(keys[some].view(np.int64))]).combine_chunks()
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), b[i : i + (1 << 16)], key[i : i + (1 << 16)]], names=["a", "b", "key"])


def _packed_labels(buckets: int):
    """(set, label) rows, packed by set."""

    def run(batches):
        packed = Buckets(buckets, (np.uint64, np.int64))
        for batch in batches:
            sets = batch.column(0).to_numpy().view(np.uint64)
            packed.add(sets, sets, batch.column(1).to_numpy())
            if packed.full():
                yield from packed.batch("of", "labels")
        yield from packed.batch("of", "labels")

    return trimmed(run)


def _packed_keys(buckets: int):
    """(key, set, salts) rows as marks of salted groups, packed by group."""

    def run(batches):
        packed = Buckets(buckets, (np.uint64,))
        for batch in batches:
            keys, sets, salts = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy().astype(np.uint8)
            packed.add(_where(keys, sets, salts), keys)
            if packed.full():
                yield from packed.batch("wanted")
        yield from packed.batch("wanted")

    return trimmed(run)


def _labelled_entries(buckets: int):
    """Entries and labels that meet in a set's bucket to entries with labels, packed by group again."""

    def run(batches):
        packed = Buckets(buckets, (*_ENTRY, np.int64))
        for keys, sets, salts, of, labels in gathered(batches, (*_ENTRY, np.uint64, np.int64)):
            if not len(keys):
                continue
            order = np.argsort(of)
            at = order[np.searchsorted(of[order], sets)]
            packed.add(_where(keys, sets, salts), keys, sets, salts, labels[at])
            if packed.full():
                yield from packed.batch("keys", "sets", "salts", "labels")
        yield from packed.batch("keys", "sets", "salts", "labels")

    return trimmed(run)


def _runs(keys: np.ndarray, sets: np.ndarray, salts: np.ndarray, labels: np.ndarray):
    """Entries by group and label: group, keys, sets, salts, labels, and where groups and their labels begin."""
    group, keys, sets, salts, labels = _grouped(keys, sets, salts, labels)
    order = np.lexsort((sets, labels, group))
    group, keys, sets, salts, labels = (x[order] for x in (group, keys, sets, salts, labels))
    new = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
    fresh = new | np.concatenate(([True], labels[1:] != labels[:-1]))[: len(group)]
    return group, keys, sets, salts, labels, np.flatnonzero(new), np.flatnonzero(fresh)


def _partners(turn: int):
    """a, b: each set of a group of several labels with two of other labels, the least and the next in an order of the
    turn; a, key, label, salts: a set for each label of a salted group."""

    def run(batches):
        for keys, sets, salts, labels in gathered(batches, (*_ENTRY, np.int64)):
            if not len(keys):
                continue
            group, keys, sets, salts, labels, first, fresh = _runs(keys, sets, salts, labels)
            kinds = np.diff(np.append(np.searchsorted(fresh, first), len(fresh)))
            some = fresh[salts[fresh] > 0]
            split = [x[some] for x in (sets.view(np.int64), keys.view(np.int64), labels, salts.astype(np.int32))]
            mixed = kinds[group] > 1
            group, sets, labels = group[mixed], sets[mixed], labels[mixed]
            pairs = np.zeros((0, 2), np.int64)
            if len(group):
                pairs = np.concatenate([_others(group, sets, labels, sets), _others(group, sets, labels, mix(sets, 50 + turn))])
                pairs = np.unique(np.sort(pairs, axis=1), axis=0).view(np.int64)
            n = len(some)
            join = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
            a = join(pa.array(pairs[:, 0]), pa.array(split[0]))
            b = join(pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()))
            rest = [join(pa.nulls(len(pairs), t), pa.array(x, t)) for x, t in zip(split[1:], (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([x[i : i + (1 << 16)] for x in (a, b, *rest)], names=["a", "b", "key", "label", "salts"])

    return trimmed(run)


def _others(group: np.ndarray, sets: np.ndarray, labels: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each set of mixed groups with the next one of another label in the cyclic order ``by``."""
    order = np.lexsort((by, group))
    group, sets, labels = group[order], sets[order], labels[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    run = np.flatnonzero(new | np.concatenate(([True], labels[1:] != labels[:-1])))
    of = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(group))))
    first = np.searchsorted(run, np.flatnonzero(new))
    first_of, last_of = first[np.cumsum(new)[run] - 1], np.append(first[1:], len(run))[np.cumsum(new)[run] - 1] - 1
    after = np.arange(len(run)) + 1
    # The last run of a group is followed by its first, or where that has the same label, by its second.
    wrapped = np.where(labels[run[first_of]] == labels[run], first_of + 1, first_of)
    after = np.where(np.arange(len(run)) == last_of, wrapped, after)
    return np.stack((sets, sets[run[after]][of]), 1)


def _mixed(batches):
    """key, set, label: the entries of groups of several labels, and of salted groups that are marked."""
    for keys, sets, salts, labels, wanted in gathered(batches, (*_ENTRY, np.int64, np.uint64)):
        if not len(keys):
            continue
        group, keys, sets, salts, labels, first, fresh = _runs(keys, sets, salts, labels)
        kinds = np.diff(np.append(np.searchsorted(fresh, first), len(fresh)))
        keep = np.where(salts > 0, np.isin(keys, wanted), kinds[group] > 1)
        keys, sets, labels = keys[keep].view(np.int64), sets[keep].view(np.int64), labels[keep]
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (keys, sets, labels)], names=["key", "set", "label"])


def _words_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sketches by their number of 64-bit words: places and rows."""
    data, by_size = column.to_pylist(), {}
    for i, x in enumerate(data):
        by_size.setdefault(len(x) // 8, []).append(i)
    return {w: (np.array(at), np.frombuffer(b"".join(data[i] for i in at), "<u8").reshape(len(at), w)) for w, at in by_size.items()}


def _lists_of(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as arrays."""
    flat, at = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _near(percent: int):
    """Pairs (ra, na, sa, rb, nb, sb) whose sizes and bit sketches allow a link, with their distance."""

    def run(batches):
        for batch in batches:
            ra, na, rb, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1, 3, 4))
            left, right = _words_of(batch.column(2)), _words_of(batch.column(5))
            away = np.full(len(ra), np.iinfo(np.int64).max)
            for x, (i, a) in left.items():
                for y, (j, b) in right.items():
                    at, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    if len(at):
                        w = min(x, y)
                        away[at] = np.bitwise_count(folded(a[p], w) ^ folded(b[q], w)).sum(1, dtype=np.int64)
            ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (away <= (na + nb) * (100 - percent) // (100 + percent))
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ra, rb)[ok]), pa.array(np.maximum(ra, rb)[ok]), pa.array(away[ok])], names=["a", "b", "distance"])

    return trimmed(run)


def _verify(k: int, percent: int):
    """Texts sorted by (key, salt, hubs first) to the pairs of a hub and a spoke that are similar enough."""

    def run(batches):
        hub_key, hubs = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            is_hub, docs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = []
            for i, own in shingle_sets(batch.column(4), k):
                if keys[i] != hub_key:
                    hub_key, hubs = keys[i], []
                if is_hub[i]:
                    if not any(len(own) == len(h) and (own == h).all() for h in hubs):
                        hubs.append(own)
                    continue
                for hub in hubs:
                    both = len(hub) + len(own)
                    same = both - len(np.unique(np.concatenate((hub, own))))
                    if 100 * same >= percent * (both - same) and both:
                        found.append((hub_key[0], docs[i]))
                        break
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return trimmed(run)


def _checked(texts: DataFrame, pairs: DataFrame, k: int, percent: int, parts: int, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.  A hub's pairs are dealt out HUB to a task, with the hub's text."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = work.write(counts.select("a", F.ceil(F.col("n") / HUB).cast("int").alias("salts")), f"{name}-hubs")
    spokes = pairs.join(maybe_broadcast(salts), "a").select(F.col("b").alias("doc"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(False).alias("hub"))
    hubs = salts.select(F.col("a").alias("doc"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("hub"))
    roles = work.write(spokes.union(hubs), f"{name}-roles")
    dealt = texts.join(maybe_broadcast(roles), F.col("doc_id") == F.col("doc")).select("key", "salt", "hub", "doc", "text")
    dealt = dealt.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", F.desc("hub"))
    return dealt.mapInArrow(_verify(k, percent), "a long, b long").distinct()


class _Search:
    """Links between classes of equal sets, by rep (the least doc_id of a class), and the components they make."""

    def __init__(self, texts: DataFrame, classes: DataFrame, work: Workspace, k: int, percent: int):
        self.texts, self.classes, self.work, self.k, self.percent = texts, classes, work, k, percent
        self.parts, self.turn = partitions(texts.sparkSession), 0
        self.labels: DataFrame | None = None
        self.tested: list[DataFrame] = []

    def label(self, df: DataFrame, node: str, label: str) -> DataFrame:
        """Adds a node's component, or the node itself."""
        if self.labels is None:
            return df.withColumn(label, F.col(node))
        own = self.labels.select(F.col("node").alias(node), F.col("component").alias(label))
        return df.join(maybe_broadcast(own), node, "left").withColumn(label, F.coalesce(label, node))

    def tie(self, links: DataFrame, name: str) -> None:
        """Adds links to the components."""
        if self.labels is not None:
            links = links.union(self.labels.select("node", "component"))
        self.labels = self.work.write(components(links, self.work, f"components-{name}"), f"labels-{name}")

    def candidates(self, sets: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of sets to waiting pairs of classes: those not tested yet that bit sketches can't rule out."""
        side = lambda x: self.classes.select(F.col("f1").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        pairs = sets.distinct().join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select("ra", "na", "sa", "rb", "nb", "sb")
        return self.waiting(pairs.mapInArrow(_near(self.percent), "a long, b long, distance long"), name)

    def waiting(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))
        for tested in self.tested:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        return self.work.write(pairs, f"waiting-{name}")

    def settle(self, waiting: DataFrame) -> None:
        """Verifies pairs, the best of each class first and MORE times as many each turn; a pair within a component is left out.

        The number of turns is the logarithm of the most pairs that a class has.
        """
        most = MOST
        while waiting.take(1):
            self.turn += 1
            name = str(self.turn)
            ranked = waiting.withColumn("rank", F.row_number().over(W.partitionBy("b").orderBy("distance", "a"))).where(F.col("rank") <= most).select("a", "b")
            now = self.work.write(ranked, f"now-{name}")
            self.tested.append(now)
            self.tie(self.work.write(_checked(self.texts, now, self.k, self.percent, self.parts, self.work, name), f"links-{name}"), name)
            rest = waiting.join(now, ["a", "b"], "left_anti")
            rest = self.label(self.label(rest, "a", "la"), "b", "lb").where("la <> lb").select("a", "b", "distance")
            waiting, most = self.work.write(rest, f"rest-{name}"), MORE * most

    def entries(self, members: DataFrame, buckets: int, name: str) -> DataFrame:
        """The entries with their sets' present labels, packed by group."""
        own = self.label(self.classes.select("f1", "rep"), "rep", "label").select("f1", "label")
        labels = own.mapInArrow(_packed_labels(buckets), "bucket int, of binary, labels binary")
        none = F.lit(None).cast("binary")
        both = members.select("bucket", "keys", "sets", "salts", none.alias("of"), none.alias("labels"))
        both = both.union(labels.select("bucket", none.alias("keys"), none.alias("sets"), none.alias("salts"), "of", "labels"))
        packed = both.repartition(self.parts, "bucket").mapInArrow(_labelled_entries(buckets), "bucket int, keys binary, sets binary, salts binary, labels binary")
        return self.work.write(packed, f"entries-{name}")

    def across(self, entries: DataFrame, hot: DataFrame, buckets: int) -> DataFrame:
        """Pairs across labels, within groups of several labels, that sizes and bit sketches allow.

        Sets of a group's largest label need no comparison with each other, so only the others are met with all, in
        blocks of BLOCK sets.  A pair that shares several keys is given in the group of the least of them alone, for which
        each set brings its keys along: n / 4 at most.
        """
        spans = hot.select("key", "salts").distinct().select("key", F.explode(F.expr("sequence(0L, shiftleft(1L, salts) - 1)")).alias("set"), "salts")
        marks = spans.mapInArrow(_packed_keys(buckets), "bucket int, wanted binary")
        none = F.lit(None).cast("binary")
        both = entries.select("*", none.alias("wanted")).union(marks.select("bucket", none.alias("k"), none.alias("s"), none.alias("t"), none.alias("l"), "wanted"))
        rows = self.work.write(both.repartition(self.parts, "bucket").mapInArrow(_mixed, "key long, set long, label long"), "mixed")
        sizes = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max("c").alias("top"), F.max_by("label", F.struct("c", "label")).alias("major"))
        plan = sizes.select("key", "major", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.greatest(F.ceil((F.col("size") - F.col("top")) / BLOCK), F.lit(1)).cast("int").alias("minor_blocks"))
        plan = self.work.write(plan, "blocks")
        lists = rows.groupBy("set").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        full = rows.join(maybe_broadcast(plan), "key").join(lists, "set").join(self.classes.select(F.col("f1").alias("set"), "rep", "n", "sketch"), "set")
        full = full.select("key", "label", "rep", "n", "sketch", "keys", "blocks", "minor_blocks", (F.col("label") != F.col("major")).alias("minor"), F.xxhash64("set").alias("h"))
        picked = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = full.where("minor").select("key", picked("minor_blocks").alias("r"), every("blocks").alias("a"), F.lit(0).alias("side"), "minor", "label", "rep", "n", "sketch", "keys")
        right = full.select("key", every("minor_blocks").alias("r"), picked("blocks").alias("a"), F.lit(1).alias("side"), "minor", "label", "rep", "n", "sketch", "keys")
        dealt = left.union(right).repartition(self.parts, "key", "r", "a").sortWithinPartitions("key", "r", "a", "side")
        return dealt.mapInArrow(_block_pairs(self.percent), "a long, b long, distance long")


def _block_pairs(percent: int):
    """Rows sorted by (unit, side): a unit's left sets are held, its right ones compared with them as they come."""

    def run(batches):
        unit, held = None, []

        def compare(left: list[pa.RecordBatch], right: pa.RecordBatch):
            right_minor, right_label, right_rep, right_n = (right.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6, 7))
            theirs, key, right_keys = _words_of(right.column(8)), int(right.column(0)[0].as_py()), _lists_of(right.column(9))
            for part in left:
                label, rep, n = (part.column(i).to_numpy() for i in (5, 6, 7))
                keys = _lists_of(part.column(9))
                for x, (i, a) in _words_of(part.column(8)).items():
                    for y, (j, b) in theirs.items():
                        if not x // 2 <= y <= 2 * x:
                            continue
                        w = min(x, y)
                        mine, other = folded(a, w), folded(b, w)
                        for own, row in zip(i, mine, strict=True):
                            sizes = n[own].astype(np.int64) + right_n[j]
                            ok = (right_label[j] != label[own]) & (100 * np.minimum(right_n[j], n[own]).astype(np.int64) >= percent * np.maximum(right_n[j], n[own]).astype(np.int64))
                            # Of two sets outside the largest label, both of which stand on either side, one order counts.
                            ok &= ~right_minor[j] | (right_rep[j] > rep[own])
                            at = np.flatnonzero(ok)
                            if not len(at):
                                continue
                            away = np.bitwise_count(other[at] ^ row).sum(1, dtype=np.int64)
                            near = away <= sizes[at] * (100 - percent) // (100 + percent)
                            near[near] = [np.intersect1d(keys[own], right_keys[o], assume_unique=True)[0] == key for o in j[at][near]]
                            if near.any():
                                theirs_rep = right_rep[j][at][near]
                                yield np.minimum(theirs_rep, rep[own]), np.maximum(theirs_rep, rep[own]), away[near]

        for batch in batches:
            if not batch.num_rows:
                continue
            key, r, a, side = (batch.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (r[1:] != r[:-1]) | (a[1:] != a[:-1]) | (side[1:] != side[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
                this = (key[lo], r[lo], a[lo])
                if this != unit:
                    unit, held = this, []
                part = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    held.append(part)
                else:
                    out += compare(held, part)
            if out:
                pairs = np.unique(np.stack([np.concatenate(z) for z in zip(*out, strict=True)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(3)], names=["a", "b", "distance"])

    return trimmed(run)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, work: Workspace | None = None, hot: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id: groups of documents linked by 100 * |A n B| >= percent * |A u B|.

    Sets that are equal are one class, so copies are never paired.  Classes that share a part sketch are met with the
    least of them only; after components are known, groups that still span several are searched across these alone.
    What is returned equals the components over all links.  A sketch that may have more than 2^hot holders is dealt out
    by holder, so no group passes through one task.

    Texts are read whole, whatever their length.  Null or empty text, or white space alone: 0 shingles, linked with
    nothing.  Null doc_ids keep their row, linked with nothing and component_id null.  Rows with one doc_id count as one
    document: any of their texts links it.  Ties need no rule: a component's id is its least doc_id.  An empty table gives
    an empty result; other columns are not read, whatever their names.  Needs percent of 60 or more.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "jaccard")
    parts, wider = partitions(spark), spread(percent)
    buckets = 2 * parts
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = work.write(texts.mapInArrow(_first(k), "doc_id long, n int, f1 long, f2 long, sketch binary"), "first")
    same = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1 and rep is not null")
    same = work.write(same.drop("copies"), "same")
    reps = rows.join(maybe_broadcast(same), ["n", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = work.write(reps, "reps")
    work.drop("first")
    classes = work.write(reps.where("n > 0 and doc_id = rep").select("rep", "n", "f1", "f2", "sketch").dropDuplicates(["rep", "n", "f1", "f2"]).drop("f2"), "classes")

    counted = texts.mapInArrow(_sketches(buckets, k, percent, wider), _PACKED).repartition(parts, "bucket").mapInArrow(_counted(buckets), _PACKED)
    counted = work.write(counted, "counted").repartition(parts, "bucket")
    entries = counted.mapInArrow(_entries(buckets, hot), "bucket int, keys binary, sets binary, salts binary").repartition(parts, "bucket")
    members = work.write(entries.mapInArrow(_members(buckets), "bucket int, keys binary, sets binary, hubs binary, salts binary"), "members")
    work.drop("counted")

    search = _Search(texts, classes, work, k, percent)
    stars = work.write(members.select("bucket", "keys", "sets", "hubs", "salts").repartition(parts, "bucket").mapInArrow(_stars, "a long, b long, key long"), "stars")
    # The parts of a salted key meet at their least set.
    split = stars.where("key is not null").select("key", "a").distinct()
    low = split.groupBy("key").agg(F.min("a").alias("low"))
    met = split.join(low, "key").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    search.settle(search.candidates(stars.where("b is not null").select("a", "b").union(met), "stars"))

    for turn in range(TURNS):
        packed = search.entries(members, buckets, str(turn))
        partners = work.write(packed.repartition(parts, "bucket").select("bucket", "keys", "sets", "salts", "labels").mapInArrow(_partners(turn), "a long, b long, key long, label long, salts int"), f"partners-{turn}")
        split = partners.where("key is not null")
        ends = split.groupBy("key").agg(F.min(F.struct("label", "a")).alias("low"), F.max(F.struct("label", "a")).alias("high")).where("low.label <> high.label")
        held = split.join(ends, "key")
        met = held.select("a", F.when(F.col("label") == F.col("low.label"), F.col("high.a")).otherwise(F.col("low.a")).alias("b"))
        pairs = partners.where("b is not null").select("a", "b").union(met)
        waiting = search.candidates(pairs, f"partners-{turn}")
        if turn < TURNS - 1 and waiting.take(1):
            search.settle(waiting)
            continue
        search.settle(search.waiting(search.across(packed, held.select("key", "salts"), buckets), "across"))
        break

    # Rows with one doc_id and several texts tie the classes of those texts together.
    several = reps.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    if several.take(1):
        ties = reps.where("n > 0").join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
        search.tie(ties, "several")
    out = search.label(reps.select("doc_id", "n", "rep"), "rep", "component")
    alone = F.col("n") == 0
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
