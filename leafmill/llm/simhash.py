"""SimHash near-dedup with bit-sliced distance tests.

1. Each text becomes a 64-bit fingerprint (majority vote of shingle hashes); equal fingerprints collapse to one node.
2. Two fingerprints at ``radius`` or fewer differing bits agree on all but ``radius`` of ``radius + 2`` equal bit ranges, so
   they meet under a key made of some two of those ranges.  Keys that many fingerprints share are keyed again by ranges of the
   bits that the first key left out, and what is still large is cut into tiles of bounded size; every pair of tiles meets once.
3. Inside a tile the fingerprints stand as bit planes, one machine word holding one bit of 64 fingerprints.  Distances grow in
   carry-save counters, a word operation per plane, and a block is given up once all its lanes exceed the radius.
4. A tile reports a spanning set of its links; distributed components join them.

Copies at a Jaccard likeness of 0.8 differ in about 15 of 100 bits, far beyond a radius of 2.  ``near_copies`` finds them with
wider fingerprints over distinct shingles: texts whose fingerprints agree on one of many keys of sampled bits meet in a tile (the more texts,
the longer and the more the keys, so that the texts of a key stay as many),
and the same bit-sliced comparison names candidates within a loose radius.  Texts of few shingles, whose fingerprints say little,
meet under the least hashes of their shingle sets instead, of which two sets of the likeness share one without exception.  A
link is only what the shingle sets themselves confirm; the search for candidates among longer texts may miss, but for few pairs.

Defined results: a null or word-less text has fingerprint 0 and links like any other; repeated rows share everything; a null
doc_id takes part but never names a component (a component of null ids only has a null id); extra columns, whatever their names,
pass through where rows are dropped; empty input, empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.rows import free_names, numbered, place
from leafmill.operators.components import connected_components
from leafmill.staging import materialize, release

BITS = 64
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
CHUNK = 1 << 15
#: (query, word) pairs compared at a time.
PAIRS = 1 << 13
#: Wide fingerprints: 64-bit words, the least bits of a key, and the texts that a key's bits let meet on average once there are more.
WORDS, KEY_BITS, MEETING = 8, 13, 2048
#: Keys that link first, so that the others have only different components to link.
FIRST = 8
#: Keys broadcast at most, as hot ones.
HOT_KEYS = 200_000
#: Candidates differ in so many of 512 bits at most: a pair at a likeness of 0.8 differs in 77, give or take 8.
RADIUS = 115
#: Texts of so many distinct shingles or fewer are compared without fingerprints; shingles in a part of a tile of sets.
FEW, PART = 48, 400_000
#: Rows from which a tile is first thinned by pivots, and pivots tried.
DENSE, PIVOTS = 256, 64


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text: words between ASCII blanks, A-Z lower-cased, shingles of ``width`` words, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        line, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        stops = ends[min(width, len(part)) - 1 :].tolist()
        h = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, stops, strict=False)), "<u8", len(stops))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _remixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * word & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    shingles = (digest(b" ".join(words[i : i + width]), seed) for i in range(max(1, len(words) - width + 1)))
    return np.unique(np.fromiter(shingles, "<u8"))


def wide_simhash(text: str | None, width: int = 5, seed: int = 42, n_words: int = WORDS) -> bytes:
    """Fingerprint of 64 * n_words bits over the distinct shingles of a text; zero bytes without words."""
    return set_simhash(shingle_set(text, width, seed), n_words)


def set_simhash(h: np.ndarray, n_words: int = WORDS) -> bytes:
    votes = np.zeros(BITS * n_words, np.int64)
    for lo in range(0, len(h), 255):  # counts of so many fit a byte
        wide = np.stack([_remixed(h[lo : lo + 255], w) for w in range(n_words)], axis=1)
        votes += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h), bitorder="little").tobytes()


def add_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), width, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _exceeds(planes: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is above radius; planes: the counter's bits, low first."""
    above, level = over.copy(), ~over
    for k in reversed(range(len(planes))):
        if radius >> k & 1:
            level &= planes[k]
        else:
            above |= level & planes[k]
            level &= ~planes[k]
    return above


def sliced_pairs(fps: np.ndarray, group: np.ndarray, radius: int, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of the same group at radius or fewer differing bits; group is sorted.

    fps holds one word a row or several.  With a label, sorted inside groups, blocks wholly of the query's label are left out.
    """
    if not len(fps):
        return
    fps = fps.reshape(len(fps), -1)
    cuts = np.flatnonzero(np.diff(group)) + 1
    start, stop = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
    keep = stop - start > 1
    start, stop = start[keep], stop[keep]
    size = stop - start
    words = (size + 63) // 64
    load = np.cumsum(size * words)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS, "right")))
        yield from _sliced_chunk(fps, start[at:upto], size[at:upto], words[at:upto], radius, label)
        at = upto


def _sliced_chunk(fps, start, size, words, radius, label):
    first = np.concatenate(([0], np.cumsum(words)))  # each group's first word
    member = np.repeat(np.arange(len(size)), size)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    lane = first[member] * 64 + within
    index = start[member] + within
    of_lane = np.full(int(first[-1]) * 64, -1, np.int64)
    of_lane[lane] = index
    one = np.uint64(1)
    places = [(w, np.uint64(b)) for w in range(fps.shape[1]) for b in range(BITS)]
    columns, lane_bit, opens = np.ascontiguousarray(fps[index].T), (within % 64).astype(np.uint64), np.flatnonzero(within % 64 == 0)
    planes = np.stack([np.add.reduceat((columns[w] >> b & one) << lane_bit, opens) for w, b in places])
    if label is not None:
        of_first, of_last = label[of_lane[0::64]], label[np.maximum.reduceat(of_lane, np.arange(0, len(of_lane), 64))]
    # A query meets its own word and the later ones of its group: each pair once.
    n_words = words[member] - within // 64
    for lo, hi in _spans(n_words):
        q = np.repeat(np.arange(lo, hi), n_words[lo:hi])
        step = np.arange(len(q)) - np.repeat(np.cumsum(n_words[lo:hi]) - n_words[lo:hi], n_words[lo:hi])
        word = first[member[q]] + within[q] // 64 + step
        left = np.clip(size[member[q]] - (within[q] // 64 + step) * 64, 0, 64).astype(np.uint64)
        valid = np.where(left == 64, ~np.uint64(0), (one << (left & np.uint64(63))) - one)
        if label is not None:
            mixed = (of_first[word] != of_last[word]) | (of_first[word] != label[index[q]])
            q, step, word, valid = q[mixed], step[mixed], word[mixed], valid[mixed]
        own = (within[q] % 64).astype(np.uint64)
        valid &= np.where(step == 0, ~((one << own) | ((one << own) - one)), ~np.uint64(0))
        value = columns[:, q]
        counters = [np.zeros(len(q), np.uint64) for _ in range(max(3, radius.bit_length()))]
        over = np.zeros(len(q), np.uint64)
        for n in range(0, len(places), 8):
            differ = [planes[n + i][word] ^ (np.uint64(0) - (value[w] >> b & one)) for i, (w, b) in enumerate(places[n : n + 8])]
            for k in range(3):  # eight planes become four of twice the weight, then two, then one
                heavier = []
                for x, y in zip(differ[0::2], differ[1::2], strict=False):
                    odd = x ^ y
                    heavier.append((x & y) | (odd & counters[k]))
                    counters[k] = odd ^ counters[k]
                differ = heavier
            carry = differ[0]
            for k in range(3, len(counters)):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            over |= carry
            if n + 8 > radius:  # give up blocks of which every lane is too far
                alive = (~_exceeds(counters, over, radius) & valid) != 0
                if not alive.all():
                    q, word, valid, value, over = q[alive], word[alive], valid[alive], value[:, alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(q):
                    break
        hit = ~_exceeds(counters, over, radius) & valid
        if len(hit):
            row, bit = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield index[q[row]], of_lane[word[row] * 64 + bit]


def _spans(n: np.ndarray) -> Iterator[tuple[int, int]]:
    load, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi
        lo = hi


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], own: np.ndarray | None = None) -> np.ndarray:
    """Least index that the pairs connect each of n indices with; own: such indices of what is connected before."""
    label = np.arange(n) if own is None else own.copy()
    for a, b in pairs:
        while len(a):
            la, lb = label[a], label[b]
            while ((label[la] != la) | (label[lb] != lb)).any():
                la, lb = label[la], label[lb]
            differ = la != lb
            if not differ.any():
                break
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
    while (label[label] != label).any():
        label = label[label]
    return label


def _tile_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each tile; the rows come sorted by tile."""
    held_t, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(tile, fp):
        u = fp.view(np.uint64)
        label = _spanning(len(u), sliced_pairs(u, tile, radius))
        far = np.flatnonzero(label != np.arange(len(u)))
        return pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["a", "b"])

    for batch in batches:
        held_t = np.concatenate((held_t, batch.column(0).to_numpy(zero_copy_only=False)))
        held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        cut = int(np.searchsorted(held_t, held_t[-1])) if len(held_t) else 0  # the last tile may go on
        if cut:
            yield links(held_t[:cut], held_f[:cut])
            held_t, held_f = held_t[cut:], held_f[cut:]
    if len(held_t):
        yield links(held_t, held_f)


def _thinned(fps: np.ndarray, radius: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large tile that, with own, connect what all its pairs connect.

    Rows near a pivot are one component already, so that only blocks with rows of other components are compared after that.
    """
    free, stars = np.ones(len(fps), bool), []
    for _ in range(PIVOTS):
        if not free.any():
            break
        pivot = int(np.argmax(free))
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[pivot]).sum(axis=1, dtype=np.int64) <= radius)
        free[near] = False
        stars.append((np.full(len(near), pivot), near))
    label = _spanning(len(fps), iter(stars), own)
    yield from stars
    order = np.argsort(label, kind="stable")
    for a, b in sliced_pairs(fps[order], np.zeros(len(fps), np.int64), radius, label[order]):
        yield order[a], order[b]


def _wide_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the labels in each tile of (tile, label, wide fingerprint) rows, which come sorted by tile and label."""

    def links(tile, name, fp):
        u = np.frombuffer(b"".join(fp), "<u8").reshape(len(fp), -1)
        at = np.arange(len(u))
        new = np.concatenate(([True], (np.diff(tile) != 0) | (np.diff(name) != 0)))
        own = np.maximum.accumulate(np.where(new, at, 0))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]))
        size, mixed = np.diff(cuts), own[cuts[:-1]] != own[cuts[1:] - 1]
        few = np.flatnonzero(np.repeat(mixed & (size <= DENSE), size))
        back = np.searchsorted(few, own[few])
        label = own.copy()
        label[few] = few[_spanning(len(few), sliced_pairs(u[few], tile[few], radius, back), back)]
        for t in np.flatnonzero(mixed & (size > DENSE)):
            lo, hi = cuts[t], cuts[t + 1]
            label[lo:hi] = lo + _spanning(hi - lo, _thinned(u[lo:hi], radius, own[lo:hi] - lo), own[lo:hi] - lo)
        far = np.flatnonzero(new & (label != at))
        return pa.RecordBatch.from_arrays([pa.array(name[far]), pa.array(name[label[far]])], ["a", "b"])

    held_t, held_n, held_f = np.empty(0, np.int64), np.empty(0, np.int64), []
    for batch in batches:
        held_t = np.concatenate((held_t, batch.column(0).to_numpy(zero_copy_only=False)))
        held_n = np.concatenate((held_n, batch.column(1).to_numpy(zero_copy_only=False)))
        held_f += batch.column(2).to_pylist()
        cut = int(np.searchsorted(held_t, held_t[-1])) if len(held_t) else 0  # the last tile may go on
        if cut:
            yield links(held_t[:cut], held_n[:cut], held_f[:cut])
            held_t, held_n, held_f = held_t[cut:], held_n[cut:], held_f[cut:]
    if len(held_t):
        yield links(held_t, held_n, held_f)


def key_plan(n: int) -> tuple[int, int]:
    """(bits of a key, keys) for n fingerprints.

    Two texts at a likeness of 0.8 agree on a bit with a chance of 0.85, so a key of more bits needs more keys beside it to miss as
    few of them: a pair shares 9.6 keys on average, at every size.
    """
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, n) / MEETING)))
    return bits, math.ceil(9.6 / 0.85**bits)


def _sampled_keys(fps: list[bytes], seed: int, bits: int, ways: int) -> np.ndarray:
    """(len(fps), ways) keys: the way's number above its sampled bits (every run of keys over all bits permutes them anew)."""
    bit = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    rng, runs = np.random.default_rng(seed), -(-ways * bits // bit.shape[1])
    places = np.concatenate([rng.permutation(bit.shape[1]) for _ in range(runs)])[: ways * bits].reshape(ways, bits)
    weight = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([bit[:, p] @ weight for p in places], axis=1) + (np.arange(ways, dtype=np.int64) << bits)


def copy_groups(nodes: DataFrame, radius: int, tile: int = 16384, seed: int = 42) -> DataFrame:
    """(fp, component): what fingerprints of a common key and at radius or fewer bits connect; nodes has distinct ``fp``, component is a number.

    Keys that more than ``tile`` fingerprints share are cut into tiles of pairs of their parts.  The table of such keys is
    broadcast while it has at most ``HOT_KEYS`` rows of two numbers; beyond that it is joined by key.

    The first ``FIRST`` keys link most of what is alike, each part by itself, so a fingerprint has ``FIRST`` links there at most.
    All other tiles know the components of that and link only different ones: no group has a link for every tile it meets in.
    """
    nodes = materialize(nodes.select("fp", F.monotonically_increasing_id().alias("label")), "prints")
    bits, ways = key_plan(nodes.count())

    def keyed(nodes: DataFrame, ways: int) -> DataFrame:
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    key = _sampled_keys(part.column(0).to_pylist(), seed, bits, ways).ravel()
                    row = pa.array(np.repeat(np.arange(part.num_rows), ways))
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(row), part.column(1).take(row)], ["key", "fp", "label"])

        return nodes.select("fp", "label").mapInArrow(keys, "key long, fp binary, label long")

    counts = materialize(keyed(nodes, ways).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > tile), "hot")
    hot = F.broadcast(counts) if counts.count() <= HOT_KEYS else counts
    parts = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "label", "fp")
        rows = rows.repartition("tile").sortWithinPartitions("tile", "label")
        return connected_components(rows.mapInArrow(lambda it: _wide_links(it, radius), "a long, b long")).withColumnRenamed("node", "label")

    def named(nodes: DataFrame, found: DataFrame) -> DataFrame:
        return nodes.join(found, "label", "left").select("fp", F.coalesce("component", "label").alias("component"))

    near = linked(keyed(nodes, min(FIRST, ways)).join(hot, "key", "left").select("key", "label", "fp", mine.alias("mine"), mine.alias("other")))
    nodes = materialize(named(nodes, near).withColumnRenamed("component", "label"), "prints")
    rows = keyed(nodes, ways).join(hot, "key", "left").select("key", "label", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return named(nodes, linked(rows.filter((F.shiftright("key", bits) >= FIRST) | (F.col("mine") != F.col("other")))))


def copy_links(nodes: DataFrame, radius: int, tile: int = 16384, seed: int = 42) -> DataFrame:
    """(a, b): each fingerprint of ``copy_groups`` and the least of its component."""
    groups = copy_groups(nodes, radius, tile, seed)
    least = groups.groupBy("component").agg(F.min("fp").alias("b"))
    return groups.join(least, "component").filter("fp <> b").select(F.col("fp").alias("a"), "b")


def _ranges(total: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of equal bit ranges."""
    cuts = [total * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pick(col, ranges) -> F.Column:
    """The bits of these ranges side by side."""
    out, at = F.lit(0).cast("long"), 0
    for shift, width in ranges:
        mask = (1 << width) - 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(col, shift).bitwiseAND(F.lit(mask).cast("long")), at))
        at += width
    return out


def fingerprint_links(nodes: DataFrame, radius: int = 2, large: int = 1024, tile: int = 2048) -> DataFrame:
    """(a, b): links that connect exactly what fingerprints at radius or fewer bits connect; nodes has distinct ``fp``."""
    ranges = _ranges(BITS, radius + 2)
    ways = list(combinations(range(radius + 2), 2))
    keyed = nodes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), _pick(F.col("fp"), [ranges[x] for x in w]).alias("key")) for i, w in enumerate(ways)])).alias("k")
    ).select("fp", "k.way", "k.key")
    keyed = materialize(keyed, "keys")
    shared = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(shared, ["way", "key"])
    small = met.filter(F.col("n") <= large).select(F.xxhash64("way", "key").alias("tile"), "fp")
    # Keys shared by many: the other bits in radius + 1 ranges, of which one at least is equal too.
    rest = F.lit(None).cast("array<struct<sub:int,bits:bigint>>")
    for i, w in enumerate(ways):
        others = [ranges[x] for x in range(radius + 2) if x not in w]
        left = sum(width for _, width in others)
        packed = _pick(F.col("fp"), others)
        subs = F.array(*[F.struct(F.lit(s).alias("sub"), _pick(packed, [r]).alias("bits")) for s, r in enumerate(_ranges(left, radius + 1))])
        rest = F.when(F.col("way") == i, subs).otherwise(rest)
    again = met.filter(F.col("n") > large).select("fp", "way", "key", F.explode(rest).alias("r")).select("fp", "way", "key", "r.sub", "r.bits")
    on = ["way", "key", "sub", "bits"]
    counts = again.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    other = F.sequence(F.lit(0), tiles - 1)
    big = again.join(counts, on).select("fp", *on, mine.alias("mine"), F.explode(other).alias("other"))
    big = big.select(F.xxhash64(*on, F.least("mine", "other"), F.greatest("mine", "other"), F.lit("big")).alias("tile"), "fp")
    rows = small.unionByName(big).repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(lambda it: _tile_links(it, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, radius: int = 2, seed: int = 42
) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): one row per input row.

    component_id is the least doc_id that links of ``radius`` or fewer differing bits reach.  Empty input, empty output.
    """
    fps = materialize(add_fingerprints(docs, text, doc_id, width, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    out = _named(fps, nodes, fingerprint_links(nodes, radius))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(fps: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fps with the least doc_id of each fingerprint's component."""
    groups = connected_components(links)
    rooted = nodes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    rooted = materialize(rooted, "roots")
    # A table of its own, so that a large component's side of the join can be split.
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    release(nodes), release(rooted), release(least)
    return fps.join(named, "fp")


def like_sets(sets: list[np.ndarray], likeness: Fraction) -> np.ndarray:
    """Least index that pairs of sets at the Jaccard likeness or more connect each set with."""
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    label = np.arange(m)
    owner, (_, token, count) = np.repeat(label, size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of_token = owner[np.argsort(token, kind="stable")]
    stop = np.cumsum(count)
    first = np.concatenate(([0], np.cumsum(size)))
    p, q = likeness.numerator, likeness.denominator
    for i in range(m):
        if (label == label[0]).all():
            break
        mine = token[first[i] : first[i + 1]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        n = count[mine]
        at = np.arange(int(n.sum())) + np.repeat(stop[mine] - np.cumsum(n), n)
        common = np.bincount(of_token[at], minlength=m)
        found = np.unique(label[(p + q) * common >= p * (size[i] + size)])
        if len(found) > 1:
            label[np.isin(label, found)] = found[0]
    return label


def _set_links(batches: Iterator[pa.RecordBatch], likeness: Fraction) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) of each tile of (tile, fp, shingle set) rows; the rows come sorted by tile."""

    def links(held):
        names = list(held)
        label = like_sets([np.frombuffer(held[x], "<u8") for x in names], likeness) if len(names) > 1 else np.zeros(len(names), np.int64)
        far = np.flatnonzero(label != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in far], "binary"), pa.array([names[i] for i in label[far]], "binary")], ["a", "b"])

    now, held = None, {}
    for b in batches:
        for tile, fp, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            if tile != now:
                if len(held) > 1:
                    yield links(held)
                now, held = tile, {}
            held[fp.as_py()] = h.as_py()
    yield links(held)


def _tiled(rows: DataFrame, key: str, parts) -> DataFrame:
    """(tile, fp, h): the rows of each key dealt into so many parts, and every pair of parts a tile."""
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    out = rows.select(key, "fp", "h", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    out = out.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), "fp", "h")
    return out.repartition("tile").sortWithinPartitions("tile")


def _few_links(nodes: DataFrame, likeness: Fraction) -> DataFrame:
    """(a, b) among texts of few shingles, exact: of n hashes in order, two sets of the likeness share one of the first n - likeness * n + 1."""
    p, q = likeness.numerator, likeness.denominator

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x.as_py(), "<i8") for x in b.column(1)]
            lead = [h[: len(h) + p * len(h) // -q + 1] for h in sets]
            row = pa.array(np.repeat(np.arange(len(lead)), [len(x) for x in lead]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *lead])), b.column(0).take(row), b.column(1).take(row)], ["key", "fp", "h"])

    keyed = nodes.filter("n > 0 and h is not null").select("fp", "h").mapInArrow(keys, "key long, fp binary, h binary")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    parts = F.ceil(F.col("n") / (PART // FEW)).cast("int")
    return _tiled(keyed.join(shared, "key"), "key", parts).mapInArrow(lambda it: _set_links(it, likeness), "a binary, b binary")


def _long_links(docs: DataFrame, nodes: DataFrame, likeness: Fraction, radius: int, width: int, seed: int) -> DataFrame:
    """(a, b) among texts of more shingles: the members of each component of candidates, compared by their sets."""
    prints = nodes.filter(F.col("n") > FEW).select(F.col("wide").alias("fp")).distinct()
    groups = copy_groups(prints, radius, seed=seed).select(F.col("fp").alias("wide"), F.col("component").alias("group"))
    members = nodes.filter(F.col("n") > FEW).join(groups, "wide").select("fp", "n", "group", "first")
    sizes = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    sizes = materialize(sizes.select("group", F.ceil(F.col("total") / PART).cast("int").alias("parts")), "groups")
    members = members.join(sizes, "group").select(F.col("first.row").alias("row"), "fp", "group", "parts")
    members = materialize(members, "members")
    texts = docs.join(members, "row").select("fp", "group", "parts", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = pa.array([shingle_set(t.as_py(), width, seed).tobytes() for t in b.column(3)], "binary")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], h], ["fp", "group", "parts", "h"])

    rows = texts.mapInArrow(sets, "fp binary, group long, parts int, h binary")
    return _tiled(rows, "group", F.col("parts")).mapInArrow(lambda it: _set_links(it, likeness), "a binary, b binary")


def _copies(docs: DataFrame, width: int, likeness: float, seed: int, radius: int) -> DataFrame:
    """(row, fp, least): fp names a shingle set, least is the place of the first row of its component; docs: (id, tie, row, text)."""
    exact = Fraction(str(likeness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(3):
                h = shingle_set(t.as_py(), width, seed)
                few = h.tobytes() if exact * len(h) <= FEW else None  # with room for partners of FEW shingles
                found.append((xxhash.xxh3_128_digest(h.tobytes()), set_simhash(h) if len(h) > FEW else None, len(h), few))
            fp, wide, n, few = zip(*found, strict=True) if found else ((), (), (), ())
            cols = [pa.array(fp, "binary"), pa.array(wide, "binary"), pa.array(n, pa.int32()), pa.array(few, "binary")]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["id", "tie", "row", "fp", "wide", "n", "h"])

    kind = dict(docs.dtypes)["id"]
    fps = materialize(docs.select("id", "tie", "row", "text").mapInArrow(run, f"id {kind}, tie long, row long, fp binary, wide binary, n int, h binary"), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min(place("id", "tie", "row")).alias("first"), F.first("wide").alias("wide"), F.first("n").alias("n"), F.first("h").alias("h"))
    nodes = materialize(nodes, "nodes")
    links = materialize(_few_links(nodes, exact).unionByName(_long_links(docs, nodes, exact, radius, width, seed)), "links")
    return _named(fps.select("row", "fp"), nodes.select("fp", "first"), links).withColumnRenamed("component_id", "least")


def near_copies(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, likeness: float = 0.8, seed: int = 42, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row, linked where the Jaccard likeness of the distinct shingles is ``likeness`` or more.

    fp names the shingle set.  Every link is checked on the sets; ``radius`` (of 512 bits, meant for 0.8) bounds only which longer
    texts are compared.  Wordless and null texts are copies of each other; a null doc_id never names a component; empty input, empty output.
    """
    rows = numbered(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "row", "tie")
    found = _copies(rows, width, likeness, seed, radius).join(rows.select("row", "id"), "row")
    return found.select(F.col("id").alias("doc_id"), "fp", F.col("least.id").alias("component_id"))


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, likeness: float = 0.8, seed: int = 42, radius: int = RADIUS
) -> DataFrame:
    """docs with one row of each component of ``near_copies``: the one of the least doc_id, null ids last.

    Every row is a document of its own: rows of one doc_id, or of none, are judged by their texts; of rows that share the least id,
    the one with the least hash of all its columns stays.
    """
    row, tie = free_names(docs.columns, "row", "tie")
    table = numbered(docs, row, tie)
    own = table.select(F.col(doc_id).alias("id"), F.col(tie).alias("tie"), F.col(row).alias("row"), F.col(text).alias("text"))
    found = _copies(own, width, likeness, seed, radius)
    gone = materialize(found.filter(F.col("row") != F.col("least.row")).select(F.col("row").alias(row)), "gone")
    return table.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
