"""Near-duplicate documents by a grouped prefix join over word shingles (operator 9).

A document is its set of distinct 5-word shingles (64-bit hashes). Under one order of all shingles, two
sets with Jaccard similarity of at least 3/4 share a shingle in their prefixes, the first
n - ceil(3n/4) + 1 of n. The order is by a level of frequency, from counts over all documents in a
sketch of fixed size, then by hash; any such order is exact, and this one keeps shingles of common
passages out of prefixes.

1. Documents with equal sets count once. Sets with the same prefix and size form a group, and a group
   sends its prefix once from a task.
2. Groups that share a prefix shingle meet in its bucket; size bounds filter the pairs of groups. A
   bucket of many groups, a group of many sets and a pair of groups with such a one go on whole, as large buckets.
3. Pairs of groups are expanded to pairs of sets and filtered by parity bitmaps: the bits in which two
   differ are at most the shingles in which the sets differ.
4. Pairs are verified by their sets, the nearest few of each set at first; a pair within a component needs
   no more verification. Each member of a large bucket is compared with some centers first; buckets whose
   members are then in different components are dealt in blocks, and blocks are compared in pairs: each
   member with its nearest in another component, then all that are left. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import exchange
from brindle.llm.blocks import LOWER, U64, gram_hashes, mix, packed_strings, ragged, text_bytes, text_words, unpacked, whole_texts
from brindle.llm.components import components
from brindle.llm.saved import FEW, bounded, counted, saved

SHINGLE = 5
#: Similarity of a link: intersection / union >= SHARE / 100.
SHARE = 75
#: Texts whose arrays a task holds at a time; a longer text comes alone.
TEXT_BYTES = 400_000
CELLS = 1 << 22
SEGMENTS = 16
#: A cell has the lowest level while it counts no more than the mean cell, three times its noise and this. A rare
#: shingle that shares a cell with others may get a higher level: that moves it in the order and loses nothing.
COMMON = 4
#: Buckets and groups of at most so many give all pairs; larger ones are compared in turns.
ALL_PAIRS = 12

MEMBERS = "doc_id long, n long, skey long, gkey long, bits binary"
_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("skey", pa.int64()), ("gkey", pa.int64()), ("bits", pa.binary())])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their number."""
    n_texts = len(offsets) - 1
    _, _, text, words = text_words(LOWER[data], offsets)
    h = gram_hashes(words, SHINGLE)
    inside = text[: len(h)] == text[SHINGLE - 1 :] if len(h) else np.empty(0, bool)
    h, owner = h[inside], text[: len(h)][inside]
    n_words = np.bincount(text, minlength=n_texts)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # the whole sequence as one shingle
        first = np.searchsorted(text, short)
        whole = np.array([gram_hashes(words[a : a + n], n)[0] ^ U64(n) for a, n in zip(first.tolist(), n_words[short].tolist(), strict=True)], U64)
        h, owner = np.append(h, whole), np.append(owner, short)
    if len(short):
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    else:
        h = h.copy()
    edges = np.searchsorted(owner, np.arange(n_texts + 1)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):  # many short sorts are faster than one long one
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n_texts)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-n * SHARE // 100) + 1, 0)


def _each(batches: Iterator[pa.RecordBatch]):
    """doc_ids, set hashes and sizes of some texts at a time."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text")), TEXT_BYTES):
            yield ids[rows], *shingle_sets(data, offsets)


def cell_of(h: np.ndarray) -> np.ndarray:
    return (h & U64(CELLS - 1)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that a task has seen and how often, packed by segment: never more than the whole sketch, and little from a small task."""
    total = np.zeros(CELLS, np.int32)
    for _, h, _ in _each(batches):
        np.add.at(total, cell_of(h), 1)
    seen = np.flatnonzero(total)
    edges = np.searchsorted(seen, np.arange(SEGMENTS + 1) * (CELLS // SEGMENTS))
    for k in range(SEGMENTS):
        at = seen[edges[k] : edges[k + 1]]
        if len(at):
            gaps = np.diff(at, prepend=k * (CELLS // SEGMENTS)).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "gaps": pa.array([gaps.tobytes()], pa.binary()), "counts": pa.array([np.minimum(total[at], 65535).astype(np.uint16).tobytes()], pa.binary())})


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, gaps, counts in zip(batch.column("segment").to_pylist(), batch.column("gaps"), batch.column("counts"), strict=True):
            of = total.setdefault(k, np.zeros(CELLS // SEGMENTS, np.int64))
            of[np.cumsum(np.frombuffer(gaps.as_buffer(), np.uint32))] += np.frombuffer(counts.as_buffer(), np.uint16)
    if total:
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(total), pa.int32()), "levels": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def levels(texts: DataFrame) -> np.ndarray:
    """Level of frequency of each cell, from the shingles of all documents; 4 MB, whatever the input."""
    summed = texts.mapInArrow(_count_cells, "segment int, gaps binary, counts binary").repartition(SEGMENTS, "segment").mapInArrow(_add_cells, "segment int, levels binary")
    counts = np.zeros(CELLS, np.int64)
    for row in summed.collect():
        counts.reshape(SEGMENTS, -1)[row.segment] = np.frombuffer(row.levels, np.int64)
    base = counts.mean() + 3 * np.sqrt(counts.mean()) + COMMON
    return np.ceil(np.log2(np.maximum(counts / base, 1))).astype(np.uint8)


def prefixes(h: np.ndarray, n: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set under the order, and its size."""
    order = np.arange(len(h))
    common = level[cell_of(h)]
    ends = np.append(0, np.cumsum(n))
    some = np.add.reduceat(np.append(common, 0) > 0, np.minimum(ends[:-1], len(h))) if len(n) else np.empty(0)
    for k in np.flatnonzero((some > 0) & (n > 0)).tolist():
        a, b = ends[k], ends[k + 1]
        order[a:b] = a + np.argsort(common[a:b], kind="stable")
    size = prefix_size(n)
    return h[order[ragged(ends[:-1], size)]], size


def _sum_by(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.append(U64(0), np.cumsum(values, dtype=U64))
    at = np.append(0, np.cumsum(n))
    return ends[at[1:]] - ends[at[:-1]]


def set_keys(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A key for each set, equal for equal sets: a sum of spread hashes."""
    return mix(_sum_by(mix(h ^ U64(0xA0761D6478BD642F)), n) * U64(0xE7037ED1A0B428DB) ^ mix(_sum_by(h, n)) ^ n.astype(U64)).astype(np.int64)


def parity_bits(h: np.ndarray) -> bytes:
    """Bit k tells whether an odd number of shingles falls on k; there are about as many bits as shingles."""
    size = 1 << max(6, int(len(h) - 1).bit_length())
    return np.packbits(np.bincount((h >> U64(20)).astype(np.int64) & (size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _members(level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, n in _each(batches):
            p, size = prefixes(h, n, level)
            ends = np.append(0, np.cumsum(n)).tolist()
            bits = [parity_bits(h[a:b]) if b > a else b"" for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(set_keys(h, n)), pa.array(set_keys(p, size) ^ n), pa.array(bits, pa.binary())], schema=_MEMBERS)

    return run


def _tokens(level: np.ndarray, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sent = exchange.Packer(n_buckets, "all", 8), set()
        for _, h, n in _each(batches):
            p, size = prefixes(h, n, level)
            key = set_keys(p, size) ^ n
            new = np.zeros(len(n), bool)
            for k, x in enumerate(key.tolist()):  # a group's prefix goes once
                if n[k] and x not in sent:
                    sent.add(x)
                    new[k] = True
            if len(sent) > 1_000_000:
                sent.clear()
            on = np.repeat(new, size)
            yield from out.add(mix(p[on]), np.repeat(key, size)[on], np.repeat(n, size)[on])
        yield from out.flush()

    return run


def size_fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= SHARE * np.maximum(a, b)


BUCKETED = "a long, b long, bucket binary"
_BUCKETED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.binary())])


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups (a, b) from small buckets, and whole large buckets for rounds of stars."""
    hs, gs, ns = [], [], []
    for batch in batches:
        hs.append(unpacked(batch.column("h"), U64)[0])
        gs.append(unpacked(batch.column("doc"), np.int64)[0])
        ns.append(unpacked(batch.column("pos"), np.int32)[0])
    if not hs:
        return
    h, g, n = np.concatenate(hs), np.concatenate(gs), np.concatenate(ns)
    del hs, gs, ns
    order = np.lexsort((g, n, h))
    h, g, n = h[order], g[order], n[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g, n = h[keep], g[keep], n[keep]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h)))
    big = size > ALL_PAIRS
    seen, kept = set(), []
    for a, k in zip(at[big].tolist(), size[big].tolist(), strict=True):
        mark = g[a : a + k].tobytes()
        if mark not in seen:  # many shingles of a passage have the same groups
            seen.add(mark)
            kept.append(mark)
    for lo in range(0, len(kept), 1000):
        some = kept[lo : lo + 1000]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64())] * 2, pa.array(some, pa.binary())], schema=_BUCKETED)
    left, right = [g[:0]], [g[:0]]
    small = np.repeat(size * ~big, size)
    index = np.arange(len(h))
    for step in range(1, min(ALL_PAIRS, len(h))):
        i = index[: len(h) - step]
        i = i[(small[: len(h) - step] > step) & (h[: len(h) - step] == h[step:])]
        i = i[size_fits(n[i], n[i + step])]
        left.append(g[i]), right.append(g[i + step])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    for lo in range(0, pairs.shape[1], 100_000):
        some = pairs[:, lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1]), pa.nulls(some.shape[1], pa.binary())], schema=_BUCKETED)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two parity bitmaps differ, the longer folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that size and bitmaps let pass; gap is the number of differing bits."""
    most = 100 - SHARE, 100 + SHARE  # a link differs in at most (n_a + n_b) * 25 / 175 shingles
    for batch in batches:
        n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        gap = np.array([differing_bits(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("bits_a"), batch.column("bits_b"), strict=True)], np.int64)
        on = pa.array((gap * most[1] <= n * most[0]) & size_fits(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(on), batch.column("b").filter(on), pa.array(gap).filter(on)], names=["a", "b", "gap"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("skey").to_numpy()
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text")), TEXT_BYTES):
            h, n = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), packed_strings(h, n)], names=["skey", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        on = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            on.append(100 * common >= SHARE * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(on, pa.bool_())), batch.column("b").filter(pa.array(on, pa.bool_()))], names=["a", "b"])


def bits_apart(bits: list[bytes], one: int, others: np.ndarray) -> np.ndarray:
    """differing_bits of one bitmap and others."""
    out = np.empty(len(others), np.int64)
    lengths = np.array([len(bits[k]) for k in others.tolist()], np.int64)
    for n in np.unique(lengths).tolist():
        on = np.flatnonzero(lengths == n)
        x = np.frombuffer(bits[one], np.uint64)[None, :]
        y = np.frombuffer(b"".join([bits[k] for k in others[on].tolist()]), np.uint64).reshape(len(on), -1)
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[on] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


#: Members of a large bucket with which all others are compared first, each set in the largest of its buckets.
CENTERS = 32
#: Members of a bucket are dealt in blocks of about so many; no row holds more than two blocks.
BLOCK = 512
STARS = "a long, b long, gap long"
#: Bucket numbers that a member carries, its smallest, so that a pair comes from one of the buckets that it shares.
CARRIED = 64


def _stars(nearest: bool):
    """From rows of members m and others c of one bucket k: pairs, between components, that pass the filters; of each member all, or the nearest.

    All pairs: one whose carried bucket numbers meet comes only from the smallest bucket in which they do,
    one whose numbers do not meet from every bucket that it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m, c in zip(batch.column("k").to_pylist(), batch.column("m"), batch.column("c"), strict=True):
                m, c = m.as_py(), c.as_py()
                one_block = not nearest and {x["skey"] for x in m} == {x["skey"] for x in c}
                carried = [] if nearest else [frozenset(x["ks"]) for x in m]
                g, label, n = (np.array([x[name] for x in m], np.int64) for name in ("skey", "label", "n"))
                bits = [x["bits"] for x in m] + [x["bits"] for x in c]
                best, center = np.full(len(g), 1 << 62), np.zeros(len(g), np.int64)
                for i, one in enumerate(c):
                    others = np.flatnonzero(label != one["label"])
                    others = others[size_fits(n[others], one["n"])]
                    gap = bits_apart(bits, len(g) + i, others)
                    on = gap * (100 + SHARE) <= (n[others] + one["n"]) * (100 - SHARE)
                    others, gap = others[on], gap[on]
                    if nearest:
                        closer = gap < best[others]
                        best[others[closer]], center[others[closer]] = gap[closer], one["skey"]
                    elif len(others):
                        mine = frozenset(one["ks"])
                        on = np.array([min(carried[x] & mine, default=k) == k and not (one_block and g[x] > one["skey"]) for x in others.tolist()])
                        yield _pairs(np.full(int(on.sum()), one["skey"]), g[others[on]], gap[on])
                found = np.flatnonzero(best < 1 << 62)
                if len(found):
                    yield _pairs(center[found], g[found], best[found])

    return run


def _pairs(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(gap)], names=["a", "b", "gap"])


#: Pairs of a set that are verified in the first round, its nearest.
AT_ONCE = 4


def ngram_join(docs: DataFrame) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.75.

    Returns a row for each document: doc_id, n_shingles (size of its set) and component_id (the smallest
    doc_id that links reach from it, itself included). Words are runs outside space and \\t..\\r after A-Z
    are lower-cased; with fewer than five words the whole sequence is one shingle; a text without words,
    or null, has the empty set and links with nothing. Rows without doc_id are left out; rows that repeat
    one count as one document. Further columns of ``docs`` are ignored, whatever their names.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = exchange.keyed(docs)
    level = levels(texts)
    members = saved(texts.mapInArrow(_members(level), MEMBERS))
    sets, _ = counted(members.where("n > 0").groupBy("skey", "gkey", "n").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits")))
    probes = texts.mapInArrow(_tokens(level, n), exchange.PROBES)
    bucketed = saved(probes.repartition(n, "bucket").mapInArrow(_group_pairs, BUCKETED))
    groups, n_groups = counted(sets.groupBy("gkey").agg(F.count("*").alias("sets_in_group")).where("sets_in_group > 1"))
    of_group = lambda s: bounded(groups.select(F.col("gkey").alias(s), F.col("sets_in_group").alias(f"n_{s}")), n_groups)
    between = bucketed.where("a IS NOT NULL").select("a", "b").distinct().join(of_group("a"), "a", "left").join(of_group("b"), "b", "left")
    between, _ = counted(between.withColumn("crowded", F.coalesce(F.greatest("n_a", "n_b") > ALL_PAIRS, F.lit(False))))

    ranked, _ = counted(_small_pairs(between, sets, of_group("gkey")))
    places, n_places = counted(_places(bucketed, between, groups))
    first = ranked.where(F.col("rank") <= AT_ONCE).select("a", "b")
    if n_places:
        first = first.unionByName(_around_centers(places, sets).mapInArrow(_stars(True), STARS).select("a", "b"))
    linked, _ = counted(_linked(first, texts, sets, n))
    found, n_found = counted(components(linked))

    rest = ranked.where(F.col("rank") > AT_ONCE).select("a", "b")
    for nearest in (True, False):
        rows, n_stars, now = _mixed(places, sets, found, n_found) if n_places else None, 0, rest
        if rows is not None:
            carried = F.slice(F.array_sort(F.collect_set("k")), 1, CARRIED).alias("ks")  # of a set's own shingles
            having = sets if nearest else sets.join(rows.groupBy("skey").agg(carried), "skey")
            stars = _between_blocks(rows, having).mapInArrow(_stars(nearest), STARS)
            if nearest:  # of all blocks that a member is compared with
                stars = stars.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("low")).select("low.a", "b")
            stars, n_stars = counted(stars.select("a", "b"))
            now = rest.unionByName(stars) if nearest else stars
        now, n_now = counted(_crossing(now, found, n_found))
        if n_now:
            linked, n_linked = counted(_linked(now, texts, sets, n))
            if n_linked:
                known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
                found, n_found = counted(components(known.unionByName(linked)))
        if not n_stars:
            break
    return _result(members, sets, found)


def _small_pairs(between: DataFrame, sets: DataFrame, of_group: DataFrame) -> DataFrame:
    """Pairs of sets from small buckets and small groups that pass the filters, ranked by the bits that differ."""
    by = lambda s, key, name: sets.select(F.col(key).alias(name), *(F.col(c).alias(f"{c}_{s}") for c in ("skey", "n", "bits") if c != key))
    columns = ["n_a", "n_b", "bits_a", "bits_b"]
    plain = between.where("NOT crowded").select("a", "b")
    expanded = plain.join(by("a", "gkey", "a"), "a").join(by("b", "gkey", "b"), "b").select(F.col("skey_a").alias("a"), F.col("skey_b").alias("b"), *columns)
    few = sets.join(of_group.where(F.col("n_gkey") <= ALL_PAIRS), "gkey").select("gkey", "skey", "n", "bits")
    left, right = (few.select("gkey", *(F.col(c).alias(f"{c}_{s}") for c in ("skey", "n", "bits"))) for s in "ab")
    within = left.join(right, "gkey").where("skey_a > skey_b").select(F.col("skey_a").alias("a"), F.col("skey_b").alias("b"), *columns)
    near = expanded.unionByName(within).mapInArrow(_near, "a long, b long, gap long")
    near = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "gap")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("gap", "b")))


def _places(bucketed: DataFrame, between: DataFrame, groups: DataFrame) -> DataFrame:
    """(k, size, gkey) of large buckets: buckets of many groups, groups of many sets, and pairs of groups with such a one."""
    big = bucketed.where("bucket IS NOT NULL").select(F.xxhash64("bucket").alias("k"), "bucket").dropDuplicates(["k"])
    crowds = groups.where(F.col("sets_in_group") > ALL_PAIRS).select(F.col("gkey").alias("k"), F.col("sets_in_group").alias("size"), "gkey")
    size = F.coalesce("n_a", F.lit(1)) + F.coalesce("n_b", F.lit(1))
    beside = between.where("crowded").select(F.xxhash64("a", "b").alias("k"), size.alias("size"), F.explode(F.array("a", "b")).alias("gkey"))
    return _unpack(big).unionByName(crowds).unionByName(beside)


def _linked(pairs: DataFrame, texts: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) of sets that are links, verified by their shingles."""
    pairs, n_pairs = counted(pairs.select("a", "b"))
    wanted, n_wanted = counted(pairs.select(F.explode(F.array("a", "b")).alias("skey")).distinct())
    wanted, n_wanted = counted(sets.select("skey", "doc_id").join(bounded(wanted, n_wanted), "skey"))
    wanted = F.broadcast(wanted) if n_wanted <= FEW else wanted.hint("shuffle_hash")
    shingles = saved(texts.join(wanted, "doc_id").select("skey", "text").mapInArrow(_sets, "skey long, shingles binary").repartition(n, "skey"))
    x, y = (shingles.select(F.col("skey").alias(s), F.col("shingles").alias(c)) for s, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _labels(found: DataFrame, n_found: int, s: str) -> DataFrame:
    return bounded(found.select(F.col("node").alias(s), F.col("component").alias(f"label_{s}")), n_found)


def _crossing(pairs: DataFrame, found: DataFrame, n_found: int) -> DataFrame:
    """Distinct pairs between components."""
    pairs = pairs.join(_labels(found, n_found, "a"), "a", "left").join(_labels(found, n_found, "b"), "b", "left")
    pairs = pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mixed(places: DataFrame, sets: DataFrame, found: DataFrame, n_found: int) -> DataFrame | None:
    """(k, skey, label) of the large buckets whose members are in different components; the others have nothing left to compare."""
    labelled = sets.select("gkey", "skey").join(_labels(found, n_found, "skey"), "skey", "left").select("gkey", "skey", F.coalesce("label_skey", "skey").alias("label"))
    of_group = labelled.groupBy("gkey").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed, n_mixed = counted(places.join(of_group, "gkey").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("k"))
    if not n_mixed:
        return None
    rows, _ = counted(places.select("k", "gkey").join(bounded(mixed, n_mixed), "k").join(labelled, "gkey").select("k", "skey", "label"))
    return rows


def _unpack(big: DataFrame) -> DataFrame:
    """(k, size, gkey): bucket number, number of groups in it, group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, counts = unpacked(batch.column("bucket"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("k").to_numpy(), counts)), pa.array(np.repeat(counts, counts).astype(np.int64)), pa.array(g)], names=["k", "size", "gkey"])

    return big.select("k", "bucket").mapInArrow(run, "k long, size long, gkey long")


def _packed(rows: DataFrame, sets: DataFrame, keys: list[str], name: str) -> DataFrame:
    own = [c for c in ("n", "bits", "ks") if c in sets.columns]
    return rows.join(sets.select("skey", *own), "skey").groupBy(*keys).agg(F.collect_list(F.struct("skey", "label", *own)).alias(name))


def _around_centers(places: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, m, c): each block of a large bucket with the bucket's centers, the smallest key of each of some slots. A set goes to the largest of its buckets."""
    home = places.groupBy("gkey").agg(F.max_by("k", F.struct("size", "k")).alias("k"))
    member = F.struct("skey", F.col("skey").alias("label"), "n", "bits").alias("one")
    rows = saved(sets.join(home, "gkey").select("k", member))
    centers = rows.groupBy("k", F.pmod(F.xxhash64("one.skey"), F.lit(CENTERS)).alias("slot")).agg(F.min_by("one", "one.skey").alias("one"), F.count("*").alias("size"))
    centers = saved(centers.groupBy("k").agg(F.collect_list("one").alias("c"), F.ceil(F.sum("size") / BLOCK).cast("long").alias("n_blocks")))
    many, n_many = counted(centers.where("n_blocks > 1").select("k", "n_blocks"))
    block = F.pmod(F.xxhash64("one.skey"), F.coalesce("n_blocks", F.lit(1)))
    members = rows.join(bounded(many, n_many), "k", "left").select("k", block.alias("block"), "one")
    members = members.groupBy("k", "block").agg(F.collect_list("one").alias("m"))
    each = centers.select("k", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    return members.join(each, ["k", "block"]).select("k", "m", "c")


def _between_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(k, m, c): pairs of blocks of a bucket. A component of many members has blocks of its own, which are not paired with each other."""
    of_label = rows.groupBy("k", "label").agg(F.count("*").alias("alike"))
    small = of_label.where(F.col("alike") <= BLOCK).groupBy("k").agg(F.sum("alike").alias("rest"))
    dealt = of_label.join(small, "k", "left").select("k", "label", "alike", F.when(F.col("alike") > BLOCK, F.col("label")).alias("sole"), F.ceil(F.col("rest") / BLOCK).cast("long").alias("n_rest"))
    part = F.when(F.col("sole").isNull(), F.pmod(F.xxhash64("label"), "n_rest")).otherwise(F.pmod(F.xxhash64("skey"), F.ceil(F.col("alike") / BLOCK).cast("long")))
    dealt = saved(rows.join(dealt, ["k", "label"]).select("k", "skey", "label", "sole", F.xxhash64(F.col("sole").isNull(), F.coalesce("sole", F.lit(0)), part).alias("block")))
    blocks = saved(dealt.join(sets.select("skey", "n"), "skey").groupBy("k", "block", "sole").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    left, right = (blocks.select("k", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "sole", "low", "high"))) for s in "ab")
    apart = ~F.coalesce(F.col("sole_a") == F.col("sole_b"), F.lit(False))
    fits = (F.col("high_a") * 100 >= F.col("low_b") * SHARE) & (F.col("high_b") * 100 >= F.col("low_a") * SHARE)
    pairs = left.join(right, "k").where((F.col("block_a") <= F.col("block_b")) & apart & fits).select("k", "block_a", "block_b")
    packed = saved(_packed(dealt, sets, ["k", "block"], "m"))
    m, c = packed.withColumnRenamed("block", "block_a"), packed.select("k", F.col("block").alias("block_b"), F.col("m").alias("c"))
    return pairs.join(m, ["k", "block_a"]).join(c, ["k", "block_b"]).select("k", "m", "c")


def _result(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    linked = sets.select("skey", "doc_id").join(found.withColumnRenamed("node", "skey"), "skey", "left").select("skey", "doc_id", F.coalesce("component", "skey").alias("label"))
    low = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = linked.join(low, "label").select("skey", "component_id")
    out = members.select("doc_id", "n", "skey").join(of_set, "skey", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
