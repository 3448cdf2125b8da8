"""Exact removal of repeated 100-byte strings with a hash-compared suffix sort (operator 3).

1. Every 100-byte window picks the smallest hash among its 32-byte strings (leftmost on ties) as owner.
   Equal windows have equal owners at the same place. Consecutive windows with one owner form a segment, in
   two parts by the owner's place: all windows of a part have at least 66 bytes around the owner in common,
   its anchor. A window can only repeat if its anchor's hash does; the exchange finds those hashes. A phrase
   shorter than that brings no segments together, however many texts have it.
2. The texts of segments with repeated anchors meet in the bucket of the owner's hash. Of segments with
   the same bytes the first (doc_id, start) stays and the others are wholly repeated; a task does this
   before it sends anything, so copies cost one segment. What is left under one owner is cut again, by
   anchors of 89 bytes and more, and equal parts are settled in the same way.
3. What is left under one of these anchors is sorted as suffixes: a bottom-up mergesort of all at once, where
   two suffixes are compared by the length of their common extension, found by binary search over prefix
   polynomial hashes. Neighbours that agree on 100 bytes are compared byte by byte before they count as
   equal; in each class of equal windows all but the first are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brindle.llm import exchange
from brindle.llm.blocks import BYTE_BASE, U64, Piece, mix, packed_strings, pieces, powers, prefix_hash, ragged, text_bytes, unpacked, whole_texts

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1
#: Places of the owner in a window that share an anchor: of the exchange, and in a bucket.
PLACES, CLOSE = 35, 12
#: The arrays of a piece stay in a core's cache.
PIECE = 1 << 16
INDEX = U64((1 << 23) - 1)
SEGMENT_FLUSH = 16_000_000

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
SEGMENTS = "bucket int, settled boolean, h binary, content binary, doc binary, pos binary, n binary, owner binary, body binary"
_SEGMENTS = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), *((k, pa.binary()) for k in ("h", "content", "doc", "pos", "n", "owner", "body"))])


def anchored(prefix: np.ndarray, start: np.ndarray, count: np.ndarray, owner: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut where the bytes before the owner reach a multiple of ``places``: index of the segment, start,
    number of windows, and the hash of what all windows of such a part have in common if none is missing."""
    top, low = (owner - start) // places, (owner - start - count + 1) // places
    of = np.repeat(np.arange(len(start)), top - low + 1)
    kind = top[of] - ragged(np.zeros(len(start), np.int64), top - low + 1)
    first = np.maximum(start[of], owner[of] - (kind + 1) * places + 1)
    n = np.minimum(start[of] + count[of], owner[of] - kind * places + 1) - first
    a, b = owner[of] - kind * places, owner[of] - np.minimum((kind + 1) * places, SPREAD) + 1 + LENGTH
    return of, first, n, mix(((prefix[b] - prefix[a]) * powers(BYTE_BASE, len(prefix))[1][a]) ^ mix(kind.astype(U64)))


class Runs:
    """The segments of a piece, cut by anchors: text index, start, number of windows, owner's place and hash, anchor's hash."""

    def __init__(self, piece: Piece):
        data, offsets = piece.data, piece.offsets
        n = len(data)
        self.start = self.count = self.owner = self.text = np.empty(0, np.int64)
        self.h = self.owner_h = np.empty(0, U64)
        self.prefix = np.zeros(1, U64)
        if n < LENGTH:
            return
        self.prefix = prefix_hash(data, BYTE_BASE)
        inverse = powers(BYTE_BASE, n + 1)[1]
        grams = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * inverse[: n - GRAM + 1])
        low = (grams & ~INDEX) | np.arange(len(grams), dtype=U64)
        width = 1
        while 2 * width <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[SPREAD - width : SPREAD - width + n - LENGTH + 1])
        owner = (low & INDEX).astype(np.int64)
        edge = np.zeros(n + 2, np.int32)
        wide = np.diff(offsets) >= LENGTH
        np.add.at(edge, offsets[:-1][wide], 1)
        np.add.at(edge, offsets[1:][wide] - LENGTH + 1, -1)
        valid = np.cumsum(edge)[: len(owner)] > 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (owner[1:] != owner[:-1])
        start = np.flatnonzero(first)
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | first[1:]
        end, owner = np.flatnonzero(stop), owner[start]
        of, self.start, self.count, self.h = anchored(self.prefix, start, end - start + 1, owner, PLACES)
        self.owner = owner[of]
        self.owner_h = mix(grams[self.owner] ^ U64(0x5851F42D4C957F2D))
        self.text = np.searchsorted(offsets, self.start, side="right") - 1


def _owners(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exchange.Packer(n_buckets, "repeated")
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for p in pieces(*text_bytes(batch.column("text")), overlap=LENGTH - 1, limit=PIECE):
                runs = Runs(p)
                yield from out.add(runs.h, ids[p.rows][runs.text], runs.start - p.offsets[runs.text] + p.base)
        yield from out.flush()

    return run


def _segments(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, turn = [], 0, 31 * TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            found = exchange.positions(batch.column("found"))
            for p in pieces(*text_bytes(batch.column("text")), overlap=LENGTH - 1, limit=PIECE):
                runs = Runs(p)
                wanted = np.zeros(len(p.data) + 1, bool)
                for k, row in enumerate(p.rows):
                    lo, hi = np.searchsorted(found[row], (p.base, p.base + p.offsets[k + 1] - p.offsets[k]))
                    wanted[found[row][lo:hi] + (p.offsets[k] - p.base)] = True
                on = wanted[runs.start]
                start, count, owner, h, text = (x[on] for x in (runs.start, runs.count, runs.owner, runs.owner_h, runs.text))
                if len(start):  # both parts of a segment go as one
                    head = np.ones(len(start), bool)
                    head[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + count[:-1])
                    count = np.add.reduceat(count, np.flatnonzero(head))
                    start, owner, h, text = (x[head] for x in (start, owner, h, text))
                end = start + count + LENGTH - 1
                content = mix((runs.prefix[end] - runs.prefix[start]) * powers(BYTE_BASE, len(runs.prefix))[1][start])
                body = p.data[ragged(start, end - start)]
                parts.append((h, content, ids[p.rows][text], (start - p.offsets[text] + p.base).astype(np.int32), count.astype(np.uint8), (owner - start).astype(np.uint8), body))
                size += len(body)
                if size >= SEGMENT_FLUSH:
                    turn += 1
                    yield from _send(parts, n_buckets, turn % n_buckets)
                    parts, size = [], 0
        if parts:
            yield from _send(parts, n_buckets, (turn + 1) % n_buckets)

    return run


def _firsts(parts: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of the first of each content, in order of (h, content); body; (doc, packed span) of the others."""
    h, content, doc, pos, n, owner, body = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, doc, content, h))
    size = n.astype(np.int64) + LENGTH - 1
    offset = np.cumsum(size) - size
    h, content, doc, pos, n, owner = (x[order] for x in (h, content, doc, pos, n, owner))
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (content[1:] != content[:-1]) | (n[1:] != n[:-1])
    rest = ~first
    spans = np.stack([doc[rest], span(pos[rest], n[rest])])
    body = body[ragged(offset[order][first], size[order][first])]
    return [x[first] for x in (h, content, doc, pos, n, owner)], body, spans


def span(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (pos.astype(np.int64) << 20) | n.astype(np.int64)


def _send(parts: list, n_buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    (h, content, doc, pos, n, owner), body, spans = _firsts(parts)
    none = pa.array([b""], pa.binary())
    if spans.shape[1]:
        count = np.array([spans.shape[1]])
        yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([True]), none, none, packed_strings(spans[0], count), packed_strings(spans[1], count), none, none, none], schema=_SEGMENTS)
    if len(h):
        which, counts = np.unique(exchange.bucket_of(h, n_buckets), return_counts=True)
        sizes = np.add.reduceat(n.astype(np.int64) + LENGTH - 1, np.cumsum(counts) - counts)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.zeros(len(which), bool)), *(packed_strings(x, counts) for x in (h, content, doc, pos, n, owner)), packed_strings(body, sizes)], schema=_SEGMENTS)


def _repeats(n_buckets: int):
    """Packed spans of the windows of one bucket that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ready = [], []
        for batch in batches:
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            for mask, into in ((settled, ready), (~settled, parts)):
                rows = batch.filter(pa.array(mask))
                if not rows.num_rows:
                    continue
                get = lambda k, dtype: unpacked(rows.column(k), dtype)[0]  # noqa: B023, E731
                if into is ready:
                    into.append(np.stack([get("doc", np.int64), get("pos", np.int64)]))
                else:
                    into.append((get("h", U64), get("content", U64), get("doc", np.int64), get("pos", np.int32), get("n", np.uint8), get("owner", np.uint8), text_bytes(rows.column("body"))[0]))
        if parts:
            (h, _, doc, pos, n, owner), body, spans = _firsts(parts)
            del parts
            ready.append(spans)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            rival = np.bincount(group)[group] > 1
            size = n.astype(np.int64) + LENGTH - 1
            offset = np.cumsum(size) - size
            for lo, hi in _blocks(group, n, rival):
                take = np.flatnonzero(rival[lo:hi]) + lo
                first, last = int(offset[take[0]]), int(offset[take[-1]] + size[take[-1]])
                ready += _late(body[first:last], offset[take] - first, n[take].astype(np.int64), owner[take].astype(np.int64), doc[take], pos[take].astype(np.int64))
        if ready:
            both = np.concatenate(ready, axis=1)
            yield from exchange.by_doc(both[0], both[1], n_buckets)

    return run


def _late(data: np.ndarray, at: np.ndarray, n: np.ndarray, owner: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[np.ndarray]:
    """(doc, packed span) of the windows of segments that start earlier in another: place in data, windows, bytes before the owner, document, start."""
    prefix = prefix_hash(data, BYTE_BASE)
    of, start, n, anchor = anchored(prefix, at, n, at + owner, CLOSE)
    end = start + n + LENGTH - 1
    content = (prefix[end] - prefix[start]) * powers(BYTE_BASE, len(prefix))[1][start]
    left, doc, pos = at[of] + owner[of] - start, doc[of], pos[of] + start - at[of]
    order = np.lexsort((pos, doc, content, anchor))
    start, n, anchor, content, left, doc, pos = (x[order] for x in (start, n, anchor, content, left, doc, pos))
    new = np.ones(len(order), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = new.copy()
    first[1:] |= (content[1:] != content[:-1]) | (n[1:] != n[:-1])
    yield np.stack([doc[~first], span(pos[~first], n[~first])])
    group = (np.cumsum(new) - 1)[first]
    start, n, left, doc, pos = (x[first] for x in (start, n, left, doc, pos))
    rival = np.bincount(group)[group] > 1
    if rival.any():
        group, start, n, left, doc, pos = (x[rival] for x in (group, start, n, left, doc, pos))
        place = ragged(np.zeros(len(n), np.int64), n)
        family = np.repeat(group * 256 + left, n) - place
        doc, where = np.repeat(doc, n), np.repeat(pos, n) + place
        late = later_windows(data, ragged(start, n), family, doc, where, prefix)
        yield np.stack([doc[late], span(where[late], np.ones(int(late.sum()), np.int64))])


def _blocks(group: np.ndarray, n: np.ndarray, rival: np.ndarray, windows: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups that hold rivals, about ``windows`` each."""
    if not rival.any():
        return
    total = np.cumsum(np.where(rival, n, 0))
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(edges[1:], len(group))
    lo, done = 0, 0
    for e in ends.tolist():
        if total[e - 1] - done >= windows or e == len(group):
            if total[e - 1] > done:
                yield lo, e
            lo, done = e, total[e - 1]


def common_extension(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length, up to LENGTH, on which the suffixes at a and at b agree."""
    inverse = powers(BYTE_BASE, len(prefix))[1]
    out = np.zeros(len(a), np.int64)
    for step in (64, 32, 16, 8, 4, 2, 1):
        x, y = a + out, b + out
        room = out + step <= LENGTH
        x, y = np.where(room, x, a), np.where(room, y, b)
        same = (prefix[x + step] - prefix[x]) * inverse[x] == (prefix[y + step] - prefix[y]) * inverse[y]
        out += np.where(room & same, step, 0)
    return out


def suffix_order(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Sorts suffixes by family, then by their first LENGTH bytes, in a bottom-up mergesort over all families at once."""
    order = np.argsort(family, kind="stable")
    sorted_family = family[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_family[1:] != sorted_family[:-1]
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(order)))
    width = 1
    while width < sizes.max(initial=0):
        open_ = np.repeat(sizes > width, sizes)
        at = np.flatnonzero(open_)
        head, tail = np.repeat(begin, sizes)[at], np.repeat(begin + sizes, sizes)[at]
        run = (at - head) // width
        base = head + (run // 2) * 2 * width
        left = run % 2 == 0
        lo = np.where(left, np.minimum(base + width, tail), base)
        hi = np.where(left, np.minimum(base + 2 * width, tail), base + width)
        start_of_sibling = lo.copy()
        mine = starts[order[at]]
        for _ in range(int(width).bit_length() + 1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            other, own = starts[order[mid]], mine[live]
            reach = common_extension(data, prefix, other, own)
            tied = reach >= LENGTH
            k = np.minimum(reach, LENGTH - 1)
            below = np.where(tied, ~left[live], data[other + k] < data[own + k])
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
        merged = order.copy()
        merged[base + (at - head) % width + lo - start_of_sibling] = order[at]
        order = merged
        width *= 2
    return order


def later_windows(data: np.ndarray, starts: np.ndarray, family: np.ndarray, doc: np.ndarray, pos: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """Which windows have the bytes of a window with smaller (doc, pos)."""
    late = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return late
    prefix = prefix_hash(data, BYTE_BASE) if prefix is None else prefix
    order = suffix_order(data, prefix, starts, family)
    a, b = starts[order[:-1]], starts[order[1:]]
    same = family[order[:-1]] == family[order[1:]]
    near = np.flatnonzero(same)
    same[near] = common_extension(data, prefix, a[near], b[near]) >= LENGTH
    span_ = np.arange(LENGTH)
    for lo in range(0, len(near), 20_000):  # hashes can collide; bytes decide
        some = near[lo : lo + 20_000]
        some = some[same[some]]
        same[some] = (data[a[some, None] + span_] == data[b[some, None] + span_]).all(axis=1)
    kind = np.append(0, np.cumsum(~same))
    by = np.lexsort((pos[order], doc[order], kind))
    first = np.ones(len(by), bool)
    first[1:] = kind[by][1:] != kind[by][:-1]
    late[order[by]] = ~first
    return late


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = exchange.positions(batch.column("found"), np.int64)
        n_bytes, n_removed, n_spans, digest, kept = [], [], [], [], []
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text")), limit=PIECE):
            cover = np.zeros(len(data) + 1, np.int32)
            for k, row in enumerate(rows):
                if found[row] is not None:
                    pos, n = found[row] >> 20, found[row] & ((1 << 20) - 1)
                    np.add.at(cover, pos + offsets[k], 1)
                    np.add.at(cover, pos + offsets[k] + n + LENGTH - 1, -1)
            stay = np.cumsum(cover)[:-1] == 0
            cut = ~stay
            cut[1:] &= stay[:-1]
            head = offsets[:-1][np.diff(offsets) > 0]
            cut[head] = ~stay[head]
            left, ends = data[stay].tobytes(), np.append(0, np.cumsum(stay))[offsets]
            cuts = np.append(0, np.cumsum(cut))[offsets]
            n_bytes += np.diff(offsets).tolist()
            n_removed += (np.diff(offsets) - np.diff(ends)).tolist()
            n_spans += np.diff(cuts).tolist()
            ends = ends.tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                digest.append(hashlib.sha256(left[a:b]).hexdigest())
                kept.append(left[a:b])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], schema=_RESULT)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Removes every byte covered by a 100-byte string that also starts earlier, in a document with a
    smaller doc_id or earlier in the same one.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each document. Strings never
    cross documents and are judged on the input. A null text counts as empty and gives zeros and the digest
    of no bytes. Rows without doc_id are left out; rows that repeat a doc_id count as one document. Further
    columns of ``docs`` are ignored, whatever their names.
    """
    n = exchange.buckets(docs.sparkSession)
    keyed = exchange.keyed(docs)
    texts = keyed.repartition(n, "doc_id")
    owners = exchange.answers(keyed.mapInArrow(_owners(n), exchange.PROBES), n, "repeated")
    near = texts.join(owners.hint("shuffle_hash"), "doc_id")
    repeats = near.mapInArrow(_segments(n), SEGMENTS).repartition(n, "bucket").mapInArrow(_repeats(n), exchange.RETURNS)
    repeats = exchange.by_document(repeats, n, np.int64)
    both = texts.join(repeats.hint("shuffle_hash"), "doc_id", "left")
    return both.mapInArrow(_removed, RESULT)
