"""Sampled subword segmentations without replacement, and decoding (operator 4).

A text is a lattice of vocabulary pieces. No piece crosses from one word into the next, so the lattice is
a chain of word lattices, and a segmentation is a leaf of a tree that chooses the words' segmentations one
after another. Each piece has a log weight; backward sums over a word's lattice give the exact mass of
every node of the tree. Gumbel top-k without replacement is an A* search from the root: a node's priority
is the maximum of the perturbed log-probabilities below it, drawn top-down. Along a found segmentation the
other choices at each word form one group, whose maximum is a truncated Gumbel of the group's mass, so the
next segmentation starts from the best group of all. The k + 1-th value is the threshold of the inclusion
scores. Random numbers are hashes of row key, word and step: a row's samples do not depend on its task.
All texts of a batch are searched at once in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.blocks import BYTE_BASE, U64, mix, packed_strings, powers, prefix_hash, ragged, span_hash, text_bytes, unpacked

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 2
#: Log weight of a piece: minus SHARPNESS times the log of its rank, after Zipf's law.
SHARPNESS = 1.0
BATCH_CHARS = 300_000
#: Draws at a branch before the draw among all other segmentations.
TRIES = 64
MARK = 0x2581
#: Parts of one in which log probabilities of words are added.
UNIT = float(1 << 32)
#: The same for the probabilities of arcs.
PARTS = float(1 << 52)
#: Ids that are decoded at a time.
DECODED = 200_000
#: Characters of words whose lattices a worker keeps.
KNOWN_CHARS = 500_000
ESCAPE = 1 << 24

RESULT = "doc_id long, sample int, ids binary, n_pieces long, log_prob double, perturbed double, log_inclusion double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.binary()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64())])


class Pieces:
    """The vocabulary by hash: ids and log weights, the longest piece, the characters that pieces hold."""

    def __init__(self, name: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        n = model.get_piece_size()
        text = [(i, model.id_to_piece(i)) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        text = [(i, x) for i, x in text if chr(MARK) not in x.lstrip(chr(MARK))]
        joined = np.frombuffer("".join(x for _, x in text).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for _, x in text])
        h = span_hash(prefix_hash(joined, BYTE_BASE), np.append(0, ends[:-1]), ends, BYTE_BASE)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([i for i, _ in text])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes * U64(BYTE_BASE)) >> U64(44)] = True
        self.longest = max(len(x) for _, x in text)
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(x) for _, x in text if len(x) == 1]] = True
        self.weight = -SHARPNESS * np.log(np.arange(n) + 2.0)
        self.byte_weight = -SHARPNESS * float(np.log(n + 2.0))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Whether a piece may have each hash; few others pass."""
        return self.seen[(h * U64(BYTE_BASE)) >> U64(44)]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of each piece hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], -1)


@cache
def vocabulary(name: str) -> Pieces:
    return Pieces(name)


class Lattices:
    """The lattices of distinct words: for each node the arcs that leave it, longest piece first, with cumulative probabilities.

    Nodes are the characters, in the order of the characters that follow in their words, so backward sums
    take one run of nodes after another; node 0 is the end of every word.
    """

    def __init__(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray, pieces: Pieces):
        size = stop - start
        base = np.cumsum(size) - size
        points = points[ragged(start, size)]  # the words, one after another
        n_chars, most = len(points), min(pieces.longest, int(size.max(initial=0)))
        left = np.repeat(base + size, size) - np.arange(n_chars)  # characters up to the end of the word
        prefix, scale = prefix_hash(points, BYTE_BASE), powers(BYTE_BASE, n_chars + 1)[1]
        ids = np.full((n_chars, most), -1, np.int32)  # column j: pieces of most - j characters
        for n in range(1, most + 1):
            h = (prefix[n:] - prefix[:-n]) * scale[: n_chars - n + 1]
            on = np.flatnonzero(pieces.maybe(h) & (left[: n_chars - n + 1] >= n))
            ids[on, most - n] = pieces.find(h[on])
        odd = np.flatnonzero(~pieces.known[points])  # characters without a piece become bytes
        if len(odd):
            ids[odd, most - 1] = ESCAPE + points[odd].astype(np.int64)
        order = np.argsort(left.astype(np.uint16) if n_chars and left.max() < 1 << 16 else left, kind="stable")
        node = np.empty(n_chars, np.int64)
        node[order] = np.arange(1, n_chars + 1)
        self.first = node[base]
        hit = ids[order] >= 0
        row, column = np.nonzero(hit)
        char, n = order[row], most - column
        self.ids = ids[char, column]
        code = self.ids - ESCAPE
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        value = np.where(code < 0, pieces.weight[np.minimum(self.ids, len(pieces.weight) - 1)], n_bytes * pieces.byte_weight)
        self.dst = np.where(left[char] == n, 0, node[np.minimum(char + n, max(n_chars - 1, 0))])
        self.arcs = np.zeros(n_chars + 2, np.int64)
        np.cumsum(np.count_nonzero(hit, axis=1), out=self.arcs[2:])
        # backward sums, from the last nodes of words to the first, all words at once
        mass = np.zeros(n_chars + 1)
        edges = np.append(1, 1 + np.cumsum(np.bincount(left, minlength=1)[1:])).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            lo, hi = int(self.arcs[a]), int(self.arcs[b])
            value[lo:hi] += mass[self.dst[lo:hi]]
            at, per = self.arcs[a:b] - lo, np.diff(self.arcs[a : b + 1])
            top = np.maximum.reduceat(value[lo:hi], at)
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(value[lo:hi] - np.repeat(top, per)), at))
            value[lo:hi] -= np.repeat(mass[a:b], per)
        self.log_p = value
        whole = np.append(0, np.cumsum(np.rint(np.exp(value) * PARTS).astype(np.int64)))
        self.upto = (whole[1:] - np.repeat(whole[self.arcs[1:-1]], np.diff(self.arcs[1:]))) / PARTS
        self.upto[self.arcs[2:] - 1] = 2.0  # the last arc takes what rounding leaves


class Known:
    """Lattices of the words that a worker has met first, up to a bound; those of other words are made for each batch."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.hashes, self.words = pieces, np.empty(0, U64), np.empty(0, np.int64)
        self.lattices = Lattices(np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), pieces)

    def of(self, points: np.ndarray, start: np.ndarray, stop: np.ndarray, h: np.ndarray) -> tuple[Lattices, np.ndarray]:
        """Lattices that hold all words of a batch, and the number of each word in them."""
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
        number = np.empty(len(distinct), np.int64)
        number[known] = self.words[at[known]]
        new = np.flatnonzero(~known)
        number[new] = len(self.lattices.first) + np.arange(len(new))
        both = joined(self.lattices, Lattices(points, start[first[new]], stop[first[new]], self.pieces)) if len(new) else self.lattices
        if len(both.arcs) <= KNOWN_CHARS:
            self.lattices = both
            h, words = np.append(self.hashes, distinct[new]), np.append(self.words, number[new])
            order = np.argsort(h, kind="stable")
            self.hashes, self.words = h[order], words[order]
        return both, number[back]


def joined(x: Lattices, y: Lattices) -> Lattices:
    out = object.__new__(Lattices)
    shift = len(x.arcs) - 2  # of y's nodes, besides node 0
    out.first = np.append(x.first, y.first + shift)
    out.dst = np.append(x.dst, np.where(y.dst > 0, y.dst + shift, 0))
    out.arcs = np.append(x.arcs, y.arcs[2:] + x.arcs[-1])
    for name in ("ids", "log_p", "upto"):
        setattr(out, name, np.append(getattr(x, name), getattr(y, name)))
    return out


def sums(log_p: np.ndarray) -> np.ndarray:
    """Sums of log probabilities up to each word, in whole units: what lies between two places does not depend on what is before."""
    return np.append(0, np.cumsum(np.rint(log_p * UNIT).astype(np.int64)))


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), a function of the key."""
    return ((mix(key) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def walk(lattices: Lattices, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One segmentation of each word: its log probability, number of arcs, and all arcs, word after word."""
    n = len(word)
    log_p, count = np.zeros(n), np.zeros(n, np.int64)
    node, at = lattices.first[word], np.arange(n)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    turn, salt = 0, mix(np.arange(64, dtype=U64) + U64(0x1F))
    while len(at):
        turn += 1
        u = uniform(key[at] ^ salt[turn % len(salt)] ^ U64(turn))
        arc = lattices.arcs[node]
        on = np.flatnonzero(lattices.upto[arc] < u)
        while len(on):
            arc[on] += 1
            on = on[lattices.upto[arc[on]] < u[on]]
        log_p[at] += lattices.log_p[arc]
        count[at] += 1
        steps.append((at, arc))
        node = lattices.dst[arc]
        more = node != 0
        at, node = at[more], node[more]
    offset = np.cumsum(count) - count
    arcs = np.empty(int(count.sum()), np.int64)
    for k, (i, arc) in enumerate(steps):
        arcs[offset[i] + k] = arc
    return log_p, count, arcs


class Path:
    """A segmentation of every text of a batch: per word its log probability and arcs; per text its value and where it left its parent."""

    def __init__(self, log_p, count, arcs, value):
        self.log_p, self.count, self.arcs, self.value = log_p, count, arcs, value
        self.used = np.zeros(len(log_p))  # probability at each word that groups no longer hold
        self.group = np.full(len(log_p), -np.inf)


def truncated(log_mass: np.ndarray, bound: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The maximum of a group with this log mass, given that it is below the bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, log_mass - np.log(np.exp(np.minimum(log_mass - bound, 700)) - np.log(uniform(key))))


class Search:
    """A* over all texts of a batch at once."""

    def __init__(self, lattices: Lattices, word: np.ndarray, text: np.ndarray, n_texts: int, key: np.ndarray):
        self.lattices, self.word, self.text, self.n_texts = lattices, word, text, n_texts
        self.edges = np.searchsorted(text, np.arange(n_texts + 1))
        self.row_key = key
        place = (np.arange(len(word)) - self.edges[text]).astype(U64)
        self.key = mix(key[text] ^ mix(place + U64(1)))
        self.found: list[Path] = []

    def first(self) -> Path:
        path = Path(*walk(self.lattices, self.word, self.key), -np.log(-np.log(uniform(self.row_key ^ U64(0x51)))))
        path.used = np.exp(path.log_p)
        self._open(path, np.zeros(self.n_texts, np.int64))
        return path

    def _open(self, path: Path, since: np.ndarray) -> None:
        """Draws the maxima of the groups from each text's word number ``since`` on."""
        before = sums(path.log_p)
        lead = (before[:-1] - before[self.edges[self.text]]) / UNIT
        with np.errstate(divide="ignore"):
            mass = lead + np.log(np.where(path.used > 1 - 1e-12, 0.0, 1 - path.used))
        path.group = truncated(mass, path.value[self.text], self.key ^ mix(np.array([0xA5 + len(self.found)], U64)))
        place = np.arange(len(self.word)) - self.edges[self.text]
        path.group[place < since[self.text]] = -np.inf
        self.found.append(path)

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the best group: its value, path and word."""
        value, owner, at = np.full(self.n_texts, -np.inf), np.zeros(self.n_texts, np.int64), np.zeros(self.n_texts, np.int64)
        full = np.flatnonzero(np.diff(self.edges) > 0)
        for k, path in enumerate(self.found):
            if not len(full):
                break
            most = np.full(self.n_texts, -np.inf)
            most[full] = np.maximum.reduceat(path.group, self.edges[full])
            better = most > value
            hit = np.flatnonzero((path.group == most[self.text]) & better[self.text])
            where = np.zeros(self.n_texts, np.int64)
            where[self.text[hit]] = hit
            value[better], owner[better], at[better] = most[better], k, where[better]
        return value, owner, at

    def threshold(self) -> np.ndarray:
        return self._best()[0]

    def next(self) -> Path:
        """The next best segmentation of each text; its value is -inf where there is none."""
        value, owner, at = self._best()
        open_ = ~np.isneginf(value)
        turn = mix(np.array([len(self.found)], U64))
        log_p, count, arcs = walk(self.lattices, self.word, self.key ^ turn)
        since = np.where(open_, at - self.edges[:-1], 1 << 40)
        place = np.arange(len(self.word)) - self.edges[self.text]
        copied = place < since[self.text]
        starts = np.cumsum(count) - count
        sources = self._resample(np.flatnonzero(open_), owner, at, log_p, count, starts, arcs, turn)
        pool, pool_start = [sources], [starts]
        for path in self.found:
            pool.append(path.arcs), pool_start.append(np.cumsum(path.count) - path.count)
        from_ = np.where(copied, owner[self.text] + 1, 0)
        used = np.exp(log_p)
        for k, path in enumerate(self.found):
            on = from_ == k + 1
            log_p[on], count[on] = path.log_p[on], path.count[on]
            branch = np.flatnonzero(open_ & (owner == k))
            used[at[branch]] += path.used[at[branch]]
            path.group[at[branch]] = -np.inf
        shift = np.cumsum([0] + [len(x) for x in pool[:-1]])
        begin = np.choose(from_, pool_start) + shift[from_] if len(self.found) < 30 else np.array([pool_start[f][i] + shift[f] for i, f in enumerate(from_)], np.int64)
        path = Path(log_p, count, np.concatenate(pool)[ragged(begin, count)], value)
        path.used = used
        self._open(path, since)
        return path

    def _resample(self, texts: np.ndarray, owner: np.ndarray, at: np.ndarray, log_p: np.ndarray, count: np.ndarray, starts: np.ndarray, arcs: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """At the word where a text branches, draws until the segmentation is none that was taken there; returns all arcs."""
        if not len(texts):
            return arcs
        w, lo = at[texts], self.edges[texts]
        taken = []  # of each path: hash of its segmentation of the word, and whether it is alike before
        for path in self.found:
            begin, h = np.cumsum(path.count) - path.count, prefix_hash(path.arcs, BYTE_BASE)
            taken.append((span_hash(h, begin[lo], begin[w], BYTE_BASE), span_hash(h, begin[w], begin[w] + path.count[w], BYTE_BASE)))
        before = np.stack([x[0] for x in taken])
        alike = before == before[owner[texts], np.arange(len(texts))]
        segments = np.stack([x[1] for x in taken])
        h = prefix_hash(arcs, BYTE_BASE)
        mine = span_hash(h, starts[w], starts[w] + count[w], BYTE_BASE)
        open_ = np.flatnonzero((alike & (segments == mine)).any(axis=0))
        parts, size, tries = [arcs], len(arcs), 0
        while len(open_):
            tries += 1
            v = w[open_]
            if tries <= TRIES:
                p, n, new = walk(self.lattices, self.word[v], mix(self.key[v] ^ turn ^ mix(np.array([tries], U64))))
            else:
                p, n, new = self._deviate(v, owner[texts[open_]], self.key[v] ^ turn ^ mix(np.array([tries], U64)))
            log_p[v], count[v], starts[v] = p, n, size + np.cumsum(n) - n
            parts.append(new)
            size += len(new)
            h = prefix_hash(new, BYTE_BASE)
            mine = span_hash(h, np.cumsum(n) - n, np.cumsum(n), BYTE_BASE)
            open_ = open_[(alike[:, open_] & (segments[:, open_] == mine)).any(axis=0)]
        return np.concatenate(parts)

    def _deviate(self, at: np.ndarray, owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words whose likely segmentation is nearly sure: draws among all others, by the arc that first differs from it."""
        lat, log_p, count, arcs = self.lattices, [], [], []
        for w, o, k in zip(at.tolist(), owner.tolist(), key.tolist(), strict=True):
            path = self.found[o]
            begin = int(path.count[:w].sum())
            old = path.arcs[begin : begin + path.count[w]]
            heads = np.append(lat.first[self.word[w]], lat.dst[old[:-1]])
            lead = np.append(0.0, np.cumsum(lat.log_p[old])[:-1])
            choices = [(lead[i] + lat.log_p[a], i, a) for i, node in enumerate(heads.tolist()) for a in range(lat.arcs[node], lat.arcs[node + 1]) if a != old[i]]
            weight = np.exp(np.array([c[0] for c in choices]) - max(c[0] for c in choices))
            u = uniform(np.array([k], U64))[0] * weight.sum()
            value, i, a = choices[min(len(choices) - 1, int(np.searchsorted(np.cumsum(weight), u)))]
            mine, node, turn = [*old[:i].tolist(), a], lat.dst[a], 0
            while node:
                turn += 1
                u = uniform(mix(np.array([k + turn & (1 << 64) - 1], U64)))[0]
                a = lat.arcs[node] + int(np.argmax(lat.upto[lat.arcs[node] : lat.arcs[node + 1]] >= u))
                value, node = value + lat.log_p[a], lat.dst[a]
                mine.append(a)
            log_p.append(value), count.append(len(mine)), arcs.extend(mine)
        return np.array(log_p), np.array(count, np.int64), np.array(arcs, np.int64)


def words(points: np.ndarray, known: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word: a run of marks with what follows, or a character without a piece; none crosses an end mark."""
    n = len(points)
    odd = ~known[points]
    begin = odd.copy()
    begin[0] = True
    mark = points == MARK
    begin[1:] |= (mark[1:] & ~mark[:-1]) | odd[:-1]
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], n)
    stay = ~np.isin(start, ends)
    return start[stay], stop[stay]


def sample_texts(keys: np.ndarray, texts: list[str], store: Known, k: int) -> Iterator[dict]:
    """For each of k samples: ids and scores of all texts; a text has a sample where its value is finite."""
    marked = [(" " + x).replace(" ", chr(MARK)) if x else "" for x in texts]
    sizes = np.fromiter((len(x) for x in marked), np.int64, len(marked)) + 1
    points = np.frombuffer("\x00".join([*marked, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes) - 1
    pieces = store.pieces
    known = pieces.known.copy()
    known[0] = False
    start, stop = words(points, known, ends)
    text = np.searchsorted(ends, start)
    lattices, word = store.of(points, start, stop, span_hash(prefix_hash(points, BYTE_BASE), start, stop, BYTE_BASE))
    search = Search(lattices, word, text, len(texts), mix(keys.astype(U64)))
    paths = [search.first()]
    for _ in range(k - 1):
        paths.append(search.next())
    threshold = search.threshold()
    for path in paths:
        log_prob = np.diff(sums(path.log_p)[search.edges]) / UNIT
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            gap = log_prob - threshold
            inclusion = np.where(gap > -30, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))), gap)
        ids, n_ids = _bytes_out(lattices.ids[path.arcs], np.add.reduceat(np.append(path.count, 0), np.minimum(search.edges[:-1], len(path.count))) * (np.diff(search.edges) > 0), pieces)
        yield {"ids": ids, "n": n_ids, "log_prob": log_prob, "perturbed": path.value, "log_inclusion": inclusion}


def _bytes_out(ids: np.ndarray, per_text: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Replaces escaped characters by the ids of their bytes."""
    odd = np.flatnonzero(ids >= ESCAPE)
    if not len(odd):
        return ids.astype(np.uint32), per_text
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[odd] - ESCAPE).tolist()]
    extra = np.zeros(len(ids), np.int64)
    extra[odd] = [len(x) - 1 for x in raw]
    out = np.repeat(ids, extra + 1)
    at = odd + (np.cumsum(extra) - extra)[odd]
    out[ragged(at, extra[odd] + 1)] = pieces.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    more = np.append(0, np.cumsum(extra))
    edges = np.append(0, np.cumsum(per_text))
    return out.astype(np.uint32), per_text + np.diff(more[edges])


def _sample(name: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Known(vocabulary(name))
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            some, size = [], 0
            for i in [*range(len(texts)), None]:
                if some and (i is None or size >= BATCH_CHARS):
                    take = np.array(some)
                    for n, x in enumerate(sample_texts(keys[take], [texts[j] for j in some], store, k)):
                        on = ~np.isneginf(x["perturbed"])
                        owner = np.repeat(on, x["n"])
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(take[on])), pa.array(np.full(int(on.sum()), n + 1, np.int32)), packed_strings(x["ids"][owner], x["n"][on]), pa.array(x["n"][on]), *(pa.array(x[c][on]) for c in ("log_prob", "perturbed", "log_inclusion"))], schema=_RESULT)
                    some, size = [], 0
                if i is not None:
                    some.append(i)
                    size += len(texts[i])

    return run


def _sample_and_decode(name: str, k: int):
    sampled, decoded = _sample(name, k), _decode(name)
    return lambda batches: decoded(sampled(batches))


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, vocabulary_name: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """k distinct segmentations of each whole text, sampled without replacement, best perturbed value first.

    Returns (doc_id, sample, ids, n_pieces, log_prob, perturbed, log_inclusion), and if ``decoded`` the text
    that the ids give back, in the same worker as ``decode`` finds it; ids are unsigned 32-bit,
    little-endian; log_inclusion is the log of the probability of being above the threshold, minus infinity
    never, 0 where a text has no further segmentation. A text with fewer segmentations has fewer rows; a
    null or empty text has the empty one. The row key is doc_id, so repeated rows have equal samples; a
    null doc_id has a key of its own, and no sample depends on the other rows. Where a word has one
    segmentation that all others together come to less than 1e-12 of, it counts as its only one. A text is
    searched whole, with about 60 bytes of arrays for each character. Other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long")).alias("key"))
    if decoded:
        return keyed.mapInArrow(_sample_and_decode(vocabulary_name, k), f"{RESULT}, text string")
    return keyed.mapInArrow(_sample(vocabulary_name, k), RESULT)


def _decode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = piece_bytes(name)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column("ids"))[1])
            part = np.cumsum(sizes) // (4 * DECODED)  # rows of some ids at a time; a longer row comes alone
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                some = batch.slice(lo, hi - lo)
                column = some.column("ids")
                ids, per_row = unpacked(whole_ids(column), np.uint32)
                ids = np.minimum(ids, len(lengths) - 1).astype(np.int64)  # the last entry stands for all ids that are none
                n_bytes = lengths[ids]
                raw = table[ragged(starts[ids], n_bytes)]
                ends = np.append(0, np.cumsum(n_bytes))[np.append(0, np.cumsum(per_row))]
                out = []
                for null, a, b in zip(column.is_null().to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                    out.append(None if null else raw[a + 1 : b].tobytes().decode("utf-8", "replace"))  # without the leading space
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.string())], names=[*some.schema.names, "text"])

    return run


def whole_ids(column: pa.Array) -> pa.Array:
    """Rows cut to a multiple of four bytes."""
    if not np.any(np.diff(text_bytes(column)[1]) % 4):
        return column
    return pa.array([None if x is None else x[: len(x) // 4 * 4] for x in column.to_pylist()], pa.binary())


@cache
def piece_bytes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, one after another, and their lengths; U+FFFD at the end."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    table = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(chr(MARK), " ").encode() for i in range(model.get_piece_size())]
    table.append("\ufffd".encode())
    return np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table])


def decode(samples: DataFrame, vocabulary_name: str = VOCABULARY, kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sample, ids, the columns kept, text): the text of each row of ids.

    Null ids give a null text, an id outside the vocabulary gives U+FFFD, bytes after the last whole id nothing.
    """
    rows = samples.select("doc_id", "sample", "ids", *kept)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_decode(vocabulary_name), f"{schema}, text string")
