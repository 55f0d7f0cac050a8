"""Benchmark decontamination: CGK embedding and bit sampling over item-sized windows, then exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.memory import frugal

SIMILARITY = 0.8
#: Longest window. A longer item is cut into pieces of this many words, each looked up like an item of its own: of pieces that
#: share floor((1 - similarity) * n) edits, one has its share of them or fewer.
WINDOW = 16
#: Walks of the embedding, tables that sample coordinates of each walk, and coordinates of a table. Chosen by the recall that
#: the tests measure at the edit limit (brute force over all stretches of words).
WALKS, TABLES, SAMPLED = 8, 3, 3
#: Sizes of windows that share their tables: from each number up to the next. Coordinates are drawn from twice the least size.
CLASSES = (1, 2, 3, 4, 5, 8, 12)
#: An index takes so many words and distinct words of the benchmark, about 60 MB; a pass over the documents takes so many indexes.
SLICE_WORDS, SLICE_DISTINCT, SLICES = 1_000_000, 300_000, 4
#: Windows that are walked at a time, and cells of edit tables that are filled at a time.
CHUNK, CELLS = 16_384, 1_000_000
PADS = ("‘", "’", "“", "”", "«", "»", "—", "–", "…", "¿", "¡", " ")
_SIGNS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: str) -> list[bytes]:
    """Lower-case words, parted by white space and signs."""
    text = text.lower()
    if not text.isascii():
        for p in PADS:
            if p in text:
                text = text.replace(p, " ")
    return text.encode("utf-8", "replace").translate(_SIGNS).split()


def allowed(n: int, similarity: float) -> int:
    """Word edits that an item of n words may show: similarity is 1 - edits / n."""
    return int(math.floor(n * (1 - similarity) + 1e-9))


class Walks:
    """The embedding of windows that begin at given places of a sequence of word ids.

    CGK writes the word under a pointer at each step and lets a random bit of (walk, step, word) move the pointer on; the bits
    are those of a word's XXH32 under the walk's seed. A walk doesn't depend on the window's size, so that all sizes share it.
    """

    def __init__(self, bits: np.ndarray, ids: np.ndarray):
        self.bits, self.ids = bits, ids

    def coordinates(self, walk: int, places: np.ndarray, steps: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(step, place under the pointer) at each of the ascending steps."""
        # The places change with the next step.
        masks, p = self.bits[walk][self.ids], places.astype(np.int64)
        want, last = set(steps), max(steps, default=-1)
        for j in range(last + 1):
            if j in want:
                yield j, p
            if j < last:
                move = masks.take(p, mode="clip")
                move >>= np.uint32(j)
                move &= np.uint32(1)
                np.add(p, move, out=p, casting="unsafe")


def _key(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """64 bits of the words at a table's coordinates."""
    h = np.full(len(parts[0]), salt + 1, np.uint64)
    for x in parts:
        h += x
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h


class Index:
    """A slice of the benchmark as every executor holds it: hash tables over sampled coordinates of the embedded items."""

    def __init__(self, items: list[tuple[int, list[bytes]]], similarity: float = SIMILARITY, seed: int = 7):
        self.keys = [k for k, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, ws in items:
            for w in ws:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.sizes = np.array([len(ws) for _, ws in items], np.int64)
        self.edits = np.array([allowed(n, similarity) for n in self.sizes], np.int64)
        self.codes = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        self.bits = np.array([[xxhash.xxh32_intdigest(w, walk) for w in (b"", *self.vocabulary)] for walk in range(WALKS)], np.uint32)
        pieces = [(i, o, min(WINDOW, n)) for i, n in enumerate(self.sizes.tolist()) for o in sorted({*range(0, max(1, n - WINDOW + 1), WINDOW), max(0, n - WINDOW)})]
        self.piece_item, self.piece_at, self.piece_size = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        # A quarter of a piece's words may be edited: its share of the item's edits is a fifth or less, the overlap of the last piece aside.
        self.piece_edits = np.where(self.sizes[self.piece_item] > WINDOW, max(1, math.ceil(WINDOW * (1 - similarity))), self.edits[self.piece_item])
        self.piece_words = np.full((len(pieces), WINDOW), -1, np.int32)
        for k, (i, o, n) in enumerate(pieces):
            self.piece_words[k, :n] = self.codes[i][o : o + n]
        self.tables = self._tables(np.random.default_rng(seed))

    def _tables(self, rng: np.random.Generator) -> dict[int, list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]]:
        """walk -> tables: coordinates, a bitmap of the keys' first bits, sorted keys, and the piece of each key."""
        out: dict[int, list] = {w: [] for w in range(WALKS)}
        for c, least in enumerate(CLASSES):
            most = CLASSES[c + 1] - 1 if c + 1 < len(CLASSES) else WINDOW
            some = np.flatnonzero((self.piece_size >= least) & (self.piece_size <= most))
            for walk in range(WALKS if least >= 5 else 1):
                for _ in range(TABLES if least >= 5 else 1):
                    # A window of under five words must be equal, which its first words tell: no coordinate there can be beyond its end.
                    steps = sorted(rng.choice(2 * least, SAMPLED, replace=False).tolist()) if least >= 5 else list(range(least))
                    if len(some):
                        out[walk].append(self._table(some, walk, steps))
        return out

    def _table(self, some: np.ndarray, walk: int, steps: list[int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        width = 3 * WINDOW
        flat = np.zeros((len(some), width), np.int64)
        flat[:, :WINDOW] = np.maximum(self.piece_words[some], 0)
        own = Walks(self.bits, flat.ravel())
        begin = np.arange(len(some)) * width
        at = [p.copy() for _, p in own.coordinates(walk, begin, steps)]
        key = _key([own.ids[p].astype(np.uint64) for p in at], steps[-1])
        inside = at[-1] - begin < self.piece_size[some]  # a walk that has passed the end has padding there, which equals nothing
        key, piece = key[inside], some[inside]
        order = np.argsort(key, kind="stable")
        key = key[order]
        bitmap = np.zeros(1 << 16 + max(0, (len(key) >> 10).bit_length()), bool)
        bitmap[key >> np.uint64(64 - (len(bitmap) - 1).bit_length())] = True
        return steps, bitmap, key, piece[order]

    def lookup(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece): windows from the first n places that share a table's key with a piece, each once."""
        found, count = [], np.int64(max(1, len(self.piece_size)))
        for a in range(0, n, CHUNK):
            walks = Walks(self.bits, ids[a : a + CHUNK + 3 * WINDOW])
            places, own, wide = np.arange(min(CHUNK, n - a)), [], walks.ids.astype(np.uint64)
            for walk, tables in self.tables.items():
                words = {j: wide.take(p) for j, p in walks.coordinates(walk, places, sorted({j for t in tables for j in t[0]}))}
                for steps, bitmap, keys, pieces in tables:
                    if not len(keys):
                        continue
                    key = _key([words[j] for j in steps], steps[-1])
                    at = np.flatnonzero(bitmap[key >> np.uint64(64 - (len(bitmap) - 1).bit_length())])
                    lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
                    times = hi - lo
                    rows = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    own.append((np.repeat(at, times) + a) * count + pieces[rows])
            if own:
                found.append(np.unique(np.concatenate(own)))
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        return hits // count, hits % count

    def sharing(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """How many of a piece's words stand anywhere in ids[lo:hi]: n less the edits at least, if the piece is there."""
        out = np.zeros(len(piece), np.int64)
        width = int((hi - lo).max(initial=0))
        for a in range(0, len(piece), CHUNK):
            l_, h, words = lo[a : a + CHUNK], hi[a : a + CHUNK], self.piece_words[piece[a : a + CHUNK]]
            seen = np.zeros(words.shape, bool)
            for k in range(width):
                c = np.where(l_ + k < h, ids[np.minimum(l_ + k, len(ids) - 1)], 0)
                seen |= words == c[:, None]
            out[a : a + CHUNK] = seen.sum(1)
        return out

    def distances(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
        """The least number of word edits between each wanted sequence and any stretch of ids[lo:hi]."""
        sizes = np.array(list(map(len, wanted)), np.int64)
        out = sizes.copy()
        order = np.lexsort((hi - lo, sizes))
        at = 0
        while at < len(order):
            rows = order[at : at + max(1, CELLS // (int(sizes[order[at]]) + 1))]
            rows = rows[sizes[rows] <= 2 * sizes[rows[0]] + 8]
            at += len(rows)
            n = int(sizes[rows].max())
            want = np.full((len(rows), n), -1, np.int64)
            for r, k in enumerate(rows.tolist()):
                want[r, : sizes[k]] = wanted[k]
            ramp = np.arange(n + 1)
            d = np.broadcast_to(ramp, (len(rows), n + 1)).copy()
            best, last = sizes[rows].copy(), sizes[rows]
            l_, h = lo[rows], hi[rows]
            for k in range(int((h - l_).max(initial=0))):
                on = l_ + k < h
                c = np.where(on, ids[np.minimum(l_ + k, len(ids) - 1)], -2)
                t = np.minimum(d[:, :-1] + (want != c[:, None]), d[:, 1:] + 1)
                new = np.concatenate([np.zeros((len(rows), 1), np.int64), t], axis=1)
                d = np.minimum.accumulate(new - ramp, axis=1) + ramp
                best = np.where(on, np.minimum(best, d[np.arange(len(rows)), last]), best)
                if not best.any():
                    break
            out[rows] = best
        return out

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(text's place, item's place, word edits) for each item that a text holds at the similarity or closer."""
        get = self.vocabulary.get
        parts = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        ends = np.cumsum(sizes)  # place of the gap after each text; place 0 is the gap before the first
        begins = ends - sizes + 1
        n = int(sizes.sum()) + 1
        ids = np.zeros(n + 3 * WINDOW, np.int64)
        for p, b in zip(parts, begins.tolist(), strict=True):
            ids[b : b + len(p)] = np.fromiter(map(get, p, repeat(0)), np.int64, len(p))
        del parts
        place, piece = self.lookup(ids, n)
        found: dict[tuple[int, int], int] = {}
        for a in range(0, len(place), 50_000):
            for x, y, z in self._verify(ids, begins, ends, place[a : a + 50_000], piece[a : a + 50_000]):
                found[x, y] = min(z, found.get((x, y), z))
        return [(x, y, z) for (x, y), z in sorted(found.items())]

    def _verify(self, ids, begins, ends, place, piece) -> Iterator[tuple[int, int, int]]:
        # A window may begin in the gap before its text, or reach into the next: both texts are tried.
        doc, other = (np.clip(np.searchsorted(begins, at, "right") - 1, 0, len(begins) - 1) for at in (place, place + self.piece_size[piece] // 2))
        more = other != doc
        doc, place, piece = np.concatenate([doc, other[more]]), np.concatenate([place, place[more]]), np.concatenate([piece, piece[more]])
        e = self.piece_edits[piece]
        lo, hi = np.maximum(begins[doc], place - e), np.minimum(ends[doc], place + self.piece_size[piece] + e)
        ok = np.flatnonzero(self.sharing(ids, lo, hi, piece) >= self.piece_size[piece] - e)
        doc, place, piece, lo, hi, e = (x[ok] for x in (doc, place, piece, lo, hi, e))
        cut = [self.codes[i][a : a + n] for i, a, n in zip(self.piece_item[piece].tolist(), self.piece_at[piece].tolist(), self.piece_size[piece].tolist(), strict=True)]
        near = self.distances(ids, lo, hi, cut) <= e
        doc, place, piece = doc[near], place[near], piece[near]
        # Stretches around the pieces that an item's copy may fill; those of one text and item that overlap are one.
        item = self.piece_item[piece]
        e, start = self.edits[item] + self.piece_edits[piece], place - self.piece_at[piece]
        lo, hi = np.maximum(begins[doc], start - e), np.minimum(ends[doc], start + self.sizes[item] + e)
        order = np.lexsort((lo, item, doc))
        doc, item, lo, hi = (x[order] for x in (doc, item, lo, hi))
        if not len(doc):
            return
        group = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        reach = np.maximum.accumulate(hi + np.cumsum(group) * len(ids)) - np.cumsum(group) * len(ids)
        first = np.flatnonzero(group | np.concatenate([[True], lo[1:] > reach[:-1]]))
        last = np.concatenate([first[1:], [len(doc)]]) - 1
        doc, item, lo, hi = doc[first], item[first], lo[first], reach[last]
        for x, y, z in zip(doc.tolist(), item.tolist(), self.distances(ids, lo, hi, [self.codes[i] for i in item.tolist()]).tolist(), strict=True):
            if z <= self.edits[y]:
                yield x, y, z


def indexes(benchmark: DataFrame, *, key: str = "item_id", text: str = "text", similarity: float = SIMILARITY) -> list[Index]:
    """The benchmark in slices of bounded size, fetched partition by partition; items without a word take no part.

    A slice closes before it would pass SLICE_WORDS or SLICE_DISTINCT; an item that is larger alone is a slice of its own.
    """
    out, items, n, seen = [], [], 0, set()
    for r in benchmark.select(F.col(key).cast("long"), F.col(text).cast("string")).toLocalIterator():
        ws = words_of(r[1] or "")
        if not ws:
            continue
        own = set(ws)
        if items and (n + len(ws) > SLICE_WORDS or len(seen | own) > SLICE_DISTINCT):
            out.append(Index(items, similarity))
            items, n, seen = [], 0, set()
        items.append((r[0], ws))
        n += len(ws)
        seen |= own
    return [*out, Index(items, similarity)] if items else out


def _batched(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list]]:
    """(place of the first, texts): runs of texts of about `most` bytes; a longer text is one of its own. Only a run's texts are Python's at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size > most:
            yield at, texts.slice(at, i + 1 - at).to_pylist()
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts.slice(at).to_pylist()


def _passes(docs: DataFrame, benchmark: DataFrame, similarity: float) -> list[list]:
    """Broadcast indexes, at most SLICES for one pass over the documents."""
    shared = [docs.sparkSession.sparkContext.broadcast(i) for i in indexes(benchmark, similarity=similarity)]
    return [shared[i : i + SLICES] for i in range(0, len(shared), SLICES)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, n_words, similarity) for each row of docs and item that it holds.

    A row holds an item if some stretch of its words is within floor((1 - similarity) * n) word edits of the
    item's n words; items may have any number of words (of fewer than five, all must stand there). Null, empty and clean texts give
    no row; repeated rows give theirs each, repeated items too; an empty table on either side gives none. Texts are read whole
    and never shuffled. Every window of a text is embedded and looked up in the items' tables; what they find is verified by the exact
    edit distance, so that no row is wrong, and a leak is missed only if no table finds any of its windows. The benchmark
    is broadcast in indexes of bounded size, up to SLICES of them in one pass over the documents.
    """
    schema = "doc_id long, item_id long, edits long, n_words long, similarity double"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _passes(docs, benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), []
                for at, texts in _batched(batch.column(1)):
                    for index in (s.value for s in shared):
                        for d, i, e in index.leaks(texts):
                            n = int(index.sizes[i])
                            found.append((ids[at + d], index.keys[i], e, n, 1 - e / n))
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "edits", "n_words", "similarity"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """docs without the rows that hold an item of the benchmark, by find_leaks()'s rule; all columns stay, whatever their names."""
    place = docs.columns.index(text)
    for shared in _passes(docs, benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {at + d for at, texts in _batched(batch.column(place)) for s in shared for d, _, _ in s.value.leaks(texts)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs
