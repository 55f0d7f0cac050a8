"""Packing of tokenised documents into sequences of a fixed size: best-two-fit over the histogram of lengths."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.memory import frugal
from sparkloom.shared_store import materialize

SIZE = 2048
END = 0
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
#: Texts of these characters alone go to the faster tokenizer of the same vocabulary; both split them alike.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧]*")
#: Items of one length and share: how many get their ranks in one task.
SHARE = 50_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(4)
def _encoders(vocabulary: str):
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    fast = None
    ranks_at = re.sub(r"\.json$", ".tiktoken", vocabulary)
    try:
        with open(ranks_at, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        end = slow.token_to_id("<|endoftext|>")
        if slow.get_vocab_size() == len(ranks) + 1 and end == len(ranks):
            fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end})
    except FileNotFoundError:
        pass
    return slow, fast


def token_ids(text: str, vocabulary: str) -> list[int]:
    """The ids that the tokenizers library gives without special tokens around."""
    slow, fast = _encoders(vocabulary)
    if fast is not None and PLAIN.fullmatch(text):
        return fast.encode(text, allowed_special="all")
    return slow.encode(text, add_special_tokens=False).ids


def cut(ids: np.ndarray, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole up to `size`; else full pieces after a first one that takes the remainder."""
    n = len(ids)
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _tokenize(vocabulary: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            out: list[tuple] = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.array([*token_ids(text.as_py() or "", vocabulary), END], "<u4")
                out += [(doc, row, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(ids, size))]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return frugal(run)


def tokenize(docs: DataFrame, *, vocabulary: str | None = None, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) for each piece of each row's ids and the closing id 0; null text: empty.

    Only ids' checksums leave the tokenizer, so the texts are read once and never shuffled.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_tokenize(vocabulary or default_vocabulary(), size), PIECES)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many)]) for each kind of bin: best-two-fit over how many items of each length there are.

    A bin is filled greedily with the largest item that fits. With nothing left that fits the gap, its smallest item
    gives way to the two unpacked ones that together fill the larger gap best, if they fill it more tightly; then
    the filling goes on. A kind of bin is used as often as its items last, so the work and the plan depend on the
    number of lengths (`size` at most), not on the number of items.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] += c
    bins = []
    while left.any():
        here, bin_, gap = left.copy(), [], size

        def below(limit: int, of: np.ndarray) -> int:
            at = np.flatnonzero(of[1 : limit + 1]) if limit > 0 else []
            return int(at[-1]) + 1 if len(at) else 0

        while True:
            while n := below(gap, here):
                bin_.append(n)
                here[n] -= 1
                gap -= n
            if not gap:
                break
            least = min(bin_)
            room = gap + least
            lengths = np.flatnonzero(here[: room + 1])
            lengths = lengths[lengths > 0]
            if not len(lengths):
                break
            partner = np.zeros(room + 1, np.int64)
            have = np.arange(room + 1) * (here[: room + 1] > 0)
            partner = np.maximum.accumulate(have)
            other = partner[room - lengths]
            alone = (other == lengths) & (here[lengths] < 2)
            if alone.any():
                other[alone] = [below(int(n) - 1, here) for n in lengths[alone]]
            total = np.where(other > 0, lengths + other, 0)
            best = int(total.argmax())
            if total[best] <= least:
                break
            bin_.remove(least)
            here[least] += 1
            for n in (int(lengths[best]), int(other[best])):
                bin_.append(n)
                here[n] -= 1
            gap = room - int(total[best])
        use = np.bincount(bin_, minlength=size + 1)
        some = np.flatnonzero(use)
        times = int((left[some] // use[some]).min())
        left -= use * times
        bins.append((times, [(int(n), int(use[n])) for n in sorted(some, reverse=True)]))
    return bins


def _slots(bins: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[int, list[np.ndarray]]:
    """Per length: from which rank on (ascending), the bin's first sequence, items of that length in it, their offset."""
    out: dict[int, list] = {}
    taken = np.zeros(size + 1, np.int64)
    first = 0
    for times, items in bins:
        at = 0
        for n, k in items:
            out.setdefault(n, []).append((int(taken[n]), first, k, at))
            taken[n] += times * k
            at += n * k
        first += times
    return {n: [np.array(c, np.int64) for c in zip(*rows, strict=True)] for n, rows in out.items()}


def _place(slots):
    def run(frames):
        for f in frames:
            rank, length = f["rank"].to_numpy(), f["length"].to_numpy()
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(f) else []:
                n = int(length[part[0]])
                since, first, each, at = slots.value[n]
                i = np.searchsorted(since, rank[part], "right") - 1
                r = rank[part] - since[i]
                seq[part] = first[i] + r // each[i]
                off[part] = at[i] + (r % each[i]) * n
            yield f.drop(columns=["rank", "row"]).assign(sequence_id=seq, offset=off)

    return run


def pack(docs: DataFrame, *, vocabulary: str | None = None, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    The pieces' histogram of lengths (at most `size` numbers) comes to the driver, which plans the kinds of bins; each
    piece finds its place by its rank among those of its length. Ranks are counted in shares of each length, so that
    a length with a third of all pieces is many tasks. Null text is empty and takes one id. Repeated rows are packed
    each; an empty table gives no rows. Every piece is placed.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, vocabulary=vocabulary, size=size, key=key, text=text), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    shares = max(16, max(counts.values(), default=0) // SHARE)
    slots = spark.sparkContext.broadcast(_slots(plan_bins(counts, size), size))
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("row", "piece"), F.lit(shares)))
    per = pieces.groupBy("length", "share").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("length", "share", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "row"))
    ranked = pieces.withColumn("own", own).join(per, ["length", "share"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    ranked = ranked.select("doc_id", "row", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
