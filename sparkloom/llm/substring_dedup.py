"""Removal of repeated byte strings: sampled suffixes, range-partitioned and sorted, compared with their neighbours."""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.shared_store import discard, materialize

#: Length of the strings, and of the gram whose hash chooses the suffix that stands for a window.
LENGTH, GRAM = 200, 48
#: Bytes that are hashed at a time; the packed key keeps a place in 18 bits.
PIECE, PLACE = 200_000, 18
#: A window begins so many bytes before its suffix at most.
REACH = LENGTH - GRAM
#: Of range partitions: bytes of contexts. Of contexts with one leading key: more are parted by further bytes, into so many shares at a time.
RANGE_BYTES, MOST, SHARES = 12_000_000, 1500, 4
#: What _contexts() holds before it hands it on: bytes.
HELD = 8_000_000
B = 0x9E3779B97F4A7C15


def _powers() -> dict[int, np.uint64]:
    out, p = {}, B
    for n in (1, 2, 4, 8, 16):
        out[n] = np.uint64(p)
        p = p * p % 2**64
    return out


POWERS = _powers()


def grams(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on, by doubling."""
    h = x.astype(np.uint64) + np.uint64(1)
    by = {1: h}
    for n in (1, 2, 4, 8, 16):
        h = h[:-n] * POWERS[n] + h[n:]
        by[2 * n] = h
    h = by[32][:-16] * POWERS[16] + by[16][32:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def anchors(text: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, place, first, last): each window's suffix is that of its gram of the smallest hash, leftmost of equals.

    Windows of one content have it at one offset, so windows only need comparing where their suffixes' grams agree. Windows
    from `first` to `last` have the suffix at `place`; each window of the PIECE from `at` on is in one such run.
    """
    low = np.uint64((1 << PLACE) - 1)
    h = grams(np.frombuffer(text, np.uint8)[at : at + PIECE + LENGTH - 1])
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    for n in (1, 2, 4, 8, 16, 32, 64):
        m = np.minimum(m[:-n], m[n:])
    rest = REACH + 1 - 128
    m = np.minimum(m[:-rest], m[rest:])
    place = (m & low).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    last = np.concatenate([first[1:], [len(place)]]) - 1
    p = place[first]
    return h[p].view(np.int64), p + at, first + at, last + at


def _without_copies(text: bytes, runs: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """The runs with each content once, and the byte spans of those that the text holds more than once.

    Of equal runs every window starts elsewhere in the same text, so the spans are known to be repeated; one of them stands for all.
    """
    gram, place, first, last = runs
    size = np.uint64(0x9E3779B97F4A7C15) * (place - first).astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F) * (last - first).astype(np.uint64)
    key = gram.view(np.uint64) ^ size
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    maybe = np.sort(order[same[1:] | same[:-1]])
    seen: dict[tuple[int, bytes], int] = {}
    keep, spans, told = np.ones(len(key), bool), [], set()
    for i, p, s, e in zip(*(c[maybe].tolist() for c in (np.arange(len(key)), place, first, last)), strict=True):
        if (j := seen.setdefault((p - s, text[s : e + LENGTH]), i)) != i:
            keep[i] = False
            for k in (i,) if j in told else (j, i):
                told.add(j)
                a, z = int(first[k]), int(last[k]) + LENGTH
                if spans and spans[-1][0] <= a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
                else:
                    spans.append((a, z))
        if len(spans) > 100_000:
            spans = merge(spans)
    return tuple(c[keep] for c in runs), spans


def distinct_runs(text: bytes) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """The runs of anchors(), each content once, and the spans of those that come more than once. Pieces are settled one after another, so that
    a text that repeats itself everywhere takes no more memory than a piece of it."""
    if len(text) < LENGTH:
        return (np.zeros(0, np.int64),) * 4, []
    kept, spans = [], []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        runs, own = _without_copies(text, anchors(text, at))
        kept.append(runs)
        spans = merge([*spans, *own])
    runs = tuple(np.concatenate(c) for c in zip(*kept, strict=True))
    if len(kept) > 1:
        runs, own = _without_copies(text, runs)
        spans = merge([*spans, *own])
    return runs, spans


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, shas, parts, spans = [], [], [], []
        for t in batch.column(2):
            b = (t.as_py() or "").encode()
            sizes.append(len(b))
            shas.append(hashlib.sha256(b).hexdigest())
            runs, own = distinct_runs(b)
            parts.append(runs)
            spans.append(own)
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]).astype(k))) for i, k in enumerate((np.int64, np.int32, np.int32, np.int32))]
        spans = pa.array([[{"a": a, "b": z} for a, z in own] for own in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), *lists, spans], ["doc_id", "mark", "n_bytes", "sha", "gram", "place", "first", "last", "own"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that each run of windows covers; `left` of them stand before the suffix."""
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for doc, mark, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            b = (text.as_py() or "").encode()
            cols = [runs.values.field(i).to_numpy() for i in range(3)]
            for p, s, e in zip(*(c.tolist() for c in cols), strict=True):
                ctx = b[s : e + LENGTH]
                out.append((doc, mark, s, hashlib.blake2b((p - s).to_bytes(2, "big") + ctx, digest_size=16).digest(), p - s, ctx))
                held += len(ctx) + 80
                if held > HELD:
                    yield _ctx_batch(out)
                    out, held = [], 0
    yield _ctx_batch(out)


_CTX = [("doc_id", pa.int64()), ("mark", pa.int64()), ("first", pa.int32()), ("cid", pa.binary()), ("left", pa.int32()), ("ctx", pa.binary())]


def _ctx_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_CTX)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _CTX, strict=True)], [n for n, _ in _CTX])


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings (a matrix): by eight bytes at a time, only among those equal so far."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: the place where the run of rows equal so far begins
    open_ = np.arange(n)  # places in `order` that aren't settled
    for w in range(words.shape[1]):
        if len(open_) < 2:
            break
        rows_, g = order[open_], group[open_]
        key = words[rows_, w]
        by = np.lexsort((key, g))
        order[open_] = rows_[by]
        g, key = g[by], key[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the sorted order, and how many first bytes each row shares with the one before it (first row: 0)."""
    order = multikey_sort(rows)
    lcp = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 20_000):
        o = order[a - 1 : a + 20_000]
        same = rows[o[1:]] == rows[o[:-1]]
        lcp[a : a + len(same)] = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return order, lcp


def repeated_windows(contexts: list[bytes], left: np.ndarray, copies: np.ndarray, least: int = 0, most: int = REACH) -> list[list[tuple[int, int]]]:
    """For each context the spans of it that repeated windows cover, of windows that begin `least` to `most` bytes before the suffix.

    A window `o` bytes before the suffix is repeated if another context agrees in the o bytes to the left and in the
    rest to the right of its suffix. The suffixes are sorted, as are the reversed left parts; neighbours that share
    enough bytes are one class, and a pair of classes that comes twice is a repeated window. Contexts with copies are
    repeated whole.
    """
    m = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, m)
    flat = np.frombuffer(b"".join(contexts) + b"\0" * (LENGTH + REACH), np.uint8)
    begin = np.cumsum(sizes) - sizes
    right, before = np.zeros((m, LENGTH - least), np.uint8), np.zeros((m, max(1, most)), np.uint8)
    for a in range(0, m, 8192):
        own, n, l_ = begin[a : a + 8192, None], sizes[a : a + 8192, None], left[a : a + 8192, None]
        step = np.arange(LENGTH - least)
        right[a : a + 8192] = np.where(step < n - l_, flat[own + l_ + step], 0)
        step = np.arange(max(1, most))
        before[a : a + 8192] = np.where(step < l_, flat[np.maximum(own + l_ - 1 - step, 0)], 0)
    nearest = LENGTH - (sizes - left)  # the last window of the run begins so many bytes before the suffix
    r_order, r_lcp = _classes(right)
    l_order, l_lcp = _classes(before)
    hit_rows, hit_offs = [], []
    whole = copies > 1
    for o in range(least, most + 1):
        r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
        r_class[r_order] = np.cumsum(r_lcp < LENGTH - o)
        l_class[l_order] = np.cumsum(l_lcp < o) if o else 0
        rows = np.flatnonzero((nearest <= o) & (left >= o))
        pair = r_class[rows] * (m + 1) + l_class[rows]
        by = np.argsort(pair, kind="stable")
        p = pair[by]
        same = np.zeros(len(p), bool)
        eq = p[1:] == p[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        got = rows[by[same]]
        hit_rows.append(got)
        hit_offs.append(np.full(len(got), o))
    rows, offs = np.concatenate(hit_rows), np.concatenate(hit_offs)
    starts = left[rows] - offs
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + LENGTH)]) if len(rows) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    for a, z in zip(first.tolist(), np.concatenate([first[1:], [len(rows)]]).tolist() if len(rows) else [], strict=False):
        out[rows[a]].append((int(starts[a]), int(starts[z - 1]) + LENGTH))
    for i in np.flatnonzero(whole).tolist():
        out[i] = [(0, int(sizes[i]))]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over range partitions sorted by leading key: groups of whole keys are compared, a few thousand contexts at a time."""
    key = lambda b, i: tuple(b.column(c)[i].as_py() for c in ("lo", "lead"))

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        for lo in t["lo"].unique().to_pylist():
            some = t.filter(pc.equal(t["lo"], lo))
            for hi in some["hi"].unique().to_pylist():
                part = some.filter(pc.equal(some["hi"], hi))
                spans = repeated_windows(part["ctx"].to_pylist(), part["left"].to_numpy().astype(np.int64), part["copies"].to_numpy(), lo, hi)
                found = [(c, [x for x, _ in s], [y for _, y in s]) for c, s in zip(part["cid"].to_pylist(), spans, strict=True) if s]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 3, (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], ["cid", "since", "until"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        leads = list(zip(batch.column("lo").to_pylist(), batch.column("lead").to_pylist(), strict=True))
        end = next((i for i in range(len(leads) - 1, 0, -1) if leads[i] != leads[i - 1]), 0)
        if held and (end or key(held[-1], -1) != leads[0]):
            whole = end if key(held[-1], -1) == leads[0] else 0
            yield from done([*held, batch.slice(0, end)] if whole else held)
            held, batch = [], batch.slice(whole)
            end -= whole
        if end:
            yield from done([batch.slice(0, end)])
        held.append(batch.slice(end))
    if held:
        yield from done(held)


def _lead(lo: Column, hi: Column) -> Column:
    """The bytes that windows from lo to hi bytes before the suffix have in common: to its right, and to its left."""
    return F.concat(F.substring(F.col("ctx"), F.col("left") + 1, F.lit(LENGTH) - hi), F.substring(F.col("ctx"), F.col("left") - lo + 1, lo))


def _flagged(distinct: DataFrame, spark) -> DataFrame:
    """(cid, since, until) for contexts that hold a repeated window, with the spans that such windows cover.

    Contexts meet by their suffix's first bytes. Where over MOST have these in common, the windows are parted by how many bytes before
    the suffix they begin: those of a share have more bytes in common, to the right or the left, which make a longer key.
    Shares of a key that is still too common are parted again; those of one offset are whole windows, which need no sorting.
    """
    schema, keys = "cid binary, since array<int>, until array<int>", ["lo", "hi", "lead"]
    lo, hi = F.col("lo"), F.col("hi")
    rows = distinct.withColumns({"lo": F.lit(0), "hi": F.lit(REACH)}).withColumn("lead", _lead(lo, hi))
    size, ready, found, stored = rows.agg(F.sum(F.length("ctx"))).first()[0] or 0, [], [], []
    while True:
        hot = materialize(rows.groupBy(keys).count().filter(F.col("count") > MOST).select(keys), "hot-leads")
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(hot, keys, "left_anti"))
        rest = rows.join(hot, keys, "left_semi")
        since = F.col("left") - lo
        found.append(rest.filter(lo == hi).select("cid", F.array(since).alias("since"), F.array(since + LENGTH).alias("until")))
        step = F.greatest(F.lit(1), F.ceil((hi - lo + 1) / SHARES)).cast("int")
        shares = rest.filter(lo < hi).withColumn("from", F.explode(F.sequence(lo, hi, step)))
        shares = shares.select("cid", "copies", "left", "ctx", F.col("from").alias("lo"), F.least(F.col("from") + step - 1, hi).alias("hi"))
        # A context takes part in a share that has one of its windows: the last begins LENGTH bytes before its end.
        shares = shares.filter((F.col("left") >= lo) & (F.lit(LENGTH) - F.length("ctx") + F.col("left") <= hi))
        rows = materialize(shares.withColumn("lead", _lead(lo, hi)), "shares", compression="zstd")
        size += rows.agg(F.sum(F.length("ctx"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    columns = [*keys, "cid", "copies", "left", "ctx"]
    all_ = functools.reduce(DataFrame.unionByName, [r.select(columns) for r in ready])
    out = all_.repartitionByRange(parts, "lo", "lead").sortWithinPartitions("lo", "lead").mapInArrow(_compare, schema)
    return functools.reduce(DataFrame.unionByName, found, out)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, mark, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            b = (text.as_py() or "").encode()
            gone = merge([(x["a"], x["b"]) for x in spans])
            kept, at = hashlib.sha256(), 0
            for x, y in gone:
                kept.update(b[at:x])
                at = y
            kept.update(b[at:])
            out.append((doc, mark, sum(y - x for x, y in gone), len(gone), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string()), strict=True)], ["doc_id", "mark", "n_removed", "n_spans", "kept_sha256"])


def _tidy(spark) -> None:
    """Let Spark drop the shuffle files of what has been written out."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has doc_id, mark, n_bytes, sha and copies (rows with that whole text); spans has (doc_id, mark, spans)
    of the texts that come once, with the byte spans that repeated strings cover (they may overlap)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    lists = "gram array<long>, place array<int>, first array<int>, last array<int>, own array<struct<a:int,b:int>>"
    rows = materialize(texts.mapInArrow(_scan, f"doc_id long, mark long, n_bytes long, sha string, {lists}"), "rows")
    # Of copies one stands for all: each string of theirs starts in another copy too.
    classes = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r"))
    classes = materialize(classes.select("sha", "copies", F.col("r.doc_id").alias("rep")), "classes")
    own = rows.filter("n_bytes >= 200").join(classes.withColumnRenamed("sha", "c"), (F.col("sha") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    each = own.select("doc_id", "mark", F.explode(F.arrays_zip("gram", "place", "first", "last")).alias("x")).select("doc_id", "mark", "x.*")
    # Written out, so that the join reads two plain exchanges, whose hot keys Spark can split.
    twice = materialize(each.groupBy("gram").count().filter("count > 1").select("gram"), "grams")
    hits = each.join(twice, "gram", "left_semi").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "first", "last")).alias("runs"))
    hits = materialize(hits, "runs")
    slim = materialize(rows.select("doc_id", "mark", "n_bytes", "sha"), "sizes")
    alone = materialize(own.filter(F.size("own") > 0).select("doc_id", "mark", F.explode("own").alias("s")), "own-spans")
    discard(twice, rows)
    _tidy(spark)
    paired = texts.join(hits.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "runs"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    contexts = paired.select("doc_id", "mark", "text", "runs").mapInArrow(_contexts, "doc_id long, mark long, first int, cid binary, left int, ctx binary")
    contexts = materialize(contexts, "contexts", compression="zstd")
    discard(hits)
    _tidy(spark)
    # Strings agree, and must be compared, only where contexts differ: copies of a context are counted first.
    distinct = contexts.groupBy("cid").agg(F.count("*").alias("copies"), F.first("left").alias("left"), F.first("ctx").alias("ctx"))
    distinct = materialize(distinct, "distinct", compression="zstd")
    _tidy(spark)
    flags = materialize(_flagged(distinct, spark), "flags")
    discard(distinct)
    _tidy(spark)
    owners = contexts.select("doc_id", "mark", "first", "cid").join(flags, "cid")
    spans = F.transform(F.arrays_zip("since", "until"), lambda s: F.struct((s["since"] + F.col("first")).alias("a"), (s["until"] + F.col("first")).alias("b")))
    spans = owners.select("doc_id", "mark", F.explode(spans).alias("s")).unionByName(alone).groupBy("doc_id", "mark").agg(F.collect_list("s").alias("spans"))
    spans = materialize(spans, "spans")
    discard(contexts, flags, alone)
    return slim.join(classes.select("sha", "copies"), "sha", "left"), spans


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row: its UTF-8 bytes without those that a 200-byte string
    covers which starts anywhere else, in another row or in the same.

    Matches don't cross rows, overlaps count, and all is judged on the input. Null text is empty; texts under 200 bytes
    stay whole; of repeated rows and copies each loses all (if it has 200 bytes). An empty table gives no rows. No text is compared with all others:
    one suffix stands for the windows around it (about one in 77 bytes), those whose first 48 bytes occur once go,
    the rest are range-partitioned at sampled splitters, sorted and compared in their partition; equal leading
    keys meet in one partition, so that no pair lies across a boundary, and a key that many have is made longer (see _flagged()).
    A text that repeats itself, however long, is settled piece by piece where it is read.
    """
    rows, spans = repeated_spans(docs, key=key, text=text)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    paired = texts.join(spans.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "spans"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    cut = paired.select("doc_id", "mark", "text", "spans").mapInArrow(_cut, "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string")
    cut = materialize(cut.dropDuplicates(["doc_id", "mark"]), "cut")
    discard(spans)
    _tidy(docs.sparkSession)
    cut = cut.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "n_removed", "n_spans", "kept_sha256")
    both = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select(
        "doc_id", "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
