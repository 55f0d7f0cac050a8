"""SimHash near-duplicates: fingerprints, a Hamming self-join on binary tries, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.shared_store import materialize

#: Bits of one of the four blocks of a fingerprint.
BLOCK = 16
#: Pairs of trie nodes that one step of the traversal holds.
FRONT = 200_000
#: Fingerprints that one task takes from one bucket; a larger bucket is parted by more bits, and then becomes a grid of tasks.
CHUNK = 8192
SPACES = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits, each set if it is in over half of the XXH64 (seed 42) of the text's shingles; 0 without a word."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z alone change, and ASCII white space alone parts
    if not parts:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h64(b" ".join(parts), 42)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = starts + sizes
    hashes = np.array([h64(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py() or "", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one 64-bit fingerprint for each row; null and wordless texts: 0."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_prints(words), "doc_id long, fp long")


def trie_self_join(bits: np.ndarray, tree: np.ndarray, budget: int, sides: np.ndarray | None = None, across: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in `bits` (uint64, sorted within each `tree`, trees in ascending order) at `budget` bits or fewer.

    Each tree's sorted values are a binary trie, whose nodes are ranges. Pairs of nodes go down together: both to 0 or
    both to 1 cost nothing, one to each costs a bit, and a pair beyond the budget is dropped with all below it. Nodes of
    one value each are compared outright. With `sides`, only pairs of one value of either side come out. With `across` (starts and
    ends of ranges, and of those to join each with), whole ranges are joined with others instead of trees with themselves.
    """
    n = len(bits)
    if not n:
        return
    starts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    many = ends - starts > 1
    a0, a1, b0, b1 = across if across is not None else (starts[many], ends[many], starts[many], ends[many])
    z = np.zeros(len(a0), np.int64)
    stack = [(a0, a1, b0, b1, z, z + 63)]
    one = np.uint64(1)
    while stack:
        a0, a1, b0, b1, cost, level = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [tuple(x[half:] for x in (a0, a1, b0, b1, cost, level)), tuple(x[:half] for x in (a0, a1, b0, b1, cost, level))]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        go = ~leaf & (level >= 0)
        a0, a1, b0, b1, cost, level = (x[go] for x in (a0, a1, b0, b1, cost, level))
        if not len(a0):
            continue
        am, bm = _middle(bits, a0, a1, level, one), _middle(bits, b0, b1, level, one)
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, cost, level - 1), (am, a1, bm, b1, cost, level - 1), (a0, am, bm, b1, cost + 1, level - 1)]
        other = ~same
        kids.append(tuple(x[other] for x in (am, a1, b0, bm, cost + 1, level - 1)))
        cols = [np.concatenate(c) for c in zip(*kids, strict=True)]
        ok = (cols[1] > cols[0]) & (cols[3] > cols[2]) & (cols[4] <= budget) & ~((cols[0] == cols[2]) & (cols[1] - cols[0] == 1) & (cols[3] - cols[2] == 1))
        if sides is not None:
            ok &= ~((cols[1] - cols[0] == 1) & (cols[3] - cols[2] == 1) & (sides[np.minimum(cols[0], n - 1)] == sides[np.minimum(cols[2], n - 1)]))
        stack.append(tuple(c[ok] for c in cols))


def _middle(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray, one: np.uint64) -> np.ndarray:
    """Where in each sorted range, equal above `level`, that bit becomes 1: a binary search for all at once."""
    lo, hi, shift = lo.copy(), hi.copy(), level.astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = open_ & (((bits[np.minimum(mid, len(bits) - 1)] >> shift) & one) == 1)
        hi = np.where(up, mid, hi)
        lo = np.where(open_ & ~up, mid + 1, lo)


class Forest:
    """Union-find over places, to keep of a bucket's links only those that join something new."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _by_cell(work):
    """Over partitions in which a cell's rows follow one another (column 1 is the cell): work(columns of whole cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            cols = [np.concatenate([h, c]) for h, c in zip(held, new, strict=True)] if held else new
            cells = cols[1]
            end = len(cells) - int(np.argmax(cells[::-1] != cells[-1])) if (cells != cells[-1]).any() else 0
            held = [c[end:] for c in cols]
            if end:
                yield work([c[:end] for c in cols])
        if held:
            yield work(held)

    return run


def _link(budget: int):
    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        fps, cell, side = cols[0].view(np.uint64), cols[1], cols[2]
        order = np.lexsort((fps, cell))
        fps, cell, side = fps[order], cell[order], side[order]
        forest, out_a, out_b = Forest(len(fps)), [], []
        across = side >= 0
        for which in (~across, across):
            at = np.flatnonzero(which)
            for i, j in trie_self_join(fps[at], cell[at], budget, side[at] if which is across else None):
                for x, y in zip(at[i].tolist(), at[j].tolist(), strict=True):
                    if forest.join(x, y):
                        out_a.append(x)
                        out_b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(fps[np.array(o, np.int64)].view(np.int64)) for o in (out_a, out_b)], ["a", "b"])

    return _by_cell(links)


def _cut_bits(value: str, bits: int) -> Column:
    """Structs (i, v, rest): each of four blocks of `bits` bits of a column, and the other bits moved together."""
    mask, parts = (1 << bits) - 1, []
    for i in range(4):
        high = f"shiftrightunsigned({value}, {bits * (i + 1)})" if bits * (i + 1) < 64 else "0L"
        low = f"({value} & {(1 << bits * i) - 1}L)" if i else "0L"
        parts.append(f"struct({i} AS i, shiftrightunsigned({value}, {bits * i}) & {mask}L AS v, (shiftleft({high}, {bits * i}) | {low}) AS rest)")
    return F.expr(f"array({', '.join(parts)})")


def _sized(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("bucket").count().filter("count > 1")


def _cells(keyed: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, cell, side, more) of rows with bucket and parts: a bucket of one part is one cell; of more, each two parts are one.

    side is -1 in a cell of one part; in others, where only links across are wanted, it tells the part.
    """
    part, other = F.pmod(F.xxhash64(key), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    keyed = keyed.withColumn("part", part).select(key, "bucket", "part", *more, other.alias("with"))
    low, high = F.least("part", "with"), F.greatest("part", "with")
    side = F.when(low == high, -1).otherwise(F.when(F.col("part") == low, 0).otherwise(1)).cast("int")
    return keyed.select(key, F.xxhash64("bucket", low, high).alias("cell"), side.alias("side"), *more)


def near_pairs(prints: DataFrame, *, budget: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, each once) that differ in `budget` (3 or fewer) bits.

    They connect what all such links connect, with fewer than as many links as fingerprints in each bucket. Two such
    fingerprints share one of four blocks of 16 bits whole, so each goes to four buckets by block and value. In a bucket of
    over CHUNK fingerprints they share one of four blocks of 12 of the other 48 bits as well, and it becomes buckets by those; one that
    still has more is dealt into parts, and each two parts are a cell: no task holds more than two of them.
    """
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find 3 differing bits at most")
    keyed = prints.select("fp", F.explode(_cut_bits("fp", BLOCK)).alias("k")).select("fp", (F.col("k.i") * 65536 + F.col("k.v")).alias("bucket"), "k.rest")
    sizes = materialize(_sized(keyed), "buckets")
    small = keyed.join(sizes.filter(F.col("count") <= CHUNK), "bucket").select("fp", "bucket", F.lit(1).alias("parts"))
    # Few buckets are large, or none; stored, they are known to be, and the rest isn't shuffled for them.
    hot = materialize(sizes.filter(F.col("count") > CHUNK), "hot-buckets")
    large = keyed.join(hot, "bucket").select("fp", "bucket", F.explode(_cut_bits("rest", BLOCK * 3 // 4)).alias("k"))
    large = large.select("fp", F.xxhash64("bucket", "k.i", "k.v").alias("bucket"))
    large = large.join(_sized(large), "bucket").select("fp", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"))
    cells = _cells(small.unionByName(large), "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link(budget), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 3, budget: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: its component's smallest doc_id.

    Rows link if their fingerprints differ in `budget` bits or fewer, and a component is what links join. Null, empty
    and wordless texts have fingerprint 0 and link like any other. Rows with one fingerprint are one class, taken once in the
    join; a repeated row, or a repeated key, is in its class with all its rows. Null keys have a fingerprint, and null as
    component_id only if their whole component has no key. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, words=words, key=key, text=text), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = connected_components(near_pairs(classes.select("fp"), budget=budget))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select(classes["fp"], "least", F.coalesce("component", classes["fp"]).alias("part"))
    first = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(first, "part").select(F.col("fp").alias("__fp"), "component_id"), "components")
    return prints.join(named, prints["fp"] == named["__fp"], "left").select("doc_id", "fp", "component_id")


def _first_rows(docs: DataFrame, near: DataFrame, key: str, text: str) -> DataFrame:
    """docs with one row of each component of near (doc_id, component_id): that of the smallest key; rows without key stay."""
    near = near.filter("doc_id is not null")
    keys = near.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    # Written out, so that Spark knows how large they are: the documents' texts are shuffled only if these keys can't be broadcast.
    marked = materialize(keys.filter("not first or n > 1").select("__key", (~F.col("first")).alias("__gone")), "marked")
    found = docs.join(marked, docs[key] == marked["__key"], "left").filter("__gone is null or not __gone")
    once = found.filter("__gone is null").select(*docs.columns)
    row = F.struct(*(F.col(c) for c in docs.columns))
    again = found.filter("not __gone").groupBy("__key").agg(F.min_by(row, F.coalesce(F.xxhash64(F.col(text)), F.lit(0))).alias("r")).select("r.*")
    return once.unionByName(again)


def keep_first(docs: DataFrame, *, words: int = 3, budget: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of near_duplicates(): that of the smallest key.

    Rows of one key count as copies of one document: one of them stays, that of the smallest hash of its text, if the key is its
    component's smallest. Rows without key are kept all.
    """
    return _first_rows(docs, near_duplicates(docs, words=words, budget=budget, key=key, text=text), key, text)
