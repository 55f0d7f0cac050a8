"""Near-duplicates by shingle similarity: buckets by MinHash, long SimHash fingerprints under a Hamming budget, exact Jaccard similarity."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.llm.memory import frugal
from sparkloom.llm.simhash import Forest, _by_cell, _cells, _first_rows, trie_self_join
from sparkloom.shared_store import materialize

#: Words of a fingerprint (of 64 bits), and the most that two texts of the wanted similarity differ in: of all bits, and of one word. At a
#: similarity of 0.8 a bit differs with a chance of 0.15, with few shingles of up to 0.19; these are over four and a half standard
#: deviations more.
WORDS, BUDGET, WORD_BUDGET = 4, 66, 27
FEW, BUDGET_OF_FEW = 64, 80
#: A bucket is by so many least hashes, and each text goes to so many buckets: two texts of similarity s share none of them with a
#: chance of (1 - s ** LEAST) ** BANDS, which is below one in a million at 0.8, whatever the number of texts.
LEAST, BANDS = 3, 20
#: Each round of proposals asks for so many times as many forests as the one before.
GROWTH = 256
#: Of plan_tables(): chance that such texts agree in a bit, and that they share a bucket of some table. Rows of a bucket, on average.
AGREE, RECALL, FILL = 0.84, 0.995, 256
#: Rows of a part of a large bucket. Buckets of over so many rows link all to their middle before pairs are looked for.
CHUNK, CROWD = 2048, 1024
#: Links that one task joins at once (tens of MB); more take the rounds of connected_components(), each of which writes a small table.
AT_ONCE = 500_000
PRINTS = [f"f{i}" for i in range(WORDS)]
KEYS = [f"b{i}" for i in range(BANDS)]


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text (its words as in simhash.fingerprint()) as 64-bit hashes, sorted; none without a word."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    ends = (starts + sizes)[words - 1 :].tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends, strict=True)], np.uint64))


def long_print(hashes: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits, each set if it is in over half of the hashes; further words are mixed from the first."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        h = hashes
        if w:
            h = (h + np.uint64(0x9E3779B97F4A7C15 * w % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(29))
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[w] = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")
    return out


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the hash functions whose least values make the buckets."""
    rng = np.random.default_rng(11)
    a, b = (rng.integers(0, 2**64, (LEAST * BANDS, 1), np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The text's bucket of each band: of LEAST hash functions, the least values that its shingles have."""
    factor, summand = _functions()
    least = np.full(LEAST * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        h = hashes[i : i + 1024]
        z = (h ^ (h >> np.uint64(32))) * factor
        z += summand
        np.minimum(least, z.min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in least.reshape(BANDS, LEAST).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, prints, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, WORDS + BANDS), np.uint64), np.zeros(batch.num_rows, np.int64)
            for i, t in enumerate(batch.column(2)):
                h = shingle_hashes(t.as_py() or "", words)
                nodes[i] = xxhash.xxh64_intdigest(h.tobytes(), 1)
                prints[i, :WORDS], prints[i, WORDS:], sizes[i] = long_print(h), bucket_keys(h), len(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.view(np.int64)) for c in (nodes, sizes, *prints.T.copy()))], ["doc_id", "mark", "node", "size", *PRINTS, *KEYS])

    return frugal(run)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py() or "", words).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return frugal(run)


def plan_tables(n: int, seed: int = 3) -> list[np.ndarray]:
    """Places of the bits that each table samples, for n fingerprints: enough for FILL a bucket, and tables for RECALL.

    A join by such tables has more of them the more rows there are; similar_duplicates() goes by bucket_keys() instead.
    """
    k = min(40, max(4, math.ceil(math.log2(max(n, 2) / FILL))))
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**k))
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice([b for b in range(64 * WORDS) if b // 64 != t % WORDS], k, replace=False)) for t in range(count)]


def _middles(cols: list[np.ndarray]) -> pa.RecordBatch:
    """In each cell all near enough to its middle, the row whose bits are most often those of the majority, with that row."""
    node, cell = cols[0], cols[1]
    prints = np.stack([c.view(np.uint64) for c in cols[-WORDS:]], 1)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    out_a, out_b = [], []
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
        own = prints[a:z]
        bits = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, WORDS * 8), axis=1)
        most = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(own)).view(">u8").astype(np.uint64)
        far = np.bitwise_count(own ^ most).sum(1)
        middle = int(np.lexsort((node[a:z], far))[0])
        near = np.flatnonzero(np.bitwise_count(own ^ own[middle]).sum(1) <= BUDGET)
        near = near[node[a + near] != node[a + middle]]
        out_a.append(node[a + near])
        out_b.append(np.full(len(near), node[a + middle]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _forests(rounds: int, similarity: float):
    """Links between what isn't joined yet: nearest first, `rounds` forests of them, so that their number follows the rows'.

    Columns: node, cell, side, told (1: the row says only that `node` and `other` are known not to link), label (what joined rows
    share; 0: none but itself), other, word of the trie, size (of the set), the fingerprint. What is alike in most rows costs little in a shuffle. A cell's commonest label is never compared with itself.
    """

    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        told = cols[3] == 1
        known = set(zip(cols[1][told].tolist(), cols[0][told].tolist(), cols[5][told].tolist(), strict=True))
        node, cell, side, _, label, _, which_word, size, *prints = (c[~told] for c in cols)
        label = np.where(label == 0, node, label)
        prints = np.stack([c.view(np.uint64) for c in prints], 1)
        word = prints[np.arange(len(prints)), which_word]
        # Rows of the commonest label of each cell come first in it.
        pairs, which, times = np.unique(np.stack([cell, label], 1), axis=0, return_inverse=True, return_counts=True)
        which = which.ravel()
        best = np.lexsort((-times, pairs[:, 0]))
        top = best[np.flatnonzero(np.concatenate([[True], pairs[best][1:, 0] != pairs[best][:-1, 0]]))] if len(best) else best
        crowd = np.isin(which, top[times[top] > 1])
        order = np.lexsort((word, ~crowd, cell))
        node, cell, side, label, word, crowd, prints, which, size = (x[order] for x in (node, cell, side, label, word, crowd, prints, which, size))
        tree = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]) | (crowd[1:] != crowd[:-1])])) if len(cell) else cell
        begin = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]])) if len(tree) else np.zeros(0, np.int64)
        end = np.concatenate([begin[1:], [len(tree)]]).astype(np.int64)
        two = np.flatnonzero(cell[begin[1:]] == cell[begin[:-1]]) if len(begin) > 1 else np.zeros(0, np.int64)
        rest = np.flatnonzero(~crowd)
        found = [(rest[i], rest[j]) for i, j in trie_self_join(word[rest], tree[rest], WORD_BUDGET)] if len(rest) else []
        if len(two):
            found += list(trie_self_join(word, tree, WORD_BUDGET, None, (begin[two], end[two], begin[two + 1], end[two + 1])))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        far = np.bitwise_count(prints[i] ^ prints[j]).sum(1)
        less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (far <= np.where(less < FEW, BUDGET_OF_FEW, BUDGET)) & (less >= similarity * more - 1e-9) & (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j, far = i[ok], j[ok], far[ok]
        by = np.lexsort((j, i, far))
        i, j = i[by], j[by]
        if known:
            new = [key not in known for key in zip(cell[i].tolist(), np.minimum(node[i], node[j]).tolist(), np.maximum(node[i], node[j]).tolist(), strict=True)]
            i, j = i[new], j[new]
        _, first = np.unique(which, return_index=True)
        group = first[np.searchsorted(np.unique(which), which)].tolist()
        taken = []
        if 1 < rounds and len(i) <= rounds * len(pairs):  # so many forests hold hardly fewer than all
            taken, rounds_left = list(zip(i.tolist(), j.tolist(), strict=True)), 0
        else:
            rounds_left = rounds
        for _ in range(rounds_left):
            forest, later = Forest(len(node)), np.ones(len(i), bool)
            for k in range(0, len(i), 50_000):  # there may be many pairs, and as Python's numbers they are large
                for m, (x, y) in enumerate(zip(i[k : k + 50_000].tolist(), j[k : k + 50_000].tolist(), strict=True), k):
                    if forest.join(group[x], group[y]):
                        taken.append((x, y))
                        later[m] = False
            if later.all():
                break
            i, j = i[later], j[later]
        x, y = (np.array([t[k] for t in taken], np.int64) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(cell[x]), pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["cell", "a", "b"])

    return frugal(_by_cell(work))


class _Verifier:
    """Exact similarity of links, by the sets of those texts alone that share a bucket with another; they are made once."""

    def __init__(self, rows: DataFrame, prints: DataFrame, asked: DataFrame, words: int, similarity: float):
        owners = prints.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("r")).select("node", F.col("r.doc_id").alias("d"), F.col("r.mark").alias("m"))
        owners = materialize(owners.join(asked, "node", "left_semi"), "asked")
        texts = rows.join(owners, (rows["doc_id"] == owners["d"]) & rows["mark"].eqNullSafe(owners["m"])).select("node", "text")
        self.sets = materialize(texts.mapInArrow(_sets(words), "node long, hashes array<long>").dropDuplicates(["node"]), "sets", compression="zstd")
        self.similarity = similarity

    def judge(self, links: DataFrame) -> DataFrame:
        """(a, b, ok) for each distinct link."""
        links = links.select("a", "b").distinct()
        left, right = (self.sets.select(F.col("node").alias(c), F.col("hashes").alias(h)) for c, h in (("a", "x"), ("b", "y")))
        both = F.size(F.array_intersect("x", "y"))
        met = links.join(left, "a").join(right, "b").select("a", "b", both.alias("n"), (F.size("x") + F.size("y")).alias("s"))
        return materialize(met.select("a", "b", (F.col("n") >= self.similarity * (F.col("s") - F.col("n")) - 1e-9).alias("ok")), "judged")


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links (a, b), as connected_components() has them."""
    read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not read:
        return
    ends = np.concatenate([x for k in range(2) for x in (pair[k] for pair in read)])
    nodes, place = np.unique(ends, return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in place.reshape(2, -1).T.tolist():
        forest.join(x, y)
    root = np.array([forest.root(i) for i in range(len(nodes))])
    more = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(nodes[root[more]])], ["node", "component"])


def _joined(links: DataFrame) -> DataFrame:
    """connected_components(), in one task if there are few links: none of them null."""
    if links.count() > AT_ONCE:
        return connected_components(links)
    return materialize(links.coalesce(1).mapInArrow(_join_all, "node long, component long"), "joined")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, count) of the buckets that hold several nodes: most texts are like no other and take no further part."""
    keyed = nodes.select("node", F.explode(F.array(*KEYS)).alias("bucket"))
    return keyed.join(materialize(keyed.groupBy("bucket").count().filter("count > 1"), "buckets"), "bucket")


def similar_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, component_id) for each row with a key: its component's smallest doc_id; node tells its set of shingles.

    Rows link if their sets of `words`-word shingles (words as in op7's fingerprints; a shorter text is one shingle) have a Jaccard
    similarity of `similarity` (0.8 or more) at least, and a component is what links join. Null, empty and wordless texts are equal, as are texts with the same set; an
    empty table gives no rows.

    Texts that may link meet in buckets by MinHash, BANDS of them for each text, however many texts there are. In a bucket a trie of one
    word of SimHash fingerprints of 256 bits is joined with itself under a budget of differing bits, and then all bits are compared. Each
    link that counts is verified by the sets. A bucket proposes spanning forests, nearest pairs first, not all pairs; where a proposed
    link fails, its bucket is asked again, for more, without what failed, until every proposal held. So a link is lost only if no
    band has it in a bucket, or if the fingerprints differ by over four and a half standard deviations more than those of such texts do.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the buckets are laid out for a similarity of 0.8 or more")
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))
    prints = materialize(rows.mapInArrow(_prints(words), "doc_id long, mark long, node long, size long, " + ", ".join(f"{f} long" for f in (*PRINTS, *KEYS))), "long-prints")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(f).alias(f) for f in ("size", *PRINTS, *KEYS))), "nodes")
    met = materialize(shared_buckets(nodes), "met")
    candidates = materialize(met.select("node").distinct(), "candidates")
    verifier = _Verifier(rows, prints, candidates, words, similarity)
    own = materialize(nodes.join(candidates, "node", "left_semi").select("node", "size", *PRINTS), "own")

    sizes = met.filter(F.col("count") > CROWD)
    links, label = [], None
    if not sizes.isEmpty():
        crowded = sizes.join(own, "node").select("node", "bucket", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts"), *PRINTS)
        part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        crowded = crowded.select("node", F.xxhash64("bucket", part).alias("cell"), *PRINTS)
        middles = crowded.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_cell(_middles), "a long, b long")
        links = [verifier.judge(middles).filter("ok").select("a", "b")]
        label = _joined(links[0])
    said, open_, forests = None, None, 1
    while True:
        named = own.withColumn("label", F.col("node")) if label is None else own.join(label.withColumnRenamed("component", "c"), "node", "left").withColumn("label", F.coalesce("c", "node")).drop("c")
        parts = F.when(F.col("count") > CROWD, F.ceil(F.col("count") / CHUNK).cast("int")).otherwise(1)
        keyed = met.join(named, "node").select("node", "bucket", "label", "size", *PRINTS, parts.alias("parts"), F.pmod("bucket", F.lit(WORDS)).cast("int").alias("own"))
        cells = _cells(keyed, "node", "label", "own", "size", *PRINTS)
        if open_ is not None:
            cells = cells.join(open_, "cell", "left_semi")
        zero = F.lit(0).cast("long")
        label_ = F.when(F.col("label") != F.col("node"), F.col("label")).otherwise(zero)
        cells = cells.select("node", "cell", F.col("side").cast("byte").alias("side"), F.lit(0).cast("byte").alias("told"), label_.alias("label"), zero.alias("other"), F.col("own").cast("byte").alias("own"), F.col("size").cast("int").alias("size"), *PRINTS)
        if said is not None:
            cells = cells.unionByName(said.select(F.col("a").alias("node"), "cell", F.lit(-1).cast("byte").alias("side"), F.lit(1).cast("byte").alias("told"), zero.alias("label"), F.col("b").alias("other"), F.lit(0).cast("byte").alias("own"), F.lit(0).alias("size"), *(zero.alias(f) for f in PRINTS)))
        asked = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_forests(forests, similarity), "cell long, a long, b long"), "proposed")
        if asked.isEmpty():
            break
        judged = verifier.judge(asked)
        links.append(judged.filter("ok").select("a", "b"))
        failed = materialize(asked.join(judged.filter("not ok").select("a", "b"), ["a", "b"]), "failed")
        label = _joined(functools.reduce(DataFrame.unionByName, links))
        if failed.isEmpty():
            break
        said = failed if said is None else said.unionByName(failed)
        open_ = failed.select("cell").distinct()
        forests *= GROWTH
    named = nodes.select("node", "least", F.col("node").alias("part")) if label is None else nodes.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    first = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(first, "part").select(F.col("node").alias("__node"), "component_id"), "components")
    return prints.join(named, prints["node"] == named["__node"]).select("doc_id", "node", "component_id")


def keep_first_similar(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of similar_duplicates(): that of the smallest key, by the rules of simhash.keep_first()."""
    return _first_rows(docs, similar_duplicates(docs, words=words, similarity=similarity, key=key, text=text), key, text)
