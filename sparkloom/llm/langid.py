"""Language identification by a small convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.memory import frugal

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
_WORDY = re.compile(r"[^\W\d_]")  # letters, and numerals such as ½ and Ⅷ, which aren't
UNKNOWN = "und"
#: Labelled rows that the network is fitted on at most, windows drawn from each at most, and passes.
SAMPLE, TAKES, EPOCHS = 3000, 3, 8
#: Windows that one matrix product takes.
BATCH = 256


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category stands anywhere in the text."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


@dataclass
class Network:
    """Byte embedding, filters of several widths (padded with zeros to the widest), max pooling, softmax."""

    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # widest * EMBED x filters
    bias: np.ndarray
    out: np.ndarray  # filters x labels
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> np.ndarray:
        """The pooled filters of each window (rows of bytes; rows of zeros at the end are padding)."""
        w = max(WIDTHS)
        e = self.embed[windows]
        n, size, d = e.shape
        grams = np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * d), (e.strides[0], e.strides[1], e.strides[2]))
        return np.maximum((grams.reshape(-1, w * d) @ self.conv).reshape(n, size - w + 1, -1).max(1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.features(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)]
        z = np.concatenate(parts) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text in windows of WINDOW bytes; the last one is filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(takes: list[list[bytes]], langs: list[str], *, seed: int = 3) -> Network | None:
    """A network fitted on windows of the labelled texts; None without a label, a constant one with one label.

    Classes weigh the same however many texts they have. Adam, fixed seed and order: the same texts give the same network.
    """
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    w, f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((w, EMBED, f), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
    mask = mask.reshape(w * EMBED, f)
    net = Network(labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (w * EMBED, f)) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.1, (f, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    net.embed[0] = 0
    xs, ys = [], []
    for windows, lang in zip(takes, langs, strict=True):
        for window in windows:
            xs.append(windows_of(window)[0])
            ys.append(labels.index(lang))
    x, y = np.array(xs), np.array(ys)
    weight = (len(y) / (len(labels) * np.bincount(y, minlength=len(labels)).clip(1)))[y].astype(np.float32)
    params = {k: getattr(net, k) for k in ("embed", "conv", "bias", "out", "out_bias")}
    first, second, step = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2)), None, 0
    first, second = first
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = order[at : at + 128]
            xb = x[rows]
            e = net.embed[xb]
            n, size, d = e.shape
            grams = np.lib.stride_tricks.as_strided(e, (n, size - w + 1, w * d), e.strides).reshape(-1, w * d)
            z = (grams @ net.conv).reshape(n, size - w + 1, f)
            top = z.argmax(1)
            pooled = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + net.bias
            h = np.maximum(pooled, 0)
            s = h @ net.out + net.out_bias
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[rows]] -= 1
            ds = p * weight[rows, None] / n
            dh = (ds @ net.out.T) * (pooled > 0)
            where = np.arange(n)[:, None] * (size - w + 1) + top  # n x f: the gram that each filter took
            took = grams[where]  # n x f x (w * d)
            grads = {"out": h.T @ ds, "out_bias": ds.sum(0), "bias": dh.sum(0), "conv": np.einsum("nfk,nf->kf", took, dh) * mask}
            back = (dh[:, :, None] * net.conv.T[None]).reshape(n, f, w, d)
            g = np.zeros_like(net.embed)
            cells = xb[np.arange(n)[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(g, cells.ravel(), back.reshape(-1, d))
            g[0] = 0
            grads["embed"] = g
            step += 1
            rate = 0.01 * (0.5 if epoch >= EPOCHS * 3 // 4 else 1)
            for k, v in params.items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Fit on about `sample` rows with text and label that aren't held out: those whose hash of key and text is lowest.

    Their number is counted first, and the hash's bound follows from it, so that what the tasks send to the driver stays as
    small for any input: up to twice `sample` rows, each with TAKES windows, which a hash draws from all of its text.
    """
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)))
    n = rows.count()
    h = F.pmod(F.xxhash64(F.lit(1), F.col(key), F.col(text)), F.lit(1 << 40))
    rows = rows.withColumn("__h", h).filter(F.col("__h") < int((1 << 40) * min(1.0, 1.5 * sample / max(n, 1))))
    rows = rows.filter(F.col(text).rlike(r"\p{L}")).withColumn("__b", F.encode(F.col(text), "utf-8"))
    count = F.greatest(F.lit(1), F.ceil(F.length("__b") / WINDOW))
    drawn = F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(i + 2), F.col(key), F.col("__h")), count) for i in range(TAKES))))
    takes = F.transform(drawn, lambda i: F.substring(F.col("__b"), (i * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    found = rows.select(F.col("__h").alias("h"), takes.alias("t"), F.col(lang).cast("string").alias("l")).orderBy("h", "t", "l").limit(sample).collect()
    return fit([[bytes(w) for w in r["t"]] for r in found], [r["l"] for r in found])


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when parted by 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """(language, score) of each whole text: the mean of its windows' probabilities, the label with most of it."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    at: list[int] = []
    data: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not at:
            return
        counts = np.array([max(1, -(-len(b) // WINDOW)) for b in data])
        means = np.zeros((len(at), len(net.labels)))
        owner = np.repeat(np.arange(len(at)), counts)
        probs = net.probabilities(np.concatenate([windows_of(b) for b in data]))
        np.add.at(means, owner, probs)
        means /= counts[:, None]
        best = means.argmax(1)
        for k, i in enumerate(at):
            langs[i], scores[i] = net.labels[best[k]], float(min(1.0, means[k, best[k]]))
        at.clear()
        data.clear()
        size = 0

    for i, text in enumerate(texts):
        if text and has_letter(text):
            b = text.encode()
            at.append(i)
            data.append(b)
            size += len(b)
            if size > 1_000_000:
                flush()
    flush()
    return langs, scores


def _apply(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None = None, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; trains on docs unless a network is given.

    `und` and score 0 if the text is null, empty or without a letter, or if there was nothing to learn from. Long texts are read
    whole, window by window; repeated rows are judged each; an empty table gives no rows. Nothing is shuffled.
    """
    net = net or train(docs, key=key, text=text, lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_apply(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def drop_rejected(docs: DataFrame, *, least: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that have no letter or whose best language has less than `least` of the probability."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, key=key, text=text, lang=lang))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net.value, batch.column(place).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
