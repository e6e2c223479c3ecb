"""Document quality from compression: zstandard dictionaries of good and of bad text.

Every text is cut into small pieces and each is compressed with a dictionary trained on good
and with one trained on bad labelled texts.  The difference of the two sizes for each byte of
text, with the smaller size for each byte (how well the text compresses at all), is calibrated
into a probability by a weighted logistic regression on labelled texts that neither dictionary
has seen.  A text's length is no input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import table

#: Labelled rows of each class that are fitted, half of them for the dictionaries: the bound of the sample.
SAMPLE = 1600
#: Characters of a fitted text, a bound of the same sample; every text is scored whole.
SAMPLE_CHARS = 200_000
PIECE, LEVEL, DICTIONARY = 512, 3, 112_640
THRESHOLD = 0.3


def _pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Model:
    """Sizes under both dictionaries, and the calibration.  Without both classes the score is the prior."""

    def __init__(self, prior: float, dictionaries: tuple[bytes, bytes] | None = None, weights: np.ndarray | None = None, scale: tuple | None = None):
        self.prior, self.dictionaries, self.weights, self.scale = prior, dictionaries, weights, scale
        self._made: list | None = None

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def sizes(self, text: str | None) -> tuple[int, int, int]:
        if self._made is None:
            self._made = []
            for raw in self.dictionaries:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)
        good, bad = self._made
        pieces = _pieces(text)
        return sum(map(len, pieces)), sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)

    def features(self, texts: list[str | None]) -> np.ndarray:
        n, good, bad = np.array([self.sizes(t) for t in texts], float).reshape(-1, 3).T
        n = np.maximum(n, 1)
        x, r = (bad - good) / n, np.minimum(good, bad) / n
        return np.stack([x, r, x * x, r * r, x * r], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        z = (self.features(texts) - self.scale[0]) / self.scale[1]
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(self.weights[0] + z @ self.weights[1:])))
        return np.where([bool(t) for t in texts], p, self.prior)


def _train(texts: list[str | None]) -> bytes | None:
    samples = [p for t in texts for p in _pieces(t) if len(p) >= 8]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its end is the dictionary
        return b"".join(samples)[-DICTIONARY:].rjust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple]:
    scale = (x.mean(0), x.std(0) + 1e-9)
    z = np.c_[np.ones(len(x)), (x - scale[0]) / scale[1]]
    w, beta, ridge = w / w.mean(), np.zeros(z.shape[1]), 1e-3 * len(x) * np.eye(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (w * (p * (1 - p) + 1e-9))[:, None]).T @ z + ridge
        beta -= np.linalg.solve(h, z.T @ (w * (p - y)) + ridge @ beta)
    return beta, scale


def held_out(doc_id):
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents of each class, chosen by a hash of doc_id.

    The classes' weights come from all labels that aren't held out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 1) / (total + 2)
    chosen = [known.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").select("quality", F.col("text").substr(1, SAMPLE_CHARS).alias("text"), F.xxhash64("doc_id").alias("h"))
    rows = rows.orderBy("h", "text").limit(2 * sample).toPandas()  # rows that repeat a doc_id don't lengthen the sample
    rows = rows.sort_values(["h", "text"], ignore_index=True)
    parts = {k: rows.text[rows.quality == k].tolist() for k in (0, 1)}
    if min(map(len, parts.values())) < 4:
        return Model(prior)
    half = {k: len(v) // 2 for k, v in parts.items()}
    trained = tuple(_train(parts[k][: half[k]]) for k in (1, 0))
    if None in trained:
        return Model(prior)
    model = Model(prior, trained)
    rest = {k: v[half[k] :] for k, v in parts.items()}
    x = model.features(rest[0] + rest[1])
    y = np.r_[np.zeros(len(rest[0])), np.ones(len(rest[1]))]
    w = np.r_[np.full(len(rest[0]), counts[0] / len(rest[0])), np.full(len(rest[1]), counts[1] / len(rest[1]))]
    model.weights, model.scale = _logistic(x, y, w)
    return model if all(map(math.isfinite, model.weights)) else Model(prior)


def score(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    Whole texts are scored, and nothing but the text.  Null and empty texts get the share of
    label 1 among the labels; so does every row where a class has fewer than four labelled texts.
    A null doc_id isn't held out.  Repeated rows give repeated results.
    """
    model = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more."""
    model = fit(docs, labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
