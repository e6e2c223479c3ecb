"""Masked pseudo-likelihood of documents under a bidirectional window network.

A word is predicted from the words on both of its sides.  The vocabulary is the corpus's most
frequent words and hash buckets for the others.  A word of a bucket has the bucket's probability
times its own share of the bucket by counts of the whole corpus, so that every distinct word is
predicted, however many there are.  The network (embeddings of the window, one hidden layer, a
softmax over word classes and one over the words of the class) is trained in numpy on masked
positions of every document: each task trains a copy on its own documents, and the next round
starts from the copies' average, in which an embedding or a class counts as often as a copy has
used it.  So weights depend a little on how rows lie in partitions.  A document's score is the
sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import table, written

#: 32 classes of 256 words: 7168 frequent words, 1024 buckets.
CLASSES, PER_CLASS = 32, 256
VOCABULARY = CLASSES * PER_CLASS
BUCKETS = 1024
SIDE, DIM, HIDDEN = 2, 16, 32
#: A round masks one position in so many, another residue each time: over the rounds every position once.
ROUNDS, STRIDE = 3, 3
BATCH, RATE = 16384, 0.15
#: Rows of a softmax at once.
BLOCK = 512
#: Few positions are trained in so many batches, of so many positions at least: a copy of few documents takes more than one step.
BATCHES, LEAST_BATCH = 4, 32
#: Bytes of texts that are split at once, to be encoded and to be counted.
SPLIT_BYTES, COUNT_BYTES = 2**23, 2**25
#: Words scored at once.
SCORE_WORDS = 16384
#: Copies that are trained at once; weights of a row of the average.
MOST_COPIES, CHUNK = 8192, 1024
_EDGE = VOCABULARY  # stands beyond a document's ends

SHAPES = {
    "e": (VOCABULARY + 1, DIM), "w": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, HIDDEN, PER_CLASS), "bo": (CLASSES, PER_CLASS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


#: glibc's M_TRIM_THRESHOLD, M_TOP_PAD and M_MMAP_THRESHOLD.
_KEPT = ((-1, 2**28), (-2, 2**24), (-3, 2**25))


def keep_memory() -> None:
    """Lets the process keep what arrays have freed for its next ones; else every block's arrays are mapped, and their pages faulted in, anew."""
    with contextlib.suppress(OSError, AttributeError):  # another library has no such setting
        for option, value in _KEPT:
            ctypes.CDLL(None).mallopt(option, value)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of one vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray) -> np.ndarray:
    """Small random weights; the biases start as the words' log-frequencies."""
    rng = np.random.default_rng(7)
    flat = np.zeros(SIZE, np.float32)
    p = parts(flat)
    for name in ("e", "w", "wc", "wo"):
        p[name][...] = rng.normal(0, 0.1 if name == "e" else SHAPES[name][-2] ** -0.5 * 0.5, SHAPES[name])
    c = (counts + 0.5).reshape(CLASSES, PER_CLASS)
    p["bc"][...] = np.log(c.sum(1) / c.sum())
    p["bo"][...] = np.log(c / c.sum(1, keepdims=True))
    return flat


def windows(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids on both sides of the positions ``at``."""
    padded = np.full(len(ids) + 2 * SIDE, _EDGE, np.int16)
    padded[SIDE : SIDE + len(ids)] = ids
    return np.stack([padded[at + k] for k in range(2 * SIDE + 1) if k != SIDE], 1)


def joined(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many documents in one vector, with edges around each, and where each begins."""
    edge = np.full(SIDE, _EDGE, np.int16).tobytes()
    sizes = np.fromiter(map(len, documents), np.int64, len(documents)) // 2 + SIDE
    return np.frombuffer(edge + edge.join([*documents, b""]), np.int16), SIDE + np.cumsum(sizes) - sizes


def around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """As ``windows``, in a vector of ``joined``."""
    out = np.empty((len(at), 2 * SIDE), np.int16)
    for slot, k in enumerate(k for k in range(-SIDE, SIDE + 1) if k):
        out[:, slot] = ids[at + k]
    return out


def _logits(w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with the bias as their last row, less a bound of all logits; whether that bound is near them all."""
    # Hidden units lie between -1 and 1, so no logit is above this bound; where it may be far above them all, the rows' own maxima.
    reach = np.abs(w).sum(0)
    most = (reach + bias).max()
    near = bool(most - (bias - reach).max() < 60)
    return np.concatenate([w, (bias - most if near else bias)[None]]), near


def _softmax(h: np.ndarray, w: np.ndarray, near: bool, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities of the targets; with ``learn`` also the loss's gradient by the logits, times each row's total, and the totals.

    ``h`` ends with a column of ones; ``w`` and ``near`` are from ``_logits``.
    """
    logits = h @ w
    if not near:
        logits -= logits.max(1, keepdims=True)
    at = np.arange(len(target))
    own = logits[at, target]
    np.exp(logits, out=logits)
    total = logits @ np.ones(w.shape[1], logits.dtype)
    if learn:
        logits[at, target] -= total
    return own - np.log(total), logits, total


#: Takes the loss's gradient of a weight, or of rows of it: (name, which rows, gradient).
Update = Callable[[str, object, np.ndarray], None]


def ready_logits(p: dict[str, np.ndarray]) -> dict[object, tuple[np.ndarray, bool]]:
    """What ``_logits`` gives for each softmax of weights that stay as they are: ... is that over classes."""
    return {...: _logits(p["wc"], p["bc"])} | {k: _logits(p["wo"][k], p["bo"][k]) for k in range(CLASSES)}


def forward(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, update: Update | None = None, known: dict[object, tuple[np.ndarray, bool]] | None = None) -> np.ndarray:
    """Log-probabilities of the targets; ``update`` gets the gradients, each after its weight's last use.  Targets come sorted; ``known`` is from ``ready_logits``."""
    n = len(target)
    x = p["e"].take(context.ravel(), 0).reshape(n, -1)
    a = x @ p["w"]
    a += p["b"]
    d = 1 / (1 + np.abs(a))
    h = np.ones((n, HIDDEN + 1), a.dtype)
    np.multiply(a, d, out=h[:, :-1])
    cls, word = target // PER_CLASS, target % PER_CLASS
    out, dh = np.zeros(n, a.dtype), np.zeros((n, HIDDEN), a.dtype)

    def run(name: str, rows: object, lo: int, hi: int, own: np.ndarray) -> None:
        """A softmax for the rows from ``lo`` to ``hi``, in blocks that stay in the processor's cache."""
        w, both = p["w" + name][rows], 0
        ready, near = _logits(w, p["b" + name][rows]) if known is None else known[rows]  # once for all blocks
        for at in range(lo, hi, BLOCK):
            block = slice(at, min(at + BLOCK, hi))
            found, g, total = _softmax(h[block], ready, near, own[block], update is not None)
            out[block] += found
            if update is not None:
                total = (1 / total)[:, None]
                dh[block] += (g @ w.T) * total
                both = both + g.T @ (h[block] * total)
        if update is not None:
            update("w" + name, rows, both[:, :-1].T)
            update("b" + name, rows, both[:, -1])

    run("c", ..., 0, n, cls)
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    for k in np.nonzero(ends[1:] > ends[:-1])[0].tolist():
        run("o", k, ends[k], ends[k + 1], word)
    if update is not None:
        da = dh * d * d
        dx = (p["w"] @ da.T).reshape(2 * SIDE, DIM, n)
        update("w", ..., (da.T @ x).T)
        update("b", ..., da.sum(0))
        slots = context.T.ravel().astype(np.intp)
        update("e", ..., np.stack([np.bincount(slots, dx[:, k].ravel(), VOCABULARY + 1) for k in range(DIM)], 1).astype(x.dtype))
    return out


class Trainer:
    """Adagrad over masked positions, from given weights; ``used`` counts the uses of each embedding, then of each class, then all."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p = parts(self.flat)
        self.squares = parts(np.full(SIZE, 1e-7, np.float32))
        self.used = np.zeros(VOCABULARY + 1 + CLASSES + 1, np.float32)
        self.context: list[np.ndarray] = []
        self.target: list[np.ndarray] = []
        self.waiting = 0

    def add(self, context: np.ndarray, target: np.ndarray) -> None:
        self.context.append(context)
        self.target.append(target)
        self.waiting += len(target)
        if self.waiting >= BATCHES * BATCH:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        context, target = np.concatenate(self.context), np.concatenate(self.target)
        self.context, self.target, self.waiting = [], [], 0
        self.used += np.r_[np.bincount(context.ravel(), minlength=VOCABULARY + 1), np.bincount(target // PER_CLASS, minlength=CLASSES), len(target)]
        size = min(BATCH, max(LEAST_BATCH, -(-len(target) // BATCHES)))
        for lo in range(0, len(target), size):
            by = lo + np.argsort(target[lo : lo + size], kind="stable")
            n = np.float32(len(by))

            def update(name: str, rows: object, g: np.ndarray, n=n) -> None:
                g = g / n
                square, own = self.squares[name][rows], self.p[name][rows]  # views
                root = g * g
                square += root
                np.sqrt(square, out=root)
                g *= np.float32(RATE)
                g /= root
                own -= g

            forward(self.p, context[by], target[by], update)

    def share(self) -> np.ndarray:
        """What the average adds up: every weight times its uses, and the uses."""
        return np.r_[self.flat * spread(self.used), self.used]


def spread(used: np.ndarray) -> np.ndarray:
    """The uses of every weight."""
    out = np.full(SIZE, used[-1])
    p = parts(out)
    p["e"][...] = used[: VOCABULARY + 1, None]
    p["wo"][...] = used[VOCABULARY + 1 : -1, None, None]
    p["bo"][...] = used[VOCABULARY + 1 : -1, None]
    return out


def _word_hash(word: bytes) -> int:
    """As Spark's xxhash64."""
    return xxhash.xxh64_intdigest(word, 42)


def _bytes_of(words: pa.StringArray) -> list[bytes]:
    """As ``to_pylist``, which makes an object of Arrow's for each value first."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def distinct_words(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Slices of the texts, of some ``most`` bytes each: where they begin, each text's number of words, the distinct words (A-Z lower-cased), and which of them each word is."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    starts = np.nonzero(np.r_[np.ones(min(1, len(part)), bool), part[1:] != part[:-1]])[0].tolist()
    for lo, hi in zip(starts, [*starts[1:], len(sizes)]):
        # A lone surrogate is no UTF-8, but these functions only look at single bytes.
        split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_trim_whitespace(pc.ascii_lower(texts[lo:hi])), ""))
        flat = split.flatten()
        kept = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # a text without words is split into an empty one
        many = np.diff(np.r_[0, np.cumsum(kept)][split.offsets.to_numpy() - split.offsets[0].as_py()])
        words = (flat if kept.all() else flat.filter(pa.array(kept))).dictionary_encode()
        yield lo, many, words.dictionary, words.indices.to_numpy(zero_copy_only=False)


class Ids:
    """Ids of texts' words; others than the frequent ones share buckets, and have hashes."""

    def __init__(self, frequent: list[str]):
        self.get = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(frequent)}.get

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and their hashes, 0 for frequent ones."""
        ids = np.fromiter(map(self.get, words, repeat(-1)), np.int16, len(words))
        rare = np.nonzero(ids < 0)[0]
        others = list(map(words.__getitem__, rare.tolist()))
        ids[rare] = VOCABULARY - BUCKETS + np.fromiter(map(crc32, others), np.int64, len(rare)) % BUCKETS
        hashes = np.zeros(len(words), np.int64)
        hashes[rare] = np.fromiter(map(_word_hash, others), np.uint64, len(rare)).view(np.int64)
        return ids, hashes


def word_counts(docs: DataFrame) -> DataFrame:
    """Every word (its bytes, A-Z lower-cased) of the corpus with its count; a task adds up its own words, a batch of texts at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, which in distinct_words(batch.column("text"), COUNT_BYTES):
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(which, minlength=len(words)))], names=["word", "count"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _rare(counts: DataFrame, frequent: list[str]) -> DataFrame:
    known = counts.sparkSession.createDataFrame([(bytearray(w.encode("utf-8", "surrogatepass")),) for w in frequent], "word binary")  # at most the vocabulary
    return counts.join(F.broadcast(known), "word", "left_anti")


def word_shares(counts: DataFrame, frequent: list[str]) -> DataFrame:
    """hash and gain (logarithm of its count, by which it is likelier than an unseen word) of every word that has a bucket and a gain."""
    return _rare(counts, frequent).filter(F.col("count") > 1).select(F.xxhash64("word").alias("hash"), F.log("count").alias("gain"))


def unseen_shares(counts: DataFrame, frequent: list[str]) -> np.ndarray:
    """The log-share of a word that the corpus doesn't have in each bucket, as one word more."""
    bucket = F.pmod(F.crc32("word"), F.lit(BUCKETS)).cast("int").alias("bucket")
    out = np.zeros(BUCKETS)
    for r in _rare(counts, frequent).groupBy(bucket).agg(F.sum("count").alias("total")).collect():
        out[r["bucket"]] = -np.log(r["total"] + 1)
    return out


class Network:
    """Vocabulary and weights; ``shares`` are those of the words outside the vocabulary, and ``unseen`` that of any other word of each bucket."""

    def __init__(self, frequent: list[str], flat: np.ndarray, shares: DataFrame | None = None, unseen: np.ndarray | None = None):
        self.frequent, self.flat, self.shares = frequent, flat, shares
        self.unseen = np.zeros(BUCKETS) if unseen is None else unseen

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each document the sum of its words' log-probabilities; ``ids`` are those of all, one after another."""
        p, out = parts(self.flat), np.zeros(len(sizes))
        known = ready_logits(p)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(ids)) + SIDE * (owner + 1)  # edges stand between documents
        padded = np.full(len(ids) + SIDE * (len(sizes) + 1), _EDGE, np.int16)
        padded[place] = ids
        for lo in range(0, len(ids), SCORE_WORDS):
            n = min(SCORE_WORDS, len(ids) - lo)
            target, own = ids[lo : lo + n], owner[lo : lo + n]
            by = np.argsort(target, kind="stable")  # 16-bit: a radix sort
            first = own[0]
            s = np.bincount(own[by] - first, forward(p, around(padded, place[lo + by]), target[by], known=known))
            out[first : first + len(s)] += s
        return out


def encode(docs: DataFrame, frequent: list[str]) -> DataFrame:
    """doc_id, row (its own number), ids (16 bits a word) and others (hashes of the words that have buckets) of every row, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(frequent)
        for batch in batches:
            for lo, many, words, which in distinct_words(batch.column("text"), SPLIT_BYTES):
                own, hashes = ids.of(_bytes_of(words))
                found, ends = own[which], np.r_[0, np.cumsum(many)]
                rare = found >= VOCABULARY - BUCKETS
                others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)][ends].astype(np.int32)), pa.array(hashes[which[rare]]))
                raw = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(many)), batch.column("row").slice(lo, len(many)), raw, others], names=["doc_id", "row", "ids", "others"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, f"doc_id {id_type}, row long, ids binary, others array<long>"), "word-ids")


def occurrences(encoded: DataFrame) -> DataFrame:
    """hash and rows (one for each time) of the words that have buckets, brought together batch by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column("others")
            hashes = others.flatten().to_numpy()
            rows = np.repeat(batch.column("row").to_numpy(), np.diff(others.offsets.to_numpy()))
            by = np.argsort(hashes)
            hashes = hashes[by]
            heads = np.nonzero(np.r_[np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]])[0]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(hashes)].astype(np.int32)), pa.array(rows[by]))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[heads]), lists], names=["hash", "rows"])

    return encoded.select("row", "others").mapInArrow(run, "hash long, rows array<long>")


def vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words of all documents, and the counts of all ids."""
    return _vocabulary(written(word_counts(docs), "word-counts"))


def _vocabulary(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = counts.orderBy(F.desc("count"), "word").limit(VOCABULARY - BUCKETS).collect()
    total = counts.agg(F.sum("count")).first()[0] or 0
    own = np.zeros(VOCABULARY)
    own[: len(rows)] = [r["count"] for r in rows]
    own[VOCABULARY - BUCKETS :] = (total - own.sum()) / BUCKETS
    return [bytes(r["word"]).decode("utf-8", "surrogatepass") for r in rows], own


def fit(docs: DataFrame) -> tuple[Network, DataFrame]:
    """A network trained on ``docs``, with the shares of all their words, and ``docs`` encoded."""
    counts = written(word_counts(docs), "word-counts")
    frequent, own = _vocabulary(counts)
    encoded = encode(docs, frequent)
    network = train(encoded, frequent, own)
    network.shares, network.unseen = word_shares(counts, frequent), unseen_shares(counts, frequent)
    return network, encoded


def first_masked(raw: bytes, k: int, rounds: int = ROUNDS, stride: int = STRIDE) -> int:
    """The first position of a document's ids that round ``k`` masks, if it has so many."""
    return (crc32(raw[:64]) + k * max(1, stride // rounds)) % stride


def masked(raw: bytes, k: int, rounds: int = ROUNDS, stride: int = STRIDE) -> np.ndarray:
    """The positions of a document's ids that round ``k`` masks: where rounds are as many as the stride, each position is masked in one of them."""
    return np.arange(first_masked(raw, k, rounds, stride), len(raw) // 2, stride)


def all_masked(documents: list[bytes], firsts: list[int], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The windows and ids of every document's masked positions, in order."""
    ids, starts = joined(documents)
    firsts = np.array(firsts, np.int64)
    sizes = np.fromiter(map(len, documents), np.int64, len(documents)) // 2
    many = np.maximum(0, (sizes - firsts + stride - 1) // stride)
    at = np.repeat(starts + firsts - stride * (np.cumsum(many) - many), many) + stride * np.arange(many.sum())
    return around(ids, at), ids[at]


def train(encoded: DataFrame, frequent: list[str], counts: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """Trains on masked positions of all documents: one position in ``stride`` each round."""
    flat = initial(counts)
    context = encoded.sparkSession.sparkContext
    for k in range(rounds):
        sent = context.broadcast(flat)  # of a fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k=k) -> Iterator[pa.RecordBatch]:
            keep_memory()
            trainer = Trainer(sent.value)
            held, firsts, waiting = [], [], 0
            for batch in batches:
                for raw in batch.column("ids").to_pylist():
                    held.append(raw)
                    firsts.append(first_masked(raw, k, rounds, stride))
                    waiting += max(0, -((firsts[-1] - len(raw) // 2) // stride))
                    if waiting >= BATCHES * BATCH:  # as many as the trainer takes at once
                        trainer.add(*all_masked(held, firsts, stride))
                        held, firsts, waiting = [], [], 0
            trainer.add(*all_masked(held, firsts, stride))
            trainer.flush()
            share = trainer.share()
            chunks = [(i, share[lo : lo + CHUNK]) for i, lo in enumerate(range(0, len(share), CHUNK)) if share[lo : lo + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks], pa.int32()), pa.array([c.tobytes() for _, c in chunks], pa.binary())], names=["chunk", "v"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1))
            for batch in batches:
                for i, v in zip(batch.column("chunk").to_pylist(), batch.column("v").to_pylist()):
                    sums[i] = sums[i] + np.frombuffer(v, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names=["chunk", "v"])

        copies = encoded.select("ids").coalesce(MOST_COPIES).mapInArrow(run, "chunk int, v binary")
        total = np.zeros(SIZE + VOCABULARY + 1 + CLASSES + 1)
        for r in copies.repartition("chunk").mapInArrow(add_up, "chunk int, v binary").collect():  # as much as the weights
            v = np.frombuffer(bytes(r["v"]))
            total[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(v)] = v
        used = spread(total[SIZE:])
        flat = np.where(used > 0, total[:SIZE] / np.maximum(used, 1), flat).astype(np.float32)
    return Network(frequent, flat)


def score(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum) and mean_log_likelihood of every row of ``docs``.

    Null, empty and blank texts have no words, a sum of 0 and a null mean.  Repeated rows give
    repeated results; other columns are ignored.  ``network`` is trained on ``docs`` unless given.
    A given network without shares scores the buckets only; words that its corpus didn't have
    count as one more word of their bucket.
    """
    if network is None:
        network, encoded = fit(docs)
    else:
        encoded = encode(docs, network.frequent)
    shares, sent = network.shares, docs.sparkSession.sparkContext.broadcast((network.flat, network.unseen))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        network = Network([], sent.value[0], None, sent.value[1])
        for batch in batches:
            raw = batch.column("ids").to_pylist()
            n = np.array([len(x) // 2 for x in raw], np.int64)
            ids = np.frombuffer(b"".join(raw), np.int16)
            s = network.score(ids, n)
            # All words of buckets as unseen ones; known words' shares are added where they differ.
            rare = ids >= VOCABULARY - BUCKETS
            s += np.bincount(np.repeat(np.arange(len(n)), n)[rare], network.unseen[ids[rare] - (VOCABULARY - BUCKETS)], len(n)) if len(n) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(s)], names=["doc_id", "row", "n_tokens", "log_likelihood"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scores = encoded.mapInArrow(run, f"doc_id {id_type}, row long, n_tokens long, log_likelihood double")
    if shares is not None:
        # Neither table is bounded: joins sort and merge at every size.
        known = occurrences(encoded).join(shares.hint("merge"), "hash").select("gain", F.explode("rows").alias("row")).groupBy("row").agg(F.sum("gain").alias("gain"))
        scores = scores.join(known.hint("merge"), "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("gain", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scores.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
