"""Near duplicates: MinHash bands propose, odd sketches check, full shingle sets confirm.

A document's MinHash samples make its band keys and, folded into one parity bitmap, its odd
sketch: the number of differing bits of two sketches tells their similarity, precisely where it
is high.  Documents of equal sets are one class.  In each bucket of equal band keys all
classes that aren't connected yet are compared by their sketches; pairs whose sketches allow at
least half the similarity make clusters.  Within a cluster, cut by the sizes of its sets into parts
of bounded size, all pairs of classes that aren't connected yet are compared on their full sets;
then the same between those of its parts whose sets are near enough in size.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldlake.llm.common import table, written
from fieldlake.llm.graph import components

WORDS = 5
#: 32 bands of 4 samples: a pair of similarity 0.75 shares no band with a chance of 5e-6.
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Sketches of more differing bits stand for less than 0.5; at 0.75, 57 are expected and 115 lie eight deviations off.
MOST_BITS = 115
#: Shingles of a cluster's part: a cell of the exact step holds one part, or two.
CELL = 1_000_000
#: Ratio of the sizes in one class of a large cluster; linked sets differ by 4/3 at most, so in neighbouring classes or one.
SIZES = 1.34
#: Words whose hashes a worker keeps.
KEPT_WORDS = 400_000

_RNG = np.random.default_rng(20_240_229)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MUL = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_POW = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS - 1, -1, -1)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(defaultdict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles."""

    def __init__(self):
        self.hashes = _WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: A-Z, and blank with 0x09-0x0D
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        if len(words) < WORDS:
            return _mix((h * _POW[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
        n = len(h) - WORDS + 1
        s = h[:n] * _POW[0]
        for k in range(1, WORDS):
            s = s + h[k : n + k] * _POW[k]
        return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples; in slices, so that long texts need no more memory."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = None
    for lo in range(0, len(x), 4096):
        part = ((x[None, lo : lo + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(1)
        best = part if best is None else np.minimum(best, part)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
    return key.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """The samples folded into a bitmap in which each sample flips one bit."""
    at = _mix(sig.astype(np.uint64) + (np.arange(len(sig), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    bits = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def similarity_of(bits: float) -> float:
    """The similarity that so many differing bits of two sketches stand for."""
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * float(np.log(max(1e-9, 1 - 2 * bits / SKETCH_BITS)))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n, digest (of the set), bands and odd (the sketch) of every row."""
    id_arrow = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            n, digest, bands, odd = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingler(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s) if len(s) else None
                bands.append(band_keys(sig) if len(s) else None)
                odd.append(odd_sketch(sig) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_arrow), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(odd, longs)], names=["doc_id", "n", "digest", "bands", "odd"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n long, digest binary, bands array<long>, odd array<long>")


def bucket_links(odd: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sketches of at most MOST_BITS differing bits that connect what all such pairs connect.

    Each sketch is compared once with those that nothing has reached so far, so that groups of
    near copies cost little; only sketches that are all dissimilar are compared all with all.
    """
    found, left, reached = [], np.arange(len(odd)), []
    while len(left):
        if not reached:
            reached, left = [int(left[0])], left[1:]
        i = reached.pop()
        near = np.bitwise_count(odd[left] ^ odd[i]).sum(1, dtype=np.int64) <= MOST_BITS
        found += [(i, j) for j in left[near].tolist()]
        reached += left[near].tolist()
        left = left[~near]
    return found


def _propose(buckets: DataFrame) -> DataFrame:
    """Links (a, b) among the rows (key, rep, odd) of each bucket."""
    id_type, id_arrow = buckets.schema["rep"].dataType.simpleString(), to_arrow_type(buckets.schema["rep"].dataType)
    words = SKETCH_BITS // 64
    rows = buckets.select("key", "rep", "odd").repartition("key").sortWithinPartitions("key", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, odds = None, [], []

        def done() -> list[tuple]:
            if len(reps) < 2:
                return []
            return [(min(reps[i], reps[j]), max(reps[i], reps[j])) for i, j in bucket_links(np.concatenate(odds))]

        def emit(found: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*set(found)) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, id_arrow), pa.array(b, id_arrow)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[tuple] = []
            keys, own = batch.column("key").to_numpy(), batch.column("rep").to_pylist()
            odd = batch.column("odd").flatten().to_numpy().view(np.uint64).reshape(-1, words)
            starts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:]):
                if keys[lo] != key:
                    found += done()
                    key, reps, odds = keys[lo], [], []
                reps += own[lo:hi]
                odds.append(odd[lo:hi])
            yield emit(found)
        yield emit(done())

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def links_between(sets: list[np.ndarray], labels: np.ndarray, left: int) -> list[tuple[int, int]]:
    """Pairs whose full sets are similar, thinned to those that join different labels.

    With ``left`` 0 all pairs are compared, else each of the first ``left`` sets with each of the
    others; pairs of equal labels are joined already.  One pass over the others' shingles counts
    a set's intersections with all of them.
    """
    labels, found, n = labels.copy(), [], len(sets)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(int(at.max()) + 1, np.int32)
    for i in range(left or n):
        lo = left or i + 1
        other = lo + np.nonzero((labels[lo:] != labels[i]) & (100 * np.minimum(sizes[lo:], sizes[i]) >= 75 * np.maximum(sizes[lo:], sizes[i])))[0]
        if not len(other):
            continue
        own = at[ends[i] - sizes[i] : ends[i]]
        flag[own] = 1
        if len(other) * 2 > n - lo:
            common = np.add.reduceat(flag[at[ends[lo] - sizes[lo] :]], ends[lo:] - sizes[lo:] - (ends[lo] - sizes[lo]))[other - lo]
        else:
            common = np.array([int(flag[at[ends[j] - sizes[j] : ends[j]]].sum()) for j in other])
        flag[own] = 0
        for j in other[100 * common >= 75 * (sizes[i] + sizes[other] - common)]:
            if labels[j] != labels[i]:
                found.append((i, int(j)))
                labels[labels == labels[j]] = labels[i]
    return found


def _confirm(cells: DataFrame, keys: list[str], side: str | None) -> DataFrame:
    """Links (a, b) among the rows (rep, comp, text) of each cell, confirmed on full sets.

    ``side`` names a boolean column: then only rows of different sides are compared.
    """
    id_type, id_arrow = cells.schema["rep"].dataType.simpleString(), to_arrow_type(cells.schema["rep"].dataType)
    columns = [*keys, "rep", "comp", "text", *([side] if side else [])]
    rows = cells.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *([F.desc(side)] if side else []), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        key, reps, comps, sets, left = None, [], [], [], 0

        def done() -> list[tuple]:
            if len(sets) < 2 or side and left in (0, len(sets)):
                return []
            labels = np.unique(np.array(comps), return_inverse=True)[1]
            return [(min(reps[i], reps[j]), max(reps[i], reps[j])) for i, j in links_between(sets, labels, left)]

        def emit(found: list[tuple]) -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, id_arrow), pa.array(b, id_arrow)], names=["a", "b"])

        for batch in batches:
            found: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if row[: len(keys)] != key:
                    found += done()
                    key, reps, comps, sets, left = row[: len(keys)], [], [], [], 0
                rep, comp, text = row[len(keys) : len(keys) + 3]
                s = shingler(text)
                if len(s):
                    reps.append(rep)
                    comps.append(comp)
                    sets.append(s)
                    left += bool(side and row[-1])
            yield emit(found)
        yield emit(done())

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}").distinct()


def _dealt(sized: DataFrame) -> DataFrame:
    """Where each node (node, component, n) of a cluster is compared: doc_id, cluster, wide, class, part, and the parts of its class, the next and the last.

    A cluster of over CELL shingles is wide: it is dealt out by size classes, and these into parts.
    Sets of classes that aren't neighbours are too different in size for a link.
    """
    wide = sized.groupBy("component").agg((F.sum("n") > CELL).alias("wide"))
    sized = sized.join(wide, "component").withColumn("class", F.when(F.col("wide"), F.floor(F.log("n") / math.log(SIZES))).otherwise(0).cast("int"))
    parts = sized.groupBy("component", "class").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("parts"))
    beside = lambda step, name: parts.select("component", (F.col("class") - step).alias("class"), F.col("parts").alias(name))
    every = parts.join(beside(1, "above"), ["component", "class"], "left").join(beside(-1, "below"), ["component", "class"], "left").fillna(0, ["above", "below"])
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    return sized.join(every, ["component", "class"]).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "wide", "class", part, "parts", "above", "below")


def _meetings() -> Column:
    """The pairs of parts that a row of a wide cluster takes part in: within its class (step 0), and with the neighbouring ones (step 1)."""
    numbers = lambda count: F.slice(F.sequence(F.lit(0), F.col(count)), F.lit(1), F.col(count))
    pair = lambda c, step, i, j, left: F.struct(c.cast("int").alias("class"), F.lit(step).alias("step"), i.alias("i"), j.alias("j"), left.alias("is_left"))
    own, c = F.col("part"), F.col("class")
    within = F.transform(F.filter(numbers("parts"), lambda k: k != own), lambda k: pair(c, 0, F.least(own, k), F.greatest(own, k), own < k))
    up = F.transform(numbers("above"), lambda k: pair(c, 1, own, k, F.lit(True)))
    down = F.transform(numbers("below"), lambda k: pair(c - 1, 1, k, own, F.lit(False)))
    return F.concat(within, up, down)


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have no shingles and are linked with nothing; texts under five
    words have one.  component_id is the least doc_id that links reach.  Rows of one doc_id count
    as one document, so repeated rows get equal results.  Rows of a null doc_id are linked with
    nothing, have a null component and are kept.  Other columns are ignored.
    """
    signed = written(sign(docs), "signatures")
    known = signed.filter(F.col("n") > 0).filter(F.col("doc_id").isNotNull())
    classes = written(known.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "odd"), "doc_id").alias("s")).select("digest", "n", "rep", "s.bands", "s.odd"), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1).select("key")
    odd = classes.groupBy("rep").agg(F.min("odd").alias("odd"), F.max("n").alias("n"))
    buckets = keyed.join(shared, "key").join(odd.select("rep", "odd"), "rep")
    clusters = components(written(_propose(buckets), "proposed"))

    sized = clusters.join(odd.select(F.col("rep").alias("node"), "n"), "node")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(_dealt(sized), "doc_id").withColumnRenamed("doc_id", "rep")
    texts = written(texts, "cluster-texts")
    links = written(_confirm(texts.withColumn("comp", F.col("rep")), ["cluster", "class", "part"], None), "links-within")
    comps = components(links)
    if not texts.filter("wide").isEmpty():  # what is left: links between parts of a large cluster that join components
        wide = texts.filter("wide").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        cells = wide.select("cluster", "rep", "comp", "text", F.explode(_meetings()).alias("m")).select("cluster", "rep", "comp", "text", "m.*")
        links = links.unionByName(written(_confirm(cells, ["cluster", "class", "step", "i", "j"], "is_left"), "links-across"))
        comps = components(links)

    whole = classes.select("digest", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    linked = known.select("doc_id", "n", "digest").join(whole, ["digest", "n"]).select("doc_id", "n", "component_id")
    alone = signed.filter((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no earlier near duplicate makes needless."""
    gone = near_groups(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # not bounded, so never broadcast


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
