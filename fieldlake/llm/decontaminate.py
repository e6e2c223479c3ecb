"""Benchmark passages in documents, found with edits by the pigeonhole principle.

A test item of m characters may differ from a passage by k = floor(rate * m) edits.  Cut into
k + 1 pieces, at least one piece must then stand in the passage unchanged.  One automaton finds
the pieces of all items; around each find the bit-parallel edit distance by Myers decides.
Short items have a budget of no edits, so one piece, and stand between other characters than
letters and digits.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldlake.llm.common import put_bytes, table

RATE = 0.08
#: Items below this length have no budget of edits; items below so many words would stand in clean documents by chance: they match a document that is nothing else.
MIN_CHARS, MIN_WORDS = 40, 3
#: Characters of test items that one pass over the documents takes (some 100 MB in a worker); more items take more passes.
BLOCK_CHARS = 1_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space as one blank."""
    return " ".join(text.lower().split()) if text else ""


class Pattern:
    """A test item for Myers' search; bit i of ``at[c]`` says that character i is c."""

    __slots__ = ("item_id", "text", "budget", "at")

    def __init__(self, item_id, text: str, rate: float):
        self.item_id, self.text, self.budget = item_id, text, int(rate * len(text))
        self.at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.at[c] |= 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        n, m = self.budget + 1, len(self.text)
        ends = [m * i // n for i in range(n + 1)]
        for lo, hi in zip(ends, ends[1:]):
            yield lo, self.text[lo:hi]

    def search(self, window: str) -> tuple[int, int]:
        """The least distance to a substring of ``window``, and where the first such one ends."""
        m, get = len(self.text), self.at.get
        mask, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = mask, 0, m, m, 0
        for j, c in enumerate(window, 1):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (mask & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, j
            ph = (ph << 1) & mask
            mh = (mh << 1) & mask
            pv = mh | (mask & ~(xv | ph))
            mv = ph & xv
        return best, end


class Matcher:
    """All items of a block in one automaton."""

    def __init__(self, items: list[tuple], rate: float, min_chars: int):
        self.patterns: list[Pattern] = []
        self.whole: dict[str, list] = defaultdict(list)
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            short = len(text) < min_chars
            if short and text.count(" ") + 1 < MIN_WORDS:
                self.whole[text].append(item_id)
                continue
            p = Pattern(item_id, text, 0 if short else rate)
            for offset, piece in p.pieces():
                pieces[piece].append((-1 - len(self.patterns) if short else len(self.patterns), offset))
            self.patterns.append(p)
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item_id, distance, budget, end in the normalised text), one for each item found."""
        t = normalise(text)
        found = [(i, 0, 0, len(t)) for i in self.whole.get(t, ())]
        if not self.patterns:
            return found
        starts: dict[int, set[int]] = defaultdict(set)
        shorts: dict[int, int] = {}
        for end, (size, owners) in self.automaton.iter(t):
            for k, offset in owners:
                if k >= 0:
                    starts[k].add(end + 1 - size - offset)
                elif k not in shorts and not t[end + 1 : end + 2].isalnum() and not t[max(0, end - size) : end + 1 - size].isalnum():
                    shorts[k] = end + 1
        found += [(self.patterns[-1 - k].item_id, 0, 0, end) for k, end in shorts.items()]
        for k, at in starts.items():
            p = self.patterns[k]
            best = (p.budget + 1, 0)
            spans: list[list[int]] = []
            for s in sorted(at):
                lo, hi = max(0, s - p.budget), s + len(p.text) + p.budget
                if spans and lo <= spans[-1][1] and hi - spans[-1][0] <= 4 * len(p.text):
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            for lo, hi in spans:
                d, end = p.search(t[lo:hi])
                best = min(best, (d, lo + end))
            if best[0] <= p.budget:
                found.append((p.item_id, best[0], p.budget, best[1]))
        return found


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The test items in blocks of bounded size; null, empty and repeated ones left out."""
    block, size = [], 0
    for item_id, text in benchmark.select("item_id", F.col("text").cast("string")).distinct().orderBy("item_id", "text").toLocalIterator():
        t = normalise(text)
        if t and item_id is not None:
            block.append((item_id, t))
            size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


_MATCHERS: dict[str, Matcher] = {}


def _shipped(spark: SparkSession, items: list[tuple], rate: float, min_chars: int) -> Callable[[], Matcher]:
    """What gives a block's matcher in a worker; the block goes there as a file, so that the driver holds one block at a time."""
    path = put_bytes(spark, "items", pickle.dumps((items, rate, min_chars)))
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]

    def made() -> Matcher:
        if name not in _MATCHERS:  # one for each worker process
            _MATCHERS.clear()
            with open(SparkFiles.get(name), "rb") as file:
                _MATCHERS[name] = Matcher(*pickle.load(file))
        return _MATCHERS[name]

    return made


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, budget and end of every item that stands in a document.

    The least distance of each pair counts; ``end`` is where the passage ends in the normalised
    text.  Null and empty documents hold nothing, and null ids of documents stay null.  Repeated
    documents give repeated rows.  Without items there are no rows.
    """
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, budget int, end long"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, block_chars):

        made = _shipped(docs.sparkSession, items, rate, min_chars)

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            matcher = made()
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    for hit in matcher.find(t):
                        rows.append(i)
                        hits.append(hit)
                ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                columns = list(zip(*hits)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (item_arrow, pa.int32(), pa.int32(), pa.int64())))], names=["doc_id", "item_id", "distance", "budget", "end"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test item stands."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, block_chars):

        made = _shipped(docs.sparkSession, items, rate, min_chars)

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            matcher = made()
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
