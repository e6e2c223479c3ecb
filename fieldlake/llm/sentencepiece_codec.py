"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units of text (a unit is what no piece reaches beyond: blanks and the word
after them) are written one after another and indexed by a suffix array, sorted to the length of
the longest piece.  A binary search finds every piece's range of occurrences; these edges are
sorted by position; then each unit is relaxed: of the edges that join two neighbouring symbols
the best one, leftmost among equals, replaces them, until none is left.  For a BPE vocabulary that
is the encoder's own order of merges, and the ids are the library's.  (Shortest paths over all
edges, as for a unigram vocabulary, would give other ids for this kind of vocabulary.)
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import table

#: Where the public vocabulary lies unless another path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Code points of new units that one suffix array holds, and units whose ids a worker keeps.
INDEX_CHARS, KEPT_UNITS = 300_000, 150_000
#: Longer units are merged with a heap, so that one of them doesn't lengthen the others' rounds.
LONG_UNIT = 96
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The pieces of a model file, read with the library; pickles as plain lists."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.unknown, self.size = sp.unk_id(), n
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces) or n > 65_535:
            raise ValueError("pieces with a blank after other characters, or over 65535 pieces, aren't handled")


class Codec:
    """Encodes and decodes batches of texts; keeps the ids of units it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        ranks = {s: k for k, s in enumerate(sorted({s for _, s in v.pieces.values()}, reverse=True))}
        self.single = {p: i for p, (i, _) in v.pieces.items() if len(p) == 1}
        self.many = [(p, i, ranks[s]) for p, (i, s) in v.pieces.items() if len(p) > 1]
        self.longest = max((len(p) for p, _, _ in self.many), default=1)
        if self.longest > 16:
            raise ValueError("pieces of over 16 characters aren't handled")
        self.lengths = np.array([len(p) for p, _, _ in self.many], np.int64)
        self.ranks = np.array([*(r for _, _, r in self.many), _NONE], np.int32)
        self.ids = np.array([*(i for _, i, _ in self.many), v.unknown], np.uint16)
        spelt = np.zeros((len(self.many), 16), np.uint32)
        for row, (p, _, _) in zip(spelt, self.many):
            row[: len(p)] = list(map(ord, p))
        self.letters, inverse = np.unique(np.r_[np.uint32(0), spelt.ravel()], return_inverse=True)
        self.spelt = inverse[1:].reshape(spelt.shape)
        inside = set("".join(p for p, _, _ in self.many))
        apart = "".join(c for c in "\n\t\r" if c not in inside)  # no piece joins these with others
        self.unit = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+" + (f"|[{apart}]" if apart else ""))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.out = [b""] * v.size
        for p, (i, _) in v.pieces.items():
            self.out[i] = p.replace(BLANK, " ").encode()
        for b, i in v.bytes_.items():
            self.out[i] = bytes([b])
        self.out[v.unknown] = " ⁇ ".encode()

    def _char(self, c: str) -> list[int]:
        i = self.single.get(c)
        if i is not None:
            return [i]
        return [self.vocabulary.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if self.vocabulary.bytes_ else [self.vocabulary.unknown]

    def _merge_long(self, units: list[str]) -> None:
        """Ids of long units: the suffix array's edges, relaxed in the same order with a heap."""
        text = "\0".join(units)
        at, length, number = self._edges(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        reach, none = self.longest + 1, len(self.lengths)
        edge = np.full(len(text) * reach, none, np.uint16)
        edge[at * reach + length] = number
        base = 0
        for unit in units:
            self.known[unit] = self._heap(unit, edge[base * reach : (base + len(unit)) * reach], reach)
            base += len(unit) + 1

    def _heap(self, unit: str, edge: np.ndarray, reach: int) -> bytes:
        """Merges of one unit; ``edge`` has the number of the piece of each length at each position."""
        n, none = len(unit), int(_NONE)

        def rank(lo: int, hi: int) -> int:
            return int(self.ranks[edge[lo * reach + hi - lo]]) if hi - lo < reach else none

        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1" * n)
        firsts = self.ranks[edge[np.arange(n - 1) * reach + 2]]
        heap = [(int(firsts[i]), i, i + 2) for i in np.nonzero(firsts < _NONE)[0].tolist()]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            alive[j], ends[i], after[i] = 0, end, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(i, ends[after[i]])) < none:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if before[i] >= 0 and (r := rank(before[i], end)) < none:
                heapq.heappush(heap, (r, before[i], end))
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                out += self._char(unit[i]) if ends[i] == i + 1 else [int(self.ids[edge[i * reach + ends[i] - i]])]
        return np.array(out, np.uint16).tobytes()

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, length and number of every occurrence of a piece in the text, by position."""
        alphabet = np.unique(codes)
        width = 8 if len(alphabet) < 255 else 16
        per = 64 // width  # characters in one key
        local = (np.searchsorted(alphabet, codes) + 1).astype(np.uint64)
        n = len(local)
        padded = np.zeros(n + 32, np.uint64)
        padded[:n] = local
        key = np.zeros(n + 16, np.uint64)
        for k in range(per):
            key |= padded[k : n + 16 + k] << np.uint64(width * (per - 1 - k))
        # A suffix's rank by the characters of its first key, then by those of twice as many, ...
        keys, order = np.unique(key, return_inverse=True)
        reach, tables = per, []
        while reach < 16:
            nxt = np.zeros_like(order)
            nxt[: n + 16 - reach] = order[reach:]
            pairs, order = np.unique((order << 32) | nxt, return_inverse=True)
            tables.append(pairs)
            reach *= 2
        packed = np.sort((order[:n] << 32) | np.arange(n))  # the suffix array, with the ranks
        ranked, suffixes = packed >> 32, packed & 0xFFFFFFFF

        letter = np.searchsorted(alphabet, self.letters)
        letter = np.where(alphabet[np.minimum(letter, len(alphabet) - 1)] == self.letters, letter + 1, 0)
        letter[0] = 0  # the filler behind short pieces
        chars = letter[self.spelt].astype(np.uint64)
        there = np.nonzero(((chars > 0) | (self.spelt == 0)).all(1))[0]
        chars, lengths = chars[there], self.lengths[there]
        # Each part of a piece as the range of keys that begin with it; then ranges of pairs of parts.
        lo_parts, hi_parts = [], []
        for at in range(0, 16, per):
            lo = np.zeros(len(there), np.uint64)
            for k in range(per):
                lo |= chars[:, at + k] << np.uint64(width * (per - 1 - k))
            free = np.clip(at + per - lengths, 0, per)
            span = np.where(free >= per, np.uint64(2**64 - 1), (np.uint64(1) << (np.minimum(free, per - 1).astype(np.uint64) * np.uint64(width))) - np.uint64(1))
            lo_parts.append(np.searchsorted(keys, lo, "left"))
            hi_parts.append(np.searchsorted(keys, lo | span, "right"))
        for pairs in tables:
            size = 16 // len(lo_parts)
            lo_next, hi_next = [], []
            for k in range(0, len(lo_parts), 2):
                short = lengths <= (k + 1) * size  # nothing is asked of the second part
                absent = ~short & (hi_parts[k] == lo_parts[k])
                lo = np.searchsorted(pairs, (lo_parts[k] << 32) | np.where(short, 0, lo_parts[k + 1]))
                hi = np.searchsorted(pairs, np.where(short, hi_parts[k] << 32, (lo_parts[k] << 32) | hi_parts[k + 1]))
                lo_next.append(lo)
                hi_next.append(np.where(absent, lo, hi))
            lo_parts, hi_parts = lo_next, hi_next
        lo, hi = np.searchsorted(ranked, lo_parts[0]), np.searchsorted(ranked, hi_parts[0])
        counts = np.maximum(hi - lo, 0)
        at = suffixes[np.arange(counts.sum()) + np.repeat(lo - (np.cumsum(counts) - counts), counts)]
        edges = np.sort((at << 24) | np.repeat((lengths << 16) | there, counts))
        return edges >> 24, (edges >> 16) & 0xFF, edges & 0xFFFF

    def _index(self, units: list[str]) -> None:
        """Finds the ids of new units."""
        text = "\0".join(units)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int32, len(units))
        starts = np.cumsum(sizes + 1, dtype=np.int32) - sizes - 1
        stops = starts + sizes
        at, length, number = self._edges(codes)
        reach = self.longest + 1
        edge = np.full(len(codes) * reach, len(self.lengths), np.uint16)
        edge[at * reach + length] = number
        sym = np.delete(np.arange(len(codes), dtype=np.int32), stops[:-1])  # one symbol for each character
        unit = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        end = sym + 1
        begins, ends = [], []
        while len(sym):
            last = np.empty(len(sym), bool)
            np.not_equal(unit[1:], unit[:-1], out=last[:-1])
            last[-1] = True
            span = np.empty_like(sym)
            np.subtract(end[1:], sym[:-1], out=span[:-1])
            span[last] = reach
            can = np.nonzero(span < reach)[0]
            score = np.full(len(sym), _NONE, np.int32)
            score[can] = self.ranks[edge[sym[can] * reach + span[can]]]
            heads = np.r_[0, np.nonzero(last)[0][:-1] + 1]
            least = np.minimum.reduceat(score, heads)
            width = np.diff(np.r_[heads, len(sym)])
            wide = np.repeat(least < _NONE, width)
            begins.append(sym[~wide])
            ends.append(end[~wide])
            hit = np.nonzero(wide & (score == np.repeat(least, width)))[0]
            if not len(hit):
                break
            first = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]]
            end[first] = end[first + 1]
            wide[first + 1] = False
            sym, unit, end = sym[wide], unit[wide], end[wide]
        spans = np.sort((np.concatenate(begins).astype(np.int64) << 32) | np.concatenate(ends))
        begin, size = spans >> 32, (spans & 0xFFFFFFFF) - (spans >> 32)
        # Ids of the symbols; a character that is no piece gives its bytes'.
        alphabet, kind = np.unique(codes, return_inverse=True)
        single = [self._char(chr(c)) for c in alphabet.tolist()]
        flat, many = np.array(sum(single, []), np.uint16), np.array([len(x) for x in single])
        offset = np.cumsum(many) - many
        alone = size == 1
        kind = kind[begin]
        count = np.where(alone, many[kind], 1)
        upto = np.cumsum(count)
        ids = np.empty(int(upto[-1]) if len(upto) else 0, np.uint16)
        ids[(upto - count)[~alone]] = self.ids[edge[begin[~alone] * reach + size[~alone]]]
        of = np.repeat(np.nonzero(alone)[0], count[alone])
        step = np.arange(len(of)) - np.repeat(np.cumsum(count[alone]) - count[alone], count[alone])
        ids[(upto - count)[of] + step] = flat[offset[kind[of]] + step]
        cut = np.r_[0, upto][np.searchsorted(begin, stops)] * 2
        raw, lo = ids.tobytes(), 0
        for u, hi in zip(units, cut.tolist()):
            self.known[u] = raw[lo:hi]
            lo = hi

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = [self.unit.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new, size, long, long_size = [], 0, [], 0
        for u in set().union(*units):
            if u in known:
                continue
            if u in older:
                known[u] = older[u]
                continue
            if len(u) > LONG_UNIT:
                long.append(u)
                long_size += len(u)
                if long_size >= INDEX_CHARS:
                    self._merge_long(long)
                    long, long_size = [], 0
                continue
            new.append(u)
            size += len(u) + 1
            if size >= INDEX_CHARS:
                self._index(new)
                new, size = [], 0
        if new:
            self._index(new)
        if long:
            self._merge_long(long)
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.uint16) for own in units]

    def decode(self, ids: list[int | None] | np.ndarray) -> str:
        """The text; ids that are no piece's, and nulls, count as the unknown one, bytes that are no text give U+FFFD."""
        out, unknown = self.out, self.out[self.vocabulary.unknown]
        size = len(out)
        raw = b"".join([out[i] if i is not None and 0 <= i < size else unknown for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(path: str, vocabulary: Vocabulary) -> Codec:
    """One for each worker process, so that tasks share what it has seen."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(vocabulary)
    return _CODECS[path]


#: Characters of text taken at once from a batch.
SLICE_CHARS = 2_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= SLICE_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row of ``docs`` (doc_id, text).

    ``round_trip`` says that decoding the ids gives the text again, with the vocabulary's blank
    sign read as a blank.  Null and empty texts have no ids and round-trip.  Repeated rows give
    repeated results; other columns are ignored; ``model`` is read by the driver alone.
    """
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, vocabulary)
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            for lo, hi in _slices(all_texts):
                texts = all_texts[lo:hi]
                ids = codec.encode(texts)
                ok = [codec.decode(x) == (t or "").replace(BLANK, " ") for x, t in zip(ids, texts)]
                sizes = [len(x) for x in ids]
                flat = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), lists, pa.array(ok)], names=["doc_id", "n_tokens", "ids", "round_trip"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids).

    A null list gives a null text; a null, negative or too large id in a list counts as the
    unknown one; bytes that are no text give U+FFFD.  Other columns are ignored.
    """
    vocabulary = Vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, vocabulary)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
