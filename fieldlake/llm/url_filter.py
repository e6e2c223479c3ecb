"""URL rules in a sorted digest array: 64-bit xxhash keys, memory-mapped on every executor.

A rule is a string ``host/path-prefix`` with an action.  The rules are held as one file: the
lengths that rules' paths have, the sorted keys, the ends of the rules' strings, the actions,
and the strings.  The file goes from the shared folder to every executor, which maps it into
memory and reads no rule but those it asks for; a batch of urls makes all candidate keys (every
suffix of the host at a dot, every path prefix of a length that some rule has), finds them by
vectorised binary search, and confirms the finds on the stored strings, all at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import put_bytes, table

ACTIONS = ("allow", "block")
#: The rules of the query: (action, host/path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rules are a curated list that the driver sorts; more than this do not belong into one mapped file.
MAX_RULES = 2_000_000


def build_index(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file's bytes.  Of repeated rules the last action counts."""
    own = {rule: ACTIONS.index(action) for action, rule in rules}
    if len(own) > MAX_RULES:
        raise ValueError(f"{len(own)} rules; an index holds {MAX_RULES} at most")
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r, a) for r, a in own.items())
    keys = np.array([k for k, _, _ in keyed], np.uint64)
    strings = [r.encode() for _, r, _ in keyed]
    starts = np.r_[0, np.cumsum([len(s) for s in strings], dtype=np.int64)].astype(np.int64)
    run = int(np.unique(keys, return_counts=True)[1].max()) if len(keys) else 0  # most rules of one key
    lengths = sorted({len(r.partition("/")[2]) + 1 for r in own})
    head = np.array([len(keys), run, len(lengths), *lengths], np.int64)
    return head.tobytes() + keys.tobytes() + starts.tobytes() + bytes(a for _, _, a in keyed) + b"".join(strings)


class DigestIndex:
    """The file mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, self.run, k = (int(x) for x in raw[:24].view(np.int64))
        self.prefix_lengths = raw[24 : 24 + 8 * k].view(np.int64).tolist()
        at = 24 + 8 * k
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.starts = raw[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.actions = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.letters = raw[at + 17 * n + 8 :]

    def rule(self, k: int) -> str:
        return self.letters[self.starts[k] : self.starts[k + 1]].tobytes().decode()

    def _equal(self, rules: np.ndarray, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each rule's string is that of its probe."""
        same = self.starts[rules + 1] - self.starts[rules] == sizes
        own = np.nonzero(same & (sizes > 0))[0]
        if len(own):
            step = np.arange(sizes[own].sum()) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            stored = self.letters[np.repeat(self.starts[rules[own]], sizes[own]) + step]
            asked = letters[np.repeat(starts[own], sizes[own]) + step]
            same[own] = np.logical_and.reduceat(stored == asked, np.cumsum(sizes[own]) - sizes[own])
        return same

    def find(self, strings: list[str]) -> np.ndarray:
        """For each string the number of the equal rule, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        probes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts, letters = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), np.uint8)
        at = np.searchsorted(self.keys, probes)
        for step in range(self.run):  # several rules may share a key
            k = np.minimum(at + step, len(self.keys) - 1)
            hit = np.nonzero((out < 0) & (self.keys[k] == probes))[0]
            hit = hit[self._equal(k[hit], letters, starts[hit], sizes[hit])]
            out[hit] = k[hit]
        return out


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url):
    """Columns host and path as the contract has them; both empty without a ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def suffixes(host: str) -> Iterator[str]:
    """The host, then what follows each of its dots."""
    yield host
    at = host.find(".")
    while at >= 0:
        yield host[at + 1 :]
        at = host.find(".", at + 1)


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url).

    The longest rule that fits decides; urls that none fits get ``default``.  Null urls and urls
    without ``://`` have an empty host and path and fit no rule.  Repeated rows give repeated
    results; other columns are ignored; without rules every verdict is the default.
    """
    spark = pages.sparkSession
    path = put_bytes(spark, "url-rules", build_index(rules))
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            owner, keys = [], []
            for i, (host, path_) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                if not host and not path_:
                    continue
                lengths = [n for n in index.prefix_lengths if n <= len(path_)]
                for s in suffixes(host):
                    for n in lengths:
                        owner.append(i)
                        keys.append(s + path_[:n])
            best: dict[int, tuple[int, int]] = {}
            found = index.find(keys)
            for at in np.nonzero(found >= 0)[0].tolist():
                i, size = owner[at], len(keys[at])
                if i not in best or size > best[i][0]:
                    best[i] = (size, int(found[at]))
            rule = [index.rule(best[i][1]) if i in best else None for i in range(batch.num_rows)]
            verdict = [ACTIONS[index.actions[best[i][1]]] if i in best else default for i in range(batch.num_rows)]
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    host, path_ = split_url(F.col("url").cast("string"))
    return pages.select("page_id", host.alias("host"), path_.alias("path")).mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: The contract's five rules, spelt out here once more so that the SQL doesn't follow the engine's.
OP3_SQL = """
WITH u AS (
  SELECT page_id, strpos(url, '://') AS k, url FROM pages
), s AS (
  SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s
)
SELECT page_id, host, path,
       CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
       CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'allow'
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'block'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'block'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'allow'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM p
"""
