"""Licences by canonical digest, with DataFrame operations only.

A text is normalised (case, copyright lines, a title, marks of lists, equivalent spellings,
punctuation, white space) and
its digest is joined with those of the known licence texts and notices.  Texts are whole
documents, and each line as a text of its own, since notices stand among other lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import table, text_or_empty
from fieldlake.llm.licence_digests import DIGESTS
from fieldlake.llm.licence_texts import known

#: Known texts are a curated list; beyond this number it would have to be joined as a table.
MAX_KNOWN = 100_000
#: Normalisation in order: (pattern, replacement), after lower case.
RULES = (
    # Copyright lines: a sign or a year follows, unlike in lines of a licence that begin with the word.
    (r"(^|\n)[ \t*#/;-]*(copyright[ \t:]*(\(c\)|©|[0-9][0-9][0-9][0-9])|\(c\)|©)[^\n]*", "\n"),
    (r"\ball rights reserved\b", " "),
    (r"^[ \t\n]*(the )?(mit|isc|((new|simplified|modified|revised) )?bsd)( ?[2-4]?[- ]clause)?( [\"'a-z]+)? licen[cs]e( \([a-z0-9 -]*\))?[ \t]*\n", ""),
    (r"(^|\n)[ \t]*([0-9]?[0-9][.)]|\([a-z0-9]\)|[*•-])[ \t]+", "\n"),
    (r"[&]", " and "),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement", "noninfringement"),
    (r"\bcopyright (owner|holder)", "copyright holder"),
    (r"^ +| +$", ""),
)


def canonical(text):
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


def anchors(texts: list[str]) -> list[str]:
    """Letters such that every known text holds some: others needn't be normalised."""
    out = ["licen"]
    for t in texts:
        if not any(a in t.lower() for a in out):
            out.append(max((w for w in t.lower().split() if w.isalpha()), key=len, default=""))
    return out


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, whole_licence, licences and n_notices for every row of ``docs`` (doc_id, text).

    ``whole_licence`` is the licence that the whole text is, or null; ``licences`` the sorted
    distinct identifiers of the whole text and of its lines; ``n_notices`` the number of lines
    that are a known text.  Null and empty texts hold none.  Repeated rows get equal results and
    rows of a null doc_id results of their own; other columns are ignored.
    """
    spark = docs.sparkSession
    texts, digests = (known(), DIGESTS) if texts is None else (texts, ())
    if len(texts) > MAX_KNOWN:
        raise ValueError(f"{len(texts)} known texts; {MAX_KNOWN} at most")
    own = spark.createDataFrame(texts, "licence string, body string")
    own = own.select("licence", F.sha2(F.encode(canonical(F.col("body")), "UTF-8"), 256).alias("digest")).unionByName(spark.createDataFrame(list(digests), "licence string, digest string")).groupBy("digest").agg(F.min("licence").alias("licence"))
    rows = docs.select("doc_id", text_or_empty("text").alias("t")).withColumn("row", F.xxhash64("t"))
    lines = F.split("t", "\n", -1)
    units = rows.select("doc_id", "row", F.posexplode(F.concat(F.array("t"), F.when(F.size(lines) > 1, lines).otherwise(F.array()))).alias("pos", "t"))
    held = F.lit(False)
    for a in anchors([t for _, t in texts]):
        held = held | F.lower("t").contains(a)
    units = units.filter(held).select("doc_id", "row", "pos", F.sha2(F.encode(canonical(F.col("t")), "UTF-8"), 256).alias("digest"))
    hits = units.join(F.broadcast(own), "digest")
    found = hits.groupBy("doc_id", "row").agg(
        F.max(F.when(F.col("pos") == 0, F.col("licence"))).alias("whole_licence"),
        F.sort_array(F.collect_set("licence")).alias("licences"),  # of the known identifiers
        F.count_distinct(F.when(F.col("pos") > 0, F.col("pos"))).alias("n_lines"),
    ).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "whole_licence", "licences", "n_lines")
    out = rows.select("doc_id", "row").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    whole = F.when(F.col("whole_licence").isNotNull() & (F.col("n_lines") == 0), F.lit(1)).otherwise(F.coalesce("n_lines", F.lit(0)))
    return out.select("doc_id", "whole_licence", F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), whole.cast("long").alias("n_notices"))


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licences joined by blanks, for comparison with SQL."""
    return scan(table(spark, sf_dir, "documents")).withColumn("licences", F.array_join("licences", " "))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, {_quoted(pattern)}, '{to}', 'g')".replace("'\n'", "chr(10)")
    return out


OP5_SQL = f"""
WITH known AS (
  SELECT sha256({_sql_canonical("body")}) AS digest, min(licence) AS licence
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in known())}) v(licence, body) GROUP BY 1
), rows AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), units AS (
  SELECT doc_id, 0 AS pos, t FROM rows
  UNION ALL
  SELECT doc_id, unnest(generate_series(1, len(string_split(t, chr(10))))), unnest(string_split(t, chr(10))) FROM rows WHERE contains(t, chr(10))
), hits AS (
  SELECT doc_id, pos, licence FROM units JOIN known ON digest = sha256({_sql_canonical("t")})
), found AS (
  SELECT doc_id, max(CASE WHEN pos = 0 THEN licence END) AS whole_licence, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS licences, count(DISTINCT CASE WHEN pos > 0 THEN pos END) AS n FROM hits GROUP BY doc_id
)
SELECT r.doc_id, whole_licence, coalesce(licences, '') AS licences, CASE WHEN whole_licence IS NOT NULL AND n = 0 THEN 1 ELSE coalesce(n, 0) END AS n_notices
FROM rows r LEFT JOIN found f ON r.doc_id IS NOT DISTINCT FROM f.doc_id
"""
