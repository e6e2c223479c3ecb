"""Repeated runs of lines by winnowing over line hashes, with DataFrame operations only.

A line here ends at a line feed or after a sentence.  From every line on, the shortest sequence
of lines that reaches the characters of a run is a window; the least line hash in it is its
fingerprint, and neighbouring windows mostly share one.  A repeated run holds at least the window
from its first line, whose fingerprint is the same in every copy: so fingerprints that stand in
one place only rule their windows out, and none of a repeated run is lost.  Around the places
that are left, every window and every sequence that goes on from it to a later last line is
compared whole with those of all other places; what stands earlier too is cut, and overlapping
sequences extend each other both ways to the whole run.  A run's first place always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import join_hot, table, text_or_empty, written

#: A repeated run counts from so many characters on.
RUN_CHARS = 120
_ENDS = r"(?<=[\n \t])(?<=\n|[.!?][ \t])"
_MARK = "\x01"
_WHITE = " \t\n\x0b\f\r"
#: Lines under so many characters are fingerprints only of windows that have no others.
LONG_LINE = 16
#: Lines whose lengths are added up at once: appending to arrays copies them.
_BLOCK = 32


def _marked(text):
    """``text`` with a mark after every line, where it holds neither tabs nor marks."""
    for end in ("\n", ". ", "! ", "? "):
        text = F.replace(text, F.lit(end), F.lit(end + _MARK))
    return text


def _plain(text):
    return ~(text.contains("\t") | text.contains(_MARK))


def _lines(text):
    """The lines: marks are found much faster than ends by an expression, which is left to the other texts."""
    return F.when(_plain(text), F.split(_marked(text), _MARK, -1)).otherwise(F.split(text, _ENDS, -1))


def _line_count(text):
    return F.when(_plain(text), F.length(_marked(text)) - F.length(text) + 1).otherwise(F.size(F.split(text, _ENDS, -1)))


def _row_key(text):
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, row, hs (hashes of trimmed lines) and ls (their lengths) of rows that have both a doc_id and text."""
    trimmed = F.transform(_lines(F.col("t")), lambda x: F.btrim(x, F.lit(_WHITE)))
    rows = docs.select("doc_id", text_or_empty("text").alias("t")).filter(F.col("doc_id").isNotNull() & (F.length("t") >= RUN_CHARS))
    return rows.select("doc_id", _row_key(F.col("t")).alias("row"), trimmed.alias("ts")).select("doc_id", "row", F.expr("transform(ts, x -> xxhash64(x))").alias("hs"), F.expr("transform(ts, x -> length(x))").alias("ls"))


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value``, computed once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sums(n: str, ls: str) -> str:
    """The characters before each of ``n`` lines, and all of them."""
    blocks = f"transform(sequence(0, ({n} - 1) div {_BLOCK}), b -> aggregate(slice({ls}, int(b) * {_BLOCK} + 1, {_BLOCK}), array(0), (a, l) -> array_append(a, element_at(a, -1) + l)))"
    before = "aggregate(bs, array(0), (a, x) -> array_append(a, element_at(a, -1) + element_at(x, -1)))"
    return _let(blocks, "bs", _let(before, "os", "array_append(flatten(transform(bs, (x, b) -> transform(slice(x, 1, size(x) - 1), v -> v + get(os, b)))), element_at(os, -1))"))


def _search(low: str, high: str, holds: str) -> str:
    """The least of low..high for which ``holds`` (of m), or high, by halving."""
    step = f"(s, k) -> if(s.lo < s.hi, {_let('(s.lo + s.hi) div 2', 'q', _let('int(q)', 'm', f'if({holds}, struct(s.lo as lo, m as hi), struct(m + 1 as lo, s.hi as hi))'))}, s)"
    return f"aggregate(sequence(0, int(ceil(log2(size(ps) + 1)))), struct({low} as lo, {high} as hi), {step}, s -> s.lo)"


def windows(lines: DataFrame, run_chars: int) -> DataFrame:
    """rid (a row's own number), doc_id, row, hs and w of ``lines``.

    w.ends holds the line after each first line's window; of neighbouring windows with one
    fingerprint w.los holds the first of their first lines and w.gs the fingerprint; w.again
    those fingerprints that the row has as several lines.
    """
    end = _search("i + 1", "size(ps) - 1", "get(ps, m) >= z")
    for k in (8, 7, 6, 5, 4, 3, 2, 1):  # most windows have few lines: these are tried before the search
        end = f"if(get(ps, i + {k}) >= z, i + {k}, {end})"
    ends = _let(_sums("size(hs)", "ls"), "ps", f"transform(filter(transform(slice(ps, 1, size(hs)), p -> p + {run_chars}), z -> z <= element_at(ps, -1)), (z, i) -> {end})")
    # The hashes of long lines are negative, so that short lines are the least only among themselves.
    ranked = f"zip_with(hs, ls, (h, l) -> if(l >= {LONG_LINE}, h | shiftleft(1L, 63), h & 9223372036854775807L))"
    least = _let(ranked, "ks", "transform(es, (e, i) -> array_min(slice(ks, i + 1, e - i)))")
    heads = "filter(transform(fs, (f, i) -> if(i > 0 and get(fs, i - 1) = f, null, i)), i -> i is not null)"
    twice = _let("sort_array(transform(hs, h -> h & 9223372036854775807L))", "xs", "filter(xs, (x, i) -> x = get(xs, i + 1))")
    found = _let("transform(is, i -> get(fs, i) & 9223372036854775807L)", "gs", f"struct(es as ends, is as los, gs, array_intersect(gs, {twice}) as again)")
    found = _let(ends, "es", _let(f"{least}", "fs", _let(heads, "is", found)))
    return lines.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "row", "hs", F.expr(found).alias("w"))


def grams(docs: DataFrame, run_chars: int) -> DataFrame:
    """g, doc_id, row, lo and hi (first line, line after the last) of every sequence that may be repeated."""
    lines = written(windows(line_table(docs), run_chars), "windows").select("rid", "doc_id", "row", "hs", "w.*")
    counts = lines.select(F.explode(F.concat("gs", "again")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    places = lines.select("rid", F.explode(F.expr("transform(gs, (g, k) -> struct(g, get(los, k) as i, coalesce(get(los, k + 1), size(ends)) - 1 as j))")).alias("p")).select("rid", "p.*")
    held = join_hot(places, written(counts, "fingerprints"), ["g"], "n").groupBy("rid").agg(F.collect_list(F.struct("i", "j")).alias("ranges"))  # at most the row's lines
    # From each first line: its window, and what goes on from there until the next line's window ends.
    spans = "flatten(transform(flatten(transform(ranges, r -> sequence(r.i, r.j))), i -> transform(sequence(get(ends, i), greatest(get(ends, i), coalesce(get(ends, i + 1), size(hs) + 1) - 1)), e -> struct(xxhash64(slice(hs, i + 1, e - i)) as g, i as lo, e as hi))))"
    found = lines.select("rid", "doc_id", "row", "hs", "ends").join(held.hint("merge"), "rid")
    return found.select("doc_id", "row", F.explode(F.expr(spans)).alias("f")).select("f.g", "doc_id", "row", "f.lo", "f.hi")


def repeated_runs(docs: DataFrame, *, run_chars: int = RUN_CHARS) -> DataFrame:
    """doc_id, row and cuts: (first line, line after the last) of every later repeated run."""
    own = written(grams(docs, run_chars), "grams")
    place = F.struct("doc_id", "row", "lo")
    # Rows of equal id and text have equal places, so that they are no copies of each other.
    first = own.groupBy("g").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = join_hot(own, written(first, "first-places"), ["g"], "n").filter(place > F.col("first")).select("doc_id", "row", F.struct("lo", "hi").alias("w"))
    merged = F.expr(
        """aggregate(concat(sort_array(ws), array(struct(2147483647 as lo, 2147483647 as hi))),
            cast(struct(-1 as lo, -1 as hi, array() as cuts) as struct<lo:int, hi:int, cuts:array<struct<lo:int, hi:int>>>),
            (s, w) -> if(w.lo <= s.hi,
                struct(s.lo as lo, greatest(s.hi, w.hi) as hi, s.cuts as cuts),
                struct(w.lo as lo, w.hi as hi, if(s.hi >= 0, array_append(s.cuts, struct(s.lo as lo, s.hi as hi)), s.cuts) as cuts)),
            s -> s.cuts)"""
    )
    # At most two sequences for each of the row's lines.
    return later.groupBy("doc_id", "row").agg(F.collect_set("w").alias("ws")).select("doc_id", "row", merged.alias("cuts"))


def dedup_lines(docs: DataFrame, *, run_chars: int = RUN_CHARS) -> DataFrame:
    """``docs`` with later repeated runs of ``run_chars`` or more cut out of text, and lines and removed added.

    ``lines`` counts a row's lines and ``removed`` those cut.  A run's first occurrence, by
    doc_id, row key (of rows of one doc_id) and then position, stays.  Null texts stay null with no lines, empty ones have one;
    rows of a null doc_id are never cut and never a source; repeated rows (equal id and text)
    count as one and are treated alike.  n_chars, where ``docs`` has it, follows the new text.
    """
    cuts = written(repeated_runs(docs, run_chars=run_chars), "cuts").select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("cuts").alias("_cuts"))
    columns = [c for c in docs.columns if c not in ("lines", "removed")]
    keyed = docs.select(*columns, _row_key(text_or_empty("text")).alias("_key"))
    met = keyed.join(cuts.hint("merge"), (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_row")), "left").drop("_doc", "_row", "_key")
    cut = F.col("_cuts").isNotNull()
    met = met.withColumn("_lines", F.when(cut, _lines(F.col("text"))))
    kept = F.expr("filter(_lines, (x, i) -> not exists(_cuts, c -> i >= c.lo and i < c.hi))")
    met = met.withColumn("_kept", F.when(cut, kept))
    out = {"text": F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join("_kept", "")), "lines": F.coalesce(F.when(cut, F.size("_lines")).otherwise(_line_count(F.col("text"))), F.lit(0)).cast("long")}
    out["removed"] = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length(F.array_join("_kept", "")).cast(kind))
    return met.select(*[out.get(c, F.col(c)).alias(c) for c in [*columns, "lines", "removed"]])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
