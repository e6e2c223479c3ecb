"""Exact duplicates by deterministic block naming, with DataFrame operations only.

Every text is cut into blocks of a fixed number of characters.  Equal blocks get the same
integer name and different blocks different names: the rows are sorted by block, and the
smallest occurrence number among equal blocks is their name.  Then adjacent names are paired,
the pairs are named in the same way, and so on until each text has one name.  Texts of equal
block counts with equal names are identical, with no chance of a collision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import join_hot, table, text_or_empty, written

#: So many hot blocks are salted, and in at most three times as many parts, whatever the input's size.
HOT_BLOCKS = 4096


def blocks_of(text, block_chars: int):
    """Array of the text's blocks; the empty text has one empty block."""
    many = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    return F.when(F.length(text) <= block_chars, F.array(text)).otherwise(many)


def exact_groups(docs: DataFrame, *, block_chars: int = 4096, hot_rows: int = 2000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts equal each other.  Rows with equal text form a group;
    keep_id is the group's largest doc_id (null only if all its ids are null) and kept says
    whether the row's id is that one, so repeated rows with the largest id are all kept.  Other
    columns of ``docs`` are ignored.  The most frequent blocks, found more than ``hot_rows``
    times, are first named within salted parts, which then meet as one row each; names of frequent
    pairs, and the largest groups, come to their rows by broadcast.
    """
    text = text_or_empty("text")
    rows = docs.select(F.col("doc_id"), text.alias("t")).select(
        "doc_id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), blocks_of(F.col("t"), block_chars).alias("bs"), F.monotonically_increasing_id().alias("rid")
    )
    often = rows.select(F.explode("bs").alias("b")).groupBy(F.xxhash64("b").alias("h")).count().filter(F.col("count") > hot_rows)
    often = written(often.orderBy(F.desc("count")).limit(HOT_BLOCKS), "hot-blocks")  # rarer blocks need no salt: each has under 1 / HOT_BLOCKS of the rows
    limit = max(hot_rows, (often.agg(F.sum("count")).first()[0] or 0) // (2 * HOT_BLOCKS))
    hot = often.select("h", F.ceil(F.col("count") / limit).alias("parts"))
    first = F.col("pos") == 0
    cut = rows.select("rid", F.size("bs").alias("n"), "doc_id", "sha", F.posexplode("bs").alias("pos", "b")).select(
        "rid", "n", "pos", "b", F.monotonically_increasing_id().alias("occ"), F.xxhash64("b").alias("h"),
        F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"),
    )
    dealt = cut.join(F.broadcast(hot), "h", "left").select(
        "rid", "n", "pos", "b", "occ", "doc_id", "sha", F.col("parts").isNotNull().alias("hot"),
        F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("occ"), F.col("parts"))).alias("salt"),
    )
    name = F.min("occ").over(Window.partitionBy("b", "salt"))
    named = dealt.withColumn("name", name).select(
        "rid", "n", "pos", "occ", "name", "doc_id", "sha", F.when(F.col("hot") & (F.col("occ") == F.col("name")), F.col("b")).alias("hot_block")
    )
    named = written(named, "block-names")
    # The salted parts of a hot block meet here: one row for each part.
    parts = named.filter(F.col("hot_block").isNotNull()).select(F.col("name").alias("part"), "hot_block")
    whole = parts.groupBy("hot_block").agg(F.min("part").alias("whole"))
    parts = parts.join(whole, "hot_block").select(F.col("part").alias("name"), "whole")
    named = named.drop("hot_block").join(F.broadcast(parts), "name", "left").withColumn("name", F.coalesce("whole", "name")).drop("whole")

    heads = named.filter(F.col("pos") == 0).select("rid", "n", "doc_id", "sha", "name")
    done = heads.filter(F.col("n") == 1)
    open_ = written(named.filter(F.col("n") > 1).select("rid", "pos", "occ", "name"), "names-0")
    longest = open_.agg(F.max("pos")).first()[0]
    level = 0
    while longest is not None and longest > 0:
        even = F.col("pos") % 2 == 0
        pairs = open_.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.min("occ").alias("occ"),
        )
        pairs = written(pairs, f"pairs-{level}")
        pair_names = written(pairs.groupBy("left", "right").agg(F.min("occ").alias("name"), F.count("*").alias("size")), f"pair-names-{level}")
        level += 1
        open_ = written(join_hot(pairs, pair_names, ["left", "right"], "size").select("rid", "pos", "occ", "name"), f"names-{level}")
        longest //= 2
    long_names = open_.filter(F.col("pos") == 0).select("rid", "name")
    long_docs = heads.filter(F.col("n") > 1).drop("name").join(long_names, "rid")
    ids = done.unionByName(long_docs).select("doc_id", "sha", "n", "name")
    groups = written(ids.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    return join_hot(ids, groups, ["n", "name"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
