"""What the training-data operators share: the shared folder, written tables, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the operators' contracts: blank and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldlake-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldlake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file of bounded size into the shared folder through Hadoop's file API; its path."""
    path = new_path(spark, name)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Keys of over 1 / HOT_KEYS of all rows are hot; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1024


def join_hot(rows: DataFrame, known: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` joined with the written table ``known`` by ``keys``; its column ``size`` counts the rows of each key.

    Hot keys of ``known``, a bounded number, are broadcast, so that none lands in one task; the
    others are sorted and merged.
    """
    total = known.agg(F.sum(size)).first()[0] or 0
    mark = F.xxhash64(*keys)
    marks = [r[0] for r in known.filter(F.col(size) * HOT_KEYS > total).select(mark).collect()]
    if not marks:
        return rows.join(known.hint("merge"), keys)
    hot = mark.isin(marks)
    cold = rows.filter(~hot).join(known.filter(~hot).hint("merge"), keys)
    return rows.filter(hot).join(F.broadcast(known.filter(hot)), keys).unionByName(cold)
