"""Helpers shared by the corpus operators.

Conventions: an operator selects the columns it needs by name, so extra columns never disturb it; columns of its own that
must travel beside the caller's are prefixed with ``__tm_``. A null text is an empty text. Rows are documents: two rows with
one ``doc_id`` are two documents unless an operator says otherwise.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that separate words and that are stripped from line ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset (tests on one machine), a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_step(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """As ``materialise``, with the path, so that the caller can ``discard`` the table when nothing reads it any more."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate tables that no later step reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Keys that hold more than one row in this many are hot, so there are never more hot keys than that.
HOT_KEYS = 10_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", hot: int = HOT_KEYS) -> DataFrame:
    """rows joined with a table of unique, non-null keys whose column ``n`` says how many rows each key has; total: all rows.

    Hot keys, at most ``hot``, are broadcast, so their rows stay where they are; the others meet by a shuffle in
    which no key has more than one row in ``hot``. Columns of ``table`` but the keys and ``n`` are added (none for left_semi).
    """
    least = max(total // hot, 1)
    there = rows.join(F.broadcast(table.filter(F.col(n) > least).drop(n)), keys, "left_semi" if how == "left_semi" else "inner")
    cold = rows.join(F.broadcast(table.filter(F.col(n) > least).select(*keys)), keys, "left_anti")
    return there.unionByName(cold.join(table.filter(F.col(n) <= least).drop(n), keys, how))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words(col: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``, in order."""
    return F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def salted_id(*cols: str) -> Column:
    """A 64-bit content key of a row."""
    return F.xxhash64(*[F.col(c) for c in cols])
