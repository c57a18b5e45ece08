"""Written intermediate tables, in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts to which the rows of one key are dealt where a key may have very many.
PARTS = 8


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, but only on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = own.get() if own.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no temporary folder")
        base = "file://" + tempfile.mkdtemp(prefix="concordat-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def partitions(df: DataFrame, size: int = 16 << 20) -> int:
    """Partitions for an exchange of ``df``: as set, and more where it has more than ``size`` bytes for each.

    Spark's estimate is used; where it has none (a plan of joins may have an absurd one), the setting holds.
    """
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, held // size) if held < 1 << 60 else own


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: met by a shuffle, whatever size its files have.

    A side that Spark broadcasts passes through the driver, and one of small files may be large as rows.
    """
    return side.hint("merge")


def spread(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (few rows a key) on ``key``, of which one value may be in most rows.

    The rows of a value are dealt to ``PARTS`` parts by column ``by``, and what ``side`` has of it stands in
    each part.  Only rows of ``side`` that are wanted are copied; what is wanted is counted on the map side.
    """
    wanted = rows.select(key).distinct()
    held = side.join(shuffled(wanted), key, "left_semi").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    return dealt.join(shuffled(held), [key, "_part"], how).drop("_part")


class Workspace:
    """Tables below the shared folder, deleted when the driver's process ends, as results still read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_delete, files, where)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read again: later steps start from the files, whatever executors are lost."""
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete(files, where) -> None:
    with contextlib.suppress(Exception):  # the session and its JVM may have ended before
        files.delete(where, True)
