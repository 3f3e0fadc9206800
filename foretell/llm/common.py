"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that ``spark.checkpoint.dir`` names.

    Every executor can read that folder, so a lost executor costs no
    recomputation.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where driver and executors are one machine's (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later work begins there. The caller's cluster clears the folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Keys that hold one part in this many of all rows are joined by broadcast, so at most so many keys are.
HOT_PARTS = 1000


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each of ``keys`` and ``n``, how many of ``rows`` have it.

    ``total`` is a bound on the number of rows. Heavy keys are few, HOT_PARTS
    at most if they hold that part of all rows each; they are broadcast, so
    their rows stay where they are. All others are joined by shuffle.
    """
    heavy = F.col("n") * HOT_PARTS >= total
    values = [c for c in table.columns if c not in (*keys, "n")]
    hot = table.where(heavy).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("__hot IS NULL").select(*rows.columns).join(table.where(~heavy).drop("n"), keys)
    return marked.where("__hot").select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in values]).unionByName(cold)


def word_array(text: Column) -> Column:
    """The words of a text, repeats included; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def slices(batch, column: str, limit: int = 4 << 20, line_bytes: int = 0):
    """An Arrow batch in pieces of about ``limit`` bytes of ``column``, a line end counting ``line_bytes`` more (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if line_bytes:
        sizes = sizes + line_bytes * pc.fill_null(pc.count_substring(batch.column(column), "\n"), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)
