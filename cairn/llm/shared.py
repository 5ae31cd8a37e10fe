"""Folders that every executor sees, written tables that cut lineage, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs locally."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("cairn.shared.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("cairn.shared.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_SETTLED: ContextVar[list[DataFrame] | None] = ContextVar("settled", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``settle`` writes in this context are deleted at its end, but for those that are taken out of the list."""
    outer = _SETTLED.set(made := [])
    try:
        yield made
    finally:
        _SETTLED.reset(outer)
        discard(*made)


def settle(df: DataFrame, name: str, distinct: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and lost executors cost nothing.

    ``distinct`` says that its values hardly repeat, so that no dictionary of them is tried.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("parquet.enable.dictionary", str(not distinct).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    if (made := _SETTLED.get()) is not None:
        made.append(out)
    return out


def discard(*settled: DataFrame) -> None:
    """Delete tables that ``settle`` wrote and that nothing will read again."""
    for df in settled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key with more than one in ``CROWD`` of all rows is a crowd, so there are fewer than ``CROWD`` of them at any size.
CROWD = 500


def join_per_key(rows: DataFrame, per: DataFrame, on: str, total: int, spread: Column) -> DataFrame:
    """``rows`` joined with ``per``, which has one row a key and says in ``n`` how many of ``total`` rows hold it.

    What is known of crowds is broadcast to their rows. These then take ``spread`` (of the key's type, with many values
    within a crowd) for a key in the shuffle of the join, which finds them nothing that counts; so no task gets all of a crowd.
    """
    known = F.struct(*[c for c in per.columns if c not in (on, "n")])
    crowds = F.broadcast(per.where(F.col("n") * CROWD > total).select(on, known.alias("_crowd")))
    dealt = rows.join(crowds, on, "left").withColumn("_dealt", F.when(F.col("_crowd").isNull(), F.col(on)).otherwise(spread))
    joined = dealt.join(per.select(F.col(on).alias("_dealt"), known.alias("_known")), "_dealt", "left")
    found = joined.withColumn("_found", F.coalesce("_crowd", "_known")).where("_found IS NOT NULL")
    return found.select(*rows.columns, "_found.*")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores before them, as many as it takes for none to be a column of ``df`` (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_draw(text: Column, digits: int = 8) -> Column:
    """The first hex digits of MD5 as a number: a uniform draw that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
