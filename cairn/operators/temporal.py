"""What was known at application time. Offsets count from the application; 0 and below is history.

Three rules: *require* raises on any row from the future (missing anchors pass), *filter* drops rows whose anchor is
not in the past or is missing, and *mask* keeps a bureau row but blanks what a later snapshot says about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import plain_flag

POLICY = "application-time-v2"
#: Facts of a bureau credit's origination, which outlive an inadmissible snapshot.
ORIGINATION = ("SK_ID_CURR", "SK_ID_BUREAU", "DAYS_CREDIT", "CREDIT_TYPE")


def reject_target(df: DataFrame, target: str = "TARGET") -> None:
    if target in df.columns:
        raise ValueError(f"{target} must not reach feature builders")


def violations(df: DataFrame, *anchors: str) -> DataFrame:
    """One row: how many rows each anchor puts after the application."""
    return df.agg(*[F.sum(plain_flag(F.col(a) > 0)).cast("long").alias(a) for a in anchors])


def require_history(df: DataFrame, *anchors: str) -> DataFrame:
    """The frame itself, with a check inside its plan: a task that meets a future row fails the job."""
    reject_target(df)
    future = plain_flag(F.greatest(*[F.col(a) for a in anchors], F.lit(None).cast("double")) > 0) == 1
    message = F.lit(f"offsets after the application in {', '.join(anchors)}")
    first = df.columns[0]
    return df.withColumn(first, F.when(future, F.raise_error(message).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def only_history(df: DataFrame, anchor: str) -> DataFrame:
    reject_target(df)
    return df.where(F.col(anchor) <= 0)


def unsafe_snapshot() -> Column:
    """A snapshot dated after the application, or not at all, or one that knows a later closing."""
    return ~F.coalesce(F.col("DAYS_CREDIT_UPDATE") <= 0, F.lit(False)) | F.coalesce(F.col("DAYS_ENDDATE_FACT") > 0, F.lit(False))


def mask_snapshots(bureau: DataFrame) -> DataFrame:
    unsafe = unsafe_snapshot()
    return bureau.select(*[F.col(c) if c in ORIGINATION else F.when(~unsafe, F.col(c)).alias(c) for c in bureau.columns])
