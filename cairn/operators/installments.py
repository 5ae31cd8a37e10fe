"""Installment payments: parts of a payment to installments, installments to one row for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_high, flag_where, keep_where, plain_flag, safe_ratio, sum_or_zero
from cairn.operators.features import Feature, aggregate, family, finish, with_ratios
from cairn.operators.temporal import require_history
from cairn.sources.tables import ID

SOURCE, TOLERANCE, SEVERE_DAYS, RECENT_DAYS, RATIO_CAP = "installments", 1.0, 30, 365, 2.0
KEY = ("SK_ID_PREV", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER")

FEATURES: tuple[Feature, ...] = (
    *family("volume", ("n_installments", "size"), ("n_contracts", "nunique", "SK_ID_PREV"), ("n_split_payments", "sum", "is_split")),
    *family("recency", ("days_since_last_instalment", "max", "days_instalment"), ("history_span_days", "min", "days_instalment")),
    *family(
        "timeliness", ("late_count", "sum", "is_late"), ("late_rate", "mean", "is_late"), ("severe_late_rate", "mean", "is_severe_late"), ("days_late_mean", "mean", "days_late"), ("days_late_max", "max", "days_late"), ("days_late_min", "min", "days_late"),
        ("days_late_std", "std", "days_late"), ("late_days_when_late_mean", "mean", "late_days_when_late"),
    ),
    *family(
        "completeness", ("unpaid_rate", "mean", "is_unpaid"), ("payment_ratio_mean", "mean", "payment_ratio"), ("payment_ratio_std", "std", "payment_ratio"), ("underpaid_rate", "mean", "is_underpaid"), ("overpaid_rate", "mean", "is_overpaid"),
        ("scheduled_sum", "sum", "scheduled"), ("paid_sum", "sum", "paid"), ("payment_gap_sum", "sum", "gap"), ("paid_share", "ratio", "paid_sum", "scheduled_sum"),
    ),
    *family("recent", ("n_installments_12m", "sum", "is_recent"), ("late_rate_12m", "mean", "is_late_recent"), ("underpaid_rate_12m", "mean", "is_underpaid_recent")),
)


def installment_level(rows: DataFrame) -> DataFrame:
    """One row for each installment: the schedule once, the payments summed, the last payment's day. Rows without a whole key vanish."""
    whole = require_history(rows, "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT")
    for k in KEY:
        whole = whole.where(F.col(k).isNotNull())
    level = whole.groupBy(*KEY).agg(
        F.min(ID).alias(ID), F.max("AMT_INSTALMENT").cast("double").alias("scheduled"), sum_or_zero(F.col("AMT_PAYMENT")).cast("double").alias("paid"), F.max("DAYS_INSTALMENT").alias("days_instalment"), F.max("DAYS_ENTRY_PAYMENT").alias("days_entry"), F.count("*").alias("n_parts"),
    )
    paid, late = F.col("days_entry").isNotNull(), F.col("days_entry") - F.col("days_instalment")
    level = level.withColumns({
        "days_late": late, "is_late": flag_where(paid, late > 0), "is_severe_late": flag_where(paid, late > SEVERE_DAYS), "late_days_when_late": keep_where(late > 0, late),
        "payment_ratio": clip_high(safe_ratio(F.col("paid"), F.col("scheduled")), RATIO_CAP), "is_underpaid": plain_flag(F.col("paid") < F.col("scheduled") - TOLERANCE), "is_overpaid": plain_flag(F.col("paid") > F.col("scheduled") + TOLERANCE),
        "is_unpaid": (~paid).cast("int"), "is_split": (F.col("n_parts") > 1).cast("int"), "gap": F.col("scheduled") - F.col("paid"), "is_recent": plain_flag(F.col("days_instalment") >= -RECENT_DAYS),
    })
    recent = F.col("is_recent") == 1
    return level.withColumns({"is_late_recent": keep_where(recent, F.col("is_late")), "is_underpaid_recent": keep_where(recent, F.col("is_underpaid"))})


def build(rows: DataFrame) -> DataFrame:
    return finish(with_ratios(aggregate(installment_level(rows), FEATURES), FEATURES), SOURCE, FEATURES)
