"""Monthly credit-card balances, to one row for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_high, clip_low, flag_where, is_one_of, known_flag, latest, plain_flag, safe_ratio
from cairn.operators.features import Feature, aggregate, family, finish
from cairn.operators.temporal import require_history
from cairn.sources.tables import ID

SOURCE, HIGH, SEVERE_DAYS, PAYMENT_CAP = "credit_card", 0.8, 30, 5.0

FEATURES: tuple[Feature, ...] = (
    *family("volume", ("n_months", "size"), ("n_cards", "nunique", "SK_ID_PREV")),
    *family("recency", ("months_min", "min", "MONTHS_BALANCE"), ("months_max", "max", "MONTHS_BALANCE")),
    *family("balances", ("balance_mean", "mean", "AMT_BALANCE"), ("balance_max", "max", "AMT_BALANCE"), ("balance_std", "std", "AMT_BALANCE"), ("balance_latest_mean", "mean", "card_balance_latest")),
    *family("limits", ("limit_mean", "mean", "AMT_CREDIT_LIMIT_ACTUAL"), ("limit_max", "max", "AMT_CREDIT_LIMIT_ACTUAL")),
    *family("utilization", ("utilization_mean", "mean", "utilization"), ("utilization_max", "max", "utilization"), ("high_utilization_rate", "mean", "high_util"), ("over_limit_rate", "mean", "over_limit"), ("utilization_latest_mean", "mean", "card_utilization_latest")),
    *family("delinquency", ("dpd_mean", "mean", "SK_DPD"), ("dpd_max", "max", "SK_DPD"), ("dpd_positive_rate", "mean", "dpd_pos"), ("severe_dpd_rate", "mean", "dpd_severe"), ("dpd_def_max", "max", "SK_DPD_DEF")),
    *family(
        "drawings", ("drawings_sum", "sum", "AMT_DRAWINGS_CURRENT"), ("drawings_mean", "mean", "AMT_DRAWINGS_CURRENT"), ("atm_drawings_sum", "sum", "AMT_DRAWINGS_ATM_CURRENT"), ("pos_drawings_sum", "sum", "AMT_DRAWINGS_POS_CURRENT"),
        ("atm_drawing_month_rate", "mean", "atm_month"), ("drawings_count_sum", "sum", "CNT_DRAWINGS_CURRENT"),
    ),
    *family("payments", ("payment_mean", "mean", "AMT_PAYMENT_TOTAL_CURRENT"), ("min_payment_mean", "mean", "AMT_INST_MIN_REGULARITY"), ("payment_to_min_ratio_mean", "mean", "payment_to_min"), ("missed_min_payment_rate", "mean", "missed_min")),
    *family("status", ("active_month_share", "mean", "active"), ("completed_cards", "sum", "card_completed"), ("mature_installments_max", "max", "CNT_INSTALMENT_MATURE_CUM")),
)
PER_CARD = ("card_balance_latest", "card_utilization_latest", "card_completed")


def derive(months: DataFrame) -> DataFrame:
    use = safe_ratio(clip_low(F.col("AMT_BALANCE")), F.col("AMT_CREDIT_LIMIT_ACTUAL"))
    due, paid = F.col("AMT_INST_MIN_REGULARITY"), F.col("AMT_PAYMENT_TOTAL_CURRENT")
    return months.withColumns({
        "utilization": use, "high_util": known_flag(use > HIGH), "over_limit": known_flag(use > 1.0), "dpd_pos": plain_flag(F.col("SK_DPD") > 0), "dpd_severe": plain_flag(F.col("SK_DPD") > SEVERE_DAYS),
        "atm_month": known_flag(F.col("CNT_DRAWINGS_ATM_CURRENT") > 0), "payment_to_min": clip_high(safe_ratio(paid, due), PAYMENT_CAP), "missed_min": flag_where(due > 0, paid < due),
        "active": is_one_of(F.col("NAME_CONTRACT_STATUS"), "Active"), "completed": is_one_of(F.col("NAME_CONTRACT_STATUS"), "Completed"),
    })


def card_level(rows: DataFrame) -> DataFrame:
    """Per card: its customer, the balance and use of its latest month, null or not, and whether it was ever completed."""
    order = F.col("MONTHS_BALANCE")
    cards = rows.where(F.col("SK_ID_PREV").isNotNull()).groupBy("SK_ID_PREV").agg(
        latest(F.col(ID), order).alias(ID), latest(F.col("AMT_BALANCE"), order).alias("card_balance_latest"), latest(F.col("utilization"), order).alias("card_utilization_latest"),
    )
    return cards


def build(months: DataFrame) -> DataFrame:
    """Monthly features in one aggregation; per-card ones by way of cards, as cards weigh alike whatever their months."""
    rows = derive(require_history(months, "MONTHS_BALANCE"))
    monthly = aggregate(rows, tuple(f for f in FEATURES if f.column not in PER_CARD))
    latest_means = aggregate(card_level(rows), tuple(f for f in FEATURES if f.column in PER_CARD[:2]))
    done = rows.groupBy(ID, "SK_ID_PREV").agg(F.max("completed").alias("card_completed")).where(F.col("SK_ID_PREV").isNotNull())
    completed = aggregate(done, tuple(f for f in FEATURES if f.column == "card_completed"))
    return finish(monthly.join(latest_means, ID, "left").join(completed, ID, "left"), SOURCE, FEATURES)
