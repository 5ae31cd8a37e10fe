"""External credits and their monthly statuses, to one row for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_low, is_one_of, keep_where, known_flag, level_map, plain_flag, safe_ratio, value_if
from cairn.operators.features import Feature, family, finish, require_unique, with_ratios
from cairn.operators.temporal import mask_snapshots, only_history
from cairn.sources.tables import ID

SOURCE, RECENT_DAYS, RECENT_MONTHS, SEVERE = "bureau", 365, 12, 3
# Severity of a monthly status, and groups of credit types.
SEVERITY = {"C": 0, "X": 0, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5}
TYPES = {"Consumer credit": "consumer", "Credit card": "credit_card", "Car loan": "car_loan", "Mortgage": "mortgage", "Microloan": "microloan"}
GROUPS = (*TYPES.values(), "other")

FEATURES: tuple[Feature, ...] = (
    *family("counts", ("credit_count", "size"), ("active_count", "sum", "is_active"), ("closed_count", "sum", "is_closed"), ("sold_or_bad_count", "sum", "is_sold_or_bad"), ("active_ratio", "mean", "is_active"), ("n_credit_types", "nunique", "CREDIT_TYPE")),
    *family("credit types", ("consumer_count", "sum", "type_consumer"), ("credit_card_count", "sum", "type_credit_card"), ("car_loan_count", "sum", "type_car_loan"), ("mortgage_count", "sum", "type_mortgage"), ("microloan_count", "sum", "type_microloan"), ("other_type_count", "sum", "type_other")),
    *family("recency", ("credits_last_year", "sum", "recent_credit")),
    *family(
        "amounts", ("credit_sum_total", "sum", "AMT_CREDIT_SUM"), ("credit_sum_mean", "mean", "AMT_CREDIT_SUM"), ("credit_sum_max", "max", "AMT_CREDIT_SUM"), ("debt_sum_total", "sum", "debt"), ("debt_sum_mean", "mean", "debt"), ("debt_sum_max", "max", "debt"),
        ("active_debt_sum", "sum", "active_debt"), ("limit_sum", "sum", "limit"), ("annuity_sum", "sum", "AMT_ANNUITY"),
    ),
    *family(
        "delinquency", ("overdue_sum_total", "sum", "AMT_CREDIT_SUM_OVERDUE"), ("overdue_sum_max", "max", "AMT_CREDIT_SUM_OVERDUE"), ("max_overdue_max", "max", "AMT_CREDIT_MAX_OVERDUE"), ("max_overdue_mean", "mean", "AMT_CREDIT_MAX_OVERDUE"),
        ("day_overdue_max", "max", "CREDIT_DAY_OVERDUE"), ("day_overdue_mean", "mean", "CREDIT_DAY_OVERDUE"), ("overdue_credit_count", "sum", "overdue_credit"), ("prolong_sum", "sum", "CNT_CREDIT_PROLONG"),
    ),
    *family("ratios", ("debt_to_credit_ratio", "ratio", "debt_sum_total", "credit_sum_total"), ("overdue_to_debt_ratio", "ratio", "overdue_sum_total", "debt_sum_total")),
    *family(
        "recency", ("days_credit_max", "max", "DAYS_CREDIT"), ("days_credit_min", "min", "DAYS_CREDIT"), ("days_credit_mean", "mean", "DAYS_CREDIT"), ("days_update_max", "max", "DAYS_CREDIT_UPDATE"), ("enddate_remaining_max", "max", "active_enddate"),
        ("days_enddate_fact_max", "max", "DAYS_ENDDATE_FACT"),
    ),
    *family(
        "monthly history", ("bb_credits_with_history", "sum", "bb_has_history"), ("bb_months_sum", "sum", "bb_months"), ("bb_history_max", "max", "bb_history_len"), ("bb_dpd_months_sum", "sum", "bb_dpd_months"), ("bb_dpd_share_mean", "mean", "bb_dpd_share"),
        ("bb_status_max", "max", "bb_status_max"), ("bb_severe_credits", "sum", "bb_severe"), ("bb_latest_dpd_credits", "sum", "bb_latest_dpd"), ("bb_recent_dpd_credits", "sum", "bb_recent_dpd"), ("bb_closed_share_mean", "mean", "bb_closed_share"),
    ),
)
#: Features that say nothing for a customer none of whose snapshots is admissible.
SNAPSHOT = frozenset(
    "active_count closed_count sold_or_bad_count active_ratio credit_sum_total credit_sum_mean credit_sum_max debt_sum_total debt_sum_mean debt_sum_max active_debt_sum limit_sum annuity_sum "
    "overdue_sum_total overdue_sum_max max_overdue_max max_overdue_mean day_overdue_max day_overdue_mean overdue_credit_count prolong_sum days_update_max enddate_remaining_max days_enddate_fact_max".split()
)
BALANCE_TYPES = {"bb_months": "long", "bb_known_months": "long", "bb_dpd_months": "long", "bb_status_max": "int", "bb_closed_months": "long", "bb_oldest_month": "int", "bb_recent_dpd": "int", "bb_latest_dpd": "int", "bb_dpd_share": "double", "bb_closed_share": "double", "bb_history_len": "int", "bb_severe": "int"}


def summarize_balance(balance: DataFrame) -> DataFrame:
    """Per credit: months seen, known, overdue and closed, worst and latest severity. Unknown statuses are severity 0, and a missing one counts as known."""
    rows = only_history(balance, "MONTHS_BALANCE").where(F.col("SK_ID_BUREAU").isNotNull())
    rows = rows.select("SK_ID_BUREAU", F.col("MONTHS_BALANCE").cast("int").alias("month"), "STATUS", level_map(F.col("STATUS"), SEVERITY, 0).alias("severity"))
    late, known = F.col("severity") > 0, 1 - is_one_of(F.col("STATUS"), "X")
    per_credit = rows.groupBy("SK_ID_BUREAU").agg(
        F.count("*").alias("bb_months"), F.sum(known).alias("bb_known_months"), F.sum(late.cast("int")).alias("bb_dpd_months"), F.max("severity").alias("bb_status_max"), F.sum(is_one_of(F.col("STATUS"), "C")).alias("bb_closed_months"),
        F.min("month").alias("bb_oldest_month"), F.max((late & (F.col("month") >= -RECENT_MONTHS)).cast("int")).alias("bb_recent_dpd"), (F.max_by("severity", F.struct("month", "severity")) > 0).cast("int").alias("bb_latest_dpd"),
    )
    return per_credit.withColumns({
        "bb_dpd_share": safe_ratio(F.col("bb_dpd_months"), F.col("bb_known_months")), "bb_closed_share": safe_ratio(F.col("bb_closed_months"), F.col("bb_months")),
        "bb_history_len": 1 - F.col("bb_oldest_month"), "bb_severe": (F.col("bb_status_max") >= SEVERE).cast("int"),
    })


def derive(bureau: DataFrame) -> DataFrame:
    """Row-level columns of admissible credits."""
    active, group = F.col("CREDIT_ACTIVE"), level_map(F.col("CREDIT_TYPE"), TYPES, "other")
    rows = bureau.withColumns({
        "debt": clip_low(F.col("AMT_CREDIT_SUM_DEBT")), "limit": clip_low(F.col("AMT_CREDIT_SUM_LIMIT")), "is_active": known_flag(active == "Active"), "is_closed": known_flag(active == "Closed"),
        "is_sold_or_bad": known_flag(active.isin("Sold", "Bad debt")), "recent_credit": plain_flag(F.col("DAYS_CREDIT") >= -RECENT_DAYS), "overdue_credit": known_flag(F.col("CREDIT_DAY_OVERDUE") > 0),
        **{f"type_{g}": (group == g).cast("int") for g in GROUPS},
    })
    return rows.withColumns({"active_debt": value_if(F.col("is_active"), F.col("debt")), "active_enddate": keep_where(F.col("is_active") == 1, F.col("DAYS_CREDIT_ENDDATE"))})


def attach_balance(bureau: DataFrame, balance: DataFrame | None) -> DataFrame:
    if balance is None:
        joined = bureau.withColumns({c: F.lit(None).cast(t) for c, t in BALANCE_TYPES.items()})
    else:
        joined = bureau.join(summarize_balance(balance), "SK_ID_BUREAU", "left")
    return joined.withColumn("bb_has_history", F.col("bb_months").isNotNull().cast("int"))


def build(bureau: DataFrame, balance: DataFrame | None = None) -> DataFrame:
    require_unique(bureau, "SK_ID_BUREAU")
    rows = attach_balance(derive(mask_snapshots(only_history(bureau, "DAYS_CREDIT"))), balance)
    rows = rows.where(F.col(ID).isNotNull())
    table = rows.groupBy(ID).agg(F.count("DAYS_CREDIT_UPDATE").alias("_snapshots"), *[f.aggregate() for f in FEATURES if f.stat != "ratio"])
    table = table.withColumns({c: F.when(F.col("_snapshots") > 0, F.col(c)) for c in sorted(SNAPSHOT)}).drop("_snapshots")
    return finish(with_ratios(table, FEATURES), SOURCE, FEATURES)
