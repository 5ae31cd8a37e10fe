"""Monthly point-of-sale and cash loan balances, to one row for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import is_one_of, keep_where, plain_flag, safe_ratio
from cairn.operators.features import Feature, aggregate, family, finish
from cairn.operators.temporal import require_history
from cairn.sources.tables import ID

SOURCE, SEVERE_DAYS, RECENT_MONTHS = "pos", 30, 12

FEATURES: tuple[Feature, ...] = (
    *family("volume", ("n_months", "size"), ("n_contracts", "nunique", "SK_ID_PREV")),
    *family("recency", ("months_min", "min", "MONTHS_BALANCE"), ("months_max", "max", "MONTHS_BALANCE")),
    *family(
        "terms", ("cnt_instalment_mean", "mean", "CNT_INSTALMENT"), ("cnt_instalment_max", "max", "CNT_INSTALMENT"), ("instalments_future_mean", "mean", "CNT_INSTALMENT_FUTURE"), ("instalments_future_max", "max", "CNT_INSTALMENT_FUTURE"),
        ("remaining_share_mean", "mean", "remaining_share"),
    ),
    *family(
        "delinquency", ("dpd_mean", "mean", "SK_DPD"), ("dpd_max", "max", "SK_DPD"), ("dpd_positive_rate", "mean", "dpd_pos"), ("severe_dpd_rate", "mean", "dpd_severe"), ("dpd_def_max", "max", "SK_DPD_DEF"), ("dpd_def_positive_rate", "mean", "dpd_def_pos"),
        ("recent_dpd_rate", "mean", "recent_dpd"),
    ),
    *family("status", ("active_month_share", "mean", "active"), ("completed_month_share", "mean", "completed"), ("completed_contracts", "sum", "contract_completed")),
)


def derive(months: DataFrame) -> DataFrame:
    late = plain_flag(F.col("SK_DPD") > 0)
    return months.withColumns({
        "dpd_pos": late, "dpd_severe": plain_flag(F.col("SK_DPD") > SEVERE_DAYS), "dpd_def_pos": plain_flag(F.col("SK_DPD_DEF") > 0), "recent_dpd": keep_where(F.col("MONTHS_BALANCE") >= -RECENT_MONTHS, late),
        "remaining_share": safe_ratio(F.col("CNT_INSTALMENT_FUTURE"), F.col("CNT_INSTALMENT")), "active": is_one_of(F.col("NAME_CONTRACT_STATUS"), "Active"), "completed": is_one_of(F.col("NAME_CONTRACT_STATUS"), "Completed"),
    })


def build(months: DataFrame) -> DataFrame:
    rows = derive(require_history(months, "MONTHS_BALANCE"))
    monthly = aggregate(rows, tuple(f for f in FEATURES if f.column != "contract_completed"))
    done = rows.groupBy(ID, "SK_ID_PREV").agg(F.max("completed").alias("contract_completed")).where(F.col("SK_ID_PREV").isNotNull())
    completed = aggregate(done, tuple(f for f in FEATURES if f.column == "contract_completed"))
    return finish(monthly.join(completed, ID, "left"), SOURCE, FEATURES)
