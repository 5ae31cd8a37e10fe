"""Audits of the raw history tables: grain, ranges, levels, profiles and anomalies, each as a table of few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_low, plain_flag, safe_ratio
from cairn.operators.quality import duplicate_rows, profile, value_counts
from cairn.sources.tables import ID


def grain(df: DataFrame, keys: list[str], **distinct: str) -> DataFrame:
    """One row: rows, distinct values of named columns, and rows that repeat a key."""
    one = F.lit(1).alias("_one")
    counts = df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()]).select("*", one)
    return counts.join(duplicate_rows(df, keys).select("duplicates", one), "_one").drop("_one")


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, min, max, n_positive."""
    wide = df.agg(*[f for c in columns for f in (F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi"), F.sum(plain_flag(F.col(c) > 0)).alias(f"{c}_pos"))])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").alias("min"), F.col(f"{c}_hi").alias("max"), F.col(f"{c}_pos").alias("n_positive")) for c in columns])))


def levels(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """column, value, n: the most frequent values of each column, missing being one."""
    out = None
    for c, k in columns.items():
        part = value_counts(df, c, k).select(F.lit(c).alias("column"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def shares(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of shares over all rows; where a condition is unknown it does not hold."""
    return df.agg(*[F.avg(plain_flag(c)).alias(n) for n, c in conditions.items()])


def counts(df: DataFrame, **conditions: Column) -> DataFrame:
    return df.agg(*[F.sum(plain_flag(c)).cast("long").alias(n) for n, c in conditions.items()])


def audit_bureau(bureau: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    return {
        "grain": grain(bureau, ["SK_ID_BUREAU"], customers=ID), "ranges": ranges(bureau, ["DAYS_CREDIT", "DAYS_CREDIT_UPDATE", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT"]), "levels": levels(bureau, {"CREDIT_ACTIVE": 12, "CREDIT_TYPE": 15}),
        "profile": profile(bureau, ["AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_LIMIT", "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "AMT_ANNUITY"]),
        "anomalies": counts(
            bureau, debt_over_credit=c("AMT_CREDIT_SUM_DEBT") > c("AMT_CREDIT_SUM"), negative_debt=c("AMT_CREDIT_SUM_DEBT") < 0, negative_limit=c("AMT_CREDIT_SUM_LIMIT") < 0, future_update=c("DAYS_CREDIT_UPDATE") > 0,
            active_past_end=(c("CREDIT_ACTIVE") == "Active") & (c("DAYS_CREDIT_ENDDATE") < 0),
        ),
    }


def audit_balance(balance: DataFrame, bureau: DataFrame | None = None) -> dict[str, DataFrame]:
    out = {"grain": grain(balance, ["SK_ID_BUREAU", "MONTHS_BALANCE"], credits="SK_ID_BUREAU"), "ranges": ranges(balance, ["MONTHS_BALANCE"]), "levels": levels(balance, {"STATUS": 12})}
    if bureau is not None:
        out["matched"] = matched_credits(bureau, balance)
    return out


def matched_credits(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Credits that have monthly rows: a semi join and a count."""
    return bureau.join(balance, "SK_ID_BUREAU", "left_semi").agg(F.count_distinct("SK_ID_BUREAU").alias("credits_matched"))


def audit_previous(previous: DataFrame) -> dict[str, DataFrame]:
    c, late = F.col, [x for x in ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION") if x in previous.columns]
    out = {
        "grain": grain(previous, ["SK_ID_PREV"], customers=ID), "ranges": ranges(previous, ["DAYS_DECISION"]), "levels": levels(previous, {"NAME_CONTRACT_STATUS": 12, "CODE_REJECT_REASON": 12, "NAME_CONTRACT_TYPE": 12}),
        "profile": profile(previous, ["AMT_APPLICATION", "AMT_CREDIT", "AMT_ANNUITY", "AMT_DOWN_PAYMENT", "CNT_PAYMENT"]),
        "anomalies": counts(previous, zero_application=c("AMT_APPLICATION") == 0, approved_without_credit=(c("NAME_CONTRACT_STATUS") == "Approved") & (c("AMT_CREDIT") == 0), negative_down_payment=c("AMT_DOWN_PAYMENT") < 0),
    }
    if late:
        real = lambda x: c(x) != 365243
        wide = previous.agg(*[f for x in late for f in (F.sum(c(x).isNull().cast("long")).alias(f"{x}_m"), F.sum(plain_flag(c(x) == 365243)).alias(f"{x}_s"), F.sum(plain_flag(real(x) & (c(x) > 0))).alias(f"{x}_p"), F.min(F.when(real(x), c(x))).cast("double").alias(f"{x}_lo"))])
        out["excluded"] = wide.select(F.inline(F.array(*[F.struct(F.lit(x).alias("column"), c(f"{x}_m").alias("n_missing"), c(f"{x}_s").alias("n_sentinel"), c(f"{x}_p").alias("n_positive"), c(f"{x}_lo").alias("min")) for x in late])))
    return out


def audit_installments(rows: DataFrame) -> dict[str, DataFrame]:
    c, late = F.col, F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    ratio = safe_ratio(c("AMT_PAYMENT"), c("AMT_INSTALMENT"))
    derived = rows.withColumns({"days_late": late, "ratio": ratio})
    return {
        "grain": grain(rows, ["SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION"], customers=ID, contracts="SK_ID_PREV"), "ranges": ranges(rows, ["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"]), "profile": profile(rows, ["AMT_INSTALMENT", "AMT_PAYMENT"]),
        "lateness": derived.agg(F.avg("days_late").alias("mean"), F.percentile("days_late", F.lit(0.5)).alias("median"), F.avg(plain_flag(c("days_late") > 0)).alias("share_late"), F.avg(plain_flag(c("days_late") > 30)).alias("share_severe"), F.max("days_late").alias("max")),
        "ratio": derived.agg(F.percentile("ratio", F.lit(0.5)).alias("median"), F.avg(plain_flag(c("ratio") < 0.99)).alias("share_under"), F.avg(plain_flag(c("ratio") > 1.01)).alias("share_over"), F.sum(plain_flag(c("AMT_INSTALMENT") == 0)).alias("zero_scheduled")),
        "anomalies": counts(rows, missing_date=c("DAYS_ENTRY_PAYMENT").isNull(), missing_amount=c("AMT_PAYMENT").isNull(), negative_amount=c("AMT_PAYMENT") < 0),
    }


def audit_credit_card(months: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    derived = months.withColumn("use", safe_ratio(clip_low(c("AMT_BALANCE")), c("AMT_CREDIT_LIMIT_ACTUAL")))
    return {
        "grain": grain(months, ["SK_ID_PREV", "MONTHS_BALANCE"], customers=ID, cards="SK_ID_PREV"), "ranges": ranges(months, ["MONTHS_BALANCE"]), "levels": levels(months, {"NAME_CONTRACT_STATUS": 12}),
        "profile": profile(months, ["AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY", "SK_DPD"]),
        "utilization": derived.agg(F.sum(plain_flag(c("AMT_CREDIT_LIMIT_ACTUAL") == 0)).alias("zero_limit"), F.percentile("use", F.lit(0.5)).alias("median"), F.percentile("use", F.lit(0.99)).alias("q99"), F.avg(plain_flag(c("use") > 1)).alias("share_over"), F.max("use").alias("max")),
        "shares": shares(months, negative_balance=c("AMT_BALANCE") < 0, late=c("SK_DPD") > 0, severe=c("SK_DPD") > 30),
    }


def audit_pos(months: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    return {
        "grain": grain(months, ["SK_ID_PREV", "MONTHS_BALANCE"], customers=ID, contracts="SK_ID_PREV"), "ranges": ranges(months, ["MONTHS_BALANCE"]), "levels": levels(months, {"NAME_CONTRACT_STATUS": 12}),
        "profile": profile(months, ["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE", "SK_DPD", "SK_DPD_DEF"]), "shares": shares(months, future_over_term=c("CNT_INSTALMENT_FUTURE") > c("CNT_INSTALMENT"), late=c("SK_DPD") > 0, severe=c("SK_DPD") > 30),
    }
