"""Feature builders, temporal policy and assembly over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import clip_high, clip_low, flag_where, keep_where, known_flag, level_map, plain_flag, safe_ratio, value_if
from cairn.operators import assemble, bureau, credit_card, installments, pos, previous, temporal
from cairn.operators.features import Feature, aggregate
from cairn.plans.registry import query
from cairn.plans.views import ctes, view
from cairn.sources.tables import ID


def stat_sql(f: Feature) -> str:
    c = f.column
    return {
        "size": "count(*)", "sum": f"coalesce(sum({c}), 0)", "mean": f"avg({c})", "max": f"max({c})", "min": f"min({c})", "std": f"stddev_samp({c})", "nunique": f"count(DISTINCT {c})",
        "latest": f"arg_max_null({c}, ({f.by.split()[0]}, -{f.by.split()[-1]}))" if f.stat == "latest" else "",
    }[f.stat]


def features_sql(features: tuple[Feature, ...], source: str, rows: str, gate: str = "", gated: frozenset = frozenset(), extra: str = "") -> str:
    """SELECT of all features of a source from derived rows; a gate is a condition under which the gated ones are known."""
    plain = ", ".join(f"CAST({stat_sql(f)} AS DOUBLE) AS {f.name}" for f in features if f.stat != "ratio" and f.column not in EXTRA)
    known = ", ".join(f"CASE WHEN {gate} THEN {f.name} END AS {f.name}" if f.name in gated else f.name for f in features if f.stat != "ratio")
    out = ", ".join(f"CAST(CAST({f'CASE WHEN {f.by} > 0 THEN {f.column} / {f.by} END' if f.stat == 'ratio' else f.name} AS FLOAT) AS DOUBLE) AS {source}__{f.name}" for f in features)
    return f"SELECT SK_ID_CURR, {out} FROM (SELECT SK_ID_CURR, {known} FROM (SELECT SK_ID_CURR, {plain}{', count(DAYS_CREDIT_UPDATE) AS snapshots' if gate else ''} FROM {rows} WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR) a{extra}) b"


#: Columns that come from a level between rows and customers.
EXTRA = frozenset({"card_balance_latest", "card_utilization_latest", "card_completed", "contract_completed"})


def shown(table: DataFrame) -> DataFrame:
    return table.select(*[F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in table.dtypes])


PREVIOUS_ROWS = ", previous_rows AS (SELECT *, " + ", ".join(
    f"CASE WHEN {c} IN ({', '.join(repr(x) for x in levels)}) THEN 1 ELSE 0 END AS {name}" for name, c, levels in previous.LEVEL_FLAGS
) + ", CASE WHEN DAYS_DECISION >= -365 THEN 1 ELSE 0 END AS recent, CASE WHEN AMT_APPLICATION > 0 THEN AMT_APPLICATION END AS amt_application_pos, CASE WHEN AMT_APPLICATION > 0 THEN AMT_CREDIT / AMT_APPLICATION END AS credit_to_application, " + ", ".join(
    f"CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN {c} END AS {c.lower()}_approved" for c in ("AMT_CREDIT", "AMT_ANNUITY", "CNT_PAYMENT")
) + ", " + ", ".join(f"CASE WHEN NAME_CONTRACT_STATUS = 'Refused' AND CODE_REJECT_REASON IN ({', '.join(repr(x) for x in codes)}) THEN 1 ELSE 0 END AS {name}" for name, codes in previous.REJECT_FLAGS) + " FROM previous)"
PREVIOUS_SQL = f"WITH {ctes('previous')}{PREVIOUS_ROWS} {features_sql(previous.FEATURES, 'previous', 'previous_rows')}"

BALANCE_SUMMARY = """, months AS (SELECT SK_ID_BUREAU, MONTHS_BALANCE AS m, STATUS, CASE WHEN STATUS IN ('1', '2', '3', '4', '5') THEN CAST(STATUS AS INT) ELSE 0 END AS s FROM balance WHERE MONTHS_BALANCE <= 0),
summary AS (SELECT *, CASE WHEN bb_known_months > 0 THEN bb_dpd_months / bb_known_months END AS bb_dpd_share, bb_closed_months / bb_months AS bb_closed_share, 1 - bb_oldest_month AS bb_history_len, CASE WHEN bb_status_max >= 3 THEN 1 ELSE 0 END AS bb_severe
  FROM (SELECT SK_ID_BUREAU, count(*) AS bb_months, CAST(count(*) - count(*) FILTER (STATUS = 'X') AS BIGINT) AS bb_known_months, count(*) FILTER (s > 0) AS bb_dpd_months, max(s) AS bb_status_max, count(*) FILTER (STATUS = 'C') AS bb_closed_months,
    min(m) AS bb_oldest_month, max(CASE WHEN s > 0 AND m >= -12 THEN 1 ELSE 0 END) AS bb_recent_dpd, CASE WHEN arg_max(s, (m, s)) > 0 THEN 1 ELSE 0 END AS bb_latest_dpd FROM months GROUP BY SK_ID_BUREAU))"""
MASKED = ", ".join(
    f"CASE WHEN safe THEN {c} END AS {c}" for c in "CREDIT_ACTIVE DAYS_CREDIT_UPDATE DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT CREDIT_DAY_OVERDUE AMT_CREDIT_MAX_OVERDUE CNT_CREDIT_PROLONG AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE AMT_ANNUITY".split()
)
MASK_ROWS = f", masked AS (SELECT SK_ID_CURR, SK_ID_BUREAU, DAYS_CREDIT, CREDIT_TYPE, {MASKED} FROM (SELECT *, coalesce(DAYS_CREDIT_UPDATE <= 0, false) AND NOT coalesce(DAYS_ENDDATE_FACT > 0, false) AS safe FROM bureau WHERE DAYS_CREDIT <= 0))"
BUREAU_ROWS = """, bureau_rows AS (SELECT masked.*, summary.* EXCLUDE (SK_ID_BUREAU), CASE WHEN AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END AS debt, CASE WHEN AMT_CREDIT_SUM_LIMIT < 0 THEN 0 ELSE AMT_CREDIT_SUM_LIMIT END AS "limit",
  CAST(CREDIT_ACTIVE = 'Active' AS INT) AS is_active, CAST(CREDIT_ACTIVE = 'Closed' AS INT) AS is_closed, CAST(CREDIT_ACTIVE IN ('Sold', 'Bad debt') AS INT) AS is_sold_or_bad, CASE WHEN DAYS_CREDIT >= -365 THEN 1 ELSE 0 END AS recent_credit,
  CAST(CREDIT_DAY_OVERDUE > 0 AS INT) AS overdue_credit, CASE WHEN CREDIT_ACTIVE = 'Active' THEN DAYS_CREDIT_ENDDATE END AS active_enddate,
  CASE WHEN CREDIT_ACTIVE IS NULL THEN NULL WHEN CREDIT_ACTIVE <> 'Active' THEN 0 WHEN AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END AS active_debt, CASE WHEN bb_months IS NULL THEN 0 ELSE 1 END AS bb_has_history,
  """ + ", ".join(f"CASE WHEN CREDIT_TYPE = '{t}' THEN 1 ELSE 0 END AS type_{g}" for t, g in bureau.TYPES.items()) + f""", CASE WHEN CREDIT_TYPE IN ({', '.join(repr(t) for t in bureau.TYPES)}) THEN 0 ELSE 1 END AS type_other
  FROM masked LEFT JOIN summary ON masked.SK_ID_BUREAU = summary.SK_ID_BUREAU)"""
BUREAU_SQL = f"WITH {ctes('bureau', 'balance')}{BALANCE_SUMMARY}{MASK_ROWS}{BUREAU_ROWS} " + features_sql(bureau.FEATURES, "bureau", "bureau_rows", "snapshots > 0", bureau.SNAPSHOT).replace("coalesce(sum(limit), 0)", 'coalesce(sum("limit"), 0)')

LEVEL = """, level AS (SELECT *, CASE WHEN days_entry IS NOT NULL THEN CASE WHEN days_late > 0 THEN 1 ELSE 0 END END AS is_late, CASE WHEN days_entry IS NOT NULL THEN CASE WHEN days_late > 30 THEN 1 ELSE 0 END END AS is_severe_late,
  CASE WHEN days_late > 0 THEN days_late END AS late_days_when_late, CASE WHEN scheduled > 0 THEN CASE WHEN paid / scheduled > 2 THEN 2 ELSE paid / scheduled END END AS payment_ratio, CASE WHEN paid < scheduled - 1 THEN 1 ELSE 0 END AS is_underpaid,
  CASE WHEN paid > scheduled + 1 THEN 1 ELSE 0 END AS is_overpaid, CASE WHEN days_entry IS NULL THEN 1 ELSE 0 END AS is_unpaid, CASE WHEN n_parts > 1 THEN 1 ELSE 0 END AS is_split, scheduled - paid AS gap, CASE WHEN days_instalment >= -365 THEN 1 ELSE 0 END AS is_recent,
  CASE WHEN days_instalment >= -365 AND days_entry IS NOT NULL THEN CASE WHEN days_late > 0 THEN 1 ELSE 0 END END AS is_late_recent, CASE WHEN days_instalment >= -365 THEN CASE WHEN paid < scheduled - 1 THEN 1 ELSE 0 END END AS is_underpaid_recent
  FROM (SELECT *, days_entry - days_instalment AS days_late FROM (SELECT SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER, min(SK_ID_CURR) AS SK_ID_CURR, max(AMT_INSTALMENT) AS scheduled, coalesce(sum(AMT_PAYMENT), 0) AS paid, max(DAYS_INSTALMENT) AS days_instalment, max(DAYS_ENTRY_PAYMENT) AS days_entry, count(*) AS n_parts
    FROM installments WHERE NUM_INSTALMENT_VERSION IS NOT NULL GROUP BY SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER)))"""
INSTALLMENTS_SQL = f"WITH {ctes('installments')}{LEVEL} {features_sql(installments.FEATURES, 'installments', 'level')}"

CARD_ROWS = """, card_rows AS (SELECT *, CASE WHEN use IS NOT NULL THEN CAST(use > 0.8 AS INT) END AS high_util, CASE WHEN use IS NOT NULL THEN CAST(use > 1 AS INT) END AS over_limit, use AS utilization, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS dpd_pos, CASE WHEN SK_DPD > 30 THEN 1 ELSE 0 END AS dpd_severe,
  CAST(CNT_DRAWINGS_ATM_CURRENT > 0 AS INT) AS atm_month, CASE WHEN AMT_INST_MIN_REGULARITY > 0 THEN CASE WHEN AMT_PAYMENT_TOTAL_CURRENT / AMT_INST_MIN_REGULARITY > 5 THEN 5 ELSE AMT_PAYMENT_TOTAL_CURRENT / AMT_INST_MIN_REGULARITY END END AS payment_to_min,
  CASE WHEN AMT_INST_MIN_REGULARITY > 0 THEN CASE WHEN AMT_PAYMENT_TOTAL_CURRENT < AMT_INST_MIN_REGULARITY THEN 1 ELSE 0 END END AS missed_min, CASE WHEN NAME_CONTRACT_STATUS = 'Active' THEN 1 ELSE 0 END AS active, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END AS completed
  FROM (SELECT *, CASE WHEN AMT_CREDIT_LIMIT_ACTUAL > 0 THEN CASE WHEN AMT_BALANCE < 0 THEN 0 ELSE AMT_BALANCE END / AMT_CREDIT_LIMIT_ACTUAL END AS use FROM credit_card)),
cards AS (SELECT SK_ID_CURR AS c, avg(b) AS balance_latest_mean, avg(u) AS utilization_latest_mean, CAST(sum(d) AS DOUBLE) AS completed_cards FROM (
  SELECT SK_ID_CURR, SK_ID_PREV, arg_max_null(AMT_BALANCE, MONTHS_BALANCE) AS b, arg_max_null(utilization, MONTHS_BALANCE) AS u, max(completed) AS d FROM card_rows GROUP BY SK_ID_CURR, SK_ID_PREV) GROUP BY SK_ID_CURR)"""
CARD_SQL = f"WITH {ctes('credit_card')}{CARD_ROWS} " + features_sql(credit_card.FEATURES, "credit_card", "card_rows", extra=" JOIN cards ON cards.c = a.SK_ID_CURR")

POS_ROWS = """, pos_rows AS (SELECT *, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS dpd_pos, CASE WHEN SK_DPD > 30 THEN 1 ELSE 0 END AS dpd_severe, CASE WHEN SK_DPD_DEF > 0 THEN 1 ELSE 0 END AS dpd_def_pos, CASE WHEN MONTHS_BALANCE >= -12 THEN CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END END AS recent_dpd,
  CASE WHEN CNT_INSTALMENT > 0 THEN CNT_INSTALMENT_FUTURE / CNT_INSTALMENT END AS remaining_share, CASE WHEN NAME_CONTRACT_STATUS = 'Active' THEN 1 ELSE 0 END AS active, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1 ELSE 0 END AS completed FROM pos),
contracts AS (SELECT SK_ID_CURR AS c, CAST(sum(d) AS DOUBLE) AS completed_contracts FROM (SELECT SK_ID_CURR, SK_ID_PREV, max(completed) AS d FROM pos_rows GROUP BY SK_ID_CURR, SK_ID_PREV) GROUP BY SK_ID_CURR)"""
POS_SQL = f"WITH {ctes('pos')}{POS_ROWS} " + features_sql(pos.FEATURES, "pos", "pos_rows", extra=" JOIN contracts ON contracts.c = a.SK_ID_CURR")


@query(f"WITH {ctes('previous_all')} SELECT SK_ID_PREV, CASE WHEN AMT_APPLICATION > 0 THEN AMT_CREDIT / AMT_APPLICATION END AS ratio FROM previous_all")
def q_safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "previous_all").select("SK_ID_PREV", safe_ratio(F.col("AMT_CREDIT"), F.col("AMT_APPLICATION")).alias("ratio"))


@query(f"WITH {ctes('bureau')} SELECT SK_ID_BUREAU, CASE WHEN AMT_CREDIT_SUM_DEBT < 0 THEN 0 ELSE AMT_CREDIT_SUM_DEBT END AS low, CASE WHEN AMT_CREDIT_SUM_LIMIT > 5000 THEN 5000 ELSE AMT_CREDIT_SUM_LIMIT END AS high FROM bureau")
def q_clip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bureau").select("SK_ID_BUREAU", clip_low(F.col("AMT_CREDIT_SUM_DEBT")).alias("low"), clip_high(F.col("AMT_CREDIT_SUM_LIMIT"), 5000.0).alias("high"))


@query(
    f"WITH {ctes('bureau')} SELECT SK_ID_CURR, avg(CAST(CREDIT_DAY_OVERDUE > 0 AS INT)) AS known_share, avg(CASE WHEN CREDIT_DAY_OVERDUE > 0 THEN 1 ELSE 0 END) AS plain_share, avg(CASE WHEN DAYS_ENDDATE_FACT IS NOT NULL THEN CASE WHEN CREDIT_DAY_OVERDUE > 0 THEN 1 ELSE 0 END END) AS closed_share, "
    "sum(CASE WHEN CREDIT_DAY_OVERDUE > 0 THEN AMT_CREDIT_SUM END) AS overdue_amount FROM bureau GROUP BY SK_ID_CURR"
)
def q_masked_vs_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("CREDIT_DAY_OVERDUE") > 0
    return view(spark, sf_dir, "bureau").groupBy(ID).agg(
        F.avg(known_flag(late)).alias("known_share"), F.avg(plain_flag(late)).alias("plain_share"), F.avg(flag_where(F.col("DAYS_ENDDATE_FACT").isNotNull(), late)).alias("closed_share"), F.sum(keep_where(late, F.col("AMT_CREDIT_SUM"))).alias("overdue_amount")
    )


@query(f"WITH {ctes('bureau')} SELECT SK_ID_BUREAU, CASE WHEN CREDIT_ACTIVE IS NULL THEN NULL WHEN CREDIT_ACTIVE = 'Active' THEN AMT_CREDIT_SUM_DEBT ELSE 0 END AS active_debt FROM bureau")
def q_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bureau").select("SK_ID_BUREAU", value_if(known_flag(F.col("CREDIT_ACTIVE") == "Active"), F.col("AMT_CREDIT_SUM_DEBT")).alias("active_debt"))


@query(f"WITH {ctes('bureau')} SELECT CASE CREDIT_TYPE WHEN 'Consumer credit' THEN 'consumer' WHEN 'Credit card' THEN 'credit_card' WHEN 'Car loan' THEN 'car_loan' WHEN 'Mortgage' THEN 'mortgage' WHEN 'Microloan' THEN 'microloan' ELSE 'other' END AS type_group, count(*) AS n FROM bureau GROUP BY 1")
def q_level_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bureau").groupBy(level_map(F.col("CREDIT_TYPE"), bureau.TYPES, "other").alias("type_group")).agg(F.count("*").alias("n"))


@query(PREVIOUS_SQL)
def q_previous_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(previous.build(view(spark, sf_dir, "previous")))


@query(f"WITH {ctes('previous')} SELECT SK_ID_CURR, SK_ID_PREV, NAME_CONTRACT_STATUS, DAYS_DECISION FROM (SELECT *, row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_DECISION DESC, SK_ID_PREV) AS rn FROM previous) WHERE rn = 1")
def q_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("SK_ID_PREV", "NAME_CONTRACT_STATUS", "DAYS_DECISION"), F.struct("DAYS_DECISION", -F.col("SK_ID_PREV"))).alias("r")
    return view(spark, sf_dir, "previous").groupBy(ID).agg(best).select(ID, "r.*")


MIN_FEATURES = tuple(f for f in previous.FEATURES if f.name in ("count", "approved_count", "approval_rate", "amt_application_mean", "decisions_last_year", "last_application_refused"))


@query(
    f"WITH {ctes('application', 'previous')}{PREVIOUS_ROWS}, f AS ({features_sql(MIN_FEATURES, 'previous', 'previous_rows')}) SELECT a.SK_ID_CURR, c_mktsegment, c_nationkey, "
    + ", ".join(f"CASE WHEN f.SK_ID_CURR IS NULL THEN 0 ELSE previous__{f.name} END AS previous__{f.name}" if f.count_like else f"previous__{f.name}" for f in MIN_FEATURES)
    + ", CASE WHEN f.SK_ID_CURR IS NULL THEN 0 ELSE 1 END AS previous__has_history FROM application a LEFT JOIN f ON a.SK_ID_CURR = f.SK_ID_CURR"
)
def q_feature_matrix_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least whole slice: applications, previous applications aggregated, joined with a history flag and zero-filled."""
    rows = previous.derive(temporal.require_history(view(spark, sf_dir, "previous"), "DAYS_DECISION"))
    table = aggregate(rows, MIN_FEATURES).withColumn("approval_rate", safe_ratio(F.col("approved_count"), F.col("count")))
    table = table.select(ID, *[F.col(f.name).cast("float").alias(f"previous__{f.name}") for f in MIN_FEATURES])
    return shown(assemble.build_matrix(view(spark, sf_dir, "application").drop("TARGET"), {"previous": table}, check=False))


@query(f"WITH {ctes('balance')}{BALANCE_SUMMARY} SELECT * FROM summary")
def q_balance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bureau.summarize_balance(view(spark, sf_dir, "balance"))


@query(BUREAU_SQL)
def q_bureau_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bureau.build(view(spark, sf_dir, "bureau"), view(spark, sf_dir, "balance")))


@query(f"WITH {ctes('installments')}{LEVEL} SELECT * FROM level")
def q_installment_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return installments.installment_level(view(spark, sf_dir, "installments"))


@query(INSTALLMENTS_SQL)
def q_installments_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(installments.build(view(spark, sf_dir, "installments")))


@query(CARD_SQL)
def q_credit_card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(credit_card.build(view(spark, sf_dir, "credit_card")))


@query(POS_SQL)
def q_pos_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pos.build(view(spark, sf_dir, "pos")))


@query(f"WITH {ctes('pos')}{POS_ROWS} SELECT c AS SK_ID_CURR, CAST(completed_contracts AS BIGINT) AS completed_contracts FROM contracts")
def q_completed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pos.derive(view(spark, sf_dir, "pos")).groupBy(ID, "SK_ID_PREV").agg(F.max("completed").alias("done"))
    return done.groupBy(ID).agg(F.sum("done").alias("completed_contracts"))


@query(f"WITH {ctes('bureau')} SELECT SK_ID_BUREAU, DAYS_CREDIT FROM bureau WHERE DAYS_CREDIT <= 0")
def q_temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.only_history(view(spark, sf_dir, "bureau"), "DAYS_CREDIT").select("SK_ID_BUREAU", "DAYS_CREDIT")


@query(f"WITH {ctes('bureau')}{MASK_ROWS} SELECT * FROM masked")
def q_temporal_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.mask_snapshots(temporal.only_history(view(spark, sf_dir, "bureau"), "DAYS_CREDIT"))


@query(f"WITH {ctes('previous_all')} SELECT count(*) FILTER (DAYS_DECISION > 0) AS DAYS_DECISION FROM previous_all")
def q_temporal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.violations(view(spark, sf_dir, "previous_all"), "DAYS_DECISION")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "bureau": bureau.build(view(spark, sf_dir, "bureau"), view(spark, sf_dir, "balance")), "previous": previous.build(view(spark, sf_dir, "previous")), "installments": installments.build(view(spark, sf_dir, "installments")),
        "credit_card": credit_card.build(view(spark, sf_dir, "credit_card")), "pos": pos.build(view(spark, sf_dir, "pos")),
    }


def _assembled_sql() -> str:
    parts = {"bureau": BUREAU_SQL, "previous": PREVIOUS_SQL, "installments": INSTALLMENTS_SQL, "credit_card": CARD_SQL, "pos": POS_SQL}
    out = []
    for s in parts:
        t = f"t_{s}"
        out += [f"CASE WHEN {t}.SK_ID_CURR IS NULL THEN 0 ELSE {s}__{f.name} END AS {s}__{f.name}" if f.count_like else f"{s}__{f.name}" for f in assemble.features_of(s)]
        out.append(f"CASE WHEN {t}.SK_ID_CURR IS NULL THEN 0 ELSE 1 END AS {s}__has_history")
    joins = " ".join(f"LEFT JOIN t_{s} ON a.SK_ID_CURR = t_{s}.SK_ID_CURR" for s in parts)
    return f"WITH {ctes('application')}, " + ", ".join(f"t_{s} AS ({sql})" for s, sql in parts.items()) + f" SELECT a.SK_ID_CURR, c_mktsegment, c_nationkey, {', '.join(out)} FROM application a {joins}"


@query(_assembled_sql())
def q_assemble_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(assemble.build_matrix(view(spark, sf_dir, "application").drop("TARGET"), _tables(spark, sf_dir), check=False))


@query(f"WITH {ctes('application', 'previous', 'pos')} SELECT 'previous' AS source, count(*) AS customers, count(*) FILTER (SK_ID_CURR IN (SELECT SK_ID_CURR FROM previous)) AS with_history FROM application UNION ALL SELECT 'pos', count(*), count(*) FILTER (SK_ID_CURR IN (SELECT SK_ID_CURR FROM pos)) FROM application")
def q_history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps, out = view(spark, sf_dir, "application").select(ID), None
    for s in ("previous", "pos"):
        seen = view(spark, sf_dir, s).select(ID).distinct().withColumn("has", F.lit(1))
        part = apps.join(seen, ID, "left").agg(F.lit(s).alias("source"), F.count("*").alias("customers"), F.count("has").alias("with_history"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {len(assemble.features_of(s)) + 1}, {len(assemble.count_like_columns(s))})" for s in assemble.SOURCES) + ") AS t(source, columns, count_like)")
def q_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.catalog(spark).groupBy("source").agg(F.count("*").cast("int").alias("columns"), F.sum(F.col("count_like").cast("int")).cast("int").alias("count_like"))
