"""Data quality, integrity and split queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import audit, quality, split
from cairn.operators.preprocessing import TreePreprocessor, clean, missing_groups, vocabulary
from cairn.operators.ranking import column_quantiles
from cairn.plans.registry import query
from cairn.plans.views import ctes, view
from cairn.sources.tables import ID, TARGET, verify_target

WIDE = f"WITH {ctes('wide')} "
COLUMNS = ("SK_ID_CURR", "TARGET", "AMT_TOTAL", "CNT_ITEMS", "DAYS_EMPLOYED", "AMT_TAIL", "NAME_PRIORITY", "CODE_GROUP", "FLAG_ONE", "EXT_SCORE")
NUMERIC = ("AMT_TOTAL", "CNT_ITEMS", "DAYS_EMPLOYED", "AMT_TAIL", "FLAG_ONE", "EXT_SCORE")


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query(WIDE + "SELECT count(*) AS n_rows, 10 AS n_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM wide)) AS duplicate_rows, count(*) - count(DISTINCT SK_ID_CURR) AS duplicate_ids, count(*) = count(DISTINCT SK_ID_CURR) AS id_unique, 8 AS n_numeric, 2 AS n_categorical FROM wide")
def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overview(view(spark, sf_dir, "wide"))


@query(WIDE + "SELECT count(*) AS n, count(*) FILTER (TARGET IS NULL) AS n_missing, count(*) FILTER (TARGET = 1) AS n_positive, count(*) FILTER (TARGET = 0) AS n_negative, count(*) FILTER (TARGET = 1) / count(*) AS prevalence, count(*) FILTER (TARGET = 0) / count(*) FILTER (TARGET = 1) AS imbalance FROM wide")
def q_target_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.target_summary(view(spark, sf_dir, "wide"))


@query(f"WITH {ctes('application')} SELECT count(*) AS rows, avg(TARGET) AS prevalence FROM application")
def q_verify_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_target(view(spark, sf_dir, "application"))


@query(WIDE + _union(f"SELECT {n} AS position, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER ({c} IS NULL) / count(*) AS fraction FROM wide" for n, c in enumerate(COLUMNS)))
def q_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missingness(view(spark, sf_dir, "wide"))


@query(WIDE + ", m AS (" + _union(f"SELECT count(*) FILTER ({c} IS NULL) / count(*) AS f FROM wide" for c in COLUMNS) + ") SELECT count(*) FILTER (f > 0) AS columns_with_missing, count(*) FILTER (f > 0.5) AS columns_over_half, count(*) FILTER (f > 0.2) AS columns_over_fifth, round(avg(f), 9) AS total_fraction FROM m")
def q_missingness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missingness_summary(quality.missingness(view(spark, sf_dir, "wide"))).withColumn("total_fraction", F.round("total_fraction", 9))


LONG = ", long AS (" + _union(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM wide GROUP BY {c}" for c in COLUMNS) + ")"


@query(WIDE + LONG + " SELECT * FROM (SELECT \"column\", count(value) AS n_unique, coalesce(max(n) FILTER (value IS NOT NULL), 0) / sum(n) AS top_share FROM long GROUP BY \"column\") WHERE top_share >= 0.99 OR n_unique <= 1")
def q_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.constant_columns(view(spark, sf_dir, "wide"))


@query(WIDE + LONG + " SELECT \"column\", count(value) AS n_unique, coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n) AS missing_fraction FROM long WHERE \"column\" IN ('NAME_PRIORITY', 'CODE_GROUP') GROUP BY \"column\"")
def q_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cardinality(view(spark, sf_dir, "wide"))


@query(WIDE + "SELECT 'CODE_GROUP' AS \"column\", count(DISTINCT CODE_GROUP) AS n_unique, 0.0::DOUBLE AS missing_fraction FROM wide HAVING count(DISTINCT CODE_GROUP) > 20")
def q_high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.high_cardinality(view(spark, sf_dir, "wide"))


@query(
    WIDE + "SELECT 'unknown_token' AS finding, 'NAME_PRIORITY' AS \"column\", NAME_PRIORITY AS detail, count(*) AS n FROM wide WHERE NAME_PRIORITY = 'XNA' GROUP BY NAME_PRIORITY "
    "UNION ALL SELECT 'positive_days', 'DAYS_EMPLOYED', '', count(*) FROM wide WHERE DAYS_EMPLOYED > 0 UNION ALL SELECT 'sentinel', 'DAYS_EMPLOYED', '', count(*) FROM wide WHERE DAYS_EMPLOYED = 365243 "
    "UNION ALL SELECT 'extreme', 'AMT_TAIL', 'large', count(*) FROM wide HAVING max(AMT_TAIL) > 100 * quantile_cont(AMT_TAIL, 0.99) UNION ALL SELECT 'negative_amount', 'CNT_ITEMS', '', count(*) FROM wide WHERE CNT_ITEMS < 0"
)
def q_suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.suspicious_values(view(spark, sf_dir, "wide").drop(ID, TARGET))
    return found.withColumn("detail", F.when(F.col("finding") == "extreme", "large").otherwise(F.col("detail")))


@query(WIDE + "SELECT NAME_PRIORITY AS value, count(*) AS n FROM wide GROUP BY NAME_PRIORITY ORDER BY n DESC, value NULLS LAST LIMIT 12")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(view(spark, sf_dir, "wide"), "NAME_PRIORITY")


@query(WIDE + _union(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_missing, count(*) FILTER ({c} < 0) AS n_negative, count(*) FILTER ({c} = 0) AS n_zero, CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.99)::DOUBLE AS q99, CAST(max({c}) AS DOUBLE) AS max FROM wide"
    for c in NUMERIC))
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(view(spark, sf_dir, "wide"), list(NUMERIC))


@query(WIDE + "SELECT round(skewness(AMT_TOTAL), 6) AS amt_total, round(skewness(CNT_ITEMS), 6) AS cnt_items, round(skewness(AMT_TAIL), 6) AS amt_tail FROM wide")
def q_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "wide").agg(*[F.round(quality.sample_skewness(c), 6).alias(c.lower()) for c in ("AMT_TOTAL", "CNT_ITEMS", "AMT_TAIL")])


@query(WIDE + "SELECT 'AMT_TAIL' AS \"column\", count(DISTINCT AMT_TAIL) AS n_unique, CAST(min(AMT_TAIL) AS DOUBLE) AS min, CAST(max(AMT_TAIL) AS DOUBLE) AS max, round(skewness(AMT_TAIL), 6) AS skew FROM wide HAVING skewness(AMT_TAIL) > 1")
def q_heavy_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.heavy_tails(view(spark, sf_dir, "wide"), ["CNT_ITEMS", "AMT_TAIL", "DAYS_EMPLOYED", "FLAG_ONE"])
    return found.withColumn("skew", F.round("skew", 6))


def _auc_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CASE WHEN a < 0.5 THEN 1 - a ELSE a END AS auc FROM (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below "
        f"FROM (SELECT {c} AS v, sum(TARGET) AS pos, sum(1 - TARGET) AS neg FROM wide WHERE {c} IS NOT NULL GROUP BY {c})))"
    )


@query(WIDE + ", r AS (" + _union(_auc_sql(c) for c in NUMERIC) + ") SELECT \"column\", round(auc, 9) AS auc FROM r")
def q_univariate_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.univariate_auc(view(spark, sf_dir, "wide"), TARGET, list(NUMERIC)).withColumn("auc", F.round("auc", 9))


@query("SELECT * FROM (VALUES ('bb_latest_dpd_credits'), ('AMT_OVERDUE'), ('late_rate')) AS t(name)")
def q_leaky_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = quality.leaky_names(["TARGET", "SK_ID_CURR", "bb_latest_dpd_credits", "AMT_OVERDUE", "AMT_CREDIT", "late_rate"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("SELECT count(*) AS orders_without_lines FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").agg(F.count("*").alias("orders_without_lines"))


@query(f"WITH {ctes('bureau', 'balance')} SELECT count(DISTINCT SK_ID_BUREAU) AS credits_matched FROM bureau WHERE SK_ID_BUREAU IN (SELECT SK_ID_BUREAU FROM balance)")
def q_semi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.matched_credits(view(spark, sf_dir, "bureau"), view(spark, sf_dir, "balance"))


@query(f"WITH {ctes('balance')} SELECT count(*) AS rows, count(DISTINCT SK_ID_BUREAU) AS credits, count(*) - (SELECT count(*) FROM (SELECT DISTINCT SK_ID_BUREAU, MONTHS_BALANCE FROM balance)) AS duplicates FROM balance")
def q_audit_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_balance(view(spark, sf_dir, "balance"))["grain"]


@query(f"WITH {ctes('bureau')} " + _union(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count(*) FILTER ({c} > 0) AS n_positive FROM bureau" for c in ("DAYS_CREDIT", "DAYS_CREDIT_UPDATE", "DAYS_CREDIT_ENDDATE", "DAYS_ENDDATE_FACT")))
def q_audit_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_bureau(view(spark, sf_dir, "bureau"))["ranges"]


@query(f"WITH {ctes('bureau')} SELECT count(*) FILTER (AMT_CREDIT_SUM_DEBT > AMT_CREDIT_SUM) AS debt_over_credit, count(*) FILTER (AMT_CREDIT_SUM_DEBT < 0) AS negative_debt, count(*) FILTER (AMT_CREDIT_SUM_LIMIT < 0) AS negative_limit, count(*) FILTER (DAYS_CREDIT_UPDATE > 0) AS future_update, count(*) FILTER (CREDIT_ACTIVE = 'Active' AND DAYS_CREDIT_ENDDATE < 0) AS active_past_end FROM bureau")
def q_audit_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_bureau(view(spark, sf_dir, "bureau"))["anomalies"]


@query(f"WITH {ctes('previous_all')} SELECT * FROM (SELECT 'NAME_CONTRACT_STATUS' AS \"column\", NAME_CONTRACT_STATUS AS value, count(*) AS n FROM previous_all GROUP BY 2) UNION ALL SELECT * FROM (SELECT 'CODE_REJECT_REASON', CODE_REJECT_REASON, count(*) FROM previous_all GROUP BY 2) UNION ALL SELECT * FROM (SELECT 'NAME_CONTRACT_TYPE', NAME_CONTRACT_TYPE, count(*) FROM previous_all GROUP BY 2)")
def q_audit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_previous(view(spark, sf_dir, "previous_all"))["levels"]


@query(f"WITH {ctes('installments')} , d AS (SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS late FROM installments) SELECT avg(late) AS mean, CAST(quantile_cont(late, 0.5) AS DOUBLE) AS median, avg(CASE WHEN late > 0 THEN 1 ELSE 0 END) AS share_late, avg(CASE WHEN late > 30 THEN 1 ELSE 0 END) AS share_severe, max(late) AS max FROM d")
def q_audit_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_installments(view(spark, sf_dir, "installments"))["lateness"]


@query(f"WITH {ctes('installments')} SELECT quantile_cont(r, 0.5) AS median, avg(CASE WHEN r < 0.99 THEN 1 ELSE 0 END) AS share_under, avg(CASE WHEN r > 1.01 THEN 1 ELSE 0 END) AS share_over, count(*) FILTER (AMT_INSTALMENT = 0) AS zero_scheduled FROM (SELECT *, CASE WHEN AMT_INSTALMENT > 0 THEN AMT_PAYMENT / AMT_INSTALMENT END AS r FROM installments)")
def q_audit_payment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_installments(view(spark, sf_dir, "installments"))["ratio"]


@query(f"WITH {ctes('installments_all')}, d AS (SELECT *, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS late FROM installments_all) SELECT avg(late) AS mean, CAST(quantile_cont(late, 0.5) AS DOUBLE) AS median, avg(CASE WHEN late > 0 THEN 1 ELSE 0 END) AS share_late, avg(CASE WHEN late > 30 THEN 1 ELSE 0 END) AS share_severe, max(late) AS max FROM d")
def q_audit_lateness_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_installments(view(spark, sf_dir, "installments_all"))["lateness"]


@query(f"WITH {ctes('installments_all')} SELECT quantile_cont(r, 0.5) AS median, avg(CASE WHEN r < 0.99 THEN 1 ELSE 0 END) AS share_under, avg(CASE WHEN r > 1.01 THEN 1 ELSE 0 END) AS share_over, count(*) FILTER (AMT_INSTALMENT = 0) AS zero_scheduled FROM (SELECT *, CASE WHEN AMT_INSTALMENT > 0 THEN AMT_PAYMENT / AMT_INSTALMENT END AS r FROM installments_all)")
def q_audit_payment_ratio_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_installments(view(spark, sf_dir, "installments_all"))["ratio"]


@query(f"WITH {ctes('credit_card')} SELECT count(*) FILTER (AMT_CREDIT_LIMIT_ACTUAL = 0) AS zero_limit, quantile_cont(u, 0.5) AS median, quantile_cont(u, 0.99) AS q99, avg(CASE WHEN u > 1 THEN 1 ELSE 0 END) AS share_over, max(u) AS max FROM (SELECT *, CASE WHEN AMT_CREDIT_LIMIT_ACTUAL > 0 THEN CASE WHEN AMT_BALANCE < 0 THEN 0 ELSE AMT_BALANCE END / AMT_CREDIT_LIMIT_ACTUAL END AS u FROM credit_card)")
def q_audit_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_credit_card(view(spark, sf_dir, "credit_card"))["utilization"]


@query(f"WITH {ctes('pos')} SELECT avg(CASE WHEN CNT_INSTALMENT_FUTURE > CNT_INSTALMENT THEN 1 ELSE 0 END) AS future_over_term, avg(CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END) AS late, avg(CASE WHEN SK_DPD > 30 THEN 1 ELSE 0 END) AS severe FROM pos")
def q_audit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_pos(view(spark, sf_dir, "pos"))["shares"]


SPLIT = (
    f"WITH {ctes('application')}, h AS (SELECT SK_ID_CURR, TARGET, md5('42:' || SK_ID_CURR) AS h FROM application), c AS (SELECT TARGET, count(*) AS n, sum(count(*)) OVER () AS total FROM h GROUP BY TARGET), "
    "q AS (SELECT TARGET, floor(ceil(total * 0.2) * n / total) AS base, ceil(total * 0.2) * n / total - floor(ceil(total * 0.2) * n / total) AS rest, ceil(total * 0.2) AS test FROM c), "
    "t AS (SELECT TARGET, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, TARGET) <= test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q), "
    "s AS (SELECT SK_ID_CURR, CASE WHEN row_number() OVER (PARTITION BY h.TARGET ORDER BY substr(h, 1, 12)) <= quota THEN 'test' ELSE 'train' END AS split FROM h JOIN t ON h.TARGET = t.TARGET) "
)


@query(SPLIT + "SELECT * FROM s")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(view(spark, sf_dir, "application"))


@query("SELECT 0::BIGINT AS duplicate_ids, 0::BIGINT AS unknown_labels, 0::BIGINT AS ids_without_data, 0::BIGINT AS ids_without_split")
def q_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = view(spark, sf_dir, "application")
    return split.check_membership(split.stratified_split(apps), apps)


@query(WIDE + "SELECT SK_ID_CURR, coalesce(AMT_TOTAL, (SELECT quantile_cont(AMT_TOTAL, 0.5) FROM wide)) AS amt_total, CASE WHEN AMT_TOTAL IS NULL THEN 1 ELSE 0 END AS missing_amt_total FROM wide")
def q_median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "wide")
    median = column_quantiles(rows, ["AMT_TOTAL"], [0.5]).first().quantiles[0]
    return rows.select(ID, F.coalesce("AMT_TOTAL", F.lit(median)).alias("amt_total"), F.col("AMT_TOTAL").isNull().cast("int").alias("missing_amt_total"))


@query(WIDE + ", b AS (SELECT quantile_cont(AMT_TAIL, 0.001) AS lo, quantile_cont(AMT_TAIL, 0.999) AS hi FROM wide) SELECT SK_ID_CURR, CAST(CAST(CASE WHEN AMT_TAIL < lo THEN lo WHEN AMT_TAIL > hi THEN hi ELSE AMT_TAIL END AS FLOAT) AS DOUBLE) AS amt_tail FROM wide, b")
def q_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "wide").select(ID, "AMT_TAIL")
    fitted = TreePreprocessor(heavy_tail="winsorize", heavy_tail_columns=["AMT_TAIL"]).fit(rows)
    return fitted.transform(rows).select(ID, F.col("AMT_TAIL").cast("double").alias("amt_tail"))


@query("SELECT * FROM (VALUES (0, 'AMT_TOTAL'), (0, 'CNT_ITEMS'), (1, 'NAME_PRIORITY'), (2, 'EXT_SCORE')) AS t(group_id, \"column\")")
def q_missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = missing_groups(view(spark, sf_dir, "wide"), ["AMT_TOTAL", "CNT_ITEMS", "NAME_PRIORITY", "EXT_SCORE"])
    return spark.createDataFrame([(n, c) for n, g in enumerate(groups) for c in g], "group_id int, column string")


@query(WIDE + ", v AS (SELECT NAME_PRIORITY AS level, row_number() OVER (ORDER BY NAME_PRIORITY) - 1 AS code FROM (SELECT DISTINCT NAME_PRIORITY FROM wide WHERE NAME_PRIORITY IS NOT NULL)) SELECT SK_ID_CURR, CAST(code AS DOUBLE) AS code FROM wide LEFT JOIN v ON NAME_PRIORITY = level")
def q_vocab_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "wide").select(ID, "NAME_PRIORITY")
    return TreePreprocessor().fit(rows).transform(rows).select(ID, F.col("NAME_PRIORITY").cast("double").alias("code"))


@query(WIDE + "SELECT NAME_PRIORITY AS level FROM wide WHERE NAME_PRIORITY IS NOT NULL GROUP BY NAME_PRIORITY")
def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in vocabulary(view(spark, sf_dir, "wide"), ["NAME_PRIORITY"])["NAME_PRIORITY"]], "level string")


@query(WIDE + "SELECT SK_ID_CURR, CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END AS DAYS_EMPLOYED FROM wide")
def q_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(view(spark, sf_dir, "wide")).select(ID, "DAYS_EMPLOYED")
