"""The credit tables as views of the driver's star schema.

Each view is one text in the SQL that Spark and other engines share; only the day difference is written differently.
Offsets count from 1999-01-01, so both past and future rows occur. Amounts are whole numbers, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ANCHOR = "1999-01-01"
DAYS = {"spark": "datediff({0}, DATE '" + ANCHOR + "')", "other": "date_diff('day', DATE '" + ANCHOR + "', CAST({0} AS DATE))"}

TEXTS = {
    "application": "SELECT c_custkey AS SK_ID_CURR, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET, c_mktsegment, c_nationkey FROM customer",
    "previous_all": """
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, {o_orderdate} AS DAYS_DECISION,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Cash loans' WHEN o_orderpriority = '3-MEDIUM' THEN 'Consumer loans' WHEN o_orderpriority = '5-LOW' THEN 'Revolving loans' END AS NAME_CONTRACT_TYPE,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(round(o_totalprice) AS DOUBLE) END AS AMT_APPLICATION,
  CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST(round(o_totalprice) AS DOUBLE) END AS AMT_CREDIT, CAST(o_orderkey % 1000 AS DOUBLE) AS AMT_ANNUITY,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 50 AS DOUBLE) END AS AMT_DOWN_PAYMENT, CAST(round(o_totalprice) AS DOUBLE) AS AMT_GOODS_PRICE, CAST(o_orderkey % 8 AS DOUBLE) / 8 AS RATE_DOWN_PAYMENT,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END AS CNT_PAYMENT, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 2 AS DOUBLE) END AS NFLAG_INSURED_ON_APPROVAL,
  CASE WHEN o_orderkey % 5 = 0 THEN 'New' ELSE 'Repeater' END AS NAME_CLIENT_TYPE, CASE o_orderkey % 4 WHEN 0 THEN 'POS' WHEN 1 THEN 'Cash' WHEN 2 THEN 'Cards' END AS NAME_PORTFOLIO,
  CASE o_orderkey % 3 WHEN 0 THEN 'x-sell' WHEN 1 THEN 'walk-in' ELSE 'XNA' END AS NAME_PRODUCT_TYPE,
  CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low_normal' WHEN 2 THEN 'low_action' WHEN 3 THEN 'middle' END AS NAME_YIELD_GROUP,
  CASE o_orderkey % 6 WHEN 0 THEN 'HC' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'SCO' WHEN 3 THEN 'SCOFR' WHEN 4 THEN 'XAP' END AS CODE_REJECT_REASON
FROM orders""",
    "previous": "SELECT * FROM previous_all WHERE DAYS_DECISION <= 0",
    "bureau": """
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR, CASE WHEN o_orderkey % 17 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Sold' END END AS CREDIT_ACTIVE,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Consumer credit' WHEN '2-HIGH' THEN 'Credit card' WHEN '3-MEDIUM' THEN 'Car loan' WHEN '5-LOW' THEN 'Mortgage' END AS CREDIT_TYPE,
  {o_orderdate} AS DAYS_CREDIT, CASE WHEN o_orderkey % 19 <> 0 THEN {o_orderdate} + CAST(o_orderkey % 400 AS INT) END AS DAYS_CREDIT_UPDATE,
  {o_orderdate} + CAST(o_orderkey % 1500 AS INT) AS DAYS_CREDIT_ENDDATE, CASE WHEN o_orderkey % 3 <> 0 THEN {o_orderdate} + CAST(o_orderkey % 900 AS INT) END AS DAYS_ENDDATE_FACT,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) - 10 END AS CREDIT_DAY_OVERDUE, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) END AS AMT_CREDIT_MAX_OVERDUE,
  CAST(o_orderkey % 3 AS DOUBLE) AS CNT_CREDIT_PROLONG, CAST(round(o_totalprice) AS DOUBLE) AS AMT_CREDIT_SUM, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice) AS DOUBLE) - 100000 END AS AMT_CREDIT_SUM_DEBT,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 9000 AS DOUBLE) - 1000 END AS AMT_CREDIT_SUM_LIMIT, CAST(o_orderkey % 70 AS DOUBLE) AS AMT_CREDIT_SUM_OVERDUE, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 800 AS DOUBLE) END AS AMT_ANNUITY
FROM orders""",
    "balance": """
SELECT l_orderkey AS SK_ID_BUREAU, CAST(floor({l_shipdate} / 30.0) AS INT) AS MONTHS_BALANCE,
  CASE WHEN l_partkey % 23 = 0 THEN NULL WHEN l_returnflag = 'A' THEN CAST(l_linenumber % 6 AS VARCHAR(2)) WHEN l_returnflag = 'R' THEN 'C' WHEN l_linestatus = 'O' THEN 'X' ELSE '0' END AS STATUS
FROM lineitem""",
    "installments": """
SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, CASE WHEN l_partkey % 41 <> 0 THEN CAST(l_suppkey % 2 AS DOUBLE) END AS NUM_INSTALMENT_VERSION, l_linenumber AS NUM_INSTALMENT_NUMBER,
  {o_orderdate} AS DAYS_INSTALMENT, CASE WHEN l_partkey % 29 <> 0 THEN {l_shipdate} END AS DAYS_ENTRY_PAYMENT, CAST(round(l_extendedprice) AS DOUBLE) AS AMT_INSTALMENT,
  CASE WHEN l_partkey % 31 <> 0 THEN CAST(round(l_extendedprice) AS DOUBLE) - CAST(l_partkey % 3 AS DOUBLE) END AS AMT_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE {o_orderdate} <= 0 AND ({l_shipdate} <= 0 OR l_partkey % 29 = 0)""",
    "credit_card": """
SELECT user_id AS SK_ID_CURR, user_id * 10 + length(event_type) AS SK_ID_PREV, CAST(-event_id AS INT) AS MONTHS_BALANCE, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 2000 AS DOUBLE) - 200 END AS AMT_BALANCE,
  CAST(event_id % 4 AS DOUBLE) * 512 AS AMT_CREDIT_LIMIT_ACTUAL, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 300 AS DOUBLE) END AS AMT_DRAWINGS_ATM_CURRENT, CAST(event_id % 700 AS DOUBLE) AS AMT_DRAWINGS_CURRENT,
  CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 400 AS DOUBLE) END AS AMT_DRAWINGS_POS_CURRENT, CAST(event_id % 8 AS DOUBLE) * 16 AS AMT_INST_MIN_REGULARITY, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 250 AS DOUBLE) END AS AMT_PAYMENT_TOTAL_CURRENT,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 3 AS DOUBLE) END AS CNT_DRAWINGS_ATM_CURRENT, CAST(event_id % 9 AS DOUBLE) AS CNT_DRAWINGS_CURRENT, CAST(event_id % 40 AS DOUBLE) AS CNT_INSTALMENT_MATURE_CUM,
  CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 45 AS DOUBLE) - 5 END AS SK_DPD, CAST(event_id % 6 AS DOUBLE) AS SK_DPD_DEF, CASE event_type WHEN 'view' THEN 'Active' WHEN 'click' THEN 'Completed' WHEN 'error' THEN 'Signed' END AS NAME_CONTRACT_STATUS
FROM events""",
    "pos": """
SELECT user_id AS SK_ID_CURR, user_id * 10 + length(event_type) AS SK_ID_PREV, CAST(-(event_id % 61) AS INT) AS MONTHS_BALANCE, CASE WHEN event_id % 12 <> 0 THEN CAST(event_id % 48 AS DOUBLE) END AS CNT_INSTALMENT, CAST(event_id % 24 AS DOUBLE) AS CNT_INSTALMENT_FUTURE,
  CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 50 AS DOUBLE) - 15 END AS SK_DPD, CAST(event_id % 5 AS DOUBLE) - 2 AS SK_DPD_DEF, CASE event_type WHEN 'view' THEN 'Active' WHEN 'click' THEN 'Completed' WHEN 'error' THEN 'Signed' END AS NAME_CONTRACT_STATUS
FROM events""",
    "scores": """
SELECT l.doc_id, l.quality AS y, CAST(1 + n_chars % 97 AS DOUBLE) / 99 AS p, CAST(1 + (n_chars * 7 + l.doc_id) % 97 AS DOUBLE) / 99 AS p2
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "wide": """
SELECT o_orderkey AS SK_ID_CURR, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS TARGET, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(round(o_totalprice) AS DOUBLE) END AS AMT_TOTAL, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 37 AS DOUBLE) - 3 END AS CNT_ITEMS,
  CASE WHEN o_orderkey % 50 = 0 THEN 365243 ELSE CAST(-(o_custkey % 4000) AS INT) + 20 END AS DAYS_EMPLOYED, CASE WHEN o_orderkey % 1000 = 1 THEN 1000000.0 ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS AMT_TAIL,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'XNA' WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS NAME_PRIORITY, CAST(o_custkey % 30 AS VARCHAR(9)) AS CODE_GROUP, 1 AS FLAG_ONE, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 10 AS DOUBLE) END AS EXT_SCORE
FROM orders""",
}
#: All payments, also those that cross the anchor: for audits, which take raw rows.
TEXTS["installments_all"] = TEXTS["installments"][: TEXTS["installments"].index("\nWHERE")]
#: Views that a view reads.
NEEDS = {"previous": ("previous_all",)}


def _text(name: str, engine: str) -> str:
    out = TEXTS[name]
    for c in ("o_orderdate", "l_shipdate"):
        out = out.replace("{" + c + "}", DAYS[engine].format(c))
    return out


def ctes(*names: str) -> str:
    """The views as common table expressions for another engine, without WITH."""
    wanted = dict.fromkeys(n for name in names for n in (*NEEDS.get(name, ()), name))
    return ", ".join(f"{n} AS ({_text(n, 'other')})" for n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; base tables are read from sf_dir, and only the columns that are used."""
    text = _text(name, "spark").replace("VARCHAR(2)", "STRING").replace("VARCHAR(9)", "STRING")
    if name in NEEDS:
        inner = view(spark, sf_dir, NEEDS[name][0])
        return spark.sql(text.replace(NEEDS[name][0], "{inner}"), inner=inner)
    for t in ("customer", "orders", "lineitem", "events", "labels", "documents"):
        text = text.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`").replace(f"JOIN {t}", f"JOIN parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)
