import math

import pytest
from pyspark.sql import functions as F

from cairn.operators import assemble, audit, bureau, credit_card, installments, pos, previous, temporal

BUREAU = "SK_ID_CURR int, SK_ID_BUREAU int, CREDIT_ACTIVE string, CREDIT_TYPE string, DAYS_CREDIT double, CREDIT_DAY_OVERDUE double, DAYS_CREDIT_ENDDATE double, DAYS_ENDDATE_FACT double, AMT_CREDIT_MAX_OVERDUE double, CNT_CREDIT_PROLONG double, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_LIMIT double, AMT_CREDIT_SUM_OVERDUE double, DAYS_CREDIT_UPDATE double, AMT_ANNUITY double"
CREDITS = [
    (100, 1, "Active", "Consumer credit", -100.0, 5.0, 300.0, None, 50.0, 0.0, 1000.0, 400.0, 0.0, 10.0, -10.0, 50.0),
    (100, 2, "Closed", "Credit card", -800.0, 0.0, -400.0, -350.0, None, 1.0, 500.0, -20.0, 100.0, 0.0, -20.0, None),
    (200, 3, "Sold", "Mortgage", -30.0, 0.0, 1000.0, None, 0.0, 0.0, 2000.0, 1500.0, -5.0, 0.0, -5.0, 100.0),
]
MONTHS = [(1, 0, "0"), (1, -1, "1"), (1, -2, "C"), (1, -3, "X"), (3, 0, "3"), (3, -20, "0")]


def credits(spark, rows=CREDITS):
    return spark.createDataFrame(rows, BUREAU)


def months(spark, extra=()):
    return spark.createDataFrame([*MONTHS, *extra], "SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string")


def changed(n, **values):
    names = [c.split()[0] for c in BUREAU.split(", ")]
    return [tuple(values.get(c, v) if row[1] == n else v for c, v in zip(names, row, strict=True)) for row in CREDITS]


def customer(table, n, source):
    rows = [r for r in table.collect() if r.SK_ID_CURR == n]
    return {k.removeprefix(f"{source}__"): v for k, v in rows[0].asDict().items()} if rows else None


def test_balance_summary(spark):
    got = {r.SK_ID_BUREAU: r for r in bureau.summarize_balance(months(spark)).collect()}
    one = got[1]
    assert (one.bb_months, one.bb_known_months, one.bb_dpd_months, one.bb_status_max, one.bb_history_len, one.bb_latest_dpd) == (4, 3, 1, 1, 4, 0)
    assert one.bb_dpd_share == pytest.approx(1 / 3) and one.bb_closed_share == 0.25
    assert (got[3].bb_latest_dpd, got[3].bb_severe, got[3].bb_recent_dpd) == (1, 1, 1)


def test_bureau_customers(spark):
    table = bureau.build(credits(spark), months(spark))
    a, b = customer(table, 100, "bureau"), customer(table, 200, "bureau")
    assert (a["credit_count"], a["active_ratio"], a["debt_sum_total"], a["limit_sum"]) == (2, 0.5, 400, 100)
    assert a["debt_to_credit_ratio"] == pytest.approx(400 / 1500) and a["overdue_to_debt_ratio"] == pytest.approx(10 / 400)
    assert (a["days_update_max"], a["enddate_remaining_max"], a["credits_last_year"]) == (-10, 300, 1)
    assert (b["sold_or_bad_count"], b["bb_severe_credits"], b["bb_latest_dpd_credits"], b["debt_to_credit_ratio"]) == (1, 1, 1, 0.75)
    assert len(table.columns) == 49 and all(t == "float" for c, t in table.dtypes if c != "SK_ID_CURR")


def test_bureau_without_balance(spark):
    a = customer(bureau.build(credits(spark)), 100, "bureau")
    assert a["bb_credits_with_history"] == 0 and a["bb_months_sum"] == 0 and a["bb_status_max"] is None


@pytest.mark.parametrize("update", [1.0, 372.0, None])
def test_inadmissible_snapshot_of_one_credit(spark, update):
    a = customer(bureau.build(credits(spark, changed(1, DAYS_CREDIT_UPDATE=update)), months(spark)), 100, "bureau")
    assert (a["credit_count"], a["credit_sum_total"], a["active_ratio"], a["bb_months_sum"], a["days_update_max"]) == (2, 500, 0, 4, -20)


def test_customer_without_admissible_snapshot(spark):
    b = customer(bureau.build(credits(spark, changed(3, DAYS_CREDIT_UPDATE=10.0)), months(spark)), 200, "bureau")
    assert b["credit_count"] == 1 and b["debt_sum_total"] is None and b["sold_or_bad_count"] is None and b["bb_severe_credits"] == 1


@pytest.mark.parametrize("day", [1.0, None])
def test_future_or_undated_credit_vanishes(spark, day):
    assert customer(bureau.build(credits(spark, changed(3, DAYS_CREDIT=day)), months(spark)), 200, "bureau") is None


def test_future_month_changes_nothing(spark):
    assert sorted(bureau.build(credits(spark), months(spark)).collect()) == sorted(bureau.build(credits(spark), months(spark, [(1, 1, "5")])).collect())


def test_repeated_credit_raises(spark):
    with pytest.raises(ValueError):
        bureau.build(credits(spark, [*CREDITS, CREDITS[0]]))


PREVIOUS = "SK_ID_PREV int, SK_ID_CURR int, NAME_CONTRACT_TYPE string, AMT_ANNUITY double, AMT_APPLICATION double, AMT_CREDIT double, AMT_DOWN_PAYMENT double, AMT_GOODS_PRICE double, RATE_DOWN_PAYMENT double, NAME_CONTRACT_STATUS string, DAYS_DECISION double, CODE_REJECT_REASON string, NAME_CLIENT_TYPE string, NAME_PORTFOLIO string, NAME_PRODUCT_TYPE string, CNT_PAYMENT double, NAME_YIELD_GROUP string, NFLAG_INSURED_ON_APPROVAL double"
APPLIED = [
    (1, 100, "Cash loans", 10.0, 1000.0, 1100.0, 0.0, 1000.0, 0.0, "Approved", -500.0, "XAP", "New", "Cash", "x-sell", 12.0, "high", 1.0),
    (2, 100, "Consumer loans", 20.0, 0.0, 0.0, None, None, None, "Canceled", -100.0, "XAP", "Repeater", "POS", "XNA", 0.0, "XNA", None),
    (3, 100, "Cash loans", None, 3000.0, 0.0, 100.0, 3000.0, 0.1, "Refused", -30.0, "SCO", "Repeater", "Cash", "walk-in", 24.0, "low_normal", 0.0),
    (4, 200, "Revolving loans", 5.0, 500.0, 600.0, 0.0, 500.0, 0.0, "Approved", -900.0, "XAP", "New", "Cards", "XNA", 0.0, "middle", 0.0),
]


def test_previous(spark):
    table = previous.build(spark.createDataFrame(APPLIED, PREVIOUS))
    a, b = customer(table, 100, "previous"), customer(table, 200, "previous")
    assert (a["count"], a["approved_count"], a["last_application_refused"], a["last_application_approved"], a["decisions_last_year"]) == (3, 1, 1, 0, 2)
    assert a["approval_rate"] == pytest.approx(1 / 3) and a["refusal_rate"] == pytest.approx(1 / 3) and a["cash_loan_share"] == pytest.approx(2 / 3)
    assert (a["amt_application_mean"], a["amt_credit_approved_mean"], a["cnt_payment_approved_mean"], a["reject_scoring_count"], a["reject_hc_count"]) == (2000, 1100, 12, 1, 0)
    assert b["last_application_approved"] == 1


INSTALLMENTS = "SK_ID_PREV int, SK_ID_CURR int, NUM_INSTALMENT_VERSION double, NUM_INSTALMENT_NUMBER int, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double"
PAYMENTS = [
    (1, 100, 1.0, 1, -100.0, -95.0, 100.0, 100.0), (1, 100, 1.0, 2, -70.0, -76.0, 200.0, 120.0), (1, 100, 1.0, 2, -70.0, -60.0, 200.0, 80.0),
    (1, 100, 1.0, 3, -40.0, None, 100.0, 0.0), (2, 100, 1.0, 1, -400.0, -410.0, 50.0, 30.0), (3, 200, 0.0, 1, -10.0, -10.0, 0.0, 10.0),
]


def test_installments(spark):
    a = customer(installments.build(spark.createDataFrame(PAYMENTS, INSTALLMENTS)), 100, "installments")
    assert (a["n_installments"], a["n_contracts"], a["n_split_payments"], a["late_count"], a["days_late_max"], a["days_late_min"]) == (4, 2, 1, 2, 10, -10)
    assert a["late_rate"] == pytest.approx(2 / 3) and a["unpaid_rate"] == 0.25 and a["underpaid_rate"] == 0.5 and a["paid_share"] == pytest.approx(330 / 450)
    assert (a["payment_gap_sum"], a["n_installments_12m"], a["days_since_last_instalment"]) == (120, 3, -40)


def test_installment_without_version_vanishes(spark):
    rows = [*PAYMENTS, (9, 300, None, 1, -5.0, -5.0, 1.0, 1.0)]
    assert customer(installments.build(spark.createDataFrame(rows, INSTALLMENTS)), 300, "installments") is None


CARD = "SK_ID_PREV int, SK_ID_CURR int, MONTHS_BALANCE int, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL double, AMT_DRAWINGS_ATM_CURRENT double, AMT_DRAWINGS_CURRENT double, AMT_DRAWINGS_POS_CURRENT double, AMT_INST_MIN_REGULARITY double, AMT_PAYMENT_TOTAL_CURRENT double, CNT_DRAWINGS_ATM_CURRENT double, CNT_DRAWINGS_CURRENT double, CNT_INSTALMENT_MATURE_CUM double, NAME_CONTRACT_STATUS string, SK_DPD double, SK_DPD_DEF double"
CARDS = [
    (1, 100, -3, 500.0, 1000.0, 100.0, 150.0, 50.0, 50.0, 50.0, 1.0, 2.0, 1.0, "Active", 0.0, 0.0), (1, 100, -2, 1200.0, 1000.0, 0.0, 0.0, 0.0, 60.0, 30.0, 0.0, 0.0, 2.0, "Active", 45.0, 10.0),
    (1, 100, -1, -10.0, 1000.0, None, 0.0, None, 0.0, 0.0, None, 0.0, 3.0, "Completed", 0.0, 0.0), (2, 200, -1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "Active", 0.0, 0.0),
]


def test_credit_card(spark):
    table = credit_card.build(spark.createDataFrame(CARDS, CARD))
    a, b = customer(table, 100, "credit_card"), customer(table, 200, "credit_card")
    assert (a["n_months"], a["n_cards"], a["utilization_latest_mean"], a["balance_latest_mean"], a["dpd_max"], a["missed_min_payment_rate"], a["atm_drawing_month_rate"], a["completed_cards"]) == (3, 1, 0, -10, 45, 0.5, 0.5, 1)
    assert a["utilization_mean"] == pytest.approx(1.7 / 3) and a["utilization_max"] == pytest.approx(1.2) and a["over_limit_rate"] == pytest.approx(1 / 3) and a["severe_dpd_rate"] == pytest.approx(1 / 3)
    assert b["utilization_mean"] is None


POS = "SK_ID_PREV int, SK_ID_CURR int, MONTHS_BALANCE int, CNT_INSTALMENT double, CNT_INSTALMENT_FUTURE double, NAME_CONTRACT_STATUS string, SK_DPD double, SK_DPD_DEF double"
LOANS = [(1, 100, -2, 12.0, 6.0, "Active", 0.0, 0.0), (1, 100, -1, 12.0, 5.0, "Active", 40.0, 0.0), (2, 100, -30, 6.0, 1.0, "Active", 0.0, 0.0), (2, 100, -29, 6.0, 0.0, "Completed", 0.0, 0.0), (3, 200, -1, 4.0, 4.0, "Signed", 0.0, 0.0)]


def test_pos(spark):
    table = pos.build(spark.createDataFrame(LOANS, POS))
    a, b = customer(table, 100, "pos"), customer(table, 200, "pos")
    assert (a["n_months"], a["n_contracts"], a["dpd_positive_rate"], a["recent_dpd_rate"], a["completed_contracts"], a["completed_month_share"], a["months_max"], a["months_min"]) == (4, 2, 0.25, 0.5, 1, 0.25, -1, -30)
    assert a["remaining_share_mean"] == pytest.approx((0.5 + 5 / 12 + 1 / 6) / 4) and b["active_month_share"] == 0


@pytest.mark.parametrize(("builder", "rows", "schema", "column"), [
    (previous.build, APPLIED, PREVIOUS, "DAYS_DECISION"), (installments.build, PAYMENTS, INSTALLMENTS, "DAYS_ENTRY_PAYMENT"), (credit_card.build, CARDS, CARD, "MONTHS_BALANCE"), (pos.build, LOANS, POS, "MONTHS_BALANCE"),
])
def test_future_rows_fail(spark, builder, rows, schema, column):
    df = spark.createDataFrame(rows, schema).withColumn(column, F.when(F.col("SK_ID_CURR") == 200, 1).otherwise(F.col(column)))
    with pytest.raises(Exception, match="offsets after the application"):
        builder(df).collect()


def test_target_never_reaches_builders(spark):
    with pytest.raises(ValueError, match="TARGET"):
        temporal.only_history(credits(spark).withColumn("TARGET", F.lit(1)), "DAYS_CREDIT")


def apps(spark, rows=((300, 1.0, "F"), (100, 2.0, "M"), (200, 3.0, "F"))):
    return spark.createDataFrame(list(rows), "SK_ID_CURR int, AMT_INCOME_TOTAL double, CODE_GENDER string")


def test_assembly(spark):
    tables = {"bureau": bureau.build(credits(spark), months(spark)), "installments": installments.build(spark.createDataFrame(PAYMENTS, INSTALLMENTS))}
    got = {r.SK_ID_CURR: r for r in assemble.build_matrix(apps(spark), tables).collect()}
    assert len(got) == 3 and got[300].bureau__has_history == 0 and got[100].bureau__has_history == 1
    assert got[300].bureau__credit_count == 0 and got[100].bureau__credit_count == 2 and got[300].bureau__credit_sum_mean is None and got[300].installments__n_installments == 0 and got[200].bureau__sold_or_bad_count == 1


def test_assembly_keeps_null_counts_of_customers_with_history(spark):
    table = bureau.build(credits(spark, changed(3, DAYS_CREDIT_UPDATE=10.0)), months(spark))
    got = {r.SK_ID_CURR: r for r in assemble.build_matrix(apps(spark), {"bureau": table}).collect()}
    assert got[200].bureau__has_history == 1 and got[200].bureau__debt_sum_total is None


def test_assembly_rejects(spark):
    table = bureau.build(credits(spark))
    for bad_apps, tables in (
        (apps(spark, ((1, 1.0, "F"), (1, 1.0, "F"))), {"bureau": table}), (apps(spark).withColumn("TARGET", F.lit(0)), {"bureau": table}), (apps(spark), {"nothing": table}),
        (apps(spark), {"bureau": table.withColumnRenamed("bureau__credit_count", "credit_count")}), (apps(spark), {"bureau": table.unionAll(table)}),
    ):
        with pytest.raises(ValueError):
            assemble.build_matrix(bad_apps, tables)


def test_catalog(spark):
    rows = assemble.catalog(spark).collect()
    assert len(rows) == 171 and len({r.column for r in rows}) == 171 and all(r.about for r in rows)
    assert assemble.columns_for(["a", "bureau__x", "pos__y"], ("pos",)) == ["a", "pos__y"]


def test_audits_run(spark):
    b = credits(spark)
    parts = {**audit.audit_bureau(b), **{f"bb_{k}": v for k, v in audit.audit_balance(months(spark), b).items()}, **{f"p_{k}": v for k, v in audit.audit_previous(spark.createDataFrame(APPLIED, PREVIOUS).withColumn("DAYS_TERMINATION", F.lit(365243.0))).items()},
             **{f"i_{k}": v for k, v in audit.audit_installments(spark.createDataFrame(PAYMENTS, INSTALLMENTS)).items()}, **{f"c_{k}": v for k, v in audit.audit_credit_card(spark.createDataFrame(CARDS, CARD)).items()}, **{f"s_{k}": v for k, v in audit.audit_pos(spark.createDataFrame(LOANS, POS)).items()}}
    rows = {k: v.collect() for k, v in parts.items()}
    assert rows["grain"][0].rows == 3 and rows["bb_matched"][0].credits_matched == 2 and rows["anomalies"][0].negative_debt == 1 and rows["p_excluded"][0].n_sentinel == 4 and rows["i_grain"][0].duplicates == 1
    assert math.isclose(rows["i_lateness"][0].share_late, 2 / 6)
