"""Previous applications, to one row for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import is_one_of, keep_where, plain_flag, safe_ratio
from cairn.operators.features import Feature, aggregate, family, finish, with_ratios
from cairn.operators.temporal import require_history

SOURCE, RECENT_DAYS = "previous", 365
LAST = "DAYS_DECISION SK_ID_PREV"

FEATURES: tuple[Feature, ...] = (
    *family("counts", ("count", "size"), ("approved_count", "sum", "approved"), ("refused_count", "sum", "refused"), ("canceled_count", "sum", "canceled"), ("unused_offer_count", "sum", "unused")),
    *family(
        "rates", ("approval_rate", "ratio", "approved_count", "count"), ("refusal_rate", "ratio", "refused_count", "count"), ("cancellation_rate", "ratio", "canceled_count", "count"),
        ("last_application_refused", "latest", "refused", LAST), ("last_application_approved", "latest", "approved", LAST),
    ),
    *family("recency", ("decisions_last_year", "sum", "recent"), ("days_decision_max", "max", "DAYS_DECISION"), ("days_decision_min", "min", "DAYS_DECISION"), ("days_decision_mean", "mean", "DAYS_DECISION")),
    *family(
        "amounts", ("amt_application_mean", "mean", "amt_application_pos"), ("amt_application_max", "max", "AMT_APPLICATION"), ("amt_credit_approved_mean", "mean", "amt_credit_approved"), ("amt_credit_approved_max", "max", "amt_credit_approved"),
        ("amt_credit_approved_sum", "sum", "amt_credit_approved"), ("amt_annuity_approved_mean", "mean", "amt_annuity_approved"), ("amt_goods_price_mean", "mean", "AMT_GOODS_PRICE"), ("amt_down_payment_mean", "mean", "AMT_DOWN_PAYMENT"),
        ("rate_down_payment_mean", "mean", "RATE_DOWN_PAYMENT"), ("credit_to_application_ratio_mean", "mean", "credit_to_application"),
    ),
    *family("terms", ("cnt_payment_approved_mean", "mean", "cnt_payment_approved"), ("cnt_payment_approved_max", "max", "cnt_payment_approved")),
    *family(
        "products", ("cash_loan_share", "mean", "cash_loan"), ("consumer_loan_share", "mean", "consumer_loan"), ("revolving_loan_share", "mean", "revolving_loan"), ("portfolio_pos_share", "mean", "portfolio_pos"),
        ("portfolio_cash_share", "mean", "portfolio_cash"), ("portfolio_cards_share", "mean", "portfolio_cards"), ("x_sell_share", "mean", "x_sell"), ("walk_in_share", "mean", "walk_in"), ("yield_high_share", "mean", "yield_high"),
        ("yield_low_share", "mean", "yield_low"), ("client_new_share", "mean", "client_new"), ("insured_rate", "mean", "NFLAG_INSURED_ON_APPROVAL"),
    ),
    *family("rejections", ("reject_hc_count", "sum", "reject_hc"), ("reject_limit_count", "sum", "reject_limit"), ("reject_scoring_count", "sum", "reject_scoring")),
)

# Fixed values: (flag, column, levels).
LEVEL_FLAGS = (
    ("approved", "NAME_CONTRACT_STATUS", ("Approved",)), ("refused", "NAME_CONTRACT_STATUS", ("Refused",)), ("canceled", "NAME_CONTRACT_STATUS", ("Canceled",)), ("unused", "NAME_CONTRACT_STATUS", ("Unused offer",)),
    ("cash_loan", "NAME_CONTRACT_TYPE", ("Cash loans",)), ("consumer_loan", "NAME_CONTRACT_TYPE", ("Consumer loans",)), ("revolving_loan", "NAME_CONTRACT_TYPE", ("Revolving loans",)),
    ("portfolio_pos", "NAME_PORTFOLIO", ("POS",)), ("portfolio_cash", "NAME_PORTFOLIO", ("Cash",)), ("portfolio_cards", "NAME_PORTFOLIO", ("Cards",)), ("x_sell", "NAME_PRODUCT_TYPE", ("x-sell",)), ("walk_in", "NAME_PRODUCT_TYPE", ("walk-in",)),
    ("yield_high", "NAME_YIELD_GROUP", ("high",)), ("yield_low", "NAME_YIELD_GROUP", ("low_normal", "low_action")), ("client_new", "NAME_CLIENT_TYPE", ("New",)),
)
REJECT_FLAGS = (("reject_hc", ("HC",)), ("reject_limit", ("LIMIT",)), ("reject_scoring", ("SCO", "SCOFR")))


def derive(previous: DataFrame) -> DataFrame:
    """Row-level columns. Product and status flags are plain, so shares divide by all rows."""
    rows = previous.withColumns({name: is_one_of(F.col(c), *levels) for name, c, levels in LEVEL_FLAGS})
    approved, refused = F.col("approved") == 1, F.col("refused") == 1
    return rows.withColumns({
        "recent": plain_flag(F.col("DAYS_DECISION") >= -RECENT_DAYS), "amt_application_pos": keep_where(F.col("AMT_APPLICATION") > 0, F.col("AMT_APPLICATION")),
        "amt_credit_approved": keep_where(approved, F.col("AMT_CREDIT")), "amt_annuity_approved": keep_where(approved, F.col("AMT_ANNUITY")), "cnt_payment_approved": keep_where(approved, F.col("CNT_PAYMENT")),
        "credit_to_application": safe_ratio(F.col("AMT_CREDIT"), F.col("AMT_APPLICATION")), **{name: plain_flag(refused & F.col("CODE_REJECT_REASON").isin(*codes)) for name, codes in REJECT_FLAGS},
    })


def build(previous: DataFrame) -> DataFrame:
    rows = derive(require_history(previous, "DAYS_DECISION"))
    return finish(with_ratios(aggregate(rows, FEATURES), FEATURES), SOURCE, FEATURES)
