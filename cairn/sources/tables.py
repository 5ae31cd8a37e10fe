"""Registry of the raw tables and typed scans of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import canonical_missing

ID, TARGET = "SK_ID_CURR", "TARGET"


@dataclass(frozen=True)
class TableSpec:
    """A raw table: its file, key, and the columns that features read, with their types."""

    name: str
    file: str
    keys: tuple[str, ...]
    columns: dict[str, str]
    audit_only: tuple[str, ...] = ()

    def schema(self, names: list[str] | None = None) -> T.StructType:
        return T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in self.columns.items() if names is None or c in names))


def _cols(ints: str = "", shorts: str = "", floats: str = "", strings: str = "") -> dict[str, str]:
    return {c: t for names, t in ((ints, "int"), (shorts, "short"), (floats, "float"), (strings, "string")) for c in names.split()}


# Names and types of the raw columns.
TABLES = {
    s.name: s
    for s in (
        TableSpec("bureau", "bureau.csv", ("SK_ID_BUREAU",), _cols(
            "SK_ID_CURR SK_ID_BUREAU", "",
            "DAYS_CREDIT CREDIT_DAY_OVERDUE DAYS_CREDIT_ENDDATE DAYS_ENDDATE_FACT AMT_CREDIT_MAX_OVERDUE CNT_CREDIT_PROLONG AMT_CREDIT_SUM AMT_CREDIT_SUM_DEBT AMT_CREDIT_SUM_LIMIT AMT_CREDIT_SUM_OVERDUE DAYS_CREDIT_UPDATE AMT_ANNUITY",
            "CREDIT_ACTIVE CREDIT_TYPE")),
        TableSpec("bureau_balance", "bureau_balance.csv", ("SK_ID_BUREAU", "MONTHS_BALANCE"), _cols("SK_ID_BUREAU", "MONTHS_BALANCE", "", "STATUS")),
        TableSpec("previous", "previous_application.csv", ("SK_ID_PREV",), _cols(
            "SK_ID_PREV SK_ID_CURR", "",
            "AMT_ANNUITY AMT_APPLICATION AMT_CREDIT AMT_DOWN_PAYMENT AMT_GOODS_PRICE RATE_DOWN_PAYMENT DAYS_DECISION CNT_PAYMENT NFLAG_INSURED_ON_APPROVAL DAYS_FIRST_DRAWING DAYS_FIRST_DUE DAYS_LAST_DUE_1ST_VERSION DAYS_LAST_DUE DAYS_TERMINATION",
            "NAME_CONTRACT_TYPE NAME_CONTRACT_STATUS CODE_REJECT_REASON NAME_CLIENT_TYPE NAME_PORTFOLIO NAME_PRODUCT_TYPE NAME_YIELD_GROUP"),
            ("DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE", "DAYS_TERMINATION")),
        TableSpec("installments", "installments_payments.csv", ("SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION"), _cols(
            "SK_ID_PREV SK_ID_CURR", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION DAYS_INSTALMENT DAYS_ENTRY_PAYMENT AMT_INSTALMENT AMT_PAYMENT")),
        TableSpec("credit_card", "credit_card_balance.csv", ("SK_ID_PREV", "MONTHS_BALANCE"), _cols(
            "SK_ID_PREV SK_ID_CURR", "MONTHS_BALANCE",
            "AMT_BALANCE AMT_CREDIT_LIMIT_ACTUAL AMT_DRAWINGS_ATM_CURRENT AMT_DRAWINGS_CURRENT AMT_DRAWINGS_POS_CURRENT AMT_INST_MIN_REGULARITY AMT_PAYMENT_TOTAL_CURRENT CNT_DRAWINGS_ATM_CURRENT CNT_DRAWINGS_CURRENT CNT_INSTALMENT_MATURE_CUM SK_DPD SK_DPD_DEF",
            "NAME_CONTRACT_STATUS")),
        TableSpec("pos", "POS_CASH_balance.csv", ("SK_ID_PREV", "MONTHS_BALANCE"), _cols(
            "SK_ID_PREV SK_ID_CURR", "MONTHS_BALANCE", "CNT_INSTALMENT CNT_INSTALMENT_FUTURE SK_DPD SK_DPD_DEF", "NAME_CONTRACT_STATUS")),
    )
}


class MissingTable(FileNotFoundError):
    """A raw table is not where it should be."""


def _load(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    try:
        if path.endswith(".csv"):
            reader = spark.read.option("header", True)
            return reader.csv(path, inferSchema=True) if schema is None else reader.option("enforceSchema", False).csv(path)
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise MissingTable(f"{path} is missing or empty; put the raw tables there first") from e
        raise


def read_table(spark: SparkSession, name: str, raw_dir: str, rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A typed scan of a registered table: only its columns, missing texts and NaN as null.

    rows: only so many, by key order, for smoke runs.
    """
    spec = TABLES[name]
    wanted = {c: t for c, t in spec.columns.items() if columns is None or c in columns}
    raw = _load(spark, f"{raw_dir}/{spec.file}", spec.schema())
    if gone := set(wanted) - set(raw.columns):
        raise ValueError(f"{spec.file} has no {sorted(gone)}")
    typed = canonical_missing(raw.select(*wanted)).select(*[F.expr(f"try_cast({c} AS {t})").alias(c) for c, t in wanted.items()])
    return typed if rows is None else typed.orderBy(*[k for k in spec.keys if k in wanted]).limit(rows)


def read_application(spark: SparkSession, path: str, columns: list[str] | None = None, required: tuple[str, ...] = (ID, TARGET), rows: int | None = None) -> DataFrame:
    """The application table; required columns are always read, and must be there."""
    raw = _load(spark, path, None)
    if gone := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} has no {gone}")
    wanted = raw.columns if columns is None else list(dict.fromkeys([*required, *columns]))
    if gone := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"{path} has no {gone}")
    table = canonical_missing(raw.select(*wanted))
    if table.isEmpty():
        raise ValueError(f"{path} has no rows")
    return table if rows is None else table.orderBy(required[0]).limit(rows)


def split_target(df: DataFrame, id_column: str = ID, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """(features with the id, labels by id). The id stays as the key that takes the place of a row index."""
    if target not in df.columns:
        raise KeyError(target)
    return df.drop(target), df.select(id_column, target)


def count_rows(spark: SparkSession, name: str, raw_dir: str) -> int:
    spec = TABLES[name]
    return read_table(spark, name, raw_dir, columns=[spec.keys[0]]).count()


def verify_table(spark: SparkSession, name: str, raw_dir: str) -> dict:
    """Reads the header and counts rows; raises where the table is missing, empty or lacks columns."""
    spec = TABLES[name]
    found = read_table(spark, name, raw_dir)
    n = found.count()
    if not n:
        raise ValueError(f"{spec.file} has no rows")
    return {"table": name, "file": spec.file, "columns": len(found.columns), "rows": n}


def verify_tables(spark: SparkSession, raw_dir: str, names: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([verify_table(spark, n, raw_dir) for n in names or TABLES])


def verify_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.avg(target).alias("prevalence"))
