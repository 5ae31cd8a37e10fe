import importlib
import json
import os
import subprocess
import sys

import pytest

from cairn.functions import canonical_missing, clip_high, clip_low, latest, level_map
from cairn.operators import bureau, provenance
from cairn.sources import sinks, tables


def test_null_rules(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, -3.0), (3, 9.0)], "i int, x double")
    assert [r[0] for r in df.orderBy("i").select(clip_low(F.col("x"))).collect()] == [None, 0, 9]
    assert [r[0] for r in df.orderBy("i").select(clip_high(F.col("x"), 5.0)).collect()] == [None, -3, 5]
    assert df.agg(latest(F.col("x"), -F.col("i")).alias("v")).first().v is None
    assert [r[0] for r in df.orderBy("i").select(level_map(F.col("x"), {9.0: "a"}, "b")).collect()] == ["b", "b", "a"]
    odd = spark.createDataFrame([(float("nan"), "NA"), (1.0, "XNA")], "x double, s string")
    assert [tuple(r) for r in canonical_missing(odd).collect()] == [(None, None), (1.0, "XNA")]


def test_csv_scan(spark, tmp_path):
    spec = tables.TABLES["bureau_balance"]
    (tmp_path / spec.file).write_text("SK_ID_BUREAU,MONTHS_BALANCE,STATUS,MORE\n1,0,C,x\n1,-1,,y\n2,NA,0,z\n")
    rows = [tuple(r) for r in tables.read_table(spark, "bureau_balance", str(tmp_path)).collect()]
    assert rows == [(1, 0, "C"), (1, -1, None), (2, None, "0")] and tables.count_rows(spark, "bureau_balance", str(tmp_path)) == 3
    assert tables.verify_table(spark, "bureau_balance", str(tmp_path))["rows"] == 3 and tables.read_table(spark, "bureau_balance", str(tmp_path), rows=1).count() == 1
    (tmp_path / spec.file).write_text("SK_ID_BUREAU,STATUS\n1,C\n")
    with pytest.raises(ValueError, match="MONTHS_BALANCE"):
        tables.read_table(spark, "bureau_balance", str(tmp_path))
    with pytest.raises(tables.MissingTable):
        tables.read_table(spark, "bureau", str(tmp_path))


def test_application_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SK_ID_CURR,TARGET,X\n1,0,NA\n2,1,5\n")
    df = tables.read_application(spark, str(tmp_path / "a.csv"), columns=["X"])
    assert df.columns == ["SK_ID_CURR", "TARGET", "X"] and df.count() == 2
    features, labels = tables.split_target(df)
    assert "TARGET" not in features.columns and labels.columns == ["SK_ID_CURR", "TARGET"]
    with pytest.raises(KeyError):
        tables.split_target(features)
    (tmp_path / "b.csv").write_text("SK_ID_CURR,X\n1,0\n")
    with pytest.raises(ValueError, match="TARGET"):
        tables.read_application(spark, str(tmp_path / "b.csv"))


def test_json_sink(tmp_path):
    import numpy as np

    path = sinks.publish_json({"a": np.float64("nan"), "b": {3, 1}, "c": np.int64(2)}, tmp_path / "x" / "m.json")
    assert json.loads(path.read_text()) == {"a": None, "b": [1, 3], "c": 2} and [p.name for p in path.parent.iterdir()] == ["m.json"]


def test_cache(spark, tmp_path):
    table = spark.createDataFrame([(1, 0.5), (2, None)], "SK_ID_CURR int, x float")
    raw, builder, at = {"f.csv": {"bytes": 1, "sha256": "0"}}, provenance.builder_signature([bureau]), tmp_path / "m.json"
    assert not provenance.is_cached(table, at, raw, builder)
    provenance.register(table, at, raw, builder)
    assert provenance.is_cached(table.repartition(3), at, raw, builder)
    for t, r, b, n in ((table, {}, builder, None), (table, raw, {}, None), (table, raw, builder, 5), (table.limit(1), raw, builder, None), (table.selectExpr("SK_ID_CURR", "cast(1 as float) as x"), raw, builder, None)):
        with pytest.raises(ValueError):
            provenance.validate(t, at, r, b, n)
    at.write_text("{")
    with pytest.raises(ValueError):
        provenance.validate(table, at, raw, builder)
    with pytest.raises(ValueError):
        provenance.table_schema(table.unionAll(table))


def test_checkpoint(tmp_path):
    f, at = tmp_path / "data", tmp_path / "c.json"
    f.write_text("1")
    assert provenance.load_checkpoint(at, {"seed": 1}, [f]) is None
    provenance.save_checkpoint(at, {"seed": 1}, [f], {"done": 3})
    assert provenance.load_checkpoint(at, {"seed": 1}, [f]) == {"done": 3}
    f.write_text("2")
    with pytest.raises(ValueError):
        provenance.load_checkpoint(at, {"seed": 1}, [f])


def test_entry_without_the_corpus_operators(tmp_path):
    """The library's own queries stand when the corpus package and its pipeline are gone."""
    import shutil

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/cairn", tmp_path / "cairn", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_queries_have_names_and_oracles():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_zipped_file(tmp_path):
    import zipfile

    from cairn.sources.archives import extract_if_zipped

    with zipfile.ZipFile(tmp_path / "a.csv.zip", "w") as z:
        z.writestr("a.csv", "x\n1\n")
    assert extract_if_zipped(tmp_path / "a.csv").read_text() == "x\n1\n" and not (tmp_path / "a.csv.zip").exists()
    with zipfile.ZipFile(tmp_path / "b.csv.zip", "w") as z:
        z.writestr("other.csv", "")
    for missing in ("b.csv", "c.csv"):
        with pytest.raises(FileNotFoundError):
            extract_if_zipped(tmp_path / missing)
