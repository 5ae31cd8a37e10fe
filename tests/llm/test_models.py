"""Operators with a fitted or an approximate part: held-out accuracy, recall, and the pipeline."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import neighbours, shared, toxicity

from corpus_helpers import more_columns, prose

BAD = ("wretch", "numbskull", "dimwitted")


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        ws, toxic = prose(rnd, 40).split(), i % 5 == 0
        if toxic:
            ws[rnd.randrange(len(ws))] = rnd.choice(BAD) if i % 10 else "zork" + rnd.choice(["a", "ed", "ing", "ish", "ox", "um"])
        texts.append((i, " ".join(ws)))
        labels.append((i, 0, int(toxic)))
    texts += [(1000, "you numbskul of a man"), (1001, "he said the word \"wretch\" is old"), (1002, None), (1003, ""), (1004, "word " * 50000), (0, "a second text of one id")]
    labels += [(0, 0, 0), (5, None, None), (None, 1, 1)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    got = toxicity.judge(more_columns(docs), labels).collect()
    scored = {r.doc_id: r for r in got if r.doc_id != 0}
    held = [r for r in scored.values() if r.doc_id < 600 and r.held_out]
    assert len(held) > 100 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert scored[1000].predicted == 1 and scored[1001].score < scored[5].score and scored[1002].score == scored[1003].score == scored[1004].score < 0.3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").isEmpty() and not kept.where("doc_id = 1002").isEmpty()


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.judge(docs, none).where("predicted = 1").count() in (0, docs.count())
    assert toxicity.judge(docs.limit(0), labels).isEmpty()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, up = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (c != d)))
    return row[-1]


def test_automaton_is_levenshtein():
    rnd = random.Random(4)
    terms = {"abcab": False, "abba": False, "bcabcabca": False, "cab": False, "acac": True}
    lexicon = toxicity.Lexicon(terms)
    lexicon._build()
    for _ in range(4000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
        near = {t: min(distance(word[:n], t) for n in range(len(word) + 1)) if stem else distance(word, t) for t, stem in terms.items()}
        best = min((e for t, e in near.items() if e <= lexicon.edits(t)), default=None)
        found = lexicon.match(word)
        assert (found and found[1]) == best and (not found or near[found[0]] == best)


def vectors(spark, n=3000, dim=24):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim))
    x[10:60] = x[10]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, [float("nan")] * dim), (n + 3, [None] + [1.0] * (dim - 1)), (n + 4, []), (n + 5, [float("inf")] * dim), (None, rows[3][1]), (7, rows[7][1]), (n + 20, [1.0, 2.0])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_neighbours(spark):
    x, df = vectors(spark)
    got = neighbours.nearest(neighbours.valid(more_columns(df)), F.col("key") % 20 == 0)
    by = {}
    for r in got.collect():
        by.setdefault(r.query, []).append((r["rank"], r.key, r.score))
    hit = 0
    assert sorted(by) == list(range(0, 3000, 20))
    for q, found in by.items():
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(s == pytest.approx(scores[k], abs=1e-12) for _, k, s in found) and all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:], strict=False))
        hit += len(set(best.tolist()) & {k for _, k, _ in found})
    assert hit / (20 * len(by)) >= 0.9
    assert [k for _, k, _ in by[20]][:20] == [k for k in range(10, 31) if k != 20][:20]


def test_few_and_no_neighbours(spark):
    _, df = vectors(spark)
    few = neighbours.nearest(neighbours.valid(df.where("vec_id IN (20, 3020, 5)")), F.col("key") % 20 == 0).collect()
    assert [(r.query, r.key) for r in few] == [(20, 5)]
    assert neighbours.nearest(neighbours.valid(df.limit(0)), F.col("key") % 20 == 0).isEmpty()


def test_pipeline(spark, tmp_path, monkeypatch):
    rnd = random.Random(3)
    item = prose(rnd, 60, 5000)
    docs = [(i, prose(rnd, 60, 3000), "en", f"s{i % 2}", 1) for i in range(120)]
    docs += [(200, docs[3][1], "en", "s0", 1), (201, docs[4][1] + " more", "en", "s0", 1), (202, item, "en", "s1", 1), (203, None, "en", None, 0), (204, "", "en", "s0", 0)]
    docs += [(300 + i, prose(rnd, 30, 3000) + " wretch", "en", "s0", 1) for i in range(40)]
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(d[0], 1, int(d[0] >= 300)) for d in docs], "doc_id long, quality int, toxic int"), "benchmark": ([(1, item)], "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == [c for c in tables["documents"][1].replace(" long", "").replace(" string", "").split(", ")]
        out.write.parquet(f"{tmp_path}/out-{name}")
        kept = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = sorted(r.doc_id for r in kept.select("doc_id").collect())
    clean = set(range(120)) | {203, 204}
    assert seen["toxicity"] == sorted(clean | {200, 201, 202})
    assert seen["ngram_jaccard_join"] == sorted(clean | {202})
    assert seen["benchmark_decontamination"] == sorted(clean)
    assert seen["sharding"] == seen["mixing"] and set(seen["mixing"]) <= clean and max(map(seen["mixing"].count, set(seen["mixing"]))) <= 2
    with monkeypatch.context() as patched:
        patched.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["sharding"])
    left = {p.name.rpartition("-")[0] for p in (tmp_path / "shared").glob("*/*")}
    assert {n for n in left if n.startswith("pipeline-")} == {"pipeline-mixing"} and not left & {"edges", "sketches", "postings", "links"}


@pytest.mark.parametrize("n", [200, 500, 2000, 6000])
def test_recall_of_unit_vectors(n):
    """Directions without any structure, the hardest case: recall is over 0.9 and far over what as many rows drawn at random would give."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, asked, hit = np.arange(n), np.arange(0, n, max(1, n // 50)), 0
    for at, found, _ in neighbours.Forest(x, stored=neighbours.Forest(x).stored()).search(x[asked], ids, asked, 20):
        scores = x @ x[asked[at]]
        scores[asked[at]] = -np.inf
        hit += len(set(np.argsort(-scores)[:20]) & set(found))
    drawn = min(1.0, neighbours.WIDTH * (20 / n) ** 0.5)
    assert hit / (20 * len(asked)) >= max(0.92, min(0.96, 2.5 * drawn))


def test_neighbours_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    known = {r.key: np.array(r.vector) for r in neighbours.valid(table).collect()}
    keys, x = np.array(sorted(known)), np.array([known[k] for k in sorted(known)])
    by = {}
    for r in neighbours.op4_neighbours(spark, "/root/testdata/sf0.01").collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == [k for k in keys if k % 20 == 0]
    hit = 0
    for q, found in by.items():
        scores = (x * known[q]).sum(1)
        scores[keys == q] = -np.inf
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(s == scores[keys == k][0] for _, k, s in found)
        hit += len(set(keys[np.argsort(-scores, kind="stable")[:20]]) & {k for _, k, _ in found})
    assert hit / (20 * len(by)) >= 0.9


FOREIGN = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
for name in ("op1_secrets", "op3_warc", "op4_neighbours", "op5_toxicity", "op6_decontamination", "op8_ngram_join", "pipeline"):
    print("ROWS", name, queries[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """All queries that use Python workers, from a folder and with a path in which the package is not found."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", FOREIGN, repo], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("ROWS")}
    assert len(rows) == 7 and rows["op1_secrets"] == rows["op5_toxicity"] == rows["op6_decontamination"] == rows["op8_ngram_join"] == 200 and all(rows.values())
