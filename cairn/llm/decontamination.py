"""Benchmark decontamination with a distributed positional inverted index.

A pass over the corpus counts the words of the benchmark. Each window (13 consecutive words of an item; the whole of a
shorter one) is then known by its rarest words. A second pass stores the postings of those words alone: where each
stands and, for the rarest word of a window, the words around it. Posting lists are intersected after subtracting the
word's offset in the window, so a document is a candidate only where all lists agree on one start; the words around
the rarest one then show whether the phrase is there exactly. A proximity match is a posting of a window's rarest word
(of its first place in the window) with every other word within ``slop`` places of its own, but not all in place.

The benchmark is handled in blocks of about ``BLOCK_WORDS`` words, which bounds all that is broadcast; each block
costs its own passes over the corpus.

Defined cases: null and empty texts have no words and are never contaminated; items without words have no windows;
rows that share doc_id and text get the same result, row for row; rows that share only doc_id are judged apart; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import settle, table, text_or_empty, unused
from cairn.llm.words import words

WINDOW, RAREST, BLOCK_WORDS = 13, 2, 200_000
FLUSH = 20_000


def windows_of(text: bytes, size: int = WINDOW) -> set[tuple]:
    ws = words(text)
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))}


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        yield batch, batch.column(column).cast(pa.binary()).to_pylist()


def count_words(docs: DataFrame, vocabulary: set) -> dict:
    """How often each word of a bounded vocabulary stands in the whole corpus."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        found: Counter = Counter()
        keep = known.value.__contains__
        for _, texts in _texts(batches):
            for text in texts:
                found.update(filter(keep, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def plan_search(windows: dict, counts: dict, slop: int = 0) -> tuple[list, dict]:
    """windows: words to items. Rows (window, phrase, rank, ranks, word, offset), and for each word (before, after) to store."""
    rows, around = [], {}
    for n, phrase in enumerate(sorted(windows)):
        first = {w: i for i, w in reversed(list(enumerate(phrase)))}
        if any(w not in counts for w in first):
            continue
        rarest = sorted(first, key=lambda w: (counts[w], w))[:RAREST]
        for rank, w in enumerate(rarest):
            at = first[w]
            rows.append((n, b" ".join(phrase).decode(errors="replace"), len(phrase), rank, len(rarest), w.decode(errors="replace"), at))
            before, after = around.get(w, (0, 0))
            around[w] = (max(before, at + slop), max(after, len(phrase) - 1 - at + slop)) if rank == 0 else (before, after)
    return rows, around


def build_index(docs: DataFrame, around: dict) -> DataFrame:
    """Postings (word, doc_id, doc_key, pos, lead, near), and a row without a word for each document with its length in pos."""
    kept = docs.sparkSession.sparkContext.broadcast(around)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def post(batches):
        around = kept.value
        keep = around.__contains__

        def flush():
            cols = [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)]
            ids = cols[1]
            batch = pa.RecordBatch.from_arrays([cols[0], source.take(ids), *cols[2:]], ["word", "doc_id", "doc_key", "pos", "lead", "near"])
            for c in out:
                c.clear()
            return batch

        for batch, texts in _texts(batches):
            source = batch.column("doc_id")
            keys = batch.column("doc_key").to_pylist()
            out = [[], [], [], [], [], []]
            for i, text in enumerate(texts):
                ws = words(text)
                for c, v in zip(out, (None, i, keys[i], len(ws), 0, None), strict=True):
                    c.append(v)
                for pos, w in enumerate(ws):
                    if keep(w):
                        before, after = around[w]
                        lead = min(before, pos)
                        near = b" ".join(ws[pos - lead : pos + after + 1]).decode(errors="replace")
                        for c, v in zip(out, (w.decode(errors="replace"), i, keys[i], pos, lead, near), strict=True):
                            c.append(v)
                        if len(out[0]) >= FLUSH:
                            yield flush()
            yield flush()

    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("doc_key"))
    return settle(keyed.mapInArrow(post, f"word string, doc_id {doc_type}, doc_key long, pos long, lead int, near string"), "postings")


PLAN_TYPE = "window long, phrase string, n int, rank int, ranks int, word string, offset int"


def _starts(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Every posting of a window's word as the start that it speaks for. The plan is bounded by BLOCK_WORDS."""
    postings = index.where("word IS NOT NULL")
    return postings.join(F.broadcast(plan), "word").withColumn("start", F.col("pos") - F.col("offset"))


def exact_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, doc_key, window, start, n of every exact phrase."""
    agreed = (
        _starts(index, plan).where("start >= 0").groupBy("doc_id", "doc_key", "window", "start")
        .agg(
            F.bit_or(F.expr("shiftleft(1, rank)")).alias("seen"), F.max("ranks").alias("ranks"), F.max("n").alias("n"),
            F.max(F.when(F.col("rank") == 0, F.struct("phrase", "near", "lead", "offset"))).alias("top"),
        )
        .where("seen = shiftleft(1, ranks) - 1")
    )
    there = F.array_join(F.slice(F.split(F.col("top.near"), " "), F.col("top.lead") - F.col("top.offset") + 1, F.col("n")), " ")
    return agreed.where(there == F.col("top.phrase")).select("doc_id", "doc_key", "window", "start", "n")


def proximity_matches(index: DataFrame, plan: DataFrame, slop: int) -> DataFrame:
    """doc_id, doc_key, window, start, distance: the rarest word in its place, all others within ``slop`` of theirs; distance is the largest of these shifts."""
    there, own = F.split("near", " "), F.col("lead") - F.col("offset")
    shift = lambda w, i: F.array_min(F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.when(F.get(there, own + i + d) == w, F.abs(d))))
    found = _starts(index, plan).where("rank = 0").withColumn("shifts", F.transform(F.split("phrase", " "), shift))
    distance = F.when(~F.exists("shifts", lambda x: x.isNull()), F.array_max("shifts"))
    return found.select("doc_id", "doc_key", "window", "start", distance.alias("distance")).where("distance > 0")


def blocks(benchmark: DataFrame, size: int = WINDOW) -> Iterator[dict]:
    """Windows to the ids of their items, one bounded block of items at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * BLOCK_WORDS)))
    for k in range(n):
        windows: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator():
            for phrase in windows_of(r.text.encode(), size):
                windows.setdefault(phrase, set()).add(r.item_id)
        yield windows


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> dict[str, DataFrame]:
    """documents (doc_id, doc_key, n_words), exact (with item_id), and proximity where slop is positive."""
    spark = docs.sparkSession
    found: dict[str, list] = {"exact": [], "proximity": []}
    lengths = None
    for windows in blocks(benchmark, size):
        counts = count_words(docs, {w for phrase in windows for w in phrase}) if windows else {}
        rows, around = plan_search(windows, counts, slop)
        index = build_index(docs, around)
        lengths = lengths or index
        plan = spark.createDataFrame(rows, PLAN_TYPE)
        items = [(n, item) for n, phrase in enumerate(sorted(windows)) for item in sorted(windows[phrase], key=str)]
        items = F.broadcast(spark.createDataFrame(items, "window long, item_id string"))
        found["exact"].append(exact_matches(index, plan).join(items, "window"))
        if slop:
            found["proximity"].append(proximity_matches(index, plan, slop).join(items, "window"))
    out = {}
    for kind, parts in found.items():
        for part in parts:
            out[kind] = out[kind].unionByName(part) if kind in out else part
    return out | {"documents": lengths.where("word IS NULL").select("doc_id", "doc_key", F.col("pos").alias("n_words"))}


def judge(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``."""
    found = search(docs, benchmark, size)
    exact = settle(found["exact"].groupBy("doc_id", "doc_key", "start", "n").agg(F.collect_set("item_id").alias("items")), "phrases")
    before = W.partitionBy("doc_id", "doc_key").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = exact.withColumn("fresh", fresh).groupBy("doc_id", "doc_key").agg(
        F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "n_hit", "items")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return found["documents"].join(hits, same, "left").select(
        "doc_id", "doc_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    id_, key = unused(docs, "id", "key")
    bad = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(id_), F.col("doc_key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(key)), "left_anti")


#: The contract in SQL: every window of every document against the windows of the items.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i + 1 : i + least(len(w), 13)], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, sizes)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (phrase, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
