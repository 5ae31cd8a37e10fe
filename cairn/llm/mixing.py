"""Mixing sources to target weights by Efraimidis-Spirakis sampling under word budgets.

Each source is due a share of the mix by its weight; a target stops at ``cap`` times what the source holds, and the
excess goes to the others by weight. A source gives ``floor(target / held)`` complete epochs, then a weighted sample
without replacement: document keys are ``-ln(u) / quality``, taken in ascending order until the words of the budget
are spent. The document on the edge is taken if at least half of it fits, so a source ends within half a document of
its target.

The order within a source is never sorted whole. Keys fall into ``BINS`` bins of ``exp(-key)``; bins that fit in the
budget as a whole are taken, and only the bin on the edge is sorted and prefix-summed.

Defined cases: null text and text of separators alone have size 0 and are taken in no amount; null source is a source
of its own, last; a null, non-positive or missing quality is 1; ties of keys go by doc_id, size and checksum; an empty
table gives an empty table. Rows that are alike in every column share one draw but are counted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import hex_draw, settle, table, text_or_empty, unused

WEIGHTS = (5, 2, 1)
SHARE, CAP, BINS = 1.5, 2, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: water-filling in closed form over one row for each source.

    Sources fill up in the order of cap over weight. With the k fullest capped, the level of the others is what is
    left by their weight; k is the first at which that level stays under the next cap, which is also the highest such.
    """
    held = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = held.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    filled = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = filled.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = named.select(
        "*", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_full"),
        F.coalesce(F.sum("_w").over(before), F.lit(0.0)).alias("_w_full"),
        F.sum("_w").over(everything).alias("_w_all"), F.sum("source_size").over(everything).alias("_all"),
    ).withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.col("_full")) / (F.col("_w_all") - F.col("_w_full")))
    fits = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    water = level.withColumn("_water", fits)
    due = F.when(F.col("_water").isNull() | (F.col("_water") * F.col("_w") > F.col("_cap")), F.col("_cap")).otherwise(F.col("_water") * F.col("_w"))
    return water.select("source", "source_size", due.alias("target"))


def draws(docs: DataFrame, quality: DataFrame | None, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, crc, key, bin: the narrow table that all later steps read.

    quality: doc_id and weight, one row for each doc_id.
    """
    text = text_or_empty()
    sized = docs.select("doc_id", "source", word_count(text).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    if quality is not None:
        sized = sized.join(quality.select("doc_id", F.col("weight").cast("double").alias("_q")), "doc_id", "left")
    else:
        sized = sized.withColumn("_q", F.lit(1.0))
    u = (hex_draw(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("crc").cast("string")), 12) + F.lit(0.5)) / F.lit(float(2**48))
    key = -F.log(u) / F.when(F.col("_q") > 0, F.col("_q")).otherwise(F.lit(1.0))
    keyed = sized.withColumn("key", key)
    return keyed.withColumn("bin", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(BINS)).cast("int")).drop("_q")


def take(keyed: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, crc, source_size, target, copies: how often the mix holds each row of ``draws``."""
    sums = keyed.groupBy("source", "bin").agg(F.sum("size").alias("_bin_size"))
    targets = source_targets(sums.withColumnRenamed("_bin_size", "size"), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.col("target") - F.col("_epochs") * F.col("source_size")
    plan = targets.withColumn("_epochs", epochs).withColumn("_budget", budget)
    up_to = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = (
        sums.withColumn("_before", F.sum("_bin_size").over(up_to) - F.col("_bin_size"))
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("_place", F.when(F.col("_before") >= F.col("_budget"), 2).when(F.col("_before") + F.col("_bin_size") <= F.col("_budget"), 0).otherwise(1))
        .select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "source_size", "target", "_epochs", "_budget", "_before", "_place")
    )
    rows = keyed.join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).drop("_s", "_b")
    order = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "crc").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.where("_place = 1").withColumn("_to", F.col("_before") + F.sum("size").over(order))
    edge = edge.withColumn("_extra", (F.col("_to") - F.col("size") * F.lit(0.5) <= F.col("_budget")).cast("long")).drop("_to")
    whole = rows.where("_place <> 1").withColumn("_extra", (F.col("_place") == 0).cast("long"))
    out = whole.unionByName(edge)
    return out.select("doc_id", "source", "size", "crc", "source_size", "target", (F.col("_epochs") + F.col("_extra")).alias("copies"))


def label_quality(labels: DataFrame) -> DataFrame:
    """Documents labelled as good weigh twice as much as others; the best label counts where there are several."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.lit(1.0) + F.coalesce(F.max("quality"), F.lit(0))).alias("weight"))


def mix(docs: DataFrame, quality: DataFrame | None) -> DataFrame:
    return take(settle(draws(docs, quality), "mix"))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (a result of ``mix`` of them) holds them, with their columns alone.

    Rows that share doc_id, source and text are told apart by count only: their copies are pooled and dealt evenly.
    Documents of size 0 cost no budget and come and go by their keys alone.
    """
    key = ["doc_id", "source", "crc"]
    held_id, held_source, held_crc, copies, n_rows, nth, times, time = unused(docs, "doc_id", "source", "crc", "copies", "rows", "nth", "times", "time")
    pooled = mixed.groupBy(*key).agg(F.sum("copies").alias(copies), F.count("*").alias(n_rows)).where(F.col(copies) > 0)
    pooled = pooled.select(*[F.col(c).alias(name) for c, name in zip(key, (held_id, held_source, held_crc), strict=True)], copies, n_rows)
    crc = F.crc32(text_or_empty().cast("binary"))
    same = F.col("doc_id").eqNullSafe(F.col(held_id)) & F.col("source").eqNullSafe(F.col(held_source)) & (crc == F.col(held_crc))
    held = docs.join(pooled.hint("shuffle_hash"), same)
    alike = W.partitionBy(held_id, held_source, held_crc).orderBy(F.lit(1))
    if mixed.groupBy(*key).count().where("count > 1").isEmpty():
        due = F.col(copies)
    else:
        held = held.withColumn(nth, F.row_number().over(alike))
        due = F.floor(F.col(copies) / F.col(n_rows)) + (F.col(nth) <= F.col(copies) % F.col(n_rows)).cast("long")
    held = held.withColumn(times, due).where(F.col(times) > 0)
    return held.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(time)).drop(time)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH sized AS (
  SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size,
    1.0 + coalesce(quality, 0) AS q, md5(coalesce(text, '')) AS h, coalesce(text, '') AS text
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
keyed AS (
  SELECT doc_id, source, size, crc, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / q::DOUBLE AS key
  FROM (SELECT *, CAST(xor(list_reduce([4294967295] || list_transform(range(1, 2 * strlen(text), 2), lambda i: CAST('0x' || substr(hex(encode(text)), i, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS BIGINT) AS crc FROM sized, crc_table)),
held AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM keyed GROUP BY source),
level AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM held WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
due AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR water * w > cap THEN cap ELSE water * w END AS target
  FROM (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS water FROM level)),
run AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size, crc ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN due ON k.source IS NOT DISTINCT FROM due.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - 0.5::DOUBLE * size <= target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
