"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Lamping and Veach's jump hash follows one stream of draws for each key. The key sits in shard ``b``; the next draw
says at how many shards it would move on, and the last place below the shard count is the shard. Here draw ``i`` is
taken from MD5 of ``key:i``, so that any SQL engine repeats it.

Defined cases: a null key is the empty key; equal keys meet in one shard; null text has size 1 and CRC-32 0; an empty
table gives an empty table. Rows that are alike in every column get different slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import hex_draw, table, text_or_empty

#: Steps tried for every key; the few keys that need more (about one in 10^20 at 10^6 shards) take the long loop.
SHORT = 64
#: Each shard is numbered in this many pieces, so that no task sorts a whole shard.
PIECES = 256
#: Rows of the table of piece offsets up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000


def _jumps(key: Column, shards: int, start: Column, first: int, last: int) -> Column:
    def step(at: Column, i: Column) -> Column:
        draw = F.floor(hex_draw(F.concat(key, F.lit(":"), i.cast("string"))) / F.lit(2))
        further = F.floor((at["next"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (draw + F.lit(1)).cast("double")))
        moved = F.struct(at["next"].alias("shard"), further.alias("next"))
        return F.when(at["next"] < F.lit(shards), moved).otherwise(at)

    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), start, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of ``key`` (any type; hashed as text) among ``shards``, from 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("string"), F.lit(""))
    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    at = _jumps(key, shards, start, 0, min(shards, SHORT))
    if shards > SHORT:
        at = F.when(at["next"] >= F.lit(shards), at).otherwise(_jumps(key, shards, at, SHORT + 1, shards))
    return at["shard"].cast("int")


def assign(df: DataFrame, shards: int, key: str = "doc_id", to: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(to, jump_shard(F.col(key), shards))


def number_rows(df: DataFrame, shards: int, shard: str, key: str, ties: list[str], to: str = "slot") -> DataFrame:
    """Gapless positions from 0 in each shard, by piece of the key's hash, then key, then ``ties``.

    Two levels: rows are numbered within ``PIECES`` pieces of a shard, and a piece starts where the pieces before it
    end. Only counts of pieces meet in one place.
    """
    piece = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 2)
    rows = df.withColumn("_piece", piece)
    ends = W.partitionBy(shard).orderBy("_piece")
    starts = (
        rows.groupBy(shard, "_piece").count()
        .withColumn("_start", F.sum("count").over(ends) - F.col("count")).drop("count")
    )
    if shards * PIECES <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    order = W.partitionBy(shard, "_piece").orderBy(key, *ties)
    numbered = rows.withColumn("_in_piece", F.row_number().over(order) - F.lit(1))
    return numbered.join(starts, [shard, "_piece"]).withColumn(to, (F.col("_start") + F.col("_in_piece")).cast("long")).drop("_piece", "_start", "_in_piece")


def manifest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One narrow row for each document: where it goes now and with one more shard, its slot, size and checksum."""
    text = text_or_empty()
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    placed = number_rows(narrow, shards, "shard", "doc_id", ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), 16)


def _jump_sql(shards: int) -> str:
    """The same walk as nested subqueries, one for each possible move."""
    sql = "SELECT *, CAST(-1 AS BIGINT) AS b0, CAST(0 AS BIGINT) AS j0 FROM docs"
    for i in range(shards + 2):
        draw = f"floor(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{i}'), 1, 8) AS BIGINT) / 2)"
        sql = (
            f"SELECT * EXCLUDE (b0, j0), CASE WHEN j0 < {shards} THEN j0 ELSE b0 END AS b0, CASE WHEN j0 < {shards} THEN "
            f"CAST(floor((j0 + 1)::DOUBLE * (2147483648.0::DOUBLE / ({draw} + 1)::DOUBLE)) AS BIGINT) ELSE j0 END AS j0 FROM ({sql})"
        )
    return sql


#: CRC-32 by its bytewise rule: the table comes from the reversed polynomial 0xEDB88320.
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
narrow AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce([4294967295] || list_transform(range(1, 2 * strlen(text), 2), lambda i: CAST('0x' || substr(hex(encode(text)), i, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS BIGINT) AS text_crc32
  FROM docs, crc_table),
now AS (SELECT doc_id, min(b0) AS shard FROM ({_jump_sql(16)}) GROUP BY doc_id),
grown AS (SELECT doc_id, min(b0) AS grown_shard FROM ({_jump_sql(17)}) GROUP BY doc_id)
SELECT n.doc_id, n.size, n.text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(n.doc_id AS VARCHAR), '')), 1, 2), n.doc_id NULLS FIRST, n.size, n.text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM narrow n JOIN now ON n.doc_id IS NOT DISTINCT FROM now.doc_id JOIN grown ON n.doc_id IS NOT DISTINCT FROM grown.doc_id
"""
