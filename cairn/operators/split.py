"""Stratified splits that any engine can repeat: rows of a class are ordered by a hash of (seed, id), not drawn by a generator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ranking import running_sums
from cairn.sources.tables import ID, TARGET


def split_hash(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string")))


def quotas(counts: dict, size: float) -> dict:
    """Test rows of each class: ceil(n * size) in all, by largest remainder, ties to the smaller label."""
    n = sum(counts.values())
    test = math.ceil(n * size)
    exact = {k: test * c / n for k, c in counts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: test - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, size: float = 0.2, seed: int = 42, id_column: str = ID, target: str = TARGET) -> DataFrame:
    """id, split: the rows of each class with the smallest hashes are test. One row for each id; a repeated id raises."""
    rows = df.select(id_column, F.col(target).alias("_y"), split_hash(id_column, seed).alias("_h"))
    counts = {r._y: r.n for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if None in counts or len(counts) < 2:
        raise ValueError("a stratified split needs labels of two classes at least, none missing")
    if rows.groupBy(id_column).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{id_column} is repeated")
    take = quotas(counts, size)
    place = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double")
    ranked = running_sums(rows.withColumns({"_x": place, "_one": F.lit(1).cast("long")}), ["_y"], "_x", ["_one"])
    quota = F.create_map(*[F.lit(v) for kv in take.items() for v in kv])
    return ranked.select(id_column, F.when(F.col("before__one") < quota[F.col("_y")], "test").otherwise("train").alias("split"))


def check_membership(membership: DataFrame, ids: DataFrame, id_column: str = ID) -> DataFrame:
    """One row of violation counts: duplicate ids, unknown labels, ids of one side alone."""
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    dup = one(membership.groupBy(id_column).count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("duplicate_ids")))
    odd = one(membership.agg(F.coalesce(F.sum((~F.coalesce(F.col("split").isin("train", "test"), F.lit(False))).cast("long")), F.lit(0)).alias("unknown_labels")))
    extra = one(membership.join(ids, id_column, "left_anti").agg(F.count("*").alias("ids_without_data")))
    missing = one(ids.select(id_column).join(membership, id_column, "left_anti").agg(F.count("*").alias("ids_without_split")))
    return dup.join(odd, "_one").join(extra, "_one").join(missing, "_one").drop("_one")


def frozen_split(df: DataFrame, membership: DataFrame, size: float = 0.2, seed: int = 42, id_column: str = ID, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a stored membership, which must be valid and must be what the seed gives again."""
    found = check_membership(membership, df, id_column).first().asDict()
    if any(found.values()):
        raise ValueError(f"membership does not fit the data: {found}")
    again = stratified_split(df, size, seed, id_column, target)
    if again.join(membership.withColumnRenamed("split", "_stored"), id_column).where("split <> _stored").limit(1).collect():
        raise ValueError("the stored membership is not what the seed gives")
    joined = df.join(membership, id_column)
    return joined.where("split = 'train'").drop("split"), joined.where("split = 'test'").drop("split")
