"""N-gram Jaccard join with Bayesian candidate pruning.

A text's set is its runs of five words (a shorter text is one run). Texts with equal sets are one key. Keys that share
one of ``BANDS`` bands of ``ROWS`` MinHash values are candidates; a pair at the threshold shares none with a
probability of 3 in a million. Candidate keys are gathered by connected components of the star graph of the bands,
and each component is compared in tasks of bounded size: small components are packed together, a large one is cut
into blocks and every two blocks meet in one task. Within a task a pair is looked at in the first band that it
shares. Its MinHash values are compared ``STEP`` at a time; under a uniform prior the pair is dropped once the
posterior probability that its similarity reaches the threshold is below ``TOLERANCE``. What is left is verified on
the sets themselves. A task counts links and joins linked keys into a forest, so no table ever holds all the pairs of
a group.

A class is a connected component of links; its id is its smallest doc_id. Links count documents: other rows with an
equal set, and all rows of linked keys.

Defined cases: texts without words (null and empty ones too) link to nothing and are classes of their own; repeated
rows are copies of one another; rows that share doc_id but not text are separate documents; a null doc_id never names
a class unless all of the class are null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import discard, join_per_key, settle, table, text_or_empty, unused
from cairn.llm.words import words

RUN, THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 5, 0.8, 32, 5, 16, 1e-6
#: Set members (8 bytes each) that one block of a task holds.
BLOCK = 2_000_000
#: Words whose hashes a worker remembers, and pairs that it compares at a time.
MEMORY, PAIRS = 300_000, 200_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _odd(seed: str, n: int) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(seed.encode()).digest(8 * n), np.uint64) | np.uint64(1)


_PLACE, _SLOPE, _SHIFT, _FOLD = _odd("place", RUN), _odd("slope", BANDS * ROWS), _odd("shift", BANDS * ROWS), _odd("fold", ROWS + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, memo: WordHash) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of a text."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
    n = min(RUN, len(ws))
    runs = sum(h[i : len(ws) - n + 1 + i] * _PLACE[i] for i in range(n))
    return np.unique(_mixed(runs + np.uint64(n)))


def signature(x: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, as 32-bit numbers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 512):
        np.minimum(low, (np.multiply.outer(x[i : i + 512], _SLOPE) + _SHIFT).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band; values of different bands differ."""
    cut = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((cut * _FOLD[:ROWS]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _FOLD[ROWS]).view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest equal ones at which a pair stays.

    With a uniform prior and m of n equal the similarity is Beta(m + 1, n - m + 1), and it reaches t with the
    probability that a binomial of n + 1 draws at t is at most m.
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _pairs_in(group: np.ndarray, side: np.ndarray | None):
    """Pairs of a group's members in bounded pieces; with sides, only pairs of different sides."""
    a, b = (group, group) if side is None else (group[side[group] == 0], group[side[group] == 1])
    if not len(a) or not len(b):
        return
    rows = max(1, PAIRS // len(b))
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        i, j = np.repeat(part, len(b)), np.tile(b, len(part))
        if side is None:
            keep = i < j
            i, j = i[keep], j[keep]
        yield i, j


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None = None, threshold: float = THRESHOLD):
    """Pieces (i, j) of all pairs of sets whose Jaccard similarity reaches the threshold, each pair once."""
    sig = np.array([signature(x) for x in sets], np.uint32).reshape(len(sets), BANDS * ROWS)
    bands = bands_of(sig)
    least = least_matches(threshold)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum([len(x) for x in sets])
    codes = [ids[e - len(x) : e] for x, e in zip(sets, ends, strict=True)]
    flags = np.zeros(len(ids), bool)
    sizes = np.array([len(x) for x in sets])
    for band in range(BANDS):
        order = np.argsort(bands[:, band], kind="stable")
        cuts = np.flatnonzero(np.diff(bands[order, band])) + 1
        for group in np.split(order, cuts):
            if len(group) < 2:
                continue
            for i, j in _pairs_in(group, side):
                for earlier in range(band):
                    fresh = bands[i, earlier] != bands[j, earlier]
                    i, j = i[fresh], j[fresh]
                same = np.zeros(len(i), np.int32)
                for n in range(STEP, BANDS * ROWS + 1, STEP):
                    same += (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(1, dtype=np.int32)
                    keep = same >= least[n]
                    i, j, same = i[keep], j[keep], same[keep]
                if not len(i):
                    continue
                by = np.argsort(i, kind="stable")
                i, j = i[by], j[by]
                common = np.empty(len(i), np.int64)
                starts = np.flatnonzero(np.r_[True, np.diff(i) > 0])
                for s, e in zip(starts, np.r_[starts[1:], len(i)], strict=True):
                    mine = codes[i[s]]
                    flags[mine] = True
                    for at in range(s, e, 512):
                        there = j[at : min(e, at + 512)]
                        offsets = np.r_[0, np.cumsum(sizes[there])[:-1]]
                        common[at : at + len(there)] = np.add.reduceat(flags[np.concatenate([codes[k] for k in there])], offsets, dtype=np.int64)
                    flags[mine] = False
                true = common / (sizes[i] + sizes[j] - common) >= threshold
                yield i[true], j[true]


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, key, size, bands of every row; key is null for texts without words."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches):
        memo = WordHash()
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                x = shingles(text, memo)
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                sizes.append(len(x))
                bands.append(bands_of(signature(x))[0] if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "key", "size", "bands"],
            )

    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    return settle(rows.mapInArrow(work, f"doc_id {doc_type}, text_key long, key binary, size int, bands array<long>"), "sketches")


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components of edges (u, v) by alternating stars; root is the smallest node. No isolated nodes.

    Each round points neighbours at the smallest one (large star, then small star) until the edges stay as they are,
    which takes a number of rounds that grows with the logarithm of the nodes. The hub of a star may have a share of all
    edges: what is known of it goes to them, not they to it.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        known, n = state, state[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = join_per_key(both, low, "u", 2 * n, F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_per_key(large, least, "u", n, F.col("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, settle(small.distinct(), "edges")
        discard(before)


def _compare(memo: WordHash):
    def work(keys, rows):
        rows = rows.to_pydict()
        crossing = keys[1].as_py() != keys[2].as_py()
        mine = {}
        for key, copies, block, text in zip(rows["key"], rows["copies"], rows["block"], rows["text"], strict=True):
            mine.setdefault(key, (copies, block, text))
        names = sorted(mine)
        sets = [shingles(mine[k][2].encode(), memo) for k in names]
        copies = np.array([mine[k][0] for k in names], np.int64)
        side = np.array([int(mine[k][1] == keys[2].as_py()) for k in names]) if crossing else None
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for i, j in linked_pairs(sets, side) if len(names) > 1 else ():
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while ((up := root[root]) != root).any():
                root[:] = up
            apart = root[i] != root[j]
            for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                a, b = _find(root, a), _find(root, b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        found = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([names[i] for i in found], pa.binary()), "hub": pa.array([names[_find(root, i)] for i in found], pa.binary()),
            "links": pa.array(links[found], pa.int64()), "cut": pa.array([keys[0].as_py() is not None] * len(found), pa.bool_()),
        })

    return work


def join(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, n_links, keeper for each row of ``docs``; the rows of one keeper (doc_id, text_key) a class."""
    spark = docs.sparkSession
    rows = sketches(docs)
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    keys = settle(rows.where("key IS NOT NULL").groupBy("key").agg(F.min(named).alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")), "keys")
    banded = keys.select("key", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    edges = banded.join(hubs, "band").where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    groups = components(edges)
    grouped = keys.select("key", "rep", "copies", "size").join(groups, F.col("key") == F.col("node")).drop("node")
    totals, n_keys = grouped.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")), keys.count()
    members = settle(join_per_key(grouped, totals, "root", n_keys, F.col("key")), "members")
    packs = max(int(members.where("blocks = 1").agg(F.sum("size")).first()[0] or 0) // BLOCK + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("key"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).cast("int")
    placed = members.select("key", "copies", F.when(F.col("blocks") > 1, F.col("root")).alias("cut"), block.alias("block"), "blocks", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_key"))
    texts = docs.select(F.col("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    held = texts.join(placed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    other = F.explode(F.when(F.col("cut").isNull(), F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = held.select("key", "copies", "cut", "block", "text", other.alias("_other"))
    tasks = tasks.select("key", "copies", "cut", "block", "text", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"))
    found = settle(tasks.groupBy("cut", "first", "second").applyInArrow(_compare(WordHash()), "key binary, hub binary, links long, cut boolean"), "links")
    whole = found.where("NOT cut").select("key", "links", F.col("hub").alias("root"))
    if not found.where("cut").isEmpty():
        roots = components(found.where("cut").select(F.col("key").alias("u"), F.col("hub").alias("v")))
        summed = found.where("cut").groupBy("key").agg(F.sum("links").alias("links"))
        whole = whole.unionByName(summed.join(roots, F.col("key") == F.col("node")).select("key", "links", "root"))
    linked = settle(keys.select("key", "rep", "copies").join(whole.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), "linked")
    classes = linked.groupBy("root").agg(F.min("rep").alias("keeper"), F.count("*").alias("n"))
    per_key = join_per_key(linked, classes, "root", n_keys, F.col("key")).select("key", "keeper", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n"))
    per_key = settle(per_key, "key-classes")
    spread = F.xxhash64("doc_id", "text_key").cast("string").cast("binary")
    judged = join_per_key(rows.where("key IS NOT NULL").select("doc_id", "text_key", "key"), per_key, "key", rows.count(), spread).select("doc_id", "text_key", F.col("keeper.doc_id").alias("class_id"), "n_links", named.eqNullSafe(F.col("keeper")).alias("keeper"))
    alone = rows.where("key IS NULL").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("keeper"))
    return judged.unionByName(alone)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def clean(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of ``docs``; texts without words all stay."""
    id_, own, one = unused(docs, "id", "key", "one")
    judged = settle(join(docs), "classes")
    named = lambda rows: rows.select(F.col("doc_id").alias(id_), F.col("text_key").alias(own))
    key = F.xxhash64(text_or_empty())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (key == F.col(own))
    kept = docs.join(named(judged.where("NOT keeper")).distinct(), same, "left_anti")
    twice = named(judged.where("keeper AND n_links > 0").groupBy("doc_id", "text_key").count().where("count > 1"))
    if twice.isEmpty():
        return kept
    again, once = kept.join(twice, same, "left_semi"), kept.join(twice, same, "left_anti")
    return once.unionByName(again.withColumn(one, key).dropDuplicates(["doc_id", one]).drop(one))


#: doc_id must be unique in the table. All shared runs are counted, which suits small tables alone.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
r AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM r a JOIN r b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c.n * 5 >= (x.n + y.n - c.n) * 4),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a)
SELECT doc_id, class_id, coalesce(m, 0) AS n_links FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a) LEFT JOIN (SELECT a, count(*) AS m FROM l GROUP BY a) ON a = doc_id
"""
