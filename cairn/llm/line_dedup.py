"""Line deduplication by an exact set-similarity join of word sets, with DataFrame operations alone.

A line is the set of its words. A line is removed if an earlier line of the corpus, in order of doc_id, text hash and
line number, has the same set or one of Jaccard similarity ``SIMILARITY`` or more; whether that line is itself removed
does not matter. Lines of equal content (by SHA-256, cut to 128 bits) are one line before anything is split into words.
The words of a line are ordered by rarity, rarest first. Two similar sets share a word within their prefixes (the first
``n - ceil(0.8 n) + 1`` words), so prefixes are posted under their words and only lines that meet there are compared: by
length, by what the positions of the shared word leave possible, and by a parity bitmap whose distance never exceeds
the difference of the sets. Pairs that pass are verified on their words, not on hashes.

Up to that point a word is a token of ``TOKEN_BITS`` bits, and a line holds a token for each distinct word, so that words
that share a token can only make two lines look more alike: sizes, prefixes, positions and bitmaps let through every
pair that is similar, whatever the tokens. Rarity is exact counting over all lines in ``2 ** CELL_BITS`` cells of tokens, a
table of fixed size: the order is the same for all lines, which is all that exactness asks for.

The lines of a word's group meet pairwise where there are up to ``SMALL`` of them; in larger groups all lines meet the
earliest one, and only those still not removed then meet all others. So the many variants of one line are settled by
their first one, and no table holds the pairs of such a group.

Lines that are not the first of their content are kept from being split by a Bloom filter of the first ones' places. What
it lets through by mistake takes part as a line of its own, which changes nothing; beyond ``MAX_BITS`` a join does the same.

Defined cases: null text is one empty line; lines without words are always kept; rows that share doc_id and text are
one document for the order and get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import discard, settle, table, text_or_empty, unused
from cairn.llm.url_filters import MAX_BITS, build_filter, holds

#: Similarity as a fraction: 4 / 5.
SIMILARITY = (4, 5)
TOKEN_BITS, CELL_BITS, SMALL = 31, 21, 512
COUNT_TOP = 2**24 - 1
#: Words beyond which the parity bitmap has 128 bits; its two halves together are the 64-bit one.
LONG = 80
#: Characters between words, each by itself: Java looks those up in a table, but tries ranges one by one.
SEPARATORS = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum() or chr(c).isupper()) + "]+"
HAS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PLACE = ("doc_id", "text_key", "line_no")
#: What is known of a line where it is posted.
SEEN = ("id", "doc", "n", "at", "low", "high")
#: Lines up to which their texts are told by broadcast.
FEW = 50_000
#: Share of keys that the Bloom filters here let through by mistake.
RATE = 1 / 8


def words_of(line: Column) -> Column:
    """The distinct words of a line."""
    return F.array_remove(F.array_distinct(F.split(F.lower(line), SEPARATORS)), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line."""
    text = text_or_empty()
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))  # once a text, not once a line
    return texts.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line"))


def place(of: str = "") -> Column:
    return F.struct(*[F.col(f"{of}{c}").alias(c) for c in PLACE])


def place_hash(of: str = "") -> Column:
    return F.xxhash64(*[F.col(f"{of}{c}") for c in PLACE])


def found_at(lines: DataFrame, places: DataFrame, n: int, level: int) -> tuple[DataFrame, bool]:
    """Those of ``lines`` whose place is among ``places`` (a struct ``first``), and whether that is exact; a Bloom filter may let others through."""
    if n * -math.log(RATE) / math.log(2) ** 2 > MAX_BITS:
        wanted = places.select(place_hash("first.").alias("_at"), F.col("first").alias("_first")).distinct()
        return lines.join(wanted, (place_hash() == F.col("_at")) & place().eqNullSafe(F.col("_first"))).drop("_at", "_first"), True
    bloom = build_filter(places.select(place_hash("first.").alias("at")), "at", level, max(1, n), RATE)
    return lines.where(holds(place_hash(), bloom, bloom["words"].scalar())), False


def lines_at(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Lines among which are those at ``places``. Where these are few, texts that hold none of them are not split."""
    if n > FEW:
        return found_at(lines_of(docs), places, n, 91)[0]
    text = lambda id_, key: F.xxhash64(id_, key)
    held = places.select(text("first.doc_id", "first.text_key").alias("_text")).distinct()
    return lines_of(docs.select("doc_id", "text").join(F.broadcast(held), text("doc_id", F.xxhash64(text_or_empty())) == F.col("_text"), "left_semi"))


def tokens_of(lines: DataFrame) -> DataFrame:
    """id, place and tokens (one for each distinct word)."""
    tokens = F.transform(words_of(F.col("line")), lambda w: F.hash(w).bitwiseAND(F.lit(2**TOKEN_BITS - 1)))
    return settle(lines.select(F.monotonically_increasing_id().alias("id"), place().alias("first"), tokens.alias("tokens")), "line-tokens", distinct=True)


def count_tokens(tokens: DataFrame) -> DataFrame:
    """One row: an array of how many lines hold the tokens of each cell. Its pieces of 2 ** 12 cells are made side by side."""
    spark, bits = tokens.sparkSession, min(CELL_BITS, TOKEN_BITS)
    seen = tokens.select(F.explode("tokens").alias("t")).select(F.col("t").bitwiseAND(F.lit(2**bits - 1)).alias("cell"), F.lit(1).alias("n"))
    every = seen.unionByName(spark.range(2**bits).select(F.col("id").cast("int").alias("cell"), F.lit(0).alias("n"))).groupBy("cell").agg(F.sum("n").alias("n"))
    packed = F.shiftleft(F.col("cell").cast("long"), 24).bitwiseOR(F.least("n", F.lit(COUNT_TOP)))
    pieces = every.groupBy(F.shiftright("cell", 12).alias("piece")).agg(F.sort_array(F.collect_list(packed)).alias("cells"))
    pieces = pieces.select("piece", F.transform("cells", lambda c: c.bitwiseAND(F.lit(COUNT_TOP)).cast("int")).alias("counts"))
    row = pieces.agg(F.sort_array(F.collect_list(F.struct("piece", "counts"))).alias("pieces"))
    return settle(row.select(F.flatten("pieces.counts").alias("counts")), "token-counts")


def described(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """id, place, n, the parity bitmap (whole, high) and the prefix of each line: tokens that start with their counts, rarest first.

    ``_counts`` must be used once and beside cheap columns alone: so the optimizer puts the array where it is read and copies it into no row.
    """
    cells, n = F.lit(2 ** min(CELL_BITS, TOKEN_BITS) - 1), F.size("tokens")
    rank = lambda t: F.shiftleft(F.get("_counts", t.bitwiseAND(cells)).cast("long"), TOKEN_BITS).bitwiseOR(t.cast("long"))
    up, down = SIMILARITY
    prefix = F.slice(F.sort_array(F.transform("tokens", rank)), F.lit(1), n - F.ceil(n * F.lit(up) / F.lit(down)).cast("int") + 1)
    zero, shift = F.lit(0).cast("long"), lambda by, x: F.call_function("shiftleft", by, x)
    whole = F.aggregate("tokens", zero, lambda acc, t: acc.bitwiseXOR(shift(F.lit(1).cast("long"), t)))
    half = F.aggregate("tokens", zero, lambda acc, t: acc.bitwiseXOR(shift(F.shiftright(t, 6).bitwiseAND(F.lit(1)).cast("long"), t)))
    rows = tokens.withColumn("_counts", counts.scalar()).select("id", "first", n.alias("n"), whole.alias("whole"), F.when(n > LONG, half).otherwise(zero).alias("high"), prefix.alias("prefix"))
    return settle(rows, "line-prefixes", distinct=True)


def postings(lines: DataFrame) -> DataFrame:
    """token, count and what is known of the line. Tokens of one line alone meet nothing and are left out."""
    low = F.col("whole").bitwiseXOR(F.col("high"))
    posted = lines.select("id", F.col("first.doc_id").alias("doc"), "n", low.alias("low"), "high", F.posexplode("prefix").alias("at", "rank"))
    count = F.shiftright("rank", TOKEN_BITS)
    return posted.where(count > 1).select(F.col("rank").bitwiseAND(F.lit(2**TOKEN_BITS - 1)).cast("int").alias("token"), (count > SMALL).alias("often"), *SEEN)


def may_match(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The length, positional and bitmap filters for two postings of one token, the smaller line first (positions from 0)."""
    up, down = SIMILARITY
    n = a["n"] + b["n"]
    least = F.ceil(n * F.lit(up) / F.lit(up + down)).cast("int")
    fits = (a["n"] * F.lit(down) >= b["n"] * F.lit(up)) & (a["n"] - a["at"] >= least) & (b["n"] - b["at"] >= least)
    low, high = a["low"].bitwiseXOR(b["low"]), a["high"].bitwiseXOR(b["high"])
    distance = F.when((a["n"] > LONG) == (b["n"] > LONG), F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))
    return fits & (distance <= n - F.lit(2) * least)


def _of(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in SEEN}


def _renamed(posted: DataFrame, *keep: str) -> DataFrame:
    return posted.select(*keep, *[F.col(c).alias(f"o_{c}") for c in SEEN])


def _early(n: Column, at: Column) -> Column:
    """Of two similar sets the smaller shares a word within its first ``n - ceil(8 n / 9) + 1`` already, so only those wait for larger ones."""
    up, down = SIMILARITY
    return at <= n - F.ceil(n * F.lit(2 * up) / F.lit(up + down))


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """early, late, sure: ids of lines that may match, the smaller line (of equal ones that with the smaller id) from ``left``.

    Their doc_ids say which is earlier; ``sure`` is false where they do not.
    """
    smaller = (F.col("n") < F.col("o_n")) | ((F.col("n") == F.col("o_n")) & (F.col("id") < F.col("o_id")))
    met = left.where(_early(F.col("n"), F.col("at"))).select("token", *SEEN).join(_renamed(right, "token"), "token")
    later, sure = F.coalesce(F.col("doc") > F.col("o_doc"), F.lit(False)), F.coalesce(F.col("doc") != F.col("o_doc"), F.lit(False))
    of = lambda first, other: F.when(later, F.col(other)).otherwise(F.col(first))
    return met.where(smaller & may_match(_of(""), _of("o_"))).select(of("id", "o_id").alias("early"), of("o_id", "id").alias("late"), sure.alias("sure"))


def either_way(open_: DataFrame, others: DataFrame) -> DataFrame:
    return meetings(open_, others).unionByName(meetings(others, open_))


def large_groups(posted: DataFrame) -> DataFrame:
    """Tokens that more than SMALL lines post. Only tokens that so many lines hold are counted."""
    return settle(posted.where("often").groupBy("token").count().where(F.col("count") > SMALL).select("token"), "large-groups")


def similar_later(pairs: DataFrame, docs: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """id of the later line of every pair whose words are similar. Words are split again from the texts, for the lines of pairs alone.

    Each line is held against one earlier line first, and only those still not removed against all others.
    """
    pairs = met = settle(pairs.distinct(), f"{name}-pairs")
    wanted = pairs.select(F.col("early").alias("id")).unionByName(pairs.select(F.col("late").alias("id"))).distinct()
    places = settle(known.select("id", "first").join(wanted, "id"), f"{name}-places")
    lines = lines_at(docs, places, places.count())
    at = places.select("id", "first", place_hash("first.").alias("_at"))
    found = at.join(lines, (F.col("_at") == place_hash()) & place().eqNullSafe(F.col("first"))).dropDuplicates(["_at", "id"])
    sets = settle(found.select("id", words_of(F.col("line")).alias("words")), f"{name}-words")
    of = lambda side: places.select(F.col("id").alias(side), F.col("first").alias(f"{side}_first"))
    unsure = pairs.where("NOT sure").join(of("early"), "early").join(of("late"), "late").where("early_first <> late_first")
    turned = F.col("early_first") > F.col("late_first")
    unsure = unsure.select(F.when(turned, F.col("late")).otherwise(F.col("early")).alias("early"), F.when(turned, F.col("early")).otherwise(F.col("late")).alias("late"))
    pairs = pairs.where("sure").select("early", "late").unionByName(unsure)

    def true(of_pairs: DataFrame) -> DataFrame:
        up, down = SIMILARITY
        with_words = lambda side: sets.select(F.col("id").alias(side), F.col("words").alias(f"{side}_words"))
        common = F.size(F.array_intersect("early_words", "late_words"))
        similar = common * F.lit(down) >= (F.size("early_words") + F.size("late_words") - common) * F.lit(up)
        return of_pairs.join(with_words("early"), "early").join(with_words("late"), "late").where(similar).select(F.col("late").alias("id")).distinct()

    removed = settle(true(pairs.groupBy("late").agg(F.min("early").alias("early"))), f"{name}-removed")
    left = pairs.join(removed.select(F.col("id").alias("late")), "late", "left_anti")
    every = settle(removed.unionByName(true(left)), f"{name}-all-removed")
    discard(met, sets, removed)
    return every


def later_ones(docs: DataFrame, known: DataFrame) -> DataFrame:
    """id of every line of ``known`` (as ``described``) to which an earlier one is similar."""
    posted = postings(known)
    if (large := large_groups(posted)).isEmpty():
        return similar_later(meetings(posted, posted), docs, known, "lines")
    small = posted.join(large, "token", "left_anti")
    crowd = settle(posted.where("often").join(large, "token"), "crowd")
    where = crowd.join(known.select("id", "first"), "id")
    hubs = where.groupBy("token").agg(F.min(F.struct("first", *SEEN)).alias("hub")).select("token", "hub.*").drop("first")
    removed = similar_later(meetings(small, small).unionByName(either_way(hubs, crowd)), docs, known, "first")
    more = similar_later(either_way(crowd.join(removed, "id", "left_anti"), crowd), docs, known, "later")
    return settle(removed.unionByName(more).distinct(), "later-ones")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_rows, n_lines, removed: the numbers of the lines to remove, one row for each (doc_id, text)."""
    content = F.when(F.rlike("line", F.lit(HAS_WORD)), F.unhex(F.substring(F.sha2("line", 256), 1, 32)))
    lines = settle(lines_of(docs).select(*PLACE, content.alias("content")), "lines")
    firsts = settle(lines.where("content IS NOT NULL").groupBy("content").agg(F.min(place()).alias("first"), F.count("*").alias("copies")), "first-lines")
    told, _ = found_at(lines_of(docs), firsts, firsts.count(), 90)
    tokens = tokens_of(told)
    known = described(tokens, count_tokens(tokens))
    discard(tokens)
    gone = later_ones(docs, known).withColumn("_gone", F.lit(True)).join(known.select("id", "first"), "id")
    gone = gone.select(place_hash("first.").alias("_at"), F.col("first").alias("_first"), "_gone").dropDuplicates(["_at", "_first"])
    judged = firsts.join(gone, (place_hash("first.") == F.col("_at")) & F.col("first").eqNullSafe(F.col("_first")), "left")
    judged = judged.select("content", "first", F.coalesce("_gone", F.lit(False)).alias("gone"), "copies").where("gone OR copies > 1")
    going = lines.join(judged, "content").where(F.col("gone") | ~place().eqNullSafe(F.col("first")))
    going = going.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    texts = lines.groupBy("doc_id", "text_key").agg(F.sum((F.col("line_no") == 0).cast("int")).alias("n_rows"), (F.max("line_no") + 1).cast("long").alias("n_lines"))
    every = texts.join(going, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return every.select("doc_id", "text_key", "n_rows", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that go taken out of their texts; all other columns stay."""
    id_, key, gone = unused(docs, "id", "key", "gone")
    found = removed_lines(docs).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("removed").alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text_or_empty()) == F.col(key))
    kept = F.array_join(F.filter(F.split(text_or_empty(), "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")
    return docs.join(found, same).select(*[kept.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = removed_lines(table(spark, sf_dir, "documents"))
    out = per.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed_lines"), F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("_row"))
    return out.drop("_row")


#: doc_id must be unique in the table.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM d),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''))) AS ws FROM l),
k AS (SELECT ws, min((doc_id, line_no)) AS first FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT ws, first, unnest(ws) AS w FROM k),
f AS (SELECT w, count(*) AS n FROM t GROUP BY w),
p AS (SELECT ws, first, w FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n, w) AS i FROM t JOIN f USING (w)) WHERE i <= len(ws) - ceil(len(ws) * 4 / 5) + 1),
c AS (SELECT DISTINCT a.ws AS a, b.ws AS b FROM p a JOIN p b ON a.w = b.w AND a.first < b.first AND len(a.ws) * 5 >= len(b.ws) * 4 AND len(b.ws) * 5 >= len(a.ws) * 4),
g AS (SELECT DISTINCT b AS ws FROM (SELECT a, b, len(list_intersect(a, b)) AS n FROM c) WHERE n * 5 >= (len(a) + len(b) - n) * 4),
r AS (SELECT s.doc_id, s.line_no FROM s JOIN k USING (ws) LEFT JOIN g USING (ws) WHERE g.ws IS NOT NULL OR (s.doc_id, s.line_no) <> k.first)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, count(line_no) AS n_removed, coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no), '') AS removed_lines
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, len(ls)
"""
