"""URL filters: longest-prefix rules, and a Bloom filter cascade over the hosts of the whole corpus.

A cascade holds exact membership for a closed universe of keys. Level 1 encodes the listed keys; the keys of the
universe that it lets through by mistake are encoded in level 2; the listed keys that level 2 wrongly holds are
encoded in level 3, and so on until a level makes no mistake. A key's place is decided by the first level that does
not hold it, so every host is judged exactly by a scan with no join of pages.

The list is a table of hosts, each standing for itself and its subdomains, of any size and origin; without one, hosts
with a word of ``LISTED_WORDS`` are listed. The list meets the distinct hosts once, when the cascade is built, and the
pages never.

The filters are arrays of 64-bit words in one row each, read by scalar subqueries. The size of every level is computed
from the count of its keys before it is built. Above ``MAX_BITS`` the verdict comes from a shuffled join of hosts instead.

Defined cases: null url, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated rows are
judged alike; an empty table, or an empty list, allows everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import settle, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts with one of these words between the separators of a label are listed.
LISTED_WORDS = ("adult", "bets", "casino", "farm", "free", "gambling", "pills", "porn", "spam", "xxx")
LISTED_PATTERN = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"
FIRST_RATE, NEXT_RATE = 1 / 64, 0.5
MAX_BITS = 64 * 8 * 1024 * 1024


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple) -> Column:
    _, h, p = rule
    return ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        text = F.when(fits(host, path, rule), F.lit(rule[1] + rule[2])).otherwise(text)
        verdict = F.when(fits(host, path, rule), F.lit(rule[0])).otherwise(verdict)
    return text, verdict


def _spot(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


def build_filter(keys: DataFrame, key: str, level: int, n: int, rate: float) -> dict:
    """A Bloom filter of ``n`` keys, kept as one row in the shared folder."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(bits / n * math.log(2)))
    seeds = [1000 * level + i for i in range(hashes)]
    spots = keys.select(F.explode(F.array(*[_spot(F.col(key), s, bits) for s in seeds])).alias("spot"))
    one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    words = spots.groupBy(F.expr("cast(spot div 64 as int)").alias("at")).agg(F.bit_or(one).alias("word"))
    empty = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("word"))
    every = words.unionByName(empty).groupBy("at").agg(F.bit_or("word").alias("word"))
    row = every.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("held")).select(F.transform("held", lambda w: w["word"]).alias("words"))
    return {"words": settle(row, f"cascade-{level}"), "bits": bits, "seeds": seeds}


def holds(key: Column, f: dict, words: Column) -> Column:
    out = F.lit(True)
    for seed in f["seeds"]:
        spot = _spot(key, seed, f["bits"])
        word = F.get(words, F.floor(spot / F.lit(64)).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, F.pmod(spot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == F.lit(1))
    return out


def build_cascade(universe: DataFrame, key: str, listed: str) -> list[dict] | None:
    """universe: distinct non-null keys and whether they are listed. None where the filters would exceed MAX_BITS."""
    sides = {True: universe.where(F.col(listed)).select(key), False: universe.where(~F.col(listed)).select(key)}
    levels: list[dict] = []
    inside, n = True, sides[True].count()
    while n:
        rate = NEXT_RATE if levels else FIRST_RATE
        if n * -math.log(rate) / math.log(2) ** 2 > MAX_BITS:
            return None
        f = build_filter(sides[inside], key, len(levels) + 1, n, rate)
        levels.append(f)
        inside = not inside
        sides[inside] = settle(sides[inside].where(holds(F.col(key), f, f["words"].scalar())), f"cascade-next-{len(levels)}")
        n = sides[inside].count()
    return levels


def listed_by(key: Column, levels: list[dict]) -> Column:
    """True for listed keys of the universe. A key that stops before level i+1 was let in by i levels: odd means listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~holds(key, levels[i], levels[i]["words"].scalar()), F.lit(i % 2 == 1)).otherwise(out)
    return out


def listed_among(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """``hosts`` with whether each is in the table ``listed`` (column ``host``, any case), itself or by a domain above it."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    every = listed.where("host IS NOT NULL AND host <> ''").select(F.translate("host", UPPER, LOWER).alias("_domain")).distinct()
    found = hosts.select("host", F.explode(above).alias("_domain")).join(every, "_domain").select("host").distinct().withColumn("_listed", F.lit(True))
    return hosts.join(found, "host", "left").select("host", F.coalesce("_listed", F.lit(False)).alias("_listed"))


def judge(pages: DataFrame, listed: DataFrame | Column | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. ``listed``: a table of hosts, or a condition on the column ``host``."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parsed.select("host").distinct()
    if isinstance(listed, DataFrame):
        universe = listed_among(hosts, listed)
    else:
        universe = hosts.withColumn("_listed", F.coalesce(F.col("host").rlike(LISTED_PATTERN) if listed is None else listed, F.lit(False)))
    universe = settle(universe, "hosts")
    levels = build_cascade(universe, "host", "_listed")
    if levels is None:
        parsed = parsed.join(universe, "host")
        bad = F.col("_listed")
    else:
        bad = listed_by(F.col("host"), levels)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _rules_sql(column: str) -> str:
    cases = ""
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        value = verdict if column == "verdict" else h + p
        cases += f" WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{value}'"
    return cases


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE{_rules_sql("rule")} END AS rule,
  CASE{_rules_sql("verdict")} WHEN regexp_matches(host, '{LISTED_PATTERN}') THEN 'block' ELSE 'allow' END AS verdict
FROM parsed
"""
