"""Secret scans over the history of a corpus, kept in an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a Parquet folder with a row for
each blob and run: the rules that the run applied and the spans that it found. A scan reads the ledger, works out for
each blob which rules, in their present versions, it has not seen, and scans one copy of just those blobs with just
those rules; findings are then joined back to all paths that ever held the blob. A new rule, or a new version of one,
is another rule id, so old findings stay true and nothing is scanned twice.

Spans count code points, ends exclusive. Matches are leftmost and non-overlapping for each kind; those that fail the
kind's length test are dropped after matching, as they may have used up text.

Defined cases: null text is the empty blob; empty blobs hold nothing; repeated rows each get the findings; rows that
share a path but not content are separate versions; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import fresh_path, settle, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters; a text without any of ``cues`` (lower case) can't match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    cues: tuple = ()
    version: int = 1

    @property
    def id(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group, self.version)).encode()).hexdigest()[:16]


BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40, 0, ("gho_", "ghp_", "ghs_", "ghu_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, ("eyj",)),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, ("private key",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0, ("xox",)),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s:@]+@", 0, 0, ("://",)),
)
RULES = BASE + MORE
#: What the pattern of a rule is searched by, and the group that is its match, where another form finds the same passing
#: matches in linear time: a run of letters in which no match starts is not tried again from each of them.
FASTER = {
    r"[0-9a-f]+": (r"[0-9a-f]{16,}", 0),
    MORE[1].pattern: (r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-])[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)", 1),
    MORE[4].pattern: (r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^/\s:@]++:[^/\s:@]++@)", 1),
}


def find(text: str, rules: tuple = RULES) -> Iterator[tuple[Rule, int, int]]:
    low = text.lower()
    for rule in rules:
        if rule.cues and not any(c in low for c in rule.cues):
            continue
        pattern, match = FASTER.get(rule.pattern, (rule.pattern, 0))
        for m in re.finditer(pattern, text):
            if m.end(rule.group or match) - m.start(rule.group or match) >= rule.least:
                yield rule, m.start(match), m.end(match)


def _read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


#: Keys over which the paths of one blob are spread when its findings are joined back.
SALTS = 16
LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,from:int,to:int>>"


def address(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The narrow table (path, blob) of all versions."""
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("blob"))


def scan(versions: DataFrame, ledger: str, rules: tuple = RULES, path: str = "path", text: str = "text", addressed: DataFrame | None = None) -> DataFrame:
    """Bring the ledger up to date with all versions; returns the table of unseen blobs that this run scanned (blob, todo)."""
    spark = versions.sparkSession
    addressed = settle(address(versions, path, text), "versions") if addressed is None else addressed
    seen = _read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("_seen"))
    every = F.array(*[F.lit(r.id) for r in rules])
    copies = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = copies.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    unseen = settle(unseen.select("blob", "path", "todo"), "unseen")
    texts = versions.select(F.col(path).alias("_path"), text_or_empty(text).alias("text"))
    texts = texts.withColumn("_blob", F.unhex(F.sha2("text", 256)))
    todo = unseen.hint("shuffle_hash")
    one_copy = texts.join(todo, F.col("_path").eqNullSafe(F.col("path")) & (F.col("_blob") == F.col("blob"))).select("blob", "text", "todo")
    by_id = {r.id: r for r in rules}

    def work(batches):
        spans = pa.list_(pa.struct([("rule", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))
        seen: set[bytes] = set()  # all rows of one path and blob come to one task
        for batch in batches:
            found, fresh = [], []
            for i, blob in enumerate(batch.column("blob").to_pylist()):
                if blob not in seen:
                    seen.add(blob)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            for content, todo in zip(batch.column("text").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                found.append([{"rule": r.id, "from": a, "to": b} for r, a, b in find(content, tuple(by_id[i] for i in todo))])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("todo"), pa.array(found, spans)], ["blob", "rules", "spans"])

    one_copy.mapInArrow(work, LEDGER).write.mode("append").parquet(ledger)
    return unseen.select("blob", "todo")


def findings(addressed: DataFrame, ledger: str, rules: tuple = RULES) -> DataFrame:
    """path and blob of every version with its spans (kind, from, to) under the present rules, by start and then by kind."""
    kinds = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(n).alias("order"), F.lit(r.kind).alias("kind")))])
    known = F.array(*[F.lit(r.id) for r in rules])
    held = _read_ledger(addressed.sparkSession, ledger).where(F.size("spans") > 0)
    span = F.filter(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda s: F.array_contains(known, s["rule"]))
    ordered = F.array_sort(F.transform(span, lambda s: F.struct(s["from"].alias("from"), kinds[s["rule"]]["order"].alias("order"), s["to"].alias("to"), kinds[s["rule"]]["kind"].alias("kind"))))
    held = held.groupBy("blob").agg(ordered.alias("spans")).select(F.col("blob").alias("_blob"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    none = F.array().cast("array<struct<from:int,order:int,to:int,kind:string>>")
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")
    return addressed.join(held, (F.col("blob") == F.col("_blob")) & (salt == F.col("_salt")), "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), fresh_path(spark, "ledger")
    addressed = settle(address(docs, "doc_id"), "versions")
    scan(docs, ledger, path="doc_id", addressed=addressed)
    found = findings(addressed, ledger)
    names = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return found.select(F.col("path").alias("doc_id"), *map(count, names), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _kind_sql(n: int, rule: Rule) -> str:
    """Matches with their places: the pieces between matches and the matches alternate."""
    pattern = rule.pattern.replace("'", "''")
    tested = f"regexp_extract(m, '{pattern}', {rule.group})"
    return (
        f"SELECT doc_id, {n} AS o, '{rule.kind}' AS kind, a, a + length(m) AS b FROM (SELECT doc_id, unnest(ms) AS m, "
        "unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT))) AS a "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM d)) WHERE length({tested}) >= {rule.least}"
    )


#: doc_id must be unique in the table.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(n, r) for n, r in enumerate(RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
