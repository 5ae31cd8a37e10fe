"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automata, and context windows.

The lexicon holds words, and stems that many words share, that stand in labelled toxic texts far more often than in
clean ones (a likelihood ratio test on a bounded sample of labelled rows, of which near copies count once). It is kept as a trie. The words of a text
run through the intersection of the trie with the Levenshtein automata of its terms: a state is the set of trie
nodes that the word so far reaches, each with its fewest edits, and states are made only as they are met. Terms of at
least ``ONE_EDIT`` letters allow one edit and of ``TWO_EDITS`` two; a term's misspellings are dropped if the sample
shows them as often in clean texts.

A hit counts by its edits and by the words around it: within quotation marks or next to words of reporting it is
likely quotation and counts little, next to words that address the reader it counts more. The score is a logistic
function of what the hits add up to, fitted on the same sample.

Labels are learned only from rows whose CRC-32 of doc_id as text is not 2 modulo 4; ``SAMPLE`` bounds the sample.

Defined cases: null and empty texts, and texts without hits, get the score of no hits; null labels are left out, and
of several labels of one doc_id the largest counts; without labels of both kinds the score is the smoothed share of
toxic ones; repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import hex_draw, settle, table, text_or_empty
from cairn.llm.words import words

#: Labelled rows that the model is fitted on, at most (in expectation: rows are kept by a hash of doc_id).
SAMPLE = 20_000
ONE_EDIT, TWO_EDITS, STEMS = 5, 9, (4, 8)
LEAST_LLR, LEAST_RATIO, STEM_WORDS = 14.0, 20.0, 4
THRESHOLD = 0.3
EDIT_WEIGHT = (1.0, 0.7, 0.4)
AROUND = 6
#: Entries of a worker's memory of words and automaton states, after which it starts afresh.
MEMORY = 400_000

#: Multipliers and offsets of the sketch's hashes.
SKETCH = [(2 * n * n * 40503 + 1, n * 2654435761 % 4294967291) for n in range(1, 9)]

# Marks and words by which quotation and address are told.
QUOTES = "\"“”„«»"
REPORTING = {"called", "calling", "claimed", "defined", "definition", "means", "phrase", "quote", "quoted", "quotes", "said", "saying", "says", "term", "word", "words", "wrote", "dijo", "palabra", "mot", "terme", "sagte", "wort", "zitat"}
ADDRESS = {"you", "your", "youre", "u", "ur", "du", "dich", "dein", "tu", "toi", "vous", "eres", "usted"}

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F“”„«»]+")


class Lexicon:
    """Terms as {text: is a stem}; ``exact_only`` are those whose misspellings do not count."""

    def __init__(self, terms: dict[str, bool], exact_only: frozenset = frozenset()):
        self.terms, self.exact_only = terms, exact_only
        self._ready = False

    def edits(self, term: str) -> int:
        return 0 if term in self.exact_only else (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)

    def _build(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in sorted(self.terms):
            at = 0
            self.most[0] = max(self.most[0], self.edits(term))
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], self.edits(term))
            self.ends[at] = term
        self._forget()
        self._ready = True

    def _forget(self) -> None:
        self.start = self._closed({0: 0})
        self.steps: dict = {}
        self.clean: set[bytes] = set()
        self.hits: dict[bytes, tuple[str, int]] = {}

    def _closed(self, reach: dict[int, int]) -> tuple:
        """With all nodes reached by leaving out letters of a term; edits beyond what any term below allows are dropped."""
        stack = list(reach.items())
        best = dict(reach)
        while stack:
            node, e = stack.pop()
            if e > best[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < best.get(child, 9):
                    best[child] = e + 1
                    stack.append((child, e + 1))
        return tuple(sorted((n, e) for n, e in best.items() if e <= self.most[n]))

    def _step(self, state: tuple, c: str) -> tuple:
        reach: dict[int, int] = {}
        for node, e in state:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < reach.get(child, 9):
                    reach[child] = cost
            if e + 1 <= self.most[node] and e + 1 < reach.get(node, 9):
                reach[node] = e + 1
        return self._closed(reach)

    def _best(self, state: tuple, stems: bool) -> tuple[str, int] | None:
        found = [(e, self.ends[n]) for n, e in state if self.ends[n] is not None and (not stems or self.terms[self.ends[n]]) and e <= self.edits(self.ends[n])]
        return min(found)[::-1] if found else None

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits; a stem may match any beginning of the word."""
        state, best = self.start, None
        for c in word:
            after = self.steps.get((state, c))
            if after is None:
                nxt = self._step(state, c)
                after = self.steps[state, c] = (nxt, self._best(nxt, True))
            state, stem = after
            if stem and (best is None or stem[1] < best[1]):
                best = stem
            if not state:
                return best
        whole = self._best(state, False)
        return whole if whole and (best is None or whole[1] <= best[1]) else best

    def hits_in(self, distinct: set[bytes]) -> dict[bytes, tuple[str, int]]:
        """The words of a text that match a term."""
        if not self._ready:
            self._build()
        if len(self.clean) > MEMORY or len(self.steps) > MEMORY or len(self.hits) > MEMORY:
            self._forget()
        for w in distinct - self.clean:
            if w not in self.hits:
                if found := self.match(w.decode(errors="replace").lower()):
                    self.hits[w] = found
                else:
                    self.clean.add(w)
        return {w: self.hits[w] for w in self.hits.keys() & distinct}


def abuse(text: bytes, lexicon: Lexicon) -> float:
    """What the hits of a text add up to, each by its edits and the window around it."""
    found = lexicon.hits_in(set(words(_MARKS.sub(b" ", text))))
    if not found:
        return 0.0
    s = text.decode(errors="replace")
    tokens = [(m.start(), m.end(), m[0].encode().translate(_LOWER)) for m in TOKEN.finditer(s)]
    total = 0.0
    for i, (a, b, w) in enumerate(tokens):
        if (hit := found.get(w)) is None:
            continue
        near = {t[2].decode(errors="replace") for t in tokens[max(0, i - AROUND) : i + AROUND + 1]}
        before, after = s[tokens[max(0, i - AROUND)][0] : a], s[b : tokens[min(len(tokens) - 1, i + AROUND)][1]]
        quoted = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        factor = (0.25 if quoted else 1.0) * (0.5 if near & REPORTING else 1.0) * (1.25 if near & ADDRESS else 1.0)
        total += EDIT_WEIGHT[hit[1]] * factor
    return total


#: Typographic quotation marks are no parts of words here.
_MARKS = re.compile(b"|".join(q.encode() for q in QUOTES[1:]))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def features(total: float) -> list[float]:
    return [1.0, math.log1p(total), min(1.0, total)]


class Model:
    def __init__(self, lexicon: Lexicon, weights: list[float]):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: bytes) -> float:
        z = sum(w * x for w, x in zip(self.weights, features(abuse(text, self.lexicon)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def plain(lexicon: Lexicon, weights: list[float] = ()) -> dict:
    """What is sent to the workers: built-in types alone, which they read without this package."""
    return {"terms": dict(lexicon.terms), "exact_only": sorted(lexicon.exact_only), "weights": list(weights)}


def rebuilt(held: dict) -> Model:
    """The model of what ``plain`` made, once for each worker, so that its memory lasts over tasks."""
    if "model" not in held:
        held["model"] = Model(Lexicon(held["terms"], frozenset(held["exact_only"])), held["weights"])
    return held["model"]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text and toxic of labelled rows outside the held-out quarter; kept by a hash of doc_id, so that about ``most`` remain."""
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    n = rows.count()
    if n > most:
        rows = rows.where(hex_draw(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string"))) < F.lit(int(2**32 * most / n)))
    sample = F.broadcast(rows.withColumnRenamed("doc_id", "_id"))  # at most about ``most`` rows of two numbers
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(sample, F.col("doc_id") == F.col("_id"))
    texts = settle(joined.groupBy("text").agg(F.max((F.col("_toxic") > 0).cast("int")).alias("toxic")).withColumn("row", F.xxhash64("text")), "toxicity-sample")
    return texts.join(F.broadcast(_one_of_each(texts)), "row").drop("row")


def sketch(text: bytes) -> list[int]:
    """Eight smallest hashes of runs of five words, in pairs: near copies nearly always share a pair, other texts rarely."""
    ws = words(text)
    runs = {b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    h = np.array([zlib.crc32(r) for r in runs], np.uint64)
    low = [int(((h * np.uint64(a) + np.uint64(b)) % np.uint64(4294967291)).min()) for a, b in SKETCH]
    return [(low[i] << 32 | low[i + 1]) - 2**63 for i in range(0, 8, 2)]


def _one_of_each(texts: DataFrame) -> DataFrame:
    """The rows of a bounded sample that are no near copies of one before: else a group of copies makes its every word look marked."""

    def work(batches):
        for batch in batches:
            pairs = [sketch(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pairs, pa.list_(pa.int64()))], ["row", "pairs"])

    seen: set = set()
    kept = []
    for r in sorted(texts.mapInArrow(work, "row long, pairs array<long>").collect()):
        keys = set(enumerate(r.pairs))
        if not keys & seen:
            kept.append((r.row,))
        seen |= keys
    return texts.sparkSession.createDataFrame(kept, "row long")


def _counted(sample: DataFrame, count, key: str = "term string, stem boolean") -> DataFrame:
    """Sums of counts that ``count(texts, toxic)`` gives for each batch as a Counter of (term, flag, toxic)."""

    def work(batches):
        total: Counter = Counter()
        for batch in batches:
            total.update(count(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist()))
        a, b, t = (list(c) for c in zip(*total, strict=True)) if total else ([], [], [])
        types = [pa.string(), pa.bool_() if "boolean" in key else pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip((a, b, t, list(total.values())), types, strict=True)], [*(k.split()[0] for k in key.split(", ")), "toxic", "n"])

    names = [k.split()[0] for k in key.split(", ")]
    counted = sample.mapInArrow(work, f"{key}, toxic int, n long")
    return counted.groupBy(*names).agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("good")).na.fill(0)


def _candidates(text: bytes) -> set[tuple[str, bool]]:
    ws = {w.decode(errors="replace").lower() for w in set(words(text))}
    out = {(w, False) for w in ws if len(w) > 2}
    return out | {(w[:n], True) for w in ws for n in range(STEMS[0], min(STEMS[1], len(w)) + 1)}


def marked(bad: int, good: int, n_bad: int, n_good: int) -> bool:
    """Whether a term stands in toxic texts far more often than chance lets it."""
    both, share = bad + good, n_bad / (n_bad + n_good)
    llr = sum(x * math.log(x / (both * p)) for x, p in ((bad, share), (good, 1 - share)) if x and p)
    return bad / n_bad >= LEAST_RATIO * good / n_good and llr >= LEAST_LLR


def choose_terms(rows: list, n_bad: int, n_good: int) -> dict[str, bool]:
    """rows: (term, stem, bad, good). Stems that cover many words, as long as they lose none; then words that no stem covers."""
    good_rows = [(t, s, b) for t, s, b, g in rows if marked(b, g, n_bad, n_good)]
    every = [t for t, s, b, g in rows if not s]
    starts = Counter(w[:n] for w in every for n in range(STEMS[0], min(STEMS[1], len(w)) + 1))
    stems = {t: b for t, s, b in good_rows if s and starts[t] >= STEM_WORDS}
    chosen: dict[str, bool] = {}
    for stem in sorted(stems, key=len):
        if any(stem[:n] in stems for n in range(STEMS[0], len(stem))):
            continue
        while longer := [x for x in stems if len(x) == len(stem) + 1 and x.startswith(stem) and stems[x] >= 0.98 * stems[stem]]:
            stem = longer[0]
        chosen[stem] = True
    for t, s, _ in good_rows:
        if not s and not any(t[:n] in chosen for n in range(STEMS[0], len(t) + 1) if chosen.get(t[:n])):
            chosen[t] = False
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    sample = training_sample(docs, labels, most)
    sample = settle(sample, "toxicity-train")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    prior = (n_bad + 0.5) / (n_bad + n_good + 1.0)
    flat = Model(Lexicon({}), [math.log(prior / (1 - prior)), 0.0, 0.0])
    if not n_bad or not n_good:
        return flat
    spark = sample.sparkSession

    def all_terms(texts, toxic):
        return Counter((*term, y) for t, y in zip(texts, toxic, strict=True) if y for term in _candidates(t))

    seen = _counted(sample.where("toxic = 1"), all_terms).where("bad > 2").collect()
    terms = spark.sparkContext.broadcast({(r.term, r.stem) for r in seen})

    def known_terms(texts, toxic):
        return Counter((*term, y) for t, y in zip(texts, toxic, strict=True) for term in _candidates(t) & terms.value)

    rows = [(r.term, r.stem, r.bad, r.good) for r in _counted(sample, known_terms).collect()]
    first = Lexicon(choose_terms(rows, n_bad, n_good))
    sent = spark.sparkContext.broadcast(plain(first))

    def misspelled(texts, toxic):
        out: Counter = Counter()
        known = rebuilt(sent.value).lexicon
        for t, y in zip(texts, toxic, strict=True):
            out.update({(term, edits, y) for term, edits in known.hits_in(set(words(t))).values() if edits})
        return out

    near = _counted(sample, misspelled, "term string, edits int").collect()
    loose: Counter = Counter()
    for r in near:
        loose[r.term, 0] += r.bad
        loose[r.term, 1] += r.good
    exact_only = frozenset(t for t in first.terms if loose[t, 1] and loose[t, 0] / n_bad < LEAST_RATIO * loose[t, 1] / n_good)
    lexicon = Lexicon(first.terms, exact_only)
    final = spark.sparkContext.broadcast(plain(lexicon))

    def totals(batches):
        known = rebuilt(final.value).lexicon
        for batch in batches:
            found = [abuse(t, known) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.float64())], ["toxic", "total"])

    fitted = sample.mapInArrow(totals, "toxic int, total double").collect()
    x = np.array([features(r.total) for r in fitted])
    return Model(lexicon, fit_logistic(x, np.array([r.toxic for r in fitted], float)))


def score_column(spark: SparkSession, model: Model):
    """The score as a function of a text column."""
    sent = spark.sparkContext.broadcast(plain(model.lexicon, model.weights))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model = rebuilt(sent.value)
        return pa.array([model.score(t) for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return score


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    score = score_column(docs.sparkSession, learn(docs, labels))
    scored = docs.select("doc_id", held_out().alias("held_out"), score(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    score = score_column(docs.sparkSession, learn(docs, labels))
    return docs.where(score(text_or_empty()) < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
