"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and a clause into symbols: a lexicon transducer writes each
word as insult, threat, target, negation, report or other.  Small transducers read the
symbols, each a table of arcs (state, symbol) -> (state, marks): one marks what a negation
governs, one what is reported speech, one what stands near a target, one what stands near
a threat, one passes on insults and threats themselves.  They are composed once into a
single table; its outputs give every matched step a kind of evidence (plain, negated,
reported, threat) and a weight, so that "not an idiot" or "he said they were idiots"
counts otherwise than an insult.  A document's evidence is summed over matched clauses.

The lexicon (whole words, and stems of inflected words) and the weights of the four kinds
of evidence are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.arrays import small_batches
from corpuslens.llm.store import settle, table

#: Bound on labelled rows used for fitting, drawn evenly by a hash of doc_id.
MAX_ROWS = 20_000
#: A feature enters if its G statistic is at least this, and its weight is.
LEAST_G, LEAST_WEIGHT = 15.0, 2.0
STEM_LENGTHS = range(3, 9)

#: Closed word classes of the grammar; threats are stems.
THREATS = "kill hurt destroy stab shoot shot beat burn strangl murder töte erschieß umbring umgebracht tuer frapper matar golpe".split()
TARGETS = "you your yours they them their he she him her du dich dir ihr euch tu toi vous te ti usted".split()
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't nicht kein keine ne pas jamais nunca sin".split()
REPORTS = "said says say wrote writes claimed quoted called reported alleged sagte schrieb dit écrit dijo escribió".split()
#: Words that a negation, a reporting verb, and a target or threat reach.
NEGATION_REACH, REPORT_REACH, TARGET_REACH = 3, 12, 4

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")
KINDS = ("plain", "negated", "reported", "threat")
SYMBOLS = ("other", "insult", "threat", "insult threat", "target", "negation", "report")
#: What an insult near a target weighs more than another.
NEAR = 1.25
#: Prior of the intercept and of each kind's weight, and its strength.
PRIOR, PRECISION = np.array([-3.0, 6.0, 2.5, 3.0, 6.0]), 0.05


def features_of(text: str) -> set[str]:
    """Words of a text, and their stems as ``stem*``."""
    out = set(WORD.findall(text.lower()))
    for w in list(out):
        out.update(w[:k] + "*" for k in STEM_LENGTHS if k < len(w))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, toxic of labelled rows outside the held-out fold, at most about ``max_rows``."""
    own = (
        labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = own.count()
    if n > max_rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    # about max_rows ids at most; texts stay where they are
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def document_counts(rows: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """Documents that hold each feature (all, or the wanted ones): feature, n."""

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = features_of(text)
                seen.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    return rows.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Features that mark toxic documents, with log-odds weights.

    Of a word and its stems the longest that keeps nearly all documents is taken."""
    kept: dict[str, float] = {}
    share = n_toxic / max(n_toxic + n_clean, 1)
    for f, t in toxic.items():
        c = clean.get(f, 0)
        weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        expected = (t + c) * share
        g = 2 * (t * math.log(t / expected) + (c * math.log(c / (t + c - expected)) if c else 0))
        if weight >= LEAST_WEIGHT and g >= LEAST_G:
            kept[f] = weight
    parent = lambda f: f[: len(f) - 2] + "*" if f.endswith("*") else f[:-1] + "*"
    best = dict(kept)
    for f in sorted(kept, key=len):  # a stem gives way to a longer one that finds as many
        up = parent(f)
        if up in best and toxic[f] >= 0.97 * toxic[up]:
            best.pop(up)
    for f in sorted(best, key=len, reverse=True):
        body = f.rstrip("*")
        for stem in (body[:k] + "*" for k in STEM_LENGTHS if k <= len(body)):
            if stem == f or stem not in best or f not in best:
                continue
            if best[stem] >= best[f] - 0.7:  # a word gives way to a stem that finds more
                best.pop(f)
            elif toxic[f] >= 0.6 * toxic[stem]:  # a vague stem gives way to the word that it was found by
                best.pop(stem)
    return best


class Transducer:
    """Arcs (state, symbol) -> (state, marks) from a start state; ``quoted`` is where a quoted clause starts."""

    def __init__(self, arcs: dict, start, quoted=None):
        self.arcs, self.start, self.quoted = arcs, start, start if quoted is None else quoted

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both on the same symbols: pairs of states that can be reached, and the marks of both."""
        arcs, seen, ahead = {}, set(), [(self.start, other.start), (self.quoted, other.quoted)]
        while ahead:
            state = ahead.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in SYMBOLS:
                (a, marks), (b, more) = self.arcs[state[0], symbol], other.arcs[state[1], symbol]
                arcs[state, symbol] = (a, b), marks | more
                ahead.append((a, b))
        return Transducer(arcs, (self.start, other.start), (self.quoted, other.quoted))


def reaching(trigger: str, reach: int, mark: str, in_quotes: bool = False) -> Transducer:
    """Marks the ``reach`` words after a trigger; the state is the number of words still reached."""
    arcs = {}
    for left in range(reach + 1):
        for symbol in SYMBOLS:
            arcs[left, symbol] = reach if trigger in symbol.split() else max(0, left - 1), frozenset([mark] if left else [])
    return Transducer(arcs, 0, reach if in_quotes else 0)


def passing(symbols: tuple[str, ...]) -> Transducer:
    """One state; passes on which of the symbols a word is."""
    return Transducer({(0, symbol): (0, frozenset(x for x in symbols if x in symbol.split())) for symbol in SYMBOLS}, 0)


def grammar_table() -> tuple[list[list[tuple[int, int, float, int]]], int, int]:
    """The composed transducer by number of state and symbol: (next state, kind of an insult or -1, its weight, kind of a threat or -1); its two starts."""
    composed = (
        passing(("insult", "threat", "target"))
        @ reaching("negation", NEGATION_REACH, "negated")
        @ reaching("report", REPORT_REACH, "reported", True)
        @ reaching("target", TARGET_REACH, "after target")
        @ reaching("threat", TARGET_REACH, "after threat")
    )
    number = {state: i for i, state in enumerate(dict.fromkeys(s for s, _ in composed.arcs))}
    table = []
    for state in number:
        row = []
        for symbol in SYMBOLS:
            after, marks = composed.arcs[state, symbol]
            governed = 2 if "reported" in marks else 1 if "negated" in marks else None
            insult = -1 if "insult" not in marks else 0 if governed is None else governed
            # a threat and its target, in either order
            met = "threat" in marks and "after target" in marks or "target" in marks and "after threat" in marks
            row.append((number[after], insult, NEAR if "after target" in marks else 1.0, -1 if not met else 3 if governed is None else governed))
        table.append(row)
    return table, number[composed.start], number[composed.quoted]


TABLE, START, QUOTED = grammar_table()


class Grammar:
    """The composed transducer with the lexicon transducer of one lexicon before it."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = {f: w / 10 for f, w in lexicon.items() if not f.endswith("*")}
        self.stems = {f[:-1]: w / 10 for f, w in lexicon.items() if f.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.threats = set(THREATS)
        self.threat_lengths = sorted(set(map(len, THREATS)))
        self.closed = {w: 4 for w in TARGETS} | {w: 5 for w in NEGATIONS} | {w: 6 for w in REPORTS}
        self.known: dict[str, tuple[int, float]] = {}
        self.finder = ahocorasick.Automaton()
        for f in [*self.words, *self.stems, *THREATS]:
            self.finder.add_word(f, len(f))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexicon transducer: a word's symbol and weight.  What the lexicon holds is an insult, whatever else it is."""
        weight = self.words.get(word, 0.0)
        for k in self.lengths:
            weight = max(weight, self.stems.get(word[:k], 0.0))
        threat = any(word[:k] in self.threats for k in self.threat_lengths)
        if weight or threat:
            return 1 * (weight > 0) + 2 * threat, weight
        return self.closed.get(word, 0), 0.0

    def clause(self, words: list[str], quoted: bool = False) -> list[float]:
        """Evidence of one clause by kind."""
        out = [0.0] * len(KINDS)
        state = QUOTED if quoted else START
        for word in words:
            found = self.known.get(word)
            if found is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                found = self.known[word] = self.symbol(word)
            state, insult, times, threat = TABLE[state][found[0]]
            if insult >= 0:
                out[insult] += found[1] * times
            if threat >= 0:
                out[threat] += 1.0
        return out

    def evidence(self, text: str | None) -> list[float]:
        """Evidence of a whole text: log(1 + sum over its matched clauses), by kind."""
        low = (text or "").lower()
        total = [0.0] * len(KINDS)
        done = 0
        for end, size in self.finder.iter(low) if len(self.finder) else ():
            start = end - size + 1
            if end < done or start and low[start - 1].isalnum():
                continue
            left = max((low.rfind(c, done, start) for c in ".!?;:\n"), default=-1)
            left = max(left + 1, done)
            stop = CLAUSE_END.search(low, end)
            right = stop.start() if stop else len(low)
            body = low[left:right]
            quoted = body.lstrip()[:1] in ('"', "“", "«", "„") and len(body) > 0
            for k, x in enumerate(self.clause(WORD.findall(body), quoted)):
                total[k] += x
            done = right + 1
        return [math.log1p(x) for x in total]


def fit_weights(evidence: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights (intercept, then each kind) under a normal prior, by Newton steps."""
    x = np.hstack([np.ones((len(evidence), 1)), evidence])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + PRECISION * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights learned from labelled rows (columns doc_id, toxic of ``labels``)."""
    rows = settle(training_rows(docs, labels, max_rows), "toxicity-training")
    n = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    # a feature of fewer texts cannot be significant, even if all of them are toxic; of at most max_rows texts
    least = max(1, math.ceil(LEAST_G / (2 * math.log((n_toxic + n_clean) / n_toxic)))) if n_toxic and n_clean else 1
    toxic = {r[0]: r[1] for r in document_counts(rows.filter("toxic = 1")).filter(F.col("n") >= least).collect()}
    clean = {r[0]: r[1] for r in document_counts(rows.filter("toxic = 0"), set(toxic)).collect()}
    lexicon = choose_lexicon(toxic, clean, n_toxic, n_clean)

    def read(batches):
        grammar = Grammar(lexicon)
        for batch in batches:
            e = [grammar.evidence(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.list_(pa.float64())), batch.column(1)], ["e", "toxic"])

    sample = rows.mapInArrow(read, "e array<double>, toxic int").groupBy("e", "toxic").count().collect()  # bounded by max_rows
    if not sample:
        return lexicon, PRIOR.copy()
    e = np.repeat(np.array([r[0] for r in sample], float), [r[2] for r in sample], axis=0)
    y = np.repeat(np.array([r[1] for r in sample], float), [r[2] for r in sample])
    return lexicon, fit_weights(e, y)


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    A null text counts as empty and gets the score of a text without matches.
    Repeated rows are scored once each, a null doc_id is kept; other columns, whatever
    their names, are ignored; an empty table gives no rows."""

    def run(batches):
        grammar = Grammar(lexicon)
        for batch in batches:
            e = np.array([grammar.evidence(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(KINDS))
            p = 1 / (1 + np.exp(-np.clip(weights[0] + e @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def clean_rows(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below 0.5.

    Null and empty texts have no matches; repeated rows and null ids are judged one by one."""
    at = docs.columns.index("text")

    def run(batches):
        grammar = Grammar(lexicon)
        for batch in small_batches(batches):
            e = np.array([grammar.evidence(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(KINDS))
            yield batch.filter(pa.array(weights[0] + e @ weights[1:] < 0))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    lexicon, weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon, weights).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted"
    )
