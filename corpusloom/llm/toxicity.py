"""Toxicity by a weighted finite-state pattern grammar.

The lexicon transducer is a prefix automaton over lower-cased words: it accepts whole words and stems whose rate is
higher in toxic training texts and emits that log ratio. Its output is composed with a clause grammar: an automaton
that reads a clause word by word, keeps apart whether a target, a negation or reported speech is open, and emits each
matched insult or threat as plain, aimed, negated or reported. A text's score is a logistic function of the weights
that its matched clauses add up to; how much each kind counts is learned too, so negated and quoted insults need not
count like plain ones.

Training reads at most `max_rows` labelled rows (those with the smallest hash of their id; whole texts): two thirds
give the lexicon, one third the weights of the kinds. Scoring reads every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import pack, saved, unpacked

MAX_ROWS = 24_000  # labelled rows that training reads at most
MAX_ENTRIES = 2_000  # lexicon entries kept, best first: the size of the model that tasks receive
STEMS = range(3, 9)
MEMO = 300_000

# Closed-class words of the four languages.
TARGETS = ("you your yours yourself he him she her they them du dich dir euch ihr sie er ihn "
           "tu te toi vous il lui tú te ti usted ustedes él ella").split()
NEGATIONS = "not never no isn't aren't don't nicht nie kein keine ne pas jamais no nunca jamás".split()
REPORTS = ("said says wrote writes called calls claimed quoted sagte schrieb nannte dit écrit appelé dijo "
           "escribió llamó").split()
THREATS = "kill hurt destroy murder beat burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
_CLAUSE_END = frozenset(".!?;\n")
_REACH = 4  # words over which a target or a negation holds
FEATURES = ("plain", "aimed", "negated", "reported", "threats", "most", "density", "spread")


def held_out(key: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, divisible by 5 (a null id is a training row)."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


class Grammar:
    """The lexicon composed with the clause automaton."""

    def __init__(self, weights: dict[str, float]):
        self.whole = {k[:-1]: w for k, w in weights.items() if k.endswith("$")}
        self.stems = {k: w for k, w in weights.items() if not k.endswith("$")}
        self.lengths = sorted({len(k) for k in self.stems})
        self.memo: dict[str, float] = {}
        self.kind = {w: "t" for w in TARGETS} | {w: "n" for w in NEGATIONS} | {w: "r" for w in REPORTS}
        self.threats = frozenset(THREATS)

    def weight(self, word: str) -> float:
        """Output of the lexicon transducer: the best of the accepted word and stems, 0 where none is accepted."""
        best = self.whole.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.stems.get(word[:n], 0.0))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = best
        return best

    def features(self, text: str | None) -> list[float]:
        """One value per FEATURES; all 0 for a text without any match, an empty and a null one."""
        text = (text or "").lower()
        words = _WORD.findall(text)
        known = self.memo.get
        weights = list(map(known, words))
        if None in weights:
            weights = [self.weight(w) if (v := known(w)) is None else v for w in words]
        if not any(weights) and self.threats.isdisjoint(words):
            return [0.0] * len(FEATURES)
        sums = dict.fromkeys("panrt", 0.0)
        most, clauses, hit = 0.0, 0, False
        target = negation = -99
        reported = quoted = False
        for at, token in enumerate(_TOKEN.findall(text)):
            if not token[0].isalpha():
                if token in _CLAUSE_END:
                    clauses += hit
                    target = negation = -99
                    reported = hit = False
                elif token != ":":
                    quoted = not quoted
                continue
            kind = self.kind.get(token)
            if kind == "t":
                target = at
            elif kind == "n":
                negation = at
            elif kind == "r":
                reported = True
            w = known(token) or 0.0
            if w > 0:
                hit, most = True, max(most, w)
                state = ("n" if at - negation <= _REACH else "r" if reported and quoted
                         else "a" if at - target <= _REACH else "p")
                sums[state] += w
            if token in self.threats and at - target <= _REACH and at - negation > _REACH:
                hit = True
                sums["t"] += 1.0
        clauses += hit
        total = sum(sums.values())
        return [log1p(sums["p"]), log1p(sums["a"]), log1p(sums["n"]), log1p(sums["r"]), sums["t"], most,
                log1p(100 * total / max(len(words), 20)), log1p(clauses)]


def _lexicon_counts(train: DataFrame) -> DataFrame:
    """(entry, toxic, pos, neg): texts of each label that hold the entry, and its occurrences."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts: dict[str, int] = {}
                for word in _WORD.findall((text or "").lower()):
                    counts[word] = counts.get(word, 0) + 1
                entries: dict[str, int] = {}
                for word, n in counts.items():
                    for entry in chain([word + "$"], (word[:k] for k in STEMS if k < len(word))):
                        entries[entry] = entries.get(entry, 0) + n
                for entry, n in entries.items():
                    row = table.setdefault(entry, [0, 0, 0, 0])
                    row[toxic] += 1
                    row[2 + toxic] += n
            columns = list(zip(*table.values())) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(table), pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                ["entry", "docs0", "docs1", "n0", "n1"])

    sums = train.select("text", "toxic").mapInArrow(counted, "entry string, docs0 long, docs1 long, n0 long, n1 long")
    return sums.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("docs0", "docs1", "n0", "n1")])


def choose_entries(rows: list[tuple], texts0: int, texts1: int, n0: int, n1: int) -> dict[str, float]:
    """Weights of the entries that are kept, from (entry, docs0, docs1, n0, n1)."""
    weights = {e: log((c1 + 0.5) / (n1 + 1)) - log((c0 + 0.5) / (n0 + 1)) for e, d0, d1, c0, c1 in rows}
    docs = {e: d1 for e, d0, d1, c0, c1 in rows}
    # of nested entries with nearly the same texts the longest says most exactly what was seen
    longest = dict(weights)
    for e in weights:
        for k in STEMS:
            stem = e.rstrip("$")[:k]
            if stem != e and stem in docs and docs[e] >= 0.95 * docs[stem]:
                longest.pop(stem, None)
    # an entry below a kept stem of the same strength adds nothing
    kept = {}
    for e in sorted(longest, key=len):
        stems = [e.rstrip("$")[:k] for k in STEMS if k < len(e)]
        if all(s not in kept or kept[s] < longest[e] - 1.0 for s in stems):
            kept[e] = longest[e]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant last) by Newton steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_rows(docs: DataFrame, keep: list[str], grammar_weights: dict[str, float], model: list[float] | None) -> DataFrame:
    """`keep` with the features (model None) or the score of each text."""
    fields = [f for f in docs.select(*[f"`{c}`" for c in keep]).schema.fields]
    out = [T.StructField(n, T.DoubleType()) for n in (FEATURES if model is None else ("score",))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(grammar_weights)
        w = None if model is None else np.array(model)
        for batch in batches:
            x = np.array([grammar.features(t.as_py()) for t in batch.column(len(keep))]).reshape(-1, len(FEATURES))
            if w is None:
                columns = [pa.array(c) for c in x.T]
            else:
                columns = [pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *columns], [*keep, *[f.name for f in out]])

    return docs.select(*[f"`{c}`" for c in keep], F.col("text").alias("_text")).mapInArrow(scored, T.StructType(fields + out))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[dict[str, float], list[float]]:
    """(lexicon weights, weights of the features and the constant) from labelled rows that aren't held out.

    Repeated texts count once. With no labelled row, or labels of one kind only, the score is that label's for every
    text (near 0 where there is no label at all).
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    once = rows.groupBy(F.md5("text").alias("_m")).agg(F.min_by(F.struct("text", "toxic", "_h"), "doc_id").alias("r"))
    once = saved(once.select("r.text", "r.toxic", (F.pmod("r._h", F.lit(3)) == 0).alias("second")))
    base = once.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", r"\s+"))).alias("w")).collect()
    texts, words = {r["toxic"]: r["n"] for r in base}, {r["toxic"]: r["w"] for r in base}
    if not texts.get(0) or not texts.get(1):
        return {}, [0.0] * len(FEATURES) + [10.0 if texts.get(1) else -10.0]
    counts = _lexicon_counts(once.where("not second"))
    words1, words0 = words[1] * 2 / 3 + 1, words[0] * 2 / 3 + 1
    ratio = F.log((F.col("n1") + 0.5) / words1) - F.log((F.col("n0") + 0.5) / words0)
    spread = F.col("docs1") / (texts[1] * 2 / 3) - F.col("docs0") / (texts[0] * 2 / 3)
    best = (
        counts.where((F.col("docs1") >= 4) & (ratio > 0.7) & (spread > 0)).orderBy(F.desc(F.col("n1") * ratio), "entry")
        .limit(MAX_ENTRIES).select("entry", "docs0", "docs1", "n0", "n1").collect()
    )
    weights = choose_entries([tuple(r) for r in best], texts[0], texts[1], words0, words1)
    seen = _feature_rows(once.where("second"), ["toxic"], weights, None).toPandas()
    y = seen["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return weights, [1.0] * len(FEATURES) + [-3.0]
    return weights, list(map(float, _logistic(seen[list(FEATURES)].to_numpy(float), y)))


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]]) -> DataFrame:
    """docs without the text, with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts get the score of a text without matches; repeated rows are scored alike; columns named
    score or predicted are replaced and other columns pass through.
    """
    names = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    packed = pack(docs.select("text", *[f"`{c}`" for c in names]), "text")
    scored = _feature_rows(packed, ["_rest"], *model)
    return scored.select(*unpacked(names), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
