"""Toxicity by a weighted lexicon and Aho-Corasick.

Text is folded (case, look-alike letters, digits used as letters), the lexicon of
words and word beginnings is learned from labelled documents, and each document
is scored from the weights of what matches, normalised by its length. A match
inside an exception phrase does not count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column, arrow_map

#: Letters of other alphabets that look like Latin ones, and digits read as letters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Harmless phrases that hold words which are otherwise insults.
EXCEPTIONS = ("clown fish", "clownfish", "class clown", "trash can", "trash bin", "trash bag", "pond scum", "stupid question")
#: Rows of either label that the lexicon and the weights are learned from, at most; the rows of smallest hash are taken.
FIT_ROWS = 20_000
MAX_TERMS, MIN_DOCS, MIN_LOG_ODDS = 20_000, 4, 2.0
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
# Full-width Latin letters and digits by rule; marks that take no space are dropped.
_FOLD |= {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {0xFF10 + i: DIGITS.get(str(i), str(i)) for i in range(10)}
_FOLD |= dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_SIGN = {"@": "a", "$": "s", "!": "i", "|": "l"}


def fold(text: str | None) -> str:
    """Words of folded letters, each after one space, and a last space."""
    text = unicodedata.normalize("NFC", (text or "").lower()).translate(_FOLD)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: _SIGN[m[0]], text)
    words = _LETTERS.findall(text)
    return " " + " ".join(words) + " " if words else " "


def patterns(folded: str) -> set[str]:
    """What a document can teach: its words, and beginnings of longer words."""
    found = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            found.add(f" {w} ")
            for k in PREFIXES:
                if k >= len(w):
                    break
                found.add(f" {w[:k]}")
    return found


@dataclass
class Scorer:
    """A lexicon with weights and the document-level weights; picklable."""

    lexicon: dict[str, float]
    weights: list[float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def machine(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for p, w in self.lexicon.items():
                self._machine.add_word(p, (len(p), w))
            for p in self.exceptions:
                word = fold(p)
                self._machine.add_word(word, (len(word), None))
            self._machine.make_automaton()
        return self._machine

    def features(self, text: str | None) -> list[float]:
        folded = fold(text)
        best: dict[int, float] = {}  # by the word's start: the heaviest match counts once
        harmless: list[tuple[int, int]] = []
        machine = self.machine()
        for end, (n, w) in machine.iter(folded) if len(machine) else ():
            start = end - n + 1
            if w is None:
                harmless.append((start, end))
            else:
                best[start] = max(w, best.get(start, 0.0))
        if harmless:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in harmless)}
        words = max(1, folded.count(" ") - 1)
        total = sum(best.values())
        return [1.0, max(best.values(), default=0.0), math.log1p(len(best)), math.log1p(100 * total / words)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first column is the intercept."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty @ beta
        hess = (x.T * (weight * p * (1 - p))) @ x + penalty
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Scorer:
    """Learn from the rows of labels (id, label); null ids and labels are left
    out, a document labelled twice counts as toxic if either label says so.

    At most fit_rows documents of each label are read, those whose ids have the
    smallest hash, and weighted to stand for all. Without toxic or without clean
    rows the lexicon is empty and every score is the share of toxic labels.
    """
    said = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = [sizes.get(0, 0), sizes.get(1, 0)]
    if not all(total):
        prior = (total[1] + 0.5) / (sum(total) + 1)
        return Scorer({}, [math.log(prior / (1 - prior)), 0.0, 0.0, 0.0], exceptions)
    some = [said.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for t in (0, 1)]
    # At most 2 x fit_rows ids are broadcast.
    picked = F.broadcast(some[0].unionByName(some[1]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").select("text", "toxic")

    def teach(batch: pa.RecordBatch) -> dict:
        counts: list[Counter] = [Counter(), Counter()]
        for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            counts[toxic].update(patterns(fold(text)))
        terms = list(counts[0].keys() | counts[1].keys())
        return {"term": terms, "clean": [counts[0][t] for t in terms], "toxic": [counts[1][t] for t in terms]}

    seen = [min(n, fit_rows) for n in total]
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("clean", T.LongType()), T.StructField("toxic", T.LongType())]
    )
    rate = lambda c, n: (F.col(c) + F.lit(0.5)) / (n + 1)
    terms = (
        arrow_map(rows, teach, schema)
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_DOCS)
        .withColumn("weight", F.log(rate("toxic", seen[1])) - F.log(rate("clean", seen[0])))
        .where(F.col("weight") >= MIN_LOG_ODDS)
        .orderBy(F.desc(F.col("weight") * F.log1p("toxic")), "term")
        .limit(MAX_TERMS)
    )
    scorer = Scorer({r["term"]: r["weight"] for r in terms.collect()}, [0.0] * 4, exceptions)

    def measure(batch: pa.RecordBatch) -> dict:
        rounded = Counter(
            (t, *(round(v, 2) for v in scorer.features(x)))
            for x, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)
        )
        keys = list(rounded)
        return {"toxic": [k[0] for k in keys], "x": [list(k[1:]) for k in keys], "n": [rounded[k] for k in keys]}

    schema = T.StructType(
        [T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
    )
    got = arrow_map(rows, measure, schema).toArrow()
    if got.num_rows:
        x = np.array(got.column("x").to_pylist(), float)
        y = got.column("toxic").to_numpy().astype(float)
        weight = got.column("n").to_numpy() * np.where(y == 1, total[1] / seen[1], total[0] / seen[0])
        order = np.lexsort(np.column_stack((x, y)).T)  # sums don't depend on which task came first
        scorer.weights = logistic(x[order], y[order], weight[order]).tolist()
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs: the whole text is matched. Null and
    empty texts get the score of a text without matches; ids may repeat or be
    null. Extra columns are ignored."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "score": [scorer.score(t) for t in batch.column(1).to_pylist()]}

    return arrow_map(docs.select(id_col, text_col), run, schema)


def held_out(id_col) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at least threshold; columns as they were.
    Null and empty texts score as texts without matches; an empty table stays empty."""
    fine = lambda texts: [scorer.score(t) < threshold for t in texts]
    return docs.where(arrow_column(fine, T.BooleanType(), F.col(text_col)))
