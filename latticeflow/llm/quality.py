"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-
maximisation over the counts of vote patterns of the whole corpus estimates how
accurate each labeller is; the posteriors label a bounded sample, on which a
hashed linear scorer is trained that then judges every document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq, itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, arrow_column, arrow_map

#: Features of the hashed scorer, and documents it is trained on at most (those whose ids have the smallest hash).
HASH_BITS, FIT_ROWS = 12, 8_000
REJECT = 0.5
#: What EM starts from: the share of good documents and how far a vote is trusted.
START_GOOD, START_ACCURACY = 0.8, 0.95
_MARK = re.compile(r"[^\w\s.,;:?'\"()\-|]")
_LETTERS = re.compile(r"[^\W_]+")
_ALNUM = re.compile(r"[^\W_]")

LABELLERS = (
    "marks", "tables", "capitals", "runs", "repeats", "letters", "word_length", "punctuation", "variety", "fragments",
)


def measures(text: str | None) -> dict[str, float]:
    """Numbers the labellers look at, over the whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return {"n": 0, "marks": 0, "tables": 0, "capitals": 0, "runs": 0, "repeats": 0, "letters": 0, "length": 0, "stops": 0, "variety": 0, "fragments": 0}
    size = sum(map(len, words))
    lines = [x for x in text.split("\n") if x]
    return {
        "n": n,
        "marks": len(_MARK.findall(text)) / n,
        "tables": text.count("|") / n,
        "capitals": sum(map(str.isupper, words)) / n,
        "runs": sum(map(eq, words, words[1:])) / n,
        "repeats": 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0,
        "letters": sum(map(len, _LETTERS.findall(text))) / size,
        "length": size / n,
        "stops": text.count(".") / n,
        "variety": len(set(words)) / n**0.8,
        "fragments": 1 - sum(map(bool, map(_ALNUM.search, words))) / n,
    }


def votes(m: dict[str, float]) -> list[int]:
    """One vote for each of LABELLERS: 1 good, 0 bad, -1 none."""

    def vote(x: float, bad: float, good: float) -> int:
        return 0 if x >= bad else 1 if x <= good else -1

    n = m["n"]
    if not n:
        return [0 if name == "fragments" else -1 for name in LABELLERS]
    return [
        vote(m["marks"], 0.7, 0.2),
        vote(m["tables"], 0.25, 0.02),
        vote(m["capitals"], 0.35, 0.05),
        vote(m["runs"], 0.3, 0.05) if n >= 8 else -1,
        vote(m["repeats"], 0.4, 0.1),
        0 if m["letters"] < 0.7 else 1 if m["letters"] > 0.9 else -1,
        0 if not 2 <= m["length"] <= 14 else 1 if 3 <= m["length"] <= 9 else -1,
        0 if n >= 60 and m["stops"] < 0.01 else 1 if m["stops"] >= 0.03 else -1,
        0 if n >= 60 and m["variety"] < 0.35 else 1 if n >= 30 and m["variety"] > 0.8 else -1,
        vote(m["fragments"], 0.2, 0.03),
    ]


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(share of good, p[labeller, class]) by EM over distinct vote patterns with
    counts; p is how often a labeller that votes says good, class 0 is bad, 1 good.
    That a labeller does not vote says nothing about the document."""
    votes_good, voted = (patterns == 1).astype(float), (patterns >= 0).astype(float)
    # At first a document is taken to be bad if any labeller says so.
    post = np.where((patterns == 0).any(axis=1), 1 - START_ACCURACY, START_ACCURACY)
    good, p = START_GOOD, np.zeros((patterns.shape[1], 2))
    for _ in range(rounds):
        mass = np.stack(((1 - post) * counts, post * counts))
        before = p
        p = ((mass @ votes_good + 1e-3) / (mass @ voted + 2e-3)).T
        good = float(np.clip(mass[1].sum() / mass.sum(), 0.02, 0.98))
        post = posterior(patterns, good, p)
        if np.abs(p - before).max() < 1e-6:
            break
    return good, p


def posterior(patterns: np.ndarray, good: float, p: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern of votes."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    for_good = np.log(p[:, 1] / p[:, 0])
    for_bad = np.log((1 - p[:, 1]) / (1 - p[:, 0]))
    z = (patterns == 1) @ for_good + (patterns == 0) @ for_bad + np.log(good / (1 - good))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


_BINNED = {
    "marks": 5, "tables": 20, "capitals": 20, "runs": 20, "repeats": 20, "letters": 20, "length": 1.5, "stops": 100, "variety": 10, "fragments": 20,
}


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & ((1 << HASH_BITS) - 1)


def hashed(text: str | None, m: dict[str, float]) -> np.ndarray:
    """Feature vector of 2^HASH_BITS: a bin of each measure, and how often words
    end in each character that is no letter or digit."""
    x = np.zeros(1 << HASH_BITS, np.float32)
    for name, per_unit in _BINNED.items():
        x[_slot(f"{name}:{min(20, int(m[name] * per_unit))}")] += 1.0
    for c, k in Counter(map(itemgetter(-1), (text or "").split())).items():
        if not c.isalnum():
            x[_slot(f"end:{c}")] += k / m["n"]
    return x


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    good: float
    accuracy: np.ndarray

    def score(self, text: str | None) -> float:
        """Probability that the document is good."""
        m = measures(text)
        z = float(hashed(text, m) @ self.weights) + self.bias
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def train_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch AdaGrad steps, over the
    columns that some document uses; the others keep weight 0."""
    used = np.flatnonzero(x.any(axis=0))
    full, x = np.zeros(x.shape[1], np.float32), x[:, used].astype(np.float64)
    w, b = np.zeros(len(used)), 0.0
    sum_w, sum_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * w
        gb = float((p - y).mean())
        sum_w += g * g
        sum_b += gb * gb
        w -= rate * g / np.sqrt(sum_w)
        b -= rate * gb / np.sqrt(sum_b)
    full[used] = w
    return full, b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Votes are counted over all documents; the scorer is trained on at most
    fit_rows of them, those whose ids have the smallest hash (of rows that share
    an id only the one of smallest text hash, so fit_rows holds whatever repeats). Null and empty
    texts get the vote of the last labeller only (bad). An empty table gives a
    model that calls everything good."""
    vote_schema = T.StructType(
        [T.StructField("pattern", T.StringType()), T.StructField("n", T.LongType())]
    )

    def count(batch: pa.RecordBatch) -> dict:
        seen: dict[str, int] = {}
        for t in batch.column(0).to_pylist():
            key = ",".join(map(str, votes(measures(t))))
            seen[key] = seen.get(key, 0) + 1
        return {"pattern": list(seen), "n": list(seen.values())}

    # At most 3 to the number of labellers patterns.
    rows = arrow_map(docs.select(text_col), count, vote_schema).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return Model(np.zeros(1 << HASH_BITS, np.float32), 10.0, START_GOOD, np.empty((0, 2)))
    rows.sort(key=lambda r: r["pattern"])
    patterns = np.array([[int(x) for x in r["pattern"].split(",")] for r in rows])
    good, p = em(patterns, np.array([r["n"] for r in rows], float))
    sample = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("h")).orderBy("h", "id").limit(fit_rows)
    ids = Table(sample.select("id").distinct(), "sample").df
    schema = T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.DoubleType())])

    def featurise(batch: pa.RecordBatch) -> dict:
        xs, ys = [], []
        for t in batch.column(0).to_pylist():
            m = measures(t)
            x = hashed(t, m)
            at = np.flatnonzero(x)
            xs.append(at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes())
            ys.append(float(posterior(np.array([votes(m)]), good, p)[0]))
        return {"x": xs, "y": ys}

    # At most fit_rows ids are broadcast.
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    picked = picked.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text")
    got = arrow_map(picked, featurise, schema).toArrow()
    packed, y = got.column("x").to_pylist(), got.column("y").to_numpy()
    order = sorted(range(len(packed)), key=lambda i: (packed[i], y[i]))  # the same sums whichever task came first
    x = np.zeros((len(packed), 1 << HASH_BITS), np.float32)
    for k, i in enumerate(order):
        n = len(packed[i]) // 6
        x[k, np.frombuffer(packed[i][: 2 * n], "<u2")] = np.frombuffer(packed[i][2 * n :], "<f4")
    if not len(x):
        return Model(np.zeros(1 << HASH_BITS, np.float32), 10.0, good, p)
    w, b = train_linear(x, y[order])
    return Model(w, b, good, p)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, good): one row per row of docs; score is the probability of a
    good document, good is score >= REJECT. Null and empty texts are judged as
    texts without words. Repeated and null ids stay rows."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("good", T.BooleanType()),
        ]
    )

    def run(batch: pa.RecordBatch) -> dict:
        s = [model.score(t) for t in batch.column(1).to_pylist()]
        return {"id": batch.column(0), "score": s, "good": [v >= REJECT for v in s]}

    return arrow_map(docs.select(id_col, text_col), run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = REJECT) -> DataFrame:
    """docs without the rows that score below threshold; columns as they were.
    Null and empty texts are judged as texts without words; an empty table stays empty."""
    good = lambda texts: [model.score(t) >= threshold for t in texts]
    return docs.where(arrow_column(good, T.BooleanType(), F.col(text_col)))
