"""Benchmark decontamination by SimHash of windows of the size of an item.

A window's fingerprint is the SimHash of its word shingles, repeats included;
blocks of the fingerprints of all items of that size are indexed, and the lookup
finds every item within RADIUS bits. Each window and item that it finds is then
verified by the exact similarity of their weighted shingles, whatever the order.

Windows that hold fewer of the benchmark's shingles than the similarity asks for
cannot resemble any item and are not fingerprinted. Shingles that repeat within an
item or a window sway a fingerprint together, so for those the radius says
little; such pairs are found exactly, by the shingles that they have in common.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_column, arrow_map

SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of benchmark text of one index, which is broadcast; larger benchmarks take a pass over the documents for each.
INDEX_BYTES = 16 << 20
#: Bits of a fingerprint, and how many may differ. Pairs right at a similarity of
#: 0.8 differ in about 35 of 256 bits (53 at most of 1,600), others in 128 (standard deviation 8).
BITS, RADIUS = 256, 80
#: Blocks of eight bits; a block that differs in e of them scores max(0, 1 + FREE - e).
#: Fingerprints within RADIUS score at least NEED in all: their e add up to no more than RADIUS.
BLOCKS, FREE = 32, 2
NEED = BLOCKS * (1 + FREE) - RADIUS
#: Starts whose shingle bits are counted at one time, and bytes of lookup tables that an index keeps.
SPAN, TABLE_BYTES = 4_096, 64 << 20
_WORD = re.compile(r"[^\W_]+")
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SCORE = np.maximum(0, 1 + FREE - np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(int)).astype(np.uint8)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], n: int = SHINGLE) -> list[str]:
    """Word shingles with repeats; a shorter sequence is one shingle."""
    if not words:
        return []
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    low = sum(min(c, b[k]) for k, c in a.items() if k in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


class _WordHashes(dict):
    """XXH64 of words; forgets them when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += hashes[k : k + m] * _PRIMES[k]
    return _mixed(total)


def shingle_bits(hashes: np.ndarray) -> np.ndarray:
    """BITS bits of each hash, as rows of 0 and 1."""
    wide = np.stack([_mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) for k in range(1, BITS // 64 + 1)], axis=1)
    return np.unpackbits(wide.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS // 8 bytes: each bit as in over half of the shingles."""
    return np.packbits(shingle_bits(hashes).sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little")


class Blocks:
    """The fingerprints of some items, by block."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        every = np.arange(256, dtype=np.uint8)
        self.table = np.stack([_SCORE[every[:, None] ^ prints[:, b]] for b in range(BLOCKS)])

    def candidates(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of wanted, item) of all pairs that score NEED in the blocks."""
        score = self.table[0][wanted[:, 0]]
        for b in range(1, BLOCKS):
            score = score + self.table[b][wanted[:, b]]
        return np.nonzero(score >= NEED)

    def within(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of wanted, item) of all pairs within RADIUS bits."""
        row, item = self.candidates(wanted)
        near = np.bitwise_count(wanted[row] ^ self.prints[item]).sum(axis=1, dtype=np.int64) <= RADIUS
        return row[near], item[near]


@dataclass
class _Sized:
    """Items of one size in words."""

    plain: list[int] = field(default_factory=list)  # no shingle twice
    prints: list[np.ndarray] = field(default_factory=list)
    repeating: set[int] = field(default_factory=set)

    def members(self) -> set[int]:
        return self.repeating.union(self.plain)


@dataclass
class Index:
    """Items by size and shingle length; picklable, tables are built on first use."""

    items: list[tuple[object, str]]
    similarity: float = SIMILARITY
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def ready(self) -> dict:
        if not self._ready:
            sized: dict[int, dict[int, _Sized]] = defaultdict(lambda: defaultdict(_Sized))  # shingle length, size
            held: dict[int, list[np.ndarray]] = defaultdict(list)
            owner: dict[int, list[np.ndarray]] = defaultdict(list)
            known = _WordHashes()
            for k, (_, text) in enumerate(self.items):
                words = words_of(text)
                if not words:
                    continue
                n = min(SHINGLE, len(words))
                hashes = rolling(known.of(words), n)
                distinct = np.unique(hashes)
                group = sized[n][len(words)]
                if len(distinct) == len(hashes):
                    group.plain.append(k)
                    group.prints.append(fingerprint(hashes))
                else:
                    group.repeating.add(k)
                held[n].append(distinct)
                owner[n].append(np.full(len(distinct), k))
            self._ready = {"sized": {n: dict(g) for n, g in sized.items()}, "words": known, "tables": OrderedDict(), "counts": {}}
            self._ready["seeds"] = {n: _Seeds(np.concatenate(held[n]), np.concatenate(owner[n])) for n in sized}
        return self._ready

    def _blocks(self, n: int, size: int) -> Blocks:
        """The lookup of one size; those not asked for of late make room."""
        tables = self.ready()["tables"]
        if (n, size) not in tables:
            tables[n, size] = Blocks(np.stack(self.ready()["sized"][n][size].prints))
            while len(tables) > 1 and sum(t.table.nbytes for t in tables.values()) > TABLE_BYTES:
                tables.popitem(last=False)
        tables.move_to_end((n, size))
        return tables[n, size]

    def _counts(self, k: int) -> Counter:
        counts = self.ready()["counts"]
        if k not in counts:
            if len(counts) >= 4_096:
                counts.clear()
            counts[k] = Counter(shingles(words_of(self.items[k][1])))
        return counts[k]

    def matches(self, text: str | None) -> dict[object, float]:
        """item id -> the highest similarity of a window, for those that reach it."""
        words = words_of(text)
        found: dict[object, float] = {}
        for size, p, k in self.candidates(words):
            sim = weighted_similarity(Counter(shingles(words[p : p + size])), self._counts(k))
            if sim >= self.similarity:
                item = self.items[k][0]
                found[item] = max(sim, found.get(item, 0.0))
        return found

    def candidates(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(size, start, item) of the windows and items to verify."""
        r = self.ready()
        if not words or not r["sized"]:
            return
        hashes = r["words"].of(words)
        for n, sizes in r["sized"].items():
            if len(words) < n:
                continue
            run = rolling(hashes, n)
            places = r["seeds"][n].places(run)
            if not len(places):
                continue
            again = _next_same(run)
            windows = []
            for size, group in sizes.items():
                per = size - n + 1
                held = min(per, len(run))
                need = max(1, int(np.ceil((per + held) * self.similarity / (1 + self.similarity) - 1e-9)))
                starts = _starts(places, held, need, max(0, len(words) - size))
                if len(starts):
                    windows.append((size, group, held, need, starts))
            for at in np.unique(np.concatenate([w[4] // SPAN for w in windows])).tolist() if windows else ():
                yield from self._in_span(n, run, again, windows, at * SPAN)

    def _in_span(self, n: int, run: np.ndarray, again: np.ndarray, windows: list, first: int) -> Iterator[tuple[int, int, int]]:
        some = []
        for size, group, held, need, starts in windows:
            a, b = np.searchsorted(starts, (first, first + SPAN))
            if a < b:
                some.append((size, group, held, need, starts[a:b]))
        end = max(int(s[-1]) + held for _, _, held, _, s in some)
        count = np.zeros((end - first + 1, BITS), np.int32)
        np.cumsum(shingle_bits(run[first:end]), axis=0, dtype=np.int32, out=count[1:])
        for size, group, held, need, starts in some:
            repeats = again[starts] < starts + held
            fresh = starts[~repeats]
            if group.plain and len(fresh):
                bits = (count[fresh - first + held] - count[fresh - first]) * 2 > held
                row, item = self._blocks(n, size).within(np.packbits(bits, axis=1, bitorder="little"))
                yield from ((size, int(p), group.plain[k]) for p, k in zip(fresh[row].tolist(), item.tolist(), strict=True))
            for p, twice in zip(starts.tolist(), repeats.tolist(), strict=True):
                if mine := group.members() if twice else group.repeating:
                    owners = self.ready()["seeds"][n].owners(run[p : p + held], need)
                    yield from ((size, p, k) for k in owners if k in mine)


def _next_same(run: np.ndarray) -> np.ndarray:
    """For each place the first place of a second hash equal to one from there on."""
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    after = np.full(len(run), len(run) + (1 << 40), np.int64)
    after[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(after[::-1])[::-1]


class _Seeds:
    """The benchmark's shingle hashes and whose they are; a table of their
    leading bits settles most questions."""

    def __init__(self, hashes: np.ndarray, owners: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.who = hashes[order], owners[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, values: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.seen[(values >> np.uint64(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.hashes, values[at]), len(self.hashes) - 1)
        return at[self.hashes[spot] == values[at]]

    def owners(self, values: np.ndarray, need: int) -> list[int]:
        """Items that have at least need of values, repeats included."""
        a, b = np.searchsorted(self.hashes, values, "left"), np.searchsorted(self.hashes, values, "right")
        who = np.concatenate([self.who[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        item, n = np.unique(who, return_counts=True)
        return item[n >= need].tolist()


def _starts(places: np.ndarray, held: int, need: int, last: int) -> np.ndarray:
    """Starts up to last of the windows of held shingles that have need of places.
    Sequences of a and b shingles that are as similar as asked have at least
    (a + b) * similarity / (1 + similarity) of them in common."""
    if len(places) < need:
        return np.empty(0, np.int64)
    low = np.maximum(places[need - 1 :] - held + 1, 0)
    high = np.minimum(places[: len(places) - need + 1], last)
    ok = low <= high
    if not ok.any():
        return np.empty(0, np.int64)
    first = int(low[ok].min())
    step = np.zeros(int(high[ok].max()) - first + 2, np.int64)
    np.add.at(step, low[ok] - first, 1)
    np.add.at(step, high[ok] + 1 - first, -1)
    return np.flatnonzero(np.cumsum(step) > 0) + first


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", similarity: float = SIMILARITY) -> Iterator:
    """The benchmark as broadcast indexes of about INDEX_BYTES of text each, so
    that what the driver and a task hold at once is bounded; a larger benchmark
    takes more passes. Null and blank items match nothing; ids keep their type."""
    spark = benchmark.sparkSession
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // INDEX_BYTES))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text")
        rows = [(r["item"], r["text"]) for r in part.collect() if words_of(r["text"])]
        if rows:
            yield spark.sparkContext.broadcast(Index(rows, similarity))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(id, item, similarity): for each row of docs the items that some window of
    the item's size resembles with weighted-shingle similarity of at least
    similarity, with the highest one. Words are lower-cased runs of letters and
    digits; five words a shingle, a shorter item is one shingle, and a text of
    fewer words than an item is one window. Null and empty texts and items match
    nothing; repeated and null ids stay rows, item ids may be of any type; items of
    one id count as one; empty tables give an empty result. Extra columns are
    ignored. Below a similarity of 0.7 RADIUS would miss pairs: a ValueError."""
    if similarity < 0.7:
        raise ValueError("similarity must be at least 0.7")
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("item", benchmark.schema[item_col].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    found = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, item_col, benchmark_text, similarity):

        def run(batch: pa.RecordBatch, index=index) -> dict:
            ids = batch.column(0).to_pylist()
            rows = [
                (ids[k], item, sim)
                for k, t in enumerate(batch.column(1).to_pylist())
                for item, sim in sorted(index.value.matches(t).items(), key=lambda x: (x[0] is None, x[0]))
            ]
            return {"id": [r[0] for r in rows], "item": [r[1] for r in rows], "similarity": [r[2] for r in rows]}

        found = found.unionByName(arrow_map(docs.select(id_col, text_col), run, schema))
    return found


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """docs without the rows that hold a benchmark item, as matches says; columns as they were."""
    for index in indexes(benchmark, item_col, benchmark_text, similarity):
        clean = lambda texts, index=index: [not index.value.matches(t) for t in texts]
        docs = docs.where(arrow_column(clean, T.BooleanType(), F.col(text_col)))
    return docs
