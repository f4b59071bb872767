"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item (all words of an item that
has fewer).  Of every 13 words the smallest hash of their nine 5-word grams is
the fingerprint, on both sides: equal windows have equal fingerprints, so every
shared span of 13 words or more is found.  For items with fewer words, the hash of
all their words is the fingerprint.  Fingerprints of documents and benchmark are
joined; a hit is extended to all words of its window, and windows are equal if the
128-bit digests (blake2b) of their words are.

A benchmark of at most SMALL bytes of text (checked by a sum) is one broadcast index,
and documents stream past it once; nothing is shuffled.  A larger one stays a table:
fingerprints, then digests of the windows that they leave, are joined by shuffles, in
which the benchmark's side has one row for each key, so that a passage that many
documents share can be split like any skewed join.  No task's memory grows with either side.

Edge cases: null and empty texts have no words and no hits; items without words
are never found; an item without an id hits words but is not listed; equal
item ids count once; repeated documents are judged each on its own; other
columns pass through, and names that clash with the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, numbered, stored
from .textscan import ALNUM, LOWER, grams, slices, window_min, word_hashes, word_spans

#: Bytes of a benchmark's texts that are broadcast as one index (about 5 bytes of index each).
SMALL = 4 << 20
OWN = ["n_words", "n_hit", "n_items", "items", "contaminated"]
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Words:
    """The words of a run of texts: their hashes, rows and bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, self.row = word_spans(self.data, offsets, ALNUM)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))

    def digests(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The digests of the windows of so many words that begin at these words, in two halves."""
        out = bytearray()
        for i in at.tolist():
            said = b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(i, i + length))
            out += hashlib.blake2b(said, digest_size=16).digest()
        both = np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def prints(self, length: int, window: int, gram: int) -> np.ndarray:
        """The fingerprint of every run of so many words (also of those across rows)."""
        if length < window:
            return grams(self.hashes, length)
        return window_min(grams(self.hashes, gram), window - gram + 1)

    def whole(self, at: np.ndarray, length: int) -> np.ndarray:
        """Those of the windows that lie in one row."""
        return at[self.row[at] == self.row[at + length - 1]]


def _bytes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


def windows(text: str | None, window: int, gram: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(length, fingerprints, digests in two halves) of the windows of an item."""
    words = Words(*_bytes(text))
    length = min(len(words.hashes), window)
    if not length:
        none = np.zeros(0, np.uint64)
        return 0, none, none, none
    at = np.arange(len(words.hashes) - length + 1)
    return length, words.prints(length, window, gram), *words.digests(at, length)


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """Which top bits occur among the keys: a cheap first test."""
    out = np.zeros(1 << 18, bool)
    out[(keys >> np.uint64(46)).astype(np.int64)] = True
    return out


class Index:
    """All windows of a small benchmark.  prints: window length -> sorted fingerprints; windows:
    window length -> (sorted digests in two halves, bounds into numbers of names)."""

    def __init__(self, items: list[tuple[object, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[int, list] = {}
        for item_id, text in items:
            length, *columns = windows(text, window, gram)
            own = np.full(len(columns[0]), -1 if item_id is None else number[str(item_id)], np.int32)
            found.setdefault(length, []).append((*columns, own))
        found.pop(0, None)
        self.prints, self.windows = {}, {}
        for length, parts in found.items():
            prints, low, high, own = (np.concatenate([p[k] for p in parts]) for k in range(4))
            keys = np.unique(prints)
            self.prints[length] = keys, _bitmap(keys)
            order = np.lexsort((own, high, low))
            low, high, own = low[order], high[order], own[order]
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            self.windows[length] = low[first], high[first], np.append(first, len(low)), own

    def find(self, words: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(first words of occurring windows, window length, the windows' numbers)."""
        for length, (keys, maybe) in self.prints.items():
            prints = words.prints(length, self.window, self.gram)
            at = np.flatnonzero(maybe[(prints >> np.uint64(46)).astype(np.int64)])
            k = np.minimum(np.searchsorted(keys, prints[at]), len(keys) - 1)
            at = words.whole(at[keys[k] == prints[at]], length)
            if not len(at):
                continue
            low, high, *_ = self.windows[length]
            x, y = words.digests(at, length)
            k = np.minimum(np.searchsorted(low, x), len(low) - 1)
            while len(more := np.flatnonzero((low[k] == x) & (high[k] < y) & (np.append(low[1:], ~low[-1])[k] == x))):
                k[more] += 1
            hit = (low[k] == x) & (high[k] == y)
            if hit.any():
                yield at[hit], length, k[hit]

    def items(self, length: int, k: int) -> set[str]:
        *_, bounds, own = self.windows[length]
        return {self.names[i] for i in own[bounds[k] : bounds[k + 1]].tolist() if i >= 0}


def _covered(n: int, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _scan(index):
    """Fills n_words, n_hit and items of rows that pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], set[str]] = {}
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for i, j, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                words = Words(data, offsets)
                hit = np.zeros(len(words.hashes), bool)
                found: dict[int, set] = {}
                for at, length, k in index.value.find(words):
                    hit |= _covered(len(hit), at, length)
                    for r, w in zip(words.row[at].tolist(), k.tolist(), strict=True):
                        if (length, w) not in known:
                            known[length, w] = index.value.items(length, w)
                        found.setdefault(r, set()).update(known[length, w])
                total = np.concatenate([[0], np.cumsum(hit)])[words.bounds]
                n_words += np.diff(words.bounds).tolist()
                n_hit += np.diff(total).tolist()
                items += [sorted(found.get(r, ())) for r in range(j - i)]
            made = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(
                [made.get(f.name, batch.column(k)) for k, f in enumerate(batch.schema)],
                schema=pa.schema([pa.field(f.name, made[f.name].type) if f.name in made else f for f in batch.schema]),
            )

    return run


def _windows_of(window: int, gram: int):
    """Rows (n, print, low, high, item) of the windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                length, *columns = windows(text, window, gram)
                if length:
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, length, np.int32)), *[pa.array(c.view(np.int64)) for c in columns], pa.array([item] * n, pa.string())],
                        names=["n", "print", "low", "high", "item"],
                    )

    return run


def _prints_of(lengths: list[int], window: int, gram: int):
    """Rows (row, n, print) of the different fingerprints of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, _, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                for length in lengths:
                    prints = words.prints(length, window, gram)
                    at = words.whole(np.arange(len(prints)), length)
                    both = np.unique(np.stack([words.row[at].astype(np.uint64), prints[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[i + both[0].astype(np.int64)]), pa.array(np.full(both.shape[1], length, np.int32)), pa.array(both[1].view(np.int64))],
                        names=["row", "n", "print"],
                    )

    return run


def _extend(window: int, gram: int):
    """Rows (row, n, low, high, at) of the windows whose fingerprints the benchmark has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for i, j, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                for r in range(i, j):
                    a, b = int(words.bounds[r - i]), int(words.bounds[r - i + 1])
                    for length in {p["n"] for p in prints[r]}:
                        own = np.array([p["print"] for p in prints[r] if p["n"] == length], np.int64).view(np.uint64)
                        at = np.flatnonzero(np.isin(words.prints(length, window, gram)[a : b - length + 1], own)) + a
                        low, high = words.digests(at, length)
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, ids[r])), pa.array(np.full(n, length, np.int32)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(at - a)],
                            names=["row", "n", "low", "high", "at"],
                        )

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for places in batch.column(1).to_pylist():
            at, n = np.array([p["at"] for p in places]), np.array([p["n"] for p in places])
            hits.append(int(_covered(int((at + n).max()), at, n).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64()), batch.column(2)], names=["row", "hit", "found"])


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """docs with n_words, n_hit and items, by joins of tables."""
    told = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(_windows_of(window, gram), "n int, print long, low long, high long, item string")
    told = stored(told.groupBy("n", "print", "low", "high").agg(F.collect_set("item").alias("names")), "benchmark-windows")
    lengths = sorted(r["n"] for r in told.select("n").distinct().collect())  # 13 at most
    number, text = free("_number", docs.columns), F.coalesce("text", F.lit(""))
    rows = numbered(docs, number, "decontaminate-rows")
    texts = rows.select(F.col(number).alias("row"), text.alias("text"))
    prints = texts.mapInArrow(_prints_of(lengths, window, gram), "row long, n int, print long")
    shared = prints.join(told.select("n", "print").distinct(), ["n", "print"]).groupBy("row").agg(F.collect_list(F.struct("n", "print")).alias("prints"))
    near = texts.join(shared, "row").select("row", "text", "prints").mapInArrow(_extend(window, gram), "row long, n int, low long, high long, at long")
    hits = near.join(told.drop("print"), ["n", "low", "high"])
    by_row = hits.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("places"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))).alias("found"))
    found = by_row.mapInArrow(_count, "row long, hit long, found array<string>")
    row, hit, names = (free(c, [*docs.columns, number]) for c in ("_row", "_hit", "_found"))
    found = found.toDF(row, hit, names)
    return rows.join(found, F.col(number) == F.col(row), "left").select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in OWN],
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("n_words"),
        F.coalesce(hit, F.lit(0)).alias("n_hit"), F.coalesce(names, F.array().cast("array<string>")).alias("items"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 5, share: int = 20, small: int = SMALL
) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings), n_items and contaminated:
    n_hit > 0 and share * n_hit >= n_words."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > small:
        df = _joined(docs, benchmark, window, gram)
    else:
        items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
        index = docs.sparkSession.sparkContext.broadcast(Index(items, window, gram))
        df = docs.select(
            *rest, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items")
        )
        df = df.mapInArrow(_scan(index), T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema]))
    return df.select(
        *rest, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, in the columns of docs."""
    own = docs.columns
    clash = {c: free(f"_{c}", own) for c in own if c in OWN}
    kept = contamination(docs.withColumnsRenamed(clash), benchmark, **options).where(~F.col("contaminated"))
    return kept.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in own])
