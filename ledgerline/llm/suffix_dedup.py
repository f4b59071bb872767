"""Suffix-array deduplication of exact substrings.

Removes every byte that a `window`-byte string covers which also starts at any other
place, in the same document or another one.

1. Of all 32-byte grams in a window the one with the least hash is its anchor (the
   leftmost of equals).  Equal windows have equal anchors at equal places, so a window
   can only repeat if its anchor does: of the text, only surroundings of repeated
   anchors go on.  An anchor that repeats inside a batch is known as such at once; of
   every other anchor one small row is counted.
2. The surroundings of repeated anchors (the bytes of all windows that have this anchor)
   are dealt by anchor.  Equal surroundings become one with many places, first in the
   batch, then in the task.  An anchor that more than HOT rows hold is split by further
   bytes: its windows fall in CLASSES by where the anchor stands in them, all windows of a
   class share bytes beside the anchor, and these name the part, so equal windows meet.  Suffixes of the different surroundings are sorted by induced
   sorting with common-prefix values (suffix_sort.py), a few MB of anchors at a time;
   a single anchor with more than that spills its queue to files.  Runs of suffixes that
   share `window` bytes are repeated windows.
3. Their places are joined to the documents that have any, and cut out.

Rows are told apart by numbers (file and place in it for scans, else those of a stored
table), so rows that repeat, ids included, are documents of their own, and a lost executor
or another split of the input changes no number.

Edge cases: null and empty texts, and texts shorter than the window, keep all bytes;
repeated rows of that length lose all; other columns pass through in cut(), and an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free, numbered, stored
from .suffix_sort import suffix_array
from .textscan import _power_tables, mix, raw, rolling, slices, window_min

GRAM = 32
#: Bytes of surroundings that are sorted at once; above SPILL bytes a queue goes to files.
SHARD, SPILL = 2 << 20, 1 << 28
#: Anchors in more rows than HOT are split, their windows in so many classes.
HOT, CLASSES = 4096, 8
U = np.uint64
HIGH, LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(key, row, first window, last window, place) of every anchor, windows by their start in data."""
    span = window - GRAM + 1
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= window)
    if n <= 0 or not len(long):
        return none.view(np.uint64), none, none, none, none
    sums = rolling(data)
    inverse = _power_tables(len(sums))[1]
    g = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM])
    least = window_min((g & HIGH) | np.arange(len(g), dtype=np.uint64), span)
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[long]] = 1
    edge[offsets[long + 1] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    place = (least[first] & LOW).astype(np.int64)
    return g[place], np.searchsorted(offsets, at[first], "right") - 1, at[first], at[last], place


def parts(data: np.ndarray, first: int, last: int, place: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(key, first window, last window) of the parts of one anchor's windows: the key tells the
    bytes that all windows of the class have, by which equal windows are in equal parts."""
    span = window - GRAM + 1  # places of an anchor in a window
    for c in range(CLASSES):
        low, high = c * span // CLASSES, (c + 1) * span // CLASSES - 1  # windows start so far before the anchor
        a, b = max(first, place - high), min(last, place - low)
        if a <= b:
            shared = data[place - low : place - high + window].tobytes()
            yield int.from_bytes(hashlib.blake2b(bytes([c]) + shared, digest_size=8).digest(), "little", signed=True), a, b


def _keys(window: int):
    """Rows (key, row, known): known keys repeat in the batch; row -1 stands for such a key elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys, rows = [], []
            for i, _, data, offsets in slices(batch.column(1)):
                key, row, *_ = anchors(data, offsets, window)
                keys.append(key)
                rows.append(ids[i + row])
            if not keys:
                continue
            key, row = np.concatenate(keys).view(np.int64), np.concatenate(rows)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            single = new & np.append(new[1:], True)
            many = ~single
            lead = new & many
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[single], key[lead], key[many]])),
                    pa.array(np.concatenate([row[single], np.full(int(lead.sum()), -1, np.int64), row[many]])),
                    pa.array(np.concatenate([np.zeros(int(single.sum() + lead.sum()), bool), np.ones(int(many.sum()), bool)])),
                ],
                names=["key", "row", "known"],
            )

    return run


def _surroundings(window: int, hot: Broadcast):
    """Rows (key, bytes, rows, starts): the bytes of a repeated anchor's windows, and all their places in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = hot.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            wanted = batch.column(2)
            found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for i, _, data, offsets in slices(batch.column(1)):
                key, row, first, last, place = anchors(data, offsets, window)
                bounds = np.searchsorted(row, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    a, b = int(bounds[r]), int(bounds[r + 1])
                    own = key[a:b].view(np.int64)
                    for k in (np.flatnonzero(np.isin(own, wanted[i + r].values.to_numpy())) + a).tolist():
                        name, begin, end = int(key[k].view(np.int64)), int(first[k]), int(last[k])
                        for own_key, x, y in parts(data, begin, end, int(place[k]), window) if name in split else [(name, begin, end)]:
                            found.setdefault((own_key, data[x : y + window].tobytes()), []).append((int(ids[i + r]), int(x - offsets[r])))
            entries = list(found.items())
            for a in range(0, len(entries), 20_000):
                part = entries[a : a + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for (k, _), _ in part], pa.int64()), pa.array([p for (_, p), _ in part], pa.binary()),
                        pa.array([[r for r, _ in x] for _, x in part], pa.list_(pa.int64())),
                        pa.array([[s for _, s in x] for _, x in part], pa.list_(pa.int64())),
                    ],
                    names=["key", "piece", "rows", "starts"],
                )

    return run


def repeated(pieces: list[bytes], copies: list[int], window: int, spill: int | None = None) -> list[np.ndarray]:
    """For every piece (all different), which of its windows occur twice or more, counting copies."""
    if len(pieces) == 1:
        return [np.full(len(pieces[0]) - window + 1, copies[0] > 1)]
    starts, common, offsets = suffix_array(pieces, window, spill)
    piece = np.searchsorted(offsets, starts, "right") - 1
    fits = starts + window < offsets[piece + 1]
    group = np.cumsum(common < window)  # runs that share a whole window
    weight = np.where(fits, np.array(copies, np.int64)[piece], 0)
    total = np.bincount(group, weights=weight)
    hit = np.zeros(int(offsets[-1]), bool)
    hit[starts[fits & (total[group] > 1)]] = True
    return [hit[offsets[k] : offsets[k + 1] - window] for k in range(len(pieces))]


def _runs(hit: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of bytes that the marked windows cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    return list(zip(at[first].tolist(), (at[last] + window).tolist(), strict=True))


def _sort(window: int):
    """Rows arrive sorted by key; whole keys are sorted together, SHARD bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, dict[bytes, list[tuple[list[int], list[int]]]]] = {}
        size, now = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal size
            alone, pieces, places = [], [], []
            for by_piece in keys.values():
                if len(by_piece) == 1:
                    alone += by_piece.items()
                else:
                    pieces += by_piece.keys()
                    places += by_piece.values()
            out: list[tuple[int, int, int]] = []

            def tell(hit: np.ndarray, at: list[tuple[list[int], list[int]]]) -> None:
                if spans := _runs(hit, window):
                    for rows, starts in at:
                        out.extend((r, s + a, s + b) for r, s in zip(rows, starts, strict=True) for a, b in spans)

            count = lambda at: sum(len(rows) for rows, _ in at)
            for piece, at in alone:
                tell(repeated([piece], [count(at)], window)[0], at)
            if pieces:
                spill = SPILL if size > 8 * SHARD else None
                for hit, at in zip(repeated(pieces, [count(at) for at in places], window, spill), places, strict=True):
                    tell(hit, at)
            keys.clear()
            size = 0
            for a in range(0, len(out), 100_000):
                part = out[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in range(3)], names=["row", "begin", "end"])

        for batch in batches:
            for key, piece, rows, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if size >= SHARD:
                        yield from close()
                    now = key
                at = keys.setdefault(key, {}).setdefault(piece, [])
                if not at:
                    size += len(piece)
                at.append((rows, starts))
        yield from close()

    return run


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = raw(batch.column(1))
        removed, runs, kept = [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text, spans = data[offsets[i] : offsets[i + 1]].tobytes(), _merged(spans)
            ends = [0, *[b for _, b in spans]]
            starts = [*[a for a, _ in spans], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
            removed.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["row", "n_removed", "n_spans", "kept"],
        )


def _hits(docs: DataFrame, window: int) -> DataFrame:
    """row, n_removed, n_spans and kept (bytes) of the rows that lose anything; docs has row and text."""
    keyed = docs.mapInArrow(_keys(window), "key long, row long, known boolean")
    # Known keys need no count: by their rows they spread over all tasks.
    place = F.when(F.col("known"), F.col("row"))
    times = F.count(F.lit(1)).over(Window.partitionBy("key", "known", place))
    again = keyed.withColumn("times", times).where("row >= 0 and (known or times > 1)")
    wanted = again.groupBy("row").agg(F.collect_set("key").alias("keys"))
    near = stored(docs.join(wanted, "row").select("row", "text", "keys"), "suffix-documents")
    common = near.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > HOT)
    hot = docs.sparkSession.sparkContext.broadcast({key for key, _ in common.collect()})  # one in HOT of the places at most
    pieces = near.mapInArrow(_surroundings(window, hot), "key long, piece binary, rows array<long>, starts array<long>")
    dealt = pieces.repartition("key").sortWithinPartitions("key")
    spans = dealt.mapInArrow(_sort(window), "row long, begin long, end long")
    grouped = spans.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return near.select("row", "text").join(grouped, "row").mapInArrow(_cut, "row long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = numbered(docs.select("doc_id", "text"), "row", "suffix-rows").withColumn("text", F.coalesce("text", F.lit("")))
    hits = _hits(rows.select("row", "text"), window).select("row", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    whole = rows.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("all_sha"))
    return whole.join(hits, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("sha", "all_sha").alias("kept_sha256"),
    )


def cut(docs: DataFrame, window: int = 200) -> DataFrame:
    """docs without the repeated bytes, in the columns of docs; what a cut leaves of a
    character is replaced by U+FFFD."""
    number, row, kept = (free(c, docs.columns) for c in ("_number", "_row", "_kept"))
    rows = numbered(docs, number, "suffix-rows")
    hits = _hits(rows.select(F.col(number).alias("row"), F.coalesce("text", F.lit("")).alias("text")), window).select(F.col("row").alias(row), F.col("kept").alias(kept))
    text = F.when(F.col(kept).isNotNull(), F.make_valid_utf8(F.col(kept).cast("string"))).otherwise(F.col("text"))
    joined = rows.join(hits, F.col(number) == F.col(row), "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
