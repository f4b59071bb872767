"""Packing token sequences: minimum bin slack over the lengths that are left.

A task reads its documents in chunks of about CHUNK ids.  Whole windows are cut off the front of documents;
what is left of each, shorter than a window, goes to a stock, a multiset of lengths.  A window starts with the
longest of the stock; a subset-sum dynamic program over bitsets of reachable sums then picks the multiset of
remaining lengths that fills it closest to its capacity, and its counts are tracked back through the kept
bitsets.  Where no multiset fills a window, the next document is cut to fill it, and its rest returns to the
stock, so windows before the last one have no slack at all.

A chunk leaves less than a window of ids; these open the next chunk of the task.  The last ones are cut into
sequences whose lengths are powers of two (which need no padding), or padded, by choice.  Every id is in
exactly one piece; a piece is in one task, so nothing is shuffled, and a lost executor repeats its own part.
Sequence ids are (task, number in the task), the same whenever the same scan runs.

Edge cases: null and empty texts are the end id alone; repeated rows and equal or null ids are packed each;
a text of any length is cut into windows; an empty table gives no pieces; only the id and the text are read,
so other columns can't clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices
from .tokens import encoder

#: Ids that a task holds before it packs them.
CHUNK = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def fill(capacity: int, stock: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Of a multiset of (length, count), the sub-multiset (length: count) whose sum is closest to capacity from below.

    Bit s of a bitset tells whether some sub-multiset has the sum s.  Counts are split into 1, 2, 4, ... copies, so
    a length takes few shifts; the program ends as soon as the capacity itself is reached."""
    mask, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    reached, steps = 1, []
    for length, count in stock:
        count, copies = min(count, capacity // length), 1
        while count > 0:
            copies = min(copies, count)
            steps.append((reached, length, copies))
            reached |= (reached << (length * copies)) & mask
            count, copies = count - copies, copies * 2
            if reached & goal:
                break
        if reached & goal:
            break
    at, taken = reached.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:  # this sum needs the step
            taken[length] = taken.get(length, 0) + copies
            at -= length * copies
    return taken


class Stock:
    """Rests of documents by length: (document, first id)."""

    def __init__(self) -> None:
        self.rests: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []  # the different lengths
        self.ids = 0

    def put(self, doc: int, start: int, length: int) -> None:
        if length not in self.rests:
            self.rests[length] = []
            insort(self.order, length)
        self.rests[length].append((doc, start))
        self.ids += length

    def take(self, length: int) -> tuple[int, int]:
        held = self.rests[length]
        doc, start = held.pop()
        if not held:
            del self.rests[length]
            del self.order[bisect_left(self.order, length)]
        self.ids -= length
        return doc, start

    def lengths(self, most: int) -> Iterator[tuple[int, int]]:
        """(length, count) of the rests of at most so many ids, long ones first: they are the hardest to place."""
        for k in range(bisect_right(self.order, most) - 1, -1, -1):
            yield self.order[k], len(self.rests[self.order[k]])

    def window(self, capacity: int) -> list[tuple[int, int, int]]:
        """The pieces (document, first id, length) of one sequence; full, if the stock holds so many ids."""
        longest = self.order[-1]
        pieces = [(*self.take(longest), longest)]
        left = capacity - longest
        for length, count in fill(left, self.lengths(left)).items():
            for _ in range(count):
                pieces.append((*self.take(length), length))
                left -= length
        if left and self.rests:  # every rest is longer than the slack
            length = self.order[0]
            doc, start = self.take(length)
            pieces.append((doc, start, left))
            self.put(doc, start + left, length - left)
        return pieces


def powers(total: int) -> list[int]:
    """total as a sum of different powers of two, the largest first."""
    return [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]


def dealt(pieces: list[tuple[int, int, int]], sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """The pieces in a row, cut into sequences of these sizes."""
    out, queue = [], list(reversed(pieces))
    for size in sizes:
        own = []
        while size:
            doc, start, length = queue.pop()
            now = min(size, length)
            own.append((doc, start, now))
            size -= now
            if now < length:
                queue.append((doc, start + now, length - now))
        out.append(own)
    return out


def _pack(path: str, capacity: int, end_id: int, chunk: int, pad_last: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, stock = encoder(path, "ids"), Stock()
        docs: dict[int, tuple[int | None, bytes]] = {}  # by number in the task: doc_id and ids
        task, number, row, held = TaskContext.get().partitionId() << 40, 0, 0, 0
        out: list[tuple] = []

        def tell(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal number
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids = docs[doc]
                out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, task + number, offset))
                offset += length
            number += 1

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while stock.ids >= capacity:
                tell(stock.window(capacity))
            if last and (total := stock.ids):
                rest = [(*stock.take(n), n) for n, count in list(stock.lengths(capacity)) for _ in range(count)]
                for pieces in dealt(rest, [total] if pad_last else powers(total)):
                    tell(pieces)
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 10_000], strict=True), TYPES, strict=True)], names=NAMES)
            out.clear()
            kept = {doc for rests in stock.rests.values() for doc, _ in rests}
            for doc in [d for d in docs if d not in kept]:
                del docs[doc]
            held = 0

        for batch in batches:
            ids_of, text_of = batch.column(0), batch.column(1)
            for i, j, *_ in slices(text_of):
                texts = [t or "" for t in text_of.slice(i, j - i).to_pylist()]
                cut = [enc.pretokens(t) for t in texts]
                whole = iter(enc.whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
                known = enc.pieces().__getitem__
                for doc_id, c in zip(ids_of.slice(i, j - i).to_pylist(), cut, strict=True):
                    own = (np.array(next(whole), "<u4").tobytes() if c is None else b"".join(map(known, c))) + end
                    docs[row], n = (doc_id, own), len(own) // 4
                    for start in range(0, n - capacity + 1, capacity):
                        tell([(row, start, capacity)])
                    if n % capacity:
                        stock.put(row, n - n % capacity, n % capacity)
                    row, held = row + 1, held + n
                    if held >= chunk:
                        yield from packed(False)
        yield from packed(True)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, chunk: int = CHUNK, pad_last: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    pad_last: the last ids of a task are one sequence to be padded instead of sequences of powers of two."""
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, capacity, end_id, chunk, pad_last), SCHEMA)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row a sequence: sequence_id, ids (binary, padded to capacity unless their number is a power of two), n_tokens,
    and starts, the offset of every piece (where attention and positions begin anew).  A group holds capacity ids at most."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    lone = F.bit_count("n_tokens") == 1
    pad = F.when(lone, F.lit(b"")).otherwise(F.expr(f"unhex(repeat('{np.array([pad_id], '<u4').tobytes().hex()}', cast({capacity} - n_tokens as int)))"))
    return rows.select("sequence_id", F.concat(joined, pad).alias("ids"), "n_tokens", F.transform("p", lambda x: x["offset"]).alias("starts"))
