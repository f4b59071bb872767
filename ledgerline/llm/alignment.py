"""Cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes; the places where tokens of both end cut these into groups, of A ids and B
ids.  A group's ids decide the byte ranges of its tokens, hence its links (pairs of an A and a B token whose
ranges overlap), so everything about links is worked out once for each different group:

1. Every text is read once.  It is parted between pre-tokens of A wherever no piece of B holds the two characters
   that meet there: no merge of either tokenizer crosses such a border, so a part is encoded once in a worker.  Groups
   of many texts are cut at once and interned; what is stored of a document are its different groups and their frequencies.
2. An id pair's count, of documents, is the sum over tasks of the documents whose groups hold it; a document is
   whole in one row, so its pairs are told apart in place, each group's links being expanded once.
3. The dictionary has each different group of the corpus once.  Its links are expanded, meet the pairs' counts
   and the highest count of their A id, and are summed by group: links, links with the highest count, counts.
4. Documents' groups meet the dictionary by the group itself, and sums times frequencies are added up.  The
   FREQUENT most frequent groups are a broadcast table of bounded size, the others, which are rare, are joined.

Edge cases: null and empty texts, and texts whose joined token bytes of A or of B differ from the text with a
space before it, have no tokens, zeros and an empty groups_sha256; repeated rows are documents each; special
strings are plain text; long parts are encoded and not kept; an empty table gives an empty result; other columns
pass through, and names that clash are replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, most_frequent, numbered, stored
from .textscan import slices
from .tokens import Pieces, byte_letters, encoder

OWN = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: Groups that are broadcast, and their longest text (some 20 MB in all).
FREQUENT, LONG = 200_000, 64
#: Parts of texts with more bytes of A ids aren't kept; the kept ones are forgotten at this number.
KEPT, PARTS = 256, 300_000
#: Id pairs that a task holds before it tells their counts.
HELD = 400_000
#: How pieces of B write a space.
SPACE = "▁"

#: A text that a tokenizer which normalises texts would change.
PROBE = "\n ﬁ  ½ x "


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(n)], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(n)), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        moved = self.first[ids] - (np.cumsum(size) - size)
        return self.data[np.repeat(moved, size) + np.arange(size.sum())].tobytes()


class Sizes:
    """Bytes of both vocabularies: byte-level letters of A, pieces of B."""

    def __init__(self, a: str, b: str):
        hidden = byte_letters()  # the others stand for themselves
        letters = {chr(hidden.get(byte, byte)): byte for byte in range(256)}
        plain = lambda token: bytes(letters[c] for c in token) if letters.keys() >= set(token) else token.encode()
        self.a = Bytes({i: plain(token) for token, i in encoder(a, "ids", True).vocabulary().items()})
        pieces = encoder(b, "lists").vocabulary()
        byte = {p: bytes([int(p[3:5], 16)]) for p in pieces if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.b = Bytes({i: byte.get(p, p.replace(SPACE, " ").encode()) for p, i in pieces.items()})
        self.space = pieces.get(SPACE)
        #: Characters that meet inside some piece, so that B may merge them.
        self.meeting = {p[k : k + 2] for p in (p.replace(SPACE, " ") for p in pieces if p not in byte) for k in range(len(p) - 1)}
        # Parts can be told apart if B takes texts as they are and has the end of a line as a byte of its own.
        whole = encoder(b, "lists").whole([PROBE])[0]
        self.parted = self.b.joined(np.array(whole)) == b" " + PROBE.encode() and whole[:2] == [self.space, pieces.get("<0x0A>")]


@cache
def sizes(a: str, b: str) -> Sizes:
    return Sizes(a, b)


def links(group: str, known: Sizes) -> list[tuple[int, int]]:
    """All (A id, B id) of overlapping tokens of a group, in order, repeats included."""
    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
    out, i, j, at_a, at_b = [], 0, 0, known.a.size[a[0]], known.b.size[b[0]]
    while True:
        out.append((a[i], b[j]))
        if at_a == at_b:  # inside a group ends differ: this is its end
            return out
        if at_a < at_b:
            i += 1
            at_a += known.a.size[a[i]]
        else:
            j += 1
            at_b += known.b.size[b[j]]


class Aligner:
    """The groups of texts.  Ids of parts of texts are kept; groups are cut out of the ids of many texts at once."""

    def __init__(self, a: str, b: str):
        self.known = sizes(a, b)
        self.a, self.b = encoder(a, "ids", True), encoder(b, "lists")
        self.parts: dict[str | tuple[str, ...], tuple[bytes, bytes]] = {}
        self.names: dict[bytes, str] = {}

    def split(self, text: str) -> list[str | tuple[str, ...]]:
        """Parts of space + text: a pre-token, or several whose ends meet in a piece of B."""
        words = self.a.parted(" " + text)[0]
        out, held, last = [], words[0], words[0][-1]
        for word in words[1:]:
            if last + word[0] in self.known.meeting:
                held = (*held, word) if isinstance(held, tuple) else (held, word)
            else:
                out.append(held)
                held = word
            last = word[-1]
        out.append(held)
        return out

    def learn(self, parts: list[str | tuple[str, ...]]) -> None:
        """A and B ids of new parts.  A leading space is the one that B adds; other parts are encoded behind the end of a line."""
        texts = ["".join(p) for p in parts]
        b = self.b.whole([t[1:] if t[0] == " " else "\n" + t for t in texts])
        one = self.a.known.encode
        for part, text, ids in zip(parts, texts, b, strict=True):
            own = ids[2:] if text[0] != " " else ids if text != " " else [self.known.space]
            self.parts[part] = one(part) if isinstance(part, str) else b"".join(map(one, part)), array("I", own).tobytes()

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """A and B ids of a text that isn't parted."""
        return np.array(self.a.whole([" " + text])[0], "<u4").tobytes(), np.array(self.b.whole([text])[0], "<u4").tobytes()

    def ids(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        if not self.known.parted or self.a.cut is None:
            yield from map(self.whole, texts)
            return
        if len(self.parts) > PARTS:
            self.parts.clear()
        split = list(map(self.split, texts))
        new = list(set(chain.from_iterable(split)) - self.parts.keys())
        self.learn(new)
        for parts in split:
            found = list(map(self.parts.__getitem__, parts))
            yield b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
        for p in new:
            if len(self.parts[p][0]) > KEPT:
                del self.parts[p]

    def valid(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[int]]:
        """Which texts have tokens, their A and B ids, and their bytes with the space before them."""
        at, rows_a, rows_b, size = [], [], [], []
        for k, (text, (a, b)) in enumerate(zip(texts, self.ids(texts), strict=True)):
            if not text:
                continue
            raw = b" " + text.encode()
            for attempt in (True, False):
                ids_a, ids_b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
                if self.known.a.joined(ids_a) == raw and self.known.b.joined(ids_b) == raw:
                    at.append(k)
                    rows_a.append(ids_a)
                    rows_b.append(ids_b)
                    size.append(len(raw))
                    break
                if attempt:  # parts may fail where the whole text doesn't
                    a, b = self.whole(text)
        return at, rows_a, rows_b, size

    def name(self, a: np.ndarray, b: np.ndarray) -> str:
        """A group as a1,a2|b1; each different one is written once."""
        key = a.tobytes() + b"|" + b.tobytes()
        found = self.names.get(key)
        if found is None:
            if len(self.names) > PARTS:
                self.names.clear()
            found = self.names[key] = f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))}"
        return found

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Ends (bytes) of all groups of two rows of ids over the same bytes, the different groups, and which one each is."""
        end_a, end_b = np.cumsum(self.known.a.size[a]), np.cumsum(self.known.b.size[b])
        both = np.zeros(int(end_a[-1]) + 1, np.int8)
        both[end_a] = 1
        both[end_b] += 1
        ends = np.flatnonzero(both == 2)
        before = np.cumsum(both == 2, dtype=np.int32)  # ends up to a byte
        n_a, n_b = (np.bincount(before[e - 1], minlength=len(ends)) for e in (end_a, end_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        which, names = np.full(len(ends), -1, np.int64), []
        small = (self.known.a.size.size <= 1 << 16) & (self.known.b.size.size <= 1 << 16)
        for i, j in ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)) if small else ():  # four ids fit in one number
            own = np.flatnonzero((n_a == i) & (n_b == j))
            key = np.zeros(len(own), np.uint64)
            for ids, first, n in ((a, first_a, i), (b, first_b, j)):
                for k in range(n):
                    key = key << np.uint64(16) | ids[first[own] + k].astype(np.uint64)
            _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            which[own] = inverse + len(names)
            names += [self.name(a[first_a[g] : first_a[g] + i], b[first_b[g] : first_b[g] + j]) for g in own[where].tolist()]
        known = {name: k for k, name in enumerate(names)}
        for g in np.flatnonzero(which < 0).tolist():
            name = self.name(a[first_a[g] : first_a[g] + n_a[g]], b[first_b[g] : first_b[g] + n_b[g]])
            which[g] = known.setdefault(name, len(known))
        return ends, list(known), which

    def align(self, texts: list[str]) -> list[pa.Array]:
        """Columns n_a, n_b, n_groups, groups_sha256, the different groups and their frequencies, of texts."""
        at, rows_a, rows_b, size = self.valid(texts)
        n_a, n_b, n_groups, shown, distinct = *np.zeros((3, len(texts)), np.int64), [""] * len(texts), np.zeros(len(texts), np.int64)
        names, used, times = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if at:
            ends, names, which = self.groups(np.concatenate(rows_a), np.concatenate(rows_b))
            cuts = np.searchsorted(ends, np.cumsum(size), "right")
            n_a[at], n_b[at], n_groups[at] = [len(x) for x in rows_a], [len(x) for x in rows_b], np.diff(cuts, prepend=0)
            written = np.array(names, object)
            for k, first, last in zip(at, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                shown[k] = hashlib.sha256(";".join(written[which[first:last]].tolist()).encode()).hexdigest()
            doc = np.repeat(np.array(at), np.diff(cuts, prepend=0))
            keys, times = np.unique(doc * len(names) + which, return_counts=True)
            used, distinct = keys % len(names), np.bincount(keys // len(names), minlength=len(texts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
        groups = pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(used)))
        return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(shown, pa.string()), groups, pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _aligned(a: str, b: str, told: list[str]):
    """Instead of text, the last column, rows get the columns that are named told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            column = batch.columns[-1]
            for i, j, *_ in slices(column):
                made = own.align([t or "" for t in column.slice(i, j - i).to_pylist()])
                rest = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*batch.schema.names[:-1], *told])

    return run


def _pair_documents(a: str, b: str):
    """Rows (a, b, docs): in how many of a task's documents an id pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sizes(a, b)
        pairs, found = Pieces(lambda group: np.array([x << 32 | y for x, y in set(links(group, known))])), Counter()

        def told() -> pa.RecordBatch:
            ids = np.array(list(found), np.int64)
            columns = [pa.array((ids >> 32).astype(np.int32)), pa.array((ids & 0xFFFFFFFF).astype(np.int32)), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "docs"])

        for batch in batches:
            rows = batch.column(0)
            doc = np.repeat(np.arange(len(rows)), rows.value_lengths().fill_null(0).to_numpy())
            if not len(doc):
                continue
            coded = rows.flatten().dictionary_encode()
            own = [pairs[g] for g in coded.dictionary.to_pylist()]  # each group's links are expanded once
            which, size = coded.indices.to_numpy(), np.array([len(x) for x in own])
            different, place = np.unique(np.concatenate(own), return_inverse=True)
            n = size[which]
            at = np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held = np.unique(np.repeat(doc, n) * len(different) + place[at])  # a document's pairs, each once
            counts = np.bincount(held % len(different), minlength=len(different))
            for pair, docs in zip(different.tolist(), counts.tolist(), strict=True):
                found[pair] += docs
            if len(found) > HELD:
                yield told()
            if len(pairs) > PARTS:
                pairs.clear()
        if found:
            yield told()

    return run


def _links(a: str, b: str):
    """Rows (group, a, b, n): a group's different links and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sizes(a, b)
        for batch in batches:
            rows = [(g, *pair, n) for g in batch.column(0).to_pylist() for pair, n in Counter(links(g, known)).items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            made = [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["group", "a", "b", "n"])

    return run


def dictionary(groups: DataFrame, a: str, b: str) -> DataFrame:
    """group, times, links, best and counts of all different groups of documents; groups: a column of arrays `groups`, with
    their frequencies in `times`."""
    pairs = groups.select("groups").mapInArrow(_pair_documents(a, b), "a int, b int, docs long")
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs")), "align-pairs")
    # One row for each A id that has tokens: as many as the vocabulary has at most.
    highest = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    pairs = pairs.join(F.broadcast(highest), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    each = groups.select(F.explode(F.arrays_zip("groups", "times")).alias("g")).groupBy(F.col("g.groups").alias("group"))
    each = stored(each.agg(F.sum("g.times").alias("times")), "align-groups")
    own = each.select("group").mapInArrow(_links(a, b), "group string, a int, b int, n long").join(pairs, ["a", "b"])
    own = own.groupBy("group").agg(
        F.sum("n").alias("links"), F.sum(F.col("n") * F.col("best")).alias("best"), F.sum(F.col("n") * F.col("docs")).alias("counts")
    )
    return each.join(own, "group")


def align(docs: DataFrame, a: str, b: str, frequent: int = FREQUENT) -> DataFrame:
    """docs without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    taken = [*docs.columns, *OWN]
    rest = [c for c in docs.columns if c not in (*OWN, "text")]
    number, groups, times, row = (free(c, taken) for c in ("_number", "_groups", "_times", "_row"))
    told = ["n_a", "n_b", "n_groups", "groups_sha256", groups, times]
    rows = numbered(docs.select(*[F.col(f"`{c}`") for c in [*rest, "text"]]), number, "align-rows")
    rows = rows.select(*[F.col(f"`{c}`") for c in [*rest, number]], "text")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema if f.name != "text"])
    kinds = [*[T.LongType()] * 3, T.StringType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType())]
    for name, kind in zip(told, kinds, strict=True):
        schema = schema.add(name, kind)
    rows = stored(rows.mapInArrow(_aligned(a, b, told), schema), "align-rows")
    found = stored(dictionary(rows.select(F.col(groups).alias("groups"), F.col(times).alias("times")), a, b), "align-dictionary")
    each = rows.select(F.col(number).alias(row), F.explode(F.arrays_zip(groups, times)).alias("g"))
    each = each.select(row, F.col("g")[groups].alias("group"), F.col("g")[times].alias("n"))
    top = most_frequent(found.where(F.octet_length("group") <= LONG), "times", frequent).drop("times")
    top = stored(top, "align-frequent")
    known = each.join(F.broadcast(top), "group")
    if found.count() > top.count():
        others = each.join(F.broadcast(top.select("group")), "group", "left_anti").join(found.drop("times"), "group")
        known = known.unionByName(others)
    sums = known.groupBy(row).agg(
        *[F.sum(F.col("n") * F.col(c)).alias(name) for c, name in (("links", "n_links"), ("best", "n_best"), ("counts", "count_sum"))]
    )
    whole = rows.drop(groups, times).join(sums, F.col(number) == F.col(row), "left")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in ("n_links", "n_best", "count_sum") else F.col(c) for c in OWN]
    return whole.select(*[F.col(f"`{c}`") for c in rest], *filled)
