"""Vector code compression: product codes over integers, assigned by an exponion search.

Components become integers, floor(scale * x).  A vector is cut into equal parts, each with a codebook of
its own, which starts as that part of the vectors with the smallest ids and moves to the floors of the
means of what it was given, `rounds` times.

Assignment starts at the entry that a part had before (the first one, where it had none), at the squared
distance u.  An entry at no larger a distance lies within twice the root of u of the start, for
d(start, entry) <= d(start, part) + d(part, entry), so only the neighbours of the start inside that ball are
scanned, in order of distance.  The ball shrinks as better entries are found: to root(u) + root(v) for the
best distance v.  Distances are exact integers and equal ones go to the lower index, so the codes are those
of a full search.

A task holds one batch; sums of entries are added up by task and then in a shuffle of (part, entry), and only
the codebooks (parts x entries rows, a size that the parameters set) reach the driver.  Codes of a round are
stored with their vectors, where the next one starts from.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped, likewise those
whose length isn't that of the first vector by id; null ids come last among the first vectors, and equal ids
are ordered by their components.  Repeated rows count each.  Components are held to +-2**62, and an error
beyond a long is the largest long.  Null labels share one sum.  Fewer vectors than entries make a smaller
codebook; an empty table gives an empty result.  Other columns pass through; names that clash are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, most_frequent, stored

OWN = ["code", "error", "label_error", "codebooks_sha256"]
MOST, LARGEST = 2**62, 2**63 - 1
#: Neighbours that are looked at before the ball is drawn anew.
STEP = 8
#: Labels whose sums are broadcast; the others are rare and joined.
LABELS = 100_000


def integers(vector: str, scale: int):
    """The components of a finite vector as integers; null for other vectors."""
    x = F.col(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    edge = float(MOST)
    # A product of infinite size is held to the edge as well.
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), v.cast("double") * scale))).cast("long"))
    return F.when(good, whole)


def _typed(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays in the narrowest integers whose squared distances can't overflow (Python's own at last)."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    largest = 4 * most * most * max(a.shape[-1] for a in arrays)
    kind = np.int32 if largest < 2**31 else np.int64 if largest < 2**63 else object
    return tuple(a.astype(kind) for a in arrays)


def nearest(points: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point: the least distance, then the lowest index."""
    points, book = _typed(points, book)
    n, k = len(points), len(book)
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(-1)
    order = np.argsort(between, axis=1, kind="stable")
    away = np.take_along_axis(between, order, 1)
    start = before.astype(np.int64)
    u = ((points - book[start]) ** 2).sum(-1)
    best, at = u.copy(), start.copy()
    live, first = np.arange(n), 0
    coordinates, entries = points.T, book.T
    while len(live) and first < k:
        # The ball: (root u + root v) squared, rounded up, so that no entry on its edge is left out.
        a, b = u[live].astype(float), best[live].astype(float)
        ball = (np.sqrt(a) + np.sqrt(b)) ** 2 * (1 + 1e-9) + 1
        live = live[away[start[live], first].astype(float) <= ball]
        if not len(live):
            break
        seen = order[start[live], first : first + STEP]
        far = np.zeros(seen.shape, points.dtype)
        for x, e in zip(coordinates, entries, strict=True):
            step = e[seen] - x[live][:, None]
            far += step * step
        least = far.min(1)
        lowest = np.where(far == least[:, None], seen, k).min(1)
        better = (least < best[live]) | ((least == best[live]) & (lowest < at[live]))
        best[live[better]], at[live[better]] = least[better], lowest[better]
        first += STEP
    return at, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assign(books: list[np.ndarray], vector: int, code: int | None, told: str):
    """Batches with the codes (one byte a part) as the last column, and, with no codes before, all parts start at entry 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = sum(b.shape[1] for b in books)
        for batch in batches:
            rows, n = _matrix(batch.column(vector), width), batch.num_rows
            before = np.zeros((n, len(books)), np.uint8)
            if code is not None:
                before = np.frombuffer(b"".join(batch.column(code).to_pylist()), np.uint8).reshape(n, -1)
            codes, errors = np.zeros((n, len(books)), np.uint8), [0] * n
            for p, book in enumerate(books):
                d = book.shape[1]
                entry, far = nearest(rows[:, p * d : (p + 1) * d], book, before[:, p])
                codes[:, p] = entry
                errors = far.astype(object) + errors
            rest = [c for k, c in enumerate(batch.columns) if k != code]
            names = [c for k, c in enumerate(batch.schema.names) if k != code]
            made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=[*names, told, f"{told}_error"])

    return run


def _sums(parts: int, entries: int, width: int):
    """Rows (part, entry, n, s0, s1, ...) of a task: how many parts each entry has, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = width // parts
        sums, counts = np.zeros((parts * entries, d), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            if not len(rows):
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(rows), parts).astype(np.int64)
            exact = max(abs(int(rows.max())), abs(int(rows.min()))) * len(rows) < 2**53
            for p in range(parts):
                own = codes[:, p]
                place = slice(p * entries, (p + 1) * entries)
                counts[place] += np.bincount(own, minlength=entries)
                for j in range(d):
                    x = rows[:, p * d + j]
                    if exact:
                        sums[place, j] += np.bincount(own, x, entries).astype(np.int64).astype(object)
                    else:
                        np.add.at(sums[place, j], own, x.astype(object))
        used = np.flatnonzero(counts)
        if len(used):
            kind = pa.decimal128(38, 0)
            columns = [pa.array([Decimal(int(v)) for v in sums[used, j]], kind) for j in range(d)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(counts[used]), *columns],
                names=["part", "entry", "n", *[f"s{j}" for j in range(d)]],
            )

    return run


def _moved(books: list[np.ndarray], assigned: DataFrame, vector: str, code: str) -> list[np.ndarray]:
    """Codebooks whose used entries are the floors of the means of their parts."""
    parts, entries, d = len(books), len(books[0]), books[0].shape[1]
    named = [f"s{j}" for j in range(d)]
    schema = ", ".join(["part int", "entry int", "n long", *[f"{s} decimal(38,0)" for s in named]])
    sums = assigned.select(vector, code).mapInArrow(_sums(parts, entries, parts * d), schema)
    sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in named])
    books = [b.copy() for b in books]
    for row in sums.collect():  # at most parts * entries rows
        books[row["part"]][row["entry"]] = [int(row[s]) // row["n"] for s in named]
    return books


def _with_label_error(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the sum of error over rows of equal labels: sums of frequent labels are broadcast, those of the others joined."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(LARGEST))).cast("long")
    label, rows, summed = (free(c, names) for c in ("_label", "_rows", "label_error"))
    sums = stored(df.groupBy(F.col("label").alias(label)).agg(F.count(F.lit(1)).alias(rows), total.alias(summed)), "label-errors")
    same = F.col("label").eqNullSafe(F.col(label))
    if sums.count() <= LABELS:
        return df.join(F.broadcast(sums.drop(rows)), same).drop(label)
    top = most_frequent(sums, rows, LABELS).drop(rows)
    known = df.join(F.broadcast(top), same)
    others = df.join(F.broadcast(top.drop(summed)), same, "left_anti").join(sums.drop(rows), same)
    return known.unionByName(others).drop(label)


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Rows of finite vectors without the vector, with code (hex, two digits a part), error, label_error (needs a
    column label) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is written in two hex digits: 1 to 256 entries")
    rest = [c for c in vectors.columns if c not in (*OWN, vector)]
    whole, code = free("_whole", vectors.columns), free("_code", vectors.columns)
    own = [F.col(f"`{c}`") for c in rest]
    rows = stored(vectors.select(*own, integers(vector, scale).alias(whole)).where(F.col(whole).isNotNull()), "vectors")
    first = rows.select(key, whole).orderBy(F.col(key).asc_nulls_last(), whole).limit(entries)
    start = [r[whole] for r in first.collect()]  # entries rows at most
    width = len(start[0]) if start else parts
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size(whole) == width)
    start = [r[whole] for r in rows.select(key, whole).orderBy(F.col(key).asc_nulls_last(), whole).limit(entries).collect()] if start else []
    d = width // parts
    books = [np.array([v[p * d : (p + 1) * d] for v in start] or np.zeros((1, d)), np.int64) for p in range(parts)]
    fields = [T.StructField(f.name, f.dataType, True) for f in rows.schema]
    schema = T.StructType([*fields, T.StructField(code, T.BinaryType()), T.StructField(f"{code}_error", T.LongType())])
    assigned, before = rows, None
    for k in range(rounds + 1):
        if k:
            books = _moved(books, assigned, whole, code)
            before = len(fields)
        assigned = assigned.mapInArrow(_assign(books, len(fields) - 1, before, code), schema)
        if k < rounds:
            assigned = stored(assigned.drop(f"{code}_error"), f"vector-codes-{k}")
    said = ",".join(str(int(v)) for book in books for entry in book for v in entry)
    coded = assigned.select(
        *own, F.lower(F.hex(code)).alias("code"), F.col(f"{code}_error").alias("error"), F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256")
    )
    coded = stored(coded, "vector-codes")
    if "label" not in rest:
        return coded
    return _with_label_error(coded, coded.columns).select(*own, *OWN)
