"""Token counts without ids.

1. The different pre-tokens of the corpus are found (those of a batch at once, then by a
   shuffle) with the number of batches' occurrences; the pieces of each are counted
   once, in a table (pretoken, times, pieces).
2. Per-document frequencies of pre-tokens are joined to that table.  The FREQUENT most
   frequent pre-tokens of at most LONG bytes are a broadcast table of bounded size, and a
   document's sum over these is taken in place; the others, which are rare, are joined by a
   shuffle (row, pretoken, frequency), so no key is hot, and summed by row.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings in
texts count as the library handles them by default; repeated rows are counted
each; other columns pass through, and names that clash are replaced.  Files without
pre-tokens (sentencepiece and others) count every different text as one pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, most_frequent, numbered, stored
from .textscan import slices
from .tokens import encoder

OWN = ["n_bytes", "n_tokens", "over_limit"]
#: Pre-tokens that are broadcast, and their most bytes (some 20 MB in all).
FREQUENT, LONG = 200_000, 64
#: Pre-tokens that a worker holds before it tells them.
HELD = 400_000


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for i, j, *_ in slices(column):
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]


def _pretokens(path: str):
    """Rows (pretoken, times): the different pre-tokens of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, found = encoder(path, "counts"), Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pretoken", "times"])
            found.clear()
            return out

        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                for text in texts:
                    found.update(enc.parted(text)[0])
                if len(found) >= HELD or enc.cut is None:
                    yield told()
        if found:
            yield told()

    return run


def _pieces(path: str):
    """Rows (pretoken, times, pieces): every pre-token's pieces are counted here, and only here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, "counts")
        for batch in batches:
            counts = []
            for word in batch.column(0).to_pylist():
                counts.append(enc.count(word))
                enc.pieces()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=["pretoken", "times", "pieces"])

    return run


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, times and pieces of all different pre-tokens of the texts."""
    found = docs.select("text").mapInArrow(_pretokens(path), "pretoken string, times long")
    return found.groupBy("pretoken").agg(F.sum("times").alias("times")).mapInArrow(_pieces(path), "pretoken string, times long, pieces long")


def _frequencies(path: str, frequent, told: list[str]):
    """Instead of text, the last column, rows get two that are named told: known, the tokens of frequent pre-tokens and special strings,
    and rare, the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pieces = encoder(path, "counts"), frequent.value
        kind = pa.list_(pa.struct([("pretoken", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            known, rare = [], []
            for _, texts in _texts(batch.columns[-1]):
                for text in texts:
                    words, total = enc.parted(text)
                    others = []
                    for word, n in Counter(words).items():
                        if (own := pieces.get(word)) is None:
                            others.append({"pretoken": word, "n": n})
                        else:
                            total += own * n
                    known.append(total)
                    rare.append(others)
            made = [pa.array(known, pa.int64()), pa.array(rare, kind)]
            names = [*batch.schema.names[:-1], *told]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    return run


def count(docs: DataFrame, path: str, limit: int = 512, frequent: int = FREQUENT) -> DataFrame:
    """docs without text, with n_bytes, n_tokens and over_limit."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (*OWN, "text")]
    words = stored(vocabulary(docs, path), "pretokens")
    top = most_frequent(words.where(F.octet_length("pretoken") <= LONG), "times", frequent)
    table = spark.sparkContext.broadcast({r["pretoken"]: r["pieces"] for r in top.select("pretoken", "pieces").collect()})
    all_known = words.count() == len(table.value)
    number, known, rare, row, more = (free(c, docs.columns) for c in ("_number", "_known", "_rare", "_row", "_more"))
    df = docs if all_known else numbered(docs, number, "count-rows")
    text = F.coalesce("text", F.lit(""))
    df = df.select(*[F.col(f"`{c}`") for c in [*rest, *([] if all_known else [number])]], F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = T.ArrayType(T.StructType([T.StructField("pretoken", T.StringType()), T.StructField("n", T.LongType())]))
    schema = [*[T.StructField(f.name, f.dataType, True) for f in df.schema if f.name != "text"], T.StructField(known, T.LongType()), T.StructField(rare, kind)]
    df = df.mapInArrow(_frequencies(path, table, [known, rare]), T.StructType(schema))
    total = F.col(known)
    if not all_known:
        df = stored(df, "count-frequencies")
        each = df.select(F.col(number).alias(row), F.explode(rare).alias("r")).select(row, "r.*")
        sums = each.join(words, "pretoken").groupBy(row).agg(F.sum(F.col("n") * F.col("pieces")).alias(more))
        df = df.drop(rare).join(sums, F.col(number) == F.col(row), "left")
        total = total + F.coalesce(more, F.lit(0))
    return df.select(*[F.col(f"`{c}`") for c in rest], "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
