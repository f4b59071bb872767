"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target, a share of all words; a document of a source is
copied target / source size times in expectation.  The whole part of that number
is certain.  The fraction is a probability, and fractions are rounded in pairs:
mass (words) moves from one document to the other, in a direction drawn with the
odds that keep both expectations, until one fraction is 0 or 1; the other goes on
to meet the next document.  The words taken never change by a move.

The first level pairs documents inside chunks (hash of the id, so a hot source
is spread over all chunks) and streams: a task holds one document.  What is
left, one document for each chunk and source, meets in a reduction tree of wide
fan-out until one fraction is left for each source.  That one is mostly large, so
each source keeps its smallest documents, RESERVE times its largest one in all, out of
the tree.  At the root the open document and these are settled from the largest down:
each is rounded at random, what it took too much or too little moves to the smaller ones,
and where only one side leaves them able to take it, that side is chosen.  So a
source misses its target by half of its smallest document or so.
Draws are hashes of ids and levels, and the chunks follow from the table's size,
not from the cluster: reruns agree.

Edge cases: null sources are a source of their own, last in order; null and empty
texts have size 0, are never taken and disturb nothing; a source without words
has target 0; repeated rows are rounded each on its own; rows with equal ids and
sizes are interchangeable; an empty table gives an empty result.  mixed() keeps all
columns of a row, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, numbered, partitions, stored, words

#: Documents of a chunk, about; residuals that meet in one node of the tree.
CHUNK, FAN = 2_000, 64
#: Words of a source's smallest documents that are settled last, in largest documents.
RESERVE = 4


def ordered(by_source: DataFrame) -> DataFrame:
    """by_source, written in ranges of names in order (range: their numbers)."""
    ranges = by_source.repartitionByRange(partitions(by_source.sparkSession), F.col("source").asc_nulls_last())
    return stored(ranges.withColumn("range", F.spark_partition_id()), "mix-sources")


def targets(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from ordered(a table with one row (source, source_size) for each source).

    Targets share `share` times all words by weight, none above `most` times its
    source's size, the excess shared again.  That is min(most * size, level * weight)
    for one level, which rises from sum to sum until no further source is above its cap.
    Sources get their places in order from ranges of names, not from one task.
    """
    before = df.groupBy("range").count()  # one row a range
    before = before.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    k = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(k, F.lit(len(weights))) + 1).cast("int")).cast("double")
    df = df.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    df = stored(df, "mix-weights")
    level, n_open = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = df.agg(F.sum("source_size"), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.sum((~above).cast("int")))
        size, capped, weighed, now = sums.first()
        if not now or now == n_open:
            break
        n_open, level = now, (share * size - (capped or 0.0)) / weighed
    target = F.col("cap") if not now else F.least("cap", F.lit(level) * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def _draw(*key: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2**64


class _Pair:
    """The document of a source that is still open, while others pass by."""

    def __init__(self) -> None:
        self.open: dict | None = None

    def meet(self, doc: dict, level: int) -> list[dict]:
        """The documents that this meeting settles."""
        if doc["_p"] <= 1e-12 or doc["_p"] >= 1 - 1e-12:
            doc["_p"] = float(doc["_p"] > 0.5)
            return [doc]
        a, b = self.open, doc
        if a is None:
            self.open = b
            return []
        up = min((1 - a["_p"]) * a["size"], b["_p"] * b["size"])  # words from b to a
        down = min(a["_p"] * a["size"], (1 - b["_p"]) * b["size"])
        move = up if _draw(a["doc_id"], b["doc_id"], a["size"], b["size"], level) * (up + down) < down else -down
        a["_p"] = min(1.0, max(0.0, a["_p"] + move / a["size"]))
        b["_p"] = min(1.0, max(0.0, b["_p"] - move / b["size"]))
        settled, self.open = [], None
        for x in (a, b):
            if x["_p"] <= 1e-9 or x["_p"] >= 1 - 1e-9:
                x["_p"] = float(x["_p"] > 0.5)
                settled.append(x)
            else:
                self.open = x
        return settled


def _round(level: int, key: list[str]):
    """Streams rows sorted by key.  Settled rows get _p = 0 or 1; of every group one row at most stays open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pair, held = None, _Pair(), None  # held: the open row as a table of one row

        def rows(table: pa.Table, docs: list[dict]) -> Iterator[pa.RecordBatch]:
            yield from _with_p(table.take(pa.array([d["at"] for d in docs], pa.int64())), [d["_p"] for d in docs])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:  # the open row comes first
                table = pa.concat_tables([held, table])
                pair.open["at"] = 0
            settled: list[dict] = []
            begin = 0 if held is None else 1
            own = table.select(list(dict.fromkeys([*key, "doc_id", "size", "_p"]))).slice(begin).to_pylist()
            for at, doc in enumerate(own, begin):
                doc["at"] = at
                if (now := tuple(doc[k] for k in key)) != group:
                    if pair.open is not None:
                        settled.append(pair.open)
                        pair.open = None
                    group = now
                settled += pair.meet(doc, level)
            held = None if pair.open is None else table.slice(pair.open["at"], 1)
            if settled:
                yield from rows(table, settled)
        if held is not None:
            pair.open["at"] = 0
            yield from rows(held, [pair.open])

    return run


def _with_p(table: pa.Table, p: list[float]) -> list[pa.RecordBatch]:
    where = table.schema.get_field_index("_p")
    return table.set_column(where, table.schema.field("_p"), pa.array(p, pa.float64())).to_batches()


def settled(docs: list[dict]) -> list[float]:
    """0 or 1 for every document of a source, the largest first, so that the words taken come to the sum of _p * size."""
    after_p, after, spread = [0.0], [0.0], [0.0]  # of later documents: words by their fractions, words at most, variance of words
    for d in reversed(docs):
        after_p.append(after_p[-1] + d["_p"] * d["size"])
        after.append(after[-1] + d["size"])
        spread.append(spread[-1] + d["_p"] * (1 - d["_p"]) * d["size"] ** 2)
    owed, out = after_p[-1], []
    for k, d in enumerate(docs):
        size, n = d["size"], len(docs) - k
        # What earlier documents left over is shared by variance, so its mean stays nought and expectations stay what they were.
        p = d["_p"] + ((owed - after_p[n]) * d["_p"] * (1 - d["_p"]) * size / spread[n] if spread[n] > 0 else 0.0)
        low, high = owed - size, after[n - 1] - owed  # below 0: taking it takes too much; leaving it leaves too much
        if low >= -1e-9 and high >= -1e-9:
            take = _draw(d["doc_id"], size, k, "settle") < p
        else:
            take = low >= high
        out.append(float(take))
        owed = min(max(owed - size * take, 0.0), after[n - 1])
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source and falling size; a source's rows are few (see RESERVE)."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        docs = table.select(["doc_id", "size", "_p"]).to_pylist()
        held.clear()
        yield from _with_p(table, settled(docs))

    for batch in batches:
        source = batch.column(batch.schema.get_field_index("source")).to_pylist()
        first = 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or source[k] != source[first]:
                if held and held[-1].column(held[-1].schema.get_field_index("source"))[0].as_py() != source[first]:
                    yield from told()
                held.append(batch.slice(first, k - first))
                first = k
    if held:
        yield from told()


def _reserve(sizes: DataFrame) -> DataFrame:
    """_source, _class, _part: a source's documents of classes (powers of two of sizes) below _class, and _part of those in it, are
    settled last: as many as hold RESERVE times the words of its largest document."""
    of = sizes.where("size > 0").groupBy("source", F.floor(F.log2(F.col("size").cast("double"))).cast("int").alias("class"))
    classes = of.agg(F.sum("size").alias("words"), F.max("size").alias("largest"))
    w = Window.partitionBy("source")  # a row for each power of two
    classes = classes.select("source", "class", "words", (F.sum("words").over(w.orderBy("class")) - F.col("words")).alias("before"), (RESERVE * F.max("largest").over(w)).alias("asked"))
    edge = classes.where("before < asked").groupBy("source").agg(F.max_by(F.struct("class", "words", "before", "asked"), "class").alias("e"))
    part = (F.col("e.asked") - F.col("e.before")) / F.col("e.words")
    return edge.select(F.col("source").alias("_source"), F.col("e.class").alias("_class"), part.alias("_part"))


def rounded(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    chunk: int = CHUNK, fan: int = FAN,
) -> DataFrame:
    """sizes (doc_id, source, size and any other narrow columns) with source_size, target, copies and taken."""
    names = sizes.columns
    sizes = stored(sizes, "mix-sizes")  # texts are read once
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_source = ordered(by_source)
    n_sources, n = by_source.agg(F.count(F.lit(1)), F.sum("docs")).first()
    goal = targets(by_source, weights, share, most).withColumnRenamed("source", "_source")
    goal = goal.join(_reserve(sizes).withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")
    goal = stored(goal, "mix-goals")  # a row a source
    joined = sizes.join(F.broadcast(goal) if n_sources <= 100_000 else goal, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size")))
    rate = F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(0.0))
    n_chunks = max(1, math.ceil((n or 0) / chunk))
    place = F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int")
    drawn = F.pmod(F.xxhash64("doc_id", "size", F.lit(2)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    last = (F.col("size") > 0) & ((place < F.col("_class")) | ((place == F.col("_class")) & (drawn < F.col("_part"))))
    rated = joined.select(
        *names, "source_size", "target", F.floor(rate).alias("copies"), (rate - F.floor(rate)).alias("_p"),
        F.pmod(F.xxhash64("doc_id", "size"), F.lit(n_chunks)).alias("_node"), F.coalesce(last, F.lit(False)).alias("_last"),
    )
    done, level, todo, waiting = [], 0, rated.where(~F.col("_last")), rated.where("_last")
    rest = [c for c in names if c not in ("doc_id", "source", "size")]
    key = ["_node", "source"]
    while True:
        # By chunk alone: all sources of a chunk share a task, so a hot source weighs on none.
        dealt = todo.repartition("_node").sortWithinPartitions(*key, F.desc("size"), "doc_id", *rest)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in dealt.schema])
        after = stored(dealt.mapInArrow(_round(level, key), schema), f"mix-level{level}")
        whole = (F.col("_p") == 0) | (F.col("_p") == 1)
        done.append(after.where(whole))
        todo = after.where(~whole)
        if n_chunks <= 1:
            break
        n_chunks, level = math.ceil(n_chunks / fan), level + 1
        todo = todo.withColumn("_node", F.expr(f"_node div {fan}"))
    # A source's open document and its reserve, a few of its largest documents' words, in one task.
    root = todo.unionByName(waiting).repartition("source").sortWithinPartitions("source", F.desc("size"), "doc_id", *rest)
    done.append(root.mapInArrow(_settle, T.StructType([T.StructField(f.name, f.dataType, True) for f in root.schema])))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    copies = (F.col("copies") + F.col("_p")).cast("long")
    return out.select(*names, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _size() -> Column:
    return F.size(words(F.col("text"))).cast("long").alias("size")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies and taken (words) of every row."""
    return rounded(docs.select("doc_id", "source", _size()), **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Every row as often as the mix takes it, in the columns of docs: only ids, sources and sizes are
    rounded, and the rows meet their copies by their numbers."""
    own = docs.columns
    number, member, copies = (free(c, own) for c in ("_number", "_member", "_copies"))
    rows = numbered(docs, number, "mix-rows")
    sizes = rows.select(F.col(number).alias("row"), "doc_id", "source", _size())
    taken = rounded(sizes, **options).where("copies > 0").select(F.col("row").alias(member), F.col("copies").cast("int").alias(copies))
    return (
        rows.join(taken, F.col(number) == F.col(member))
        .withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
        .select(*[F.col(f"`{c}`") for c in own])
    )
