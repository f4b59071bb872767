"""A source that answers in pages: offsets, retries and a check of what a page must hold, as a Spark data source.

A reader asks for one page a partition, so pages are fetched by as many tasks as there are; a page that fails is asked for again,
with growing pauses, and a task that is lost asks for its own page only.  A page without the required keys, or with fewer rows than it
should have, is an error that names the page: half an answer must not look like a whole one.

Where pages come from is a matter of the transport: files of pages in any store that pyarrow reads stand for the network,
`<path>/<prefix><offset>.json`, each an object with the number of all rows and a list of records.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = {"string": str, "bigint": int, "int": int, "double": float, "boolean": bool}


@dataclass
class Page(InputPartition):
    offset: int
    length: int
    total: int


class PageError(ValueError):
    """A page that can't be used, however often it is asked for."""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.path, self.prefix = options["path"], options.get("prefix", "page-")
        self.length, self.retries = int(options.get("pagelength", 5000)), int(options.get("retries", 3))
        self.pause = float(options.get("pause", 0.2))
        self.required = [k for k in options.get("required", "").split(",") if k]
        self.records, self.count = options.get("records", "data"), options.get("count", "total")

    def fetch(self, offset: int) -> dict:
        """One answer, asked for again when it can't be had or read."""
        for attempt in range(self.retries + 1):
            try:
                store, path = _store(self.path)
                with store.open_input_stream(f"{path}/{self.prefix}{offset}.json") as f:
                    answer = json.loads(f.read())
                break
            except (OSError, ValueError) as error:
                if attempt == self.retries:
                    raise PageError(f"page at {offset} of {self.path}: {error}") from error
                time.sleep(self.pause * 2**attempt)
        if not isinstance(answer, dict) or self.records not in answer or self.count not in answer:
            raise PageError(f"page at {offset} of {self.path} lacks {self.records} or {self.count}")
        return answer

    def partitions(self) -> list[Page]:
        total = int(self.fetch(0)[self.count])
        return [Page(k, min(self.length, total - k), total) for k in range(0, total, self.length)]

    def read(self, page: Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # a source without rows has no page
            return
        answer = self.fetch(page.offset)
        rows = answer[self.records]
        if int(answer[self.count]) != page.total:
            raise PageError(f"the source changed while it was read: {answer[self.count]} rows at {page.offset}, {page.total} before")
        if len(rows) != page.length:
            raise PageError(f"page at {page.offset} of {self.path} has {len(rows)} rows of {page.length}")
        for k, row in enumerate(rows):
            if missing := [c for c in self.required if row.get(c) is None]:
                raise PageError(f"row {k} of the page at {page.offset} lacks {', '.join(missing)}")
        columns = [[None if (v := row.get(name)) is None else KINDS.get(kind, str)(v) for row in rows] for name, kind in self.fields]
        types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}.get(kind, pa.string()) for _, kind in self.fields]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[n for n, _ in self.fields])


class PagedSource(DataSource):
    """spark.read.format("paged"): options path, pageLength, prefix, records, count, required, retries, pause."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema: read.schema(...)")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def read_pages(spark: SparkSession, path: str, schema: str, page_length: int, required: list[str] | None = None, **options: object) -> DataFrame:
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").schema(schema).option("path", path).option("pageLength", page_length)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.option("required", ",".join(required or [])).load()


def write_pages(df: DataFrame, order: str, path: str, page_length: int, records: str = "data", count: str = "total", prefix: str = "page-") -> None:
    """df as pages in the order of a key without ties: what an interface would answer.  A page is one row of one task."""
    from ledgerline.operators.ranking import row_numbers

    n = df.count()
    placed = row_numbers(df.withColumn("_order", F.col(order).cast("double")), "_order", order, "_place").drop("_order")
    names = df.columns
    paged = placed.groupBy(F.floor((F.col("_place") - 1) / page_length).alias("_page")).agg(
        F.sort_array(F.collect_list(F.struct("_place", F.struct(*names).alias("row")))).alias("rows")
    )
    rows = F.transform("rows", lambda x: x["row"])
    body = F.to_json(F.struct(F.lit(n).alias(count), rows.alias(records)))
    pages = paged.select((F.col("_page") * page_length).cast("long").alias("offset"), body.alias("body"))
    pages = pages.unionByName(df.sparkSession.range(1).select(F.lit(0).cast("long").alias("offset"), F.lit(json.dumps({count: 0, records: []})).alias("body"))) if not n else pages

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            for offset, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{folder}/{prefix}{offset}.json") as f:
                    f.write(text.encode())
            yield batch.select(["offset"])

    pages.mapInArrow(write, "offset long").count()
