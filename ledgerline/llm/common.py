"""What the corpus operators share: words, shared folders, sizes of plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and the five ASCII controls 09-0D.
SPACE = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text, without a word for null and empty texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the setting is missing, local runs (tests) set a folder of this machine
    and a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="ledgerline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage
    ends there, and lost executors cost no recomputation before it.  Such tables stay in
    the shared folder, as checkpoints do, for results are read from them later."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark deletes a write's shuffle files as soon as it has ended, where it otherwise waits for the driver to forget the plan.
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """stored(), whose shuffles don't stay on the executors' disks beside those of what follows."""
    conf = df.sparkSession.conf
    before = conf.get(DROPPED, None)
    conf.set(DROPPED, "true")
    try:
        return stored(df, name)
    finally:
        conf.unset(DROPPED) if before is None else conf.set(DROPPED, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, taken: list[str]) -> str:
    """name, or the first of name_, name__, ... that no column has (case doesn't tell columns apart)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def _scans_files(df: DataFrame) -> bool:
    """Whether df is a file scan under nothing but projections and filters, so that _metadata tells its rows apart."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    return {"file_path", "row_index"} <= {f.name for f in df.select("_metadata.*").schema}


def numbered(df: DataFrame, name: str = "_number", table: str = "numbered") -> DataFrame:
    """df with a number of its own for every row, the same whenever the plan runs.

    Rows of a file scan are told by file and place in it, however the scan is split; files get their
    numbers from a small table (one row a file).  Any other table is numbered once and stored."""
    if not _scans_files(df):
        return stored(df.withColumn(name, F.monotonically_increasing_id()), table)
    own = [F.col(f"`{c}`") for c in df.columns]
    path, place, file, file_no = (free(c, [*df.columns, name]) for c in ("_path", "_place", "_file", "_file_no"))
    files = df.select(F.col("_metadata.file_path").alias(file)).distinct()
    files = stored(files.select(file, (F.row_number().over(Window.orderBy(file)) - 1).cast("long").alias(file_no)), f"{table}-files")
    places = df.select(*own, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    # One row a file: a few bytes for each 100 MB or so of input.
    joined = places.join(F.broadcast(files), F.col(path) == F.col(file))
    return joined.select(*own, (F.shiftleft(file_no, 40) + F.col(place)).alias(name))


def sums_before(x: Column, block: int = 256) -> Column:
    """For every element of an array of integers the sum of those before it.

    An array that grows inside aggregate() is copied at every step, so it grows in blocks: the time
    is that of n * block, not of n * n."""
    long = "array<bigint>"
    cut = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block))))
    cut = F.coalesce(cut, F.array().cast("array<array<bigint>>"))

    def within(part: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(long).alias("sums"))
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["sums"], F.array(acc["at"])).alias("sums"))
        return F.aggregate(part, begin, step, lambda acc: acc["sums"])

    totals = F.transform(cut, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.flatten(F.zip_with(cut, within(totals), lambda part, first: F.transform(within(part), lambda v: v + first)))


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most so many: all whose count is above a bound.

    The bound comes from a histogram over powers of 2 ** (1 / 16), some hundred rows, so that not every task sends its
    own largest rows; rows of the class that doesn't fit whole stay out, whichever they are."""
    scale = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    classes = df.where(F.col(count) > 0).groupBy(scale.alias("scale")).count().collect()
    bound, total = None, 0
    for number, rows in sorted(classes, reverse=True):
        total += rows
        if total > most:
            break
        bound = number
    return df.where(F.lit(False)) if bound is None else df.where((F.col(count) > 0) & (scale >= bound))
