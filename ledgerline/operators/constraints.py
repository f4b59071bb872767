"""Constraints as declarations, compiled to one aggregation a table.

Row checks (a predicate that must be true; unknown counts against it) and foreign keys (a marker joined from the distinct keys
of the other table) of a table are counted together in one pass over it.  Keys that must be unique, and sets that must be the
same, have a grouped pass of their own each, with partial counts.  What can be said of a schema costs no pass.  observed()
attaches the row checks to a table that is being written, so that a check costs no pass at all."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Holds:
    """A predicate over the table's rows (and the columns that `beside` joins by key: table, own keys, its keys, columns)."""

    name: str
    table: str
    predicate: Column
    where: Column | None = None


@dataclass(frozen=True)
class Known:
    """Keys that another table must have."""

    name: str
    table: str
    keys: tuple[str, ...]
    other: str
    other_keys: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    name: str
    table: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class SameKeys:
    """The different keys of both tables must be the same: missing ones and unknown ones are counted."""

    name: str
    table: str
    keys: tuple[str, ...]
    other: str
    other_keys: tuple[str, ...]


@dataclass(frozen=True)
class Columns:
    """The columns that a table must have; exactly: no others."""

    name: str
    table: str
    columns: tuple[str, ...] = field(default=())
    exactly: bool = False


Constraint = Holds | Known | Unique | SameKeys | Columns


def required(name: str, table: str, *columns: str) -> Holds:
    return Holds(name, table, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def within(name: str, table: str, column: str, values: list[str]) -> Holds:
    return Holds(name, table, F.col(column).isin(*values))


def _broken(c: Holds, predicate: Column) -> Column:
    bad = ~F.coalesce(predicate, F.lit(False))
    return F.count_if(bad if c.where is None else F.coalesce(c.where, F.lit(False)) & bad)


def _named(violations: dict[str, Column]) -> Column:
    rows = [F.struct(F.lit(n).alias("constraint_name"), v.cast("long").alias("violations")) for n, v in violations.items()]
    return F.inline(F.array(*rows))


def _distinct(df: DataFrame, keys: tuple[str, ...], mark: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"{mark}_{i}") for i, k in enumerate(keys)]).distinct().withColumn(mark, F.lit(True))


def _same(own: list[str] | tuple[str, ...], mark: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{mark}_{i}")) for i, k in enumerate(own)])


def _rows_of(table: str, df: DataFrame, tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame | None:
    """One pass over a table for its row checks and foreign keys."""
    checks: dict[str, Column] = {}
    for k, c in enumerate(constraints):
        if isinstance(c, Holds) and c.table == table:
            checks[c.name] = _broken(c, c.predicate)
        elif isinstance(c, Known) and c.table == table:
            mark = f"_known{k}"
            df = df.join(_distinct(tables[c.other], c.other_keys, mark), _same(c.keys, mark), "left")
            checks[c.name] = F.count_if(F.col(mark).isNull())
    if not checks:
        return None
    aliases = {name: f"_c{k}" for k, name in enumerate(checks)}
    return df.agg(*[x.alias(aliases[n]) for n, x in checks.items()]).select(_named({n: F.col(a) for n, a in aliases.items()}))


def _keys_of(c: Unique | SameKeys, tables: dict[str, DataFrame]) -> DataFrame:
    df = tables[c.table]
    if isinstance(c, Unique):
        n = df.groupBy(*c.keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_bad"))
    else:
        a, b = _distinct(df, c.keys, "_a"), _distinct(tables[c.other], c.other_keys, "_b")
        both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"_a_{i}").eqNullSafe(F.col(f"_b_{i}")) for i in range(len(c.keys))]), "full")
        n = both.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("_bad"))
    return n.select(_named({c.name: F.col("_bad")}))


def report(tables: dict[str, DataFrame], constraints: list[Constraint]) -> DataFrame:
    """constraint_name and violations of every constraint."""
    names = [c.name for c in constraints]
    if len(set(names)) < len(names):
        raise ValueError("constraints have names of their own")
    parts = [x for table, df in tables.items() if (x := _rows_of(table, df, tables, constraints)) is not None]
    parts += [_keys_of(c, tables) for c in constraints if isinstance(c, Unique | SameKeys)]
    schema: dict[str, Column] = {}
    for c in constraints:
        if isinstance(c, Columns):
            own, wanted = set(tables[c.table].columns), set(c.columns)
            schema[c.name] = F.lit(len(wanted - own) + (len(own - wanted) if c.exactly else 0))
    if schema:
        spark = next(iter(tables.values())).sparkSession
        parts.append(spark.range(1).select(_named(schema)))
    return reduce(DataFrame.unionByName, parts)


def observed(df: DataFrame, constraints: list[Constraint], name: str = "constraints") -> tuple[DataFrame, Observation]:
    """df that counts, while an action reads it, the violations of its row checks: observation.get has them by name."""
    watch = Observation(name)
    checks = [_broken(c, c.predicate).alias(c.name) for c in constraints if isinstance(c, Holds)]
    return df.observe(watch, *checks), watch
