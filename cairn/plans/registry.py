"""Named transforms and pipelines, pluggable sources and writers, and the registry of queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """A named table of functions: ``register`` adds (also as a decorator), ``build`` binds options."""

    def __init__(self, kind: str):
        self.kind = kind
        self.items: dict[str, Callable] = {}

    def register(self, name: str, f: Callable | None = None) -> Callable:
        if f is None:
            return lambda g: self.register(name, g)
        if name in self.items:
            raise ValueError(f"{self.kind} {name} is registered already")
        self.items[name] = f
        return f

    def build(self, name: str, **options) -> Callable:
        if name not in self.items:
            raise ValueError(f"no {self.kind} {name}; there are {sorted(self.items)}")
        return lambda *args: self.items[name](*args, **options)


TRANSFORMS, SOURCES, WRITERS = Registry("transform"), Registry("source"), Registry("writer")


def pipeline(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Apply registered transforms in order; a step is ``{"type": name, **options}``."""
    for step in steps:
        options = dict(step)
        df = df.transform(TRANSFORMS.build(options.pop("type"), **options))
    return df


#: The lineitem table seen as a point cloud. All coordinates are dyadic fractions, so sums are exact in any order.
POINTS_SQL = """
SELECT l_suppkey AS tile, l_suppkey % 10 AS source_block, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS point_id,
  l_orderkey * 8 + l_linenumber AS orig_idx,
  (l_partkey % 100) + l_quantity / CAST(64 AS DOUBLE) AS x,
  (l_orderkey % 100) + l_linenumber / CAST(8 AS DOUBLE) AS y,
  CAST(floor(l_extendedprice) AS DOUBLE) / CAST(1024 AS DOUBLE) AS z,
  CAST(1 + l_partkey % 8 AS INT) AS classification,
  CAST(1 + (l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 8 AS INT) AS pred,
  CAST(1 + (l_partkey + CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) % 8 AS INT) AS pred2,
  CAST(1 + l_orderkey % 4 AS INT) AS number_of_returns,
  CAST(1 + l_linenumber % (1 + l_orderkey % 4) AS INT) AS return_number,
  l_quantity * CAST(100 AS DOUBLE) AS intensity,
  CAST(l_partkey % 256 AS DOUBLE) AS r, CAST(l_orderkey % 256 AS DOUBLE) AS g, CAST(l_suppkey % 256 AS DOUBLE) AS b
FROM {lineitem}
"""


class Tables:
    """The tables of one folder; ``pts`` is the point view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def pts(self) -> DataFrame:
        return self.spark.sql(POINTS_SQL.format(lineitem="{lineitem}"), lineitem=self("lineitem"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Tables], DataFrame], select: str | None = None, ctes: str = "") -> None:
    """Register a query: ``build`` takes the tables; ``select`` is its SQL over the view ``pts`` and the tables, after ``ctes``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered already")
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if select is not None:
        SQL[name] = f"WITH RECURSIVE pts AS ({POINTS_SQL.format(lineitem='lineitem')}){', ' + ctes if ctes else ''} {select}"


def rnd(expression: str, digits: int = 6) -> str:
    """SQL of a double cut to some digits; the odd offset keeps exact halves, which engines round apart, off the edge."""
    return f"(floor(({expression}) * {10**digits} + 0.37::DOUBLE) / {10**digits}::DOUBLE)"


def cut(c: Column | str, digits: int = 6) -> Column:
    """The same in Spark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.37)) / F.lit(float(10**digits))
