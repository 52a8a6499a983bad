"""Connected components of an edge table by alternating large and small stars, small tables in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.storage import Stored


def _shape(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


#: Edges, at most, that one task joins by itself: some 10 MB, and less time than a round of stars takes.
SMALL = 50_000


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b), the component being the smallest node."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    nodes, kind = list(up), batch.schema.field(0).type if up else pa.null()
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "component"])


def _in_one_task(rows: DataFrame) -> DataFrame:
    kind = rows.schema["a"].dataType.simpleString()
    return Stored(rows.coalesce(1).mapInArrow(_join_all, f"node {kind}, component {kind}"), "components").df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge, the component being the smallest node that is reachable.

    Edges point both ways; loops and repeats do no harm, and rows with a null are left out. Every round hangs
    neighbours below the smallest one (first those above a node, then those below it), so that paths shorten by a
    factor a round; the edge table of a round is written to the shared folder and that of the round before deleted.
    Nothing but the row count and a checksum comes to the driver; edges that are few by that count are joined in one
    task. Minima are taken by aggregation and joined back, so
    that the node of a large star is pre-aggregated and its join can be split.
    """
    rows = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if rows.count() <= SMALL:
        return _in_one_task(rows)
    loops = rows.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    held = Stored(rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    loops_held = Stored(loops.distinct(), "components-loops")
    before = _shape(held.df)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = held.df.select("a", "b").union(held.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("e"))
        small = small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        new = Stored(small, "components")
        held.drop()
        held, shape = new, _shape(new.df)
        if shape == before:
            break
        before = shape
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    stars = held.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    found = stars.union(roots)
    return found.union(loops_held.df.join(found.select("node"), "node", "left_anti"))
