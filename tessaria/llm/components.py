"""Consolidating pairwise matches into groups: hierarchical union-find over spanning forests.

A level works like this:

1. Union-find runs inside every edge partition, over bounded blocks of edges, and keeps only a spanning
   forest: one edge (node, smallest node of its local tree) per node.
2. Per node, the trees of different blocks that hold it are linked: its smallest root becomes its label,
   and each other root gets an edge to that label. These edges are over roots only, so the graph shrinks.
3. The shrunken forest goes to the next level, redistributed by a rebalance on one endpoint (which splits
   hot nodes), until it fits one bounded block, whose union-find gives the global components.

Labels then run back through the levels by joins of (node, label) tables. A hub that holds a third of all
edges meets no single task: blocks reduce it to one edge each before the first shuffle.

Defined results: null, blank and repeated members are ignored; a member linked to no other has no row; empty
input gives an empty result; other columns are ignored. Rows may repeat and arrays may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.runtime import delete_path, fresh_path, key, materialize

#: Edges that one union-find block holds at most, and the size from which a level is the last one.
BLOCK_EDGES = 400_000

FOREST = "node string, root string"


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component; a, b: ends of the edges among nodes 0..n-1, vectorised."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        ra, rb = label[a], label[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))  # hook the larger root
        while True:  # pointer jumping
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Spanning forest of the edges (u, v) as (node, smallest node of its tree), roots included."""
    names = pc.unique(pa.concat_arrays([u, v]))
    names = names.take(pc.sort_indices(names))  # codes then compare as the strings do
    code = lambda x: pc.index_in(x, names).to_numpy(zero_copy_only=False)
    label = union_find(code(u), code(v), len(names))
    return names, names.take(pa.array(label))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _forests(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, most):
            u, v = (block.column(c).combine_chunks().cast(pa.string()) for c in ("u", "v"))
            node, root = _forest(u, v)
            yield from pa.table({"node": node, "root": root}).to_batches(max_chunksize=100_000)

    return run


def member_edges(df: DataFrame, members: str) -> DataFrame:
    """Star edges (u, v) of each row's distinct members, written as keys; u is the first of them."""
    keys = F.array_distinct(F.filter(F.transform(F.col(members), lambda x: key(x)), lambda x: x.isNotNull()))
    rows = df.select(keys.alias("k")).filter(F.size("k") > 1)
    return rows.select(F.col("k")[0].alias("u"), F.explode(F.slice("k", 2, 2_000_000_000)).alias("v"))


def connected_components(edges: DataFrame, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(u, v) strings -> (node, component): every node of an edge with the smallest node it is linked to.

    An edge from a node to itself counts as no link.
    """
    spark = edges.sparkSession
    edges = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    levels: list[DataFrame] = []
    while True:
        path = fresh_path(spark, "forest")
        edges.mapInArrow(_forests(block_edges), FOREST).write.parquet(path)
        forest = spark.read.schema(FOREST).parquet(path)
        # one row per node and block: a node's roots are as many as the blocks that hold it, not its edges
        joined = materialize(
            forest.groupBy("node").agg(F.min("root").alias("label"), F.collect_set("root").alias("roots")).withColumn("roots", F.array_remove("roots", F.col("label"))),
            "labels",
        )
        delete_path(spark, path)
        levels.append(joined.select("node", "label"))
        edges = joined.filter(F.size("roots") > 0).select(F.explode("roots").alias("u"), F.col("label").alias("v")).distinct()
        edges = materialize(edges, "rest")
        left = edges.count()
        if left == 0:
            break
        if left <= block_edges:
            top = edges.coalesce(1).mapInArrow(_forests(block_edges * 2), FOREST)
            levels.append(materialize(top, "top").select("node", F.col("root").alias("label")))
            break
        # co-locate by the endpoint with the smaller hash: stars contract; the rebalance splits hot ones
        first = F.xxhash64("u", F.lit(len(levels))) < F.xxhash64("v", F.lit(len(levels)))
        edges = edges.withColumn("c", F.when(first, F.col("u")).otherwise(F.col("v"))).hint("rebalance", "c").drop("c")
    found = levels[-1]
    for level in reversed(levels[:-1]):
        up = found.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        found = level.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return found.select("node", F.col("label").alias("component"))


def consolidate(df: DataFrame, members: str) -> DataFrame:
    """Group identifiers of all hashes named in the arrays of column ``members``: (raw_hash, group_hash)."""
    return connected_components(member_edges(df, members)).select(F.col("node").alias("raw_hash"), F.col("component").alias("group_hash"))
