"""Problem 6: the most similar vectors of every vector.

NN-descent: a first graph comes from random hyperplanes (vectors sorted by the signs of their projections are compared
with those beside them, in blocks that overlap), then rounds of Spark joins compare the neighbours of each vector with one
another and keep the best, whatever their similarity, until few edges change. A round looks only at vectors with a new
edge. The descent runs on vectors of one byte per value; the resulting pairs are measured again exactly. Queries walk the
graph greedily until no beam improves.

Recall is below 1 by nature of the method; ``tests/llm`` hold it against brute force.

Defined results: null, short, long, NaN-bearing and all-zero vectors take no part; an id counts once; ties are broken
by the smaller internal number; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathom.session import write_table

#: Orderings by hyperplane signs, planes per ordering, rows compared with one another, rows that two blocks share, and the
#: best of them that an ordering proposes.
ORDERINGS, PLANES, BESIDE, OVERLAP, PROPOSED = 8, 24, 128, 32, 6

#: Edges per vector, and neighbours of one vector, in and out, that a round compares with one another.
DEGREE, FAN = 10, 12

#: The descent ends with a round that changes at most this share of the edges.
CHANGED = 0.03


def usable(column: str, dimensions: int) -> F.Column:
    v = F.col(column)
    return (
        v.isNotNull()
        & (F.size(v) == dimensions)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        & F.exists(v, lambda x: x != 0)
    )


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a value, and the scale that gives back the unit length."""
    q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
    return q, (1 / np.linalg.norm(q.astype(np.float32), axis=1)).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _from_binary(column: pa.Array, dimensions: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dimensions).astype(np.float32)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _quantise(dimensions: int):
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, _ = _bytes(_unit(_rows(batch.column(1), dimensions)))
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(q)], ["v", "q"])

    return quantise


def _orderings(dimensions: int):
    def orderings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(7).standard_normal((dimensions, ORDERINGS * PLANES)).astype(np.float32)
        weights = (1 << np.arange(PLANES, dtype=np.int64))[::-1]
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = (_from_binary(batch.column(1), dimensions) @ planes > 0).reshape(-1, ORDERINGS, PLANES)
            keys = signs @ weights + (np.arange(ORDERINGS, dtype=np.int64) << PLANES)
            for t in range(ORDERINGS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, t], pa.int64()), batch.column(0), batch.column(1)], ["key", "v", "q"]
                )

    return orderings


def _best(ids: np.ndarray, x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s) of each row's ``degree`` most similar other rows."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    if len(ids) > degree + 1:
        limit = np.partition(s, -degree, axis=1)[:, -degree]
        a, b = np.nonzero(s >= limit[:, None])
    else:
        a, b = np.nonzero(s > -2)
    keep = ids[a] != ids[b]
    return ids[a][keep], ids[b][keep], s[a, b][keep]


def _compare_beside(dimensions: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros(0, np.int64), np.zeros((0, dimensions), np.float32)
        for batch in batches:
            ids = np.concatenate([held_ids, batch.column(1).to_numpy()])
            x = np.concatenate([held, _from_binary(batch.column(2), dimensions)])
            for start in range(0, max(len(ids) - OVERLAP, 1), BESIDE - OVERLAP):
                a, b, s = _best(ids[start : start + BESIDE], x[start : start + BESIDE], PROPOSED)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s, pa.float32())], ["a", "b", "s"])
            held_ids, held = ids[-OVERLAP:], x[-OVERLAP:]

    return compare


def _compare_around(dimensions: int):
    """Members of one neighbourhood with one another; only pairs of which one is new to it and that beat the worst edge."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            inner = lists.flatten()
            ids, new, worst = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("u", "new", "worst"))
            x = _from_binary(inner.field("q"), dimensions) if len(ids) else None
            out, at = [], 0
            for n in lists.value_lengths().to_pylist():
                part = slice(at, at + n)
                s = x[part] @ x[part].T
                fresh = new[part]
                a, b = np.nonzero((s > worst[part][:, None]) & (fresh[:, None] | fresh[None, :]))
                keep = a != b
                out.append((ids[part][a[keep]], ids[part][b[keep]], s[a[keep], b[keep]]))
                at += n
            if out:
                a, b, s = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(s, pa.float32())], ["a", "b", "s"]
                )

    return compare


def _keep_best(edges: DataFrame, degree: int) -> DataFrame:
    """Each vector's ``degree`` best edges; an edge is ``new`` if none of its rows is old."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), *([F.min("new").alias("new")] if "new" in edges.columns else []))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= degree).drop("rank")


def neighbour_graph(rows: DataFrame, id_col: str, vector_col: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(vectors(v, id, x), edges(a, b, s)): each vector's most similar others, approximately.

    Both tables are written to the shared folder.
    """
    clean = (
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
        .filter(F.col("id").isNotNull() & usable("x", dimensions))
        .dropDuplicates(["id"])
        .withColumn("v", F.monotonically_increasing_id())
    )
    vectors = write_table(clean, "vectors")
    edge = "a long, b long, s float"
    coded = write_table(vectors.select("v", "x").mapInArrow(_quantise(dimensions), "v long, q binary"), "coded")
    keyed = coded.mapInArrow(_orderings(dimensions), "key long, v long, q binary")
    beside = keyed.repartitionByRange(F.col("key")).sortWithinPartitions("key").mapInArrow(_compare_beside(dimensions), edge)
    edges = write_table(_keep_best(beside, DEGREE).withColumn("new", F.lit(True)), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "new"))
        fans = write_table(_keep_best(both, FAN).select(F.col("a").alias("centre"), F.col("b").alias("u"), "new"), "fans")
        moved = fans.groupBy("centre").agg(F.max("new").alias("moved")).filter("moved").select("centre")
        around = fans.join(moved, "centre", "left_semi").unionByName(moved.select("centre", F.col("centre").alias("u"), F.lit(False).alias("new")))
        limits = edges.groupBy("a").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= DEGREE)
        known = coded.join(limits.select(F.col("a").alias("v"), "s"), "v", "left").select(
            F.col("v").alias("u"), "q", F.coalesce("s", F.lit(-1.0).cast("float")).alias("worst")
        )
        lists = around.join(known, "u").groupBy("centre").agg(F.collect_list(F.struct("u", "q", "new", "worst")).alias("members")).select("members")
        found = lists.mapInArrow(_compare_around(dimensions), edge).groupBy("a", "b").agg(F.max("s").alias("s"))
        fresh = _keep_best(found, DEGREE).withColumn("new", F.lit(True))
        edges = write_table(_keep_best(edges.withColumn("new", F.lit(False)).unionByName(fresh), DEGREE), "edges")
        counts = edges.agg(F.count(F.lit(1)).alias("n"), F.count_if("new").alias("new")).first()
        if counts["new"] <= CHANGED * counts["n"]:
            return vectors, edges.drop("new")


def _cosines(dimensions: int):
    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unit(_rows(batch.column(i), dimensions).astype(np.float64)) for i in (2, 3))
            s = np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "s"])

    return cosines


def measure(pairs: DataFrame, vectors: DataFrame, dimensions: int) -> DataFrame:
    """(a, b, s): the exact cosine similarity of ``pairs(a, b)``."""
    x = vectors.select(F.col("v").alias("a"), F.col("x").alias("xa"))
    y = vectors.select(F.col("v").alias("b"), F.col("x").alias("xb"))
    return (
        pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb")
        .mapInArrow(_cosines(dimensions), "a long, b long, s double")
    )


def similar_pairs(
    rows: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "id", vector_col: str = "embedding",
    dimensions: int = 128,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one is among the other's ``k`` most similar, with a cosine of at least ``least``."""
    vectors, edges = neighbour_graph(rows, id_col, vector_col, dimensions)
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    exact = write_table(measure(pairs, vectors, dimensions).filter(F.col("s") >= least), "cosines")
    both = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    kept = _keep_best(both, k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = vectors.select("v", "id")
    named = kept.join(names.select(F.col("v").alias("a"), F.col("id").alias("x")), "a").join(
        names.select(F.col("v").alias("b"), F.col("id").alias("y")), "b"
    )
    return named.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def graph_search(
    queries: DataFrame, vectors: DataFrame, edges: DataFrame, dimensions: int, k: int = 10,
    beam: int = 32, entries: int = 64,
) -> DataFrame:
    """(q, v, s, rank): greedy search of the graph for ``queries(q, x)``, a beam of nodes per query, all queries at once.

    Each step joins the beam's nodes that were not expanded yet with their neighbours, in both directions, measures the
    new ones and keeps the best ``beam``; the search ends when no beam has a node left to expand. Entry points are the
    ``entries`` nodes with the least hash: a fixed number, broadcast.
    """
    known = vectors.select("v", "x")
    both = edges.select("a", "b", "s").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    links = write_table(_keep_best(both, FAN).select("a", "b"), "links")
    asked = queries.select("q", F.col("x").alias("xq"))

    def scored(candidates: DataFrame) -> DataFrame:
        return (
            candidates.join(known, "v").join(asked, "q").select(F.col("q").alias("a"), F.col("v").alias("b"), "xq", "x")
            .mapInArrow(_cosines(dimensions), "a long, b long, s double")
            .select(F.col("a").alias("q"), F.col("b").alias("v"), "s")
        )

    def best(rows: DataFrame, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= n)

    start = known.select("v").orderBy(F.xxhash64("v")).limit(entries)
    first = asked.select("q").join(F.broadcast(start), how="cross")
    held = write_table(best(scored(first), beam).drop("rank").withColumn("expanded", F.lit(False)), "beam")
    while not held.filter(~F.col("expanded")).isEmpty():
        reached = (
            held.filter(~F.col("expanded")).select("q", F.col("v").alias("a")).join(links, "a")
            .select("q", F.col("b").alias("v")).distinct().join(held.select("q", "v"), ["q", "v"], "left_anti")
        )
        grown = held.withColumn("expanded", F.lit(True)).unionByName(scored(reached).withColumn("expanded", F.lit(False)))
        held = write_table(best(grown, beam).drop("rank"), "beam")
    return best(held, k).select("q", "v", "s", "rank")
