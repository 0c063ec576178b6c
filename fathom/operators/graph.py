"""The artifact graph: cleaning, resolution of references, walks and rankings of nodes."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fathom.functions.access import in_scope
from fathom.session import write_table

#: Which relationship a walk follows first. Fixed values.
PRIORITY = {
    "references": 0, "validated-by": 1, "calls": 2, "defines": 3, "imports": 4, "inherits": 5, "uses": 6, "bridges": 7,
}


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges as a set, without self loops."""
    return edges.filter("source_id <> target_id").select("source_id", "target_id", "relationship").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose both ends are among ``nodes(id)``."""
    return edges.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(
        nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi"
    )


def priority(relationship) -> F.Column:
    out = F.lit(10)
    for name, n in PRIORITY.items():
        out = F.when(relationship == name, F.lit(n)).otherwise(out)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour, priority): both directions, the best relationship of each pair."""
    there = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour"), "relationship")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"), "relationship")
    return there.unionByName(back).groupBy("id", "neighbour").agg(F.min(priority(F.col("relationship"))).alias("priority"))


def placed(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """``near`` with the repository and tier of each neighbour; neighbours that ``nodes(id, repository, tier)`` lack are left out."""
    return near.join(nodes.select(F.col("id").alias("neighbour"), "repository", "tier"), "neighbour")


def walk(anchors: DataFrame, near: DataFrame, depth: int = 3, breadth: int = 50, requests: DataFrame | None = None) -> DataFrame:
    """(qid, id, level, position): breadth-first from ``anchors(qid, id, rank)`` over ``near(id, neighbour, priority)``.

    All requests walk at once, a level per step. A node takes the place of the earliest parent that reaches it, then
    the relationship's priority, then the id. A walk ends at ``depth`` and keeps its first ``breadth`` nodes; levels
    are written to the shared folder, so that each step starts from a table. With ``requests(qid, user_tier, repo_scope)``
    and a ``near`` of ``placed``, a walk neither gives nor passes through what its user may not see.
    """
    scopes = None if requests is None else requests.select("qid", "user_tier", "repo_scope")
    place = Window.partitionBy("qid")
    seen = write_table(
        anchors.select("qid", "id", F.lit(0).alias("level"), F.row_number().over(place.orderBy("rank", "id")).alias("position")),
        "walk",
    )
    for level in range(1, depth + 1):
        full = seen.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        last = seen.filter(F.col("level") == level - 1).join(full.filter(F.col("n") < breadth), "qid")
        steps = last.select("qid", "n", "id", "position").join(near, "id")
        if scopes is not None:
            steps = steps.join(scopes, "qid").filter((F.col("tier") <= F.col("user_tier")) & in_scope(F.col("repository"), F.col("repo_scope")))
        reached = (
            steps.groupBy("qid", F.col("neighbour").alias("id"))
            .agg(F.min(F.struct("position", "priority")).alias("via"), F.first("n").alias("n"))
            .join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        )
        order = F.row_number().over(place.orderBy("via.position", "via.priority", "id"))
        grown = reached.select("qid", "id", F.lit(level).alias("level"), (F.col("n") + order).cast("int").alias("position"))
        seen = write_table(seen.unionByName(grown), "walk")
    return seen.filter(F.col("position") <= breadth)


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, id): each reference to the one symbol of its repository that bears the name; ambiguous names resolve to none."""
    unique = (
        symbols.groupBy("repository", F.lower("symbol_name").alias("name"))
        .agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).filter("n = 1")
    )
    return references.join(unique, ["repository", "name"], "left").select("ref", "repository", "name", "id")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree). Counts come before the shuffle, so hubs are no hot keys."""
    ends = edges.select(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


#: Sources of shortest paths that a task follows at once: at most so many, and so many (source, node) cells.
PIVOT_BLOCK, CELLS = 2000, 400_000


def betweenness(edges: DataFrame, pivots: DataFrame, block: int = PIVOT_BLOCK) -> DataFrame:
    """(id, score): shortest-path betweenness over undirected edges, summed over ``pivots(pivot)`` as sources; exact.

    Trees that hang on the rest of the graph are folded into their roots first: what they add is a product of counts. Tasks
    then follow all shortest paths of the rest, whose nodes weigh as much as their trees, from their share of its nodes. The
    graph goes through the driver as pairs of numbers; the work grows with nodes times edges of what isn't folded.
    """
    spark = edges.sparkSession
    pairs = adjacency(edges).filter("id < neighbour").select("id", "neighbour")
    named = pairs.select("id").unionByName(pairs.select(F.col("neighbour").alias("id"))).distinct()
    chosen = pivots.select(F.col("pivot").alias("id"), F.lit(True).alias("chosen")).distinct()
    nodes = write_table(named.join(chosen, "id", "left").select("id", F.monotonically_increasing_id().alias("n"), F.col("chosen").isNotNull().alias("chosen")), "nodes")
    ends = nodes.select("id", "n")
    arcs = pairs.join(ends.withColumnRenamed("n", "a"), "id").join(ends.select(F.col("id").alias("neighbour"), F.col("n").alias("b")), "neighbour").select("a", "b").toArrow()
    known = nodes.select("n", "chosen").toArrow().sort_by("n")
    n = known.column("n").to_numpy()
    a, b = (np.searchsorted(n, arcs.column(c).to_numpy()) for c in ("a", "b"))
    chosen = known.column("chosen").to_numpy().astype(float)
    folded = fold_trees(a, b, chosen)
    parts = [spark.createDataFrame(pa.table({"n": n, "score": folded.score}), "n long, score double")]
    if len(folded.nodes):
        starts, near = _lists(folded.a, folded.b, len(folded.nodes))
        sources = np.flatnonzero(folded.pivots)
        shared = spark.sparkContext.broadcast((n[folded.nodes], starts, near, folded.sizes, folded.pivots, sources))

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, starts, near, sizes, weights, sources = shared.value
            total, at_once = np.zeros(len(names)), max(1, min(block, CELLS // len(names)))
            for batch in batches:
                mine = sources[batch.column("id").to_numpy()]
                for at in range(0, len(mine), at_once):
                    total += dependencies(starts, near, sizes, weights, mine[at : at + at_once])
            kept = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(total[kept])], ["n", "score"])

        tasks = max(1, min(len(sources), 4 * spark.sparkContext.defaultParallelism))
        parts.append(spark.range(0, len(sources), 1, tasks).mapInArrow(follow, "n long, score double"))
    score = functools.reduce(DataFrame.unionByName, parts).groupBy("n").agg(F.sum("score").alias("score")).filter("score > 0")
    return nodes.join(score, "n").select("id", "score")


@dataclass(frozen=True)
class Folded:
    """A graph without its trees: ``score`` of all nodes for pairs that trees tell; the other nodes, their edges and weights."""

    score: np.ndarray
    nodes: np.ndarray
    a: np.ndarray
    b: np.ndarray
    sizes: np.ndarray
    pivots: np.ndarray


def fold_trees(a: np.ndarray, b: np.ndarray, pivots: np.ndarray) -> Folded:
    """Folds leaves into what they hang on until none is left. ``a`` and ``b`` are the ends of undirected edges, each once.

    Pairs of a source and a target that lie in different trees of a node, or one in its trees and one elsewhere, go through it.
    """
    n = len(pivots)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    other = np.zeros(n, np.int64)  # of a leaf, the exclusive or of its neighbours is the only one
    np.bitwise_xor.at(other, a, b)
    np.bitwise_xor.at(other, b, a)
    size, source, same, gone = np.ones(n), pivots.astype(float), np.zeros(n), np.zeros(n, bool)
    leaves = np.flatnonzero(degree == 1)
    while len(leaves):
        roots = other[leaves]
        apart = (degree[roots] > 1) | (leaves < roots)  # of two nodes alone, one is the root
        leaves, roots = leaves[apart], roots[apart]
        gone[leaves] = True
        degree[leaves] = 0
        np.add.at(same, roots, size[leaves] * source[leaves])
        np.add.at(size, roots, size[leaves])
        np.add.at(source, roots, source[leaves])
        np.subtract.at(degree, roots, 1)
        np.bitwise_xor.at(other, roots, leaves)
        roots = np.unique(roots)
        leaves = roots[(degree[roots] == 1) & ~gone[roots]]
    label = _components(a, b, n)
    whole, sources = np.bincount(label, minlength=n)[label], np.bincount(label, weights=pivots, minlength=n)[label]
    below, below_sources = size - 1, source - pivots
    score = below * below_sources - same + below_sources * (whole - size) + (sources - source) * below
    kept = np.flatnonzero(degree > 0)
    within = (degree[a] > 0) & (degree[b] > 0)
    return Folded(score, kept, np.searchsorted(kept, a[within]), np.searchsorted(kept, b[within]), size[kept], source[kept])


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component."""
    label = np.arange(n)
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while (label != label[label]).any():
            label = label[label]


def _lists(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of all nodes in one array, and where those of each begin."""
    ends, near = np.concatenate([a, b]), np.concatenate([b, a])
    return np.append(0, np.cumsum(np.bincount(ends, minlength=n))), near[np.argsort(ends, kind="stable")]


def dependencies(starts: np.ndarray, near: np.ndarray, sizes: np.ndarray, weights: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Per node the dependencies of ``sources`` on it, each times its weight, where a target counts as its size.

    All sources go one level out per step, counting paths, and then one level back per step, adding up. A cell is a
    source's place times the number of nodes, plus a node.
    """
    n = len(sizes)
    first = np.arange(len(sources)) * n + sources
    paths, level, place = np.zeros(len(sources) * n), np.full(len(sources) * n, -1, np.int32), np.zeros(len(sources) * n, np.int64)
    paths[first], level[first] = 1.0, 0
    steps, frontier = [], first
    while len(frontier):
        node = frontier % n
        counts = starts[node + 1] - starts[node]
        shift = np.repeat(starts[node] - np.cumsum(counts) + counts, counts)
        back = np.repeat(frontier, counts)
        out = back - np.repeat(node, counts) + near[shift + np.arange(len(shift))]
        new = level[out] < 0
        back, out = back[new], out[new]
        np.add.at(paths, out, paths[back])
        level[out] = len(steps) + 1
        each = np.arange(len(out))
        place[out] = each
        frontier = out[place[out] == each]
        steps.append((back, out))
    credit = np.zeros(len(paths))
    for back, out in reversed(steps):
        np.add.at(credit, back, paths[back] / paths[out] * (sizes[out % n] + credit[out]))
    credit[first] = 0.0
    return weights[sources] @ credit.reshape(len(sources), n)


def central(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """``scores(id, score)`` with ``is_central``: whether a node is among the ``share`` of highest scores."""
    limit = scores.agg(F.percentile("score", F.lit(1 - share)).alias("limit"))
    return scores.join(F.broadcast(limit)).select("id", "score", (F.col("score") >= F.col("limit")).alias("is_central"))


def call_edges(artifacts: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship): calls within a file, resolved in order.

    A call is a name, perhaps qualified, before an opening bracket. It means the symbol whose qualified name it is; after
    ``self.``, ``cls.`` or ``this.`` the one of the caller's own class; other qualified names mean none; a short name means
    the only symbol of the file that bears it.
    """
    bodies = artifacts.filter(F.col("kind").endswith("-implementation")).withColumn("qualified", F.coalesce(F.col("metadata")["qualified_name"], F.col("symbol_name")))
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][\w.]*)\s*\("), F.lit(1)))
    owner = F.regexp_extract("qualified", r"^(.*)\.[^.]*$", 1)
    file = ["repository", "file_path"]
    calls = bodies.filter("text is not null").select(F.col("id").alias("source_id"), *file, owner.alias("owner"), F.explode(names).alias("reference"))
    dotted = F.col("reference").contains(".")
    own = F.when(F.col("reference").rlike(r"^(self|cls|this)\.") & (F.col("owner") != ""), F.concat("owner", F.lit("."), F.regexp_replace("reference", r"^\w+\.", "")))
    asked = calls.select("source_id", *file, F.when(dotted, F.col("reference")).alias("exact"), own.alias("own"), F.when(~dotted, F.col("reference")).alias("short"))
    qualified = bodies.filter("qualified is not null").groupBy(*file, "qualified").agg(F.min("id").alias("target"))
    short = bodies.filter("symbol_name is not null").select(*file, F.regexp_extract("symbol_name", r"([^.:]*)$", 1).alias("short"), "id").groupBy(*file, "short").agg(
        F.min("id").alias("by_short"), F.countDistinct("id").alias("n")).filter("n = 1").drop("n")
    found = (
        asked.join(qualified.select(*file, F.col("qualified").alias("exact"), F.col("target").alias("by_exact")), [*file, "exact"], "left")
        .join(qualified.select(*file, F.col("qualified").alias("own"), F.col("target").alias("by_own")), [*file, "own"], "left")
        .join(short, [*file, "short"], "left")
    )
    target = F.coalesce("by_exact", "by_own", "by_short")
    return found.select("source_id", target.alias("target_id"), F.lit("calls").alias("relationship")).filter("target_id is not null and source_id <> target_id").distinct()
