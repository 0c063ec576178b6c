"""Hashed embeddings and nearest vectors of a stated set of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from fathom.functions import text as T
from fathom.session import write_table

#: Queries per block, whose scores a task holds at once, and blocks per pass over the rows: what is broadcast is bounded,
#: whatever the number of queries.
BLOCK, PASS_BLOCKS = 1024, 16


def hashed_weights(rows: DataFrame, key: str, text: str, dimensions: int = 128) -> DataFrame:
    """(key, bucket, weight): signed counts of the tokens' buckets.

    A token's bucket is the first four bytes of its SHA-256 modulo ``dimensions``; its sign is + where the fifth byte is
    even. Tokens are hashed where they are read and added up before the only shuffle, which carries at most ``dimensions``
    rows per text and input partition.
    """
    digest = F.sha2("token", 256)
    hashed = rows.select(key, F.explode(T.tokens(F.col(text))).alias("token")).select(key, digest.alias("h"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    signed = hashed.select(
        key, (number(1, 8) % dimensions).cast("int").alias("bucket"), F.when(number(9, 2) % 2 == 0, 1).otherwise(-1).alias("sign")
    )
    return signed.groupBy(key, "bucket").agg(F.sum("sign").alias("weight")).filter("weight <> 0")


def hashed_vectors(rows: DataFrame, key: str, text: str, dimensions: int = 128) -> DataFrame:
    """(key, buckets, weights): sparse hashed vectors, one row per text that has tokens."""
    weights = hashed_weights(rows, key, text, dimensions).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.col("weight").cast("int").alias("weight")))).alias("v")
    )
    return weights.select(key, F.col("v.bucket").alias("buckets"), F.col("v.weight").alias("weights"))


#: Tokens whose buckets a task remembers.
KNOWN_TOKENS = 200_000


def row_vectors(rows: DataFrame, dimensions: int = 128) -> DataFrame:
    """(id, buckets, weights, tier, repository): ``hashed_vectors`` of ``rows(id, text, tier, repository)`` whose ids are distinct.

    A row is added up where it is read, so that nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, known = re.compile(T.TOKEN), {}

        def of(word: str) -> tuple[int, int]:
            if word not in known:
                if len(known) >= KNOWN_TOKENS:
                    known.clear()
                digest = hashlib.sha256(word.encode()).digest()
                known[word] = int.from_bytes(digest[:4]) % dimensions, 1 if digest[4] % 2 == 0 else -1
            return known[word]

        for batch in batches:
            buckets, weights, kept = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                sums = [0] * dimensions
                for word in token.findall(text or ""):
                    bucket, sign = of(word)
                    sums[bucket] += sign
                filled = [b for b in range(dimensions) if sums[b]]
                if filled:
                    kept.append(at)
                    buckets.append(filled)
                    weights.append([sums[b] for b in filled])
            part, kind = batch.select(["id", "tier", "repository"]).take(pa.array(kept, pa.int64())), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(buckets, kind), pa.array(weights, kind), part.column("tier"), part.column("repository")],
                ["id", "buckets", "weights", "tier", "repository"],
            )

    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, buckets array<int>, weights array<int>, tier {kinds['tier']}, repository {kinds['repository']}"
    return rows.select("id", F.lower("text").alias("text"), "tier", "repository").mapInArrow(run, schema)


def _dense(buckets: pa.Array, weights: pa.Array, dimensions: int) -> np.ndarray:
    lengths = buckets.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(buckets), dimensions))
    out[np.repeat(np.arange(len(buckets)), lengths), buckets.flatten().to_numpy(zero_copy_only=False)] = (
        weights.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def _best(ids: pa.Array, scores: np.ndarray, qids: np.ndarray, k: int) -> pa.RecordBatch:
    """Of one batch of rows, each query's best ``k`` and all that tie with the last of them."""
    n = scores.shape[0]
    if n > k:
        limit = np.partition(scores, n - k, axis=0)[n - k]
        rows, columns = np.nonzero((scores >= limit - 1e-12) & np.isfinite(scores))
    else:
        rows, columns = np.nonzero(np.isfinite(scores))
    return pa.RecordBatch.from_arrays(
        [pa.array(qids[columns]), ids.take(pa.array(rows)), pa.array(scores[rows, columns])], ["qid", "id", "score"]
    )


def _may_see(batch: pa.RecordBatch, tiers: np.ndarray, scopes: list) -> np.ndarray:
    """(rows x queries): whether the query's user may see the row, by its tier and repository."""
    row_tiers = batch.column("tier").to_numpy(zero_copy_only=False).astype(float)
    coded = batch.column("repository").dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    codes = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    scoped = np.array([[s is None or (r is not None and r in s) for s in scopes] for r in names], bool).reshape(len(names), len(scopes))
    return (row_tiers[:, None] <= tiers[None, :]) & scoped[codes]


def _against(blocks, dimensions: int, k: int, sparse: bool):
    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if sparse:
                x = _dense(batch.column("buckets"), batch.column("weights"), dimensions)
            else:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
            norms = np.sqrt((x**2).sum(1))
            for qids, matrix, tiers, scopes in blocks.value:
                lengths = np.sqrt((matrix**2).sum(1))
                scores = (x @ matrix.T) / np.maximum(norms[:, None] * lengths[None, :], 1e-300)
                if tiers is not None:
                    scores[~_may_see(batch, tiers, scopes)] = -np.inf
                yield _best(batch.column("id"), scores, qids, k)

    return against


def _block(table: pa.Table, dimensions: int, sparse: bool, access: bool) -> tuple:
    if sparse:
        matrix = _dense(table.column("buckets").combine_chunks(), table.column("weights").combine_chunks(), dimensions)
    else:
        matrix = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(float)
    qids = table.column("qid").to_numpy()
    if not access:
        return qids, matrix, None, None
    scopes = [None if s is None else frozenset(s) for s in table.column("repo_scope").to_pylist()]
    return qids, matrix, table.column("user_tier").to_numpy().astype(float), scopes


def nearest(
    queries: DataFrame, rows: DataFrame, dimensions: int, k: int, sparse: bool, id_type: str = "string", access: bool = False
) -> DataFrame:
    """(qid, id, score, rank): every query's ``k`` most similar rows by cosine, exactly, ties by id.

    ``queries`` and ``rows`` have (qid or id, buckets, weights) if ``sparse``, else (qid or id, vector); with ``access``,
    queries have user_tier and repo_scope and rows tier and repository, and only rows that the user may see compete.
    Both are written once; every pass over the rows holds them against PASS_BLOCKS blocks of queries, each broadcast.
    """
    spark = rows.sparkSession
    vector = ["buckets", "weights"] if sparse else ["vector"]
    queries = queries.select("qid", *vector, *(["user_tier", "repo_scope"] if access else []))
    rows = rows.select("id", *vector, *(["tier", "repository"] if access else []))
    asked = write_table(queries, "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    found = None
    for first in range(0, blocks, PASS_BLOCKS):
        held = numbered.filter((F.col("_block") >= first) & (F.col("_block") < first + PASS_BLOCKS)).toArrow()
        parts = [held.filter(pc.equal(held.column("_block"), b)) for b in range(first, min(first + PASS_BLOCKS, blocks))]
        packed = [_block(t, dimensions, sparse, access) for t in parts if t.num_rows]
        if not packed:
            continue
        part = rows.mapInArrow(
            _against(spark.sparkContext.broadcast(packed), dimensions, k, sparse), f"qid long, id {id_type}, score double"
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"qid long, id {id_type}, score double, rank int")
    rounded = found.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)
