"""Problem 5: near-equal bodies among a collection too large for pairwise comparison.

Order MinHash: of each body's occurrence-labelled token triples, several sketches each keep the smallest ones and their
order in the text, so that bodies within a small edit distance share sketches. Bodies that share one and whose numbers of
triples allow the similarity are aligned within a band, then compared exactly; a frequent sketch is split over tasks. Exact copies are one representative until the end.

Defined results: null texts and bodies of fewer than three tokens are in no pair; an id counts once, however often its
row is delivered; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fathom.llm.hot import pairs_sharing
from fathom.session import spread, write_table

#: Sketches per body and smallest triples per sketch. A pair of Jaccard index 0.7 shares no sketch with p < 1e-5.
SKETCHES, SMALLEST = 20, 2

#: Candidates whose banded alignment matches less than this share of the longer body are dropped before the exact check.
LEAST_ALIGNED = 0.2

_TOKEN = re.compile(r"[a-z0-9_]+")
_U = np.uint64


def tokens(text: str) -> list[str]:
    """Longest runs of ASCII letters, digits and _ in the lower-cased text."""
    return _TOKEN.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[:, None]


def sketch(words: list[str], hashes: dict[str, int]) -> list[int]:
    """The order-sensitive sketches of a body; none below three tokens."""
    if len(words) < 3:
        return []
    for w in words:
        if w not in hashes:
            hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.array([hashes[w] for w in words], np.uint64)
    with np.errstate(over="ignore"):
        triples = _mix(_mix(_mix(h[:-2]) + h[1:-1]) + h[2:])
        order = np.argsort(triples, kind="stable")
        s = triples[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
        labelled = _mix(triples + occurrence * _U(0xD6E8FEB86659FD93))
        seen = _mix(labelled ^ _SEEDS)
        least = min(SMALLEST, len(s))
        smallest = np.sort(np.argpartition(seen, least - 1, axis=1)[:, :least], axis=1)
        key = _SEEDS[:, 0].copy()
        for i in range(least):
            key = _mix(key + labelled[smallest[:, i]])
    return key.view(np.int64).tolist()


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes: dict[str, int] = {}
    for batch in batches:
        if len(hashes) > 1_000_000:
            hashes.clear()
        words = [tokens(t) for t in batch.column(1).to_pylist()]
        joined = [" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([xxhash.xxh128_digest(j) for j in joined], pa.binary()),
                pa.array(joined, pa.string()),
                pa.array([sketch(w, hashes) for w in words], pa.list_(pa.int64())),
                pa.array([len(set(zip(w, w[1:], w[2:]))) for w in words], pa.int32()),
            ],
            ["id", "content", "tokens", "sketches", "n"],
        )


def aligned(a: list[str], b: list[str], band: int) -> int:
    """Matched tokens in the best alignment of ``a`` and ``b`` within ``band`` of the diagonal (bit-parallel)."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    slope = len(b) / max(len(a), 1)
    for i, w in enumerate(a):
        match = places.get(w, 0)
        if match:
            low = max(0, int(i * slope) - band)
            match &= (1 << (int(i * slope) + band + 1)) - (1 << low)
            kept = row & match
            row = (row + kept | row - kept) & full
    return len(b) - row.bit_count()


def jaccard(a: list[str], b: list[str]) -> float:
    """Jaccard index of the sets of token triples."""
    x = set(zip(a, a[1:], a[2:]))
    y = set(zip(b, b[1:], b[2:]))
    return len(x & y) / max(1, len(x | y))


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            out = []
            for ia, ib, x, y in zip(a, b, ta, tb):
                p, q = x.split(" "), y.split(" ")
                longer = max(len(p), len(q))
                matched = aligned(p, q, max(32, longer // 2)) / longer
                if matched >= LEAST_ALIGNED and (j := jaccard(p, q)) >= threshold:
                    out.append((ia, ib, matched, j))
            columns = list(zip(*out)) or [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["rep_a", "rep_b", "aligned", "similarity"]
            )

    return verify


def near_copies(bodies: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members(id, rep), pairs(rep_a, rep_b, aligned, similarity)) of ``bodies(id, text)``.

    ``rep`` is the least id with the same tokens; ``pairs`` are the pairs of representatives of at least ``threshold``.
    """
    usable = bodies.filter(F.col("text").isNotNull()).select("id", "text")
    rows = write_table(
        spread(usable).mapInArrow(_sketch_rows, "id string, content binary, tokens string, sketches array<long>, n int")
        .filter(F.size("sketches") > 0),
        "sketches",
    )
    classes = rows.groupBy("content").agg(F.min("id").alias("rep"))
    members = write_table(rows.join(classes, "content").select("id", "rep").distinct(), "members")
    reps = rows.join(
        members.filter(F.col("id") == F.col("rep")).select("id"), "id", "left_semi"
    ).select("id", "tokens", "sketches", "n").dropDuplicates(["id"])
    keys = reps.select(F.col("id").alias("x"), "n", F.explode("sketches").alias("key"))
    pairs = pairs_sharing(keys, threshold).select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"))
    texts = reps.select("id", "tokens")
    candidates = (
        pairs.join(texts.select(F.col("id").alias("rep_a"), F.col("tokens").alias("tokens_a")), "rep_a")
        .join(texts.select(F.col("id").alias("rep_b"), F.col("tokens").alias("tokens_b")), "rep_b")
        .select("rep_a", "rep_b", "tokens_a", "tokens_b")
    )
    verified = candidates.mapInArrow(
        _verify(threshold), "rep_a string, rep_b string, aligned double, similarity double"
    )
    return members, write_table(verified, "near-pairs")


def near_copy_pairs(bodies: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: every pair of different ids of at least ``threshold``, copies included."""
    members, pairs = near_copies(bodies, threshold)
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    between = pairs.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).filter("x < y").select("x", "y")
    return between.unionByName(within).select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )
