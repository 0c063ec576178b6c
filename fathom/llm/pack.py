"""Problem 9: filling containers of fixed capacity with texts measured in tokens.

Minimum bin slack: each container takes the largest size left, then the multiset of remaining sizes that comes closest
to the capacity, found by a bitset subset-sum with backtracked counts. A found multiset is used as often as the counts
allow. Only histograms of sizes (at most ``capacity`` rows a window) reach a task; documents are matched to the planned
places by rank, in a join.

Defined results: null and empty texts have size 0 and lie in the first container of their window; a text longer than
the capacity fills whole containers and its rest is an item of its own; repeated ids are separate items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.tokenize import token_counts
from fathom.session import write_table

#: Documents per window; each window is filled by itself and leaves about one container partly empty.
WINDOW_ROWS = 25_000


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: how many})]: multisets that fill containers, covering every item of ``counts``."""
    left = {s: n for s, n in counts.items() if n > 0}
    planned = []
    while left:
        first = max(left)
        picked = {first: 1}
        room = capacity - first
        steps = []
        reached, full = 1, (1 << (room + 1)) - 1
        for size in sorted((s for s in left if s <= room), reverse=True):
            available = min(left[size] - (size == first), room // size)
            part = 1
            while available > 0 and not reached >> room & 1:
                take = min(part, available)
                steps.append((size, take, reached))
                reached |= reached << (size * take) & full
                available -= take
                part *= 2
            if reached >> room & 1:
                break
        at = reached.bit_length() - 1
        for size, take, before in reversed(steps):
            if not before >> at & 1:
                picked[size] = picked.get(size, 0) + take
                at -= size * take
        times = min(left[s] // n for s, n in picked.items())
        for s, n in picked.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        planned.append((times, picked))
    return planned


def _plan(capacity: int):
    def plan(histogram: pd.DataFrame) -> pd.DataFrame:
        counts = {int(s): int(n) for s, n in zip(histogram["size"], histogram["n"])}
        zeros = counts.pop(0, 0)
        used: dict[int, int] = {}
        rows = []
        container = 0
        for times, picked in fill(counts, capacity):
            for size, n in picked.items():
                rank = used.get(size, 0)
                rows.append((size, rank, rank + n * times, n, container))
                used[size] = rank + n * times
            container += times
        if zeros:
            rows.append((0, 0, zeros, zeros, 0))
        planned = pd.DataFrame(rows, columns=["size", "rank_from", "rank_to", "each", "container"])
        planned.insert(0, "window", histogram["window"].iloc[0])
        return planned

    return plan


def pack(sizes: DataFrame, capacity: int = 2048, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(doc_id, piece, token_from, size, container) for ``sizes(doc_id, n_tokens)``."""
    sizes = write_table(sizes.select("doc_id", "n_tokens"), "sizes")
    windows = max(1, -(-sizes.count() // window_rows))
    whole = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    pieces = sizes.select(
        "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")
    ).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("token_from"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.lit(windows)).alias("window"),
    )
    schema = "window long, size int, rank_from long, rank_to long, each long, container long"
    planned = (
        pieces.groupBy("window", "size").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("window").applyInPandas(_plan(capacity), schema)
    )
    places = planned.select(
        F.col("window").alias("in_window"), F.col("size").alias("of_size"), "rank_from", "each", "container",
        F.explode(F.sequence("rank_from", F.col("rank_to") - 1)).alias("place"),
    ).select(
        "in_window", "of_size", "place",
        (F.col("container") + F.floor((F.col("place") - F.col("rank_from")) / F.col("each"))).alias("container"),
    )
    ranked = pieces.withColumn(
        "rank", F.row_number().over(Window.partitionBy("window", "size").orderBy("doc_id", "piece")).cast("long") - 1
    )
    same = (F.col("window") == F.col("in_window")) & (F.col("size") == F.col("of_size")) & (F.col("rank") == F.col("place"))
    return ranked.join(places, same).select(
        "doc_id", "piece", "token_from", "size",
        (F.col("window") * F.lit(1 << 32) + F.col("container")).alias("container"),
    )


def pack_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str | None = None
) -> DataFrame:
    """Containers of ``capacity`` tokens for every document."""
    return pack(token_counts(docs, id_col, text_col, vocabulary), capacity)
