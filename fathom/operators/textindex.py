"""Which texts hold a term as a substring, without reading every text once per term.

A text is cut into runs of word characters and runs of other visible characters. A term lies in a text only if the term's
longest run lies within one of the text's; runs meet terms through the rarest three characters of that run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import text as T
from fathom.session import write_table

RUN = r"[a-z0-9_]+|[^a-z0-9_\s]+"

#: Where few rows meet many, the many of a key are split into so many parts by the id of the row.
SALTS = 16

#: In the stored index, a run is split into parts of so many texts.
SPLIT_ROWS = 50_000


def salted_join(few: DataFrame, many: DataFrame, key: str, by: str) -> DataFrame:
    """``few`` joined with ``many`` on ``key``; the rows of a frequent key are spread over SALTS tasks by ``by``."""
    spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")), [key, "_salt"]).drop("_salt")


def runs(texts: DataFrame) -> DataFrame:
    """(id, run): the distinct runs of ``texts(id, text)`` in lower case."""
    return texts.select("id", F.explode(F.array_distinct(T.all_matches(F.lower("text"), RUN))).alias("run"))


def split_runs(run_table: DataFrame) -> DataFrame:
    """(id, run, part, parts): ``run_table`` with runs of more than SPLIT_ROWS texts in several parts."""
    counted = run_table.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT_ROWS)
    hot = counted.select("run", F.ceil(F.col("n") / SPLIT_ROWS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    return run_table.join(hot, "run", "left").select("id", "run", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), parts.alias("parts"))


def _pieces(text: str, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))
    )


def grams(run_table: DataFrame) -> DataFrame:
    """(run, parts, gram): pieces of one to three characters of every distinct run of a split table."""
    return run_table.select("run", "parts").distinct().select(
        "run", "parts", F.explode(F.array_distinct(F.concat(*(_pieces("run", n) for n in (1, 2, 3))))).alias("gram")
    )


def containing(terms: DataFrame, run_table: DataFrame, gram_table: DataFrame) -> DataFrame:
    """(term, id, whole): texts whose runs hold the longest run of each of ``terms(term)``.

    ``whole`` says that the term is that run, so that the text holds it for sure; else the text itself must tell.
    """
    found = T.all_matches(F.col("term"), RUN)
    longest = F.get(F.sort_array(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False), F.lit(0))["x"]
    asked = terms.select("term").distinct().select("term", longest.alias("piece")).filter("piece is not null")
    keys = asked.select("piece").distinct().select(
        "piece", F.explode(F.when(F.length("piece") < 3, F.array("piece")).otherwise(F.array_distinct(_pieces("piece", 3)))).alias("gram")
    )
    counted = gram_table.join(keys.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = keys.join(counted, "gram", "left").groupBy("piece").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    holds = rarest.join(gram_table, "gram").filter(F.col("run").contains(F.col("piece"))).select(
        "piece", "run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    touched = holds.join(run_table, ["run", "part"]).select("piece", "id").distinct()
    return asked.join(touched, "piece").select("term", "id", (F.col("term") == F.col("piece")).alias("whole"))


def verified(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id) of the ``candidates(term, id, whole)`` whose text in ``texts(id, text)`` holds the term."""
    candidates = write_table(candidates, "candidates")
    open_ones = candidates.filter(~F.col("whole")).select("term", "id")
    return candidates.filter("whole").select("term", "id").unionByName(held_terms(open_ones, texts))


def held_terms(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id) of ``wanted(term, id)`` where the text of ``texts(id, text)`` holds the term in lower case.

    A text is read once for all of its terms: these are at most the distinct terms of a batch of requests.
    """
    of_text = wanted.groupBy("id").agg(F.collect_set("term").alias("terms"))
    lower = texts.select("id", F.lower("text").alias("text"))
    held = of_text.join(lower, "id").select("id", F.filter("terms", lambda t: F.col("text").contains(t)).alias("terms"))
    return held.select(F.explode("terms").alias("term"), "id")
