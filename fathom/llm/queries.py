"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from fathom.llm.cut_texts import cut_rates, cut_texts
from fathom.llm.foreign_files import foreign_files
from fathom.llm.near_copies import near_copies, near_copy_pairs
from fathom.llm.neighbours import graph_search, neighbour_graph, similar_pairs
from fathom.llm.pack import pack_corpus
from fathom.llm.pairs import defective_pairs
from fathom.llm.parsing import invalid_files, invalid_rates, parsed_files
from fathom.llm.secrets import find_secrets, redact
from fathom.llm.split import oversized, split_oversized
from fathom.llm.tokenize import decode_corpus, encode_corpus
from fathom.tables import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = foreign_files(read(spark, sf_dir, "artifacts"), read(spark, sf_dir, "upstream_files"))
    return found.select("repository", "file_path")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = foreign_files(read(spark, sf_dir, "artifacts"), read(spark, sf_dir, "upstream_files"))
    return found.groupBy("repository", "reason").agg(F.count(F.lit(1)).alias("files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(read(spark, sf_dir, "artifacts"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(read(spark, sf_dir, "artifacts"))


def p2_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unrecoverable error of every invalid file: its line and token."""
    return parsed_files(read(spark, sf_dir, "artifacts")).filter(F.col("error_line").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(read(spark, sf_dir, "user_history"), read(spark, sf_dir, "harness_traces"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "artifacts"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(read(spark, sf_dir, "artifacts"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "artifacts").filter(F.col("kind").endswith("-implementation"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_pairs(_bodies(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per id the least id with the same tokens, and the number of near-equal other texts that one has."""
    members, pairs = near_copies(_bodies(spark, sf_dir))
    ends = pairs.select(F.col("rep_a").alias("rep")).unionByName(pairs.select(F.col("rep_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(links, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(read(spark, sf_dir, "artifacts"))


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vec_id divisible by 50, its ten most similar others among all rows."""
    vectors, edges = neighbour_graph(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    queries = vectors.filter(F.col("id") % 50 == 0).select(F.col("v").alias("q"), "x")
    hits = graph_search(queries, vectors, edges, 64, k=11).filter("q <> v")
    names = vectors.select("v", "id")
    return (
        hits.join(names.select(F.col("v").alias("q"), F.col("id").alias("query_id")), "q")
        .join(names.select("v", F.col("id").alias("vec_id")), "v")
        .select("query_id", "vec_id", F.round("s", 4).alias("similarity"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(read(spark, sf_dir, "artifacts"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "artifacts"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read(spark, sf_dir, "documents"))


def p8_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, decoded from its ids again."""
    return decode_corpus(encode_corpus(read(spark, sf_dir, "documents")))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(read(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_texts(read(spark, sf_dir, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(read(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by how full they are, in tenths; none holds more than its capacity."""
    held = pack_corpus(read(spark, sf_dir, "documents")).groupBy("container").agg(F.sum("size").alias("held"))
    tenth = F.ceil(F.col("held") * 10 / 2048).cast("int").alias("tenth")
    return held.groupBy(tenth).agg(F.count(F.lit(1)).alias("containers"), F.max("held").alias("most"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        p1_found, p1_reasons, p2_found, p2_rates, p2_errors, p3_found, p4_found, p4_redacted, p5_found, p5_classes, p6_found, p6_search,
        p7_found, p7_pieces, p8_ids, p8_text, p9_containers, p9_fill, p10_found, p10_rates,
    )
}

_TRIPLES = """b AS (SELECT id, any_value(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM artifacts
  WHERE kind LIKE '%-implementation' AND text IS NOT NULL GROUP BY id),
s AS (SELECT id, t, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS x FROM b WHERE len(t) >= 3)"""
_COSINES = """v AS (SELECT id, any_value(embedding)::DOUBLE[] AS e FROM artifacts
  WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.id <> b.id)"""

#: SQL where it can say the same over whole tables; the other operators are tested by brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "p5_found": f"""WITH {_TRIPLES} SELECT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id
WHERE len(list_intersect(a.x, b.x)) >= 0.7 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x)))""",
    "p5_classes": f"""WITH {_TRIPLES}, r AS (SELECT min(id) AS rep, t, any_value(x) AS x FROM s GROUP BY t),
l AS (SELECT a.rep, count(*) AS links FROM r a JOIN r b ON a.rep <> b.rep
  WHERE len(list_intersect(a.x, b.x)) >= 0.7 * (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) GROUP BY a.rep)
SELECT s.id, r.rep, coalesce(l.links, 0) AS links FROM s JOIN r USING (t) LEFT JOIN l ON l.rep = r.rep""",
    "p6_found": f"""WITH {_COSINES}, k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k WHERE s >= 0.8""",
    "p7_found": "SELECT DISTINCT id FROM artifacts WHERE length(text) > 4000",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
