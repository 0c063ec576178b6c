"""Registered queries of the core and the SQL that checks them.

Requests are the rows of user_history whose id is divisible by 50 and whose query isn't null, each id once; they are
held against all artifacts. access_violations takes all requests, whatever their id.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fathom.functions import access, text as T
from fathom.operators import answers, evaluation, graph, scan, scoring, search, tables, textindex, vectors
from fathom.plans.oracle import ORACLE_SQL as ORACLE_SQL
from fathom.session import passing, shared_dir, stored, write_table
from fathom.sources import files, links, symbols
from fathom.streaming import requests as stream
from fathom.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Requests that are searched at once where all of the history are: a task's memory and the tables on disk grow with them.
BATCH = scan.PASS_REQUESTS // 2


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _requests(spark: SparkSession, d: str, step: int = 50) -> DataFrame:
    """Every ``step``-th request, with its user's tier."""
    rows = read(spark, d, "user_history").filter((F.col("id") % step == 0) & F.col("query").isNotNull())
    once = rows.groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("query", "user_id", "repo_scope")).alias("r"))
    users = once.select("qid", "r.query", "r.user_id", "r.repo_scope")
    return access.user_tiers(users, read(spark, d, "access_matrix"))


# Indexes: written once per session and state of the tables, and read by all queries.

FIELDS = ("repository", "file_path", "language", "text", "tier", "symbol_name", "line_start", "line_end", "kind", "metadata")


def _artifacts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``columns`` of the last delivery of each id."""
    once = stored(spark, d, "latest", lambda: search.latest(read(spark, d, "artifacts"), *FIELDS))
    return once.select("id", *columns)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "entries", lambda: scoring.entries(_artifacts(
        spark, d, "repository", "tier", "file_path", "kind", "line_start", "line_end", "symbol_name", "metadata", "text")))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).filter("kind <> 'chunk'")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "postings", lambda: search.postings(_index(spark, d)).sortWithinPartitions("token"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.whole_texts(_artifacts(spark, d, "file_path", "symbol_name", "kind", "text", "metadata"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "runs", lambda: textindex.split_runs(write_table(textindex.runs(_texts(spark, d)), "all-runs")))


def _grams(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "grams", lambda: textindex.grams(_runs(spark, d)))


def _text_vectors(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "text-vectors", lambda: vectors.row_vectors(_artifacts(spark, d, "text", "tier", "repository")))


def _by_repository(spark: SparkSession, d: str) -> DataFrame:
    """``_artifacts`` in order of repository, so that a task that scans them meets only the requests of few repositories."""
    return stored(spark, d, "by-repository", lambda: _artifacts(spark, d, *FIELDS).repartitionByRange(2 * spark.sparkContext.defaultParallelism, "repository", "id"))


def _vectors_by_repository(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "vectors-by-repository", lambda: vectors.row_vectors(_by_repository(spark, d).select("id", "text", "tier", "repository")))


def _near(spark: SparkSession, d: str) -> DataFrame:
    nodes = _entries(spark, d).select("id", "repository", "tier")
    return stored(spark, d, "near", lambda: graph.placed(graph.adjacency(graph.clean_edges(read(spark, d, "edges"))), nodes))


def build_indexes(spark: SparkSession, d: str) -> None:
    """Writes all indexes of the tables in ``d``, so that the first search doesn't have to."""
    for index in (_entries, _postings, _text_vectors, _near):
        index(spark, d)


class _Search:
    """The searches of one batch of requests: each step is computed once per query, whichever of the others need it.

    Given ``requests`` are many: these are held against artifacts in order of repository.
    """

    def __init__(self, spark: SparkSession, d: str, requests: DataFrame | None = None):
        self.spark, self.d, self.requests = spark, d, requests

    @cached_property
    def asked(self) -> DataFrame:
        requests = _requests(self.spark, self.d) if self.requests is None else self.requests
        return write_table(requests, "requests")

    @cached_property
    def entries(self) -> DataFrame:
        return _entries(self.spark, self.d)

    @cached_property
    def held(self) -> DataFrame:
        """(term, id): the requests' terms within artifacts."""
        terms = scoring.items(self.asked).select(F.col("item").alias("term"))
        found = textindex.containing(terms, _runs(self.spark, self.d), _grams(self.spark, self.d))
        return write_table(textindex.verified(found, _texts(self.spark, self.d)), "held-terms")

    @property
    def rows(self) -> DataFrame:
        return _artifacts(self.spark, self.d, *FIELDS) if self.requests is None else _by_repository(self.spark, self.d)

    def lexical(self, limit: int = 50, terms: DataFrame | None = None) -> DataFrame:
        return search.lexical_index_search(self.asked, _index(self.spark, self.d), limit, _postings(self.spark, self.d), terms)

    @cached_property
    def text_hits(self) -> DataFrame:
        rows = _artifacts(self.spark, self.d, "repository", "tier", "file_path", "symbol_name", "kind", "text")
        return search.text_hits(self.asked, rows, self.held)

    @cached_property
    def composite(self) -> DataFrame:
        """The best fifty by index or text. Of the text hits only the best fifty can be among them; whether the others are text hits is asked at the end."""
        longest = write_table(search.longest_terms(self.asked, 8), "longest-terms")
        asked = write_table(scan.text_requests(self.asked, longest, 3), "text-requests")
        texts = search.best_text_hits(asked, self.rows, 50)
        union = write_table(search.lexical_union(self.lexical(300, longest.select("qid", "term")), texts), "composite")
        also = search.are_text_hits(asked, union.filter("not by_text").select("qid", "id"), self.rows).withColumn("also", F.lit(True))
        marked = union.join(also, ["qid", "id"], "left").withColumn("by_text", F.col("by_text") | F.coalesce("also", F.lit(False)))
        return write_table(marked.select(union.columns), "composite")

    @cached_property
    def all_named(self) -> DataFrame:
        return write_table(self.named(), "named")

    def named(self, asked: DataFrame | None = None) -> DataFrame:
        asked = self.asked if asked is None else asked
        classes = write_table(asked.select(F.explode(search.named_classes(F.col("query"))).alias("term")).select(F.lower("term").alias("term")).distinct(), "classes")
        held = None
        if not classes.isEmpty():
            held = write_table(scan.holding(classes, _artifacts(self.spark, self.d, "text")), "held-classes")
        rows = _artifacts(self.spark, self.d, "repository", "file_path", "kind", "tier", "line_start", "text")
        return search.file_name_search(asked, rows, held)

    @cached_property
    def paths(self) -> DataFrame:
        """The first two visible artifacts of each of a request's best twenty paths."""
        return write_table(search.rows_of_files(search.path_search(self.asked, self.entries, 20), self.entries, self.asked), "path-rows")

    def vector(self, k: int = 20) -> DataFrame:
        queries = vectors.hashed_vectors(self.asked, "qid", "query").join(self.asked.select("qid", "user_tier", "repo_scope"), "qid")
        rows = (_text_vectors if self.requests is None else _vectors_by_repository)(self.spark, self.d)
        return vectors.nearest(queries, rows, 128, k, sparse=True, access=True)

    @cached_property
    def closest(self) -> DataFrame:
        return write_table(self.vector(80).select("qid", "id", "score", "rank"), "vector-hits")

    @cached_property
    def rescored(self) -> DataFrame:
        hits = self.closest.select("qid", "id", "score")
        points = scoring.scores_of_pairs(self.asked, hits, self.rows)
        scored = hits.join(points, ["qid", "id"]).select("qid", "id", F.round(F.col("score") + F.col("points"), 6).alias("score"))
        return write_table(search.top(scored, ["qid"], [F.desc("score"), F.col("id")], 20), "vector-rescored")

    @cached_property
    def anchors(self) -> DataFrame:
        """(qid, id, rank): visible artifacts that hold any term of a request, by score; the three closest where none does."""
        found = write_table(scoring.best_scored(self.asked, self.rows, 50).select("qid", "id", "rank"), "anchors")
        # only requests without an anchor, but with something to see, need the closest artifacts
        repositories = self.entries.groupBy("repository").agg(F.min("tier").alias("tier"))
        lacking = self.asked.join(found.select("qid").distinct(), "qid", "left_anti")
        seeing = lacking.join(repositories, (F.col("tier") <= F.col("user_tier")) & access.in_scope(F.col("repository"), F.col("repo_scope")), "left_semi")
        if "rescored" not in self.__dict__ and seeing.isEmpty():
            return found
        closest = self.rescored.filter("rank <= 3").join(found.select("qid").distinct(), "qid", "left_anti")
        return found.unionByName(closest.select("qid", "id", "rank"))

    @cached_property
    def graph(self) -> DataFrame:
        return graph.walk(self.anchors, _near(self.spark, self.d), 3, 50, self.asked)

    @cached_property
    def hybrid(self) -> DataFrame:
        named = self.all_named.withColumn(
            "rank", F.row_number().over(Window.partitionBy("qid").orderBy("file_path", "rank", "id"))
        ).select("qid", "id", "rank")
        graph_hits = self.graph.select("qid", "id", F.col("position").alias("rank"))
        return search.fuse(named, self.rescored.select("qid", "id", "rank"), graph_hits)

    @cached_property
    def reranked(self) -> DataFrame:
        """The hits of the composite search, of named files and of paths, scored again; the best eight of each request."""
        no, yes = F.lit(False), F.lit(True)
        flags = ("by_lexical", "by_text", "by_name", "by_path")

        def marked(rows: DataFrame, score: F.Column, *marks: F.Column) -> DataFrame:
            return rows.select("qid", "id", score.alias("score"), *(m.alias(f) for m, f in zip(marks, flags)))

        by_text = F.col("by_text")
        hits = (
            marked(self.composite, F.col("score"), yes, by_text, no, no)
            .unionByName(marked(self.all_named, F.lit(1.0), no, by_text, ~by_text, no))
            .unionByName(marked(self.paths, F.lit(0.0), no, no, no, yes))
            .groupBy("qid", "id").agg(F.max("score").alias("score"), *(F.max(f).alias(f) for f in flags))
        )
        return scoring.diverse(scoring.rerank_scores(hits, self.asked, _artifacts(self.spark, self.d, "text"), self.entries), 8)


# --- scans, predicates, functions ---


@registered
def scoped_scan(spark, d):
    """Rows of tier 2 or below in the repositories that some group may see."""
    seen = access.visible(read(spark, d, "artifacts"), 2, None)
    scopes = read(spark, d, "group_scopes").select("repository").distinct()
    rows = seen.join(scopes, "repository", "left_semi")
    return rows.groupBy("repository", "tier").agg(F.countDistinct("id").alias("artifacts"), F.min("file_path").alias("first_path"))


@registered
def index_decisions(spark, d):
    """How many artifacts of each language are indexed, or left out for which reason."""
    reasons = files.index_decisions(_artifacts(spark, d, "file_path", "text"))
    kinds = _artifacts(spark, d, "language")
    return reasons.join(kinds, "id").groupBy("language", "reason").agg(F.count(F.lit(1)).alias("files"))


@registered
def file_languages(spark, d):
    """Language by file name, and what the rows say."""
    rows = read(spark, d, "artifacts").select(files.language_of(F.col("file_path")).alias("detected"), "language", "id").distinct()
    return rows.groupBy("detected", "language").agg(F.count(F.lit(1)).alias("artifacts"))


@registered
def token_stats(spark, d):
    """Every token's number of texts."""
    words = _artifacts(spark, d, "text").select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("texts"))


@registered
def identifier_parts(spark, d):
    """Parts, normal form and stem of every symbol name."""
    names = read(spark, d, "artifacts").filter("symbol_name is not null").select("symbol_name").distinct()
    name = F.col("symbol_name")
    return names.select(
        "symbol_name", F.array_join(T.index_tokens(name), " ").alias("parts"), T.normalise_identifier(name).alias("normal"),
        T.light_stem(F.lower(name)).alias("stem"), T.light_stem_rerank(F.lower(name)).alias("rerank_stem"),
    )


@registered
def related_words(spark, d):
    """Words of a query that are related to words of a path, by stems: counts per query."""
    words = _requests(spark, d).select("qid", F.explode(T.query_terms(F.col("query"))).alias("term")).distinct()
    pieces = read(spark, d, "artifacts").select(F.explode(F.split(F.lower("file_path"), "[^a-z0-9]+")).alias("piece")).distinct()
    key = lambda c: F.left(T.light_stem(F.col(c)), F.lit(5))
    pairs = words.withColumn("k", key("term")).join(pieces.withColumn("k", key("piece")), "k")
    return pairs.filter(T.related(F.col("term"), F.col("piece"))).groupBy("qid").agg(F.count(F.lit(1)).alias("related"))


@registered
def query_terms(spark, d):
    """Terms, literals and path-like terms of every distinct query of the history."""
    q = read(spark, d, "user_history").filter("query is not null").select("query").distinct()
    join = lambda c: F.array_join(c, "|")
    return q.select(
        "query", join(T.query_terms(F.col("query"))).alias("terms"), join(T.query_literals(F.col("query"))).alias("literals"),
        join(T.path_like_terms(F.col("query"))).alias("paths"), T.squeeze(F.col("query")).alias("squeezed"),
    )


@registered
def joined_terms(spark, d):
    """Each user's distinct engines as a phrase."""
    rows = read(spark, d, "user_history").filter("inference_engine_used is not null")
    engines = rows.groupBy("user_id").agg(F.array_sort(F.collect_set("inference_engine_used")).alias("engines"))
    return engines.select("user_id", T.join_terms(F.col("engines")).alias("phrase"))


@registered
def sliding_chunks(spark, d):
    """Overlapping chunks of the texts of documents, with their lines and a digest."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return files.sliding_chunks(docs).select("id", "start", "line_start", "line_end", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@registered
def text_heads(spark, d):
    """What is indexed of text files: their first 4,000 characters."""
    rows = _artifacts(spark, d, "language", "kind", "text").filter("language like 'text%' and kind = 'chunk'")
    return files.text_heads(rows).select("id", "line_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@registered
def sniffed_languages(spark, d):
    """Languages by name and content, as if half of the files were headers, and half of the others had no extension."""
    rows = _artifacts(spark, d, "file_path", "text").select("id", "text", F.regexp_replace("file_path", r"\.(cpp|py)$", ".h").alias("p"))
    renamed = rows.withColumn("p", F.regexp_replace("p", r"\.json$", ""))
    return renamed.groupBy(files.sniffed_language(F.col("p"), F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("artifacts"))


@registered
def artifact_ids(spark, d):
    """Artifacts by kind whose id is what their fields give."""
    rows = _artifacts(spark, d, "repository", "file_path", "kind", "symbol_name", "metadata", "tier")
    symbol = F.when(F.col("kind") == "module", "module").otherwise(F.coalesce(F.col("metadata")["qualified_name"], "symbol_name", F.lit("chunk-1")))
    same = T.artifact_id(F.col("repository"), F.col("file_path"), symbol, F.col("tier")) == F.col("id")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("artifacts"), F.count_if(same).alias("derived"))


@registered
def json_leaves(spark, d):
    """Keys and values of the events' properties."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    return files.json_leaves(rows, "props").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total")
    )


def _json_leaves(spark: SparkSession, d: str) -> DataFrame:
    rows = _artifacts(spark, d, "language", "text").filter("language = 'json' and text is not null").select("id", "text")
    return files.json_tree_leaves(rows)


@registered
def json_documents(spark, d):
    """Leaves of the JSON documents, at whatever depth, with their path."""
    return _json_leaves(spark, d).select("id", F.regexp_replace("path", r"^\$\.?", "").alias("path"), "value", (F.col("type") == "STRING").alias("is_text"))


@registered
def schema_documents(spark, d):
    """JSON documents that are schemas, and where the schema of each may lie."""
    rows = _artifacts(spark, d, "file_path", "kind", "text").filter("kind = 'json-document' and text is not null")
    return rows.select("id", links.is_schema(F.try_parse_json("text")).alias("is_schema"), F.array_join(links.candidate_schema_paths(F.col("file_path")), "|").alias("candidates"))


@registered
def cross_file_edges(spark, d):
    """Links of the JSON documents to their schemas and to the files that they name."""
    return links.cross_file_edges(_artifacts(spark, d, "repository", "file_path", "kind", "tier", "text"), _json_leaves(spark, d))


@registered
def markdown_cells(spark, d):
    """Cells of the pipe tables within artifacts."""
    rows = _artifacts(spark, d, "text").filter("text is not null")
    return files.markdown_cells(rows)


@registered
def symbol_definitions(spark, d):
    """Definitions of source files by kind, found by patterns."""
    rows = _artifacts(spark, d, "kind", "language", "text").filter("kind in ('module', 'chunk') and text is not null").select("id", "language", "text")
    found = symbols.definitions(rows).join(rows.select("id", "language"), "id")
    return found.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("definitions"), F.countDistinct("name").alias("names"))


# --- tables ---


@registered
def upsert_latest(spark, d):
    """A table of all artifacts as first written, after the deliveries of tier 2 and above: rows and times per repository."""
    rows = read(spark, d, "artifacts").select("id", "repository", "tier", "updated_at")
    current = rows.groupBy("id").agg(F.min("repository").alias("repository"), F.min("tier").alias("tier")).withColumn("updated_at", F.lit(0.0))
    return tables.upsert(current, rows.filter("tier >= 2"), "id", "updated_at").groupBy("repository").agg(
        F.count(F.lit(1)).alias("artifacts"), F.round(F.sum("updated_at"), 0).alias("total_time")
    )


@registered
def tier_upserts(spark, d):
    """The users' tiers after each trace's tier was set, the latest last."""
    traces = read(spark, d, "harness_traces").filter("access_tier is not null").groupBy("user_id", "trace_id").agg(F.max(F.struct("created_at", "access_tier")).alias("t"))
    incoming = traces.select("user_id", F.col("t.access_tier").alias("tier"), F.struct("t.created_at", "trace_id").alias("at"))
    current = read(spark, d, "access_matrix").select("user_id", "tier", F.lit(None).cast(incoming.schema["at"].dataType).alias("at"))
    return tables.upsert(current, incoming, "user_id", "at").select("user_id", "tier")


@registered
def scope_grants(spark, d):
    """The groups' scopes after every tier was granted the repositories of its traces; what is there already changes nothing."""
    grants = read(spark, d, "harness_traces").select(F.coalesce("access_tier", F.lit("none")).alias("group_name"), F.explode("repo_scopes").alias("repository"))
    current = read(spark, d, "group_scopes")
    return tables.insert_missing(current, grants).groupBy("group_name").agg(F.count(F.lit(1)).alias("repositories"), F.min("repository").alias("first"))


@registered
def edge_upserts(spark, d):
    """The edges after their second delivery: a set, by relationship."""
    edges = read(spark, d, "edges")
    return tables.insert_missing(edges.distinct(), edges).groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"))


@registered
def delete_repository(spark, d):
    """What is left of the graph without its largest repository's artifacts."""
    rows = read(spark, d, "artifacts").select("id", "repository").distinct()
    sizes = rows.groupBy("repository").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.orderBy(F.desc("n"), "repository").first()["repository"]
    kept, links = tables.delete_repository(rows, graph.clean_edges(read(spark, d, "edges")), largest)
    left = kept.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("artifacts").alias("what"), "n")
    return left.unionByName(links.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("what"), "n"))


@registered
def index_stats(spark, d):
    return tables.index_stats(read(spark, d, "artifacts"))


@registered
def repository_fingerprints(spark, d):
    return tables.fingerprints(_artifacts(spark, d, "repository", "text"))


@registered
def schema_migration(spark, d):
    """The history under its old column name, with the new column filled where it was null."""
    old = read(spark, d, "user_history").withColumnRenamed("inference_engine_used", "engine")
    new = old.withColumn("inference_engine_used", F.coalesce("engine", F.lit("unknown"))).drop("engine")
    return new.groupBy("inference_engine_used").agg(F.countDistinct("id").alias("answers"))


# --- access, audit, history ---


@registered
def user_tiers(spark, d):
    """Requests per tier; unknown users have the lowest."""
    users = read(spark, d, "harness_traces").select("user_id", "trace_id").distinct()
    return access.user_tiers(users, read(spark, d, "access_matrix")).groupBy("user_tier").agg(F.count(F.lit(1)).alias("requests"))


@registered
def allowed_scopes(spark, d):
    """The repositories each group may see."""
    groups = read(spark, d, "group_scopes")
    members = groups.select(F.col("group_name").alias("subject"), "group_name").distinct()
    return access.allowed_scopes(members, groups).select("subject", F.array_join("scopes", ",").alias("scopes"))


@registered
def last_turns(spark, d):
    """The last four answers of each user, the newest first."""
    rows = read(spark, d, "user_history").select("id", "user_id").distinct()
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    return rows.withColumn("turn", n).filter("turn <= 4").select("user_id", "id", "turn")


@registered
def audit_rollup(spark, d):
    """Requests, hits and latency by day and tier, with totals."""
    rows = read(spark, d, "audit_log").dropDuplicates(["id"]).withColumn("day", F.date_format(F.timestamp_seconds(F.floor("created_at")), "yyyy-MM-dd"))
    tier = F.coalesce("access_tier", F.lit("none")).alias("tier")
    return rows.select("day", tier, "cache_hit", "latency_ms").rollup("day", "tier").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("cache_hit").alias("hits"), F.sum(F.round(F.col("latency_ms") * 1000).cast("long")).alias("total_us")
    )


@registered
def latency_percentiles(spark, d):
    """Exact latency percentiles per engine."""
    rows = read(spark, d, "audit_log").dropDuplicates(["id"]).filter("latency_ms is not null")
    p = lambda q: F.round(F.percentile("latency_ms", F.lit(q)), 4)
    return rows.groupBy(F.coalesce("inference_engine_used", F.lit("none")).alias("engine")).agg(
        p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.sum(F.round(F.col("latency_ms") * 1000).cast("long")).alias("total_us")
    )


@registered
def cache_keys(spark, d):
    """The cache key of every trace, and how many traces share it."""
    rows = read(spark, d, "harness_traces").filter("query is not null").dropDuplicates(["trace_id"])
    key = answers.cache_key("v1", F.col("query"), F.coalesce("access_tier", F.lit("T-1")), F.coalesce("repo_scopes", F.array().cast("array<string>")), "answer", F.col("model_id"), F.lit("index"))
    return rows.select("trace_id", key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("traces"))


def _audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The audit table as a stream, whether it is one file or a folder of files."""
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/audit_log.parquet")
    folder = table.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(table).isDirectory()
    return stream.audit_stream(spark, f"{d}/audit_log.parquet" if folder else d, "*.parquet" if folder else "audit_log.parquet")


def _stream_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@registered
def audit_windows_stream(spark, d):
    """Hourly windows of the audit log, by a stream that is run over what there is."""
    return stream.run_available(stream.audit_windows(_audit_stream(spark, d)), _stream_dir(spark))


@registered
def audit_once_stream(spark, d):
    """Requests per tier, repeated deliveries left out by the stream."""
    once = stream.once_each(_audit_stream(spark, d).withColumn("access_tier", F.coalesce("access_tier", F.lit("none"))))
    kept = stream.run_available(once.select("id", "access_tier"), _stream_dir(spark), "append")
    return kept.groupBy("access_tier").agg(F.count(F.lit(1)).alias("requests"))


@registered
def audit_append_stream(spark, d):
    """The audit log appended to a table by day."""
    table = stream.append_history(_audit_stream(spark, d), _stream_dir(spark))
    return table.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("cache_hit").alias("hits"))


@registered
def policy_decisions(spark, d):
    """Whether each trace's answer would be kept."""
    rows = read(spark, d, "harness_traces").dropDuplicates(["trace_id"])
    return answers.decisions(rows).groupBy("decision").agg(F.count(F.lit(1)).alias("traces"))


@registered
def policy_applied(spark, d):
    """Every trace's answer after the policy: where it comes from, its flags, and a digest of what is left of it."""
    rows = read(spark, d, "harness_traces").dropDuplicates(["trace_id"])
    return answers.applied_policy(rows).select("trace_id", "source", F.array_join("flags", ",").alias("flags"), F.md5(F.col("response").cast("binary")).alias("digest"))


@registered
def cached_answers(spark, d):
    """Distinct responses of the history that may be given again, cleaned."""
    rows = read(spark, d, "user_history").filter("response is not null").select("response").distinct()
    return rows.select(F.md5(F.col("response").cast("binary")).alias("given"), F.md5(answers.sanitised(F.col("response")).cast("binary")).alias("kept"))


@registered
def behaviour_phrases(spark, d):
    """What the names of symbols say that they do."""
    names = read(spark, d, "artifacts").filter("symbol_name is not null").select("symbol_name").distinct()
    return names.select("symbol_name", answers.behaviour_phrase(F.col("symbol_name")).alias("phrase"))


# --- search ---


@registered
def lexical_search(spark, d):
    """The best fifty artifacts of each request in the inverted index."""
    return _Search(spark, d).lexical()


@registered
def text_scan(spark, d):
    """Artifacts whose text holds one of the three longest terms of a request, with ten points for each of its eight longest."""
    return _Search(spark, d).text_hits


@registered
def composite_search(spark, d):
    """The best fifty artifacts of each request, by the index or by their text, whichever gives more."""
    return _Search(spark, d).composite


@registered
def path_search(spark, d):
    """The best twenty paths of each request."""
    return search.path_search(_requests(spark, d), read(spark, d, "artifacts"), 20)


@registered
def path_rows(spark, d):
    return _Search(spark, d).paths


@registered
def file_name_search(spark, d):
    """Artifacts of the files and classes that queries name, for every query of the history."""
    rows = read(spark, d, "user_history").filter("query is not null")
    once = rows.groupBy(F.col("id").alias("qid")).agg(F.min(F.struct("query", "user_id")).alias("r"))
    asked = access.user_tiers(once.select("qid", "r.query", "r.user_id", F.lit(None).cast("array<string>").alias("repo_scope")), read(spark, d, "access_matrix"))
    return _Search(spark, d).named(write_table(asked, "asked"))


@registered
def hash_embedding(spark, d):
    """Hashed embeddings of all artifacts: the non-zero buckets and their weights."""
    return _text_vectors(spark, d).select("id", F.array_join("buckets", ",").alias("buckets"), F.array_join("weights", ",").alias("weights"))


@registered
def vector_search(spark, d):
    """The twenty visible artifacts whose hashed embeddings are closest to each request's."""
    return _Search(spark, d).vector().select("qid", "id", "rank", "score")


@registered
def vector_rescored(spark, d):
    """The eighty closest visible artifacts of each request with points for its terms, literals and paths: the best twenty."""
    return _Search(spark, d).rescored


@registered
def dense_nearest(spark, d):
    """The ten vectors most similar to every vec_id divisible by 50, exactly."""
    e = read(spark, d, "embeddings").filter(F.size("embedding") == 64)
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = vectors.nearest(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 64, 10, sparse=False, id_type="long")
    return found.select("qid", "id", "rank", "score")


@registered
def label_votes(spark, d):
    """How often the ten most similar others of a vector share its label."""
    e = read(spark, d, "embeddings").filter(F.size("embedding") == 64)
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    found = vectors.nearest(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 64, 11, sparse=False, id_type="long")
    labels = e.select("vec_id", "label")
    joined = (
        found.filter("qid <> id").join(labels.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
        .join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    )
    return joined.groupBy("qid").agg(F.count_if(F.col("own") == F.col("label")).alias("same"), F.count(F.lit(1)).alias("others"))


# --- graph ---


@registered
def edges_clean(spark, d):
    """Edges by relationship: rows, distinct ones, and those with both ends among the artifacts."""
    rows = read(spark, d, "edges")
    clean = graph.clean_edges(rows)
    inner = graph.induced(clean, read(spark, d, "artifacts").select("id").distinct())
    n = lambda df, name: df.groupBy("relationship").agg(F.count(F.lit(1)).alias(name))
    return n(rows, "given").join(n(clean, "distinct_edges"), "relationship").join(n(inner, "induced_edges"), "relationship", "left").select(
        "relationship", "given", "distinct_edges", F.coalesce("induced_edges", F.lit(0)).alias("induced_edges")
    )


@registered
def neighbours(spark, d):
    """Each node's neighbours with the relationship that a walk prefers: counts by priority."""
    near = graph.adjacency(graph.clean_edges(read(spark, d, "edges")))
    return near.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"), F.min("priority").alias("best"), F.min("neighbour").alias("first"))


@registered
def graph_search(spark, d):
    """Breadth-first walks of depth three from each request's anchors, over what its user may see."""
    return _Search(spark, d).graph


@registered
def graph_walk(spark, d):
    """The same walk from each request's two best artifacts of the index, so that it goes beyond its anchors."""
    q = _Search(spark, d)
    return graph.walk(q.lexical(2).select("qid", "id", "rank"), _near(spark, d), 3, 50, q.asked)


@registered
def access_violations(spark, d):
    """Hits of each search above the user's tier or outside the request's scope: none. Every request of the history is searched."""
    names = ("lexical", "composite", "named", "paths", "vector", "rescored", "graph", "hybrid", "rerank")
    every = write_table(_requests(spark, d, 1), "requests")
    blocks = max(1, -(-every.count() // BATCH))
    totals = {name: (0, 0) for name in names}
    for b in range(blocks):
        # another hash than that of the searches' own blocks, which would be uneven otherwise
        q = _Search(spark, d, every.filter(F.pmod(F.hash("qid"), F.lit(blocks)) == b))
        # tables of a batch go with it; its hits are counted one by one, so that not all their shuffles stand at once
        with passing(spark):
            hits = (q.lexical(), q.composite, q.all_named, q.paths, q.closest.filter("rank <= 20"), q.rescored, q.graph, q.hybrid, q.reranked)
            for name, found in zip(names, hits):
                counted = _violations(q, found).first()
                totals[name] = totals[name][0] + counted.above_tier, totals[name][1] + counted.out_of_scope
    return spark.createDataFrame([(name, *n) for name, n in totals.items()], "search string, above_tier long, out_of_scope long")


def _violations(q: _Search, hits: DataFrame) -> DataFrame:
    """(above_tier, out_of_scope): how many ``hits(qid, id)`` the requests of ``q`` may not see."""
    seen = hits.select("qid", "id").join(q.entries.select("id", "tier", "repository"), "id").join(q.asked.select("qid", "user_tier", "repo_scope"), "qid")
    above, outside = F.col("tier") > F.col("user_tier"), ~access.in_scope(F.col("repository"), F.col("repo_scope"))
    return seen.agg(F.count_if(above).alias("above_tier"), F.count_if(outside).alias("out_of_scope"))


@registered
def listed_edges(spark, d):
    """Per user tier and relationship the distinct edges of which a user of that tier sees both ends."""
    nodes = _entries(spark, d).select("id", "tier")
    clean = graph.clean_edges(read(spark, d, "edges"))
    placed = clean.join(nodes.select(F.col("id").alias("source_id"), F.col("tier").alias("a")), "source_id").join(
        nodes.select(F.col("id").alias("target_id"), F.col("tier").alias("b")), "target_id"
    )
    return placed.select("relationship", F.explode(F.sequence(F.greatest("a", "b"), F.lit(3))).alias("user_tier")).groupBy("user_tier", "relationship").agg(
        F.count(F.lit(1)).alias("edges")
    )


@registered
def call_edges(spark, d):
    """Calls within files, resolved to the only symbol of the name."""
    return graph.call_edges(_artifacts(spark, d, "repository", "file_path", "kind", "symbol_name", "metadata", "text"))


@registered
def degree_centrality(spark, d):
    return graph.degrees(graph.clean_edges(read(spark, d, "edges")))


@registered
def central_nodes(spark, d):
    """Betweenness of all nodes over all shortest paths, and whether a node is in the highest tenth."""
    edges = graph.clean_edges(read(spark, d, "edges"))
    nodes = graph.degrees(edges).select(F.col("id").alias("pivot"))
    return graph.central(graph.betweenness(edges, nodes).select("id", F.round("score", 6).alias("score")))


@registered
def resolve_symbols(spark, d):
    """Back-quoted names of requests, resolved where one artifact of a repository bears the name."""
    rows = read(spark, d, "user_history").filter("query is not null").select("query", "repo_scope").distinct()
    refs = (
        rows.select(T.query_literals(F.col("query")).alias("names"), "repo_scope")
        .select(F.explode("names").alias("name"), "repo_scope").select("name", F.explode("repo_scope").alias("repository")).distinct()
        .withColumn("ref", F.concat_ws(":", "repository", "name"))
    )
    named = read(spark, d, "artifacts").filter("symbol_name is not null and kind like '%-implementation'").select("id", "repository", "symbol_name").distinct()
    return graph.resolve_references(refs, named)


# --- fusion, re-ranking, answers ---


@registered
def hybrid_search(spark, d):
    """File-name, vector and graph hits of each request in one order of twenty."""
    return _Search(spark, d).hybrid


@registered
def rerank(spark, d):
    """The best eight hits of each request by symbol, path, literals, owner and source; one per file and name first."""
    return _Search(spark, d).reranked


@registered
def merge_by_file(spark, d):
    """The lexical hits of each request, one row per file."""
    hits = _Search(spark, d).lexical()
    fields = _artifacts(spark, d, "symbol_name", "line_start", "line_end")
    return answers.merge_by_file(hits.join(fields, "id"))


@registered
def u_shape(spark, d):
    """The lexical hits of each request with the best at both ends."""
    hits = _Search(spark, d).lexical()
    return answers.u_shape(hits.select("qid", "id", "rank")).select("qid", "id", "rank", "place")


@registered
def summaries(spark, d):
    """One line on every artifact."""
    return answers.summaries(_artifacts(spark, d, "symbol_name", "file_path", "kind", "language", "line_start", "line_end", "text"))


@registered
def prompts(spark, d):
    """Prompts of the requests from their eight best artifacts."""
    hits = _Search(spark, d).lexical(8)
    return answers.prompts(hits.select("qid", "id", "rank"), answers.summaries(_artifacts(spark, d, "symbol_name", "file_path", "kind", "language", "line_start", "line_end", "text")), _requests(spark, d))


@registered
def fallback_answers(spark, d):
    """Answers without a model, from each request's best artifacts."""
    return answers.fallback_answers(_Search(spark, d).reranked, answers.summaries(_artifacts(spark, d, "symbol_name", "file_path", "kind", "language", "line_start", "line_end", "text")), _requests(spark, d))


@registered
def blended_rescoring(spark, d):
    """The re-ranked hits again: 0.4 of the hashed cosine and 0.6 of the re-ranker's points, up to 20 of them."""
    q = _Search(spark, d)
    hits = q.reranked
    words = vectors.hashed_weights(q.asked, "qid", "query")
    lengths = words.groupBy("qid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("m"))
    texts = _text_vectors(spark, d).join(hits.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.arrays_zip("buckets", "weights")).alias("w"))
    each = texts.select("id", F.col("w.buckets").alias("bucket"), F.col("w.weights").alias("x"))
    norms = each.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    dots = hits.select("qid", "id").join(each, "id").join(words, ["qid", "bucket"]).groupBy("qid", "id").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    cosine = F.coalesce(F.col("dot") / (F.col("n") * F.col("m")), F.lit(0.0))
    blend = F.round(0.4 * cosine + 0.6 * F.least(F.col("rerank_score") / 20, F.lit(1.0)), 6)
    scored = hits.join(dots, ["qid", "id"], "left").join(norms, "id", "left").join(lengths, "qid", "left").select("qid", "id", "file_path", blend.alias("score"))
    return search.top(scored, ["qid"], [F.desc("score"), F.desc("file_path"), F.col("id")], 8)


@registered
def refusal_scores(spark, d):
    """Traces whose response refuses without giving anything away."""
    rows = read(spark, d, "harness_traces").groupBy("trace_id").agg(F.min("response").alias("response"))
    return rows.select("trace_id", evaluation.refusal_score(F.col("response")).alias("score"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """The traces as cases, written as JSON lines and read again: literals of the query are expected, retrieved ids forbidden."""
    rows = read(spark, d, "harness_traces").groupBy("trace_id").agg(F.min(F.struct("query", "response", "model_id", "retrieval_ids")).alias("r"))
    flags = answers.quality_flags(F.col("r.response"))
    cases = rows.select(
        F.col("trace_id").alias("id"), F.when(F.array_contains(flags, "empty"), "thin-evidence").otherwise("useful-answer").alias("category"), F.col("r.query").alias("query"),
        F.col("r.model_id").alias("language"), F.coalesce("r.response", F.lit("")).alias("model_output"), F.array().cast("array<string>").alias("summaries"),
        T.all_matches(F.col("r.query"), "`([^`]+)`", 1).alias("expected_contains"), F.col("r.retrieval_ids").alias("forbidden"),
    )
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    cases.write.json(path)
    read_back = evaluation.load_cases(spark, path)
    return read_back.select("id", "category", F.coalesce("language", F.lit("none")).alias("model"), evaluation.failures(
        F.col("category"), F.col("model_output"), F.col("expected_contains"), F.col("forbidden")).alias("failures"))


@registered
def case_grades(spark, d):
    """Why the traces' responses fail as answers to their queries."""
    return _graded(spark, d).select("id", "category", F.array_join("failures", "|").alias("failures"))


@registered
def eval_report(spark, d):
    """Pass rates per model as lines of a table; a model without cases passes."""
    graded = _graded(spark, d)
    models = graded.select("model").unionByName(spark.createDataFrame([("no cases",)], "model string")).distinct()
    return evaluation.report_lines(evaluation.pass_rates(graded, models, "model"), "model")


@registered
def markdown_questions(spark, d):
    """Queries that name files under src/, as a question list in Markdown and read from it again."""
    rows = read(spark, d, "user_history").filter("query is not null").groupBy(F.col("id").alias("qid")).agg(F.min("query").alias("query"))
    asked = rows.select("qid", "query", (F.col("qid") % 10).alias("n"))
    entry = F.concat(F.lit("### Q"), F.col("qid").cast("string"), F.lit("\n**Query**: "), F.regexp_replace(F.trim("query"), r"\*\*", ""), F.lit("\n**Expected**: `src/"), F.col("qid").cast("string"), F.lit(".py`\n**Hops**: one\n"))
    parts = asked.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("qid", entry.alias("e")))), lambda x: x["e"]), "\n").alias("body"))
    lists = parts.select(F.col("n").cast("string").alias("path"), F.concat(F.lit("# List\n\n## Seed 1\n"), "body").alias("text"))
    found = evaluation.load_questions(lists)
    return found.select("path", "seed", F.array_join("expected", ",").alias("expected"), "difficulty", "hops", F.md5(T.squeeze(F.col("query"))).alias("digest"))


@registered
def quality_flags(spark, d):
    """Flags of every trace's response, by their combination."""
    rows = read(spark, d, "harness_traces").dropDuplicates(["trace_id"])
    return rows.select(F.array_join(answers.quality_flags(F.col("response")), ",").alias("flags")).groupBy("flags").agg(F.count(F.lit(1)).alias("responses"))


@registered
def search_quality(spark, d):
    """Hit rate, recall and reciprocal rank of path search, by language of the file that the query names."""
    rows = read(spark, d, "user_history").filter("query is not null")
    once = rows.groupBy(F.col("id").alias("qid")).agg(F.min("query").alias("query"))
    asked = once.withColumn("repo_scope", F.lit(None).cast("array<string>"))
    named = asked.select("qid", F.explode(T.path_like_terms(F.col("query"))).alias("file_path")).filter(F.col("file_path").rlike(r"/.*\.\w+$"))
    gold = named.withColumn("suffix", F.regexp_extract("file_path", r"\.(\w+)$", 1))
    ranked = search.path_search(asked.join(named.select("qid").distinct(), "qid", "left_semi"), read(spark, d, "artifacts"), 8)
    return answers.ranking_quality(ranked, gold, "suffix")
