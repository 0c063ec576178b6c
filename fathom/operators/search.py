"""Lexical, path and file-name search for a batch of requests.

``requests`` has qid, query, user_tier and repo_scope. Every operator is a plan over (requests x postings), joined on
tokens: no query is compared with every artifact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as T
from fathom.functions.access import in_scope
from fathom.operators import scan, textindex
from fathom.session import write_table


#: Ids with several deliveries that are broadcast at most.
MOST_AGAIN = 100_000


def latest(artifacts: DataFrame, *columns: str) -> DataFrame:
    """One row per id, with ``columns`` (all where none are named): the last delivered; of equal times, the least of the rest."""
    rest = [c for c in (columns or artifacts.columns) if c != "id"]
    kinds = dict(artifacts.dtypes)
    order = F.struct(*(F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map") else F.col(c) for c in rest))
    # few ids come again: the others' rows are taken as they are read, without a shuffle of their texts
    again = write_table(artifacts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").select("id", F.lit(True).alias("again")), "again")
    once = artifacts.limit(0)
    if again.count() <= MOST_AGAIN:
        marked = artifacts.join(F.broadcast(again), "id", "left")
        once, artifacts = marked.filter("again is null and id is not null").drop("again"), marked.filter("again or id is null").drop("again")
    newest = artifacts.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct((-F.coalesce("updated_at", F.lit(float("-inf")))).alias("t"), order.alias("o"))).alias("r"))
    return once.select("id", *rest).unionByName(newest.select("id", "r.*"))


def top(rows: DataFrame, keys: list[str], order: list[Column], k) -> DataFrame:
    """The first ``k`` rows per key in a total order, with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def entries(artifacts: DataFrame) -> DataFrame:
    """The lexical index's entries: identifying fields without text and vectors."""
    return artifacts.select(
        "id", "repository", "tier", "file_path", "kind", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"),
        T.metadata_text(F.col("metadata")).alias("metadata_text"),
    )


def postings(index: DataFrame) -> DataFrame:
    """(token, id, repository, tier): the inverted index over the entries' fields."""
    searchable = F.concat_ws(
        " ", "repository", F.col("tier").cast("string"), "file_path", "symbol_name", "kind", "metadata_text"
    )
    return index.select("id", "repository", "tier", F.explode(T.index_tokens(searchable)).alias("token"))


def terms_of(requests: DataFrame) -> DataFrame:
    """(qid, term): the distinct terms of each request that the index looks up."""
    terms = F.filter(T.query_terms(F.col("query")), lambda t: (F.length(t) > 1) & ~t.isin(*T.QUERY_STOPWORDS))
    return requests.select("qid", F.explode(terms).alias("term"))


def lexical_index_search(
    requests: DataFrame, index: DataFrame, limit: int = 50, held: DataFrame | None = None, terms: DataFrame | None = None
) -> DataFrame:
    """(qid, id, file_path, score, rank): summed term weights plus boosts for terms within symbol, metadata, path and kind.

    ``held`` are the ``postings`` of ``index`` where they are stored; ``terms(qid, term)`` stand for all of the requests'.
    What a user may not see is left out before anything is added up; a frequent token's postings are spread by id.
    """
    terms = terms_of(requests) if terms is None else terms
    scoped = terms.join(requests.select("qid", "user_tier", "repo_scope"), "qid").withColumnRenamed("term", "token")
    base = (
        textindex.salted_join(scoped, postings(index) if held is None else held, "token", "id")
        .filter((F.col("tier") <= F.col("user_tier")) & in_scope(F.col("repository"), F.col("repo_scope")))
        .groupBy("qid", "id").agg(F.sum(T.term_weight(F.col("token"))).alias("base"))
    )
    asked = terms.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    found = base.join(index.select("id", "symbol_name", "metadata_text", "file_path", "kind"), "id").join(asked, "qid")
    symbol, meta, path, kind = (F.lower(c) for c in ("symbol_name", "metadata_text", "file_path", "kind"))
    boost = F.aggregate(
        "terms", F.lit(0.0),
        lambda acc, t: acc
        + F.when(symbol.contains(t), 3.0).otherwise(0.0)
        + F.when(meta.contains(t), 2.0).otherwise(0.0)
        + F.when(path.contains(t), 1.0).otherwise(0.0)
        + F.when(kind == t, 0.5).otherwise(0.0),
    )
    scored = found.select("qid", "id", "file_path", (F.col("base") + boost).alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.col("file_path"), F.col("id")], limit)


def longest_terms(requests: DataFrame, n: int) -> DataFrame:
    """(qid, term, place): each request's ``n`` longest terms, the longest first, ties in the query's order."""
    terms = requests.select("qid", F.posexplode(T.query_terms(F.col("query"))).alias("at", "term"))
    return top(terms, ["qid"], [F.desc(F.length("term")), F.col("at")], n).select("qid", "term", F.col("rank").alias("place"))


def text_hits(requests: DataFrame, artifacts: DataFrame, held: DataFrame, terms: int = 8, scanned: int = 3) -> DataFrame:
    """(qid, id, file_path, score): visible artifacts whose text holds one of the ``scanned`` longest terms of a request.

    Ten points for each of the ``terms`` longest within path, symbol, kind or text. ``held(term, id)`` says which artifacts
    may hold which terms (in any field); the text decides.
    """
    longest = longest_terms(requests, terms)
    scopes = requests.select("qid", "user_tier", "repo_scope")
    asked = longest.filter(F.col("place") <= scanned).select("qid", "term")
    found = textindex.salted_join(asked, held, "term", "id").join(artifacts.select("id", "repository", "tier"), "id").join(scopes, "qid").filter(
        (F.col("tier") <= F.col("user_tier")) & in_scope(F.col("repository"), F.col("repo_scope"))
    ).select("qid", "id").distinct()
    listed = longest.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list(F.when(F.col("place") <= scanned, F.col("term"))).alias("first"))
    fields = artifacts.select("id", "file_path", F.lower("text").alias("text"), F.lower(F.concat_ws(" ", "file_path", "symbol_name", "kind", "text")).alias("haystack"))
    scored = found.join(fields, "id").join(listed, "qid").filter(F.exists("first", lambda t: F.col("text").contains(t)))
    return scored.select("qid", "id", "file_path", (10.0 * F.size(F.filter("terms", lambda t: F.col("haystack").contains(t)))).alias("score"))


def _text_rows(artifacts: DataFrame) -> DataFrame:
    head = F.lower(F.concat_ws(" ", "file_path", "symbol_name", "kind"))
    return artifacts.select("file_path", "id", "repository", "tier", head.alias("head"), F.lower("text").alias("text"))


def best_text_hits(asked: DataFrame, artifacts: DataFrame, k: int) -> DataFrame:
    """(qid, id, file_path, score): at least the ``k`` best of ``text_hits`` by score, path and id; ``asked`` as of ``scan.text_requests``."""
    found = scan.best(asked, _text_rows(artifacts), scan.text_postings, ("file_path", "id"), k)
    return found.select("qid", "id", "file_path", scan.units(F.col("points")).alias("score"))


def are_text_hits(asked: DataFrame, pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(qid, id): which of the visible ``pairs(qid, id)`` are among ``text_hits``."""
    return scan.of_pairs(asked, pairs, _text_rows(artifacts), scan.text_postings).filter("counted").select("qid", "id")


def lexical_union(indexed: DataFrame, texts: DataFrame, k: int = 50) -> DataFrame:
    """(qid, id, file_path, score, by_text, rank): hits of the index and of the texts, each with its higher score."""
    both = indexed.select("qid", "id", "file_path", "score", F.lit(False).alias("by_text")).unionByName(
        texts.select("qid", "id", "file_path", "score", F.lit(True).alias("by_text"))
    )
    once = both.groupBy("qid", "id", "file_path").agg(F.max("score").alias("score"), F.max("by_text").alias("by_text"))
    return top(once, ["qid"], [F.desc("score"), F.col("file_path"), F.col("id")], k)


def paths(artifacts: DataFrame) -> DataFrame:
    """(id, text): the paths in lower case, and what names them in a path index."""
    return artifacts.select("repository", "file_path").distinct().select(
        F.concat_ws(":", "repository", "file_path").alias("id"), F.replace(F.lower("file_path"), F.lit("\\"), F.lit("/")).alias("text")
    )


def path_search(requests: DataFrame, artifacts: DataFrame, k: int = 50) -> DataFrame:
    """(qid, repository, file_path, score, rank): files whose path the terms name.

    A term that is the stem counts 6, one within the basename 4, a directory 3, one within the path 1; the first that
    holds counts. Requests meet paths in one pass (``scan``), so that no pairs of terms and paths are written.
    """
    text = F.replace(F.lower("file_path"), F.lit("\\"), F.lit("/"))
    known = write_table(artifacts.select("repository", "file_path").distinct(), "paths")
    rows = known.select("file_path", "repository", text.alias("text"), T.basename(text).alias("name"), T.stem_of(T.basename(text)).alias("stem")).filter("file_path is not null")
    asked = write_table(scan.path_requests(requests), "path-requests")
    found = scan.best(asked, rows, scan.path_postings, ("file_path", "repository"), k, descending=True)
    scored = found.select("qid", "repository", "file_path", (F.col("points") / scan.UNIT).cast("long").alias("score"))
    return top(scored, ["qid"], [F.desc("score"), F.desc("file_path"), F.desc("repository")], k)


KIND_RANK = "CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END"


def rows_of_files(files: DataFrame, artifacts: DataFrame, requests: DataFrame, per_file: int = 2) -> DataFrame:
    """The first ``per_file`` visible artifacts of each (qid, repository, file_path), by kind and line."""
    seen = (
        files.select("qid", "repository", "file_path").join(
            artifacts.select("id", "repository", "file_path", "kind", "tier", "line_start"), ["repository", "file_path"]
        ).join(requests.select("qid", "user_tier"), "qid").filter("tier <= user_tier")
    )
    order = [F.expr(KIND_RANK), F.col("line_start"), F.col("id")]
    return top(seen, ["qid", "repository", "file_path"], order, per_file).select("qid", "id", "file_path", "rank")


#: Suffixes of files that queries name, and those that a class's files may have, in order. Fixed values but for the last six.
NAMED_SUFFIXES = ("cpp", "cxx", "cc", "c", "h", "hpp", "hxx", "py", "pyx", "java", "js", "ts", "go", "json", "md")
CLASS_SUFFIXES = (".h", ".hpp", ".hxx", ".cpp", ".cxx", ".cc", ".c", ".py")

#: A class that more files name than this tells nothing. Fixed value.
MOST_FILES = 8


def named_classes(query: Column) -> Column:
    """Classes that a query names: the capitalised parts of ``A::b``, then capitalised words between back quotes."""
    qualified = T.all_matches(query, r"[A-Z][A-Za-z0-9_]*(?:::[A-Za-z0-9_]+)+")
    parts = F.filter(F.flatten(F.transform(qualified, lambda x: F.split(x, "::"))), lambda x: x.rlike("^[A-Z]"))
    return F.array_distinct(F.concat(parts, T.all_matches(query, "`([A-Z][A-Za-z0-9_]{1,})`", 1)))


def file_name_search(requests: DataFrame, artifacts: DataFrame, held: DataFrame | None = None, per_file: int = 2) -> DataFrame:
    """(qid, id, file_path, by_text, rank): artifacts of the files that a query names, at most ``per_file`` of a path.

    A file is named by the end of its name (``name.ext``), or by a class with one of the suffixes that classes' files have.
    A class without such a file is looked for in the texts of source files, unless more than MOST_FILES paths hold it;
    ``held(term, id)`` says which texts hold which class names in lower case (without it, texts aren't searched).
    """
    scopes = requests.select("qid", "user_tier", "repo_scope")
    visible = (F.col("tier") <= F.col("user_tier")) & in_scope(F.col("repository"), F.col("repo_scope"))
    given = T.all_matches(F.col("query"), rf"\b[A-Za-z_][A-Za-z0-9_\-]*\.(?:{'|'.join(NAMED_SUFFIXES)})\b")
    inferred = F.flatten(F.transform(named_classes(F.col("query")), lambda c: F.transform(F.array(*map(F.lit, CLASS_SUFFIXES)), lambda s: F.concat(c, s))))
    names = F.array_distinct(F.transform(F.concat(given, inferred), F.lower))
    asked = requests.select("qid", F.posexplode(names).alias("place", "name"))
    rows = artifacts.select("id", "repository", "file_path", "kind", "tier", "line_start")
    base = T.basename(F.lower("file_path"))
    ends = rows.select("repository", "file_path").distinct().select(
        "repository", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(base), F.lit(1))), lambda i: F.substring(base, i, F.length(base)))).alias("name")
    )
    files = textindex.salted_join(asked, ends, "name", "file_path").select("qid", "place", "name", "repository", "file_path")
    by_name = files.join(rows, ["repository", "file_path"]).join(scopes, "qid").filter(visible)
    found = by_name.select("qid", "id", "file_path", "kind", "line_start", F.lit(False).alias("by_text"), "place")
    if held is not None:
        classes = requests.select("qid", F.posexplode(named_classes(F.col("query"))).alias("place", "class")).withColumn("term", F.lower("class"))
        inferred_of = classes.select("qid", "term", F.explode(F.array(*(F.concat("term", F.lit(s)) for s in CLASS_SUFFIXES))).alias("name"))
        settled = inferred_of.join(by_name.select("qid", "name").distinct(), ["qid", "name"], "left_semi").select("qid", "term")
        source = F.lower("file_path").rlike(rf"({'|'.join(x.replace('.', '[.]') for x in CLASS_SUFFIXES)})$")
        within = (
            textindex.salted_join(classes.join(settled, ["qid", "term"], "left_anti").select("qid", "place", "term"), held, "term", "id")
            .join(rows.filter(source), "id").join(scopes, "qid").filter(visible)
        )
        few = within.groupBy("qid", "term").agg(F.countDistinct("file_path").alias("n")).filter(F.col("n") <= MOST_FILES).select("qid", "term")
        found = found.unionByName(
            within.join(few, ["qid", "term"]).select("qid", "id", "file_path", "kind", "line_start", F.lit(True).alias("by_text"), "place")
        )
    once = found.groupBy("qid", "id", "file_path", "kind", "line_start").agg(F.min(F.struct("by_text", "place")).alias("p"))
    order = [F.col("p.by_text"), F.col("p.place"), F.expr(KIND_RANK), F.col("line_start"), F.col("id")]
    return top(once, ["qid", "file_path"], order, per_file).select("qid", "id", "file_path", "p.by_text", "rank")


def fuse(named: DataFrame, vector: DataFrame, graph: DataFrame, ratio: float = 0.5, k: int = 20) -> DataFrame:
    """(qid, id, position): file-name hits, then a ``ratio`` of the vector hits, the graph hits, the other vector hits.

    Each input has (qid, id, rank); an id keeps its first place.
    """
    slots = vector.groupBy("qid").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("slots"))
    split = vector.join(slots, "qid").select("qid", "id", "rank", F.when(F.col("rank") <= F.col("slots"), 1).otherwise(3).alias("band"))
    parts = (
        named.select("qid", "id", "rank", F.lit(0).alias("band"))
        .unionByName(split).unionByName(graph.select("qid", "id", "rank", F.lit(2).alias("band")))
    )
    once = parts.groupBy("qid", "id").agg(F.min(F.struct("band", "rank")).alias("place"))
    return top(once, ["qid"], [F.col("place.band"), F.col("place.rank"), F.col("id")], k).select(
        "qid", "id", F.col("rank").alias("position")
    )
