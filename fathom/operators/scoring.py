"""Scores of artifacts against requests: the retrieval score of the searches, and the re-ranker.

Both add up points for a request's terms, literals and path-like terms. What depends on a term and a file, or a term
and an artifact, is computed once per such pair and only then joined with the requests that ask for the term.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import text as T
from fathom.functions.access import in_scope
from fathom.operators import scan, textindex
from fathom.operators.search import top
from fathom.session import write_table

#: Words and names that mark requests and files. Fixed values.
OPERATIONAL_TERMS = ("script", "validator", "workflow", "command", "implements", "install", "build", "test", "lint")
OPERATIONAL_SUFFIXES = (".py", ".js", ".ts", ".sh", ".ps1", ".bat", ".cmd", ".yml", ".yaml", ".toml", ".ini", ".cfg")
OPERATIONAL_FOLDERS = ("scripts", "tools", "workflows", ".github", ".gitlab", ".circleci")
OPERATIONAL_KINDS = ("function", "method", "class", "module")
POLICY_TERMS = (
    "policy", "policies", "governance", "contributing", "contribution", "license", "licensing", "maintainer", "release", "rfc",
)
SCHEMA_ROLE = "document_role = json schema"
TYPE_KINDS = ("class", "struct", "interface", "enum")

#: Words that the re-ranker's terms leave out. Fixed values.
RERANK_STOPWORDS = (
    "a", "an", "and", "are", "artifact", "as", "at", "be", "by", "callee", "confirm", "contains", "correspond", "defined", "does",
    "file", "for", "from", "how", "in", "indexed", "is", "it", "kind", "kinds", "of", "on", "or", "public", "repository", "symbol",
    "the", "to", "what", "where", "which", "with",
)


@dataclass(frozen=True)
class Points:
    """Points of each kind of match. Fixed values."""

    term: float
    name: float
    related_name: float
    folder: float
    related_folder: float
    path: float
    basename: float
    under: float
    in_path: float
    in_text: float
    suffix: float
    schema: float
    operational: float
    config: float


RETRIEVAL = Points(0.08, 0.6, 0.35, 0.25, 0.15, 5.0, 3.0, 0.2, 1.5, 0.8, 2.0, 2.5, 2.5, 6.0)
RERANK = Points(1.0, 6.0, 3.5, 2.5, 1.5, 50.0, 30.0, 1.0, 15.0, 8.0, 20.0, 30.0, 35.0, 60.0)


def searchable(*fields: str) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def entries(artifacts: DataFrame, *more: Column) -> DataFrame:
    """What the scores need of each artifact besides its text, and ``more`` columns; one row per id."""
    path = F.replace(F.lower("file_path"), F.lit("\\"), F.lit("/"))
    meta = T.metadata_text(F.col("metadata"))
    whole = F.lower(F.concat_ws(" ", "id", "symbol_name", "file_path", "kind", "text", meta))
    name = T.basename(path)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return artifacts.select(
        "id", "repository", "tier", "file_path", "kind", "line_start", "line_end", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"),
        meta.alias("metadata_text"), F.coalesce(F.col("metadata")["qualified_name"], F.lit("")).alias("qualified"),
        F.concat_ws(":", "repository", "file_path").alias("file"), path.alias("path"), name.alias("name"), suffix.alias("suffix"),
        (path.endswith(".schema.json") | F.coalesce(whole.contains(SCHEMA_ROLE), F.lit(False))).alias("schema_doc"),
        (
            suffix.isin(*OPERATIONAL_SUFFIXES) | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, OPERATIONAL_FOLDERS)))
            | F.col("kind").rlike("|".join(OPERATIONAL_KINDS))
        ).alias("operational"),
        ((suffix == "") & (F.col("line_end") <= 3)).alias("config"), *more,
    )


def whole_texts(artifacts: DataFrame) -> DataFrame:
    """(id, text): everything of an artifact that a term may lie in."""
    return artifacts.select("id", _whole_text().alias("text"))


def _whole_text() -> Column:
    return F.concat_ws(" ", "id", "symbol_name", "file_path", T.basename(F.col("file_path")), "kind", "text", T.metadata_text(F.col("metadata")))


def items(requests: DataFrame) -> DataFrame:
    """(qid, item, n): each request's terms, and how many of its literals and path-like terms are the same."""
    named = F.concat(T.query_literals(F.col("query")), T.path_like_terms(F.col("query")))
    return requests.select("qid", named.alias("named"), F.explode(T.query_terms(F.col("query"))).alias("item")).select(
        "qid", "item", F.size(F.filter("named", lambda x: x == F.col("item"))).alias("n")
    )


def asks(requests: DataFrame) -> DataFrame:
    """(qid, for_schema, for_operations): what a request's terms ask for."""
    terms = T.query_terms(F.col("query"))
    has = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    return requests.select("qid", (F.array_contains(terms, "schema") & ~has(POLICY_TERMS)).alias("for_schema"), has(OPERATIONAL_TERMS).alias("for_operations"))


def path_words() -> tuple[Column, Column]:
    """The distinct tokens of a file's name and of its folders."""
    pieces = lambda c: F.split(c, "[^a-z0-9]+")
    name = F.col("name")
    stem = T.stem_of(name)
    high = F.concat(F.array("path", name, stem, F.ltrim(F.col("suffix"), F.lit("."))), pieces(name), pieces(stem))
    low = pieces(F.regexp_replace("path", "/?[^/]*$", ""))
    filled = lambda c: F.array_distinct(F.filter(c, lambda x: x != ""))
    return filled(high), filled(low)


def path_tokens(files: DataFrame) -> DataFrame:
    """(file, token, high): the tokens of each file's name (high) and of its folders."""
    high, low = path_words()
    tagged = lambda c, flag: F.transform(c, lambda x: F.struct(x.alias("token"), F.lit(flag).alias("high")))
    return files.select("file", F.explode(F.concat(tagged(high, True), tagged(low, False))).alias("t")).select("file", "t.token", "t.high")


def file_points(wanted: DataFrame, files: DataFrame, runs: DataFrame, grams: DataFrame, p: Points = RETRIEVAL) -> DataFrame:
    """(item, file, path_points, literal_points, in_path, named): what each of ``wanted(item)`` is worth in each file's path.

    ``files`` has file, path, name and suffix; ``runs`` and ``grams`` are the index of their paths. Equal and related words
    meet by keys, items and paths by the index.
    """
    wanted = wanted.select("item").distinct()
    tokens = path_tokens(files)
    long = F.length("item") >= 3
    zero = F.lit(0.0)
    equal = textindex.salted_join(wanted.withColumn("token", F.col("item")), tokens, "token", "file").select(
        "item", "file", F.when(long, F.when(F.col("high"), p.name).otherwise(p.folder)).otherwise(zero).alias("path_points"),
        zero.alias("literal_points"), F.lit(False).alias("in_path"), F.col("high").alias("named"),
    )
    key = lambda c: F.left(T.light_stem(F.col(c)), F.lit(5)).alias("key")
    related = textindex.salted_join(
        wanted.filter(long).select("item", key("item")).filter(F.length("key") >= 5),
        tokens.select("file", "high", key("token")).filter(F.length("key") >= 5).distinct(), "key", "file",
    ).select(
        "item", "file", F.when(F.col("high"), p.related_name).otherwise(p.related_folder).alias("path_points"),
        zero.alias("literal_points"), F.lit(False).alias("in_path"), F.lit(False).alias("named"),
    )
    paths = files.select(F.col("file").alias("id"), F.col("path").alias("text"))
    terms = wanted.select(F.col("item").alias("term"))
    within = textindex.verified(textindex.containing(terms, runs, grams), paths).select(F.col("term").alias("item"), F.col("id").alias("file"))
    item = F.col("item")
    inside = within.join(files.select("file", "path", "name"), "file").select(
        "item", "file", zero.alias("path_points"),
        F.when(item == F.col("path"), p.path).when(item == F.col("name"), p.basename).when(item.endswith("/"), p.under).otherwise(p.in_path).alias("literal_points"),
        F.lit(True).alias("in_path"), F.lit(False).alias("named"),
    )
    best = equal.unionByName(related).unionByName(inside).groupBy("item", "file").agg(
        F.max("path_points").alias("path_points"), F.max("literal_points").alias("literal_points"), F.max("in_path").alias("in_path"), F.max("named").alias("named")
    )
    ends = F.when(item.startswith(".") & (item == F.col("suffix")), p.suffix).otherwise(0.0)
    return best.join(files.select("file", "suffix"), "file").withColumn("literal_points", F.col("literal_points") + ends).drop("suffix")


def scores(
    requests: DataFrame, matched: DataFrame, known: DataFrame, points: DataFrame, pairs: DataFrame | None = None, p: Points = RETRIEVAL
) -> DataFrame:
    """(qid, id, points): the retrieval score without the cosine.

    ``matched(term, id)`` says which artifacts hold which terms, ``known`` are their ``entries``, ``points`` the requests'
    ``file_points``. Without ``pairs(qid, id)``,
    every artifact that the user may see and that holds a term of the request gets a row.
    """
    asked = items(requests)
    placed = matched.withColumnRenamed("term", "item").join(known.select("id", "file", "repository", "tier"), "id")
    by_item = placed.join(points.filter("in_path").select("item", "file", "in_path"), ["item", "file"], "left").select(
        "item", "id", "repository", "tier", F.when(F.col("in_path"), 0.0).otherwise(p.in_text).alias("in_text")
    )
    gain = F.sum(F.lit(p.term) + F.col("n") * F.col("in_text")).alias("a")
    if pairs is None:
        scoped = asked.join(requests.select("qid", "user_tier", "repo_scope"), "qid")
        own = textindex.salted_join(scoped, by_item, "item", "id").filter(
            (F.col("tier") <= F.col("user_tier")) & in_scope(F.col("repository"), F.col("repo_scope"))
        ).groupBy("qid", "id").agg(gain)
    else:
        own = pairs.select("qid", "id").distinct().join(
            pairs.join(asked, "qid").join(by_item.select("item", "id", "in_text"), ["item", "id"]).groupBy("qid", "id").agg(gain), ["qid", "id"], "left"
        )
    of_files = textindex.salted_join(asked, points, "item", "file").groupBy("qid", "file").agg(
        F.sum(F.col("path_points") + F.col("n") * F.col("literal_points")).alias("b"), F.max("named").alias("named")
    )
    facts = known.select("id", "file", "schema_doc", "operational", "config")
    return (
        own.join(facts, "id").join(of_files, ["qid", "file"], "left").join(asks(requests), "qid").select(
            "qid", "id",
            F.round(
                F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)) + F.when(F.col("for_schema") & F.col("schema_doc"), p.schema).otherwise(0.0)
                + F.when(F.col("for_operations") & F.col("operational"), p.operational).otherwise(0.0)
                + F.when(F.col("config") & F.coalesce("named", F.lit(False)), p.config).otherwise(0.0), 6,
            ).alias("points"),
        )
    )


# --- the same score in one pass over the artifacts ---


def scored_requests(requests: DataFrame) -> DataFrame:
    """The requests of the retrieval score, as ``scan.Asked`` takes them."""
    listed = items(requests).groupBy("qid").agg(F.collect_list(F.struct("item", "n")).alias("items"))
    flags = asks(requests).select("qid", F.array("for_schema", "for_operations").alias("flags"))
    none = F.array().cast("array<struct<item:string,n:int>>")
    return requests.select("qid", "user_tier", "repo_scope").join(flags, "qid").join(listed, "qid", "left").withColumn("items", F.coalesce("items", none))


def scanned(artifacts: DataFrame) -> DataFrame:
    """What a pass needs of each artifact: its ``entries``, the words of its path and its whole text in lower case."""
    high, low = path_words()
    known = entries(artifacts, F.lower(_whole_text()).alias("text"))
    return known.select("id", "repository", "tier", "file", "path", "name", "suffix", "schema_doc", "operational", "config", "text", high.alias("high"), low.alias("low"))


def _stem(word: str) -> str:
    """``T.light_stem`` of one word."""
    return next((word[: -len(x)] for x in T.STEM_SUFFIXES if word.endswith(x) and len(word) > len(x) + 3), word)


def _points(p: Points) -> Points:
    return Points(**{k: round(v * scan.UNIT) for k, v in vars(p).items()})


def retrieval_postings(asked: scan.Asked, matcher: scan.Matcher | scan.Lookup, points: Points = RETRIEVAL) -> scan.Postings:
    """The terms of ``scores`` for rows of ``scanned``: points once per item, and for each equal literal or path-like term."""
    p = _points(points)
    related: dict[str, list[int]] = {}
    for i, item in enumerate(asked.items):
        key = _stem(item)[:5]
        if len(item) >= 3 and len(key) == 5:
            related.setdefault(key, []).append(i)

    def of(row: dict, seen: frozenset) -> dict:
        path, name, suffix = row["path"], row["name"], row["suffix"]
        held, inside = matcher.held(row["text"], seen), matcher.held(path, seen)
        once: dict[int, int] = {}
        for words, equal, near in ((row["high"] or (), p.name, p.related_name), (row["low"] or (), p.folder, p.related_folder)):
            for word in words:
                i = asked.index.get(word)
                if i in seen and len(word) >= 3:
                    once[i] = max(once.get(i, 0), equal)
                for i in related.get(_stem(word)[:5], ()):
                    if i in seen:
                        once[i] = max(once.get(i, 0), near)
        out = {}
        for i in held | inside | once.keys():
            item, each = asked.items[i], 0
            if i in inside:
                each = p.path if item == path else p.basename if item == name else p.under if item.endswith("/") else p.in_path
                if item.startswith(".") and item == suffix:
                    each += p.suffix
            elif i in held:
                each = p.in_text
            out[i] = once.get(i, 0) + (scan.COUNTS + p.term if i in held else 0), each
        return out

    return of


def retrieval_extra(asked: scan.Asked, rows: list[dict], points: Points = RETRIEVAL):
    """What ``scores`` adds for schemas, operations and configuration files."""
    p = _points(points)
    flagged = lambda c, v: np.array([v if r[c] else 0 for r in rows], np.int64)
    schema, operational = flagged("schema_doc", p.schema), flagged("operational", p.operational)
    config = [(at, {asked.index.get(w) for w in r["high"] or ()}) for at, r in enumerate(rows) if r["config"]]

    def more(q: int, found: np.ndarray) -> np.ndarray:
        for_schema, for_operations = asked.flags[q]
        found = found + schema * bool(for_schema) + operational * bool(for_operations)
        for at, named in config:
            if any(i in named for i, _ in asked.of[q]):
                found[at] += p.config
        return found

    return more


def best_scored(requests: DataFrame, artifacts: DataFrame, k: int) -> DataFrame:
    """(qid, id, points, rank): the ``k`` best of ``scores`` among the visible artifacts that hold a term of the request."""
    asked = write_table(scored_requests(requests), "scored-requests")
    found = scan.best(asked, scanned(artifacts), retrieval_postings, ("id",), k, extra=retrieval_extra)
    return top(found, ["qid"], [F.desc("points"), F.col("id")], k).withColumn("points", scan.units(F.col("points")))


def scores_of_pairs(requests: DataFrame, pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(qid, id, points): ``scores`` of ``pairs(qid, id)``, which are stored and visible."""
    asked = write_table(scored_requests(requests), "scored-requests")
    found = scan.of_pairs(asked, pairs, scanned(artifacts), retrieval_postings, retrieval_extra)
    return found.select("qid", "id", scan.units(F.col("points")).alias("points"))


def matched_pairs(pairs: DataFrame, requests: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, id): which of the requests' terms lie in the texts of ``pairs(qid, id)``; each (term, id) is looked at once."""
    wanted = pairs.select("qid", "id").join(items(requests).select("qid", F.col("item").alias("term")), "qid").select("term", "id").distinct()
    return textindex.held_terms(wanted, texts)


# --- the re-ranker ---


def identifier_parts(text: Column) -> Column:
    """Words of a name, their normal forms and camel parts, then the whole's normal form; distinct, in order."""
    words = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.concat(F.array(F.lower(w), T.normalise_identifier(w)), F.transform(T.camel_parts(w), F.lower)))
    return F.array_distinct(F.filter(F.concat(F.flatten(each), F.array(T.normalise_identifier(text))), lambda x: x != ""))


def qualified_parts(name: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.split(name, r"::|\.|#"), identifier_parts)))


def rerank_terms(query: Column) -> Column:
    """The re-ranker's distinct terms: identifier parts and their stems, path-like terms, the literals and their parts."""
    lower = F.replace(F.lower(query), F.lit("\\"), F.lit("/"))
    kept = lambda c: F.filter(F.flatten(F.transform(c, identifier_parts)), lambda t: (F.length(t) > 1) & ~t.isin(*RERANK_STOPWORDS))
    words = kept(T.all_matches(lower, T.TOKEN))
    stems = F.transform(words, T.light_stem_rerank)
    literals = T.query_literals(query)
    inner = F.flatten(F.transform(literals, lambda x: F.concat(kept(T.all_matches(x, T.TOKEN)), F.array(x))))
    return F.array_distinct(F.filter(F.concat(words, stems, T.path_like_terms(query), inner), lambda t: t != ""))


def _stem_key(word: Column) -> Column:
    """What related words have in common: the first five characters of stems that have as many, else null."""
    stem = T.light_stem_rerank(word)
    return F.when(F.length(stem) >= 5, F.left(stem, F.lit(5)))


def _stem_keys(words: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words, _stem_key), lambda k: k.isNotNull()))


def rerank_scores(hits: DataFrame, requests: DataFrame, artifacts: DataFrame, known: DataFrame, p: Points = RERANK) -> DataFrame:
    """(qid, id, rerank_score, score, owner, file_path): ``hits(qid, id, score, by_lexical, by_text, by_name, by_path)`` again.

    Hits are few per request; each is scored where its text is. ``known`` are the artifacts' ``entries``.
    """
    texts = hits.select("id").distinct().join(artifacts.select("id", "text"), "id")
    pieces = lambda c: F.split(c, "[^a-z0-9]+")
    full = lambda c: F.filter(c, lambda x: x != "")
    name, stem = F.col("name"), T.stem_of(F.col("name"))
    symbol, whole = T.normalise_identifier(F.col("symbol_name")), T.normalise_identifier(F.col("qualified"))
    fields = texts.join(known, "id").select(
        "id", "file_path", "kind", "path", "name", "suffix", "schema_doc", "operational", "config",
        F.replace(searchable("id", "symbol_name", "file_path", "kind", "text", "metadata_text"), F.lit("\\"), F.lit("/")).alias("searchable"),
        symbol.alias("symbol"), whole.alias("whole"), qualified_parts(F.col("qualified")).alias("parts"),
        F.filter(F.split("qualified", r"::|\.|#"), lambda x: x != "").alias("owners"),
        full(F.concat(F.array("path", name, stem, F.ltrim(F.col("suffix"), F.lit("."))), pieces(name), pieces(stem))).alias("high"),
        full(pieces(F.regexp_replace("path", "/?[^/]*$", ""))).alias("low"),
    ).withColumns({"high_keys": _stem_keys(F.col("high")), "low_keys": _stem_keys(F.col("low"))})
    asked = requests.select(
        "qid", rerank_terms(F.col("query")).alias("terms"), F.concat(T.query_literals(F.col("query")), T.path_like_terms(F.col("query"))).alias("named")
    )
    path = F.col("path")

    def of_term(x: Column) -> Column:
        t, related = x["term"], lambda keys: F.coalesce(F.array_contains(keys, x["key"]), F.lit(False))
        of_symbol = (
            F.when(
                t == F.col("symbol"),
                40.0 + F.when(F.lower("kind").isin(*TYPE_KINDS), 15.0).otherwise(0.0) + F.when(F.lower("kind").contains("implementation"), 20.0).otherwise(0.0),
            )
            .when(t == F.col("whole"), 35.0).when(F.try_element_at("parts", F.lit(-1)) == t, 18.0).when(F.array_contains("parts", t), 3.0)
            .when(F.concat_ws(" ", "symbol", "whole").contains(t), 6.0).otherwise(0.0)
        )
        of_path = (
            F.when(F.length(t) < 3, 0.0).when(F.array_contains("high", t), p.name).when(related("high_keys"), p.related_name)
            .when(F.array_contains("low", t), p.folder).when(related("low_keys"), p.related_folder).otherwise(0.0)
        )
        return F.when(F.col("searchable").contains(t), p.term).otherwise(0.0) + of_symbol + of_path

    def of_named(x: Column) -> Column:
        place = (
            F.when(x == path, p.path).when(x == name, p.basename).when(x.endswith("/") & path.contains(x), p.under).when(path.contains(x), p.in_path)
            .when(F.col("searchable").contains(x), p.in_text).otherwise(0.0)
        )
        return F.when(x == "", 0.0).otherwise(place) + F.when(x.startswith(".") & (x == F.col("suffix")), p.suffix).otherwise(0.0)

    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + f(x))
    has = lambda words: F.arrays_overlap("terms", F.array(*map(F.lit, words)))
    n = F.size("parts")
    owner_action = F.col("kind").rlike("(?i)method|function") & (n >= 2) & F.arrays_overlap(F.slice("parts", F.lit(1), F.greatest(n - 1, F.lit(0))), "terms") & (
        F.arrays_overlap(F.slice("parts", F.lit(2), F.greatest(n - 1, F.lit(0))), "terms")
    )
    marks = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in (("by_path", 6.0), ("by_name", 5.0), ("by_lexical", 4.0), ("by_text", 2.0))), F.lit(0.0))
    points = (
        total("keyed", of_term) + total("named", of_named) + F.when(F.array_contains("terms", "schema") & ~has(POLICY_TERMS) & F.col("schema_doc"), p.schema).otherwise(0.0)
        + F.when(has(OPERATIONAL_TERMS) & F.col("operational"), p.operational).otherwise(0.0)
        + F.when(F.col("config") & F.arrays_overlap("terms", "high"), p.config).otherwise(0.0) + F.when(owner_action, 60.0).otherwise(0.0) + marks
    )
    owners = F.col("owners")
    owner = (
        F.when(F.lower("kind").isin(*TYPE_KINDS, "class-implementation", "struct-implementation"), F.try_element_at(owners, F.lit(-1)))
        .when(F.size(owners) > 1, F.try_element_at(owners, F.lit(-2))).otherwise("")
    )
    # a request's terms go to its hits before these meet the texts, so that no text is shuffled once per hit
    keyed = F.transform("terms", lambda t: F.struct(t.alias("term"), _stem_key(t).alias("key")))
    return hits.join(asked, "qid").join(fields, "id").withColumn("keyed", keyed).select(
        "qid", "id", F.round(points, 4).alias("rerank_score"), "score", T.normalise_identifier(F.coalesce(owner, F.lit(""))).alias("owner"), "file_path", "name"
    )


def diverse(scored: DataFrame, m: int = 8) -> DataFrame:
    """(qid, id, file_path, rerank_score, position): the best ``m`` hits of each request, one per file and name first.

    In order of score, a hit whose file or base name was taken is passed over unless its owner was taken; then hits of
    files not taken yet fill up. A request's hits are few (the searches' limits), so that they are one array.
    """
    hit = F.struct(
        (-F.col("rerank_score")).alias("a"), (-F.col("score")).alias("b"), "id", "file_path", "name", "owner", "rerank_score"
    )
    kept = "array<struct<id:string,file_path:string,rerank_score:double>>"
    names = "array<string>"
    start = F.struct(
        F.array().cast(kept).alias("kept"), F.array().cast(names).alias("owners"), F.array().cast(names).alias("files"), F.array().cast(names).alias("names")
    )
    short = lambda x: F.struct(x["id"].alias("id"), x["file_path"].alias("file_path"), x["rerank_score"].alias("rerank_score"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.array_contains(acc["files"], x["file_path"]) | F.array_contains(acc["names"], x["name"])
        take = (~seen | F.array_contains(acc["owners"], x["owner"])) & (F.size(acc["kept"]) < m)
        add = lambda c, v, on: F.when(on, F.concat(c, F.array(v))).otherwise(c)
        return F.struct(
            add(acc["kept"], short(x), take).alias("kept"), add(acc["owners"], x["owner"], take & (x["owner"] != "")).alias("owners"),
            add(acc["files"], x["file_path"], take).alias("files"), add(acc["names"], x["name"], take & (x["name"] != "")).alias("names"),
        )

    def fill(acc: Column, x: Column) -> Column:
        take = ~F.array_contains(acc["files"], x["file_path"]) & (F.size(acc["kept"]) < m)
        return F.struct(
            F.when(take, F.concat(acc["kept"], F.array(short(x)))).otherwise(acc["kept"]).alias("kept"), acc["owners"].alias("owners"),
            F.when(take, F.concat(acc["files"], F.array(x["file_path"]))).otherwise(acc["files"]).alias("files"), acc["names"].alias("names"),
        )

    ordered = scored.groupBy("qid").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    first = ordered.withColumn("acc", F.aggregate("hits", start, step))
    return first.withColumn("acc", F.aggregate("hits", F.col("acc"), fill)).select("qid", F.posexplode("acc.kept").alias("at", "x")).select(
        "qid", "x.id", "x.file_path", "x.rerank_score", (F.col("at") + 1).alias("position")
    )
