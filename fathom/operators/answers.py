"""Shaping answers: order of context, merges, flags, cache keys, prompts and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathom.functions import text as T

#: What in a response counts as a path or as a line of code. Fixed values.
PATH = r"(?i)\b(?:[A-Z]:[\\/]|(?:\.{1,2}|src|tests?|scripts?|evaluation|[A-Za-z0-9_.-]+)[\\/])[^\s`'\"),]+"
RAW_CODE = (
    r"(?m)^\s*(?:class|def|async def|return|if|else|for|while|switch|case|template|namespace|public:|private:|protected:"
    r"|[A-Za-z_:<>~*&\s]+\([^)]*\)\s*(?:const)?\s*[;{])"
)
PATH_HEADINGS = ("relevant files:", "files:", "source files:", "sources:", "paths:", "file paths:")


def quality_flags(response: Column) -> Column:
    """path_leak, raw_code, path_list and empty, in that order."""
    text = F.coalesce(response, F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*]") & x.rlike(PATH)))
    path_list = (F.size(lines) > 0) & (
        F.lower(F.get(lines, F.lit(0))).isin(*PATH_HEADINGS) | (bullets >= F.greatest(F.lit(1), F.size(lines) - 1))
    )
    flags = F.array(
        F.when(text.rlike(PATH), F.lit("path_leak")), F.when(text.rlike(RAW_CODE), F.lit("raw_code")),
        F.when(path_list, F.lit("path_list")), F.when(F.trim(text) == "", F.lit("empty")),
    )
    return F.array_compact(flags)


def cache_key(policy: str, query: Column, tier: Column, scopes: Column, mode: str, model: Column, fingerprint: Column) -> Column:
    """SHA-256 of the parts that make two requests the same."""
    return F.sha2(
        F.concat_ws(
            ":", F.lit(policy), T.squeeze(query), tier, F.array_join(F.array_sort(scopes), ","), F.lit(mode),
            F.coalesce(model, F.lit("default-model")), fingerprint,
        ),
        256,
    )


def u_shape(hits: DataFrame) -> DataFrame:
    """Reorders ranked hits so that the best stand at both ends: even places first, then odd places backwards.

    ``hits`` has qid and rank (from 1); gives ``place`` (from 1).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    zero = F.col("rank") - 1
    evens = F.ceil(F.col("n") / 2)
    odd_rank = F.row_number().over(Window.partitionBy("qid", (F.col("rank") - 1) % 2).orderBy(F.desc("rank")))
    ordered = hits.withColumn("n", n).withColumn("from_end", odd_rank)
    place = F.when(zero % 2 == 0, zero / 2).otherwise(evens + F.col("from_end") - 1)
    return ordered.withColumn("place", (place + 1).cast("int")).drop("n", "from_end")


def merge_by_file(hits: DataFrame, most: int = 4) -> DataFrame:
    """(qid, file_path, position, symbols, line_start, line_end): one row per file; up to ``most`` distinct symbols.

    ``hits`` has qid, file_path, rank, symbol_name, line_start, line_end.
    """
    first = hits.groupBy("qid", "file_path", "symbol_name").agg(F.min("rank").alias("rank"))
    ranked = first.filter(F.col("symbol_name").isNotNull()).withColumn(
        "n", F.row_number().over(Window.partitionBy("qid", "file_path").orderBy("rank", "symbol_name"))
    ).filter(F.col("n") <= most)
    symbols = ranked.groupBy("qid", "file_path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "symbol_name"))), lambda s: s["symbol_name"]), ", ").alias("symbols")
    )
    spans = hits.groupBy("qid", "file_path").agg(
        F.min("rank").alias("position"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end")
    )
    return spans.join(symbols, ["qid", "file_path"], "left").withColumn("symbols", F.coalesce("symbols", F.lit("")))


def summaries(artifacts: DataFrame, most: int = 10) -> DataFrame:
    """(id, summary): symbol, kind, language, lines and the first distinct identifiers of each text."""
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: (F.length(t) > 2) & ~t.startswith("__")))
    named = F.slice(words, 1, most)
    body = F.when(F.size(named) > 0, F.concat(F.lit("Mentions "), F.array_join(named, ", "), F.lit("."))).otherwise(
        F.lit("No salient identifiers extracted.")
    )
    head = F.format_string("%s (%s, %s, lines %d-%d) - ", F.coalesce("symbol_name", "file_path"), "kind", "language", "line_start", "line_end")
    return artifacts.select("id", F.concat(head, body).alias("summary"))


def prompts(hits: DataFrame, texts: DataFrame, requests: DataFrame) -> DataFrame:
    """(qid, prompt): numbered summaries in U-shaped order, then the query. ``hits`` has qid, id, rank."""
    placed = u_shape(hits).join(texts, "id")
    lines = placed.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("place", "summary"))).alias("s")
    ).select(
        "qid", F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["place"].cast("string"), F.lit("] "), x["summary"])), "\n").alias("context")
    )
    return requests.select("qid", "query").join(lines, "qid").select(
        "qid", F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "query").alias("prompt")
    )


def ranking_quality(ranked: DataFrame, gold: DataFrame, groups: str, k: int = 8) -> DataFrame:
    """Per group and in total: requests, hit@k, recall@k, all-gold@k and mean reciprocal rank.

    ``ranked`` has qid, file_path, rank; ``gold`` has qid, ``groups`` and file_path. A retrieved path matches a gold
    path that equals it, ends with it, or has its basename.
    """
    asked = gold.select("qid", groups, F.lower("file_path").alias("gold")).distinct()
    got = ranked.filter(F.col("rank") <= k).select("qid", "rank", F.lower("file_path").alias("path"))
    pairs = asked.join(got, "qid", "left")
    hit = F.when(
        (F.col("path") == F.col("gold")) | F.col("path").endswith(F.concat(F.lit("/"), "gold"))
        | (T.basename(F.col("path")) == T.basename(F.col("gold"))), F.col("rank"),
    )
    each = pairs.groupBy("qid", groups, "gold").agg(F.min(hit).alias("first"))
    per_query = each.groupBy("qid", groups).agg(
        F.min("first").alias("first"), F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("recall")
    )
    return per_query.rollup(groups).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg(F.when(F.col("recall") == 1.0, 1.0).otherwise(0.0)), 6).alias("all_gold"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    ).withColumn(groups, F.coalesce(groups, F.lit("total")))


#: A marker that a failed model call leaves. Fixed value.
INFERENCE_ERROR = r"(?i)\[Inference Error:.*?\]"


def decisions(traces: DataFrame) -> DataFrame:
    """(trace_id, decision): whether an answer would be kept, or why a fallback would take its place."""
    flags = quality_flags(F.col("response"))
    found = F.size(F.coalesce("retrieval_ids", F.array().cast("array<string>"))) > 0
    decision = (
        F.when(~found, "no_context").when(F.array_contains(flags, "empty"), "empty")
        .when(F.coalesce("response", F.lit("")).rlike(INFERENCE_ERROR), "error").when(F.array_contains(flags, "path_list"), "path_list")
        .otherwise("kept")
    )
    return traces.select("trace_id", decision.alias("decision"))


#: What a response is when nothing of it can be used, and lines that say nothing. Fixed values.
UNUSABLE = "The cached response matched code artifacts but did not contain a usable behavioral summary."
VACUOUS_LINES = ("answer comes from", "the answer comes from", "see", "from", "in")
LIST_MARKS = ("-", "*")

#: Headers of files, lines of code besides RAW_CODE, and answers that only name what an artifact is. Fixed values.
FILE_HEADER = r"(?m)^--- File: .*?---$"
CODE_LINES = (
    r"^[A-Za-z_][A-Za-z0-9_:]*:$",
    r"^[A-Za-z_][A-Za-z0-9_:.\->]*\s*\([^)]*\)\s*:?$",
    r"^[A-Za-z_][A-Za-z0-9_]*\s*=",
    r"^[A-Za-z_][A-Za-z0-9_:.\->]*\s*\([^)]*\)\s*;?$",
    r"^(?:\{|\}|\};)$",
)
LANGUAGE_NAMES = r"(?:Python|TypeScript|JavaScript|C\+\+|C#|Go|Rust|Java)"
ABSTRACT = rf"(?i)^[A-Za-z_][A-Za-z0-9_:]* is an? (?:{LANGUAGE_NAMES} )?(?:class|function|method|artifact)(?: in {LANGUAGE_NAMES})?\.?\s*$"
LABEL = r"(?i)\b(?:class|struct|interface|method|function)-implementation tied to\b"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shaped(response: Column) -> Column:
    """The response without file headers, fences, paths and lines of code; UNUSABLE where nothing is left, empty stays empty."""
    text = _stripped(F.coalesce(response, F.lit("")))
    bare = F.replace(F.regexp_replace(text, FILE_HEADER, ""), F.lit("```"), F.lit(""))
    lines = F.transform(F.split(bare, r"\r\n|\n|\r"), lambda x: _stripped(F.regexp_replace(F.regexp_replace(x, PATH, " "), "[ \t]{2,}", " ")))
    says = lambda x: (
        (x != "") & ~F.lower(x).isin(*PATH_HEADINGS, *LIST_MARKS) & ~F.btrim(F.lower(x), F.lit(" .:")).isin(*VACUOUS_LINES)
        & ~x.rlike("|".join((RAW_CODE, *CODE_LINES)))
    )
    kept = F.array_join(F.filter(lines, says), "\n")
    return F.when(text == "", "").when(kept == "", UNUSABLE).otherwise(kept)


def all_flags(response: Column) -> Column:
    """The flags of a response, then those that only its shaped form has."""
    return F.array_distinct(F.concat(quality_flags(response), quality_flags(shaped(response))))


def applied_policy(traces: DataFrame) -> DataFrame:
    """(trace_id, response, source, flags): the shaped answer, or null with source ``fallback`` where it can't stand.

    Without retrieved ids and summary there is no context; else an answer falls if nothing usable is left of it, if it
    reports an error, only declares or labels an artifact, or leaks paths or code, or is a list of paths.
    """
    filled = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    context = filled(F.col("retrieval_ids")) | (F.trim(F.coalesce("prompt_summary", F.lit(""))) != "")
    each = traces.select("trace_id", context.alias("context"), shaped(F.col("response")).alias("shaped"), all_flags(F.col("response")).alias("flags"))
    said = F.transform(F.split("shaped", "\n"), lambda x: F.regexp_replace(F.trim(x), r"^\s*(?:[-*]\s*)?", ""))
    falls = (
        F.col("shaped").isin("", UNUSABLE) | F.col("shaped").rlike(INFERENCE_ERROR) | F.exists(said, lambda x: x.rlike(ABSTRACT))
        | F.col("shaped").rlike(LABEL) | F.arrays_overlap("flags", F.array(*map(F.lit, ("path_leak", "raw_code", "path_list"))))
    )
    why = F.when(~F.col("context"), "no_retrieval_context").when(falls, "fallback_used")
    return each.select(
        "trace_id", F.when(why.isNull(), F.col("shaped")).alias("response"), F.when(why.isNull(), "model").otherwise("fallback").alias("source"),
        F.array_compact(F.concat("flags", F.array(why))).alias("flags"),
    )


def sanitised(response: Column) -> Column:
    """A cached response as it may be given again: shaped; null where nothing is left or what is left leaks paths or code."""
    text = shaped(response)
    leaks = F.arrays_overlap(quality_flags(text), F.array(F.lit("path_leak"), F.lit("raw_code")))
    return F.when(~text.isin("", UNUSABLE) & ~leaks, text)


#: Verbs that names begin with, and plurals of what they end with. Fixed values.
VERBS = {
    "is": "checks", "acquire": "acquires", "append": "appends", "build": "builds", "collect": "collects", "dedupe": "deduplicates",
    "delete": "deletes", "detect": "detects", "find": "finds", "generate": "generates", "get": "gets", "index": "indexes", "iter": "iterates",
    "merge": "merges", "parse": "parses", "publish": "publishes", "release": "releases", "resolve": "resolves", "search": "searches",
    "set": "sets", "upsert": "upserts", "validate": "validates", "warm": "warms",
}
PLURALS = {"file": "files", "path": "paths", "repository": "repositories"}


def behaviour_phrase(name: Column) -> Column:
    """What a name says its bearer does: ``build_path`` builds paths; empty where its first word is no known verb."""
    words = F.transform(T.all_matches(F.coalesce(name, F.lit("")), r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|[^A-Za-z0-9]|$)|[0-9]+"), F.lower)
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    verb = F.try_element_at(table(VERBS), F.get(words, F.lit(0)))
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    last = F.get(rest, F.size(rest) - 1)
    ended = F.concat(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0))), F.array(F.coalesce(F.try_element_at(table(PLURALS), last), last)))
    of = F.when(F.size(rest) == 0, "state").when((F.size(rest) == 1) & (last == "excluded"), "excluded paths").otherwise(F.array_join(ended, " "))
    return F.coalesce(F.concat_ws(" ", verb, F.when(verb.isNotNull(), of)), F.lit(""))


def fallback_answers(scored: DataFrame, texts: DataFrame, requests: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """(qid, answer): what can be said without a model: the best artifacts' summaries, or that there is too little.

    ``scored`` has qid, id, rerank_score and position; a hit counts from ``least`` points.
    """
    useful = scored.filter((F.col("rerank_score") >= least) & (F.col("position") <= most)).join(texts, "id")
    lines = useful.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "summary"))).alias("s")).select(
        "qid", F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["summary"])), "\n").alias("lines")
    )
    head = F.concat(F.lit("For `"), "query", F.lit("`, "))
    found = F.concat(head, F.lit("the useful retrieved signals are:\n"), "lines")
    thin = F.concat(head, F.lit("the indexed context is too thin for an answer."))
    return requests.select("qid", "query").join(lines, "qid", "left").select(
        "qid", F.when(F.col("lines").isNotNull(), found).otherwise(thin).alias("answer")
    )
