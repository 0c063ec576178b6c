"""Links between files: JSON documents with the schemas that they follow and the files that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathom.functions import text as T


def suffix_of(name: Column) -> Column:
    """The name's last extension with its dot; none for names that only begin or end with a dot."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def candidate_schema_paths(path: Column) -> Column:
    """Where a document's schema may lie, in order: by its extension, its stem and its name."""
    lower = F.lower(path)
    name = T.basename(lower)
    suffix = F.ltrim(suffix_of(name), F.lit("."))
    stem = F.when(suffix == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1))
    parent = F.regexp_extract(lower, "^(.*/)[^/]*$", 1)
    at = lambda folder, x: F.concat(folder, x, F.lit(".schema.json"))
    of = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.array(at(F.lit("schemas/"), x), at(F.lit("schema/"), x), at(parent, x)))
    return F.array_distinct(F.concat(of(suffix), of(stem), F.array(at(parent, name))))


def resolve_path(path: Column) -> Column:
    """``path`` without ``.`` and ``..``; null where it leaves the root."""
    folders = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(acc.isNull(), None).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(folders, F.array().cast("array<string>"), step), "/")


def reference_targets(path: Column, value: Column) -> Column:
    """The paths that a string of the file ``path`` may mean, in order; none for URLs and plain words."""
    v = F.replace(F.btrim(value, F.lit(" \t\r\n")), F.lit("\\"), F.lit("/"))
    beside = resolve_path(F.concat(F.regexp_extract(path, "^(.*/)[^/]*$", 1), v))
    relative = v.rlike(r"^\.\.?/")
    named = relative | v.contains("/") | (suffix_of(T.basename(v)) != "")
    found = F.when(relative, F.array(beside)).otherwise(F.array(resolve_path(v), beside))
    none = F.array().cast("array<string>")
    return F.when((v == "") | v.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | ~named, none).otherwise(F.array_compact(found))


def is_schema(document: Column) -> Column:
    """Whether a JSON object (a VARIANT) is a schema."""
    kind = lambda key: F.coalesce(F.schema_of_variant(F.try_variant_get(document, key, "variant")).startswith("OBJECT"), F.lit(False))
    has = F.try_variant_get(document, "$['$schema']", "variant").isNotNull()
    return F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False)) & (
        has | kind("$.properties") | kind("$['$defs']") | kind("$.definitions")
    )


def cross_file_edges(artifacts: DataFrame, leaves: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship): documents with their schema (validated-by) and the files they name (references).

    ``artifacts`` has id, repository, file_path, kind and text; ``leaves`` the documents' (id, value, type). A file is known
    by its least artifact of the lowest tier. Candidates are joined by path; of several the first one in order counts.
    """
    documents = artifacts.filter("kind = 'json-document'").select("id", "repository", "file_path", F.try_parse_json("text").alias("v"))
    first_ids = artifacts.groupBy("repository", F.lower("file_path").alias("path")).agg(F.min_by("id", F.struct("tier", "id")).alias("target_id"))
    schemas = documents.filter(F.lower("file_path").endswith(".schema.json") | is_schema(F.col("v"))).groupBy("repository", F.lower("file_path").alias("path")).agg(F.min("id").alias("target_id"))
    asked = documents.select(F.col("id").alias("source_id"), "repository", F.posexplode(candidate_schema_paths(F.col("file_path"))).alias("at", "path"))
    validated = asked.join(schemas, ["repository", "path"]).groupBy("source_id").agg(F.min_by("target_id", "at").alias("target_id")).withColumn("relationship", F.lit("validated-by"))
    named = leaves.filter("type = 'STRING'").join(documents.select("id", "repository", "file_path"), "id").select(
        F.col("id").alias("source_id"), "repository", "value", F.posexplode(reference_targets(F.col("file_path"), F.col("value"))).alias("at", "path")
    ).withColumn("path", F.lower("path"))
    referenced = named.join(first_ids, ["repository", "path"]).groupBy("source_id", "value").agg(F.min_by("target_id", "at").alias("target_id"))
    return validated.unionByName(referenced.select("source_id", "target_id", F.lit("references").alias("relationship"))).filter("source_id <> target_id").distinct()
