"""Symbols of source files: definitions by language patterns, with their line spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: How definitions begin, by language: (kind, pattern with the name as first group). Fixed values.
DEFINITIONS = {
    "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")),
    "javascript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)")),
    "typescript": (
        ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
    ),
    "go": (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("class", r"^type\s+(\w+)\s+struct")),
    "java": (("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)")),
    "cpp": (("class", r"^\s*(?:class|struct)\s+(\w+)"), ("namespace", r"^\s*namespace\s+(\w+)")),
}


def definitions(files: DataFrame) -> DataFrame:
    """(id, line_no, kind, name, line_end): the definitions of each file; one ends where the next as deep begins.

    ``files`` has id, language and text. Lines are exploded in Spark; no file is held by Python.
    """
    lines = files.filter(F.col("language").isin(*DEFINITIONS)).select(
        "id", "language", F.size(F.split("text", "\n", -1)).alias("n_lines"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    )
    kind = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for language, patterns in DEFINITIONS.items():
        for k, pattern in reversed(patterns):
            holds = (F.col("language") == language) & F.col("line").rlike(pattern)
            kind = F.when(holds, F.lit(k)).otherwise(kind)
            name = F.when(holds, F.regexp_extract("line", pattern, 1)).otherwise(name)
    found = lines.select(
        "id", "n_lines", (F.col("at") + 1).alias("line_no"), kind.alias("kind"), name.alias("name"),
        F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"),
    ).filter(F.col("kind").isNotNull())
    following = F.lead("line_no").over(Window.partitionBy("id", "indent").orderBy("line_no"))
    return found.select("id", "line_no", "kind", "name", F.coalesce(following - 1, F.col("n_lines")).alias("line_end"))
