"""Sources: files of a repository, JSON documents, Markdown tables, and what is left out of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.functions import text as T
from fathom.session import write_table

#: Path components and names that aren't indexed. Fixed values.
EXCLUDED = (".git", ".venv", "__pycache__", "node_modules", "vendor", "build", "dist", ".idea", ".cis")
SENSITIVE_NAMES = (
    ".env", ".env.local", ".env.production", "credentials", "credentials.json", "id_dsa", "id_ed25519", "id_rsa", "known_hosts",
    "kubeconfig",
)
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".crt", ".cer")
SECRET_PATTERNS = (
    r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |)PRIVATE KEY-----",
    r"(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|private[_-]?key|password)\s*[:=]\s*['\"]?[^'\"\s]{12,}",
)
GENERATED_MARKERS = ("auto-generated", "autogenerated", "generated by", "do not edit")

#: Languages by file suffix. Fixed values.
LANGUAGES = {
    ".json": "json", ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript",
    ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".java": "java", ".cs": "csharp",
}


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of the files below ``paths``, each once; files that aren't UTF-8 have a null text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).dropDuplicates(["path"])
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", text.alias("text"))


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def is_sensitive(path: Column) -> Column:
    lower = F.lower(path)
    parts = F.split(lower, "/")
    suffix = F.lit(False)
    for s in SENSITIVE_SUFFIXES:
        suffix = suffix | lower.endswith(s)
    return (
        F.arrays_overlap(parts, F.array(*map(F.lit, SENSITIVE_NAMES))) | T.basename(lower).startswith(".env.") | suffix
        | F.array_contains(parts, "secret") | F.array_contains(parts, "secrets")
    )


def has_secret(text: Column) -> Column:
    head = F.substring(text, 1, 8192)
    return head.rlike(SECRET_PATTERNS[0]) | head.rlike(SECRET_PATTERNS[1])


def is_generated(text: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n"))
    found = F.lit(False)
    for m in GENERATED_MARKERS:
        found = found | head.contains(m)
    return found


def is_readable(text: Column) -> Column:
    """No line of more than 500 characters, and hardly any NUL."""
    nul = F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))
    return ~F.exists(F.split(text, "\n"), lambda x: F.length(F.rtrim(x)) > 500) & (nul <= 0.001 * F.length(text))


def looks_like_json(text: Column) -> Column:
    return F.ltrim(text).rlike(r"^\s*[{\[]")


#: What tells a C++ header from a C one. Fixed value.
CPP_HEADER = r"\b(class|namespace|template)\b|::|\b(public|private|protected):"


def sniffed_language(path: Column, text: Column) -> Column:
    """The language by name and, for headers and files of no known name, by what the text holds."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 8192)
    by_name = language_of(path)
    return (
        F.when(F.lower(path).endswith(".h") & head.rlike(CPP_HEADER), "cpp").when((by_name == "text") & F.coalesce(looks_like_json(text), F.lit(False)), "json")
        .otherwise(by_name)
    )


def language_of(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)
    out = F.lit("text")
    for s, language in LANGUAGES.items():
        out = F.when(suffix == s, F.lit(language)).otherwise(out)
    return out


def index_decisions(artifacts: DataFrame) -> DataFrame:
    """(id, reason): why a file isn't indexed; ``indexed`` where it is. The first reason that holds counts."""
    text, path = F.coalesce("text", F.lit("")), F.col("file_path")
    reason = (
        F.when(is_excluded(path), "excluded").when(is_sensitive(path), "sensitive").when(~is_readable(text), "unreadable")
        .when(has_secret(text), "secret").when(is_generated(text), "generated").otherwise("indexed")
    )
    return artifacts.select("id", reason.alias("reason"))


def sliding_chunks(rows: DataFrame, size: int = 200, overlap: int = 50) -> DataFrame:
    """(id, start, line_start, line_end, chunk): windows of ``size`` characters, each beginning ``size - overlap`` after the last."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(step))
    chunk = F.substring("text", F.col("start") + 1, F.lit(size))
    lines = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))
    first = lines(F.substring("text", F.lit(1), F.col("start"))) + 1
    return rows.filter(F.char_length("text") > 0).select("id", "text", F.explode(starts).alias("start")).select(
        "id", "start", first.alias("line_start"), (first + lines(chunk)).alias("line_end"), chunk.alias("chunk")
    )


def text_heads(rows: DataFrame, most: int = 4000) -> DataFrame:
    """(id, text, line_end): the first ``most`` characters of texts that aren't blank."""
    head = F.substring("text", 1, most)
    return rows.filter(F.trim(F.regexp_replace(head, r"\s+", " ")) != "").select("id", head.alias("text"), T.line_count(head).alias("line_end"))


def json_leaves(rows: DataFrame, column: str) -> DataFrame:
    """(id, key, value): the top-level leaves of a JSON object column."""
    pairs = F.from_json(column, "map<string,string>")
    return rows.select("id", F.explode(pairs).alias("key", "value"))


def markdown_cells(rows: DataFrame) -> DataFrame:
    """(id, line_no, col, cell): the cells of pipe tables in a text; separator rows are left out."""
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tables = lines.filter(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:\-]+$"))
    inner = F.regexp_replace("line", r"^\s*\||\|\s*$", "")
    return tables.select("id", (F.col("line_no") + 1).alias("line_no"), F.posexplode(F.split(inner, r"\|")).alias("col", "cell")).select(
        "id", "line_no", "col", F.trim("cell").alias("cell")
    )


def json_tree_leaves(rows: DataFrame) -> DataFrame:
    """(id, path, value, type): every leaf of the JSON documents ``rows(id, text)``, with its path (``$.a.b[0]``).

    A level is opened per step, for all documents at once; texts that aren't JSON give no rows.
    """
    spark = rows.sparkSession
    frontier = rows.select("id", F.lit("$").alias("path"), F.try_parse_json("text").alias("v"))
    leaves = None
    while True:
        opened = frontier.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
            "id", F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.format_string("[%d]", "pos"))).alias("path"),
            F.schema_of_variant("value").alias("type"), F.to_json("value").alias("json"), F.col("value").cast("string").alias("value"),
        )
        level = write_table(opened, "json-level")
        inner = level.filter(F.col("type").rlike("^(OBJECT|ARRAY)<"))
        found = level.filter(~F.col("type").rlike("^(OBJECT|ARRAY)<")).select("id", "path", "value", "type")
        leaves = found if leaves is None else leaves.unionByName(found)
        if inner.isEmpty():
            break
        frontier = inner.select("id", "path", F.parse_json("json").alias("v"))
    return leaves
