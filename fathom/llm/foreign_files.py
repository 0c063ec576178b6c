"""Problem 1: generated, minified and vendored files, and data saved as code.

Files with the same text are one until the end. An inverted index of line hashes, with the number of texts that hold each
line, points every rare line at the first and the last text that has it and at the published files that have it. Texts are
compared exactly, over all their lines, with those that most of their rare lines point at, which settles most copies without
forming all pairs of a library's copies. Every text that isn't settled by that is compared with all texts that share one of
its rarest lines (or one of theirs), so many of them that no text with enough common lines can be missed; a frequent line is
split over tasks. Texts of few lines are compared as wholes. Only what is left is judged by the composition of its tokens.

Defined results: null and empty texts are no cases; a repeated file row counts once (the least of different texts); other
columns are ignored; of several reasons the method's first one counts: published, copied, composition.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathom.session import write_table

#: The languages whose files are judged, and the kinds of whole files.
LANGUAGES = ("python", "javascript", "typescript", "go", "java", "cpp")
FILE_KINDS = ("module", "json-document", "chunk")

#: Shorter lines tell nothing; files of fewer lines than LEAST_LINES are compared as whole texts of WHOLE_CHARS at least.
LINE_CHARS, LEAST_LINES, WHOLE_CHARS = 15, 6, 80

#: Least share of a file's lines in a published file, and in a file of another repository.
FROM_PUBLISHED, FROM_REPOSITORY = 0.5, 0.8

#: Share of the larger file's lines that makes it a copy of the smaller one, too.
OF_LARGER = 0.6

#: Share of its lines that a file must have in common with one candidate before the first exact comparison.
CANDIDATE_SHARE = 0.25

#: Lines of more texts than this point at no candidates in the first comparison; the second one is exact without a bound.
RARE = 200

#: A line of more holders is split: a task pairs so many of them with the texts that look for the line.
HOLDERS = 1000

#: Where tools sign: the first lines of a file.
HEAD_LINES = 12

_VENDOR_PATH = re.compile(r"(?:^|/)(?:vendor|third_party|third-party|3rdparty|node_modules|external|deps|bower_components)/[^/]+/")
_LICENCE = re.compile(r"copyright \(?c?\)?|©|licen[cs]ed? under|permission to use, copy", re.I)
_ATOM = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\d[\w.]*|[A-Za-z_$][\w$]*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])-?\d[\w.]*|[,\s]")
_ASSIGNED = re.compile(r"[=:(]\s*(?:new\s+)?[\w\[\]<>]*\s*[\[{(]|\b(?:=|return)\s*[\"'`]|export default")
_GENERATED = re.compile(
    r"generated by|generated from|auto-?generated|@generated|machine output|do not (?:edit|modify)|automatisch\b.*\berzeugt|"
    r"nicht bearbeiten|fichier (?:produit|généré)|ne pas modifier|generado (?:por|autom)|no (?:editar|modificar)|schema hash",
    re.I,
)


def _shape(m: re.Match) -> str:
    c = m[0][0]
    return "S" if c in "\"'" else "0" if c.isdigit() else "x"


def composition(path: str, text: str) -> str | None:
    """``generated``, ``minified``, ``data`` or ``vendored`` where the tokens of a file (and its path) tell; else None."""
    body = text.strip()
    if not body:
        return None
    lines = body.split("\n")
    head = "\n".join(lines[:HEAD_LINES])
    if _VENDOR_PATH.search(path) and _LICENCE.search(body):
        return "vendored"
    literal = sum(m.end() - m.start() for m in _LITERAL.finditer(body))
    if literal >= 0.9 * len(body) and len(body) > 300 and _ASSIGNED.search(body):
        return "data"
    long = sum(len(x) for x in lines if len(x) > 120)
    if long > 0.5 * len(body) and len(body) / len(lines) > 100:
        spaces = body.count(" ") / len(body)
        marks = sum(body.count(c) for c in "(){};=,.") / len(body)
        if spaces < 0.09 and marks > 0.12:
            return "minified"
    shapes = Counter(s for x in lines if len(x.strip()) > 3 and (s := _ATOM.sub(_shape, x.strip())))
    total = sum(shapes.values())
    common = sum(n for _, n in shapes.most_common(6))
    if total >= 10 and common >= 0.85 * total and len(shapes) <= max(12, 0.2 * total):
        coded = sum(any(c in x for c in "(){}[];") for x in lines)
        words = len(re.findall(r"[a-z]{2,} [a-z]{2,} [a-z]{2,}", body))
        if words < 0.5 * len(lines) and coded > 0.4 * len(lines):
            return "generated"
    if _GENERATED.search(head) and total >= 6 and common >= 0.7 * total:
        return "generated"
    return None


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = pa.array([composition(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.string())
        keep = kinds.is_valid()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep), kinds.filter(keep)], ["repository", "file_path", "reason"]
        )


def _lines(text: str) -> F.Column:
    """Hashes of the distinct lines of a text that are long enough to tell something."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: F.length(x) >= LINE_CHARS)), lambda x: F.xxhash64(x))


def _overlaps(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(file, other, shared, n, m): exact numbers of common lines of ``pairs(file, other)``."""
    a = files.select("file", F.col("hashes").alias("x"))
    b = files.select(F.col("file").alias("other"), F.col("hashes").alias("y"))
    joined = pairs.join(a, "file").join(b, "other")
    return joined.select(
        "file", "other", F.size(F.array_intersect("x", "y")).alias("shared"), F.size("x").alias("n"), F.size("y").alias("m")
    )


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("other").alias("file"), F.col("file").alias("other"))).distinct()


def _held(index: DataFrame, counted: DataFrame) -> DataFrame:
    """(other, line, part): the holders of the lines of ``counted(line, parts)``, frequent lines in parts."""
    return index.join(counted, "line").select(F.col("file").alias("other"), "line", F.pmod(F.xxhash64("file"), F.col("parts")).cast("int").alias("part"))


def foreign_files(artifacts: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repository, file_path, reason) of the files that aren't hand-written source of their repository."""
    rows = artifacts.filter(
        F.col("kind").isin(*FILE_KINDS) & F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull()
    ).groupBy("repository", "file_path").agg(F.min("text").alias("text"))
    # one row per different text; ``file`` is its number
    texts = write_table(
        rows.groupBy(F.unhex(F.md5(F.col("text").cast("binary"))).alias("content")).agg(
            F.min("text").alias("text"), F.array_distinct(F.array(F.min("repository"), F.max("repository"))).alias("homes")
        ).withColumn("file", F.monotonically_increasing_id()), "different-texts",
    )
    places = write_table(
        rows.select("repository", "file_path", F.unhex(F.md5(F.col("text").cast("binary"))).alias("content"))
        .join(texts.select("content", "file"), "content").select("repository", "file_path", "file"), "places",
    )
    lined = texts.select("file", "homes", _lines("text").alias("hashes"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("whole"))
    files = write_table(lined.filter(F.size("hashes") >= LEAST_LINES).select("file", "homes", "hashes", F.size("hashes").alias("n")), "line-hashes")
    index = files.select("file", F.explode("hashes").alias("line"))
    counted = write_table(index.groupBy("line").agg(
        F.count(F.lit(1)).alias("holders"), F.min("file").alias("first"), F.max("file").alias("last")
    ), "line-counts")
    rare = counted.filter(F.col("holders") <= RARE)

    # published files: bounded by the table of published files
    of_published = upstream.select(F.col("file_no").alias("published"), F.explode(_lines("body")).alias("line"))
    taken = write_table(
        index.join(of_published, "line").groupBy("file", "published").agg(F.count(F.lit(1)).alias("shared"))
        .join(files.select("file", "n"), "file").filter(F.col("shared") >= FROM_PUBLISHED * F.col("n")).select("file").distinct(), "taken",
    )

    # the same text in several repositories
    same = files.filter(F.size("homes") > 1).select("file")

    # other texts: each rare line points at the first and the last one that has it
    pointed = (
        index.join(rare.filter("holders > 1").select("line", "first", "last"), "line")
        .select("file", F.explode(F.array_distinct(F.array("first", "last"))).alias("other")).filter("file <> other")
        .groupBy("file", "other").agg(F.count(F.lit(1)).alias("votes"))
        .join(files.select("file", "n"), "file").filter(F.col("votes") >= CANDIDATE_SHARE * F.col("n"))
    )

    def compared(pairs: DataFrame) -> DataFrame:
        """(file, other, abroad): pairs of enough common lines, and whether they lie in different repositories."""
        exact = _overlaps(pairs, files).filter(
            (F.col("shared") >= FROM_REPOSITORY * F.least("n", "m"))
            # a file that holds a small one and much more isn't its copy
            & ((F.col("n") <= F.col("m")) | (F.col("shared") >= OF_LARGER * F.col("n")))
        ).select("file", "other")
        a = files.select("file", F.col("homes").alias("x"))
        b = files.select(F.col("file").alias("other"), F.col("homes").alias("y"))
        apart = (F.size("x") > 1) | (F.size("y") > 1) | (F.get("x", F.lit(0)) != F.get("y", F.lit(0)))
        return exact.join(a, "file").join(b, "other").select("file", "other", apart.alias("abroad"))

    first = write_table(compared(_turned(pointed.select("file", "other"))), "copies")
    settled = write_table(taken.unionByName(same).unionByName(first.filter("abroad").select("file")).distinct(), "settled")
    # a file of n lines shares one of its n - 0.8 n + 1 rarest with every file that has 0.8 n of its lines
    ordered = index.join(counted.select("line", "holders"), "line").groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("holders", "line"))).alias("x")
    )
    n = F.size("x")
    rarest = write_table(
        ordered.select("file", F.explode(F.slice("x", 1, n - F.ceil(n * FROM_REPOSITORY).cast("int") + 1)).alias("x"))
        .select("file", "x.line", F.ceil(F.col("x.holders") / HOLDERS).cast("int").alias("parts"), "x.holders").filter("holders > 1").select("file", "line", "parts"),
        "rarest-lines",
    )
    held = _held(index, rarest.select("line", "parts").distinct())
    asking = rarest.select("file", "line", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    unsettled = files.select("file").join(settled, "file", "left_anti")
    of_open = asking.join(unsettled, "file", "left_semi").join(held, ["line", "part"])
    of_others = asking.join(settled, "file", "left_semi").join(
        held.join(unsettled.select(F.col("file").alias("other")), "other", "left_semi"), ["line", "part"]
    )
    sharing = of_open.unionByName(of_others).filter("file <> other").select("file", "other").distinct()
    copies = write_table(first.unionByName(compared(_turned(sharing))), "all-copies")
    known_abroad = write_table(copies.filter("abroad").select("file").unionByName(same).distinct(), "known-abroad")
    # a copy within the same repository of a file that is known abroad
    beside = (
        copies.filter(~F.col("abroad")).select("file", F.col("other").alias("f"))
        .join(known_abroad.select(F.col("file").alias("f")), "f", "left_semi").select("file").distinct()
    )

    # files of few lines, as whole texts
    few = write_table(
        lined.filter((F.size("hashes") < LEAST_LINES) & (F.length("whole") >= WHOLE_CHARS))
        .select("file", "homes", F.unhex(F.md5(F.col("whole").cast("binary"))).alias("whole")), "whole-texts",
    )
    abroad = few.select("whole", F.explode("homes").alias("home")).groupBy("whole").agg(F.min("home").alias("r1"), F.max("home").alias("r2")).filter("r1 <> r2")
    bodies = upstream.select(F.unhex(F.md5(F.trim(F.regexp_replace("body", r"\s+", " ")).cast("binary"))).alias("whole"))
    alike = few.join(abroad.select("whole").unionByName(bodies), "whole", "left_semi").select("file")
    reason = lambda df, order, name: df.select("file", F.struct(F.lit(order).alias("order"), F.lit(name).alias("reason")).alias("r"))
    copied = write_table(
        reason(taken, 0, "vendored: published").unionByName(reason(known_abroad, 1, "vendored: copied")).unionByName(reason(beside, 2, "vendored: beside"))
        .unionByName(reason(alike, 1, "vendored: copied")).groupBy("file").agg(F.min("r").alias("r")).select("file", "r.reason"), "copied",
    )
    # what is left, by its tokens, at each of its places
    left = texts.select("file", "text").join(copied.select("file"), "file", "left_anti")
    composed = places.join(left, "file").select("repository", "file_path", "text").mapInArrow(
        _compose, "repository string, file_path string, reason string"
    )
    return places.join(copied, "file").select("repository", "file_path", "reason").unionByName(composed)
