"""Problem 10: texts cut off by field limits or in transfer.

Near copies are found by min-hash banding over five-word shingles, verified, and their ends are aligned: the copy whose
last words lie before the other's end, not at the end of a sentence, was cut. Only records that no alignment calls cut are
then scored by how they close: marks that tools append, open code blocks and brackets, sentences without an end, lengths
at a limit of their source, and closing words that the corpus knows only as the beginnings of others.

Defined results: null, empty and blank texts and placeholders are no cases; equal texts are judged once and all their
ids come out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.hot import pairs_sharing
from fathom.llm.pairs import is_empty
from fathom.llm.prose import CUT_MARK, ALL_FUNCTION_WORDS, has_function_words, last_line, odd_marks, tail
from fathom.session import write_table

#: A length is a source's limit if so many open-ended texts have it, and so many times the mean of the lengths around.
SPIKE_ROWS, SPIKE_TIMES, SPIKE_AROUND = 6, 8, 10

#: Words at the end of a text that are aligned with its near copies, and edits within them.
TAIL, EDITS = 12, 3

#: Words per shingle, least similarity of near copies, bands, hashes per band. Misses a pair of 0.8 with p = 0.0003.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 14, 4

_TERMINAL = re.compile(r"[.!?。？！]['\"”’»)\]*_]*\Z")
_CLOSED = re.compile(r"(?:[.!?。？！]['\"”’»)\]*_]*|```)\Z")
_DOTS = re.compile(r"\s*(?:\.\.\.|…)\Z")
_WORD = re.compile(r"\w+")
_ENTRY = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_PATH = re.compile(r"(?:^|[\s(`])[\w.\-]+/[\w./\-]*\w\.[A-Za-z]\w{0,5}`?\Z")
_URL = re.compile(r"https?://\S+\Z")
_ARGUMENT = re.compile(r"\s+\w+ \([^()]*\): \w+ \w+ \w+\Z")
_SIGNED = re.compile(r"\s*(?:--|—) ?\w+(?: \w+){0,4}\Z", re.I)
_TRAILER = re.compile(r"[A-Z][\w\-]+: (?:[A-Z]+[-/]\d+|#\d+|\S+@\S+|[\w.\- ]+ <[^>]+>)\Z")
_FRAME = re.compile(r"\s+File \"|\s+at \S+\(")
_ERROR = re.compile(r"[A-Z]\w*(?:Error|Exception|Warning|Fault)(?:: .*)?\Z")


def judge(text: str) -> tuple[bool | None, str | None]:
    """(cut, closing word): None with a word where the corpus must tell whether the word is one."""
    stripped = text.rstrip().rstrip("​﻿\x00").rstrip()
    if not _WORD.search(stripped) or is_empty(stripped):
        return False, None
    end = last_line(stripped)
    if end.endswith("�") or CUT_MARK.search(end) or _DOTS.search(end):
        return True, None
    if stripped.count("```") % 2:
        return True, None
    line = last_line(stripped)
    if line.strip() == "```":
        return False, None
    if _FRAME.match(line):
        return True, None
    if _TERMINAL.search(line):
        rest = tail(line)
        return odd_marks(stripped) or bool(re.search(r"\b[vV]ersion \d+\.\Z|\w/[\w/]+\.\Z", rest)), None
    if line.endswith((",", ";", "(", "[", "{", "=", "/", "\\", "_", "+", "&", "'", '"', "#", "`-", " -", ":")):
        return not line.endswith((":", "'", '"')) or odd_marks(stripped), None
    entry = _ENTRY.match(line)
    body = line[entry.end() :] if entry else line
    if not body.strip():
        return True, None
    if _URL.search(body):
        return None, _WORD.findall(body)[-1].lower()
    if body.lstrip().startswith("$ ") or _PATH.search(body):
        return not _PATH.search(body), None
    if _ERROR.match(body):
        return None, _WORD.findall(body)[-1].lower()
    if "\n  File " in stripped and re.fullmatch(r"\w+", line):
        return True, None
    if _TRAILER.match(body):
        return False, None
    if odd_marks(stripped):
        return True, None
    words = _WORD.findall(body)
    if _ARGUMENT.match(line):
        return None, words[-1].lower()
    if _SIGNED.match(line):
        return words[-1].lower() in ALL_FUNCTION_WORDS, None
    if line.startswith(("# ", "## ", "### ")):
        return None, words[-1].lower()
    if re.search(r"\(#?\w[\w\-]*\)\Z", body):
        return False, None
    rest = tail(body)
    if has_function_words(rest):
        return True, None
    if rest != body and not body.endswith(")") and has_function_words(body):
        return None, words[-1].lower()
    return None, (words[-1].lower() if words and not body.endswith(")") else None)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] | np.uint64(1)


def unmarked(text: str) -> str:
    """The text without the mark that a tool appended."""
    text = text.rstrip()
    at = text.rfind("\n") + 1
    return (text[:at] + CUT_MARK.sub("", text[at:])).rstrip()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bands(words: list[str], hashes: dict[str, int]) -> list[int]:
    """One key per band of the min-hash signature of the five-word shingles; none below five words."""
    if len(words) < SHINGLE:
        return []
    for w in words:
        if w not in hashes:
            hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.array([hashes[w] for w in words], np.uint64)
    with np.errstate(over="ignore"):
        s = h[: len(h) - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            s = _mix(s) + h[i : len(h) - SHINGLE + 1 + i]
        s = np.unique(_mix(s))
        # the shingles' hashes are mixed already: one multiplication by an odd number gives each its own order
        least = (s[:4096] * _SEEDS).min(axis=1)
        for i in range(4096, len(s), 4096):
            np.minimum(least, (s[i : i + 4096] * _SEEDS).min(axis=1), out=least)
        key = _SEEDS[::ROWS, 0].copy()
        for r in range(ROWS):
            key = _mix(key + least[r::ROWS])
    return key.view(np.int64).tolist()


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes: dict[str, int] = {}
    for batch in batches:
        if len(hashes) > 1_000_000:
            hashes.clear()
        words = [words_of(unmarked(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([bands(w, hashes) for w in words], pa.list_(pa.int64())),
                pa.array([len(set(zip(*(w[i:] for i in range(SHINGLE))))) for w in words], pa.int32()),
            ],
            ["content", "bands", "n"],
        )


def _judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdicts = [judge(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([v[0] for v in verdicts], pa.bool_()), pa.array([v[1] for v in verdicts], pa.string())],
            ["content", "cut", "closing"],
        )


def _aligned_end(x: list[str], y: list[str]) -> int | None:
    """Where in ``y`` the last words ``x`` of a text end, by the alignment of least edits; the last such place."""
    last = x[-SHINGLE:]
    for at in range(len(y) - SHINGLE, -1, -1):
        if y[at : at + SHINGLE] == last:
            return at + SHINGLE - 1
    # semi-global edit distance: any beginning in y is free, and the last word of x may be the beginning of y's
    row = [0] * (len(y) + 1)
    for i, w in enumerate(x):
        above, row = row, [i + 1]
        closing = i == len(x) - 1
        for j, v in enumerate(y):
            same = v.startswith(w) if closing else v == w
            row.append(min(above[j] + (not same), above[j + 1] + 1, row[j] + 1))
    least = min(row)
    if least > EDITS or 2 * least >= len(x):
        return None
    return max(j for j, d in enumerate(row) if d == least) - 1


def ends_early(a: str, b: str) -> bool:
    """Whether ``a`` breaks off where ``b``, a near copy, goes on.

    The last words of ``a`` are aligned with ``b``. Nothing is missing where ``b`` ends there, too, or where both end a sentence.
    """
    a = _DOTS.sub("", unmarked(a)).rstrip("� \n")
    x, spans = list(_WORD.finditer(a.lower())), list(_WORD.finditer(b.lower()))
    y = [m[0] for m in spans]
    if len(x) < SHINGLE + 1 or len(y) <= SHINGLE + 1:
        return False
    at = _aligned_end([m[0] for m in x[-TAIL:]], y)
    if at is None or at < 0:
        return False
    if y[at] != x[-1][0] and y[at].startswith(x[-1][0]):
        return not _TERMINAL.search(a)  # within a word
    if at + 1 >= len(y):
        return False
    if not _CLOSED.search(a):
        return True
    # a mark closes a sentence only if it stands before a blank in the copy, too
    return not re.match(r"[\W_]*[.!?。？！`'\"”’»)\]*_]+\s|\s*\n", b[spans[at].end() : spans[at + 1].start()])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cut = []
        for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = words_of(unmarked(ta)), words_of(unmarked(tb))
            s = {tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)}
            t = {tuple(y[i : i + SHINGLE]) for i in range(len(y) - SHINGLE + 1)}
            if len(s & t) < SIMILAR * len(s | t):
                continue
            if ends_early(ta, tb):
                cut.append(a)
            if ends_early(tb, ta):
                cut.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["content"])


def _open(column: str) -> F.Column:
    """Whether a text lacks a terminal mark or a closed block at its end: only such copies can have been cut."""
    return ~F.rtrim(column).rlike(r"([.!?。？！]['\"”’»)\]*_]*|```)$")


def at_limits(rows: DataFrame) -> DataFrame:
    """(content) of the open-ended texts of ``rows(content, source, text)`` whose length is a limit of their source."""
    ended = rows.filter(_open("text")).select("content", "source", F.length("text").alias("n_chars")).distinct()
    counts = ended.groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    band = F.floor(F.col("n_chars") / 4096)
    around = Window.partitionBy("source", band).orderBy("n_chars").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    mean = (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_AROUND)
    limits = counts.withColumn("mean", mean).filter(
        (F.col("n") >= SPIKE_ROWS) & (F.col("n") > SPIKE_TIMES * F.col("mean"))
    )
    return ended.join(limits.select("source", "n_chars"), ["source", "n_chars"], "left_semi").select("content")


def cut_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, reason) of the documents whose text ends before its content does."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("content"), F.col(text_col).alias("text"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
    )
    texts = write_table(rows.groupBy("content").agg(F.min("text").alias("text")), "texts")
    # near copies first: texts are joined only with the pairs whose numbers of shingles allow the similarity
    banded = write_table(texts.mapInArrow(_band_rows, "content binary, bands array<long>, n int"), "bands")
    pairs = pairs_sharing(banded.select(F.col("content").alias("x"), "n", F.explode("bands").alias("key")), SIMILAR)
    candidates = (
        pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    early = write_table(candidates.mapInArrow(_verify, "content binary").distinct(), "early-ends")
    # then the closing of all others
    others = texts.join(early, "content", "left_anti")
    judged = write_table(others.mapInArrow(_judge_rows, "content binary, cut boolean, closing string"), "judged")
    # words that stand before another word of their line, by distinct texts
    inner = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]++)(?=[^\p{L}\p{N}_\n]+[\p{L}\p{N}_])"), F.lit(1)))
    asked = judged.filter(F.col("cut").isNull() & F.col("closing").isNotNull()).select("content", "closing")
    wanted = asked.select(F.col("closing").alias("word")).distinct()
    known = (
        texts.select(F.explode(inner).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .join(wanted, "word", "left_semi").filter(F.col("n") >= 2)
    )
    fragments = (
        asked.filter(~F.col("closing").rlike(r"^[\d_]+$"))
        .join(known.select(F.col("word").alias("closing")), "closing", "left_anti").select("content")
    )
    reasons = (
        early.withColumn("reason", F.lit("alignment"))
        .unionByName(judged.filter("cut").select("content", F.lit("closing").alias("reason")))
        .unionByName(fragments.withColumn("reason", F.lit("fragment")))
        .unionByName(at_limits(rows).withColumn("reason", F.lit("limit")))
        .groupBy("content").agg(F.min("reason").alias("reason"))
    )
    return rows.select("doc_id", "content").join(reasons, "content").select("doc_id", "reason").distinct()


def cut_rates(docs: DataFrame) -> DataFrame:
    """(source, reason, texts, cut, rate): how often each source cuts its texts, in all and by what told."""
    cut = cut_texts(docs)
    known = docs.filter(F.col("text").isNotNull()).select("doc_id", "source")
    texts = known.groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    found = known.join(cut, "doc_id").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("cut"))
    total = found.groupBy("source").agg(F.sum("cut").alias("cut")).withColumn("reason", F.lit("all"))
    none = texts.select("source", F.lit("all").alias("reason"), F.lit(0).cast("long").alias("cut"))
    counts = found.unionByName(total).unionByName(none).groupBy("source", "reason").agg(F.sum("cut").alias("cut"))
    return counts.join(texts, counts["source"].eqNullSafe(texts["source"])).select(
        counts["source"], "reason", "texts", "cut", F.round(F.col("cut") / F.col("texts"), 4).alias("rate")
    )
