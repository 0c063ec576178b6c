"""Problem 7: cutting oversized texts at natural boundaries, with overlap.

Lexical cohesion: at every line end the words of the lines before are compared with those of the lines after; valleys
of that similarity mark boundaries. Each cut takes the deepest valley within the window that the size limit leaves. What
counts as deeper beside the words depends on the row's ``kind``: beginnings of definitions, blank lines and less indented
lines in source, ends of members in JSON, headings and paragraphs in prose. Where a window has no line end, the cut is at
the last sentence end, else at the last white space, else at the limit.

Defined results: null texts and texts within the limit give no row; a repeated id is cut once (of different texts the
least); a null or unknown kind counts as prose; lengths count code points; lines are separated by \\n and numbered from the
row's ``line_start`` (1 where null).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 4000, 200

#: Lines on each side of a boundary whose words are compared.
BLOCK_LINES = 8

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?。！？][\"')\]]*\s")


class Boundary(NamedTuple):
    """How much deeper a valley is at each sort of line end, and how the line after it begins."""

    indent: float
    blank: float
    opens: float
    closes: float
    opening: re.Pattern
    closing: re.Pattern


_CODE = Boundary(
    1.0, 0.4, 0.3, 0.1,
    re.compile(r"(?:@|def|class|func|function|export|public|private|protected|static|interface|type|struct|async|package|import|namespace|template)\b"),
    re.compile(r"[}\])]+[;,]?\Z"),
)
_JSON = Boundary(1.0, 0.1, 0.1, 0.3, re.compile(r"\"[^\"]*\":"), re.compile(r".*[}\]],\Z"))
_PROSE = Boundary(0.2, 0.5, 0.4, 0.2, re.compile(r"#{1,6} |\d+[.)] |[-*+] |=+\Z"), re.compile(r".*[.!?。！？:]\Z"))


def boundary_of(kind: str | None) -> Boundary:
    if kind == "json-document":
        return _JSON
    if kind == "module" or kind and ("function" in kind or "method" in kind or "class" in kind):
        return _CODE
    return _PROSE


def cohesion(lines: list[str]) -> np.ndarray:
    """Similarity of the lines before and after each of the ``len(lines) - 1`` inner line ends.

    The counts of the two blocks slide over the lines: what is held grows with the different words, not with their product.
    """
    places: dict[str, int] = {}
    words = [[places.setdefault(w, len(places)) for w in _WORD.findall(x)] for x in lines]
    before, after = [0] * len(places), [0] * len(places)
    dot = square_before = square_after = 0
    for line in words[:BLOCK_LINES]:
        for w in line:
            square_after += 2 * after[w] + 1
            after[w] += 1
    similar = np.zeros(max(len(lines) - 1, 0))
    for i in range(1, len(lines)):
        for w in words[i - 1]:
            # the line goes from the block after to the block before
            b, a = before[w], after[w]
            dot += a - 1 - b
            square_after -= 2 * a - 1
            square_before += 2 * b + 1
            before[w], after[w] = b + 1, a - 1
        if i + BLOCK_LINES <= len(lines):
            for w in words[i + BLOCK_LINES - 1]:
                dot += before[w]
                square_after += 2 * after[w] + 1
                after[w] += 1
        if i > BLOCK_LINES:
            for w in words[i - BLOCK_LINES - 1]:
                dot -= after[w]
                square_before -= 2 * before[w] - 1
                before[w] -= 1
        if square_before and square_after:
            similar[i - 1] = dot / (square_before * square_after) ** 0.5
    return similar


def cut_points(text: str, kind: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[(from, to)) of the pieces of ``text``, in code points."""
    if len(text) <= limit:
        return [(0, len(text))]
    lines = text.split("\n")
    starts = np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])
    if len(lines) > 1:
        at = boundary_of(kind)
        indents = np.array([len(x) - len(x.lstrip()) if x.strip() else -1 for x in lines])
        blank = indents[:-1] < 0
        opens = np.array([bool(at.opening.match(x.lstrip())) for x in lines[1:]])
        close = np.array([bool(at.closing.match(x.strip())) for x in lines[:-1]])
        score = (
            cohesion(lines) + at.indent * np.clip(indents[1:], 0, 12) / 24 - at.blank * blank - at.opens * opens - at.closes * close
            + 0.5 * (indents[1:] < 0)
        )
    pieces, at = [], 0
    while len(text) - at > limit:
        low, high = at + max(limit // 2, overlap + 1), at + limit
        first, last = np.searchsorted(starts, [low, high + 1])
        first = max(first, 1)
        if last > first:
            cut = int(starts[first + int(np.argmin(score[first - 1 : last - 1]))])
        else:
            window = text[low:high]
            sentence = max((m.end() for m in _SENTENCE.finditer(window)), default=0)
            cut = (sentence or max((m.end() for m in re.finditer(r"\s", window)), default=limit - (low - at))) + low
        pieces.append((at, cut))
        at = cut - overlap
    pieces.append((at, len(text)))
    return pieces


def _cut(limit: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, text, kind, first in zip(*(c.to_pylist() for c in batch.columns)):
                line, counted = first or 1, 0
                for i, (start, end) in enumerate(cut_points(text, kind, limit, overlap)):
                    line += text.count("\n", counted, start)
                    counted = start
                    last = line + text.count("\n", start, max(start, end - 1))
                    for column, value in zip(out, (id_, i, text[start:end], line, last)):
                        column.append(value)
            types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], _NAMES)

    return cut


_NAMES = ["id", "piece", "text", "line_start", "line_end"]


def split_oversized(artifacts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, text, line_start, line_end) of every id of ``artifacts`` whose text is longer than ``limit``."""
    long = artifacts.filter(F.char_length("text") > limit).groupBy("id").agg(F.min(F.struct("text", "kind", "line_start")).alias("r"))
    return long.select("id", "r.text", "r.kind", "r.line_start").mapInArrow(
        _cut(limit, overlap), "id string, piece int, text string, line_start int, line_end int"
    )


def oversized(artifacts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id) of the rows that were cut into more than one piece."""
    return split_oversized(artifacts, limit, overlap).filter(F.col("piece") == 1).select("id")
