"""Problem 4: credentials in source code and configuration, found and redacted.

Literals that stand in a credential's place are indexed over the whole corpus; those shared by many owners are
placeholders and dropped; of the rest, values structured like credentials are confirmed. Then every text is scanned
again for the confirmed values by an automaton, so that a value is found where nothing names it, too.

Defined results: null and empty texts have no findings; a repeated row gives its findings once; ties and other columns
don't matter; line numbers count from 1 by \\n. A private key block counts on its BEGIN line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathom.session import spread, write_table

#: A value that this many repositories hold is a placeholder or a published example.
SHARED_BY = 5

#: The automaton of one scan holds at most so many values; more take more scans. Of a value longer than NEEDLE_CHARS it
#: holds the beginning, and a hash decides on the whole.
AUTOMATON_VALUES, NEEDLE_CHARS = 100_000, 256

#: Values from so many characters on are found within words, too.
WITHIN_WORDS = 12

#: A key block that breaks off is compared with shared blocks by so many characters (the first 82 of all unencrypted
#: OpenSSH keys of a kind are equal).
BROKEN_CHARS = 128

#: What lines must hold to be looked at.
_INTERESTING = re.compile(
    r"pass|pwd|kennwort|contrase|senha|parol|secret|token|key|cred|auth|bearer|basic |BEGIN |eyJ|://[^\s/\"'@]+:[^\s/\"'@]+@"
    r"|[\"'= ][A-Za-z0-9]{2,8}[_.\-](?:live_|prod_)?[A-Za-z0-9]{20,}",
    re.I,
)

_NAMED = re.compile(
    r"""(?<![\w+/=])(?<!\w[\-.])(?P<name>[A-Za-z_][\w\-.]++)["'`]?\s*(?:\]\s*)?(?::\s*[A-Za-z_][\w<>\[\]. ]*=|:=|=>|=|:|,|\s)\s*
        (?:[rbuf]|std::string\(|String\()?(?P<quote>["'`])(?P<value>(?:(?!(?P=quote))[^\\\n]|\\.){6,})(?P=quote)
        (?:\s*[+.]?\s*(?P<q2>["'`])(?P<rest>(?:(?!(?P=q2))[^\\\n]|\\.){1,})(?P=q2))?""",
    re.X,
)
_BARE = re.compile(r"(?<![\w+/=])(?<!\w[\-.])(?P<name>[A-Za-z_][\w\-.]++)\s*(?:=|:)\s*(?P<value>[^\s\"'`{}()\[\],;<>$]{6,})(?=[\s;,]|$)")
_URL = re.compile(r"[a-z][a-z0-9+.\-]*://[^\s/\"'@:]*:(?P<value>[^\s/\"'@]+)@")
_HEADER = re.compile(r"\b(?:bearer|basic|token|apikey)[ :]+(?P<value>[A-Za-z0-9+/=._\-]{16,})", re.I)
_JWT = re.compile(r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}")
_PREFIXED = re.compile(r"(?<![\w/+.\-])[A-Za-z]{1,6}[A-Za-z0-9]{0,3}(?:[_\-](?:live|prod|test)?[_\-]?|\.)(?P<tail>[A-Za-z0-9]{20,})(?![\w/+])")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Base64 characters in group 1; escaped line ends and armour headers without a group.
_RUN = re.compile(r"\\[nrt]|(?m:^[ \t\"'`]*[A-Z][\w\-]+: .*$)|([A-Za-z0-9+/=]*[A-Za-z0-9][A-Za-z0-9+/=]*)")
_OPEN_BODY = re.compile(
    r"(?:\\[nr]|[A-Za-z0-9+/=]|[\"'`]\s*[+.,]?\s*[\"'`](?=(?:\\[nr])*[A-Za-z0-9+/=]{16})|[ \t]*\r?\n[\w\-]+: [^\n]*"
    r"|[ \t]*\r?\n[ \t]*(?=\r?\n|[A-Za-z0-9+/=]{16,}[ \t]*(?:[\r\n\"'`\\]|$)|[A-Za-z0-9+/]+={1,2}[ \t]*(?:[\r\n\"'`\\]|$)))*"
)

_PASSWORD_NAME = re.compile(
    r"(?:(?<![a-z])[Pp]ass|(?<!COM)PASS|(?<=[a-z])Pass)(?i:word|wd|phrase|code|wort)?(?![a-z])|(?i:passw(?:or)?d|pwd|kennwort|"
    r"mot_?de_?passe|contrase|senha|parol)"
)
_KEY_NAME = re.compile(r"secret|token|[_\-]key|key$|Key|KEY|^key|api|auth|bearer|cred|signing|signer", re.I)
_HARMLESS_NAME = re.compile(
    r"hint|field|pattern|regex|_name|Name|source|public|label|policy|revision|commit|integrity|checksum|sha\d|digest|"
    r"uuid|request|trace|_id$|Id$|fingerprint|format|prompt|length|file|path|icon|image",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^[<\[{$%*.#_\-]|^[xX]{4}|\$\{|\{\{|%\(|<[\w\- ]+>|(?i:your[_\-]|change[_\-]?me|example|dummy|placeholder|redacted|"
    r"replace|insert|todo|sample[_\-]|fake|^(?:test|none|null|true|false|secret|password)$)|(.)\1{5,}|^(?:vault|env|arn|file|ssm)[:/]"
)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_HEX = re.compile(r"[0-9a-f]{32,128}", re.I)
_BASE64 = re.compile(r"[A-Za-z0-9+/\-_]{22,}={0,2}")
_EMBEDDED = re.compile(r"data:|iVBORw0KGgo|/9j/|R0lGOD|UklGR|PHN2Zy|PD94bWw|AAABAA|JVBERi0|d09G[RM]|AAEAAAA|T1RUTw|LS0tLS1CRUdJTiBDRVJU")
_LIST = re.compile(r"\w+([,;|:])\w+(?:\1\w+){8,}\1?")
_REFERENCE = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)\w+)+\(?|https?://|/|[\w\-/]+\.\w{2,5}$")


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _keylike(value: str) -> bool:
    return bool(
        _UUID.fullmatch(value)
        or (_HEX.fullmatch(value) and _mixed(value))
        or (_BASE64.fullmatch(value) and _mixed(value) and (value.lower() != value or "_" not in value))
        or _JWT.fullmatch(value)
        or _PREFIXED.fullmatch(value)
    )


def _passwordlike(value: str) -> bool:
    if len(value) < 8 or any(c.isspace() for c in value) or not _mixed(value):
        return False
    return not re.fullmatch(r"[A-Za-z][a-z]*(?:_[a-z0-9]+)+|[A-Za-z_]\w*\(.*|\[.*", value)


def _placeholder(value: str) -> bool:
    """Words and runs of one character mark short values as placeholders; in long base64 they stand by chance."""
    if len(value) > 200 and _BASE64.fullmatch(value):
        return len(set(value)) < 16
    return bool(_PLACEHOLDER.search(value))


def structured(name: str, value: str) -> bool:
    """Whether a literal in the place of ``name`` is structured like a live credential."""
    if _EMBEDDED.match(value) or _LIST.fullmatch(value) or _placeholder(value) or (name and _HARMLESS_NAME.search(name)):
        return False
    if sum(c.isdigit() for c in name) > 2:
        return False  # a literal beside another one, not a name
    if _PASSWORD_NAME.search(name) and _passwordlike(value) and not _REFERENCE.match(value):
        return True
    if _KEY_NAME.search(name):
        return _keylike(value) or (
            _passwordlike(value) and len(value) >= 12 and value.lower() != value and not _REFERENCE.match(value)
        )
    return False


def _key_body(text: str, start: int) -> tuple[list[tuple[int, int]], bool]:
    """The spans of the base64 runs of the private key block whose BEGIN mark ends at ``start``, and whether it breaks off.

    Line breaks, quotes, operators and armour headers lie between the runs. A block without an END mark goes on as long as
    its lines do.
    """
    end, begin = _END.search(text, start), text.find("-----BEGIN", start)
    if end and not 0 <= begin < end.start():
        runs = [m.span(1) for m in _RUN.finditer(text, start, end.start()) if m[1] and _is_run(text, start, end.start(), *m.span(1))]
        others = re.sub(r"(?m)^[ \t\"'`]*[A-Z][\w\-]+: .*$|\\[nrt]|[\s\"'`+,.()|]", "", text[start : end.start()])
        if sum(e - s for s, e in runs) >= 0.6 * len(others):
            return runs, False
    stop = _OPEN_BODY.match(text, start).end()
    return [m.span(1) for m in _RUN.finditer(text, start, stop) if m[1]], True


def _is_run(text: str, low: int, high: int, start: int, end: int) -> bool:
    """Whether base64 characters are a line or a literal of a block, not a word of the code around it."""
    before, after = text[max(low, start - 2) : start], text[end : min(high, end + 40)].lstrip(" \t")
    return end - start >= 16 or bool(
        (not before or before[-1] in "\n\r\t \"'`" or re.fullmatch(r"\\[nrt]", before))
        and (not after or after[0] in "\n\r\"'`" or re.match(r"\\[nr]", after))
    )


def candidates(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, str, tuple[tuple[int, int], ...]]]:
    """(kind, value, spans) of the literals that begin on the line ``text[start:end]`` and may be credentials.

    The spans are the places in ``text``: both halves of a split literal, every run of a private key block.
    """
    found = []
    line = text[start:end]

    def add(kind: str, m: re.Match, group: str | int) -> None:
        found.append((kind, m[group], ((start + m.start(group), start + m.end(group)),)))

    for m in _PRIVATE.finditer(line):
        runs, broken = _key_body(text, start + m.end())
        found.append(("broken block" if broken else "block", "".join(text[i:j] for i, j in runs), tuple(runs)))
    for m in _URL.finditer(line):
        if not _PLACEHOLDER.search(m["value"]) and len(m["value"]) >= 4:
            add("url", m, "value")
    for m in _HEADER.finditer(line):
        if _mixed(m["value"]) and not _PLACEHOLDER.search(m["value"]):
            add("header", m, "value")
    for m in _JWT.finditer(line):
        add("token", m, 0)
    for m in _PREFIXED.finditer(line):
        tail = m["tail"]
        if _mixed(tail) and tail.lower() != tail and tail.upper() != tail and not _HEX.fullmatch(tail):
            add("token", m, 0)
    for m in _NAMED.finditer(line):
        value = m["value"] + (m["rest"] or "")
        if structured(m["name"], m["value"]):
            add("named", m, "value")
        elif m["rest"] and structured(m["name"], value):
            found.append(("split", value, _halves(m, start, 0, len(value))))
        elif m["rest"] and (u := _URL.search(value)) and not _PLACEHOLDER.search(u["value"]):
            found.append(("split", u["value"], _halves(m, start, *u.span("value"))))
        elif m["rest"] and (_JWT.fullmatch(value) or (_PREFIXED.fullmatch(value) and _mixed(value))):
            found.append(("split", value, _halves(m, start, 0, len(value))))
    for m in _BARE.finditer(line):
        if structured(m["name"], m["value"]):
            add("named", m, "value")
    return found


def _halves(m: re.Match, offset: int, low: int, high: int) -> tuple[tuple[int, int], ...]:
    """The places of the characters ``low`` to ``high`` of a literal written in two parts."""
    n, first, second = len(m["value"]), offset + m.start("value"), offset + m.start("rest")
    parts = (first + low, first + min(high, n)), (second + max(low - n, 0), second + high - n)
    return tuple((i, j) for i, j in parts if i < j)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per candidate literal."""
    for batch in batches:
        rows = []
        for id_, version, repository, text in zip(*(c.to_pylist() for c in batch.columns)):
            seen = -1
            for m in _INTERESTING.finditer(text):
                start = text.rfind("\n", 0, m.start()) + 1
                if start <= seen:
                    continue
                seen = start
                end = text.find("\n", m.start())
                found = candidates(text, start, end if end >= 0 else len(text))
                if found:
                    line_no = text.count("\n", 0, start) + 1
                    rows += [(id_, version, repository, line_no, kind, value, spans) for kind, value, spans in set(found)]
        columns = list(zip(*rows)) or [()] * 7
        columns[6] = [[{"start": i, "end": j} for i, j in spans] for spans in columns[6]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX.values())], list(_INDEX))


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_INDEX = {
    "id": pa.string(), "version": pa.int64(), "repository": pa.string(), "line_no": pa.int32(), "kind": pa.string(),
    "value": pa.string(), "spans": _SPANS,
}


def _versions(artifacts: DataFrame, *columns: str) -> DataFrame:
    """The texts, with a hash that tells the texts of one id apart: places count within one text."""
    rows = artifacts.filter(F.col("text").isNotNull())
    return rows.select("id", F.xxhash64("text").alias("version"), *columns, "text")


def literal_index(artifacts: DataFrame) -> DataFrame:
    """The candidate literals of every text and their places; written to the shared folder."""
    return write_table(
        spread(_versions(artifacts, "repository")).mapInArrow(
            _index,
            "id string, version long, repository string, line_no int, kind string, value string, spans array<struct<start: int, end: int>>",
        ),
        "literals",
    )


def confirmed(index: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """The rows of ``index`` whose value fewer than ``shared_by`` repositories hold.

    Values are compared by hashes, key blocks by their whole body. A block without a body has no owners; one that breaks off
    is shared if a shared block begins with it.
    """
    kept = index.withColumn("owned", F.when(F.length("value") > 0, F.sha2("value", 256)))
    owners = kept.filter("owned is not null").select("owned", "repository").distinct().groupBy("owned").agg(
        F.count(F.lit(1)).alias("owners")
    )
    shared = owners.filter(F.col("owners") >= shared_by).select("owned")
    head = F.substring("value", 1, BROKEN_CHARS).alias("head")
    shared_blocks = kept.filter(F.col("kind") == "block").join(shared, "owned", "left_semi").select(
        head, F.col("value").alias("whole")
    ).distinct()
    broken = kept.filter((F.col("kind") == "broken block") & (F.length("value") >= BROKEN_CHARS)).select("owned", head, "value")
    parts = broken.join(shared_blocks, "head").filter(F.col("whole").startswith(F.col("value"))).select("owned")
    return kept.join(shared.unionByName(parts), "owned", "left_anti").select(*index.columns)


@lru_cache(maxsize=1)
def _automaton(values: tuple[tuple[str, int, str | None], ...]):
    import ahocorasick

    by_needle: dict[str, list[tuple[int, str | None]]] = {}
    for needle, n, digest in values:
        by_needle.setdefault(needle, []).append((n, digest))
    a = ahocorasick.Automaton()
    for needle, wholes in by_needle.items():
        a.add_word(needle, (len(needle), wholes))
    a.make_automaton()
    return a


def _in_place(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` stands in a credential's place: as the whole value of a credential's name."""
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    line = text[low : high if high >= 0 else len(text)]
    for pattern in (_NAMED, _BARE):
        for m in pattern.finditer(line):
            if m.span("value") == (start - low, end - low):
                name = m["name"]
                return bool((_PASSWORD_NAME.search(name) or _KEY_NAME.search(name)) and not _HARMLESS_NAME.search(name))
    return any(m.span("value") == (start - low, end - low) for m in _URL.finditer(line))


def _stands(text: str, start: int, end: int) -> bool:
    """Whether a confirmed value at this place is the credential, not a part of a word or a word by itself."""
    value = text[start:end]
    if not _mixed(value) or len(value) < 8:
        return _in_place(text, start, end)
    return len(value) >= WITHIN_WORDS or bool(_whole(value).match(text, start))


def _scan(values):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(values.value)
        for batch in batches:
            rows = []
            for id_, version, text in zip(*(c.to_pylist() for c in batch.columns)):
                blocks = None
                for last, (n, wholes) in automaton.iter(text):
                    start = last - n + 1
                    for length, digest in wholes:
                        end = start + length
                        if digest and hashlib.sha256(text[start:end].encode("utf-8", "surrogatepass")).hexdigest() != digest:
                            continue
                        if blocks is None:  # the literals within a key block count on its BEGIN line
                            blocks = [(r[0][0], r[-1][1]) for m in _PRIVATE.finditer(text) if (r := _key_body(text, m.end())[0])]
                        if any(i <= start and end <= j for i, j in blocks) or not _stands(text, start, end):
                            continue
                        rows.append((id_, version, text.count("\n", 0, start) + 1, start, end))
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["id", "version", "line_no", "start", "end"]
            )

    return scan


def _automata(values: DataFrame):
    """Broadcast tuples of at most AUTOMATON_VALUES (beginning, length, hash of a long one) each, by shards of their hashes."""
    spark = values.sparkSession
    values = write_table(
        values.select(
            F.substring("value", 1, NEEDLE_CHARS).alias("needle"), F.length("value").alias("n"),
            F.when(F.length("value") > NEEDLE_CHARS, F.sha2("value", 256)).alias("digest"),
        ).distinct(),
        "secret-values",
    )
    shards = max(1, -(-values.count() * 2 // AUTOMATON_VALUES))
    for shard in range(shards):
        part = values.filter(F.pmod(F.xxhash64("needle", "n", "digest"), F.lit(shards)) == shard)
        yield spark.sparkContext.broadcast(tuple(sorted(map(tuple, part.toLocalIterator()), key=str)))


def _places(artifacts: DataFrame, shared_by: int) -> tuple[DataFrame, DataFrame]:
    """The confirmed literals, and (id, version, line_no, start, end) of all places of confirmed values."""
    kept = write_table(confirmed(literal_index(artifacts), shared_by), "confirmed")
    texts = spread(_versions(artifacts))
    hits = None
    for values in _automata(kept.filter((F.col("kind") != "broken block") & (F.length("value") > 0)).select("value")):
        more = write_table(texts.mapInArrow(_scan(values), "id string, version long, line_no int, start int, end int"), "hits")
        values.destroy()
        hits = more if hits is None else hits.unionByName(more)
    return kept, hits


def find_secrets(artifacts: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(id, line_no) of every line on which a live credential begins."""
    kept, hits = _places(artifacts, shared_by)
    return kept.select("id", "line_no").unionByName(hits.select("id", "line_no")).distinct()


def _whole(value: str) -> re.Pattern:
    """Finds ``value`` where no word goes on before or after it."""
    return re.compile(rf"(?:(?<!\w)|(?<=\\[nrt])){re.escape(value)}(?!\w)")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans, values in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            places = [(x["start"], x["end"]) for x in spans]
            for v in set(values or ()):
                places += [m.span() for m in _whole(v).finditer(text)]
            parts, at, low, high = [], 0, 0, 0
            for start, end in [*sorted(places), (len(text) + 1, 0)]:
                if start < high:
                    high = max(high, end)
                    continue
                if low < high:
                    parts += [text[at:low], "x" * (high - low) if high - low < 8 else "REDACTED"]
                    at = high
                low, high = start, end
            texts.append("".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def redact(artifacts: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """(id, text) of the texts that hold credentials, with each credential's literal replaced within its quotes.

    Replaced by place: every confirmed literal, both halves of a split one, all base64 runs of a private key block, every
    hit of the re-scan, and in the text that names a value its other uses as a whole word. Quotes, names and code stay.
    """
    kept, hits = _places(artifacts, shared_by)
    own = kept.select("id", "version", F.explode("spans").alias("x"), F.when(~F.col("kind").endswith("block"), F.col("value")).alias("value"))
    places = own.unionByName(hits.select("id", "version", F.struct("start", "end").alias("x"), F.lit(None).cast("string").alias("value")))
    spans = places.groupBy("id", "version").agg(F.collect_set("x").alias("spans"), F.collect_set("value").alias("values"))
    texts = _versions(artifacts).dropDuplicates(["id", "version"])
    return texts.join(spans, ["id", "version"]).select("id", "text", "spans", "values").mapInArrow(_replace, "id string, text string")
