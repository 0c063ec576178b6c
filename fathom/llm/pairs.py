"""Problem 3: defective pairs of a query and a response.

Responses are sorted by text, so that a shortened version comes right before its longer one, and neighbours' common
prefixes are compared; lengths at which unfinished responses pile up mark length limits; short responses that the traces'
quality flags call empty time and again are placeholders. Then come the rules for empty, copied, refusing, truncated and wrong-language responses, in that order: a pair has one defect at most.

Defined results: a null response is empty; a null query can't be copied and has no language; a key delivered several
times counts once (its least response, nulls last); other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fathom.llm.prose import language, open_end, unfinished
from fathom.session import write_table

#: A length is a limit if so many unfinished responses have it, and so many times the mean of the lengths around it.
SPIKE_ROWS, SPIKE_TIMES, SPIKE_AROUND = 8, 6, 10

#: Shorter responses that begin like another one count as cut only within a word.
SHORT_CHARS = 20

#: A short response is a placeholder if so many traces have it and half of them are flagged as empty.
FLAGGED_TRACES = 3

_TAG = re.compile(r"<[^<>]*>|```\w*")
_MARKS = re.compile(r"[\W_]+")
#: A text with so many letters outside tags is no placeholder.
_LETTERS = re.compile(r"(?:[\W_]*[^\W_]){31}")
_PLACEHOLDERS = {
    "", "na", "null", "none", "nil", "nan", "undefined", "noanswer", "noresponse", "tbd", "todo", "empty", "placeholder",
    "answer", "noanswerprovided", "nodata", "notavailable", "keineantwort", "sansréponse", "sinrespuesta",
}
_WORD = re.compile(r"\w+")
_CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)

#: Ways to decline, as whole sentences, in the languages of the logs.
_DECLINES = re.compile(
    r"""(?ix)^(?:
    (?:i['’]m|i\ am|we['’]re|we\ are)\ (?:very\ |really\ |so\ )?(?:sorry|afraid)\b.*
    |(?:sorry|apologies|unfortunately)\b[^:]*\b(?:can['’]?t|cannot|can\ not|won['’]?t|not\ able|unable|not\ allowed|not\ permitted)\b.*
    |(?:i|we)\ (?:can['’]?t|cannot|can\ not|won['’]?t|will\ not|must|have\ to|may\ not|am\ not|are\ not|do\ not|don['’]t|prefer\ not)\b
        .*\b(?:decline|help|assist|answer|share|explain|describe|talk|discuss|provide|permission|allowed|do\ that|able|disclose|comment|comply)\b.*
    |i['’]d\ (?:prefer|rather)\ not\b.*
    |no,?\ (?:i|we)\ (?:will\ not|won['’]?t|can['’]?t|cannot)\b.*
    |(?:this|that|the|your)\ (?:request|question)\ (?:can['’]?t|cannot|can\ not|will\ not|won['’]?t)\b.*
    |as\ an?\ (?:\w+\ ){0,2}(?:assistant|ai|model)\b.*\b(?:decline|can['’]?t|cannot|permission|not\ able|unable|allowed)\b.*
    |(?:sadly|unfortunately|regrettably)\b.*\b(?:outside|not\ allowed|allowed\ to\ talk|beyond)\b.*
    |it\ (?:touches|falls)\b.*\b(?:guidelines|allowed|policy|rules)\b.*
    |.*\b(?:guidelines|rules|policy|instructions)\ (?:do\ not|don['’]t|forbid)\b.*
    |(?:that|this)\ is\ (?:something|not\ something)\b.*\b(?:won['’]?t|can['’]?t|cannot|can)\b.*
    |.*\b(?:darf|kann|möchte|werde)\b.*\b(?:nicht|leider)\b.*\b(?:helfen|beantworten|antworten|sagen|auskunft|geben|erklären|sprechen|äußern)\b.*
    |(?:es\ )?(?:tut\ mir\ leid|entschuldigung|leider)\b.*\b(?:nicht|keine)\b.*
    |(?:désolé|je\ suis\ désolé|pardon|malheureusement)\b.*\b(?:ne|pas)\b.*
    |je\ (?:ne|préfère|n['’]ai)\b.*\b(?:pas)\b.*\b(?:répondre|aider|droit|expliquer|partager|dire|autorisé|autorisée|parler|autorisation)\b.*
    |(?:prefiero|no\ puedo|no\ me\ es\ posible|no\ debo|no\ voy\ a)\b.*\b(?:contestar|ayudar|responder|explicar|compartir|decir|hablar|pregunta|petición)\b.*
    |(?:lo\ siento|perdón|lamentablemente)\b.*\bno\b.*
    |.*(?:お答え|お手伝い|回答).{0,8}(?:できません|いたしかねます).*
    |(?:к\ сожалению|извините)\b.*\bне\b.*
    )$"""
)
#: What may stand beside a refusal without adding anything.
_POLITE = re.compile(
    r"(?i)^(?:hello|hi|hey|hallo|bonjour|hola|thanks?\b.*|thank you\b.*|guten tag|please (?:ask|contact|talk to|turn to|see)\b.*"
    r"|bitte (?:wenden|fragen)\b.*|veuillez\b.*|merci\b.*|gracias\b.*|por favor\b.*|pregunt\w+\b.*|i hope\b.*|ask the owner\b.*)?$"
)
_LEADS = re.compile(r"(?i)^(?:you (?:asked|wrote|said)|your question(?: was)?|the question (?:is|was)|question|q|re|query|frage|du fragst|sie fragen|pregunta|vous demandez)\s*[:\-]\s*")
_ASKED = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "japanese": "ja", "russian": "ru", "englisch": "en",
    "deutsch": "de", "französisch": "fr", "spanisch": "es", "anglais": "en", "allemand": "de", "français": "fr",
    "espagnol": "es", "inglés": "en", "alemán": "de", "francés": "fr", "español": "es",
}
_ASKS = re.compile(
    r"(?i)\b(?:in|auf|en|into|to)\s+(" + "|".join(_ASKED) + r")\b"
)


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    body = _TAG.sub("", response)
    return not _LETTERS.match(body) and _MARKS.sub("", body).lower() in _PLACEHOLDERS


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("_", ""))


def is_echo(query: str, response: str) -> bool:
    """Whether the response is made of the query's words, but for a few, and holds most of them."""
    q = _words(query)
    r = _words(_LEADS.sub("", response.strip().lstrip(">\"'“«*_ \t")))
    if len(q) < 3 or not r:
        return False
    asked, answered = set(q), set(r)
    new = sum(w not in asked for w in r)
    return len(answered & asked) >= 0.6 * len(asked) and new <= max(1, 0.12 * len(r)) or (
        "".join(q) == "".join(r) or "".join(r) == "".join(q) * 2
    )


def is_refusal(response: str) -> bool:
    """Whether every sentence declines or is a courtesy, and one at least declines."""
    text = _CODE.sub("X", response).strip().lstrip(">*_ \t\"'")
    declined = False
    for sentence in re.split(r"(?<=[.!?。])\s+|(?<=[!。])|\n+", text):
        sentence = sentence.strip(" .!?。>*_\"'\t")
        if not sentence or _POLITE.match(sentence):
            continue
        if not _DECLINES.match(sentence):
            return False
        declined = True
    return declined


def is_wrong_language(query: str, response: str) -> bool:
    answered, asked = language(response), language(query)
    if answered is None or asked is None or answered == asked:
        return False
    wanted = {_ASKED[m.lower()] for m in _ASKS.findall(query)}
    return answered not in wanted


def defect(query: str | None, response: str | None, shortened: bool, at_limit: bool, flagged: bool = False) -> str | None:
    if is_empty(response) or flagged:
        return "empty"
    if query is not None and is_echo(query, response):
        return "echo"
    if is_refusal(response):
        return "refusal"
    if unfinished(response) or (shortened and open_end(response)) or (at_limit and open_end(response)):
        return "truncated"
    if query is not None and is_wrong_language(query, response):
        return "wrong_language"
    return None


def is_shortened(text: str, longer: str) -> bool:
    """Whether ``longer`` begins with ``text`` and goes on. Short answers may begin like others: those of less than
    SHORT_CHARS characters must stop within a word that isn't their first one."""
    if len(longer) <= len(text) or not longer.startswith(text):
        return False
    within = text[-1:].isalnum() and longer[len(text)].isalnum()
    return len(text) >= SHORT_CHARS or (within and len(text.split()) > 1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts: (response, part, edge, shortened): whether the next one begins with the whole text.

    The first text of each partition also comes as an edge row, against which the last one of the partition before,
    marked by ``shortened`` null, is compared later.
    """
    part, previous, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if first:
                rows.append((text, part, True, False))
                first = False
            if previous is not None:
                rows.append((previous, part, False, is_shortened(previous, text)))
            previous = text
        if rows:
            yield _neighbour_batch(rows)
    if previous is not None:
        yield _neighbour_batch([(previous, part, False, None)])


def _neighbour_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["response", "part", "edge", "shortened"]
    )


def shortened_responses(pairs: DataFrame) -> DataFrame:
    """(response) of the texts that a longer response in the collection begins with."""
    texts = pairs.select("response").filter(F.length("response") > 0).distinct()
    ordered = texts.repartitionByRange("response").sortWithinPartitions("response")
    rows = write_table(
        ordered.mapInArrow(_neighbours, "response string, part int, edge boolean, shortened boolean"), "neighbours"
    )
    # one row a partition: the last text of each against the first of the next that isn't empty
    edges = rows.filter(F.col("edge") | F.col("shortened").isNull())
    lead = F.lead("response").over(Window.orderBy("part", F.expr("not edge")))
    n = F.length("response")
    within = F.substring("response", -1, 1).rlike(r"[\p{L}\p{N}]") & F.substring("next", n + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & F.trim("response").rlike(r"\s")
    across = edges.withColumn("next", lead).filter(
        ~F.col("edge") & F.col("next").startswith(F.col("response")) & (F.length("next") > n) & ((n >= SHORT_CHARS) | within)
    )
    return rows.filter("not edge and shortened").select("response").unionByName(across.select("response")).distinct()


def length_limits(pairs: DataFrame) -> DataFrame:
    """(n_chars) of the lengths at which responses without a proper end pile up."""
    open_ended = pairs.filter(~F.rtrim("response").rlike(r"[.!?。…:`\])}>\"']$"))
    counts = open_ended.groupBy(F.length("response").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy(F.floor(F.col("n_chars") / 4096)).orderBy("n_chars").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    mean = (F.sum("n").over(around) - F.col("n")) / (2 * SPIKE_AROUND)
    spikes = counts.withColumn("mean", mean)
    return spikes.filter((F.col("n") >= SPIKE_ROWS) & (F.col("n") > SPIKE_TIMES * F.col("mean"))).select("n_chars")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, str | None] = {}

    def judged(q: str | None, r: str | None, *marks: bool) -> str | None:
        # equal pairs are judged once; what is held is their digests
        key = xxhash.xxh128_digest(repr((q, r, marks)))
        if key not in known:
            if len(known) > 200_000:
                known.clear()
            known[key] = defect(q, r, *marks)
        return known[key]

    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(2, 7))
        defects = pa.array([judged(*x) for x in zip(*columns)], pa.string())
        keep = defects.is_valid()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep), defects.filter(keep)],
            ["origin", "record_key", "defect"],
        )


def _plain(response: str) -> F.Column:
    """A response of few letters without its markup; null for others."""
    body = F.lower(F.regexp_replace(F.regexp_replace(response, r"<[^<>]*>|```\w*", ""), r"[^\p{L}\p{N}]+", ""))
    return F.when(F.length(body).between(1, 30), body)


def flagged_responses(harness_traces: DataFrame) -> DataFrame:
    """(plain) of the short responses that the traces' quality flags call empty.

    A flag by itself is noisy: FLAGGED_TRACES different traces must have the response, and half of them the flag.
    """
    rows = harness_traces.select("trace_id", _plain("response").alias("plain"), F.array_contains("quality_flags", "empty").alias("flag"))
    once = rows.filter("plain is not null and flag is not null").groupBy("trace_id", "plain").agg(F.max("flag").alias("flag"))
    counts = once.groupBy("plain").agg(F.count(F.lit(1)).alias("n"), F.count_if("flag").alias("flagged"))
    return counts.filter((F.col("n") >= FLAGGED_TRACES) & (2 * F.col("flagged") >= F.col("n"))).select("plain")


def defective_pairs(user_history: DataFrame, harness_traces: DataFrame) -> DataFrame:
    """(origin, record_key, defect): one row per defective key of either table."""
    def keyed(rows: DataFrame, origin: str, key: str) -> DataFrame:
        return rows.select(
            F.lit(origin).alias("origin"), F.col(key).cast("string").alias("record_key"), "query", "response"
        ).groupBy("origin", "record_key").agg(F.min(F.struct(F.col("response").isNull(), "response", "query")).alias("p")
        ).select("origin", "record_key", "p.query", "p.response")

    pairs = write_table(
        keyed(user_history, "user_history", "id").unionByName(keyed(harness_traces, "harness_traces", "trace_id")),
        "pairs",
    )
    answered = pairs.filter(F.col("response").isNotNull())
    short = shortened_responses(answered).withColumn("shortened", F.lit(True))
    limits = length_limits(answered).withColumn("at_limit", F.lit(True))
    flagged = flagged_responses(harness_traces).withColumn("flagged", F.lit(True))
    marked = (
        pairs.withColumn("n_chars", F.length("response")).withColumn("plain", _plain("response"))
        .join(short, "response", "left").join(limits, "n_chars", "left").join(flagged, "plain", "left")
        .select(
            "origin", "record_key", "query", "response",
            F.coalesce("shortened", F.lit(False)), F.coalesce("at_limit", F.lit(False)), F.coalesce("flagged", F.lit(False)),
        )
    )
    return marked.mapInArrow(_judge, "origin string, record_key string, defect string")
