"""Text functions as columns: tokens, identifiers, stems, query terms, paths. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that a query's terms leave out. Fixed values.
QUERY_STOPWORDS = (
    "a an and are around artifact as at be by callee confirm contains correspond defined does file for from in indexed is it "
    "kind kinds of on or public repository symbol the to what where whether which with"
).split()

#: Suffixes that the light stemmers strip, first match wins. Fixed values.
STEM_SUFFIXES = ("ization", "ation", "tion", "ing", "ers", "er", "ed", "es", "s")

TOKEN = "[a-z_][a-z0-9_]*"
RAW_TOKEN = "[A-Za-z_][A-Za-z0-9_]*"
CAMEL = "[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"
PATH_LIKE = r"[a-z0-9_./-]+(?:\[[0-9]+\])?(?:\.[a-z0-9_./-]+)*"
ACCESSOR = "^(get|set|has|is)[a-z0-9_]{3,}$"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Lower-cased identifier tokens, in order, with repeats."""
    return all_matches(F.lower(text), TOKEN)


def camel_parts(word: Column) -> Column:
    """Parts of a camel-case word; an upper-case run before anything but a capital or the end loses its last letter."""
    return all_matches(F.replace(word, F.lit("_"), F.lit(" ")), CAMEL)


def index_tokens(text: Column) -> Column:
    """Distinct lower-cased tokens and camel parts of more than one character: what a postings list is built on."""
    raw = all_matches(text, RAW_TOKEN)
    parts = F.flatten(F.transform(raw, camel_parts))
    both = F.transform(F.concat(raw, parts), F.lower)
    return F.array_distinct(F.filter(both, lambda t: F.length(t) > 1))


def normalise_identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def qualified_parts(text: Column) -> Column:
    """Parts of a qualified name, split at ``::``, ``.`` and ``#``."""
    return F.filter(F.split(text, r"::|\.|#"), lambda p: p != "")


def light_stem(word: Column) -> Column:
    """The index's stemmer: the first suffix that leaves more than three characters is stripped."""
    out = word
    for suffix in reversed(STEM_SUFFIXES):
        longer = F.length(word) > len(suffix) + 3
        stripped = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out = F.when(word.endswith(suffix) & longer, stripped).otherwise(out)
    return out


def light_stem_rerank(word: Column) -> Column:
    """The re-ranker's stemmer: a final s goes first."""
    plural = word.endswith("s") & (F.length(word) > 3)
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(light_stem(word))


def related(left: Column, right: Column) -> Column:
    """Whether two words' stems have five characters and begin with the same five."""
    a, b = light_stem(left), light_stem(right)
    return (F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5)))


def query_literals(query: Column) -> Column:
    """What stands between back quotes, trimmed, lower-cased, with forward slashes."""
    return F.transform(all_matches(query, "`([^`]+)`", 1), lambda x: F.replace(F.lower(F.trim(x)), F.lit("\\"), F.lit("/")))


def path_like_terms(query: Column) -> Column:
    found = all_matches(F.replace(F.lower(query), F.lit("\\"), F.lit("/")), PATH_LIKE)
    pathy = F.filter(found, lambda x: x.contains("/") | x.contains(".") | x.contains("["))
    return F.array_distinct(F.transform(pathy, lambda x: F.btrim(x, F.lit(".,:;()[]{}'\""))))


def _kept(found: Column) -> Column:
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(QUERY_STOPWORDS))


def query_terms(query: Column) -> Column:
    """Ordered distinct terms of a query: tokens, path-like terms, then each literal's tokens and the literal."""
    slashed = F.replace(F.lower(query), F.lit("\\"), F.lit("/"))
    literal = F.transform(query_literals(query), lambda x: F.concat(_kept(tokens(x)), F.array(x)))
    found = F.concat(_kept(all_matches(slashed, TOKEN)), path_like_terms(query), F.flatten(literal))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def term_weight(term: Column) -> Column:
    return F.when(term.rlike(ACCESSOR) | term.contains("_"), F.lit(8.0)).otherwise(F.lit(4.0))


def basename(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-1))


def stem_of(name: Column) -> Column:
    """The name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def metadata_text(metadata: Column) -> Column:
    """A map's keys and values, sorted by key."""
    entries = F.array_sort(F.map_entries(metadata))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["key"], e["value"])), " "), F.lit(""))


def squeeze(text: Column) -> Column:
    """Lower case, trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def join_terms(terms: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(terms)
    many = F.concat(F.array_join(F.slice(terms, F.lit(1), n - 1), ", "), F.lit(", and "), F.try_element_at(terms, F.lit(-1)))
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.try_element_at(terms, F.lit(1)))
        .when(n == 2, F.concat_ws(" and ", F.try_element_at(terms, F.lit(1)), F.try_element_at(terms, F.lit(2))))
        .otherwise(many)
    )


def artifact_id(repository: Column, path: Column, symbol: Column, tier: Column) -> Column:
    """``repository:path:symbol:T<tier>``, blanks of the symbol as underscores."""
    return F.concat(repository, F.lit(":"), path, F.lit(":"), F.replace(symbol, F.lit(" "), F.lit("_")), F.lit(":T"), tier.cast("string"))
