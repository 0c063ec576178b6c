"""Rules on natural-language text: its language and whether its end is an end."""

from __future__ import annotations

import re

#: Frequent function words by language. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an of to is are was were be been and or but if for in on at by with from as that this it its not no than then "
    "when where which who whether because so after before there nobody each only both only into out would can could may "
    "must has have had does do did you your i we they them what why how about every",
    "de": "der die das den dem des ein eine einen einem eines und oder aber nicht ist sind war wird werden wurde mit von vom zu zum "
    "zur im in auf für aus bei nach vor über unter dass wenn weil damit auch nur man wir sie er es keine kein wie was wer wo "
    "warum welche welcher dann als bis ohne durch höchstens danach gibt diese dieser",
    "fr": "le la les l un une des du de d et ou mais ne pas est sont était être avec sans pour par dans sur sous au aux que qui quoi "
    "quand où pourquoi quelle quel si ce cette ces il elle nous vous ils on y a plus puis avant après en son sa ses se",
    "es": "el la los las un una unos unas y o pero no es son era ser con sin para por en sobre del de al que quien cuando donde "
    "dónde qué cuál por como cómo si se su sus lo le les más hay antes después este esta estos estas hasta como entonces a",
}

#: Words that tell a language, but may close a title or stand in a list of words. Fixed values.
COMMON_WORDS = {"en": "one per more now other same two again first"}

ALL_FUNCTION_WORDS = frozenset().union(*(v.split() for v in FUNCTION_WORDS.values()))
_SETS = {k: frozenset((v + " " + COMMON_WORDS.get(k, "")).split()) for k, v in FUNCTION_WORDS.items()}
#: A word of one language tells twice as much as one that several share.
_WEIGHTS = {k: {w: 1 + (sum(w in o for o in _SETS.values()) == 1) for w in v} for k, v in _SETS.items()}

_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\S*[_/\\()\[\]{}<>=#$]\S*|\w+\.\w+\S*|\b\w*[a-z][A-Z]\w*\b|\w+-\w+\S*", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def language(text: str) -> str | None:
    """The language of the prose in ``text``, without code, paths and names; None where too little tells."""
    prose = _CODE.sub(" ", text)
    if len(_KANA.findall(prose)) >= 3:
        return "ja"
    if len(_CYRILLIC.findall(prose)) >= 6:
        return "ru"
    words = _WORD.findall(prose.lower())
    scores = sorted(((sum(s.get(w, 0) for w in words), k) for k, s in _WEIGHTS.items()), reverse=True)
    best, second = scores[0], scores[1]
    if best[0] >= 2 and best[0] > second[0] and best[0] >= 0.12 * len(words):
        return best[1]
    return None


#: What tools append where they cut a text. Fixed values.
CUT_MARK = re.compile(
    r"(?:\s*(?:\.\.\.|…)?\s*(?:\[(?:\w+ )?(?:truncated|clipped|cut|snipped|cut off|continued|more|abridged|shortened)\b[^\]\n]*\]"
    r"|<(?:cut|truncated|snip|clipped|more)[^>\n]*>|\((?:\d+|\w+) more (?:characters|chars|bytes|lines|words)\)"
    r"|\((?:truncated|cut|clipped|continued)\)|\[(?:…|\.\.\.)\]|\(?(?:read|show|view) more\)?|--more--))\s*\Z",
    re.I,
)
_DOTS = re.compile(r"(?:\.\.\.|…)\s*\Z")
_TERMINAL = re.compile(r"[.!?。？！]['\"”’»)\]*_`]*\Z")
_PATH_END = re.compile(r"(?:^|[\s(])[\w.\-]+(?:/[\w.\-]+)*/[\w\-]+\.\w{1,5}\Z")
_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?。？！])['\"”’»)]*\s+|(?<=[。？！])")


def last_line(text: str) -> str:
    t = text.rstrip()
    return t[t.rfind("\n") + 1 :]


def tail(line: str) -> str:
    """What follows the last finished sentence of a line."""
    parts = _SENTENCE.split(line)
    return parts[-1] if parts else line


def has_function_words(segment: str, least: int = 1) -> bool:
    if _KANA.search(segment) or len(_CYRILLIC.findall(segment)) >= 3:
        return True
    return sum(w in ALL_FUNCTION_WORDS for w in _WORD.findall(_CODE.sub(" ", segment).lower())) >= least


def open_end(text: str) -> bool:
    """Whether a text ends without a terminal mark, a closed block or a finished list entry."""
    line = last_line(text)
    return not (_TERMINAL.search(line) or line.strip() == "```" or _PATH_END.search(line) or line.rstrip().endswith("`"))


def odd_marks(text: str) -> bool:
    """Whether the last paragraph leaves a code span or a bracket open."""
    paragraph = text.rstrip().rpartition("\n\n")[2]
    line = last_line(paragraph)
    if "```" in line:
        return False
    return line.count("`") % 2 == 1 or line.count("(") > line.count(")") or line.count("[") > line.count("]")


def unfinished(text: str) -> bool:
    """Whether a response stops within a word, sentence or code block."""
    stripped = text.rstrip()
    if stripped.count("```") % 2:
        return True
    if CUT_MARK.search(stripped):
        return True
    line = last_line(stripped)
    if line.strip() == "```":
        return False
    if _DOTS.search(stripped) and len(stripped) > 20:
        return True
    if _TERMINAL.search(line):
        rest = tail(line)
        return odd_marks(stripped) or bool(re.search(r"\b[vV]ersion \d+\.\Z|\w/[\w/]+\.\Z", rest))
    entry = _LIST.match(line)
    if entry:
        body = line[entry.end() :]
        if _PATH_END.search(body):
            return False
        if not has_function_words(body, 1):
            return odd_marks(stripped)
        return True
    rest = tail(line)
    if line.rstrip().endswith((",", ";", "(", "-", "=", "{")):
        return True
    words = rest.split()
    if len(words) <= 2 and line == rest and "\n" not in stripped:
        return False
    return has_function_words(rest, 1) or odd_marks(stripped) or line != rest
