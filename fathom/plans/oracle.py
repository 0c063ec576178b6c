"""SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from fathom.functions.text import PATH_LIKE, QUERY_STOPWORDS
from fathom.operators.answers import ABSTRACT, CODE_LINES, FILE_HEADER, LABEL, LIST_MARKS, PATH, PATH_HEADINGS, RAW_CODE, UNUSABLE, VACUOUS_LINES
from fathom.operators.evaluation import CODE_PATTERNS, REFUSAL_MARKERS
from fathom.operators.scoring import (
    OPERATIONAL_FOLDERS, OPERATIONAL_KINDS, OPERATIONAL_SUFFIXES, OPERATIONAL_TERMS, POLICY_TERMS, RERANK, RERANK_STOPWORDS, RETRIEVAL, SCHEMA_ROLE,
)
from fathom.operators.search import CLASS_SUFFIXES, NAMED_SUFFIXES
from fathom.sources.files import EXCLUDED, LANGUAGES, SENSITIVE_NAMES, SENSITIVE_SUFFIXES

ORACLE_SQL: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


STOP = _list(QUERY_STOPWORDS)
CUR = "cur AS (SELECT * FROM artifacts QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"
REQ = """req AS (SELECT r.qid, r.query, r.user_id, r.repo_scope,
  coalesce(CASE a.tier WHEN 'T-1' THEN 1 WHEN 'T-2' THEN 2 WHEN 'T-3' THEN 3 END, 1) AS user_tier
  FROM (SELECT id AS qid, min(query) AS query, min(user_id) AS user_id, any_value(repo_scope) AS repo_scope
        FROM user_history WHERE id % 50 = 0 AND query IS NOT NULL GROUP BY id) r LEFT JOIN access_matrix a USING (user_id))"""


def _kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


def _ordered_distinct(items: str) -> str:
    return f"list_transform(list_filter(list_transform({items}, lambda x, i: struct_pack(x := x, i := i)), lambda s: list_position({items}, s.x) = s.i), lambda s: s.x)"


LITERALS = r"list_transform(regexp_extract_all(query, '`([^`]+)`', 1), lambda x: replace(lower(trim(x, ' ')), '\', '/'))"
_PATHS = rf"""list_transform(list_filter(regexp_extract_all(replace(lower(query), '\', '/'), '{PATH_LIKE}'),
  lambda x: contains(x, '/') OR contains(x, '.') OR contains(x, '[')), lambda x: trim(x, '.,:;()[]{{}}''"'))"""
PATHS = _ordered_distinct(_PATHS)
_TERMS = rf"""list_filter(list_concat(list_concat({_kept(r"regexp_extract_all(replace(lower(query), '\', '/'), '[a-z_][a-z0-9_]*')")}, {PATHS}),
  flatten(list_transform({LITERALS}, lambda l: list_append({_kept("regexp_extract_all(l, '[a-z_][a-z0-9_]*')")}, l)))), lambda t: t <> '')"""
TERMS = _ordered_distinct(_TERMS)
TERM = f"term AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({_TERMS}) AS term FROM req) WHERE length(term) > 1 AND NOT list_contains({STOP}, term))"


def _camel(x: str) -> str:
    spaced = rf"regexp_replace(regexp_replace(replace({x}, '_', ' '), '[A-Z]([^A-Za-z])', ' \1', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"regexp_extract_all({spaced}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"


def _index_tokens(x: str) -> str:
    raw = f"regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*')"
    both = f"list_transform(list_concat({raw}, flatten(list_transform({raw}, lambda w: {_camel('w')}))), lambda t: lower(t))"
    return f"list_filter({both}, lambda t: length(t) > 1)"


META = "coalesce(array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: concat_ws(' ', e.key, e.value))), ' '), '')"
ENTRY = f"""entry AS (SELECT id, repository, tier, file_path, kind, coalesce(symbol_name, '') AS symbol_name, {META} AS metadata_text
  FROM cur WHERE kind <> 'chunk')"""
POST = f"""post AS (SELECT DISTINCT id, unnest({_index_tokens("concat_ws(' ', repository, tier::VARCHAR, file_path, symbol_name, kind, metadata_text)")}) AS token FROM entry)"""
BASE = """base AS (SELECT qid, id, sum(CASE WHEN regexp_matches(term, '^(get|set|has|is)[a-z0-9_]{3,}$') OR contains(term, '_') THEN 8.0 ELSE 4.0 END) AS base
  FROM term JOIN post ON token = term GROUP BY qid, id)"""
SCORED = """scored AS (SELECT b.qid, b.id, e.file_path, b.base + (SELECT coalesce(sum(
    CASE WHEN contains(lower(e.symbol_name), t.term) THEN 3.0 ELSE 0.0 END + CASE WHEN contains(lower(e.metadata_text), t.term) THEN 2.0 ELSE 0.0 END
    + CASE WHEN contains(lower(e.file_path), t.term) THEN 1.0 ELSE 0.0 END + CASE WHEN lower(e.kind) = t.term THEN 0.5 ELSE 0.0 END), 0)
    FROM term t WHERE t.qid = b.qid) AS score
  FROM base b JOIN entry e USING (id) JOIN req r USING (qid)
  WHERE e.tier <= r.user_tier AND (r.repo_scope IS NULL OR list_contains(r.repo_scope, e.repository)))"""
LEX = f"""{CUR}, {REQ}, {TERM}, {ENTRY}, {POST}, {BASE}, {SCORED},
lex AS (SELECT qid, id, file_path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path, id)::INTEGER AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path, id) <= 50)"""

ORACLE_SQL["scoped_scan"] = """SELECT repository, tier, count(DISTINCT id) AS artifacts, min(file_path) AS first_path FROM artifacts
WHERE tier <= 2 AND repository IN (SELECT repository FROM group_scopes) GROUP BY repository, tier"""
_FOLDERS = "string_split(lower(file_path), '/')"
ORACLE_SQL["index_decisions"] = rf"""WITH {CUR}, r AS (SELECT language, coalesce(text, '') AS text, file_path FROM cur)
SELECT language, CASE
  WHEN list_has_any(string_split(file_path, '/'), {_list(EXCLUDED)}) THEN 'excluded'
  WHEN list_has_any({_FOLDERS}, {_list(SENSITIVE_NAMES)}) OR list_has_any({_FOLDERS}, ['secret', 'secrets'])
    OR starts_with(list_last({_FOLDERS}), '.env.') OR {" OR ".join(f"ends_with(lower(file_path), '{s}')" for s in SENSITIVE_SUFFIXES)} THEN 'sensitive'
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: length(rtrim(x, ' ')) > 500)) > 0 THEN 'unreadable'
  WHEN regexp_matches(left(text, 8192), '-----BEGIN (?:RSA |DSA |EC |OPENSSH |)PRIVATE KEY-----')
    OR regexp_matches(left(text, 8192), '(?i)\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|private[_-]?key|password)\s*[:=]\s*[''"]?[^''"\s]{{12,}}') THEN 'secret'
  WHEN len(list_filter(['auto-generated', 'autogenerated', 'generated by', 'do not edit'],
    lambda m: contains(lower(array_to_string(string_split(text, chr(10))[1:5], chr(10))), m))) > 0 THEN 'generated'
  ELSE 'indexed' END AS reason, count(*) AS files FROM r GROUP BY 1, 2"""
ORACLE_SQL["file_languages"] = f"""SELECT CASE regexp_extract(lower(file_path), '[^/](\\.[^./]+)$', 1)
  {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} ELSE 'text' END AS detected, language, count(DISTINCT id) AS artifacts
FROM artifacts GROUP BY 1, 2"""
ORACLE_SQL["token_stats"] = f"""WITH {CUR} SELECT token, count(*) AS texts FROM
(SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*')) AS token FROM cur) GROUP BY token"""


def _stem(x: str) -> str:
    cases = "".join(f" WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 3} THEN left({x}, length({x}) - {len(s)})"
                    for s in ("ization", "ation", "tion", "ing", "ers", "er", "ed", "es", "s"))
    return f"CASE{cases} ELSE {x} END"


_PARTS = _index_tokens("symbol_name")
ORACLE_SQL["identifier_parts"] = f"""SELECT DISTINCT symbol_name, array_to_string({_ordered_distinct(_PARTS)}, ' ') AS parts,
regexp_replace(lower(symbol_name), '[^a-z0-9]', '', 'g') AS normal, {_stem("lower(symbol_name)")} AS stem,
CASE WHEN ends_with(lower(symbol_name), 's') AND length(symbol_name) > 3 THEN left(lower(symbol_name), length(symbol_name) - 1) ELSE {_stem("lower(symbol_name)")} END AS rerank_stem
FROM artifacts WHERE symbol_name IS NOT NULL"""
ORACLE_SQL["related_words"] = f"""WITH {REQ}, w AS (SELECT DISTINCT qid, unnest({TERMS}) AS term FROM req),
s AS (SELECT qid, term, {_stem("term")} AS a FROM w),
p AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(file_path), '[^a-z0-9]+')) AS piece FROM artifacts), q AS (SELECT piece, {_stem("piece")} AS b FROM p)
SELECT qid, count(*) AS related FROM s JOIN q ON left(a, 5) = left(b, 5) WHERE length(a) >= 5 AND length(b) >= 5 GROUP BY qid"""
ORACLE_SQL["query_terms"] = rf"""SELECT query, array_to_string({TERMS}, '|') AS terms, array_to_string({LITERALS}, '|') AS literals,
array_to_string({PATHS}, '|') AS paths, trim(regexp_replace(lower(query), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS squeezed
FROM (SELECT DISTINCT query FROM user_history WHERE query IS NOT NULL)"""
ORACLE_SQL["joined_terms"] = """WITH e AS (SELECT user_id, list_sort(list_distinct(list(inference_engine_used))) AS l FROM user_history
WHERE inference_engine_used IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2]
ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS phrase FROM e"""
ORACLE_SQL["json_leaves"] = """SELECT key, count(*) AS n, sum(json_extract_string(props, '$.' || key)::BIGINT)::BIGINT AS total
FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key"""
ORACLE_SQL["delete_repository"] = """WITH a AS (SELECT DISTINCT id, repository FROM artifacts),
big AS (SELECT repository FROM a GROUP BY repository ORDER BY count(*) DESC, repository LIMIT 1),
gone AS (SELECT id FROM a WHERE repository IN (SELECT repository FROM big))
SELECT 'artifacts' AS what, count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'edges', count(*) FROM (SELECT DISTINCT source_id, target_id, relationship FROM edges WHERE source_id <> target_id
AND source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone))"""
ORACLE_SQL["index_stats"] = """SELECT coalesce(repository, 'total') AS repository, count(DISTINCT id) AS artifacts, round(max(updated_at), 3) AS newest
FROM artifacts GROUP BY ROLLUP (repository)"""
ORACLE_SQL["repository_fingerprints"] = f"""WITH {CUR}, h AS (SELECT DISTINCT repository, id, ('0x' || substr(sha256(id || chr(31) || coalesce(text, '')), 1, 10))::BIGINT AS number FROM cur),
s AS (SELECT repository, count(*) AS artifacts, sum(number)::VARCHAR AS sum FROM h GROUP BY repository)
SELECT repository, artifacts, sha256(repository || ':' || artifacts || ':' || sum) AS fingerprint FROM s"""
ORACLE_SQL["schema_migration"] = "SELECT coalesce(inference_engine_used, 'unknown') AS inference_engine_used, count(DISTINCT id) AS answers FROM user_history GROUP BY 1"
ORACLE_SQL["user_tiers"] = """SELECT coalesce(CASE a.tier WHEN 'T-1' THEN 1 WHEN 'T-2' THEN 2 WHEN 'T-3' THEN 3 END, 1) AS user_tier, count(*) AS requests
FROM (SELECT DISTINCT user_id, trace_id FROM harness_traces) t LEFT JOIN access_matrix a USING (user_id) GROUP BY 1"""
ORACLE_SQL["allowed_scopes"] = "SELECT group_name AS subject, string_agg(DISTINCT repository, ',' ORDER BY repository) AS scopes FROM group_scopes GROUP BY 1"
ORACLE_SQL["last_turns"] = """SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC)::INTEGER AS turn
FROM (SELECT DISTINCT id, user_id FROM user_history) QUALIFY turn <= 4"""
_AUDIT = "a AS (SELECT * FROM audit_log QUALIFY row_number() OVER (PARTITION BY id) = 1)"
ORACLE_SQL["audit_rollup"] = f"""WITH {_AUDIT}, r AS (SELECT strftime(make_timestamp((floor(created_at) * 1000000)::BIGINT), '%Y-%m-%d') AS day, coalesce(access_tier, 'none') AS tier, cache_hit, latency_ms FROM a)
SELECT day, tier, count(*) AS requests, count(*) FILTER (cache_hit) AS hits, sum(round(latency_ms * 1000)::BIGINT)::BIGINT AS total_us FROM r GROUP BY ROLLUP (day, tier)"""
ORACLE_SQL["latency_percentiles"] = f"""WITH {_AUDIT} SELECT coalesce(inference_engine_used, 'none') AS engine, round(quantile_cont(latency_ms, 0.5), 4) AS p50,
round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99, sum(round(latency_ms * 1000)::BIGINT)::BIGINT AS total_us
FROM a WHERE latency_ms IS NOT NULL GROUP BY 1"""
ORACLE_SQL["cache_keys"] = r"""WITH t AS (SELECT * FROM harness_traces WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id) = 1)
SELECT sha256(concat_ws(':', 'v1', trim(regexp_replace(lower(query), '[ \t\n\r\f\v]+', ' ', 'g'), ' '), coalesce(access_tier, 'T-1'),
  coalesce(array_to_string(list_sort(repo_scopes), ','), ''), 'answer', coalesce(model_id, 'default-model'), 'index')) AS key, count(*) AS traces FROM t GROUP BY 1"""
ORACLE_SQL["audit_windows_stream"] = """SELECT to_timestamp(floor(created_at / 3600) * 3600)::TIMESTAMP AS window_start, coalesce(access_tier, 'none') AS access_tier,
count(*) AS requests, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (rbac_blocked) AS blocked FROM audit_log GROUP BY 1, 2"""
ORACLE_SQL["lexical_search"] = f"WITH {LEX} SELECT qid, id, file_path, score::DOUBLE AS score, rank FROM lex"
ALL_TERMS = f"tm AS (SELECT DISTINCT qid, unnest({TERMS}) AS term FROM req)"
_LOW = "lower(file_path)"
_NAME = f"list_last(string_split({_LOW}, '/'))"
_SUFFIX = f"regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1)"
_STEM_OF = f"regexp_replace({_NAME}, '^(.+)\\.[^.]*$', '\\1')"
ALLOWED = """al AS (SELECT qid, id FROM req JOIN cur ON tier <= user_tier AND (repo_scope IS NULL OR list_contains(repo_scope, repository)))"""
_LONGEST = f"""lt AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, pos) AS place FROM
  (SELECT qid, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT qid, {TERMS} AS l FROM req)) QUALIFY place <= 8),
ll AS (SELECT qid, list(term) AS terms, list(term) FILTER (place <= 3) AS first FROM lt GROUP BY qid)"""
_TEXT_HITS = f"""{_LONGEST}, th AS (SELECT qid, id, file_path, 10.0::DOUBLE * len(list_filter(terms, lambda t: contains(lower(concat_ws(' ', file_path, symbol_name, kind, text)), t))) AS score
  FROM al JOIN cur USING (id) JOIN ll USING (qid) WHERE text IS NOT NULL AND len(list_filter(first, lambda t: contains(lower(text), t))) > 0)"""
ORACLE_SQL["text_scan"] = f"WITH {CUR}, {REQ}, {ALLOWED}, {_TEXT_HITS} SELECT * FROM th"
_COMPOSITE = f"""{CUR}, {REQ}, {ALLOWED}, {_TEXT_HITS}, term AS (SELECT qid, term FROM lt), {ENTRY}, {POST}, {BASE}, {SCORED},
ix AS (SELECT qid, id, file_path, score FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path, id) <= 300),
co AS (SELECT qid, id, file_path, max(score)::DOUBLE AS score, bool_or(by_text) AS by_text FROM
  (SELECT *, false AS by_text FROM ix UNION ALL SELECT *, true FROM th) GROUP BY qid, id, file_path),
comp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path, id)::INTEGER AS rank FROM co QUALIFY rank <= 50)"""
ORACLE_SQL["composite_search"] = f"WITH {_COMPOSITE} SELECT * FROM comp"
_PATHS_SCORED = r"""SELECT qid, repository, file_path, sum(CASE
  WHEN term = regexp_replace(list_last(string_split(lower(file_path), '/')), '^(.+)\.[^.]*$', '\1') THEN 6
  WHEN contains(list_last(string_split(lower(file_path), '/')), term) THEN 4
  WHEN contains(lower(file_path), '/' || term || '/') OR starts_with(lower(file_path), term || '/') THEN 3 ELSE 1 END)::BIGINT AS score
FROM tm JOIN (SELECT DISTINCT repository, file_path FROM artifacts) p ON contains(lower(file_path), term) JOIN req USING (qid)
WHERE (repo_scope IS NULL OR list_contains(repo_scope, repository)) GROUP BY qid, repository, file_path"""
ORACLE_SQL["path_search"] = f"""WITH {REQ}, {ALL_TERMS}, s AS ({_PATHS_SCORED})
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path DESC, repository DESC)::INTEGER AS rank FROM s QUALIFY rank <= 20"""
_KIND = "CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END"
_BY_PATH = f"""ps AS ({_PATHS_SCORED}), pk AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path DESC, repository DESC) <= 20),
pr AS (SELECT qid, id, file_path, row_number() OVER (PARTITION BY qid, repository, file_path ORDER BY {_KIND}, line_start, id)::INTEGER AS rank
  FROM pk JOIN cur USING (repository, file_path) JOIN req USING (qid) WHERE tier <= user_tier QUALIFY rank <= 2)"""
ORACLE_SQL["path_rows"] = f"WITH {CUR}, {REQ}, {ALL_TERMS}, {_BY_PATH} SELECT * FROM pr"
_CLASS_ENDS = "[" + ",".join(f"'{x}'" for x in CLASS_SUFFIXES) + "]"
_NAMED = rf"""cl AS (SELECT qid, user_tier, repo_scope, query, list_concat(
    list_filter(flatten(list_transform(regexp_extract_all(query, '[A-Z][A-Za-z0-9_]*(?:::[A-Za-z0-9_]+)+'), lambda x: string_split(x, '::'))), lambda x: regexp_matches(x, '^[A-Z]')),
    regexp_extract_all(query, '`([A-Z][A-Za-z0-9_]{{1,}})`', 1)) AS classes FROM @asked),
ng AS (SELECT qid, user_tier, repo_scope, list_transform(list_concat(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_\-]*\.(?:{"|".join(NAMED_SUFFIXES)})'),
    flatten(list_transform(classes, lambda c: list_transform({_CLASS_ENDS}, lambda s: c || s)))), lambda x: lower(x)) AS names FROM cl),
nn AS (SELECT qid, user_tier, repo_scope, name, min(place) AS place FROM (SELECT qid, user_tier, repo_scope, unnest(names) AS name, generate_subscripts(names, 1) AS place FROM ng) GROUP BY ALL),
nh AS (SELECT qid, name, id, file_path, kind, line_start, false AS by_text, place FROM nn JOIN cur ON ends_with({_NAME}, name) AND tier <= user_tier AND (repo_scope IS NULL OR list_contains(repo_scope, repository))),
cc AS (SELECT qid, user_tier, repo_scope, lower(class) AS term, min(place) AS place FROM (SELECT qid, user_tier, repo_scope, unnest(classes) AS class, generate_subscripts(classes, 1) AS place FROM cl) GROUP BY ALL),
co_ AS (SELECT * FROM cc WHERE NOT EXISTS (SELECT 1 FROM nh WHERE nh.qid = cc.qid AND list_contains(list_transform({_CLASS_ENDS}, lambda s: cc.term || s), nh.name))),
tx AS (SELECT qid, term, id, file_path, kind, line_start, place FROM co_ JOIN cur ON contains(lower(text), term) AND tier <= user_tier AND (repo_scope IS NULL OR list_contains(repo_scope, repository))
  AND regexp_matches(lower(file_path), '({"|".join(x.replace(".", "[.]") for x in CLASS_SUFFIXES)})$')),
tf AS (SELECT qid, term FROM tx GROUP BY qid, term HAVING count(DISTINCT file_path) <= 8),
nu AS (SELECT qid, id, file_path, kind, line_start, min(by_text::INTEGER * 1000000 + place) AS p FROM
  (SELECT qid, id, file_path, kind, line_start, by_text, place FROM nh UNION ALL SELECT qid, id, file_path, kind, line_start, true, place FROM tx JOIN tf USING (qid, term)) GROUP BY 1, 2, 3, 4, 5),
named AS (SELECT qid, id, file_path, p >= 1000000 AS by_text, row_number() OVER (PARTITION BY qid, file_path ORDER BY p, {_KIND}, line_start, id)::INTEGER AS rank FROM nu QUALIFY rank <= 2)"""
ORACLE_SQL["file_name_search"] = f"""WITH {CUR}, r AS (SELECT h.qid, h.query, NULL::VARCHAR[] AS repo_scope, coalesce(CASE a.tier WHEN 'T-1' THEN 1 WHEN 'T-2' THEN 2 WHEN 'T-3' THEN 3 END, 1) AS user_tier
  FROM (SELECT id AS qid, min(query) AS query, min(user_id) AS user_id FROM user_history WHERE query IS NOT NULL GROUP BY id) h LEFT JOIN access_matrix a USING (user_id)),
{_NAMED.replace("@asked", "r")} SELECT * FROM named"""
_BUCKETS = """SELECT {key}, bucket, sum(sign)::BIGINT AS weight FROM (SELECT {key}, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 128 AS bucket,
  CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z_][a-z0-9_]*')) AS token FROM {table})) GROUP BY 1, 2 HAVING sum(sign) <> 0"""
ORACLE_SQL["hash_embedding"] = f"""WITH {CUR}, w AS ({_BUCKETS.format(key="id", text="text", table="cur")})
SELECT id, string_agg(bucket, ',' ORDER BY bucket) AS buckets, string_agg(weight, ',' ORDER BY bucket) AS weights FROM w GROUP BY id"""
_VECTOR = f"""w AS ({_BUCKETS.format(key="id", text="text", table="cur")}), q AS ({_BUCKETS.format(key="qid", text="query", table="req")}),
wn AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY id), qn AS (SELECT qid, sqrt(sum(weight * weight)) AS m FROM q GROUP BY qid),
dots AS (SELECT q.qid, w.id, sum(q.weight * w.weight) AS dot FROM q JOIN w USING (bucket) GROUP BY 1, 2),
vs AS (SELECT al.qid, al.id, round(coalesce(dot, 0) / (n * m), 6) AS score FROM al JOIN qn ON qn.qid = al.qid JOIN wn ON wn.id = al.id LEFT JOIN dots ON dots.qid = al.qid AND dots.id = al.id)"""
ORACLE_SQL["vector_search"] = f"""WITH {CUR}, {REQ}, {ALLOWED}, {_VECTOR}
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank, score FROM vs QUALIFY rank <= 20"""


def _is_related(a: str, b: str, stem=None) -> str:
    stem = stem or _stem
    return f"(length({stem(a)}) >= 5 AND length({stem(b)}) >= 5 AND left({stem(a)}, 5) = left({stem(b)}, 5))"


def _rerank_stem(x: str) -> str:
    return f"CASE WHEN ends_with({x}, 's') AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {_stem(x)} END"


_FACTS = f"""fa AS (SELECT id, repository, file_path, kind, symbol_name, coalesce(metadata['qualified_name'], '') AS qualified, {_LOW} AS path, {_NAME} AS name, {_SUFFIX} AS suffix, line_end,
  lower(concat_ws(' ', id, symbol_name, file_path, {_NAME}, kind, text, {META})) AS w,
  list_filter(list_concat([{_LOW}, {_NAME}, {_STEM_OF}, ltrim({_SUFFIX}, '.')], list_concat(regexp_split_to_array({_NAME}, '[^a-z0-9]+'), regexp_split_to_array({_STEM_OF}, '[^a-z0-9]+'))), lambda x: x <> '') AS high,
  list_filter(regexp_split_to_array(regexp_replace({_LOW}, '/?[^/]*$', ''), '[^a-z0-9]+'), lambda x: x <> '') AS low,
  ends_with({_LOW}, '.schema.json') OR contains(lower(concat_ws(' ', id, symbol_name, file_path, kind, text, {META})), '{SCHEMA_ROLE}') AS schema_doc,
  list_contains({_list(OPERATIONAL_SUFFIXES)}, {_SUFFIX}) OR list_has_any(string_split({_LOW}, '/'), {_list(OPERATIONAL_FOLDERS)}) OR regexp_matches(kind, '{"|".join(OPERATIONAL_KINDS)}') AS operational,
  {_SUFFIX} = '' AND line_end <= 3 AS config FROM cur)"""


def _path_points(t: str, p, stem=None) -> str:
    return f"""CASE WHEN length({t}) < 3 THEN 0.0 WHEN list_contains(high, {t}) THEN {p.name} WHEN len(list_filter(high, lambda x: {_is_related(t, "x", stem)})) > 0 THEN {p.related_name}
  WHEN list_contains(low, {t}) THEN {p.folder} WHEN len(list_filter(low, lambda x: {_is_related(t, "x", stem)})) > 0 THEN {p.related_folder} ELSE 0.0 END"""


def _named_points(x: str, p, whole: str) -> str:
    return f"""(CASE WHEN {x} = path THEN {p.path} WHEN {x} = name THEN {p.basename} WHEN ends_with({x}, '/') AND contains(path, {x}) THEN {p.under} WHEN contains(path, {x}) THEN {p.in_path}
  WHEN contains({whole}, {x}) THEN {p.in_text} ELSE 0.0 END + CASE WHEN starts_with({x}, '.') AND {x} = suffix THEN {p.suffix} ELSE 0.0 END)"""


def _bonuses(p, terms: str) -> str:
    return f"""(CASE WHEN list_contains({terms}, 'schema') AND NOT list_has_any({terms}, {_list(POLICY_TERMS)}) AND schema_doc THEN {p.schema} ELSE 0.0 END
  + CASE WHEN list_has_any({terms}, {_list(OPERATIONAL_TERMS)}) AND operational THEN {p.operational} ELSE 0.0 END + CASE WHEN config AND list_has_any({terms}, high) THEN {p.config} ELSE 0.0 END)"""


def _points(pairs: str) -> str:
    """(qid, id, points, held) of the retrieval score for ``pairs(qid, id)``."""
    return f"""SELECT p.qid, p.id, round((coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(w, t) THEN {RETRIEVAL.term} ELSE 0.0 END + {_path_points("t", RETRIEVAL)})), 0)
  + coalesce(list_sum(list_transform(named, lambda x: {_named_points("x", RETRIEVAL, "w")})), 0) + {_bonuses(RETRIEVAL, "terms")})::DOUBLE, 6) AS points,
  len(list_filter(terms, lambda t: contains(w, t))) > 0 AS held
FROM {pairs} p JOIN fa USING (id) JOIN (SELECT qid, {TERMS} AS terms, list_filter(list_concat({LITERALS}, {PATHS}), lambda x: x <> '') AS named FROM req) USING (qid)"""


_RESCORED = f"""{_VECTOR}, vh AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 80), {_FACTS},
vp AS ({_points("vh")}), vr AS (SELECT qid, id, round(score + points, 6) AS score FROM vh JOIN vp USING (qid, id)),
rs AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank FROM vr QUALIFY rank <= 20)"""
ORACLE_SQL["vector_rescored"] = f"WITH {CUR}, {REQ}, {ALLOWED}, {_RESCORED} SELECT * FROM rs"
_DENSE = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT q.vec_id AS qid, e.vec_id AS id, q.label AS own, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q CROSS JOIN e WHERE q.vec_id % 50 = 0)"""
ORACLE_SQL["dense_nearest"] = f"WITH {_DENSE} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INTEGER AS rank, score FROM s QUALIFY rank <= 10"
ORACLE_SQL["label_votes"] = f"""WITH {_DENSE}, t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 11)
SELECT qid, count(*) FILTER (own = label) AS same, count(*) AS others FROM t WHERE qid <> id GROUP BY qid"""
_EDGES = "e AS (SELECT DISTINCT source_id, target_id, relationship FROM edges WHERE source_id <> target_id)"
ORACLE_SQL["edges_clean"] = f"""WITH {_EDGES}, g AS (SELECT relationship, count(*) AS given FROM edges GROUP BY 1)
SELECT relationship, any_value(given) AS given, count(*) AS distinct_edges,
count(*) FILTER (source_id IN (SELECT id FROM artifacts) AND target_id IN (SELECT id FROM artifacts)) AS induced_edges FROM e JOIN g USING (relationship) GROUP BY relationship"""
_PRIO = """CASE relationship WHEN 'references' THEN 0 WHEN 'validated-by' THEN 1 WHEN 'calls' THEN 2 WHEN 'defines' THEN 3 WHEN 'imports' THEN 4
WHEN 'inherits' THEN 5 WHEN 'uses' THEN 6 WHEN 'bridges' THEN 7 ELSE 10 END"""
_NEAR = "near AS (SELECT id, neighbour, min(priority) AS priority FROM (SELECT source_id AS id, target_id AS neighbour, {p} AS priority FROM {e} UNION ALL SELECT target_id, source_id, {p} FROM {e}) GROUP BY 1, 2)"
ORACLE_SQL["neighbours"] = f"WITH {_EDGES}, {_NEAR.format(p=_PRIO, e='e')} SELECT id, count(*) AS neighbours, min(priority)::INTEGER AS best, min(neighbour) AS first FROM near GROUP BY id"
ORACLE_SQL["degree_centrality"] = f"""WITH {_EDGES} SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree
FROM (SELECT source_id AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT target_id, 1, 0 FROM e) GROUP BY id"""


def _level(n: int) -> str:
    """One level of the walk: visible nodes not seen yet, placed after the ones seen, unless ``breadth`` are."""
    return f"""full{n} AS MATERIALIZED (SELECT qid, count(*) AS n FROM s{n - 1} GROUP BY qid),
r{n} AS MATERIALIZED (SELECT l.qid, k.neighbour AS id, min(l.position * 100 + k.priority) AS via, any_value(f.n) AS n FROM s{n - 1} l JOIN full{n} f USING (qid) JOIN near k USING (id)
  JOIN al ON al.qid = l.qid AND al.id = k.neighbour
  WHERE l.level = {n - 1} AND f.n < 50 AND NOT EXISTS (SELECT 1 FROM s{n - 1} x WHERE x.qid = l.qid AND x.id = k.neighbour) GROUP BY 1, 2),
s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL SELECT qid, id, {n}, n + row_number() OVER (PARTITION BY qid ORDER BY via, id) FROM r{n})"""


_ANCHORS = f"""{CUR}, {REQ}, {ALLOWED}, {_RESCORED}, ap AS ({_points("al")}),
a1 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY points DESC, id) AS rank FROM ap WHERE held QUALIFY rank <= 50),
anchor AS (SELECT * FROM a1 UNION ALL SELECT qid, id, rank FROM rs WHERE rank <= 3 AND qid NOT IN (SELECT qid FROM a1))"""
_STEPS = f"""e AS (SELECT DISTINCT source_id, target_id, relationship FROM edges WHERE source_id <> target_id), {_NEAR.format(p=_PRIO, e="e")},
s0 AS MATERIALIZED (SELECT qid, id, 0 AS level, row_number() OVER (PARTITION BY qid ORDER BY rank, id) AS position FROM @anchors),
{_level(1)}, {_level(2)}, {_level(3)}"""
_WALK = f"{_ANCHORS}, {_STEPS.replace('@anchors', 'anchor')}"
ORACLE_SQL["graph_search"] = f"WITH {_WALK} SELECT qid, id, level::INTEGER AS level, position::INTEGER AS position FROM s3 WHERE position <= 50"
ORACLE_SQL["graph_walk"] = f"""WITH {LEX}, {ALLOWED}, {_STEPS.replace("@anchors", "(SELECT * FROM lex WHERE rank <= 2)")}
SELECT qid, id, level::INTEGER AS level, position::INTEGER AS position FROM s3 WHERE position <= 50"""
ORACLE_SQL["listed_edges"] = f"""WITH {CUR}, {_EDGES}, t AS (SELECT unnest([1, 2, 3])::INTEGER AS user_tier)
SELECT user_tier, relationship, count(*) AS edges FROM t JOIN e ON true JOIN cur a ON a.id = source_id AND a.tier <= user_tier JOIN cur b ON b.id = target_id AND b.tier <= user_tier GROUP BY 1, 2"""
ORACLE_SQL["resolve_symbols"] = f"""WITH q AS (SELECT DISTINCT query, repo_scope FROM user_history WHERE query IS NOT NULL),
n AS (SELECT unnest({LITERALS}) AS name, repo_scope FROM q), r AS (SELECT DISTINCT name, unnest(repo_scope) AS repository FROM n),
u AS (SELECT repository, lower(symbol_name) AS name, min(id) AS id FROM artifacts WHERE symbol_name IS NOT NULL AND kind LIKE '%-implementation' GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT r.repository || ':' || r.name AS ref, r.repository, r.name, u.id FROM r LEFT JOIN u ON u.repository = r.repository AND u.name = r.name"""
def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _identifier_parts(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({x}, '[^A-Za-z0-9]+'), lambda w: w <> '')"
    each = f"flatten(list_transform({words}, lambda w: list_concat([lower(w), {_norm('w')}], list_transform({_camel('w')}, lambda c: lower(c)))))"
    return f"list_filter(list_append({each}, {_norm(x)}), lambda y: y <> '')"


def _kept_rerank(tokens: str) -> str:
    return f"list_filter(flatten(list_transform({tokens}, lambda r: {_identifier_parts('r')})), lambda t: length(t) > 1 AND NOT list_contains({_list(RERANK_STOPWORDS)}, t))"


_RWORDS = _kept_rerank(r"regexp_extract_all(replace(lower(query), '\', '/'), '[a-z_][a-z0-9_]*')")
_RTERMS = f"""list_distinct(list_filter(list_concat(list_concat({_RWORDS}, list_transform({_RWORDS}, lambda t: {_rerank_stem("t")})),
  list_concat({PATHS}, flatten(list_transform({LITERALS}, lambda l: list_append({_kept_rerank("regexp_extract_all(l, '[a-z_][a-z0-9_]*')")}, l))))), lambda t: t <> ''))"""
_QPARTS = f"flatten(list_transform(string_split_regex(qualified, '::|\\.|#'), lambda q: {_identifier_parts('q')}))"
_OWNERS = "list_filter(string_split_regex(qualified, '::|\\.|#'), lambda p: p <> '')"
_P = RERANK
_TERM_POINTS = f"""CASE WHEN contains(ws, t) THEN {_P.term} ELSE 0.0 END + {_path_points("t", _P, _rerank_stem)}
  + CASE WHEN t = sym THEN 40.0 + CASE WHEN kind IN ('class', 'struct', 'interface', 'enum') THEN 15.0 ELSE 0.0 END + CASE WHEN contains(kind, 'implementation') THEN 20.0 ELSE 0.0 END
    WHEN t = qn THEN 35.0 WHEN len(parts) > 0 AND list_last(parts) = t THEN 18.0 WHEN list_contains(parts, t) THEN 3.0 WHEN contains(sym || ' ' || qn, t) THEN 6.0 ELSE 0.0 END"""
_RERANK = f"""{_COMPOSITE}, {ALL_TERMS}, {_BY_PATH}, {_NAMED.replace("@asked", "req")}, {_FACTS},
hits AS (SELECT qid, id, max(score) AS score, bool_or(bl) AS bl, bool_or(bt) AS bt, bool_or(bn) AS bn, bool_or(bp) AS bp FROM
  (SELECT qid, id, score, true AS bl, by_text AS bt, false AS bn, false AS bp FROM comp UNION ALL SELECT qid, id, 1.0, false, by_text, NOT by_text, false FROM named
   UNION ALL SELECT qid, id, 0.0, false, false, false, true FROM pr) GROUP BY qid, id),
fb AS (SELECT fa.* EXCLUDE (w), lower(concat_ws(' ', id, coalesce(fa.symbol_name, ''), file_path, kind, c.text, {META})) AS ws, {_norm("coalesce(fa.symbol_name, '')")} AS sym, {_norm("qualified")} AS qn,
  {_ordered_distinct("qp")} AS parts, {_OWNERS} AS owners FROM (SELECT *, {_QPARTS} AS qp FROM fa WHERE id IN (SELECT id FROM hits)) fa JOIN (SELECT id, text, metadata FROM cur) c USING (id)),
ra AS (SELECT qid, {_RTERMS} AS terms, list_filter(list_concat({LITERALS}, {PATHS}), lambda x: x <> '') AS named FROM req),
sc AS (SELECT h.qid, h.id, file_path, name, score, round((coalesce(list_sum(list_transform(terms, lambda t: {_TERM_POINTS})), 0)
  + coalesce(list_sum(list_transform(named, lambda x: {_named_points("x", _P, "ws")})), 0) + {_bonuses(_P, "terms")}
  + CASE WHEN regexp_matches(kind, '(?i)method|function') AND len(parts) >= 2 AND list_has_any(parts[1:len(parts) - 1], terms) AND list_has_any(parts[2:], terms) THEN 60.0 ELSE 0.0 END
  + CASE WHEN bp THEN 6.0 ELSE 0.0 END + CASE WHEN bn THEN 5.0 ELSE 0.0 END + CASE WHEN bl THEN 4.0 ELSE 0.0 END + CASE WHEN bt THEN 2.0 ELSE 0.0 END)::DOUBLE, 4) AS rerank_score,
  {_norm("coalesce(CASE WHEN kind IN ('class', 'struct', 'interface', 'enum', 'class-implementation', 'struct-implementation') THEN list_last(owners) WHEN len(owners) > 1 THEN owners[len(owners) - 1] END, '')")} AS owner
  FROM hits h JOIN fb USING (id) JOIN ra USING (qid)),
od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, score DESC, id) AS rn FROM sc),
dv AS (SELECT qid, 0::BIGINT AS r, []::VARCHAR[] AS kept, []::VARCHAR[] AS ow, []::VARCHAR[] AS fi, []::VARCHAR[] AS na FROM (SELECT DISTINCT qid FROM od)
  UNION ALL SELECT d.qid, o.rn, CASE WHEN ok THEN list_append(kept, o.id) ELSE kept END, CASE WHEN ok AND o.owner <> '' THEN list_append(ow, o.owner) ELSE ow END,
    CASE WHEN ok THEN list_append(fi, o.file_path) ELSE fi END, CASE WHEN ok THEN list_append(na, o.name) ELSE na END
  FROM dv d JOIN od o ON o.qid = d.qid AND o.rn = d.r + 1,
  LATERAL (SELECT len(kept) < 8 AND (NOT (list_contains(fi, o.file_path) OR list_contains(na, o.name)) OR list_contains(ow, o.owner)) AS ok)),
de AS (SELECT qid, kept, fi FROM dv QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r DESC) = 1),
fl AS (SELECT o.qid, o.id, row_number() OVER (PARTITION BY o.qid ORDER BY rn) AS k, len(kept) AS n FROM od o JOIN de ON de.qid = o.qid WHERE NOT list_contains(fi, o.file_path)
  QUALIFY row_number() OVER (PARTITION BY o.qid, o.file_path ORDER BY rn) = 1),
best AS (SELECT qid, id, pos::INTEGER AS position FROM (SELECT qid, unnest(kept) AS id, generate_subscripts(kept, 1) AS pos FROM de)
  UNION ALL SELECT qid, id, (n + row_number() OVER (PARTITION BY qid ORDER BY k))::INTEGER FROM fl),
bst AS (SELECT qid, id, file_path, rerank_score, position FROM best JOIN sc USING (qid, id) WHERE position <= 8)"""
ORACLE_SQL["rerank"] = f"WITH RECURSIVE {_RERANK} SELECT * FROM bst"
ORACLE_SQL["merge_by_file"] = f"""WITH {LEX}, h AS (SELECT lex.*, symbol_name, line_start, line_end FROM lex JOIN cur USING (id)),
s AS (SELECT qid, file_path, symbol_name, min(rank) AS r FROM h WHERE symbol_name IS NOT NULL GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY qid, file_path ORDER BY min(rank), symbol_name) <= 4),
a AS (SELECT qid, file_path, string_agg(symbol_name, ', ' ORDER BY r, symbol_name) AS symbols FROM s GROUP BY 1, 2)
SELECT h.qid, h.file_path, min(rank)::INTEGER AS position, min(line_start)::INTEGER AS line_start, max(line_end)::INTEGER AS line_end, coalesce(any_value(symbols), '') AS symbols
FROM h LEFT JOIN a ON a.qid = h.qid AND a.file_path = h.file_path GROUP BY 1, 2"""
ORACLE_SQL["u_shape"] = f"""WITH {LEX}, n AS (SELECT qid, id, rank, count(*) OVER (PARTITION BY qid) AS n FROM lex)
SELECT qid, id, rank, (CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - rank // 2 END + 1)::INTEGER AS place FROM n"""
_SUMMARY = """SELECT id, format('{} ({}, {}, lines {}-{}) - ', coalesce(symbol_name, file_path), kind, language, line_start, line_end)
  || CASE WHEN w IS NOT NULL THEN 'Mentions ' || array_to_string(w[1:10], ', ') || '.' ELSE 'No salient identifiers extracted.' END AS summary
FROM cur LEFT JOIN (SELECT id, list(token ORDER BY pos) AS w FROM (SELECT id, token, min(pos) AS pos FROM
  (SELECT id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*') AS l FROM cur))
  WHERE length(token) > 2 AND NOT starts_with(token, '__') GROUP BY id, token) GROUP BY id) USING (id)"""
ORACLE_SQL["quality_flags"] = r"""WITH t AS (SELECT coalesce(response, '') AS text FROM harness_traces QUALIFY row_number() OVER (PARTITION BY trace_id) = 1),
l AS (SELECT text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM t)
SELECT array_to_string(list_filter([CASE WHEN regexp_matches(text, $p$(?i)\b(?:[A-Z]:[\\/]|(?:\.{1,2}|src|tests?|scripts?|evaluation|[A-Za-z0-9_.-]+)[\\/])[^\s`'"),]+$p$) THEN 'path_leak' END,
  CASE WHEN regexp_matches(text, $p$(?m)^\s*(?:class|def|async def|return|if|else|for|while|switch|case|template|namespace|public:|private:|protected:|[A-Za-z_:<>~*&\s]+\([^)]*\)\s*(?:const)?\s*[;{])$p$) THEN 'raw_code' END,
  CASE WHEN len(lines) > 0 AND (lower(lines[1]) IN ('relevant files:', 'files:', 'source files:', 'sources:', 'paths:', 'file paths:')
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[-*]') AND regexp_matches(x, $p$(?i)\b(?:[A-Z]:[\\/]|(?:\.{1,2}|src|tests?|scripts?|evaluation|[A-Za-z0-9_.-]+)[\\/])[^\s`'"),]+$p$))) >= greatest(1, len(lines) - 1)) THEN 'path_list' END,
  CASE WHEN trim(text, ' ') = '' THEN 'empty' END], lambda x: x IS NOT NULL), ',') AS flags, count(*) AS responses FROM l GROUP BY 1"""
ORACLE_SQL["summaries"] = f"WITH {CUR} {_SUMMARY}"
ORACLE_SQL["prompts"] = f"""WITH {LEX}, sm AS ({_SUMMARY}), t AS (SELECT qid, id, rank, count(*) OVER (PARTITION BY qid) AS n FROM lex WHERE rank <= 8),
p AS (SELECT qid, (CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - rank // 2 END + 1)::INTEGER AS place, summary FROM t JOIN sm USING (id)),
c AS (SELECT qid, string_agg('[' || place || '] ' || summary, chr(10) ORDER BY place) AS context FROM p GROUP BY qid)
SELECT qid, 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query AS prompt FROM c JOIN req USING (qid)"""
ORACLE_SQL["hybrid_search"] = f"""WITH {_WALK}, sl AS (SELECT qid, greatest(1, floor(count(*) * 0.5)) AS slots FROM rs GROUP BY qid), {_NAMED.replace("@asked", "req")},
parts AS (SELECT qid, id, 0 AS band, row_number() OVER (PARTITION BY qid ORDER BY file_path, rank, id) AS rank FROM named
  UNION ALL SELECT rs.qid, id, CASE WHEN rank <= slots THEN 1 ELSE 3 END, rank FROM rs JOIN sl USING (qid)
  UNION ALL SELECT qid, id, 2, position FROM s3 WHERE position <= 50),
o AS (SELECT qid, id, min(band * 1000000 + rank) AS place FROM parts GROUP BY 1, 2)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place, id)::INTEGER AS position FROM o QUALIFY position <= 20"""
ORACLE_SQL["access_violations"] = """SELECT unnest(['lexical', 'composite', 'named', 'paths', 'vector', 'rescored', 'graph', 'hybrid', 'rerank']) AS search, 0::BIGINT AS above_tier, 0::BIGINT AS out_of_scope"""
ORACLE_SQL["search_quality"] = rf"""WITH req AS (SELECT id AS qid, min(query) AS query, NULL::VARCHAR[] AS repo_scope FROM user_history WHERE query IS NOT NULL GROUP BY id),
nm AS (SELECT DISTINCT qid, path AS gold, regexp_extract(path, '\.(\w+)$', 1) AS suffix FROM (SELECT qid, unnest({PATHS}) AS path FROM req) WHERE regexp_matches(path, '/.*\.\w+$')),
{ALL_TERMS}, s AS ({_PATHS_SCORED}),
k AS (SELECT qid, lower(file_path) AS path, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path DESC, repository DESC) AS rank FROM s QUALIFY rank <= 8),
m AS (SELECT nm.qid, suffix, gold, min(CASE WHEN path = gold OR ends_with(path, '/' || gold) OR list_last(string_split(path, '/')) = list_last(string_split(gold, '/')) THEN rank END) AS first
  FROM nm LEFT JOIN k USING (qid) GROUP BY 1, 2, 3),
p AS (SELECT qid, suffix, min(first) AS first, avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END) AS recall FROM m GROUP BY 1, 2)
SELECT coalesce(suffix, 'total') AS suffix, count(*) AS requests, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(recall), 6) AS recall,
round(avg(CASE WHEN recall = 1.0 THEN 1.0 ELSE 0.0 END), 6) AS all_gold, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM p GROUP BY ROLLUP (suffix)"""
ORACLE_SQL["audit_once_stream"] = "SELECT coalesce(access_tier, 'none') AS access_tier, count(DISTINCT id) AS requests FROM audit_log GROUP BY 1"
ORACLE_SQL["audit_append_stream"] = """SELECT strftime(make_timestamp((created_at * 1000000)::BIGINT), '%Y-%m-%d') AS day, count(*) AS rows,
count(*) FILTER (cache_hit) AS hits FROM audit_log GROUP BY 1"""
_CALLS = r"""b AS (SELECT * FROM cur WHERE kind LIKE '%-implementation' AND text IS NOT NULL),
c AS (SELECT DISTINCT id AS source_id, repository, file_path, unnest(regexp_extract_all(text, '([A-Za-z_]\w*)\s*\(', 1)) AS name FROM b),
y AS (SELECT repository, file_path, symbol_name AS name, min(id) AS target_id FROM b WHERE symbol_name IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1)"""
ORACLE_SQL["fallback_answers"] = f"""WITH RECURSIVE {_RERANK}, sm AS ({_SUMMARY}),
l AS (SELECT qid, string_agg('- ' || summary, chr(10) ORDER BY position) AS lines FROM bst JOIN sm USING (id) WHERE position <= 5 AND rerank_score >= 2 GROUP BY qid)
SELECT qid, 'For `' || query || '`, ' || CASE WHEN lines IS NOT NULL THEN 'the useful retrieved signals are:' || chr(10) || lines
  ELSE 'the indexed context is too thin for an answer.' END AS answer FROM req LEFT JOIN l USING (qid)"""
ORACLE_SQL["policy_decisions"] = ORACLE_SQL["quality_flags"].split("SELECT array_to_string")[0].replace(
    "SELECT coalesce(response, '') AS text FROM", "SELECT coalesce(response, '') AS text, retrieval_ids FROM"
).replace("SELECT text, list_filter", "SELECT text, retrieval_ids, list_filter") + r"""SELECT CASE WHEN len(coalesce(retrieval_ids, [])) = 0 THEN 'no_context'
  WHEN trim(text, ' ') = '' THEN 'empty' WHEN regexp_matches(text, '(?i)\[Inference Error:.*?\]') THEN 'error'
  WHEN len(lines) > 0 AND (lower(lines[1]) IN ('relevant files:', 'files:', 'source files:', 'sources:', 'paths:', 'file paths:')
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[-*]') AND regexp_matches(x, $p$(?i)\b(?:[A-Z]:[\\/]|(?:\.{1,2}|src|tests?|scripts?|evaluation|[A-Za-z0-9_.-]+)[\\/])[^\s`'"),]+$p$))) >= greatest(1, len(lines) - 1))
  THEN 'path_list' ELSE 'kept' END AS decision, count(*) AS traces FROM l GROUP BY 1"""

ORACLE_SQL["sliding_chunks"] = """WITH s AS (SELECT doc_id AS id, text, unnest(range(0, length(text), 150)) AS start FROM documents WHERE length(text) > 0),
c AS (SELECT id, start, left(text, start) AS before, substr(text, start + 1, 200) AS chunk FROM s),
l AS (SELECT *, 1 + length(before) - length(replace(before, chr(10), '')) AS line FROM c)
SELECT id, start::INTEGER AS start, line::INTEGER AS line_start, (line + length(chunk) - length(replace(chunk, chr(10), '')))::INTEGER AS line_end, md5(chunk) AS digest FROM l"""
ORACLE_SQL["text_heads"] = rf"""WITH {CUR} SELECT id, (1 + length(left(text, 4000)) - length(replace(left(text, 4000), chr(10), '')))::INTEGER AS line_end, md5(left(text, 4000)) AS digest
FROM cur WHERE language LIKE 'text%' AND kind = 'chunk' AND regexp_matches(left(text, 4000), '\S')"""
ORACLE_SQL["sniffed_languages"] = rf"""WITH {CUR}, r AS (SELECT text, regexp_replace(regexp_replace(file_path, '\.(cpp|py)$', '.h'), '\.json$', '') AS p FROM cur),
n AS (SELECT text, p, CASE regexp_extract(lower(p), '[^/](\.[^./]+)$', 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())} ELSE 'text' END AS l FROM r)
SELECT CASE WHEN ends_with(lower(p), '.h') AND regexp_matches(left(text, 8192), '\b(class|namespace|template)\b|::|\b(public|private|protected):') THEN 'cpp'
  WHEN l = 'text' AND regexp_matches(text, '^\s*[\{{\[]') THEN 'json' ELSE l END AS language, count(*) AS artifacts FROM n GROUP BY 1"""
ORACLE_SQL["artifact_ids"] = f"""WITH {CUR} SELECT kind, count(*) AS artifacts, count(*) FILTER (id = repository || ':' || file_path || ':'
  || replace(CASE WHEN kind = 'module' THEN 'module' ELSE coalesce(metadata['qualified_name'], symbol_name, 'chunk-1') END, ' ', '_') || ':T' || tier) AS derived FROM cur GROUP BY kind"""
ORACLE_SQL["json_documents"] = f"""WITH {CUR} SELECT c.id, regexp_replace(replace(t.fullkey, '"', ''), '^\\$\\.?', '') AS path,
  CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' WHEN t.type = 'NULL' THEN NULL ELSE t.atom::VARCHAR END AS value, t.type = 'VARCHAR' AS is_text
FROM (SELECT id, text FROM cur WHERE language = 'json' AND text IS NOT NULL AND json_valid(text)) c, json_tree(c.text) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')"""
_SCHEMA = """json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT' AND (json_exists(CASE WHEN json_valid(text) THEN text END, '$."$schema"')
  OR coalesce(json_type(CASE WHEN json_valid(text) THEN text END, '$.properties') = 'OBJECT', false) OR coalesce(json_type(CASE WHEN json_valid(text) THEN text END, '$."$defs"') = 'OBJECT', false)
  OR coalesce(json_type(CASE WHEN json_valid(text) THEN text END, '$.definitions') = 'OBJECT', false))"""
_DOCS = rf"""dc AS (SELECT id, repository, file_path, text, lower(file_path) AS path, {_NAME} AS name, ltrim({_SUFFIX}, '.') AS sfx, {_STEM_OF} AS stem, regexp_extract(lower(file_path), '^(.*/)[^/]*$', 1) AS parent,
  coalesce({_SCHEMA}, false) AS is_schema FROM cur WHERE kind = 'json-document' AND text IS NOT NULL),
cd AS (SELECT *, list_concat(CASE WHEN sfx = '' THEN [] ELSE ['schemas/' || sfx || '.schema.json', 'schema/' || sfx || '.schema.json', parent || sfx || '.schema.json'] END,
  ['schemas/' || stem || '.schema.json', 'schema/' || stem || '.schema.json', parent || stem || '.schema.json', parent || name || '.schema.json']) AS l FROM dc)"""
ORACLE_SQL["schema_documents"] = f"WITH {CUR}, {_DOCS} SELECT id, is_schema, array_to_string({_ordered_distinct('l')}, '|') AS candidates FROM cd"
ORACLE_SQL["markdown_cells"] = rf"""WITH {CUR}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM cur),
t AS (SELECT id, line_no, string_split(regexp_replace(regexp_replace(line, '^\s*\|', ''), '\|\s*$', ''), '|') AS cells FROM l
  WHERE regexp_matches(line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(line, '^[\s|:\-]+$'))
SELECT id, line_no::INTEGER AS line_no, (generate_subscripts(cells, 1) - 1)::INTEGER AS col, trim(unnest(cells), ' ') AS cell FROM t"""
ORACLE_SQL["upsert_latest"] = """WITH c AS (SELECT id, min(repository) AS repository FROM artifacts GROUP BY id), i AS (SELECT id, max(updated_at) AS t FROM artifacts WHERE tier >= 2 GROUP BY id)
SELECT repository, count(*) AS artifacts, round(sum(coalesce(t, 0.0)), 0) AS total_time FROM c LEFT JOIN i USING (id) GROUP BY repository"""
ORACLE_SQL["tier_upserts"] = """WITH t AS (SELECT user_id, trace_id, max(created_at) AS w, max_by(access_tier, (created_at, access_tier)) AS tier FROM harness_traces WHERE access_tier IS NOT NULL GROUP BY 1, 2),
l AS (SELECT user_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, trace_id DESC) = 1)
SELECT * FROM l UNION ALL SELECT user_id, tier FROM access_matrix WHERE user_id NOT IN (SELECT user_id FROM l)"""
ORACLE_SQL["scope_grants"] = """SELECT group_name, count(*) AS repositories, min(repository) AS first FROM (SELECT * FROM group_scopes
UNION SELECT coalesce(access_tier, 'none'), unnest(repo_scopes) FROM harness_traces) GROUP BY 1"""
ORACLE_SQL["edge_upserts"] = "SELECT relationship, count(*) AS edges FROM (SELECT DISTINCT * FROM edges) GROUP BY 1"
_CALLS = r"""b AS (SELECT *, coalesce(metadata['qualified_name'], symbol_name) AS qualified FROM cur WHERE kind LIKE '%-implementation'),
c AS (SELECT DISTINCT id AS source_id, repository, file_path, regexp_extract(qualified, '^(.*)\.[^.]*$', 1) AS owner, unnest(regexp_extract_all(text, '([A-Za-z_][\w.]*)\s*\(', 1)) AS reference FROM b WHERE text IS NOT NULL),
q AS (SELECT repository, file_path, qualified, min(id) AS target FROM b WHERE qualified IS NOT NULL GROUP BY 1, 2, 3),
y AS (SELECT repository, file_path, regexp_extract(symbol_name, '([^.:]*)$', 1) AS short, min(id) AS target FROM b WHERE symbol_name IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT id) = 1),
f AS (SELECT source_id, coalesce(e.target, o.target, y.target) AS target_id FROM c
  LEFT JOIN q e ON e.repository = c.repository AND e.file_path = c.file_path AND contains(reference, '.') AND e.qualified = reference
  LEFT JOIN q o ON o.repository = c.repository AND o.file_path = c.file_path AND owner <> '' AND regexp_matches(reference, '^(self|cls|this)\.') AND o.qualified = owner || '.' || regexp_replace(reference, '^\w+\.', '')
  LEFT JOIN y ON y.repository = c.repository AND y.file_path = c.file_path AND NOT contains(reference, '.') AND y.short = reference)"""
ORACLE_SQL["call_edges"] = f"""WITH {CUR}, {_CALLS} SELECT DISTINCT source_id, target_id, 'calls' AS relationship FROM f WHERE target_id IS NOT NULL AND source_id <> target_id"""
ORACLE_SQL["blended_rescoring"] = f"""WITH RECURSIVE {_RERANK}, {_VECTOR}, bl AS (SELECT b.qid, b.id, b.file_path, round(0.4 * coalesce(dot / (n * m), 0.0) + 0.6 * least(rerank_score / 20, 1.0), 6)::DOUBLE AS score
  FROM bst b LEFT JOIN dots ON dots.qid = b.qid AND dots.id = b.id LEFT JOIN wn ON wn.id = b.id LEFT JOIN qn ON qn.qid = b.qid)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_path DESC, id)::INTEGER AS rank FROM bl"""
_LEAKS = " OR ".join(f"regexp_matches(r, $p${p}$p$)" for p in CODE_PATTERNS)
_REFUSES = " OR ".join(f"""contains(lower(r), '{m.replace("'", "''")}')""" for m in REFUSAL_MARKERS)
ORACLE_SQL["refusal_scores"] = f"""SELECT trace_id, CASE WHEN ({_REFUSES}) AND NOT ({_LEAKS}) THEN 1 ELSE 0 END AS score
FROM (SELECT trace_id, coalesce(min(response), '') AS r FROM harness_traces GROUP BY trace_id)"""
_GRADED = f"""g AS (SELECT trace_id AS id, (m).model_id AS model, coalesce((m).response, '') AS r, (m).query AS query, (m).retrieval_ids AS ids FROM
  (SELECT trace_id, min(struct_pack(query := query, response := response, model_id := model_id, retrieval_ids := retrieval_ids)) AS m FROM harness_traces GROUP BY trace_id)),
h AS (SELECT id, coalesce(model, 'none') AS model, CASE WHEN trim(r, ' ') = '' THEN 'thin-evidence' ELSE 'useful-answer' END AS category, list_concat(
  list_transform(list_filter(coalesce(regexp_extract_all(query, '`([^`]+)`', 1), []), lambda x: NOT contains(r, x)), lambda x: 'missing expected text: ' || x), list_concat(
  list_transform(list_filter(coalesce(ids, []), lambda x: x <> '' AND contains(r, x)), lambda x: 'forbidden text present: ' || x), list_filter([
  CASE WHEN regexp_matches(r, $p${PATH}$p$) THEN 'path leak' END, CASE WHEN regexp_matches(r, $p${RAW_CODE}$p$) THEN 'raw code leak' END,
  CASE WHEN trim(r, ' ') = '' THEN 'missing insufficiency language' END], lambda x: x IS NOT NULL))) AS failures FROM g)"""
ORACLE_SQL["case_grades"] = f"WITH {_GRADED} SELECT id, category, array_to_string(failures, '|') AS failures FROM h"
ORACLE_SQL["eval_report"] = f"""WITH {_GRADED} SELECT format('| {{}} | {{}} | {{}} | {{:.3f}} |', model, count(*), count(*) FILTER (len(failures) = 0), round(count(*) FILTER (len(failures) = 0) / count(*), 6)) AS line FROM h GROUP BY model
UNION ALL SELECT '| no cases | 0 | 0 | 1.000 |'"""
ORACLE_SQL["markdown_questions"] = r"""WITH u AS (SELECT id, min(query) AS query FROM user_history WHERE query IS NOT NULL GROUP BY id)
SELECT (id % 10)::VARCHAR AS path, 1 AS seed, 'src/' || id || '.py' AS expected, 2 AS difficulty, 'one' AS hops,
md5(trim(regexp_replace(lower(replace(query, '**', '')), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS digest FROM u WHERE trim(query, ' ') <> ''"""


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')"


def _flags(text: str) -> str:
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    return f"""[CASE WHEN regexp_matches({text}, $p${PATH}$p$) THEN 'path_leak' END, CASE WHEN regexp_matches({text}, $p${RAW_CODE}$p$) THEN 'raw_code' END,
  CASE WHEN len({lines}) > 0 AND (list_contains({_list(PATH_HEADINGS)}, lower({lines}[1])) OR len(list_filter({lines}, lambda x: regexp_matches(x, '^[-*]')
    AND regexp_matches(x, $p${PATH}$p$))) >= greatest(1, len({lines}) - 1)) THEN 'path_list' END, CASE WHEN trim({text}, ' ') = '' THEN 'empty' END]"""


_SHAPED = rf"""ln AS (SELECT *, list_transform(string_split_regex(replace(regexp_replace({_strip("text")}, $p${FILE_HEADER}$p$, '', 'g'), '```', ''), '\r\n|\n|\r'),
  lambda x: {_strip(f"regexp_replace(regexp_replace(x, $p${PATH}$p$, ' ', 'g'), '[ \t]{{2,}}', ' ', 'g')")}) AS lines FROM given),
kp AS (SELECT * EXCLUDE (lines), array_to_string(list_filter(lines, lambda x: x <> '' AND NOT list_contains({_list(PATH_HEADINGS + LIST_MARKS)}, lower(x))
  AND NOT list_contains({_list(VACUOUS_LINES)}, trim(lower(x), ' .:')) AND NOT regexp_matches(x, $p${"|".join((RAW_CODE, *CODE_LINES))}$p$)), chr(10)) AS kept FROM ln),
sh AS (SELECT * EXCLUDE (kept), CASE WHEN {_strip("text")} = '' THEN '' WHEN kept = '' THEN '{UNUSABLE}' ELSE kept END AS shaped FROM kp)"""
ORACLE_SQL["policy_applied"] = rf"""WITH given AS (SELECT trace_id, coalesce(response, '') AS text, len(coalesce(retrieval_ids, [])) > 0 OR trim(coalesce(prompt_summary, ''), ' ') <> '' AS context
  FROM harness_traces QUALIFY row_number() OVER (PARTITION BY trace_id) = 1), {_SHAPED},
a AS (SELECT trace_id, context, shaped, {_flags("text")} AS a, {_flags("shaped")} AS b FROM sh),
f AS (SELECT trace_id, context, shaped, list_filter(list_concat(a, list_filter(b, lambda x: NOT coalesce(list_contains(a, x), false))), lambda x: x IS NOT NULL) AS flags FROM a),
w AS (SELECT *, CASE WHEN NOT context THEN 'no_retrieval_context' WHEN shaped IN ('', '{UNUSABLE}') OR regexp_matches(shaped, '(?i)\[Inference Error:.*?\]')
  OR len(list_filter(string_split(shaped, chr(10)), lambda x: regexp_matches(regexp_replace(trim(x, ' '), '^\s*(?:[-*]\s*)?', ''), $p${ABSTRACT}$p$))) > 0
  OR regexp_matches(shaped, $p${LABEL}$p$) OR list_has_any(flags, ['path_leak', 'raw_code', 'path_list']) THEN 'fallback_used' END AS why FROM f)
SELECT trace_id, CASE WHEN why IS NULL THEN 'model' ELSE 'fallback' END AS source, array_to_string(CASE WHEN why IS NULL THEN flags ELSE list_append(flags, why) END, ',') AS flags,
  CASE WHEN why IS NULL THEN md5(shaped) END AS digest FROM w"""
ORACLE_SQL["cached_answers"] = rf"""WITH given AS (SELECT DISTINCT response AS text FROM user_history WHERE response IS NOT NULL), {_SHAPED}
SELECT md5(text) AS given, CASE WHEN shaped NOT IN ('', '{UNUSABLE}') AND {_flags("shaped")}[1] IS NULL AND {_flags("shaped")}[2] IS NULL THEN md5(shaped) END AS kept FROM sh"""
