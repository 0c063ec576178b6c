import os

import numpy as np
from pyspark.sql import functions as F

from fathom import session
from fathom.functions import access, text as T
from fathom.operators import answers, evaluation, graph, scan, scoring, search, tables, textindex, vectors
from fathom.plans import registry
from fathom.sources import files, links


def column(spark, expression, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_camel_parts(spark):
    got = column(spark, lambda x: F.array_join(T.camel_parts(x), "|"), "parseHTTP2Response", "get_userName", "HTTPServer", "", None)
    assert got == ["parse|HTT|2|Response", "get|user|Name", "HTTP|Server", "", ""]


def test_stems_differ_between_index_and_reranker(spark):
    assert column(spark, T.light_stem, "parsers", "normalization", "bus", "tests") == ["pars", "normal", "bus", "test"]
    assert column(spark, T.light_stem_rerank, "parsers", "glass") == ["parser", "glas"]


def test_query_terms_keep_order_and_literals(spark):
    got = column(spark, lambda x: F.array_join(T.query_terms(x), " "), "Where is `Foo.bar` in src/a_b.py defined?", None)
    assert got[0].split(" ")[:4] == ["foo", "bar", "src", "a_b"]
    assert "src/a_b.py" in got[0] and "foo.bar" in got[0] and got[1] == ""


def test_join_terms(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(T.join_terms(F.col("x"))).collect()] == ["a", "a and b", "a, b, and c", ""]


def test_scope_has_three_states(spark):
    rows = spark.createDataFrame([("i", "a", 1), ("j", "a", 3), ("k", "b", 1)], "id string, repository string, tier int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(access.visible(rows, 1, ["a"])) == ["i"]
    assert ids(access.visible(rows, 3, None)) == ["i", "j", "k"]
    assert ids(access.visible(rows, 3, [])) == []


def test_walk_respects_depth_and_breadth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls") for i in range(6)] + [("n0", "x", "references")], "source_id string, target_id string, relationship string")
    near = graph.adjacency(graph.clean_edges(edges))
    anchors = spark.createDataFrame([(1, "n0", 1)], "qid long, id string, rank int")
    got = {r.id: (r.level, r.position) for r in graph.walk(anchors, near, 2, 10).collect()}
    assert got == {"n0": (0, 1), "x": (1, 2), "n1": (1, 3), "n2": (2, 4)}
    assert graph.walk(anchors, near, 3, 2).count() == 2


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")], "source_id string, target_id string, relationship string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "pivot string")
    assert {r.id: r.score for r in graph.betweenness(edges, nodes).collect()} == {"b": 4.0, "c": 4.0}


def test_upsert_last_wins_and_anti_delete(spark):
    current = spark.createDataFrame([("a", 1.0, "old"), ("b", 1.0, "old")], "id string, t double, v string")
    incoming = spark.createDataFrame([("b", 2.0, "new"), ("b", 3.0, "newest"), ("c", 1.0, "new")], "id string, t double, v string")
    assert sorted((r.id, r.v) for r in tables.upsert(current, incoming, "id", "t").collect()) == [("a", "old"), ("b", "newest"), ("c", "new")]


def test_u_shape(spark):
    hits = spark.createDataFrame([(1, f"i{r}", r) for r in range(1, 6)], "qid long, id string, rank int")
    got = [r.id for r in answers.u_shape(hits).orderBy("place").collect()]
    assert got == ["i1", "i3", "i5", "i4", "i2"]


def test_fuse_keeps_first_place(spark):
    def hits(ids):
        return spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "qid long, id string, rank int")

    got = search.fuse(hits(["f"]), hits(["v1", "v2", "v3", "v4"]), hits(["g", "v1"]), 0.5).orderBy("position").collect()
    assert [r.id for r in got] == ["f", "v1", "v2", "g", "v3", "v4"]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    got = {}
    for r in vectors.nearest(asked, rows, 8, 5, sparse=False, id_type="long").orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, ids in got.items():
        assert ids == list(np.argsort(-(unit @ unit[q]), kind="stable")[:5])


def test_file_filters(spark):
    rows = spark.createDataFrame(
        [("1", "a/vendor/x.py", "x"), ("2", "a/.env", "x"), ("3", "b.py", "password = 'abcdefghijklm'"), ("4", "c.py", "# Generated by t\n"), ("5", "d.py", "x = 1"), ("6", "e.py", None), ("7", "f.py", "y" * 600)],
        "id string, file_path string, text string",
    )
    assert {r.id: r.reason for r in files.index_decisions(rows).collect()} == {
        "1": "excluded", "2": "sensitive", "3": "secret", "4": "generated", "5": "indexed", "6": "indexed", "7": "unreadable",
    }


def test_sliding_chunks_and_markdown(spark):
    rows = spark.createDataFrame([("a", "x" * 20), ("b", ""), ("c", None)], "id string, text string")
    got = [(r.id, r.start, len(r.chunk)) for r in files.sliding_chunks(rows, 10, 5).orderBy("start").collect()]
    assert got == [("a", 0, 10), ("a", 5, 10), ("a", 10, 10), ("a", 15, 5)]
    table = spark.createDataFrame([("t", "# h\n| a | b |\n|---|---|\n| 1 | 2 |")], "id string, text string")
    assert sorted((r.line_no, r.col, r.cell) for r in files.markdown_cells(table).collect()) == [(2, 0, "a"), (2, 1, "b"), (4, 0, "1"), (4, 1, "2")]


def test_empty_tables(spark):
    artifacts = spark.createDataFrame([], "id string, repository string, tier int, file_path string, kind string, symbol_name string, metadata map<string,string>, text string, line_start int, line_end int, updated_at double")
    asked = spark.createDataFrame([], "qid long, query string, user_tier int, repo_scope array<string>")
    assert search.lexical_index_search(asked, search.entries(artifacts)).count() == 0
    assert search.path_search(asked, artifacts).count() == 0
    assert vectors.nearest(spark.createDataFrame([], "qid long, vector array<float>"), spark.createDataFrame([], "id long, vector array<float>"), 4, 3, False, "long").count() == 0


def test_json_tree_leaves(spark):
    rows = spark.createDataFrame([("1", '{"a": {"b": [1, "x", {"c": null}]}, "d": "{y}"}'), ("2", "{bad"), ("3", None), ("4", "[]"), ("5", "7")], "id string, text string")
    got = {(r.id, r.path, r.value) for r in files.json_tree_leaves(rows).collect()}
    assert got == {("1", "$.a.b[0]", "1"), ("1", "$.a.b[1]", "x"), ("1", "$.a.b[2].c", None), ("1", "$.d", "{y}")}


def test_fallback_answer_says_when_there_is_too_little(spark):
    scored = spark.createDataFrame([(1, "a", 9, 1), (1, "b", 1, 2)], "qid long, id string, rerank_score long, position int")
    texts = spark.createDataFrame([("a", "A does."), ("b", "B does.")], "id string, summary string")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, query string")
    got = {r.qid: r.answer for r in answers.fallback_answers(scored, texts, asked).collect()}
    assert got[1].endswith("signals are:\n- A does.") and "too thin" in got[2]


def test_call_edges_resolve_in_order(spark):
    q = lambda name: {"qualified_name": name}
    kind = "method-implementation"
    rows = spark.createDataFrame(
        [("a", "r", "f.py", kind, "run", q("A.run"), "def run():\n  self.helper(1)\n  twice()\n  B.go(1)\n  x.helper()\n  once()"),
         ("b", "r", "f.py", kind, "helper", q("A.helper"), "def helper(x): pass"), ("c", "r", "f.py", kind, "helper", q("B.helper"), "x"),
         ("d", "r", "f.py", kind, "go", q("B.go"), "x"), ("e", "r", "f.py", "function-implementation", "twice", None, "x"), ("f", "r", "f.py", kind, "twice", q("B.twice"), "x"),
         ("g", "r", "f.py", "function-implementation", "once", None, None), ("h", "r", "g.py", "function-implementation", "once", None, None)],
        "id string, repository string, file_path string, kind string, symbol_name string, metadata map<string,string>, text string",
    )
    assert {(r.source_id, r.target_id) for r in graph.call_edges(rows).collect()} == {("a", "b"), ("a", "d"), ("a", "g")}


def test_documents_link_to_schemas_and_files(spark):
    rows = spark.createDataFrame(
        [("s", "r", "schemas/part.schema.json", "json-document", 1, '{"$schema": "x", "properties": {}}'), ("p", "r", "examples/widget.part", "json-document", 1, '{"material": "Steel"}'),
         ("j", "r", "examples/assembly.json", "json-document", 1, '{"uses": ["./widget.part", "https://a/b.c", "../schemas/part.schema.json", "word"], "out": "../../x.py"}'),
         ("x", "other", "examples/widget.part", "chunk", 1, "t"), ("b", "r", "bad.json", "json-document", 1, "{"), ("n", "r", "n.json", "json-document", 1, None)],
        "id string, repository string, file_path string, kind string, tier int, text string",
    )
    leaves = files.json_tree_leaves(rows.filter("kind = 'json-document'").select("id", "text"))
    got = {tuple(r) for r in links.cross_file_edges(rows, leaves).collect()}
    assert got == {("p", "s", "validated-by"), ("j", "p", "references"), ("j", "s", "references")}


def test_question_lists_cases_and_reports(spark, tmp_path):
    text = "# t\n## Seed 1\nno questions\n## Seed 2\n### Q1\n**Query**: where\nis it\n**Expected**: `src/a.py`, `src/b.py`\n**Difficulty**: 3\n**Hops**: two\n### Q2\n**Query**: nothing\n### Q3\n**Query**: last `src/c.py`"
    got = [tuple(r) for r in evaluation.load_questions(spark.createDataFrame([("q.md", text), ("e", ""), ("n", None)], "path string, text string")).orderBy("query").collect()]
    assert got == [("q.md", 1, "last `src/c.py`", ["src/c.py"], 2, ""), ("q.md", 1, "where is it", ["src/a.py", "src/b.py"], 3, "two")]
    (tmp_path / "c.jsonl").write_text('{"id": "1", "category": "thin-evidence", "query": "q", "model_output": "see src/x.py"}\n\n{"id": "2", "category": "useful-answer", "query": "q", "expected_contains": ["keel"], "model_output": "a keel"}\n')
    cases = evaluation.load_cases(spark, str(tmp_path / "c.jsonl"))
    graded = cases.select("id", "category", evaluation.failures(F.col("category"), F.col("model_output"), F.col("expected_contains"), F.col("forbidden")).alias("failures"))
    assert {r.id: len(r.failures) for r in graded.collect()} == {"1": 2, "2": 0}
    groups = spark.createDataFrame([("thin-evidence",), ("useful-answer",), ("none",)], "category string")
    assert {r.category: r.rate for r in evaluation.pass_rates(graded, groups, "category").collect()} == {"thin-evidence": 0.0, "useful-answer": 1.0, "none": 1.0}
    assert column(spark, evaluation.refusal_score, "I cannot say.", "I cannot, but def f(x)", "Sure", None) == [1, 0, 0, 0]
    manifest = evaluation.manifest(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert len(manifest) == 1 and len(manifest[0].sha256) == 64 and manifest[0].bytes > 0


def test_reading_files_and_partition_overwrite(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "x.py").write_text("é = 1\n", encoding="utf-8")
    (tmp_path / "src" / "y.bin").write_bytes(b"\xff\xfe\x00")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, [str(tmp_path / "src")]).collect()}
    assert got == {"x.py": "é = 1\n", "y.bin": None}
    target = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1, "r1"), ("b", 2, "r2")], "id string, tier int, repository string")
    tables.overwrite_repositories(rows, target)
    tables.overwrite_repositories(rows.filter("id = 'a'").withColumn("id", F.lit("new")), target)
    assert sorted((r.id, r.repository) for r in spark.read.parquet(target).collect()) == [("b", "r2"), ("new", "r1")]


def test_ranking_quality_counts_paths_by_suffix_and_name(spark):
    ranked = spark.createDataFrame([(1, "x/y/a.py", 1), (1, "b.py", 2), (2, "q.py", 1)], "qid long, file_path string, rank int")
    gold = spark.createDataFrame([(1, "py", "b.py"), (2, "py", "z.py")], "qid long, suffix string, file_path string")
    got = {r.suffix: (r.requests, r.hit, r.mrr) for r in answers.ranking_quality(ranked, gold, "suffix").collect()}
    assert got == {"py": (2, 0.5, 0.25), "total": (2, 0.5, 0.25)}


def test_containing_equals_a_plain_scan(spark):
    texts = ["def run_all(x): return x.y/z", "a=>b -> c", "", None, "UPPER Case_1", "ünïcode häus", "x" * 300 + "yz", "src/a_b.py:12"]
    terms = ["run", "n_a", "x.y/z", "=>", "upper case", "se_1", "äus", "xyz", "a_b.py:1", "q", "1", "y/z"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").filter("text is not null")
    runs = textindex.split_runs(textindex.runs(rows))
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.term, r.id) for r in textindex.verified(textindex.containing(asked, runs, textindex.grams(runs)), rows).collect()}
    assert got == {(t, str(i)) for t in terms for i, x in enumerate(texts) if x is not None and t in x.lower()}


def test_a_walk_neither_gives_nor_passes_through_what_is_above_the_tier(spark):
    nodes = spark.createDataFrame([("h", "r", 1), ("s", "r", 2), ("i", "r", 3), ("j", "r", 1), ("o", "other", 1)], "id string, repository string, tier int")
    edges = spark.createDataFrame([("h", "s", "calls"), ("s", "i", "calls"), ("i", "j", "calls"), ("s", "o", "calls")], "source_id string, target_id string, relationship string")
    near = graph.placed(graph.adjacency(graph.clean_edges(edges)), nodes)
    asked = spark.createDataFrame([(1, 2, ["r"]), (2, 3, None)], "qid long, user_tier int, repo_scope array<string>")
    anchors = spark.createDataFrame([(1, "h", 1), (2, "h", 1)], "qid long, id string, rank int")
    got = {}
    for r in graph.walk(anchors, near, 3, 10, asked).collect():
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {1: {"h", "s"}, 2: {"h", "s", "i", "j", "o"}}


def test_nearest_leaves_out_what_the_user_may_not_see(spark):
    rows = spark.createDataFrame([("a", "r", 1, [1.0, 0.0]), ("b", "r", 3, [1.0, 0.0]), ("c", "q", 1, [1.0, 0.0]), ("d", "r", 1, [0.0, 1.0])], "id string, repository string, tier int, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 2, ["r"]), (2, [1.0, 0.0], 3, None), (3, [1.0, 0.0], 3, [])], "qid long, vector array<float>, user_tier int, repo_scope array<string>")
    got = {}
    for r in vectors.nearest(asked, rows, 2, 2, sparse=False, access=True).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: ["a", "d"], 2: ["a", "b"]}


def _hit(id_, path, score, rerank, owner=""):
    return (1, id_, rerank, score, owner, path, path.rsplit("/", 1)[-1].lower())


def test_diversity_by_file_name_and_owner(spark):
    schema = "qid long, id string, rerank_score double, score double, owner string, file_path string, name string"
    order = lambda hits, m: [r.id for r in scoring.diverse(spark.createDataFrame(hits, schema), m).orderBy("position").collect()]
    assert order([_hit("a1", "a.py", 1.0, 9.0), _hit("a2", "a.py", 1.0, 8.0), _hit("b1", "b.py", 1.0, 7.0)], 2) == ["a1", "b1"]
    assert order([_hit("x", "p/cfg.py", 1.0, 9.0), _hit("y", "q/cfg.py", 1.0, 8.0), _hit("z", "r/d.py", 1.0, 1.0)], 3) == ["x", "z", "y"]
    assert order([_hit("m", "o.py", 1.0, 9.0, "owner"), _hit("n", "o.py", 1.0, 8.0, "owner"), _hit("k", "k.py", 1.0, 7.0)], 2) == ["m", "n"]
    assert order([_hit("u", "u.py", 1.0, 5.0), _hit("v", "v.py", 2.0, 5.0)], 2) == ["v", "u"]


def test_rerank_points_for_paths_symbols_and_owners(spark):
    artifacts = spark.createDataFrame(
        [("1", "r", "src/cart/checkout.ts", 1, "method-implementation", "submit", {"qualified_name": "Cart.submit"}, "text", 1, 9),
         ("2", "r", "docs/checkout.md", 1, "chunk", None, None, "submit the cart", 1, 9), ("3", "r", "Makefile", 1, "chunk", None, None, "x", 1, 2)],
        "id string, repository string, file_path string, tier int, kind string, symbol_name string, metadata map<string,string>, text string, line_start int, line_end int",
    )
    asked = spark.createDataFrame([(1, "How does cart submit?"), (2, "what is in src/cart/checkout.ts"), (3, "the makefile")], "qid long, query string")
    hits = asked.select("qid").crossJoin(artifacts.select("id")).selectExpr("qid", "id", "0.0D score", "true by_lexical", "false by_text", "false by_name", "false by_path")
    known = scoring.entries(artifacts)
    got = {(r.qid, r.id): r.rerank_score for r in scoring.rerank_scores(hits, asked, artifacts, known).collect()}
    assert got[1, "1"] > got[1, "2"] + 100 and got[2, "1"] > got[2, "2"] + 50 and got[3, "3"] > got[3, "1"] + 60


def test_shaped_answers(spark):
    text = "--- File: a.py ---\n```python\ndef run(x):\n    total = 1\n```\nThe loader in src/a/b.py keeps   order.\nsee:\nFiles:\n- \n"
    got = column(spark, answers.shaped, text, " \n", None, "x = 1\nfoo(bar)")
    assert got == ["python\nThe loader in keeps order.", "", "", answers.UNUSABLE]
    assert column(spark, answers.sanitised, "It keeps order.", "", "x = 1", None) == ["It keeps order.", None, None, None]


def test_policy(spark):
    kept = "The store keeps its rows sorted."
    rows = [
        ("a", ["i"], None, kept), ("b", [], "", kept), ("c", None, "some context", kept), ("d", ["i"], None, "Foo is a Python class."),
        ("e", ["i"], None, "[Inference Error: none]"), ("f", ["i"], None, "It lies in src/a.py somewhere."), ("g", ["i"], None, None),
        ("h", ["i"], None, "Foo is a method-implementation tied to bar."),
    ]
    df = spark.createDataFrame(rows, "trace_id string, retrieval_ids array<string>, prompt_summary string, response string")
    got = {r.trace_id: (r.response, r.source, r.flags) for r in answers.applied_policy(df).collect()}
    assert got["a"] == got["c"] == (kept, "model", [])
    assert got["b"] == (None, "fallback", ["no_retrieval_context"])
    assert got["d"] == got["e"] == got["h"] == (None, "fallback", ["fallback_used"])
    assert got["f"] == (None, "fallback", ["path_leak", "fallback_used"]) and got["g"] == (None, "fallback", ["empty", "fallback_used"])


def test_behaviour_phrases(spark):
    got = column(spark, answers.behaviour_phrase, "build_path", "isExcluded", "get", "parseHTTPFile", "_find_all_repository", "Store", "", None)
    assert got == ["builds paths", "checks excluded paths", "gets state", "parses http files", "finds all repositories", "", "", ""]


def test_held_terms_reads_a_text_once(spark):
    wanted = spark.createDataFrame([("ab", "1"), ("zz", "1"), ("ab", "2"), ("ab", "9"), ("ab", "1")], "term string, id string")
    texts = spark.createDataFrame([("1", "xABx"), ("2", None)], "id string, text string")
    assert [(r.term, r.id) for r in textindex.held_terms(wanted, texts).collect()] == [("ab", "1")]


def _brute_betweenness(edges, pivots):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = dict.fromkeys(near, 0.0)
    for s in pivots:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for x in order:
            for y in sorted(near[x]):
                if y not in level:
                    level[y], paths[y] = level[x] + 1, 0.0
                    order.append(y)
                if level[y] == level[x] + 1:
                    paths[y] += paths[x]
        credit = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if level[x] == level[y] - 1:
                    credit[x] += paths[x] / paths[y] * (1 + credit[y])
            if y != s:
                score[y] += credit[y]
    return {x: v for x, v in score.items() if v > 0}


def test_betweenness_equals_brute_force_and_needs_no_step_per_level(spark, monkeypatch):
    rng = np.random.default_rng(5)
    edges = {(f"a{i}", f"a{(i + 1) % 30}") for i in range(30)} | {(f"a{x}", f"a{y}") for x, y in rng.integers(0, 30, (12, 2)) if x < y}
    edges |= {(f"t{i}", f"t{rng.integers(0, i)}" if i % 3 else f"a{rng.integers(0, 30)}") for i in range(1, 40)} | {("p", "q"), ("u", "v"), ("v", "w"), ("w", "u"), ("w", "x")}
    names = sorted({x for e in edges for x in e})
    table = spark.createDataFrame([(*e, "calls") for e in edges], "source_id string, target_id string, relationship string")
    written, write = [], graph.write_table
    monkeypatch.setattr(graph, "write_table", lambda df, name: written.append(name) or write(df, name))
    for chosen in (names, names[::3]):
        got = {r.id: r.score for r in graph.betweenness(table, spark.createDataFrame([(x,) for x in chosen], "pivot string"), 7).collect()}
        want = _brute_betweenness(edges, chosen)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert len(written) == 2


def _requests_and_artifacts(spark):
    queries = ["Where is `Cart.submit` in src/cart/checkout.ts?", "which schema validates the cart config", "run the build script for a_b.py 12", "the makefile", "zzz nothing here", "submit `the cart` order"]
    asked = spark.createDataFrame(
        [(q, x, 1 + q % 3, scope) for q, (x, scope) in enumerate(zip(queries, (None, ["r"], ["r", "s"], None, ["r"], ["s", None])))],
        "qid long, query string, user_tier int, repo_scope array<string>",
    )
    rows = [
        (f"{repo}{n}", repo, path, "py", text, tier, symbol, 1, end, kind, meta)
        for repo in ("r", "s") for n, (path, text, tier, symbol, end, kind, meta) in enumerate((
            ("src/cart/checkout.ts", "def submit(the cart): return 12", 1, "submit", 9, "method", {"qualified_name": "Cart.submit"}),
            ("src\\cart\\a_b.py", None, 2, None, 9, "chunk", None), ("Makefile", "build: a_b.py\n\trun ./script", 1, None, 2, "chunk", None),
            ("conf/cart.schema.json", '{"order": 1, "Cart": "x"}', 3, None, 3, "json-document", {}), ("carts/building/scripts.py", "Submit THE cart orders configs", 2, "runner", 5, "module", {"a": "12"}),
        ))
    ]
    artifacts = spark.createDataFrame(rows, "id string, repository string, file_path string, language string, text string, tier int, symbol_name string, line_start int, line_end int, kind string, metadata map<string,string>")
    return asked, artifacts


def _refuse(*args, **named):
    raise AssertionError("a table of pairs")


def test_anchors_are_those_of_all_scores_without_tables_of_terms(spark, monkeypatch):
    asked, artifacts = _requests_and_artifacts(spark)
    texts, known = scoring.whole_texts(artifacts), scoring.entries(artifacts)
    runs = textindex.split_runs(textindex.runs(texts))
    terms = scoring.items(asked).select(F.col("item").alias("term"))
    held = textindex.verified(textindex.containing(terms, runs, textindex.grams(runs)), texts)
    path_runs = textindex.split_runs(textindex.runs(search.paths(artifacts)))
    points = scoring.file_points(scoring.items(asked), known.select("file", "path", "name", "suffix").distinct(), path_runs, textindex.grams(path_runs))
    order = [F.desc("points"), F.col("id")]
    want = {k: sorted(map(tuple, search.top(scoring.scores(asked, held, known, points), ["qid"], order, k).select("qid", "id", "points").collect())) for k in (2, 50)}
    pairs = asked.select("qid").crossJoin(artifacts.select("id"))
    of_pairs = sorted(map(tuple, scoring.scores(asked, held, known, points, pairs).select("qid", "id", "points").collect()))
    for name in ("salted_join", "containing", "verified", "held_terms"):
        monkeypatch.setattr(textindex, name, _refuse)
    for k in want:
        assert sorted(map(tuple, scoring.best_scored(asked, artifacts, k).select("qid", "id", "points").collect())) == want[k]
    assert len(want[50]) > len(want[2]) > 5
    assert sorted(map(tuple, scoring.scores_of_pairs(asked, pairs, artifacts).collect())) == of_pairs


def test_best_text_hits_are_those_of_the_whole_scan(spark):
    asked, artifacts = _requests_and_artifacts(spark)
    longest = search.longest_terms(asked, 8)
    texts = scoring.whole_texts(artifacts)
    held = scan.holding(scoring.items(asked).select(F.col("item").alias("term")), texts)
    all_hits = search.text_hits(asked, artifacts, held)
    order = [F.desc("score"), F.col("file_path"), F.col("id")]
    listed = scan.text_requests(asked, longest, 3)
    for k in (1, 50):
        got = search.top(search.best_text_hits(listed, artifacts, k), ["qid"], order, k).select("qid", "id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, search.top(all_hits, ["qid"], order, k).select("qid", "id", "score").collect()))
    pairs = asked.select("qid").crossJoin(artifacts.select("id"))
    seen = {tuple(r) for r in all_hits.select("qid", "id").collect()}
    assert seen and seen <= {tuple(r) for r in search.are_text_hits(listed, pairs, artifacts).collect()}


def test_path_search_writes_no_pairs_and_keeps_order(spark, monkeypatch):
    asked, artifacts = _requests_and_artifacts(spark)
    for name in ("salted_join", "containing", "verified", "runs", "grams"):
        monkeypatch.setattr(textindex, name, _refuse)
    got = {}
    for r in search.path_search(asked, artifacts, 2).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.repository, r.file_path, r.score))
    assert got[0] == [("s", "src/cart/checkout.ts", 17), ("r", "src/cart/checkout.ts", 17)]
    assert got[3] == [("s", "Makefile", 6), ("r", "Makefile", 6)] and {x[0] for x in got[5]} == {"s"}


def test_a_request_meets_its_hits_before_their_texts(spark):
    asked, artifacts = _requests_and_artifacts(spark)
    hits = asked.select("qid").crossJoin(artifacts.select("id")).selectExpr("qid", "id", "0.0D score", "true by_lexical", "false by_text", "false by_name", "false by_path")
    scored = scoring.rerank_scores(hits, asked, artifacts.select("id", "text"), scoring.entries(artifacts))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "UsingJoin" not in plan
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "id#" in joins[0] and "qid#" not in joins[0]


def test_row_vectors_equal_hashed_vectors(spark):
    _, artifacts = _requests_and_artifacts(spark)
    want = {(r.id, *r.buckets, *r.weights) for r in vectors.hashed_vectors(artifacts, "id", "text").collect()}
    found = vectors.row_vectors(artifacts)
    assert {(r.id, *r.buckets, *r.weights) for r in found.collect()} == want and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_latest_shuffles_only_repeated_ids(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "z", None), (None, "u", 1.0), (None, "v", 3.0)], "id string, text string, updated_at double")
    for most in (search.MOST_AGAIN, 0):
        monkeypatch.setattr(search, "MOST_AGAIN", most)
        assert {(r.id, r.text) for r in search.latest(rows).select("id", "text").collect()} == {("a", "y"), ("b", "z"), (None, "v")}


def test_access_violations_count_the_hits_of_every_request(spark, monkeypatch, tmp_path):
    history = [(1, "u", "a", ["r"]), (1, "u", "a", ["r"]), (7, "v", "b", None), (50, "u", "c", ["s"]), (99, "u", None, ["s"])]
    tables_of = {
        "user_history": spark.createDataFrame(history, "id long, user_id string, query string, repo_scope array<string>"),
        "access_matrix": spark.createDataFrame([("v", "T-3")], "user_id string, tier string"),
    }
    for name, table in tables_of.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    entries = spark.createDataFrame([("low", 1, "r"), ("high", 2, "r")], "id string, tier int, repository string")
    searches = ("composite", "all_named", "paths", "closest", "rescored", "graph", "hybrid", "reranked")
    everything = lambda q, *_: q.asked.select("qid", F.lit(1).alias("rank")).crossJoin(entries.select("id"))
    for name in searches:
        monkeypatch.setattr(registry._Search, name, property(everything))
    monkeypatch.setattr(registry._Search, "lexical", everything)
    monkeypatch.setattr(registry._Search, "entries", property(lambda q: entries))
    monkeypatch.setattr(registry, "BATCH", 2)
    found = registry.access_violations(spark, str(tmp_path)).collect()
    # requests 1 and 50 may not see "high", request 50 neither of the two
    assert len(found) == 9 and {(r.above_tier, r.out_of_scope) for r in found} == {(2, 2)}


def test_passing_tables_are_deleted_and_stored_ones_stay(spark, tmp_path):
    key, folder = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(tmp_path)
    before = spark.conf.get(key, None)
    with session.passing(spark):
        gone = session.write_table(spark.range(3), "gone")
        kept = session.stored(spark, folder, "kept", lambda: session.write_table(spark.range(4), "inner"))
        files_of = [f.removeprefix("file:") for f in gone.inputFiles()]
        assert gone.count() == 3 and all("/passing-" in f for f in files_of)
    assert kept.count() == 4 and spark.conf.get(key, None) == before
    assert not any(os.path.exists(f.replace("//", "/")) for f in files_of)
