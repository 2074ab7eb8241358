import os
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.catalog import Graph
from tessera.operators import communities, derive, neighbors, reach, search, structural, textsearch, verbs
from tessera.operators.reach import Scope
from tessera.queries import QUERIES, pages
from tessera.sources import stores, tables
from tessera.streaming import maintain

from .graphs import golden


@pytest.fixture(scope="module")
def g(spark):
    return golden(spark)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- graph ---------------------------------------------------------------------------------------------------------
def test_reach(spark, g):
    seeds = spark.createDataFrame([(20,)], "id bigint")
    got = {r["id"]: (r["depth"], r["via"], r["grade"]) for r in reach.reach(g, seeds, max_depth=0).collect()}
    assert got == {21: (1, 20, "exact"), 22: (2, 21, "exact"), 26: (3, 22, "constrained")}
    assert {r["id"] for r in reach.reach(g, seeds, "both", max_depth=0).collect()} == {21, 22, 23, 24, 26}
    assert {r["id"] for r in reach.reach(g, seeds, min_confidence=98, max_depth=0).collect()} == {21, 22}
    assert reach.reach(g, seeds.limit(0), max_depth=3).count() == 0


def test_related_and_envelopes(spark, g):
    assert rows(neighbors.related(g, "callers", spark.createDataFrame([(22,)], "id bigint"))) == [(22, 21, 100, "exact"), (22, 23, 60, "heuristic"), (22, 24, 85, "constrained")]
    assert neighbors.lookup(g, "callers", name="nobody")["status"] == "no-match"
    assert neighbors.lookup(g, "callers", path="dough.py")["status"] == "ambiguous"
    assert neighbors.lookup(g, "callers", path="dough.py", every=True)["status"] == "hits"
    assert neighbors.select(g).count() == 0
    p = neighbors.page(g.nodes, ["id"], limit=4, cursor="o:1")
    assert (p["total"], p["truncated"], p["nextCursor"], [r["id"] for r in p["rows"].collect()]) == (7, True, "o:5", [21, 22, 23, 24])
    with pytest.raises(ValueError, match="cursor"):
        neighbors.page(g.nodes, ["id"], cursor="x")
    assert neighbors.toon(g.nodes.select("id", "name").limit(1)).startswith("rows[1]{id,name}:")


def test_reports(spark, g):
    assert {r["name"] for r in verbs.dead(g).collect()} == {"order", "Oven", "deliver"}
    assert {r["name"]: r["status"] for r in verbs.dead(g.with_tables(evidence=spark.createDataFrame([("order",)], "name string"))).collect()}["order"] == "mentioned"
    later = g.with_tables(nodes=g.nodes.where("id <> 25").withColumn("content_hash", F.when(F.col("id") == 21, "new").otherwise(F.col("content_hash"))))
    assert rows(verbs.diff_nodes(g, later).select("name", "change")) == [("Oven", "removed"), ("knead", "modified")]
    shown, hidden = reach.scoped(g.nodes.select("id"), g, Scope(within=("app",), exclude=("app/shop.py",), kinds=("function", "method")))
    assert shown.count() == 3 and hidden.first()[0] == 4
    assert [r["name"] for r in verbs.entries(g).collect()] == ["order"]


def test_snippets_and_call_sites(spark, g):
    text = "fn a() {\n  knead();\n  knead();\n}\n"
    files = spark.createDataFrame([("app/oven.py", text, "python", len(text), 0, 0, None)], "path string, text string, lang string, size bigint, error_nodes int, error_bytes bigint, digest string")
    ev = spark.createDataFrame([(20, 21, "calls", 21), (20, 21, "calls", 11)], "src bigint, dst bigint, rel string, span_start int")
    spanned = g.nodes.withColumn("span_start", F.lit(11)).withColumn("span_end", F.lit(18))
    full = g.with_tables(nodes=spanned, files=files, evidence=ev)
    hit = neighbors.call_sites(full, spark.createDataFrame([(20, 21)], "holder bigint, callee bigint")).first()
    assert (hit["line"], hit["code"]) == (2, "knead();")
    s = verbs.snippets(full, spark.createDataFrame([(20,)], "id bigint"), context=1).first()
    assert (s["first_line"], s["last_line"], s["state"]) == (1, 3, "unverified") and s["code"].startswith("fn a()")


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_scc(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    up = {i: {i} for i in range(40)}
    for _ in range(40):
        for a, b in edges:
            up[a] |= up[b]
    want = {i: min(j for j in up[i] if i in up[j]) for i in range(40)}
    graph = Graph(spark.createDataFrame([(i, "function", str(i), "x") for i in range(40)], "id bigint, kind string, name string, path string"), spark.createDataFrame([(a, b, "calls", 100) for a, b in edges], "src bigint, dst bigint, rel string, confidence int"))
    if one_task == 0:
        graph = graph.with_tables(edges=graph.edges.where("src < 14 and dst < 14"))
        up = {i: {i} for i in range(40)}
        for _ in range(40):
            for a, b in edges:
                if a < 14 and b < 14:
                    up[a] |= up[b]
        want = {i: min(j for j in up[i] if i in up[j]) for i in range(40)}
    assert {r["id"]: r["component"] for r in communities.scc(graph, one_task=one_task).collect()} == want


def test_communities(spark):
    edges = [(a, b) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10), (14, 20)]
    graph = Graph(spark.createDataFrame([(i, "function", str(i), "x") for i in range(25)], "id bigint, kind string, name string, path string"), spark.createDataFrame([(a, b, "calls", 100) for a, b in edges], "src bigint, dst bigint, rel string, confidence int"))
    for f in (communities.communities, communities.label_propagation):
        got = {r["id"]: r["community"] for r in f(graph).collect()}
        assert all(len({got[i] for i in range(b, b + 5)}) == 1 for b in (0, 10, 20))
        assert got[7] == 7
    assert len(set(communities.louvain([(a, b, 1) for a, b in edges]).values())) == 3


# -- derivations ---------------------------------------------------------------------------------------------------
def test_traces(spark):
    lines = spark.createDataFrame([("a;x::b+0x1f;c (inlined) 3",), ("a;?;c 2",), ("a;dup;b 1",), ("bad",)], "line string")
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "dup"), (5, "dup")], "id bigint, name string")
    calls, counts = derive.fold_traces(lines, known)
    assert rows(calls) == [(1, 2, 3), (2, 3, 3)]
    assert counts.first().asDict() == {"resolved": 7, "unknown": 1, "ambiguous": 1}


def test_imports_and_closure(spark):
    files = spark.createDataFrame([("a/x.py",), ("a/y.py",), ("b/y.py",), ("lib/z.py",)], "path string")
    refs = spark.createDataFrame([(1, "a/x.py", "y", "f", None), (2, "a/x.py", "z", "g", "gg"), (3, "q/w.py", "y", "f", None)], "ref_id bigint, from_path string, name string, symbol string, alias string")
    assert rows(derive.import_targets(refs, files)) == [(1, "a/y.py"), (2, "lib/z.py")]
    symbols = spark.createDataFrame([(7, "f", "a/y.py", None, True), (8, "g", "lib/z.py", None, False)], "id bigint, name string, path string, owner string, exported boolean")
    bound = derive.bind_imports(refs, symbols, files)
    assert rows(bound) == [("a/x.py", "f", 7), ("a/x.py", "gg", 8)]
    use = spark.createDataFrame([(1, 0, "a/x.py", "gg", "bare", None, None, None)], "ref_id bigint, from_id bigint, from_path string, name string, form string, qualifier string, receiver_type string, receiver_origin string")
    assert rows(derive.resolve(use, symbols, bound).select("dst", "confidence", "reason")) == [(8, 90, "import_binding")]
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert {tuple(r) for r in derive.include_closure(steps).collect()} == {(a, b) for a in "abc" for b in "abcd" if a != b}
    facts = spark.createDataFrame([("s", "x", "A"), ("s", "x", "A"), ("s", "y", "A"), ("s", "y", "B")], "scope string, name string, type string")
    assert rows(derive.type_facts(facts)) == [("s", "x", "A")]


# -- search --------------------------------------------------------------------------------------------------------
def test_search(spark, g):
    usage = spark.createDataFrame([(21, 5)], "id bigint, in_degree bigint")
    bodies = spark.createDataFrame([(20, "uses magic words"), (22, "magic magic words")], "id bigint, text string")
    s = search.Searcher(g.nodes, usage, bodies)
    assert [r["id"] for r in s.search("knead", 3).collect()][0] == 21
    assert [r["id"] for r in s.search("magic words").collect()] == [22, 20]
    assert [r["id"] for r in s.search('"def" AND "wash"').collect()] == [26]
    assert s.search("knead", 5, search.Filter(kinds=("class",))).count() == 0
    assert search.conjunction('"a" OR "b"') == [] and search.query_tokens("parseHTTPServer2Go x_y") == ["parse", "httpserver2", "go", "x", "y"]


def test_vectors(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, vec array<double>")
    got = {}
    for r in search.nearest(v, v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    for q, hits in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [i for _, i in sorted(hits)] == np.argsort(d, kind="stable")[:5].tolist()
    texts = spark.createDataFrame([(1, ["read", "file"]), (2, ["file", "read"]), (3, [])], "id bigint, tokens array<string>")
    lex = {r["id"]: np.array(r["vec"]) for r in search.lexical_vectors(texts).collect()}
    assert np.allclose(lex[1], lex[2]) and abs(np.linalg.norm(lex[1]) - 1) < 1e-6 and not lex[3].any()
    hits = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "id bigint, rank int")
    vec = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.1, 1.0]), (2, [1.0, 0.1])], "id bigint, vec array<double>")
    assert [r["id"] for r in search.rerank(hits, vec, [1.0, 0.0]).orderBy("new_rank").collect()] == [0, 2, 1]
    out = {r["id"]: r["vec"] for r in search.retrofit(vec, spark.createDataFrame([(0, 2)], "a bigint, b bigint")).collect()}
    assert out[1] == [0.1, 1.0] and abs(out[0][0] - out[2][0]) < 1.0


def test_word_vectors(spark):
    docs = spark.createDataFrame([(["a", "b", "c", "d"] * 6,), (["a", "c", "x", "y"] * 6,)], "tokens array<string>")
    weights = search.ppmi(search.cooccurrences(docs))
    assert search.word_vectors(weights, 3).count() == weights.select("a").distinct().count()


# -- text ----------------------------------------------------------------------------------------------------------
def test_trigrams_prune_and_never_lose(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choice("abcé ") for _ in range(40)) + "\nend", "x") for _ in range(80)]
    files = spark.createDataFrame([(f"f{i}", t, "x") for i, (t, _) in enumerate(texts)], "path string, text string, lang string")
    index = textsearch.trigrams(files.select(F.col("path").alias("file_id"), "text"))
    for pattern in ("abc", "ab(c|é)a", "cab+a", "éab", "a.c"):
        plain = rows(textsearch.text_search(files, pattern))
        assert rows(textsearch.text_search(files, pattern, index=index)) == plain
        few = textsearch.candidates(index, pattern)
        if few is not None:
            assert {r[0] for r in plain} <= {r["file_id"] for r in few.collect()}
    assert textsearch.branches("ab(cc|dd)e") == [["ab", "cc", "e"], ["ab", "dd", "e"]] and textsearch.plan(["ab"]) is None


def test_text_search_symbols(spark):
    files = spark.createDataFrame([("p", "é def f\n  x = 1\ny = 1", "py")], "path string, text string, lang string")
    spans = spark.createDataFrame([("p", 0, 17, 1, "f", "function"), ("p", 0, 100, 2, "m", "module")], "path string, start bigint, end bigint, id bigint, name string, kind string")
    got = rows(textsearch.text_search(files, "= 1|def", spans=spans).select("line", "column", "name"))
    assert got == [(1, 4, "f"), (2, 5, "f"), (3, 3, "m")]
    assert textsearch.text_search(files, "= 1", spans=spans, symbol="f").count() == 1


# -- structure -----------------------------------------------------------------------------------------------------
HTML = "<div id=a><ul><li>1</li><li><b>2</b></li><!-- c --><li>3</li></ul><p>x<br>y</p></div>"
PY = "import os\n\ndef f(a, b):\n    x = g(a, b)\n    return g(a, a)\n\nclass K:\n    def m(self):\n        return f(1, *[2]) + f()\n"


def test_rules_read_whole_texts(spark, tmp_path):
    """A match far into a node counts, by the registered rule too, and texts larger than a batch stay whole."""
    far = "x " * 300_000
    html = {1: f"<title>{far}nation</title>", 2: f"<title>{far}</title>", 3: "<title>nation</title>", 4: f"<title>a</title><div><p>{far}é\nnation</p></div>"}
    spark.createDataFrame([(k, v) for k, v in html.items()], "page_id long, html string").repartition(1).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, QUERIES["p_regex_rule"](spark, str(tmp_path)).collect())) == [("1", 1), ("3", 1)]
    ast = structural.ast_table(pages(spark, str(tmp_path)), "html").cache()
    assert all(r["text"] == html[int(r["path"])][r["start"] : r["end"]] for r in ast.collect())
    assert [tuple(r) for r in structural.Rules(ast).of({"all": [{"kind": "p"}, {"regex": "é\nnation"}]}).select("path").collect()] == [("4",)]


def test_rules(spark):
    files = spark.createDataFrame([("h", HTML)], "path string, text string")
    ast = structural.ast_table(files, "html").cache()
    r = structural.Rules(ast, files)
    text = lambda rule: sorted(HTML[x["start"] : x["end"]] for x in ast.join(r.of(rule), structural.KEY, "left_semi").collect())
    assert text({"kind": "li"}) == ["<li>1</li>", "<li>3</li>", "<li><b>2</b></li>"]
    assert text({"kind": "li", "has": {"kind": "b"}}) == ["<li><b>2</b></li>"]
    assert text({"kind": "b", "inside": {"kind": "div", "stopBy": "end"}}) == ["<b>2</b>"]
    assert text({"kind": "b", "inside": {"kind": "div", "stopBy": {"kind": "ul"}}}) == []
    assert text({"kind": "li", "follows": {"kind": "comment"}}) == ["<li>3</li>"]
    assert text({"kind": "li", "precedes": {"regex": "3", "stopBy": "end"}}) == ["<li>1</li>", "<li><b>2</b></li>"]
    assert text({"kind": "li", "nthChild": 1}) == ["<li>1</li>"] and text({"kind": "li", "nthChild": {"position": 1, "reverse": True}}) == ["<li>3</li>"]
    assert text({"kind": "li", "nthChild": {"position": "2n", "ofRule": {"kind": "li"}}}) == ["<li><b>2</b></li>"]
    assert text({"all": [{"kind": "li"}, {"not": {"has": {"kind": "b"}}}]}) == ["<li>1</li>", "<li>3</li>"]
    assert text({"kind": "ul > li, p"}) == ["<li>1</li>", "<li>3</li>", "<li><b>2</b></li>", "<p>x<br>y</p>"]
    assert text({"range": {"start": {"line": 0, "column": 10}, "end": {"line": 0, "column": 66}}})[0].startswith("<ul>")
    assert text({"pattern": "<li>$A</li>"}) == ["<li>1</li>", "<li>3</li>", "<li><b>2</b></li>"]
    with pytest.raises(ValueError, match="not a rule"):
        r.of({"nope": 1})


def test_patterns(spark):
    files = spark.createDataFrame([("p.py", PY), ("bad.py", "def (")], "path string, text string")
    found = lambda p: [(r["text"], r["captures"]) for r in structural.ordered(structural.matches(files, "python", p)).collect()]
    assert [t for t, _ in found("g($A, $B)")] == ["g(a, b)", "g(a, a)"] and [t for t, _ in found("g($A, $A)")] == ["g(a, a)"]
    assert [t for t, _ in found("f($$$ARGS)")] == ["f(1, *[2])", "f()"] and found("f($$$ARGS)")[0][1] == {"ARGS": "1, *[2]"}
    assert [t for t, _ in found("return $X")] == ["return g(a, a)", "return f(1, *[2]) + f()"]
    assert found({"pattern": "h($A, $B)", "strictness": "signature"})[0][0] == "g(a, b)"
    rule = {"id": "swap", "language": "python", "rule": {"pattern": "g($A, $B)"}, "constraints": {"B": {"regex": "^b$"}}, "transform": {"U": {"convert": {"source": "$A", "toCase": "upperCase"}}}, "fix": "g($B, $U)"}
    assert [r["fixes"] for r in structural.scan(files, [rule]).collect()] == [["g(b, A)"]]
    quiet = spark.createDataFrame([("q.py", "g(1, 2)  # tessera-ignore: swap\ng(1, 2)\nx = 1  # tessera-ignore\n")], "path string, text string")
    assert rows(structural.scan(quiet, [{"id": "swap", "language": "python", "rule": {"pattern": "g($A, $B)"}}]).select("rule", "line")) == [("swap", 2), ("unused-suppression", 3)]
    assert structural.call_shape("f($A, $B)") == ("f", 2) and structural.call_shape("f($$$)") == ("f", None) and structural.call_shape("f(1)") is None
    assert structural.apply_fixes("abcdef", [(1, 3, "X"), (2, 4, "Y"), (5, 6, "")]) == "aXde"


def test_python_outline(spark):
    got = structural.extract_python(spark.createDataFrame([("p.py", PY)], "path string, text string"))
    assert rows(structural.outline(got, "signatures", "structure").select("name", "kind")) == [("K", "class"), ("f", "function"), ("m", "method")]
    refs = got.select(F.explode("refs").alias("r")).select("r.*")
    assert refs.where("kind = 'call' and name = 'g'").count() == 2 and structural.calls_of_shape(refs, "f()").count() == 1


def test_cases(spark):
    from tessera.functions import trees

    df = spark.createDataFrame([("fooBar baz-qux",)], "s string")
    for case in ("camelCase", "pascalCase", "snakeCase", "kebabCase", "upperCase", "lowerCase", "capitalize"):
        assert df.select(structural.convert_case(F.col("s"), case)).first()[0] == trees.CASES[case]("fooBar baz-qux", trees.words_of("fooBar baz-qux"))


# -- streams and stores ----------------------------------------------------------------------------------------------
def test_view_equals_scratch(spark, tmp_path):
    layout, rng, log = "path string, text string", random.Random(0), []
    view = maintain.View(spark, str(tmp_path / "view"), layout)
    source = tmp_path / "in"
    source.mkdir()
    shape = "path string, version bigint, deleted boolean, text string"
    for batch in range(3):
        part = [(f"f{rng.randrange(8)}", batch * 100 + i, rng.random() < 0.2, f"t{batch}{i}") for i in range(10)]
        log += part
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(source))
        view.follow(spark.readStream.schema(shape).parquet(str(source)))
    want = maintain.latest(spark.createDataFrame(log, shape)).select("path", "text")
    assert rows(view.read()) == rows(want)


def test_generations(spark, g, tmp_path):
    store = stores.Generations(spark, str(tmp_path))
    assert store.current() is None
    assert store.publish(g) == 0 and store.publish(g.with_tables(nodes=g.nodes.where("id < 23"))) == 1
    assert store.open().nodes.count() == 3 and store.open(0).nodes.count() == 7 and store.open().evidence is None


def test_files(spark, tmp_path):
    Path(tmp_path / "a").mkdir()
    Path(tmp_path / "a/x.py").write_text("é = 1\n")
    got = stores.files(spark, str(tmp_path)).first()
    assert (got["path"], got["text"], got["lang"], got["size"]) == ("a/x.py", "é = 1\n", "python", 7)
    Path(tmp_path / "log").write_text("commit c2\na\nb\n\ncommit c1\na\n")
    assert {(r["commit_id"], r["path"]) for r in stores.commits(spark, str(tmp_path / "log")).collect()} == {("c2", "a"), ("c2", "b"), ("c1", "a")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the bundled tables")
def test_a_stored_graph_answers_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "STORED", {})
    ask = "MATCH (o:Order)-[:calls]->(p:Part) RETURN p.name AS name, count(*) AS n"
    read = lambda: sorted(map(tuple, tables.graph(spark, "/root/testdata/sf0.001").query(ask).collect()))
    derived = read()
    tables.store(spark, "/root/testdata/sf0.001", f"{tmp_path}/g")
    assert tables.STORED and read() == derived


def test_an_empty_graph_is_stored(spark, tmp_path):
    empty = Graph(spark.createDataFrame([], schema.NODES), spark.createDataFrame([], schema.EDGES))
    stores.save(empty, f"{tmp_path}/g")
    got = stores.load(spark, f"{tmp_path}/g")
    assert got.nodes.count() == got.edges.count() == 0 and got.edges.columns == empty.edges.columns
