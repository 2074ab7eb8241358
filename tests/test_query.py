import random

import pytest

from tessera.plans import ir
from tessera.plans.compile import total_rows
from tessera.plans.parser import parse

from .graphs import golden


@pytest.fixture(scope="module")
def g(spark):
    return golden(spark)


def rows(g, q):
    return [tuple(r) for r in g.query(q).collect()]


def names(g, q):
    return sorted(r[0] for r in rows(g, q))


@pytest.mark.parametrize(("q", "want"), [
    ("MATCH (f:Function) RETURN COUNT(*)", [(5,)]),
    ('MATCH (f {name:"bake"}) RETURN f', [(20, "bake", "function", "app/oven.py")]),
    ("MATCH (f:Function) RETURN sum(f.in_degree) AS s, avg(f.in_degree) AS a, min(f.name) AS lo, max(f.name) AS hi", [(6, 1.2, "bake", "weigh")]),
    ("MATCH (f:Function|Method)-[:calls]->(g) RETURN g.name AS name, count(*) AS n, collect(f.name) AS by ORDER BY n DESC, name LIMIT 1", [("weigh", 3, ["knead", "order", "deliver"])]),
    ("MATCH (f)-[:calls]->(g) WITH g, count(*) AS n WHERE n >= 2 RETURN g.name AS name, n", [("weigh", 3)]),
    ('MATCH (f:Function) WHERE f.name = "Bake" RETURN f.name', []),
    ('MATCH (f) WHERE f.kind = "Function" RETURN count(*)', [(5,)]),
    ("MATCH (f:Route) RETURN count(*)", [(0,)]),
    ("MATCH (f:Route) RETURN sum(f.in_degree) AS s", []),
    ("MATCH (f:Route) RETURN count(*) AS a, count(f.name) AS b", []),
    ("MATCH (f {id: 21}) UNWIND [3, 1, 2] AS x RETURN x ORDER BY x DESC SKIP 1 LIMIT 1", [(2,)]),
    ("MATCH (f {id: 21}) UNWIND [] AS x RETURN f.name", []),
    ("MATCH (f {id: 21}) RETURN 7 / 2 AS a, 1 / 0 AS b, -5 % -3 AS c, 5 % 0 AS d, 'a' + 'b' AS e, 9223372036854775807 + 1 AS f", [(3.5, None, 1, None, "ab", None)]),
    ("MATCH (f {id: 21}) RETURN [1] + 2 AS a, [1] + [2, 3] AS b, range(1, 3) AS c, range(3, 1) AS d, range(3, 1, -1) AS e, head([]) AS f, last([1, 2]) AS g", [([1, 2], [1, 2, 3], [1, 2, 3], [], [3, 2, 1], None, 2)]),
    ("MATCH (f {id: 21}) RETURN substring('hello', 1, 3) AS a, substring('hello', -2) AS b, substring('hello', 9) AS c, left('abc', 2) AS d, right('abc', 9) AS e, split('a..b.', '.') AS f, replace('aXbX', 'X', '-') AS g, trim('\t a \n') AS h, reverse('añ') AS i", [("ell", "hello", "", "ab", "abc", ["a", "", "b", ""], "a-b-", "a", "ña")]),
    ("MATCH (f {id: 21}) RETURN toInteger(' 12 ') AS a, toInteger('x') AS b, toInteger(2.9) AS c, toFloat('1.5') AS d, toBoolean('TRUE') AS e, toBoolean('yes') AS f, toString(1.0) AS g, toString([1, 2]) AS h, round(-2.5) AS i, floor(-1.5) AS j, ceil(1.2) AS k, abs(-3) AS l, sign(-2.0) AS m, size('añ') AS n, size([1, 2]) AS o", [(12, None, 2, 1.5, True, None, "1", "[1, 2]", -3, -2, 2, 3, -1, 2, 2)]),
    ("MATCH (f {id: 21}) RETURN id(f) AS i, labels(f) AS l, size(keys(f)) AS k, coalesce(null, f.signature, 'x') AS c", [(21, ["function"], 11, "def knead()")]),
    ("MATCH (f:Function) RETURN CASE WHEN f.in_degree > 1 THEN 'hub' WHEN f.name STARTS WITH 'w' THEN 'w' ELSE 'no' END AS c, count(*) AS n ORDER BY c", [("hub", 1), ("no", 3), ("w", 1)]),
    ("MATCH (f {id: 22}) RETURN CASE f.signature WHEN null THEN 1 ELSE 2 END AS c", [(1,)]),
    ("MATCH (f:Function) RETURN DISTINCT f.exported AS e ORDER BY e", [(False,), (True,)]),
    ("MATCH (f) RETURN f.scc_size AS s, f.community AS c LIMIT 1", [(None, None)]),
    ("RETURN 1 AS one", [(1,)]),
])
def test_rows(g, q, want):
    assert rows(g, q) == want


@pytest.mark.parametrize(("q", "want"), [
    ('MATCH (f {path:"dough.py"}) RETURN f.name', ["knead", "weigh"]),
    ('MATCH (f:Function)-[:calls]->(g {name:"weigh"}) RETURN f.name', ["knead", "order"]),
    ('MATCH (p {name:"bake"})-[:calls]-(x) RETURN x.name', ["knead", "order"]),
    ('MATCH (f)-[:calls*1..5]->(g {name:"weigh"}) RETURN f.name', ["bake", "deliver", "knead", "order"]),
    ('MATCH (f)-[:calls*1..5 {grade: exact}]->(g {name:"weigh"}) RETURN f.name', ["bake", "knead"]),
    ('MATCH (f)-[:calls*2..5]->(g {name:"weigh"}) RETURN f.name', ["bake"]),
    ('MATCH (f {name:"order"})-[:calls*2]->(g) RETURN g.name', ["knead", "wash"]),
    ('MATCH (f {name:"bake"})-[]->(g) RETURN g.name', ["Oven", "knead"]),
    ('MATCH (f {name:"bake"})-->(g)<--(h) RETURN h.name', ["bake", "bake"]),
    ("MATCH (f:Function) WHERE NOT EXISTS { (f)<-[:calls]-() } RETURN f.name", ["order"]),
    ("MATCH (f) WHERE EXISTS { (f)-[:calls]->()-[:calls]->(x {name: 'wash'}) } OR f:Class RETURN f.name", ["Oven", "deliver", "knead", "order"]),
    ("MATCH (f) WHERE f.signature = null OR f.signature <> null RETURN f.name", []),
    ("MATCH (f) WHERE NOT f.signature = null RETURN f.name", ["Oven", "bake", "deliver", "knead", "order", "wash", "weigh"]),
    ("MATCH (f) WHERE f.signature IS NULL RETURN f.name", ["weigh"]),
    ("MATCH (f) WHERE f.signature IN [null, ''] RETURN f.name", ["Oven", "weigh"]),
    ("MATCH (f) WHERE f.exported AND f.name =~ '^[A-Z]|ei' RETURN f.name", ["Oven", "weigh"]),
    ("MATCH (f) WHERE (f.id + 1) * 2 = 44 OR (f.id = 25) RETURN f.name", ["Oven", "knead"]),
    ("MATCH (f) WHERE f.id = 21 RETURN f.name UNION MATCH (f) WHERE f.id < 22 RETURN f.name", ["bake", "knead"]),
    ("MATCH (f) WHERE f.id = 21 RETURN f.name UNION ALL MATCH (f) WHERE f.id < 22 RETURN f.name UNION ALL MATCH (f) WHERE f.id = 21 RETURN f.name", ["bake", "knead", "knead", "knead"]),
    ("MATCH (f) WHERE f.in_degree >= 2 RETURN f.name", ["weigh"]),
    ("MATCH (f)-[:calls]->(g) WITH g.path AS p, f WHERE f.exported RETURN p", ["app/dough.py", "app/dough.py", "app/oven.py", "lib/sink.py"]),
])
def test_names(g, q, want):
    assert names(g, q) == want


@pytest.mark.parametrize("q", ["MATCH (f RETURN f", "MATCH (f) RETURN", "MATCH (f) RETURN f.name f", "MATCH (f) WHERE RETURN f", "RETURN 'open", "MATCH (f)-[:calls]>(g) RETURN f", "MATCH (f) RETURN f; DROP", "", "MATCH (f) RETURN 99999999999999999999"])
def test_parse_errors(g, q):
    with pytest.raises(ir.ParseError) as e:
        g.query(q)
    assert 0 <= e.value.offset <= len(q)


@pytest.mark.parametrize("q", [
    "OPTIONAL MATCH (f) RETURN f", "MATCH (f) MATCH (g) RETURN f", "MATCH (f:Nope) RETURN f", "MATCH (f)-[:nope]->(g) RETURN f", "MATCH (f)-[:calls {grade: nope}]->(g) RETURN f", "MATCH (f) RETURN f.nope", "MATCH (f) RETURN nope(f.name)",
    "MATCH (f) WHERE f.id = 1 XOR f.id = 2 RETURN f", "MATCH (f) RETURN {a: 1}", "MATCH (f) RETURN type(f)", "MATCH (f) WHERE count(*) > 1 RETURN f", "MATCH (f) RETURN sum(count(*))", "MATCH (f) RETURN f.name + count(*)",
    "MATCH (f) RETURN f.name, f.name", "MATCH (f) RETURN f AS g", "MATCH (f) WHERE f.name > 1 RETURN f", "MATCH (f) WHERE f.id CONTAINS 'x' RETURN f", "MATCH (f)-->(f) RETURN f", "MATCH (f) WHERE EXISTS { (q)-->() } RETURN f", "MATCH (f) UNWIND [1] AS f RETURN f",
    "MATCH (f) RETURN f.id UNION MATCH (f) RETURN f.id, f.name", "MATCH (f)-[:calls*0..2]->(g) RETURN f", "MATCH (f) WHERE f.name =~ '(?=a)' RETURN f", "MATCH (f {size: 1}) RETURN f", "MATCH (f) RETURN x", "MATCH (f) RETURN left('a')",
])
def test_plan_errors(g, q):
    with pytest.raises(ir.PlanError):
        g.query(q)


@pytest.mark.parametrize("q", ["MATCH (a)-[*1..11]->(b) RETURN a", "MATCH (a)" + "-->()" * 9 + " RETURN a", "MATCH (a) WHERE a.name =~ '" + "x" * 600 + "' RETURN a", "RETURN 1 AS a //" + " " * 17000])
def test_ceilings(g, q):
    with pytest.raises(ir.CeilingError):
        g.query(q)
    with pytest.raises(ir.CeilingError):
        g.query("MATCH (f) RETURN f.id", max_rows=3)


def test_json_form(g):
    q = "MATCH (f:Function)-[:calls*1..2 {grade: heuristic}]->(g) WHERE f.id IN [20, 23] AND NOT g.name = 'x' WITH f, count(*) AS n RETURN f.name AS a, n ORDER BY n DESC LIMIT 5 UNION ALL MATCH (f) RETURN f.name, f.id"
    tree = parse(q)
    assert ir.from_json(ir.to_json(tree)) == tree
    assert rows(g, ir.to_json(tree)) == rows(g, q)
    with pytest.raises(ir.PlanError):
        g.query({"type": "Nope"})


def test_implicit_order(g):
    """Without ORDER BY rows go by the nodes that they bind, in the pattern's order; groups by their output."""
    assert rows(g, "MATCH (f)-[:calls]->(g) RETURN g.name AS x, f.name AS y SKIP 1 LIMIT 4") == [("weigh", "knead"), ("wash", "weigh"), ("bake", "order"), ("weigh", "order")]
    assert rows(g, "MATCH (g)<-[:calls]-(f) RETURN f.name AS y LIMIT 3") == [("order",), ("bake",), ("knead",)]
    assert rows(g, "MATCH (f)-[:calls]->(g) RETURN g.path AS p, count(*) AS n LIMIT 2") == [("app/dough.py", 4), ("app/oven.py", 1)]


def test_total_rows(g):
    assert total_rows(g, "MATCH (f) RETURN f.name ORDER BY f.name SKIP 1 LIMIT 2") == 7


def test_laws(g):
    both = names(g, "MATCH (a)-[:calls]-(b) RETURN a.name + '>' + b.name AS x")
    assert both == sorted({*names(g, "MATCH (a)-[:calls]->(b) RETURN a.name + '>' + b.name AS x"), *names(g, "MATCH (a)<-[:calls]-(b) RETURN a.name + '>' + b.name AS x")})
    sizes = [len(rows(g, f"MATCH (a)-[*1..{k}]->(b) RETURN a.id, b.id")) for k in (1, 2, 3, 4)]
    assert sizes == sorted(sizes)


def test_parser_is_total():
    rng = random.Random(0)
    words = "MATCH ( ) f : Function -[ ]-> <- { } WHERE AND OR NOT EXISTS RETURN count * 'x' 1 1.5 , . .. + - = <> IN [ ] CASE WHEN THEN END UNION ALL WITH AS ORDER BY DESC é \\ \"".split()
    for _ in range(3000):
        try:
            parse(" ".join(rng.choice(words) for _ in range(rng.randrange(25))))
        except ir.QueryError:
            pass
