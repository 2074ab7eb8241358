import random
import re

import numpy as np

from tessera.llm import linkgraph as lg


def brute(rows, rules=lg.RULES):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        h = re.match("[^/?#]*", rest)[0]
        return re.sub("[A-Z]", lambda m: m[0].lower(), h), re.match("[^?#]*", rest[len(h) :])[0]

    def rule(h, p):
        fit = [r for r, _ in rules if (h == r.split("/", 1)[0] or h.endswith("." + r.split("/", 1)[0])) and p.startswith("/" + r.split("/", 1)[1])]
        return max(fit, key=len) if fit else None

    say, out, seeds, edges = dict(rules), {}, {"allow": {}, "block": {}}, {}
    for i, u, html in rows:
        h, p = parts(u)
        r = rule(h, p)
        out[i] = [h, p, r]
        if r:
            seeds[say[r]][h] = seeds[say[r]].get(h, 0) + 1
        to = {parts("http:" + x if x.startswith("//") else x)[0] for x in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)""", html or "", re.I | re.S) if x.startswith("//") or re.match("[A-Za-z][A-Za-z0-9+.-]*://", x)}
        for t in to - {h, ""} if h else ():
            edges[h, t] = edges.get((h, t), 0) + 1
    rank = {}
    for kind, e in (("allow", edges), ("block", {(b, a): n for (a, b), n in edges.items()})):
        n = sum(seeds[kind].values())
        start = {h: c / n for h, c in seeds[kind].items()}
        outs = {}
        for (a, _), c in e.items():
            outs[a] = outs.get(a, 0) + c
        r = start
        for _ in range(lg.ROUNDS):
            new = {}
            for (a, b), c in e.items():
                if a in r:
                    new[b] = new.get(b, 0) + lg.DAMPING * r[a] * c / outs[a]
            stay = 1 - sum(new.values())
            old, r = r, {h: new.get(h, 0) + start.get(h, 0) * stay for h in {*new, *start}}
            if sum(abs(r.get(h, 0) - old.get(h, 0)) for h in {*r, *old}) < lg.CLOSE:
                break
        rank[kind] = r
    for i, x in out.items():
        t, d = rank["allow"].get(x[0], 0), rank["block"].get(x[0], 0)
        x.append(say[x[2]] if x[2] else "block" if d > 0 and d > lg.THRESHOLD * (t + d) else "allow")
    return out


def test_against_brute_force(spark):
    rng, rows = random.Random(4), []
    hosts = [f"{a}.example.{b}" for a in ("one", "two", "Three", "four") for b in ("com", "org", "net", "io")] + ["plain.net", "far.io"]
    for i in range(300):
        h = rng.choice(hosts)
        href = " ".join(f"<A class=x HREF={q}{x}{q}>y</a>" for q, x in [(rng.choice(['"', "'", ""]), rng.choice(["/rel", "#a", f"http://{rng.choice(hosts)}/z", f"//{rng.choice(hosts)}/q", f"https://{h}/self", f"/go?u=https://{rng.choice(hosts)}/z"])) for _ in range(rng.randrange(4))])
        rows.append((i, f"http://{h}{rng.choice(['', '/', '/es/1', '/en/12', '/fr/3?x=http://q/', '/de/4#top', '?a=1', '#x'])}", href))
    rows += [(900, None, None), (901, "no scheme", ""), (902, "://", "x"), (903, "http://", "<a href="), (904, "ftp://EXAMPLE.ORG/en/1", None), (905, "http://org/x", ""), (906, "http://xorg/x", ""), (907, "http://a.com/fr/" + "p" * 50000, None), (908, "", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, trust string")
    got = {r["page_id"]: [r["host"], r["path"], r["rule"], r["verdict"]] for r in lg.judge(df).collect()}
    want = brute(rows)
    assert got == want and {w[3] for w in want.values() if not w[2]} == {"allow", "block"}


def test_no_links_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/fr/", None), (1, "http://a.com/fr/", None), (None, "http://a.com/x", ""), (2, "http://b.com/de/", ""), (3, "http://b.com/en", "")], "page_id long, url string, html string")
    assert sorted(((r["page_id"], r["verdict"]) for r in lg.judge(df).collect()), key=str) == sorted([(1, "allow"), (1, "allow"), (None, "allow"), (2, "block"), (3, "block")], key=str)
    assert lg.judge(df.limit(0)).count() == 0
    assert [r["rule"] for r in lg.judge(df.limit(1), rules=(("com/f", "allow"), ("com/fr", "block"))).collect()] == ["com/fr"]
    ties = (("b.com/", "allow"), ("com/ab", "block"), ("com/a", "block"))
    for order in (ties, ties[::-1]):
        assert [r["rule"] for r in lg.judge(spark.createDataFrame([(1, "http://b.com/abc", "")], "page_id long, url string, html string"), rules=order).collect()] == [max((r for r, _ in order), key=len)]


def test_ranks_converge(spark):
    """Hubs, hosts that link nowhere and a long cycle: ranks are those of a dense solution, also far from the seeds."""
    rng, n = np.random.default_rng(0), 120
    edges = {(i, (i + 1) % 60) for i in range(60)} | {(0, k) for k in range(60, 100)} | {(k, 3) for k in range(60, 80)} | {(int(a), int(b)) for a, b in rng.integers(100, n, (30, 2)) if a != b}
    m = np.zeros((n, n))
    for a, b in edges:
        m[b, a] = 1 / sum(x == a for x, _ in edges)
    start = np.zeros(n)
    start[[5, 105]] = 0.75, 0.25
    stuck = m.sum(0) == 0
    # rank that has no link to follow, and what damping takes off, returns to the start
    want = np.linalg.solve(np.eye(n) - lg.DAMPING * m - np.outer(start, 1 - lg.DAMPING * ~stuck) + np.outer(start, np.ones(n)), start)
    rows = [("trust", str(a), str(b), float(m[b, a])) for a, b in edges]
    got = {int(r["host"]): r["rank"] for r in lg.spread(spark.createDataFrame(rows, "kind string, src string, dst string, w double"), spark.createDataFrame([("trust", "5", 0.75), ("trust", "105", 0.25)], "kind string, host string, start double")).collect()}
    assert abs(want.sum() - 1) < 1e-9 and all(abs(want[i] - r) < 1e-8 for i, r in got.items()) and got[4] > 0
