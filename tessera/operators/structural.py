"""Structural search: syntax trees as a table, rules as algebra on sets of its nodes, code patterns and fixes.

ast columns: path, node_id (pre-order), parent, last (the greatest id below), depth, kind, named, field, start, end, sib, named_sib, line, column, ancestors, text.
A set of nodes is a DataFrame of distinct (path, node_id). Every relation between nodes is an equi-join inside a file.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trees

AST = "path string, node_id int, parent int, last int, depth int, kind string, named boolean, field string, start int, end int, sib int, named_sib int, line int, column int, ancestors array<int>, text string"
KEY = ["path", "node_id"]
SHOWN, IGNORE = 200, "tessera-ignore"
#: Characters of nodes' texts, and 64 for each node, that a batch of ast_table holds.
BATCH = 1 << 22
HITS = "rule string, path string, node_id int, start int, end int, line int, column int, text string, captures map<string,string>, fixes array<string>"


def ast_table(files: DataFrame, lang: str) -> DataFrame:
    """The trees of files (path, text), parsed batch by batch; a text that doesn't parse has one node of kind ``error``.

    text is the whole text of each node, so a file's texts together take up to its length times its tree's depth.
    """

    kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.bool_(), pa.string(), *[pa.int32()] * 6, pa.list_(pa.int32()), pa.string()]
    names = [x.split()[0] for x in AST.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    def run(batches):
        for b in batches:
            out, size = [], 0
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                for path, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), strict=True):
                    text = text or ""
                    try:
                        found = trees.rows(trees.parse(text, lang), text)
                    except (SyntaxError, ValueError, RecursionError, AssertionError):
                        found = [(0, None, 0, 0, "error", True, None, 0, len(text), 0, 0, 1, 1, [])]
                    for r in found:
                        out.append((path, *r, text[r[7] : r[8]]))
                        size += 64 + r[8] - r[7]
                        if size > BATCH:
                            yield batch(out)
                            out, size = [], 0
            if out:
                yield batch(out)

    return files.select("path", "text").mapInArrow(run, AST)


def dump(ast: DataFrame, max_nodes: int = 1000) -> DataFrame:
    """Named nodes of trees, one line each, in order: the first max_nodes."""
    return ast.where("named").select("path", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("field").isNotNull(), F.concat("field", F.lit(": "))).otherwise(""), "kind", F.format_string(" [%d, %d]", "line", "column")).alias("line")).orderBy("path", "node_id").limit(max_nodes)


# -- rules on sets -------------------------------------------------------------------------------------------------
class Rules:
    """Compiles rules, given as dicts, to sets of nodes.

    Keys: kind, regex, pattern, nthChild, range; inside, has, precedes, follows with stopBy (neighbor, end or a rule) and field; all, any, not, matches.
    Several keys of one rule hold together. kind takes a simple selector: ``a``, ``a, b``, ``a > b``, ``a b``.
    """

    def __init__(self, ast: DataFrame, files: DataFrame | None = None, lang: str = "html", utils: dict | None = None):
        self.ast, self.files, self.lang, self.utils = ast, files, lang, utils or {}

    def nodes(self, condition: Column | str) -> DataFrame:
        return self.ast.where(condition).select(*KEY)

    def both(self, sets: list[DataFrame]) -> DataFrame:
        out = sets[0]
        for s in sets[1:]:
            out = out.join(s, KEY, "left_semi")
        return out

    def of(self, rule: dict, depth: int = 0) -> DataFrame:
        if depth > 64:
            raise ValueError("rules refer to themselves")
        unknown = set(rule) - {"kind", "regex", "pattern", "nthChild", "range", "inside", "has", "precedes", "follows", "all", "any", "not", "matches"}
        if unknown or not rule:
            raise ValueError(f"not a rule: {sorted(unknown) or rule}")
        sets = []
        if "kind" in rule:
            sets.append(self.selector(rule["kind"]))
        if "regex" in rule:
            sets.append(self.nodes(F.col("named") & F.col("text").rlike(rule["regex"])))
        if "pattern" in rule:
            sets.append(self.pattern(rule["pattern"]).select(*KEY))
        if "nthChild" in rule:
            sets.append(self.nth_child(rule["nthChild"], depth))
        if "range" in rule:
            a, b = rule["range"]["start"], rule["range"]["end"]
            sets.append(self.nodes((F.col("line") == a["line"] + 1) & (F.col("column") == a["column"] + 1)) if not b else self.within(a, b))
        for name in ("inside", "has", "precedes", "follows"):
            if name in rule:
                sets.append(self.relation(name, dict(rule[name]), depth))
        if "all" in rule:
            sets += [self.of(r, depth + 1) for r in rule["all"]]
        if "any" in rule:
            out = self.of(rule["any"][0], depth + 1)
            for r in rule["any"][1:]:
                out = out.unionByName(self.of(r, depth + 1))
            sets.append(out.distinct())
        if "matches" in rule:
            if rule["matches"] not in self.utils:
                raise ValueError(f"unknown rule {rule['matches']}")
            sets.append(self.of(self.utils[rule["matches"]], depth + 1))
        if "not" in rule:
            base = self.both(sets) if sets else self.nodes("named")
            return base.join(self.of(rule["not"], depth + 1), KEY, "left_anti")
        return self.both(sets)

    def within(self, a: dict, b: dict) -> DataFrame:
        """Nodes from one 0-based line and column to another."""
        lines = self.ast.withColumn("inner", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
        last = F.element_at(F.split("text", "\n"), -1)
        ends = F.when(F.col("inner") == 0, F.col("column") + F.length("text")).otherwise(F.length(last) + 1)
        return lines.where((F.col("line") == a["line"] + 1) & (F.col("column") == a["column"] + 1) & (F.col("line") + F.col("inner") == b["line"] + 1) & (ends == b["column"] + 1)).select(*KEY)

    def selector(self, text: str) -> DataFrame:
        out = None
        for part in text.split(","):
            steps = re.findall(r">|[\w:*-]+", part)
            if not steps:
                raise ValueError("an empty selector")
            here, child = None, False
            for s in steps:
                if s == ">":
                    child = True
                    continue
                found = self.nodes("named" if s == "*" else F.col("kind") == s)
                here = found if here is None else self.both([found, self.below(here, child)])
                child = False
            out = here if out is None else out.unionByName(here)
        return out.distinct() if "," in text else out

    def below(self, targets: DataFrame, child: bool) -> DataFrame:
        """Nodes whose parent, or any ancestor, is a target."""
        t = targets.select("path", F.col("node_id").alias("up"))
        up = F.col("parent").alias("up") if child else F.explode("ancestors").alias("up")
        return self.ast.select(*KEY, up).join(t, ["path", "up"]).select(*KEY).distinct()

    def relation(self, name: str, spec: dict, depth: int) -> DataFrame:
        stop, field = spec.pop("stopBy", "neighbor"), spec.pop("field", None)
        if field is not None and name not in ("inside", "has"):
            raise ValueError(f"{name} takes no field")
        targets = self.of(spec, depth + 1).distinct()
        stops = self.of(stop, depth + 1).distinct() if isinstance(stop, dict) else None
        if name in ("inside", "has"):
            return self.vertical(name, targets, stop, stops, field)
        flagged = self.ast.where("named").select("path", "node_id", "parent", "sib").join(targets.withColumn("t", F.lit(True)), KEY, "left")
        if stops is not None:
            flagged = flagged.join(stops.withColumn("s", F.lit(True)), KEY, "left")
        else:
            flagged = flagged.withColumn("s", F.lit(None).cast("boolean"))
        order = Window.partitionBy("path", "parent").orderBy(F.asc("sib") if name == "precedes" else F.desc("sib"))
        ahead = order.rowsBetween(1, 1) if stop == "neighbor" else order.rowsBetween(1, Window.unboundedFollowing)
        near = (lambda c: F.min(c)) if name == "precedes" else (lambda c: F.max(c))
        out = flagged.withColumn("nt", near(F.when(F.col("t"), F.col("sib"))).over(ahead)).withColumn("ns", near(F.when(F.col("s"), F.col("sib"))).over(ahead))
        inside = F.col("ns").isNull() | (F.col("nt") <= F.col("ns") if name == "precedes" else F.col("nt") >= F.col("ns"))
        return out.where(F.col("nt").isNotNull() & inside).select(*KEY)

    def vertical(self, name: str, targets: DataFrame, stop, stops, field: str | None) -> DataFrame:
        """inside: an ancestor is a target; has: a descendant is. A stop rule ends the way at the first node that fits it, which still counts."""
        pairs = self.ast.select("path", F.col("node_id").alias("low"), "depth", F.posexplode("ancestors").alias("d", "high"))
        if stop == "neighbor":
            pairs = pairs.where("d = depth - 1")
        if field is not None:  # the step from the upper node leads through this field
            fields = self.ast.where(F.col("field") == field).select("path", F.col("node_id").alias("step"))
            chain = self.ast.select("path", F.col("node_id").alias("low"), F.concat("ancestors", F.array("node_id")).alias("chain"))
            pairs = pairs.join(chain, ["path", "low"]).withColumn("step", F.get("chain", F.col("d") + 1)).join(fields, ["path", "step"], "left_semi").drop("chain", "step")
        one, other = ("low", "high") if name == "inside" else ("high", "low")
        hits = pairs.join(targets.withColumnRenamed("node_id", other), ["path", other])
        if stops is not None:
            s = stops.withColumnRenamed("node_id", "mid")
            steps = self.ast.select("path", F.col("node_id").alias("low"), F.posexplode("ancestors").alias("k", "mid")).join(s, ["path", "mid"]).select("path", "low", "k")
            # a stop strictly between both ends hides the target
            if name == "inside":
                first = steps.groupBy("path", "low").agg(F.max("k").alias("k"))
                hits = hits.join(first, ["path", "low"], "left").where("k is null or d >= k")
            else:
                last = steps.join(hits.select("path", "low", "high", "d"), ["path", "low"]).where("k > d").select("path", "low", "high").distinct()
                hits = hits.join(last, ["path", "low", "high"], "left_anti")
        return hits.select("path", F.col(one).alias("node_id")).distinct()

    def nth_child(self, spec, depth: int) -> DataFrame:
        """Places from 1 among named siblings: a number, ``odd``, ``even`` or ``An+B``; or position, ofRule and reverse."""
        full = spec if isinstance(spec, dict) else {"position": spec}
        text = str(full["position"]).replace(" ", "")
        text = {"odd": "2n+1", "even": "2n"}.get(text, text)
        m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
        if not m or not text:
            raise ValueError(f"not a position: {text}")
        a = 0 if "n" not in text else int({"": "1", "+": "1", "-": "-1"}.get(m[1] or "", m[1] or "1"))
        b = int(m[2] or 0)
        rows = self.ast.where("named and parent is not null")
        if "ofRule" in full:
            rows = rows.join(self.of(full["ofRule"], depth + 1), KEY, "left_semi")
        order = F.desc("sib") if full.get("reverse") else F.asc("sib")
        placed = rows.select(*KEY, F.row_number().over(Window.partitionBy("path", "parent").orderBy(order)).alias("i"))
        fits = F.col("i") == b if a == 0 else (F.pmod(F.col("i") - b, F.lit(abs(a))) == 0) & ((F.col("i") - b) * (1 if a > 0 else -1) >= 0)
        return placed.where(fits).select(*KEY)

    def pattern(self, spec) -> DataFrame:
        """(path, node_id, captures) of a code pattern: text, or pattern and strictness."""
        if self.files is None:
            raise ValueError("patterns need the files")
        return matches(self.files, self.lang, spec)


# -- patterns over files -------------------------------------------------------------------------------------------
def literals(spec) -> list[str]:
    """Words that a text must hold to match a pattern: what stands outside captures."""
    text = spec["pattern"] if isinstance(spec, dict) else spec
    return [w for part in re.split(r"\$+[A-Z0-9_]*", text) for w in re.findall(r"\w{2,}", part)]


def rule_literals(rule: dict, utils: dict | None = None) -> list[list[str]] | None:
    """Alternatives of required words of a rule; None if a text can't be told to miss."""
    out: list[list[str]] = []
    if "pattern" in rule:
        found = literals(rule["pattern"])
        out = [found] if found else []
    if "all" in rule:
        for r in rule["all"]:
            inner = rule_literals(r, utils)
            if inner and len(inner) == 1:
                out = [(out[0] if out else []) + inner[0]]
    if not out and "any" in rule:
        inner = [rule_literals(r, utils) for r in rule["any"]]
        if all(inner):
            out = [x for i in inner for x in i]
    return out or None


def prefiltered(files: DataFrame, alternatives: list[list[str]] | None) -> DataFrame:
    if not alternatives:
        return files
    hit = F.lit(False)
    for words in alternatives:
        own = F.lit(True)
        for w in words:
            own = own & F.col("text").contains(w)
        hit = hit | own
    return files.where(hit)


def matches(files: DataFrame, lang: str, spec, prefilter: bool = True) -> DataFrame:
    """(path, node_id, start, end, line, column, text, captures): where a code pattern matches, on whole files that hold its words."""
    text, strictness = (spec["pattern"], spec.get("strictness", "smart")) if isinstance(spec, dict) else (spec, "smart")
    trees.Matcher(text, lang, strictness)  # a bad pattern is told here
    rows = scan(files, [{"id": "pattern", "language": lang, "rule": {"pattern": {"pattern": text, "strictness": strictness}}}], prefilter=prefilter)
    return rows.drop("rule", "fixes")


def load_rules(text: str) -> list[dict]:
    """Rules from JSON, or YAML documents where a YAML parser is installed."""
    try:
        found = json.loads(text)
        return found if isinstance(found, list) else [found]
    except ValueError:
        import yaml

        return [r for r in yaml.safe_load_all(text) if r]


def scan(files: DataFrame, rules: list[dict], prefilter: bool = True, no_suppress: bool = False) -> DataFrame:
    """Hits of pattern rules: rule, path, node_id, start, end, line, column, text, captures, fixes.

    A rule has an id, a language, ``rule: {pattern}`` or ``rule: {any: [{pattern}...]}``, and may have constraints {capture: {regex}}, transform {name: spec}, fix (text, {template,
    expandStart, expandEnd} or a list of these), severity (off: left out), files and ignores (globs). A comment that holds ``tessera-ignore`` hides hits on its own or the next line, in the
    first line those of the file; after a colon it may name rules. A suppression that hides nothing is a hit of the rule ``unused-suppression``.
    """
    rules = [r for r in rules if r.get("severity", "hint") != "off"]
    for r in rules:
        if r["language"] not in trees.PARSERS:
            raise ValueError(f"unknown language {r['language']}")
    if prefilter and len(rules) == 1:
        files = prefiltered(files, rule_literals(rules[0]["rule"]))

    def run(batches):
        ready = []
        for r in rules:
            parts = r["rule"]["any"] if "any" in r["rule"] else [r["rule"]]
            specs = [p["pattern"] if isinstance(p["pattern"], dict) else {"pattern": p["pattern"]} for p in parts]
            ready.append((r, [trees.Matcher(s["pattern"], r["language"], s.get("strictness", "smart")) for s in specs]))
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is not None:
                    out += hits_of(path, text, ready, no_suppress)
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
            names = [x.split()[0] for x in HITS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, HITS)


def hits_of(path: str, text: str, ready: list, no_suppress: bool) -> list[tuple]:
    from fnmatch import fnmatch

    parsed: dict = {}
    lines = text.split("\n")
    hidden: dict[int, tuple[set, list]] = {}
    for i, x in enumerate(lines, 1):
        m = re.search(rf"{IGNORE}(?::\s*([\w, -]+))?", x)
        if m and not no_suppress:
            names = {n.strip() for n in (m[1] or "").split(",") if n.strip()}
            alone = x.strip().startswith(("#", "<!--", "//"))
            hidden[i] = (names, [0] if i == 1 and alone else [i + 1] if alone else [i])
    used, out = set(), []
    for rule, matchers in ready:
        if rule.get("files") and not any(fnmatch(path, g) for g in rule["files"]) or any(fnmatch(path, g) for g in rule.get("ignores", ())):
            continue
        lang = rule["language"]
        if lang not in parsed:
            try:
                tree = trees.parse(text, lang)
                parsed[lang] = list(zip(tree.walk(), trees.rows(tree, text), strict=True))
            except (SyntaxError, ValueError, RecursionError, AssertionError):
                parsed[lang] = []
        for t, row in parsed[lang]:
            if t.kind in ("module", "document"):
                continue
            env = next((e for m in matchers if (e := m.match(t)) is not None), None)
            if env is None:
                continue
            captured = {k: trees.span(v, text) for k, v in env.items()}
            if any(not re.search(c["regex"], captured.get(k.lstrip("$"), "")) for k, c in rule.get("constraints", {}).items() if "regex" in c):
                continue
            for name, spec in rule.get("transform", {}).items():
                made = trees.transform(spec, captured, lang)
                if made is not None:
                    captured[name] = made
            line, column = row[11], row[12]
            cover = next((i for i, (names, at) in hidden.items() if (at == [0] or line in at) and (not names or rule["id"] in names)), None)
            if cover is not None:
                used.add(cover)
                continue
            own = lines[line - 1]
            indent = len(own) - len(own.lstrip())
            fixes = rule.get("fix")
            made = [edit(text, t, f, captured, indent) for f in (fixes if isinstance(fixes, list) else [fixes])] if fixes is not None else []
            out.append((rule["id"], path, row[0], t.start, t.end, line, column, text[t.start : t.end].split("\n")[0][:SHOWN], list(captured.items()), made))
    for i in hidden:
        if i not in used:
            out.append(("unused-suppression", path, None, None, None, i, 1, lines[i - 1][:SHOWN], [], []))
    return out


def edit(text: str, t, fix, captured: dict[str, str], indent: int) -> str:
    """The replacement of a match; expandStart and expandEnd are regular expressions whose text beside the match goes with it."""
    if isinstance(fix, str):
        return trees.filled(fix, captured, indent)
    out = trees.filled(fix["template"], captured, indent)
    start, end = t.start, t.end
    if "expandEnd" in fix and (m := re.match(fix["expandEnd"]["regex"], text[end:])):
        end += m.end()
    if "expandStart" in fix and (m := re.search(f"(?:{fix['expandStart']['regex']})$", text[:start])):
        start = m.start()
    return json.dumps({"start": start, "end": end, "text": out, "title": fix.get("title")}, ensure_ascii=False) if (start, end) != (t.start, t.end) or "title" in fix else out


def apply_fixes(text: str, edits: list[tuple[int, int, str]]) -> str:
    """A text with edits (start, end, replacement) made; of overlapping ones the first."""
    out, at = [], 0
    for a, b, x in sorted(edits):
        if a >= at:
            out += [text[at:a], x]
            at = b
    return "".join([*out, text[at:]])


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy("path", "line", "column")


# -- around hits ---------------------------------------------------------------------------------------------------
def code_search(hits: DataFrame, spans: DataFrame, degrees: DataFrame, k: int = 10) -> DataFrame:
    """(id, name, kind, in_degree, matches): hits (path, start) by the innermost definition that holds them; by semantic in-degree, matches, id."""
    from .textsearch import enclosing

    held = enclosing(hits.select("path", F.col("start").alias("at")), spans).where("id is not null")
    found = held.groupBy("id", "name", "kind").agg(F.count(F.lit(1)).alias("matches")).join(degrees.select("id", "in_degree"), "id", "left").fillna(0, ["in_degree"])
    return found.orderBy(F.desc("in_degree"), F.desc("matches"), "id").limit(k)


def call_shape(pattern: str) -> tuple[str, int | None] | None:
    """The callee and arity of a pattern like ``f($A, $B)``, ``f()`` or ``f($$$)`` (any arity); None for others."""
    m = re.fullmatch(r"\s*(\w+)\((.*)\)\s*", pattern)
    if not m:
        return None
    args = [a.strip() for a in m[2].split(",")] if m[2].strip() else []
    if args == ["$$$"]:
        return m[1], None
    named = [a for a in args if re.fullmatch(r"\$[A-Z_][A-Z0-9_]*", a)]
    kept = [a for a in named if not a.startswith("$_")]
    return (m[1], len(args)) if len(named) == len(args) and len(set(kept)) == len(kept) else None


def calls_of_shape(refs: DataFrame, pattern: str) -> DataFrame | None:
    """References (name, kind, args) that a call pattern means, without parsing; None if it isn't one."""
    shape = call_shape(pattern)
    if shape is None:
        return None
    rows = refs.where((F.col("kind") == "call") & (F.col("name") == shape[0]))
    return rows if shape[1] is None else rows.where(F.size("args") == shape[1])


def graph_predicate(hits: DataFrame, resolved: DataFrame, target: DataFrame, relation: str = "resolvesTo", minimum: int = 0, require: str = "skip") -> DataFrame:
    """Hits (path, start, ...) whose reference at that place resolves, with enough confidence, to a target (id).

    resolved: path, start, dst, confidence, rel. relation names which references count: resolvesTo any, else calls, imports or implements. Where nothing is known about the place, require says
    skip (no hit) or ignore (a hit); error raises when the result is computed.
    """
    rows = resolved if relation == "resolvesTo" else resolved.where(F.col("rel") == relation)
    known = rows.where(F.col("confidence") >= minimum).select("path", "start", F.col("dst").alias("id"))
    good = known.join(target.select("id"), "id", "left_semi").select("path", "start").distinct().withColumn("good", F.lit(True))
    some = known.select("path", "start").distinct().withColumn("some", F.lit(True))
    out = hits.join(good, ["path", "start"], "left").join(some, ["path", "start"], "left")
    unknown = {"skip": F.lit(False), "ignore": F.lit(True), "error": F.raise_error(F.lit("nothing is known about the place")).cast("boolean")}[require]
    return out.where(F.when(F.col("good"), True).when(F.col("some"), False).otherwise(unknown)).drop("good", "some")


def same_binding(hits: DataFrame, resolved: DataFrame, left: str, right: str) -> DataFrame:
    """Hits whose two captured places (columns left and right) resolve to the same node."""
    r = resolved.select("path", F.col("start").alias("at"), "dst")
    a = hits.join(r.withColumnRenamed("at", left).withColumnRenamed("dst", "__a"), ["path", left])
    return a.join(r.withColumnRenamed("at", right).withColumnRenamed("dst", "__b"), ["path", right]).where("__a = __b").drop("__a", "__b")


def injected(ast: DataFrame) -> DataFrame:
    """(path, lang, start, text): scripts and styles inside HTML."""
    hosts = ast.where(F.col("kind").isin("script", "style")).select("path", F.col("node_id").alias("parent"), F.when(F.col("kind") == "script", "javascript").otherwise("css").alias("lang"))
    return ast.where("kind = 'text'").join(hosts, ["path", "parent"]).select("path", "lang", "start", "text")


# -- outlines and references of Python -----------------------------------------------------------------------------
ITEMS = "path string, name string, kind string, signature string, is_import boolean, is_exported boolean, member_of string, start int, end int"
REFS = "path string, holder string, name string, kind string, form string, qualifier string, alias string, args array<struct<class:string,expr:string>>, start int, end int"


def extract_python(files: DataFrame) -> DataFrame:
    """(path, items, refs) of Python files: definitions with their members, and calls and imports with their arguments."""

    def run(batches):
        item_type = pa.list_(pa.struct([(c.split()[0], {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}[c.split()[1]]) for c in ITEMS.split(", ")[1:]]))
        ref_type = pa.list_(pa.struct([("holder", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("form", pa.string()), ("qualifier", pa.string()), ("alias", pa.string()), ("args", pa.list_(pa.struct([("class", pa.string()), ("expr", pa.string())]))), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            items, refs = [], []
            for text in b.column(1).to_pylist():
                found = extract_text(text or "")
                items.append(found[0])
                refs.append(found[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, item_type), pa.array(refs, ref_type)], names=["path", "items", "refs"])

    items = ITEMS.split(", ", 1)[1].replace(" string", ":string").replace(" boolean", ":boolean").replace(" int", ":int").replace(", ", ",")
    refs = "holder:string,name:string,kind:string,form:string,qualifier:string,alias:string,args:array<struct<class:string,expr:string>>,start:int,end:int"
    return files.select("path", "text").mapInArrow(run, f"path string, items array<struct<{items}>>, refs array<struct<{refs}>>")


def extract_text(text: str) -> tuple[list[dict], list[dict]]:
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
    lines = [0]
    for x in text.splitlines(keepends=True):
        lines.append(lines[-1] + len(x))
    items: list[dict] = []
    refs: list[dict] = []

    def place(n) -> dict:
        return {"start": lines[n.lineno - 1] + n.col_offset, "end": lines[n.end_lineno - 1] + n.end_col_offset}

    def class_of(a) -> dict:
        kind = "var" if isinstance(a, ast.Name) else "field" if isinstance(a, ast.Attribute) else "call" if isinstance(a, ast.Call) else "literal"
        return {"class": kind, "expr": ast.unparse(a)[:64]}

    def visit(node, holder: str | None, owner: str | None) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                sign = f"class {n.name}" if kind == "class" else f"def {n.name}({ast.unparse(n.args)})"
                items.append({"name": n.name, "kind": kind, "signature": sign, "is_import": False, "is_exported": not n.name.startswith("_"), "member_of": owner, **place(n)})
                for base in getattr(n, "bases", ()):
                    refs.append({"holder": n.name, "name": ast.unparse(base), "kind": "implements", "form": "bare", "qualifier": None, "alias": None, "args": [], **place(base)})
                visit(n, n.name, n.name if kind == "class" else None)
                continue
            if isinstance(n, (ast.Import, ast.ImportFrom)):
                for a in n.names:
                    module = getattr(n, "module", None)
                    refs.append({"holder": holder, "name": a.name, "kind": "import", "form": "bare", "qualifier": module, "alias": a.asname, "args": [], **place(n)})
                    items.append({"name": a.asname or a.name, "kind": "import", "signature": None, "is_import": True, "is_exported": False, "member_of": None, **place(n)})
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    name, form, q = f.id, "bare", None
                elif isinstance(f, ast.Attribute):
                    q = ast.unparse(f.value)
                    name, form = f.attr, "static" if q[:1].isupper() else "method"
                else:
                    name = None
                if name:
                    refs.append({"holder": holder, "name": name, "kind": "call", "form": form, "qualifier": q, "alias": None, "args": [class_of(a) for a in n.args], **place(n)})
            visit(n, holder, owner if isinstance(node, ast.ClassDef) and not isinstance(n, ast.stmt) else None if not isinstance(n, (ast.If, ast.Try)) else owner)

    visit(tree, None, None)
    return items, refs


def outline(extracted: DataFrame, view: str = "signatures", items: str = "all") -> DataFrame:
    """Definitions by file: names, signatures, digest (counts by kind) or expanded (with members and places)."""
    rows = extracted.select("path", F.explode("items").alias("i")).select("path", "i.*")
    rows = {"all": rows, "structure": rows.where("not is_import"), "exports": rows.where("is_exported and not is_import"), "imports": rows.where("is_import")}[items]
    if view == "digest":
        return rows.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("path", *{"names": ["name"], "signatures": ["name", "kind", "signature"], "expanded": ["name", "kind", "signature", "member_of", "start", "end"]}[view])


def convert_case(c: Column, case: str) -> Column:
    """The case conversions of names, as Columns."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), r"[-./ _]+", " ")
    parts = F.filter(F.split(spaced, " "), lambda x: x != "")
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
    return {
        "lowerCase": F.lower(c), "upperCase": F.upper(c), "capitalize": F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))),
        "snakeCase": F.lower(F.array_join(parts, "_")), "kebabCase": F.lower(F.array_join(parts, "-")), "pascalCase": F.array_join(F.transform(parts, cap), ""),
        "camelCase": F.concat(F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), F.array_join(F.transform(F.slice(parts, 2, 10_000), cap), "")),
    }[case]


def sarif(hits: list[dict]) -> dict:
    """A page of hits as a SARIF log."""
    place = lambda h: {"physicalLocation": {"artifactLocation": {"uri": h["path"]}, "region": {"startLine": h["line"], "startColumn": h["column"]}}}
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "tessera"}}, "results": [{"ruleId": h["rule"], "message": {"text": h["text"]}, "locations": [place(h)]} for h in hits]}]}


def annotations(hits: list[dict], level: str = "warning") -> list[str]:
    """A page of hits as lines that mark places in a code review."""
    return [f"::{level} file={h['path']},line={h['line']},col={h['column']},title={h['rule']}::{h['text']}" for h in hits]
