"""Syntax trees of HTML and Python texts, in one plain form."""

from __future__ import annotations

import ast
import re
import textwrap
from bisect import bisect_right
from dataclasses import dataclass
from dataclasses import field as made
from html.parser import HTMLParser

# HTML elements without an end.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
META = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)?|\$\$?([A-Z_][A-Z0-9_]*)")


@dataclass
class Tree:
    kind: str
    start: int
    end: int
    value: str | None = None  # of a leaf: its text
    field: str | None = None
    named: bool = True
    children: list[Tree] = made(default_factory=list)

    def walk(self):
        stack = [self]
        while stack:
            t = stack.pop()
            yield t
            stack.extend(reversed(t.children))


# -- HTML ----------------------------------------------------------------------------------------------------------
class Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.root = text, Tree("document", 0, len(text))
        self.open, self.lines = [self.root], [0, *[m.end() for m in re.finditer("\n", text)]]
        self.feed(text)
        self.close()
        for t in self.open[1:]:
            t.end = len(text)

    def here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def add(self, t: Tree) -> Tree:
        self.open[-1].children.append(t)
        return t

    def handle_starttag(self, tag, attrs):
        at, raw = self.here(), self.get_starttag_text() or ""
        t = self.add(Tree(tag, at, at + len(raw)))
        for k, v in attrs:
            place = max(0, raw.lower().find(k.lower()))
            t.children.append(Tree("attribute", at + place, at + len(raw), field="attribute", children=[Tree("attribute_name", at + place, at + place + len(k), k, "name"), *([Tree("attribute_value", at + max(0, raw.find(v)), at + max(0, raw.find(v)) + len(v), v, "value")] if v is not None else [])]))
            t.children[-1].end = t.children[-1].children[-1].end
        if tag not in VOID:
            self.open.append(t)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].kind == tag), None)
        if at is None:
            return
        end = self.text.find(">", self.here())
        for t in self.open[at:]:
            t.end = self.here()
        self.open[at].end = end + 1 if end >= 0 else len(self.text)
        del self.open[at:]

    def leaf(self, kind: str, raw: str, named: bool = True):
        at = self.here()
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if kind == "text" and last is not None and last.kind == "text" and last.end == at:
            last.end, last.value = at + len(raw), last.value + raw
        else:
            self.add(Tree(kind, at, at + len(raw), raw, named=named))

    def handle_data(self, data):
        self.leaf("text", data, bool(data.strip()))

    def handle_entityref(self, name):
        self.leaf("text", f"&{name};")

    def handle_charref(self, name):
        self.leaf("text", f"&#{name};")

    def handle_comment(self, data):
        self.leaf("comment", f"<!--{data}-->")

    def handle_decl(self, decl):
        self.leaf("doctype", f"<!{decl}>")


# -- Python --------------------------------------------------------------------------------------------------------
def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


def python_tree(text: str) -> Tree:
    lines, total = [0], 0
    raw = text.splitlines(keepends=True)
    for x in raw:
        total += len(x)
        lines.append(total)

    def offset(line: int, column: int) -> int:
        own = raw[line - 1] if line <= len(raw) else ""
        return lines[line - 1] + (column if own.isascii() else len(own.encode()[:column].decode("utf-8", "ignore")))

    def build(node: ast.AST, field_: str | None, start: int, end: int) -> Tree:
        if hasattr(node, "lineno"):
            start, end = offset(node.lineno, node.col_offset), offset(node.end_lineno, node.end_col_offset)
        t = Tree(snake(type(node).__name__), start, end, field=field_)
        for name, value in ast.iter_fields(node):
            if name in ("ctx", "type_comment", "kind", "type_ignores"):
                continue
            for v in value if isinstance(value, list) else [value]:
                if isinstance(v, ast.AST):
                    t.children.append(build(v, name, start, end))
                elif v is not None or (isinstance(node, ast.Constant) and name == "value"):
                    t.children.append(Tree(f"{t.kind}_{name}", start, end, repr(v) if isinstance(node, ast.Constant) else str(v), name, named=False))
        if not t.children and not hasattr(node, "lineno"):
            t.value, t.named = t.kind, False  # an operator
        return t

    root = build(ast.parse(text), None, 0, len(text))
    root.end = len(text)
    return root


PARSERS = {"html": lambda text: Html(text).root, "python": python_tree}


def parse(text: str, lang: str) -> Tree:
    return PARSERS[lang](text)


def rows(tree: Tree, text: str) -> list[tuple]:
    """(node_id, parent, last, depth, kind, named, field, start, end, sib, named_sib, line, column, ancestors) in pre-order; last is the greatest id below."""
    lines = [0, *[m.end() for m in re.finditer("\n", text)]]
    out: list[list] = []
    stack: list = [(tree, None, [], 0, 0)]
    while stack:
        t, parent, above, sib, named_sib = stack.pop()
        i = len(out)
        line = bisect_right(lines, t.start) - 1
        out.append([i, parent, i, len(above), t.kind, t.named, t.field, t.start, t.end, sib, named_sib, line + 1, t.start - lines[line] + 1, above])
        inner, named = [], 0
        for k, c in enumerate(t.children):
            inner.append((c, i, [*above, i], k, named if c.named else None))
            named += c.named
        stack.extend(reversed(inner))
    for r in reversed(out):
        if r[1] is not None:
            out[r[1]][2] = max(out[r[1]][2], r[2])
    return [tuple(r) for r in out]


# -- patterns ------------------------------------------------------------------------------------------------------
def pattern_tree(pattern: str, lang: str) -> Tree:
    """The tree of a code pattern; capture names become identifiers that match() knows."""

    def stand_in(m):
        many, one = m[0].startswith("$$$"), m[2]
        return f"__many_{m[1] or ''}__" if many else f"__one_{one}__"

    text = META.sub(stand_in, textwrap.dedent(pattern).strip())
    t = parse(text, lang)
    kids = [c for c in t.children if c.named]
    if len(kids) != 1:
        raise ValueError("a pattern is one piece of code")
    t = kids[0]
    if lang == "python" and t.kind == "expr" and t.children:
        t = t.children[0]
    return t


def stands_for(t: Tree) -> tuple[str, str] | None:
    """Whether a pattern's node is a capture: its sort and name."""
    probe = t
    while probe.value is None and len(probe.children) == 1 and probe.kind in ("name", "expr", "arg"):
        probe = probe.children[0]
    m = re.fullmatch(r"\s*__(one|many)_([A-Z0-9_]*?)__\s*", probe.value or "")
    return (m[1], m[2]) if m else None


def same(a: Tree, b: Tree) -> bool:
    return a.kind == b.kind and a.value == b.value and len(a.children) == len(b.children) and all(map(same, a.children, b.children))


class Matcher:
    """Matches a pattern's tree against nodes. Equal capture names must meet equal subtrees.

    strictness: cst compares all nodes; smart, ast and relaxed leave out comments and blank text; signature leaves out the text of leaves; template compares the
    text of leaves and no kinds.
    """

    def __init__(self, pattern: str, lang: str, strictness: str = "smart"):
        if strictness not in ("cst", "smart", "ast", "relaxed", "signature", "template"):
            raise ValueError(f"unknown strictness {strictness}")
        self.goal, self.strictness = pattern_tree(pattern, lang), strictness

    def children(self, t: Tree) -> list[Tree]:
        return t.children if self.strictness == "cst" else [c for c in t.children if c.kind != "comment" and not (c.kind == "text" and not c.named)]

    def match(self, t: Tree) -> dict[str, list[Tree]] | None:
        return self.node(self.goal, t, {})

    def bind(self, name: str, nodes: list[Tree], env: dict) -> dict | None:
        if not name or name.startswith("_"):
            return env
        held = env.get(name)
        if held is None:
            return env | {name: nodes}
        return env if len(held) == len(nodes) and all(map(same, held, nodes)) else None

    def node(self, goal: Tree, t: Tree, env: dict) -> dict | None:
        hole = stands_for(goal)
        if hole and hole[0] == "one":
            return self.bind(hole[1], [t], env)
        if self.strictness != "template" and goal.kind != t.kind:
            return None
        if goal.value is not None or t.value is not None:
            if goal.value is not None and re.search(r"__one_[A-Z0-9_]+__", goal.value):  # a capture inside a leaf
                rest = re.fullmatch(re.sub(r"__one_([A-Z0-9_]+)__", r"(?P<\1>.*)", re.escape(goal.value).replace("__one", "__one")), t.value or "", re.S)
                for k, v in (rest.groupdict() if rest else {}).items():
                    env = self.bind(k, [Tree("text", t.start, t.end, v)], env) if env is not None else None
                return env if rest else None
            if self.strictness != "signature" and (goal.value or "").strip() != (t.value or "").strip():
                return None
        return self.list(self.children(goal), self.children(t), env)

    def list(self, goals: list[Tree], nodes: list[Tree], env: dict) -> dict | None:
        if not goals:
            return env if not nodes else None
        hole = stands_for(goals[0])
        if hole and hole[0] == "many":
            field_ = goals[0].field
            for n in range(len(nodes) + 1):
                if n and nodes[n - 1].field != field_:
                    break
                bound = self.bind(hole[1], nodes[:n], env)
                rest = self.list(goals[1:], nodes[n:], bound) if bound is not None else None
                if rest is not None:
                    return rest
            return None
        if not nodes or (goals[0].field != nodes[0].field and self.strictness != "template"):
            return None
        env2 = self.node(goals[0], nodes[0], env)
        return self.list(goals[1:], nodes[1:], env2) if env2 is not None else None


def span(nodes: list[Tree], text: str) -> str:
    if not nodes:
        return ""
    if len(nodes) == 1 and nodes[0].value is not None and text[nodes[0].start : nodes[0].end] != nodes[0].value:
        return nodes[0].value
    return text[nodes[0].start : nodes[-1].end]


# -- transforms and fixes ------------------------------------------------------------------------------------------
def words_of(name: str, separators=None) -> list[str]:
    marks = {"dash": "-", "dot": ".", "slash": "/", "space": " ", "underscore": "_"}
    cuts = "".join(marks[s] for s in (separators or marks) if s in marks)
    parts = re.split(f"[{re.escape(cuts)}]+", name) if cuts else [name]
    if separators is None or "caseChange" in separators:
        parts = [w for p in parts for w in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", p)]
    return [p for p in parts if p]


CASES = {
    "lowerCase": lambda s, _: s.lower(), "upperCase": lambda s, _: s.upper(), "capitalize": lambda s, _: s[:1].upper() + s[1:],
    "camelCase": lambda s, w: "".join([x.lower() if i == 0 else x[:1].upper() + x[1:].lower() for i, x in enumerate(w)]), "pascalCase": lambda s, w: "".join(x[:1].upper() + x[1:].lower() for x in w),
    "snakeCase": lambda s, w: "_".join(w).lower(), "kebabCase": lambda s, w: "-".join(w).lower(),
}


def transform(spec: dict, captured: dict[str, str], lang: str) -> str | None:
    """One transform of a capture: substring, replace, convert or rewrite."""
    (kind, arg), = spec.items()
    source = captured.get(arg["source"].lstrip("$"))
    if source is None:
        return None
    if kind == "substring":
        n = len(source)
        at = lambda x, default: default if x is None else max(0, min(n, x if x >= 0 else n + x))
        return source[at(arg.get("startChar"), 0) : at(arg.get("endChar"), n)]
    if kind == "replace":
        return re.sub(arg["replace"], re.sub(r"\$(\d+|\w+)", r"\\g<\1>", arg["by"]), source)
    if kind == "convert":
        return CASES[arg["toCase"]](source, words_of(source, arg.get("separatedBy")))
    if kind == "rewrite":
        return rewrite(source, arg["rewriters"], lang, arg.get("joinBy"))
    raise ValueError(f"unknown transform {kind}")


def rewrite(source: str, rewriters: list[dict], lang: str, join_by: str | None = None) -> str:
    """The text with each outermost match of a rewriter {pattern, fix} replaced; joined, only the replacements remain."""
    tree, edits = parse(source, lang), []
    matchers = [(Matcher(r["pattern"], lang), r["fix"]) for r in rewriters]
    done = -1
    for t in tree.walk():
        if t.start < done or t.kind in ("module", "document"):
            continue
        for m, fix in matchers:
            env = m.match(t)
            if env is not None:
                edits.append((t.start, t.end, filled(fix, {k: span(v, source) for k, v in env.items()})))
                done = t.end
                break
    if join_by is not None:
        return join_by.join(e[2] for e in edits)
    for a, b, x in reversed(edits):
        source = source[:a] + x + source[b:]
    return source


def filled(template: str, captured: dict[str, str], indent: int = 0) -> str:
    """A fix with its captures; further lines of a capture and of the fix keep their place relative to where they start."""

    def put(m):
        name = m[1] or m[2]
        if name not in captured:
            return ""
        column = m.start() - (template.rfind("\n", 0, m.start()) + 1)
        head, *rest = captured[name].split("\n")
        rest = textwrap.dedent("\n".join(rest)).split("\n") if rest else []
        lead = template[m.start() - column : m.start()]
        pad = " " * (len(lead) - len(lead.lstrip()))
        extra = min((len(x) - len(x.lstrip()) for x in captured[name].split("\n")[1:] if x.strip()), default=0)
        return "\n".join([head, *[pad + " " * max(0, extra - indent) + x if x else x for x in rest]])

    out = META.sub(put, template)
    head, *rest = out.split("\n")
    return "\n".join([head, *[" " * indent + x if x.strip() else x for x in rest]])
