"""Text of a graph query to its data form.

    query   := [MATCH pattern [WHERE pred]] (WITH output [WHERE pred] | UNWIND expr AS name)* RETURN output [UNION [ALL] query]
    output  := [DISTINCT] item (, item)* [ORDER BY expr [ASC|DESC] (, ...)*] [SKIP n] [LIMIT n]
    pattern := node (rel node)*
    node    := ( [name] [: kind (| kind)*] [{ property: literal, ... }] )
    rel     := -[ ... ]-> | <-[ ... ]- | -[ ... ]- | --> | <-- | --
    [ ... ] := [: type (| type)*] [* | *n | *a..b | *..b] [{ grade: name }]
"""

from __future__ import annotations

import re

from .ir import Agg, Arith, Call, Case, CeilingError, Cmp, Exists, HasLabel, IsNull, Item, Listing, Lit, Logic, Neg, Node, Not, Output, ParseError, Pattern, PlanError, Prop, Query, Rel, Unwind, Var, With

# Bounds on a query.
MAX_TEXT, MAX_HOPS, MAX_SEGMENTS, MAX_REGEX, MAX_LIST, MAX_ROWS = 16 * 1024, 10, 8, 512, 100_000, 100_000

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|`(?P<quoted>[^`]+)`
    |(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op><>|!=|<=|>=|=~|\.\.|[-+*/%=<>(){}\[\]:,.|])""",
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
COMPARISONS = {"=": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "=~": "=~"}


def lex(text: str) -> list[tuple[str, object, int]]:
    """(kind, value, offset) of every token; the last has the kind end."""
    if len(text.encode("utf-8", "surrogatepass")) > MAX_TEXT:
        raise CeilingError(f"a query has at most {MAX_TEXT} bytes")
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r}", at)
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif kind == "int":
            value = int(value)
            if value >= 1 << 63:
                raise ParseError("integer out of range", at)
        elif kind == "float":
            value = float(value)
        if kind != "space":
            out.append(("name" if kind == "quoted" else kind, value, at))
        at = m.end()
    return [*out, ("end", None, len(text))]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = lex(text), 0

    # -- tokens --------------------------------------------------------------------------------------------
    def fail(self, message: str):
        raise ParseError(message, self.tokens[self.at][2])

    def op(self, *ops: str) -> str | None:
        kind, value, _ = self.tokens[self.at]
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def word(self, *words: str) -> bool:
        """Whether these words come next, which are then taken."""
        here = self.tokens[self.at : self.at + len(words)]
        if len(here) == len(words) and all(k == "name" and v.lower() == w for (k, v, _), w in zip(here, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"expected {op!r}")

    def needs(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(f"expected {' '.join(words).upper()}")

    def take(self, kind: str):
        k, v, _ = self.tokens[self.at]
        if k != kind:
            self.fail(f"expected {kind}")
        self.at += 1
        return v

    # -- clauses -------------------------------------------------------------------------------------------
    def whole(self) -> Query:
        q = self.query()
        if self.tokens[self.at][0] != "end":
            self.fail("unexpected text after the query")
        return q

    def query(self) -> Query:
        pattern = where = None
        if self.word("optional"):
            raise PlanError("there is no optional pattern: MATCH takes only what is there")
        if self.word("match"):
            pattern = self.pattern()
            where = self.pred() if self.word("where") else None
            if self.op(","):
                raise PlanError("a query has one linear pattern")
        stages: list = []
        while True:
            if self.word("with"):
                out = self.output()
                if self.word("where"):
                    out = Output(out.items, out.distinct, out.order, out.skip, out.limit, self.pred())
                    out = self.tail(out)
                stages.append(With(out))
            elif self.word("unwind"):
                e = self.expr()
                self.needs("as")
                stages.append(Unwind(e, self.take("name")))
            elif self.word("match") or self.word("optional"):
                raise PlanError("a query has one MATCH")
            else:
                break
        self.needs("return")
        out = self.output()
        union = None
        if self.word("union"):
            union = (self.word("all"), self.query())
        return Query(pattern, where, tuple(stages), out, union)

    def output(self) -> Output:
        distinct, items = self.word("distinct"), [self.item()]
        while self.op(","):
            items.append(self.item())
        return self.tail(Output(tuple(items), distinct))

    def tail(self, out: Output) -> Output:
        order, skip, limit = list(out.order), out.skip, out.limit
        if self.word("order", "by"):
            while True:
                e = self.expr()
                down = self.word("desc") or self.word("descending")
                if not down:
                    self.word("asc") or self.word("ascending")
                order.append((e, down))
                if not self.op(","):
                    break
        skip = self.take("int") if self.word("skip") else skip
        limit = self.take("int") if self.word("limit") else limit
        return Output(out.items, out.distinct, tuple(order), skip, limit, out.where)

    def item(self) -> Item:
        e = self.expr()
        return Item(e, self.take("name") if self.word("as") else None)

    # -- patterns ------------------------------------------------------------------------------------------
    def pattern(self) -> Pattern:
        nodes, rels = [self.node()], []
        while (back := self.op("<")) or self.op("-"):
            if back:
                self.need("-")
            rels.append(self.rel(bool(back)))
            nodes.append(self.node())
        if len(nodes) > MAX_SEGMENTS + 1:
            raise CeilingError(f"a pattern has at most {MAX_SEGMENTS} relationships")
        return Pattern(tuple(nodes), tuple(rels))

    def names(self) -> tuple:
        out = [self.take("name")]
        while self.op("|"):
            self.op(":")
            out.append(self.take("name"))
        return tuple(out)

    def node(self) -> Node:
        self.need("(")
        var = self.take("name") if self.tokens[self.at][0] == "name" else None
        kinds = self.names() if self.op(":") else ()
        props: list = []
        if self.op("{"):
            while True:
                name = self.take("name")
                self.need(":")
                props.append((name.lower(), self.literal()))
                if not self.op(","):
                    break
            self.need("}")
        self.need(")")
        return Node(var, tuple(k.lower() for k in kinds), tuple(props))

    def literal(self):
        if self.word("true"):
            return True
        if self.word("false"):
            return False
        minus = self.op("-")
        kind, value, _ = self.tokens[self.at]
        if kind not in ("int", "float") and (minus or kind != "text"):
            self.fail("expected a literal")
        self.at += 1
        return -value if minus else value

    def rel(self, back: bool) -> Rel:
        types, hops, grade = (), None, None
        if self.op("["):
            if self.tokens[self.at][0] == "name":
                raise PlanError("a relationship can't be bound to a variable")
            types = tuple(t.lower() for t in self.names()) if self.op(":") else ()
            if self.op("*"):
                hops = self.hops()
            if self.op("{"):
                if not self.word("grade"):
                    self.fail("expected grade")
                self.need(":")
                grade = str(self.take("text" if self.tokens[self.at][0] == "text" else "name")).lower()
                self.need("}")
            self.need("]")
        self.need("-")
        forth = bool(self.op(">"))
        if back and forth:
            self.fail("a relationship has one direction")
        return Rel(types, "in" if back else "out" if forth else "both", hops, grade)

    def hops(self) -> tuple:
        least = self.take("int") if self.tokens[self.at][0] == "int" else None
        most = least
        if self.op(".."):
            most = self.take("int") if self.tokens[self.at][0] == "int" else MAX_HOPS
            least = 1 if least is None else least
        elif least is None:
            least, most = 1, MAX_HOPS
        if least < 1 or most < least:
            raise PlanError("hops run from 1 upwards")
        if most > MAX_HOPS:
            raise CeilingError(f"a path has at most {MAX_HOPS} hops")
        return least, most

    # -- predicates ----------------------------------------------------------------------------------------
    def pred(self):
        args = [self.conjunction()]
        while self.word("or"):
            args.append(self.conjunction())
        if self.word("xor"):
            raise PlanError("of the connectives only AND, OR and NOT can be used, not XOR")
        return args[0] if len(args) == 1 else Logic("or", tuple(args))

    def conjunction(self):
        args = [self.negation()]
        while self.word("and"):
            args.append(self.negation())
        return args[0] if len(args) == 1 else Logic("and", tuple(args))

    def negation(self):
        if self.word("not"):
            return Not(self.negation())
        if self.tokens[self.at][0] == "name" and self.tokens[self.at][1].lower() == "exists" and self.tokens[self.at + 1][1] == "{":
            self.at += 2
            p = self.pattern()
            if self.word("where"):
                raise PlanError("EXISTS takes a pattern without WHERE")
            self.need("}")
            return Exists(p)
        if self.tokens[self.at][:2] == ("op", "("):
            here = self.at  # a group of predicates, or an expression that starts with a parenthesis
            self.at += 1
            try:
                inner = self.pred()
                self.need(")")
                kind, value, _ = self.tokens[self.at]
                if not (kind == "op" and (value in COMPARISONS or value in "+-*/%")) and not (kind == "name" and value.lower() in ("in", "is", "starts", "ends", "contains")):
                    return inner
            except ParseError:
                pass
            self.at = here
        return self.comparison()

    def comparison(self):
        if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1][:2] == ("op", ":"):
            var = self.take("name")
            self.need(":")
            return HasLabel(var, tuple(k.lower() for k in self.names()))
        left = self.expr()
        for words, op in ((("starts", "with"), "starts"), (("ends", "with"), "ends"), (("contains",), "contains"), (("in",), "in")):
            if self.word(*words):
                return Cmp(op, left, self.expr())
        if self.word("is"):
            negated = self.word("not")
            self.needs("null")
            return IsNull(left, negated)
        op = self.op(*COMPARISONS)
        return Cmp(COMPARISONS[op], left, self.expr()) if op else left

    # -- expressions ---------------------------------------------------------------------------------------
    def expr(self):
        left = self.term()
        while op := self.op("+", "-"):
            left = Arith(op, left, self.term())
        return left

    def term(self):
        left = self.factor()
        while op := self.op("*", "/", "%"):
            left = Arith(op, left, self.factor())
        return left

    def factor(self):
        return Neg(self.factor()) if self.op("-") else self.atom()

    def atom(self):
        kind, value, _ = self.tokens[self.at]
        if kind in ("int", "float", "text"):
            self.at += 1
            return Lit(value)
        if self.op("("):
            e = self.expr()
            self.need(")")
            return e
        if self.op("["):
            items: list = []
            while not self.op("]"):
                items.append(self.expr())
                if not self.op(","):
                    self.need("]")
                    break
            return Listing(tuple(items))
        if self.tokens[self.at][:2] == ("op", "{"):
            raise PlanError("map literals are not supported")
        if kind != "name":
            self.fail("expected an expression")
        for word, lit in (("null", None), ("true", True), ("false", False)):
            if self.word(word):
                return Lit(lit)
        if self.word("case"):
            return self.case()
        name = self.take("name")
        if self.op("("):
            return self.call(name.lower())
        if self.op("."):
            return Prop(name, self.take("name").lower())
        return Var(name)

    def call(self, name: str):
        if name in ("type", "properties"):
            raise PlanError(f"{name}() is not supported")
        if name in AGGREGATES:
            distinct = self.word("distinct")
            arg = None
            if not (name == "count" and not distinct and self.op("*")):
                arg = self.expr()
            self.need(")")
            return Agg(name, arg, distinct)
        args: list = []
        if not self.op(")"):
            args.append(self.expr())
            while self.op(","):
                args.append(self.expr())
            self.need(")")
        return Call(name, tuple(args))

    def case(self) -> Case:
        subject = None if self.tokens[self.at][0] == "name" and self.tokens[self.at][1].lower() == "when" else self.expr()
        whens: list = []
        while self.word("when"):
            test = self.pred() if subject is None else self.expr()
            self.needs("then")
            whens.append((test, self.expr()))
        if not whens:
            self.fail("expected WHEN")
        default = self.expr() if self.word("else") else None
        self.needs("end")
        return Case(subject, tuple(whens), default)


def parse(text: str) -> Query:
    return Parser(text).whole()
