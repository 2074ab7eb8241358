"""Graph queries to DataFrames.

Expressions become Columns with a static type; the two-valued logic of the language wraps each comparison in coalesce(..., false).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from . import ir, patterns
from .ir import Agg, Arith, Call, Case, CeilingError, Cmp, Exists, HasLabel, IsNull, Listing, Lit, Logic, Neg, Not, Output, PlanError, Prop, Query, Unwind, Var, With
from .parser import MAX_LIST, MAX_REGEX, parse
from .patterns import slot

NUMBERS = ("int", "float")
SPARK = {"int": "bigint", "float": "double", "text": "string", "bool": "boolean", "null": "string"}


def is_list(t) -> bool:
    return isinstance(t, tuple) and t[0] == "list"


def spark_type(t) -> str:
    return f"array<{spark_type(t[1])}>" if is_list(t) else SPARK[t]


def unify(types, what: str):
    """One type for all; integers widen to floats, null fits anything."""
    found = "null"
    for t in types:
        if t == "null" or t == found:
            continue
        if found == "null":
            found = t
        elif {t, found} == {"int", "float"}:
            found = "float"
        elif is_list(t) and is_list(found):
            found = ("list", unify([t[1], found[1]], what))
        else:
            raise PlanError(f"{what}: {t} and {found} don't go together")
    return found


def comparable(a, b) -> bool:
    return "null" in (a, b) or a == b or (a in NUMBERS and b in NUMBERS) or (is_list(a) and is_list(b))


class Scope:
    """Variables in reach: nodes (a column for each property) and values (one column, with its type)."""

    def __init__(self, nodes: dict[str, set[str]], values: dict[str, object] | None = None):
        self.nodes, self.values = nodes, values or {}

    def names(self) -> set[str]:
        return {*self.nodes, *self.values}


class Expressions:
    """Compiles expressions over a scope. flags: columns of EXISTS probes that have been joined; aggregates: columns of computed ones."""

    def __init__(self, graph, scope: Scope, flags=None, aggregates=None, keys=None):
        self.graph, self.scope, self.flags, self.aggregates, self.keys = graph, scope, flags or {}, aggregates, keys or {}

    def of(self, e) -> tuple[Column, object]:
        if self.keys and e in self.keys:
            return self.keys[e]
        return getattr(self, "on_" + type(e).__name__.lower())(e)

    # -- leaves --------------------------------------------------------------------------------------------
    def on_lit(self, e: Lit):
        v = e.value
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "text"
        return (F.lit(v).cast("bigint") if kind == "int" else F.lit(v).cast("string") if v is None else F.lit(v)), kind

    def on_listing(self, e: Listing):
        if len(e.items) > MAX_LIST:
            raise CeilingError(f"a list has at most {MAX_LIST} elements")
        parts = [self.of(x) for x in e.items]
        try:
            t = unify([p[1] for p in parts], "list")
        except PlanError:  # mixed elements are kept as text
            t = "text"
        if not parts:
            return F.array().cast("array<string>"), ("list", "null")
        return F.array(*[c.cast(spark_type(t)) for c, _ in parts]), ("list", t)

    def on_var(self, e: Var):
        if e.name in self.scope.values:
            return F.col(e.name), self.scope.values[e.name]
        if e.name in self.scope.nodes:
            return F.col(slot(e.name)), "node"
        raise PlanError(f"unknown variable {e.name}")

    def on_prop(self, e: Prop):
        if e.var not in self.scope.nodes:
            raise PlanError(f"{e.var} is not a node here")
        if e.name not in schema.PROPERTIES:
            raise PlanError(f"unknown property {e.name}")
        return F.col(slot(e.var, e.name)), schema.PROPERTIES[e.name]

    def on_agg(self, e: Agg):
        if self.aggregates is None:
            raise PlanError("an aggregate can't stand here")
        return self.aggregates[e]

    # -- arithmetic ----------------------------------------------------------------------------------------
    def on_neg(self, e: Neg):
        c, t = self.of(e.arg)
        if t not in (*NUMBERS, "null"):
            raise PlanError("minus takes a number")
        return (F.try_subtract(F.lit(0).cast(spark_type(t) if t != "null" else "bigint"), c.cast(spark_type(t) if t != "null" else "bigint"))), t

    def on_arith(self, e: Arith):
        (a, s), (b, t) = self.of(e.left), self.of(e.right)
        if e.op == "+" and is_list(s):
            kind = unify([s[1], t[1] if is_list(t) else t], "+")
            whole = f"array<{spark_type(kind)}>"
            joined = F.concat(a.cast(whole), b.cast(whole)) if is_list(t) else F.array_append(a.cast(whole), b.cast(spark_type(kind)))
            return joined, ("list", kind)
        if e.op == "+" and "text" in (s, t):
            if is_list(t) or "node" in (s, t):
                raise PlanError("text can't be joined to that")
            return F.concat(a.cast("string"), b.cast("string")), "text"
        if s not in (*NUMBERS, "null") or t not in (*NUMBERS, "null"):
            raise PlanError(f"{e.op} takes numbers")
        kind = "float" if "float" in (s, t) or e.op == "/" else "int"
        a, b = a.cast(spark_type(kind)), b.cast(spark_type(kind))
        if e.op == "/":
            return F.try_divide(a, b), "float"
        if e.op == "%":
            return F.when(b != 0, F.pmod(a, F.abs(b))), kind
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b), kind

    def on_case(self, e: Case):
        results = [self.of(r) for _, r in e.whens] + [self.of(e.default) if e.default is not None else (F.lit(None), "null")]
        kind = unify([t for _, t in results], "CASE")
        out = results[-1][0].cast(spark_type(kind))
        subject = self.of(e.subject) if e.subject is not None else None
        for (test, _), (c, _) in zip(reversed(e.whens), reversed(results[:-1]), strict=True):
            if subject is None:
                hit = self.truth(test)
            else:
                v, t = self.of(test)
                hit = subject[0].eqNullSafe(v) if comparable(subject[1], t) else F.lit(False)
            out = F.when(hit, c.cast(spark_type(kind))).otherwise(out)
        return out, kind

    # -- functions -----------------------------------------------------------------------------------------
    def on_call(self, e: Call):
        name, n = e.name, len(e.args)
        arity = {"substring": (2, 3), "coalesce": (1, 16), "range": (2, 3), "replace": (3, 3), "left": (2, 2), "right": (2, 2), "split": (2, 2)}
        if name not in FUNCTIONS:
            raise PlanError(f"unknown function {name}")
        least, most = arity.get(name, (1, 1))
        if not least <= n <= most:
            raise PlanError(f"{name} takes {least} to {most} arguments")
        if name in ("id", "labels", "keys"):
            if not (isinstance(e.args[0], Var) and e.args[0].name in self.scope.nodes):
                raise PlanError(f"{name} takes a node")
            var = e.args[0].name
            if name == "id":
                return F.col(slot(var)), "int"
            if name == "labels":
                return F.array(F.col(slot(var, "kind"))), ("list", "text")
            return F.array(*map(F.lit, schema.PROPERTIES)), ("list", "text")
        return FUNCTIONS[name](*[self.of(a) for a in e.args])

    # -- predicates ----------------------------------------------------------------------------------------
    def truth(self, e) -> Column:
        """The two-valued truth of a predicate."""
        c, t = self.of(e)
        if t not in ("bool", "null"):
            raise PlanError("a condition must be true or false")
        return F.coalesce(c.cast("boolean"), F.lit(False))

    def on_logic(self, e: Logic):
        parts = [self.truth(a) for a in e.args]
        return reduce((lambda a, b: a & b) if e.op == "and" else (lambda a, b: a | b), parts), "bool"

    def on_not(self, e: Not):
        return ~self.truth(e.arg), "bool"

    def on_isnull(self, e: IsNull):
        c, _ = self.of(e.arg)
        return (c.isNotNull() if e.negated else c.isNull()), "bool"

    def on_haslabel(self, e: HasLabel):
        if e.var not in self.scope.nodes:
            raise PlanError(f"{e.var} is not a node here")
        for k in e.kinds:
            if k not in self.graph.kinds:
                raise PlanError(f"unknown kind {k}")
        return F.col(slot(e.var, "kind")).isin(*e.kinds), "bool"

    def on_exists(self, e: Exists):
        if e not in self.flags:
            raise PlanError("EXISTS can't stand here")
        return F.coalesce(F.col(self.flags[e]), F.lit(False)), "bool"

    def on_cmp(self, e: Cmp):
        a, s = self.of(e.left)
        if e.op == "=~":
            if not (isinstance(e.right, Lit) and isinstance(e.right.value, str)):
                raise PlanError("=~ takes a literal pattern")
            if s not in ("text", "null"):
                raise PlanError("=~ takes text")
            return F.coalesce(a.rlike(regex(e.right.value)), F.lit(False)), "bool"
        b, t = self.of(e.right)
        if e.op == "in":
            if not is_list(t):
                raise PlanError("IN takes a list")
            if not comparable(s, t[1]):
                return F.lit(False), "bool"
            return F.coalesce(F.exists(b, lambda x: x.eqNullSafe(a.cast(spark_type(t[1])) if s == "null" else a)), F.lit(False)), "bool"
        if e.op in ("starts", "ends", "contains"):
            if s not in ("text", "null") or t not in ("text", "null"):
                raise PlanError(f"{e.op} takes text")
            return F.coalesce({"starts": a.startswith, "ends": a.endswith, "contains": a.contains}[e.op](b), F.lit(False)), "bool"
        if e.op in ("=", "<>"):
            if not comparable(s, t):
                raise PlanError(f"{s} can't equal {t}")
            if isinstance(e.left, Prop) and e.left.name in ("kind", "eid"):
                a, b = F.lower(a), F.lower(b)
            return F.coalesce(a == b if e.op == "=" else a != b, F.lit(False)), "bool"
        if "null" not in (s, t) and not (s in NUMBERS and t in NUMBERS) and not (s == t and s in ("text", "bool")):
            raise PlanError(f"{s} and {t} have no order")
        return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.op], F.lit(False)), "bool"


def regex(pattern: str) -> str:
    """A pattern of the common dialect: no look-around and no back-references."""
    if len(pattern.encode()) > MAX_REGEX:
        raise CeilingError(f"a pattern has at most {MAX_REGEX} bytes")
    if re.search(r"\(\?(=|!|<=|<!)|(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise PlanError("look-around and back-references are not supported")
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "x", pattern, flags=re.I).replace("\\z", "$"))
    except re.error as e:
        raise PlanError(f"not a pattern: {e}") from None
    return pattern


# -- scalar functions: (column, type) arguments to (column, type); ill-typed arguments give null -----------------------------
def typed(kinds, result, f):
    def call(*args):
        for (_, t), k in zip(args, kinds, strict=False):
            if t != "null" and k != "any" and not (is_list(t) if k == "list" else t in NUMBERS if k == "number" else t == k):
                return F.lit(None).cast(SPARK.get(result, "string")), result if isinstance(result, str) else "null"
        cast = [c.cast({"text": "string", "int": "bigint"}[k]) if t == "null" and k in ("text", "int") else c for (c, t), k in zip(args, kinds, strict=False)]
        return f(*cast), result

    return call


def fn_reverse(a):
    return F.reverse(a[0]), a[1]


def fn_size(a):
    return (F.size(a[0]) if is_list(a[1]) else F.char_length(a[0])).cast("bigint"), "int"


def fn_substring(s, start, n=None):
    at = F.greatest(start[0], F.lit(0)) + 1
    whole = F.char_length(s[0])
    return F.substr(s[0], at.cast("int"), (F.greatest(n[0], F.lit(0)) if n else whole).cast("int")), "text"


def fn_split(s, sep):
    return F.when(s[0].isNotNull() & sep[0].isNotNull(), F.when(sep[0] == "", F.split(s[0], "")).otherwise(F.split(s[0], F.concat(F.lit("\\Q"), sep[0], F.lit("\\E")), -1))), ("list", "text")


def fn_tostring(a):
    if is_list(a[1]):
        return F.concat(F.lit("["), F.array_join(a[0].cast("array<string>"), ", ", "null"), F.lit("]")), "text"
    if a[1] == "float":
        return F.when(a[0] == F.floor(a[0]), F.floor(a[0]).cast("string")).otherwise(a[0].cast("string")), "text"
    return a[0].cast("string"), "text"


def fn_tointeger(a):
    c, t = a
    return (c.try_cast("bigint") if t != "text" else text.trim(c).try_cast("bigint")), "int"


def fn_tofloat(a):
    c, t = a
    if t == "bool" or is_list(t):
        return F.lit(None).cast("double"), "float"
    return (c if t != "text" else text.trim(c)).try_cast("double"), "float"


def fn_toboolean(a):
    c, t = a
    if t == "bool":
        return c, "bool"
    if t != "text":
        return F.lit(None).cast("boolean"), "bool"
    low = F.lower(text.trim(c))
    return F.when(low == "true", True).when(low == "false", False), "bool"


def fn_coalesce(*args):
    t = unify([a[1] for a in args], "coalesce")
    return F.coalesce(*[c.cast(spark_type(t)) for c, _ in args]), t


def fn_end(at):
    def call(a):
        if not is_list(a[1]):
            return F.lit(None).cast("string"), "null"
        return F.try_element_at(a[0], F.lit(at)), a[1][1]

    return call


def fn_range(a, b, step=None):
    by = step[0] if step else F.lit(1).cast("bigint")
    good = F.when(by == 0, False).when(by > 0, a[0] <= b[0]).otherwise(a[0] >= b[0])
    few = F.least(F.abs(b[0] - a[0]) / F.abs(by) + 1, F.lit(MAX_LIST + 1)) <= MAX_LIST
    made = F.when(few, F.sequence(a[0], F.when(good, b[0]).otherwise(a[0]), F.when(good, by).otherwise(F.lit(1).cast("bigint")))).otherwise(F.raise_error(F.lit(f"a list has at most {MAX_LIST} elements")).cast("array<bigint>"))
    return F.when(good, made).when(a[0].isNotNull() & b[0].isNotNull() & by.isNotNull(), F.array().cast("array<bigint>")), ("list", "int")


def fn_abs(a):
    return (F.abs(a[0]), a[1]) if a[1] in NUMBERS else (F.lit(None).cast("bigint"), "int")


FUNCTIONS = {
    "tolower": typed(["text"], "text", F.lower), "toupper": typed(["text"], "text", F.upper),
    "trim": typed(["text"], "text", text.trim), "ltrim": typed(["text"], "text", lambda c: text.trim(c, right=False)), "rtrim": typed(["text"], "text", lambda c: text.trim(c, left=False)),
    "reverse": fn_reverse, "replace": typed(["text"] * 3, "text", lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b))), "substring": fn_substring,
    "left": typed(["text", "int"], "text", lambda s, n: F.left(s, F.greatest(n, F.lit(0)).cast("int"))), "right": typed(["text", "int"], "text", lambda s, n: F.right(s, F.greatest(n, F.lit(0)).cast("int"))),
    "split": fn_split, "size": fn_size, "length": fn_size, "tostring": fn_tostring, "tointeger": fn_tointeger, "tofloat": fn_tofloat, "toboolean": fn_toboolean, "coalesce": fn_coalesce,
    "id": None, "labels": None, "keys": None, "head": fn_end(1), "last": fn_end(-1), "range": fn_range, "abs": fn_abs, "sign": typed(["number"], "int", lambda c: F.signum(c).cast("bigint")),
    "round": typed(["number"], "int", lambda c: F.round(c).cast("bigint")), "floor": typed(["number"], "int", lambda c: F.floor(c).cast("bigint")), "ceil": typed(["number"], "int", lambda c: F.ceil(c).cast("bigint")),
}


# -- titles ------------------------------------------------------------------------------------------------------------------
def title(e) -> str:
    """The name of an output column that has no alias."""
    match e:
        case Var(name):
            return name
        case Prop(var, name):
            return f"{var}.{name}"
        case Lit(value):
            return "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        case Agg(name, None, _):
            return name
        case Agg(name, arg, distinct):
            return f"{name}({'DISTINCT ' * distinct}{title(arg)})"
        case Call(name, args):
            return f"{name}({', '.join(map(title, args))})"
        case Arith(op, left, right):
            return f"{title(left)} {op} {title(right)}"
        case Neg(arg):
            return f"-{title(arg)}"
        case Listing(items):
            return f"[{', '.join(map(title, items))}]"
        case _:
            return type(e).__name__.lower()


# -- reads -----------------------------------------------------------------------------------------------------------------------
def reads_of(query: Query) -> dict[str, set[str]]:
    """Properties that the query reads, by variable; a variable that is returned bare is read with its four."""
    out: dict[str, set[str]] = {}
    for e in ir.walk(tuple(x for x in (query.where, query.stages, query.output))):
        if isinstance(e, Prop):
            out.setdefault(e.var, set()).add(e.name)
        elif isinstance(e, HasLabel):
            out.setdefault(e.var, set()).add("kind")
        elif isinstance(e, Call) and e.name == "labels" and e.args and isinstance(e.args[0], Var):
            out.setdefault(e.args[0].name, set()).add("kind")
        elif isinstance(e, ir.Item) and isinstance(e.expr, Var):
            out.setdefault(e.expr.name, set()).update(("id", "name", "kind", "path"))
    # a node that WITH renames is read under its new name
    for s in reversed(query.stages):
        if isinstance(s, With):
            for i in s.output.items:
                if isinstance(i.expr, Var) and i.alias:
                    out.setdefault(i.expr.name, set()).update(out.get(i.alias, ()))
    for v in out.values():
        bad = v - set(schema.PROPERTIES)
        if bad:
            raise PlanError(f"unknown property {sorted(bad)[0]}")
    return out


class Compiler:
    def __init__(self, graph):
        self.graph = graph

    # -- predicates over rows ----------------------------------------------------------------------------------
    def filtered(self, rows: DataFrame, scope: Scope, pred) -> DataFrame:
        """rows that satisfy pred: EXISTS as a conjunct is a semi-join, NOT EXISTS an anti-join, elsewhere a joined flag."""
        if any(isinstance(e, Agg) for e in ir.walk(pred)):
            raise PlanError("an aggregate can't stand in WHERE")
        rest = []
        for c in pred.args if isinstance(pred, Logic) and pred.op == "and" else [pred]:
            inner, how = (c.arg, "left_anti") if isinstance(c, Not) else (c, "left_semi")
            if isinstance(inner, Exists):
                var, ids = patterns.matching(self.graph, inner.pattern, scope.nodes)
                rows = rows.join(ids.withColumnRenamed("id", "__probe"), F.col(slot(var)) == F.col("__probe"), how)
            else:
                rest.append(c)
        if not rest:
            return rows
        keep = rows.columns
        rows, flags = self.flagged(rows, scope, tuple(rest))
        on = Expressions(self.graph, scope, flags)
        for c in rest:
            rows = rows.where(on.truth(c))
        return rows.select(*keep)

    def flagged(self, rows: DataFrame, scope: Scope, exprs) -> tuple[DataFrame, dict]:
        """rows with a boolean column for each EXISTS in the expressions."""
        flags: dict = {}
        for e in ir.walk(exprs):
            if isinstance(e, Exists) and e not in flags:
                var, ids = patterns.matching(self.graph, e.pattern, scope.nodes)
                flags[e] = f"__exists{len(flags)}"
                rows = rows.join(ids.select(F.col("id").alias("__probe"), F.lit(True).alias(flags[e])), F.col(slot(var)) == F.col("__probe"), "left").drop("__probe")
        return rows, flags

    # -- outputs -------------------------------------------------------------------------------------------------
    def project(self, rows: DataFrame, scope: Scope, out: Output, final: bool) -> tuple[DataFrame, Scope]:
        """RETURN or WITH. Columns of values carry their names, of nodes their slots; a final node becomes four columns."""
        items = list(out.items)
        if final:
            for i in items:
                if isinstance(i.expr, Var) and i.expr.name in scope.nodes and i.alias:
                    raise PlanError("a returned node can't be renamed")
        names = [i.alias or title(i.expr) for i in items]
        if not final:
            for i, n in zip(items, names, strict=True):
                if not i.alias and not isinstance(i.expr, Var):
                    raise PlanError(f"WITH needs a name for {n}")
        grouping = any(isinstance(e, Agg) for e in ir.walk(tuple(i.expr for i in items)))
        rows, flags = self.flagged(rows, scope, (tuple(items), out.order))
        outside: list = []  # what ORDER BY reads from the scope before
        order_by = []
        for e, down in out.order:
            target = next((k for k, (i, n) in enumerate(zip(items, names, strict=True)) if i.expr == e or (isinstance(e, Var) and e.name == n) or title(e) == n), None)
            if target is None:
                if grouping or out.distinct:
                    raise PlanError("ORDER BY must name an output here")
                outside.append(e)
                order_by.append((f"__order{len(outside) - 1}", down))
            else:
                order_by.append((target, down))
        is_node = [isinstance(i.expr, Var) and i.expr.name in scope.nodes for i in items]
        columns: list[list[str]] = []  # of each item
        new_nodes, new_values, chosen = {}, {}, []

        def add(k: int, col_, kind):
            if kind == "node":
                raise PlanError("a node can't be computed with")
            if isinstance(kind, str) and kind == "null":
                col_ = col_.cast("string")
            columns.append([names[k]])
            new_values[names[k]] = kind
            chosen.append(col_.alias(names[k]))

        if grouping:
            rows, computed = self.grouped(rows, scope, items, is_node, flags)
        for k, i in enumerate(items):
            if is_node[k]:
                var, props = i.expr.name, ["id", *sorted(scope.nodes[i.expr.name] - {"id"})]
                if final:
                    shown = ["id", "name", "kind", "path"]
                    columns.append([f"{var}.{p}" for p in shown])
                    chosen += [F.col(slot(var, p)).alias(f"{var}.{p}") for p in shown]
                else:
                    columns.append([slot(names[k], p) for p in props])
                    new_nodes[names[k]] = set(props)
                    chosen += [F.col(slot(var, p)).alias(slot(names[k], p)) for p in props]
            elif grouping:
                add(k, *computed[k])
            else:
                add(k, *Expressions(self.graph, scope, flags).of(i.expr))
        titles = [c for cs in columns for c in cs]
        if len(set(titles)) < len(titles):
            raise PlanError("two outputs have the same name")
        order_columns = [Expressions(self.graph, scope, flags).of(e)[0].alias(f"__order{n}") for n, e in enumerate(outside)]
        if not out.order and not grouping and not out.distinct and (out.skip is not None or out.limit is not None):
            # where no order is asked for, rows go by the ids of the nodes that they bind, in the pattern's order
            for var in scope.nodes:
                order_by.append((f"__order{len(order_columns)}", False))
                order_columns.append(F.col(slot(var)).alias(order_by[-1][0]))
        rows = rows.select(*chosen, *order_columns)
        if out.distinct:
            rows = rows.dropDuplicates()
        after = Scope(new_nodes, new_values)
        if not final and out.where is not None:
            rows = self.filtered(rows, after, out.where)
        q = lambda c: f"`{c}`"
        if out.order or out.skip is not None or out.limit is not None:
            # ties go by the whole output row, and so do groups and distinct rows where no order is asked for
            keys = []
            for target, down in order_by:
                for c in [target] if isinstance(target, str) else columns[target]:
                    keys.append(F.col(q(c)).desc() if down else F.col(q(c)).asc())
            keys += [F.col(q(c)).asc() for c in titles]
            rows = rows.orderBy(*keys)
            if out.skip:
                rows = rows.offset(out.skip)
            if out.limit is not None:
                rows = rows.limit(out.limit)
        return rows.select(*[F.col(q(c)) for c in titles]) if order_columns else rows, after

    def grouped(self, rows: DataFrame, scope: Scope, items, is_node, flags):
        """Rows by the items that hold no aggregate; of each item its column and type over them."""
        on = Expressions(self.graph, scope, flags)
        keys: dict = {}
        key_columns = []
        for k, i in enumerate(items):
            if is_node[k]:
                for p in ["id", *sorted(scope.nodes[i.expr.name] - {"id"})]:
                    key_columns.append(F.col(slot(i.expr.name, p)))
            elif not any(isinstance(e, Agg) for e in ir.walk(i.expr)):
                c, t = on.of(i.expr)
                keys[i.expr] = (F.col(f"__key{k}"), t)
                key_columns.append(c.alias(f"__key{k}"))
        for k, i in enumerate(items):
            if not is_node[k] and i.expr not in keys:
                self.check_mixture(i.expr, keys)
        found: dict = {}
        aggs = []
        inputs = [slot(v) for v in scope.nodes] or list(scope.values)
        for e in ir.walk(tuple(i.expr for i in items)):
            if isinstance(e, Agg) and e not in found:
                if e.arg is not None and any(isinstance(x, Agg) for x in ir.walk(e.arg)):
                    raise PlanError("aggregates can't be nested")
                name = f"__agg{len(found)}"
                c, t = self.aggregate(e, on, inputs)
                aggs.append(c.alias(name))
                found[e] = (F.col(name), t)
        if key_columns:
            out = rows.groupBy(*key_columns).agg(*aggs)
        else:  # over no rows there is no group, except for a count of rows alone
            alone = len(items) == 1 and items[0].expr == Agg("count")
            out = rows.agg(*aggs, F.count(F.lit(1)).alias("__n"))
            out = (out if alone else out.where("__n > 0")).drop("__n")
        over = Expressions(self.graph, scope, flags, found, keys)
        computed = {}
        for k, i in enumerate(items):
            if not is_node[k]:
                computed[k] = over.of(i.expr)
        return out, computed

    def check_mixture(self, e, keys) -> None:
        """Outside its aggregates, an item may read what rows are grouped by and nothing else."""
        if isinstance(e, Agg) or e in keys:
            return
        if isinstance(e, (Var, Prop)):
            raise PlanError(f"{title(e)} stands beside an aggregate and isn't grouped by")
        if isinstance(e, tuple):
            for x in e:
                self.check_mixture(x, keys)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                self.check_mixture(getattr(e, f), keys)

    def aggregate(self, e: Agg, on: Expressions, inputs) -> tuple[Column, object]:
        if e.arg is None:
            return F.count(F.lit(1)), "int"
        c, t = on.of(e.arg)
        if t == "node" and e.name not in ("count", "collect"):
            raise PlanError(f"{e.name} can't take a node")
        if e.name == "count":
            return (F.countDistinct(c) if e.distinct else F.count(c)), "int"
        if e.name in ("sum", "avg"):
            if t not in (*NUMBERS, "null"):
                raise PlanError(f"{e.name} takes numbers")
            c = c.cast("bigint") if t == "null" else c
            if e.name == "avg":
                return F.try_divide(F.sum_distinct(c), F.countDistinct(c)) if e.distinct else F.avg(c), "float"
            return F.coalesce(F.sum_distinct(c) if e.distinct else F.sum(c), F.lit(0).cast("double" if t == "float" else "bigint")), t if t != "null" else "int"
        if e.name in ("min", "max"):
            return (F.min if e.name == "min" else F.max)(c), t
        kind = "int" if t == "node" else t
        # in the order of the rows; of equal values DISTINCT keeps the first
        pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*[F.col(f"`{i}`").alias(f"o{n}") for n, i in enumerate(inputs)], c.alias("x")))))
        values = F.transform(pairs, lambda p: p["x"])
        return F.array_distinct(values) if e.distinct else values, ("list", kind)

    # -- whole queries ---------------------------------------------------------------------------------------------
    def one(self, query: Query) -> DataFrame:
        reads = reads_of(query)
        if query.pattern is None:
            rows, scope = self.graph.spark.range(1).select(F.lit(1).alias("__one")), Scope({})
        else:
            bound = {n.var for n in query.pattern.nodes if n.var}
            rows = patterns.match(self.graph, query.pattern, reads)
            order = dict.fromkeys(n.var for n in query.pattern.nodes if n.var in bound)
            scope = Scope({v: reads.get(v, set()) | {"id"} for v in order})
        if query.where is not None:
            rows = self.filtered(rows, scope, query.where)
        for s in query.stages:
            if isinstance(s, With):
                rows, scope = self.project(rows, scope, s.output, final=False)
            else:
                rows, scope = self.unwound(rows, scope, s)
        return self.project(rows, scope, query.output, final=True)[0]

    def unwound(self, rows: DataFrame, scope: Scope, s: Unwind) -> tuple[DataFrame, Scope]:
        if s.var in scope.names():
            raise PlanError(f"{s.var} is bound already")
        c, t = Expressions(self.graph, scope).of(s.expr)
        if not is_list(t):
            c, t = F.when(c.isNotNull(), F.array(c)), ("list", t)
        rows = rows.withColumn(s.var, F.explode(c))
        return rows, Scope(scope.nodes, scope.values | {s.var: t[1]})

    def whole(self, query: Query) -> DataFrame:
        out = self.one(query)
        rest, dedup = query.union, False
        while rest is not None:  # left to right: a plain UNION dedups all that stands before it
            all_, q = rest
            arm = self.one(Query(q.pattern, q.where, q.stages, q.output))
            if len(arm.columns) != len(out.columns):
                raise PlanError("arms of a UNION have as many columns")
            out = out.union(arm.toDF(*out.columns))
            dedup = not all_
            out = out.distinct() if dedup else out
            rest = q.union
        return out


def run(graph, query, max_rows: int | None = None) -> DataFrame:
    """Rows of a query given as text, JSON form or Query. max_rows refuses larger results (parser.MAX_ROWS is the usual bound)."""
    if isinstance(query, str):
        query = parse(query)
    elif isinstance(query, dict):
        query = ir.from_json(query)
    if not isinstance(query, Query):
        raise PlanError("not a query")
    for e in ir.walk(query):
        if isinstance(e, ir.Pattern) and len(e.rels) > 8:
            raise CeilingError("a pattern has at most 8 relationships")
        if isinstance(e, ir.Rel) and e.hops and not 1 <= e.hops[0] <= e.hops[1] <= 10:
            raise CeilingError("hops run from 1 to 10")
    out = Compiler(graph).whole(query)
    if max_rows is not None and len(out.limit(max_rows + 1).take(max_rows + 1)) > max_rows:
        raise CeilingError(f"the result has more than {max_rows} rows")
    return out


def total_rows(graph, query) -> int:
    """How many rows a query has before its last SKIP and LIMIT."""
    q = parse(query) if isinstance(query, str) else query
    o = q.output
    return Compiler(graph).whole(Query(q.pattern, q.where, q.stages, Output(o.items, o.distinct), q.union)).count()
