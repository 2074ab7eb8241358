"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0). A document is good or has one of a few faults, which nobody sees; each
of these classes has a share of the documents and, for each rule, rates of its three votes. Expectation-maximisation over the counts of vote
patterns estimates shares and rates with no labels, and a document's posterior probability of being good replaces the demand that it pass every
rule. A fault is told from a habit of good documents by agreement: rules that see the same fault vote bad together. A bad vote that its
fellows don't share may so be overruled, and a document without any bad vote may fall by abstentions that are usual for a fault.

Defined cases: a null or empty text has no words, fails the base rule and isn't kept; a text of any length is read whole;
repeated rows are judged alike; a null key is kept as it is; further columns are ignored, whatever their names; an empty table gives an
empty result. Vote patterns are at most 3 ** rules rows, whatever the input.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, let, semi, unused, words

#: name: (good if, bad if), over the columns of measures(); neither: the rule abstains.
RULES = {
    "symbols": ("20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "letters": ("100 * n_other <= 8 * word_chars", "100 * n_other > 15 * word_chars"),
    "capitals": ("5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "exclaims": ("20 * n_exclaims <= n_words", "5 * n_exclaims > n_words"),
    "lines": ("20 * n_dup_lines <= n_lines", "4 * n_dup_lines > n_lines"),
    "windows": ("20 * n_repeat_words <= n_words", "100 * n_repeat_words > 18 * n_words"),
    "variety": ("10 * n_distinct >= 3 * least(n_words, 500)", "10 * n_distinct < 2 * least(n_words, 500)"),
    "word_length": ("word_chars >= 3 * n_words and word_chars <= 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
}
#: Faults, with the rules that see them. The estimation starts from a share GOOD of good documents and equal shares of faults, and from these rates of
#: votes (good, bad, none): SEES for a rule of the fault, CALM for any other. The start stays as ANCHOR times the documents, which keeps rates above zero and weighs little.
FAULTS = {"junk": ("symbols", "letters"), "shouting": ("capitals", "exclaims", "letters"), "repetition": ("lines", "windows", "variety")}
GOOD, SEES, CALM = 0.9, (0.2, 0.7, 0.1), (0.95, 0.01, 0.04)
ROUNDS, ANCHOR = 20, 0.05
VOTES = (1, -1, 0)
CLASSES = ("good", *FAULTS)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims", "n_other", "n_distinct")


def repeated_words(w: Column, size: int = 5) -> Column:
    """How many of the words stand in a window of so many words that the text holds at least twice.

    Window hashes are compared by sorting them; only a text in which some occur twice pays for their places.
    """

    def places(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        twice = let(order, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda p: p.isNotNull()))
        covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x)
        return let(F.array_sort(twice), covered)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h)))
    return F.when(F.size(w) > size, found).otherwise(F.lit(0)).cast("long")


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and MEASURES of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    capitals = "".join(chr(c) for c in range(65, 91))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    both = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).cast("long").alias("d")))
    folded = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    upper = F.length(text) - without(F.translate(text, "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÁÍÓÚÑ", "A" * 20), capitals)
    base = docs.select(F.col(id_col), F.col(text_col)).select(F.col(id_col), both.alias("w"), folded.alias("l"), without(text, SPACE_CHARS).cast("long").alias("word_chars"), (F.length(text) - without(text, "#*$%&|<>")).cast("long").alias("n_symbols"), upper.cast("long").alias("n_upper"), (F.length(text) - without(text, "!")).cast("long").alias("n_exclaims"), (F.length(text) - without(text, string.digits + string.punctuation)).cast("long").alias("n_other"))
    return base.select(id_col, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_upper", "n_exclaims", "n_other", F.col("w.d").alias("n_distinct"))


def vote(rule: str) -> str:
    good, bad = RULES[rule]
    return f"case when {good} then 1 when {bad} then -1 else 0 end"


def start() -> dict:
    """share[class] and rate[rule, vote, class]."""
    share = {c: GOOD if c == "good" else (1 - GOOD) / len(FAULTS) for c in CLASSES}
    return {"share": share, "rate": {(r, v, c): (SEES if r in FAULTS.get(c, ()) else CALM)[k] for r in RULES for k, v in enumerate(VOTES) for c in CLASSES}}


def log_of(params: dict, c: str) -> str:
    """SQL of the log of a class' share times its probability of a row's votes v_<rule>."""
    terms = [f"{math.log(params['share'][c])!r}D"] + ["case v_{0} when 1 then {1!r}D when -1 then {2!r}D else {3!r}D end".format(r, *[math.log(params["rate"][r, v, c]) for v in VOTES]) for r in RULES]
    return " + ".join(f"({t})" for t in terms)


def belongs(c: str) -> str:
    """SQL of the posterior probability of a class, of a row with the logs l_<class>."""
    return "1 / (" + " + ".join(f"exp(l_{k} - l_{c})" for k in CLASSES) + ")"


def estimate(patterns: DataFrame, rounds: int = ROUNDS, anchor: float = ANCHOR) -> dict:
    """Expectation-maximisation over patterns (v_<rule>..., n); each round is one aggregation to a row for each rule and vote.

    A round first weighs each pattern by its posteriors, then sets shares and rates to the weighted shares of documents and votes.
    """
    first = params = start()
    for _ in range(rounds):
        seen = patterns.withColumns({f"l_{c}": F.expr(log_of(params, c)) for c in CLASSES})
        cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v_{r}").alias("vote")) for r in RULES])).alias("x")
        sums = seen.select("n", *[F.expr(f"n * ({belongs(c)})").alias(c) for c in CLASSES], cells).groupBy("x.rule", "x.vote").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in CLASSES]).collect()
        if not sums:
            break
        by = {(s["rule"], s["vote"], c): s[c] for s in sums for c in CLASSES}
        one = [s for s in sums if s["rule"] == next(iter(RULES))]
        n, size = sum(s["n"] for s in one), {c: sum(s[c] for s in one) for c in CLASSES}
        more = {c: anchor * n * first["share"][c] for c in CLASSES}
        params = {"share": {c: (size[c] + more[c]) / (n + anchor * n) for c in CLASSES}, "rate": {(r, v, c): (by.get((r, v, c), 0.0) + more[c] * first["rate"][r, v, c]) / (size[c] + more[c]) for r, v, c in first["rate"]}}
    return params


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Measures, votes, base_failed, the posterior quality and kept of every document."""
    votes = [f"v_{r}" for r in RULES]
    seen = cut(measures(docs, id_col, text_col).withColumns({f"v_{r}": F.expr(vote(r)) for r in RULES}))
    patterns = cut(seen.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")))
    params = estimate(patterns, rounds)
    logs = [F.expr(log_of(params, c)).alias(f"l_{c}") for c in CLASSES]
    judged = patterns.select(*votes, *logs).select(*votes, F.expr(belongs("good")).alias("quality"))  # a row a pattern
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return seen.withColumn("base_failed", failed).join(F.broadcast(judged), votes).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns and however often they are repeated.

    Rows are told apart by a hash of id and text, so null or repeated ids do no harm; texts are shuffled only if very many rows go.
    """
    made = unused(docs)
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    gone = judge(docs.select(mark.alias(made), F.col(text_col)), made, text_col, least).where("not kept").select(made).distinct()
    return semi(docs.withColumn(made, mark), cut(gone), made, "left_anti").select(*docs.columns)


# -- the same in SQL ------------------------------------------------------------------------------------------------
def sql(source: str = "documents", keep: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept") -> str:
    """DuckDB SQL of judge(): measures by unnesting, and one CTE for each round of the estimation."""
    ws = "[ \\t\\n\\x0b\\f\\r]"
    ctes = [
        f"src as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from {source})",
        f"toks as (select rid, list_filter(regexp_split_to_array(t, '{ws}+'), lambda x: x <> '') as w from src)",
        "wins as (select rid, i, list_slice(w, i, i + 4) as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from toks))",
        "twice as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from wins) where c > 1)",
        "covered as (select rid, count(distinct i + k) as r from twice, (select unnest(range(0, 5)) as k) group by rid)",
        f"lines as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as l from src)",
        f"""seen as (select doc_id, len(w) as n_words, length(regexp_replace(t, '{ws}', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r, 0) as n_repeat_words, len(l) as n_lines,
            length(regexp_replace(t, '[^A-ZÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÁÍÓÚÑ]', '', 'g')) as n_upper, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaims,
            length(regexp_replace(t, '[^0-9!-/:-@\\[-`{{-~]', '', 'g')) as n_other, len(list_distinct(w)) as n_distinct
            from src join toks using (rid) join lines using (rid) left join covered using (rid))""",
        "voted as (select *, " + ", ".join(f"{vote(r)} as v_{r}" for r in RULES) + " from seen)",
        "patterns as materialized (select " + ", ".join(f"v_{r}" for r in RULES) + ", count(*) as n from voted group by all)",
    ]
    name, first = {1: "y", -1: "n", 0: "o"}, start()
    col = lambda r, v, c: f"{r}_{name[v]}_{c}"
    each = list(first["rate"])
    ctes.append("par0 as materialized (select " + ", ".join([f"{first['share'][c]!r}::double as share_{c}" for c in CLASSES] + [f"{first['rate'][x]!r}::double as {col(*x)}" for x in each]) + ")")
    logs = ", ".join(f"ln(share_{c}) + " + " + ".join(f"case v_{r} when 1 then ln({col(r, 1, c)}) when -1 then ln({col(r, -1, c)}) else ln({col(r, 0, c)}) end" for r in RULES) + f" as l_{c}" for c in CLASSES)
    for k in range(1, ROUNDS + 1):
        ctes.append(f"log{k} as materialized (select patterns.*, {logs} from patterns, par{k - 1})")
        ctes.append(f"sum{k} as materialized (select sum(n) as n, " + ", ".join([f"sum(n * w_{c}) as size_{c}" for c in CLASSES] + [f"sum(case when v_{r} = {v} then n * w_{c} else 0 end) as {col(r, v, c)}" for r, v, c in each]) + " from (select *, " + ", ".join(f"{belongs(c)} as w_{c}" for c in CLASSES) + f" from log{k}))")
        more = {c: f"{ANCHOR} * n * {first['share'][c]!r}" for c in CLASSES}
        ctes.append(f"par{k} as materialized (select " + ", ".join([f"(size_{c} + {more[c]}) / (n + {ANCHOR} * n) as share_{c}" for c in CLASSES] + [f"({col(*x)} + {more[x[2]]} * {first['rate'][x]!r}) / (size_{x[2]} + {more[x[2]]}) as {col(*x)}" for x in each]) + f" from sum{k})")
    ctes.append(f"judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {belongs('good')} as quality from (select voted.*, {logs} from voted, par{ROUNDS}))")
    return "with " + ",\n".join(ctes) + f"\nselect {keep} from (select *, not base_failed and quality >= 0.5 as kept from judged)"
