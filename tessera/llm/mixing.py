"""Mixing sources to target weights under a time-varying curriculum, with DataFrame functions only.

Every source has a weight and a schedule: its share of the weight at training time t in [0, 1] is w * (1 + a * (2t - 1)), which
integrates to w; the shares of all sources need not sum to 1 at every t, so equal steps of t may hold unequal numbers of words. The corpus' words are shared out by weight; a source stops at ``most`` times its words and what is
over is shared out again. A source's documents stand in the order of the MD5 of id and text; whole rounds are taken
while they fit and a last part round stops at the document boundary nearest to the target. The running count of words that a source has given,
as a share of its demand, inverted through the integrated schedule, is a copy's training position; documents are
range-sorted by their first.

The running count is a two-level sum: per source and one of 4096 ranges of the hash, then inside each range. No window holds a whole source.

Defined cases: a null text has size 0 and is never taken; the null source counts as a source, sorted last; a null id
counts as no id, so its text alone decides the order; repeated rows are separate documents, whose rows stand in one range; columns of the input keep their values
whatever their names (the operator's own come as one struct); an empty table gives an empty result. A corpus
without words has targets of 0. Sources are assumed to be few enough for one sort (a row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

WEIGHTS, SLOPES, MOST = (5, 2, 1), (0.5, 0.0, -0.5), 3
#: Hexadecimal digits of the MD5 that name a range.
DIGITS = 3


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, most: int = MOST) -> DataFrame:
    """From (source, s): also rank, weight, slope and target.

    With sources in the order of the level at which they reach their bound, the level at which all words are given out is the greatest that
    any prefix of bounded sources leaves to the rest.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", cycle(weights, F.col("rank"))).withColumn("slope", cycle(slopes, F.col("rank")))
    by_bound = Window.orderBy((F.lit(most) * F.col("s")).cast("double") / F.col("weight"), "rank")
    left = F.sum("s").over(every) - F.coalesce(F.sum(F.lit(most) * F.col("s")).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", left.cast("double") / rest)
    return level.withColumn("target", F.least(F.max("level").over(every) * F.col("weight"), (F.lit(most) * F.col("s")).cast("double"))).drop("level")


def when(u: Column, a: Column) -> Column:
    """The t at which the integral of 1 + a * (2t - 1) is u."""
    return F.when(a == 0, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, light: bool = False, ordered: bool = True, **how) -> DataFrame:
    """(doc struct of the columns ``keep``, mix struct of size, source_size, target, copies, taken, position, positions), sorted by position.

    ordered: otherwise the rows come in any order.
    light: rows without their texts are few bytes, so they are written once instead of being computed twice.
    """
    # the row before the new names, so that columns of the input may be called anything
    row = F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("doc")
    order = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.col(text_col))))
    rows = docs.select(row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), order.alias("order"), F.size(words(F.col(text_col))).cast("long").alias("size")).withColumn("part", F.substring("order", 1, DIGITS)).withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    if light:
        rows = cut(rows)
    parts = cut(rows.groupBy("source_key", "source", "part").agg(F.sum("size").alias("n")))
    goals = targets(parts.groupBy("source_key", "source").agg(F.sum("n").alias("s")), **how).drop("source")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = cut(parts.select("source_key", "part", before.alias("before")).join(goals, "source_key"))
    inside = Window.partitionBy("source_key", "part").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("long")
    placed = rows.drop("source").join(plan, ["source_key", "part"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("full", full)
    more = (F.col("size") > 0) & ((2 * F.col("at") + F.col("size")).cast("double") <= 2 * (F.col("target") - (F.col("full") * F.col("s")).cast("double")))
    counted = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + more.cast("long")).otherwise(0))
    share = lambda c: F.least(F.lit(1.0), (c * F.col("s") + F.col("at")).cast("double") / F.col("target"))
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: when(share(c), F.col("slope"))))
    out = counted.withColumn("positions", times)
    out = out.select("doc", F.struct("size", F.col("s").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.get("positions", F.lit(0)).alias("position"), "positions").alias("mix"), "order")
    return (out.orderBy(F.col("mix.position").asc_nulls_last(), "order") if ordered else out).drop("order")


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The training sequence: every copy that the mix takes, with all columns of docs, range-sorted by position."""
    copies = mix(docs, ordered=False, **how).where("mix.copies > 0").select("doc", F.explode("mix.positions").alias("at"))
    names = [f for f in copies.schema["doc"].dataType.names]
    return copies.repartitionByRange("at", F.col("doc").getField(how.get("id_col", "doc_id"))).sortWithinPartitions("at").select(*[F.col("doc").getField(c).alias(c) for c in names])


def sql(source: str = "documents") -> str:
    """DuckDB SQL of mix(): (doc_id, size, source_size, target, copies, taken, position)."""
    case = lambda v: f"case (rank % {len(v)}) " + " ".join(f"when {i} then {x}" for i, x in enumerate(v)) + " end"
    return f"""with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) as size, md5(concat_ws('|', cast(doc_id as varchar), md5(text))) as k from {source}),
s1 as (select source, cast(sum(size) as bigint) as s, row_number() over (order by source nulls last) - 1 as rank from d group by source),
s2 as (select *, {case(WEIGHTS)} as weight, cast({case(SLOPES)} as double) as slope from s1),
s3 as (select *, cast(sum(s) over () - coalesce(sum({MOST} * s) over (order by cast({MOST} * s as double) / weight, rank rows between unbounded preceding and 1 preceding), 0) as double)
  / sum(weight) over (order by cast({MOST} * s as double) / weight, rank rows between current row and unbounded following) as level from s2),
s4 as (select *, least((select max(level) from s3) * weight, cast({MOST} * s as double)) as target from s3),
p as (select doc_id, size, s, target, slope, case when s > 0 then cast(floor(target / s) as bigint) else 0 end as full_rounds,
  cast(coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as ahead from d join s4 on d.source is not distinct from s4.source),
c as (select *, case when size > 0 then full_rounds + case when cast(2 * ahead + size as double) <= 2 * (target - cast(full_rounds * s as double)) then 1 else 0 end else 0 end as copies from p),
u as (select *, case when copies > 0 then least(1.0, cast(ahead as double) / target) end as u from c)
select doc_id, size, s as source_size, target, copies, copies * size as taken,
  round(case when slope = 0 then u else (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) end, 9) as position from u"""
