"""The bundled tables as a graph: a fixed rule for nodes, edges and side tables, and the same rule in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import Graph
from ..plans.spread import spread
from . import stores

#: A node's id is the base of its kind and its key.
BASE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "document": 7, "page": 8}
TRILLION = 10**12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    return F.col(key).cast("bigint") + F.lit(BASE[kind] * TRILLION) if isinstance(key, str) else key.cast("bigint") + F.lit(BASE[kind] * TRILLION)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    text = lambda *parts: F.concat(*[F.lit(p) if p.endswith("/") or p.startswith("/") else F.col(p).cast("string") for p in parts])

    def row(df: DataFrame, kind: str, key: str, name, path: Column, signature, exported: Column) -> DataFrame:
        return df.select(node_id(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), signature.alias("signature"), exported.alias("exported"))

    home = t("nation").select(F.col("n_nationkey").alias("key"), "n_regionkey")  # few rows
    c = t("customer").join(home, F.col("c_nationkey") == F.col("key"))
    s = t("supplier").join(home, F.col("s_nationkey") == F.col("key"))
    parts = [
        row(t("region"), "region", "r_regionkey", F.col("r_name"), text("r/", "r_regionkey"), F.col("r_name"), F.lit(True)),
        row(t("nation"), "nation", "n_nationkey", F.col("n_name"), text("r/", "n_regionkey", "/n/", "n_nationkey"), F.col("n_name"), F.col("n_nationkey") % 2 == 0),
        row(c, "customer", "c_custkey", F.col("c_name"), text("r/", "n_regionkey", "/n/", "c_nationkey", "/c/", "c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal") >= 0),
        row(s, "supplier", "s_suppkey", F.col("s_name"), text("r/", "n_regionkey", "/n/", "s_nationkey", "/s/", "s_suppkey"), F.lit(None).cast("string"), F.col("s_acctbal") >= 0),
        row(t("part"), "part", "p_partkey", F.col("p_name"), text("p/", "p_brand", "/", "p_partkey"), F.col("p_type"), F.col("p_size") >= 25),
        row(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), text("o/", "o_orderstatus", "/", "o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F"),
        row(t("documents"), "document", "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), text("d/", "source", "/", "lang", "/", "doc_id"), F.col("lang"), F.col("lang") == "en"),
        row(t("pages"), "page", "page_id", F.col("url"), F.concat(F.lit("w/"), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), F.col("page_id").cast("string")), F.lit(None).cast("string"), F.lit(False)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on rel reach this union: branches of other relations fold away."""
    t = lambda n: table(spark, sf_dir, n)

    def row(df: DataFrame, src: Column, dst: Column, rel: str, confidence) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("int").alias("confidence"))

    li = spread(t("lineitem"), "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    grade = F.when(F.col("d") <= 0.02, 100).when(F.col("d") <= 0.05, 90).when(F.col("d") <= 0.07, 85).otherwise(40)
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    brand = t("part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    parts = [
        row(t("nation"), node_id("region", "n_regionkey"), node_id("nation", "n_nationkey"), "defines", 0),
        row(t("customer"), node_id("nation", "c_nationkey"), node_id("customer", "c_custkey"), "defines", 0),
        row(t("supplier"), node_id("nation", "s_nationkey"), node_id("supplier", "s_suppkey"), "defines", 0),
        row(t("orders"), node_id("order", "o_orderkey"), node_id("customer", "o_custkey"), "references", 100),
        row(li, node_id("order", "l_orderkey"), node_id("part", "l_partkey"), "calls", grade),
        row(spread(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct(), node_id("supplier", "l_suppkey"), node_id("part", "l_partkey"), "imports", 90),
        row(spread(t("orders"), "o_custkey").withColumn("after", after).where("after is not null"), node_id("order", "o_orderkey"), node_id("order", "after"), "data_flows", 85),
        row(t("part").join(brand, "p_brand").where("p_partkey <> first"), node_id("part", "p_partkey"), node_id("part", "first"), "of_type", 100),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; one in seven of them counts as damaged by a share that its key gives."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    bad = F.when(F.col("doc_id") % 7 == 0, F.octet_length("text") * (F.col("doc_id") % 20) / 100).otherwise(0).cast("bigint")
    return d.select(F.concat(F.lit("d/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text", "lang", F.octet_length("text").cast("bigint").alias("size"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("error_nodes"), bad.alias("error_bytes"), F.md5("text").alias("digest"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that references mention: parts of returned line items, by name, without a target."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 50").select("l_orderkey", "l_partkey").distinct()
    return li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(node_id("order", "l_orderkey").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-time calls: order to part by how many line items, and as many to the next part, which the graph mostly lacks."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    a = li.select(node_id("order", "l_orderkey").alias("src"), node_id("part", "l_partkey").alias("dst"))
    b = li.where("l_linenumber = 1").select(node_id("order", "l_orderkey").alias("src"), node_id("part", F.col("l_partkey") + 1).alias("dst"))
    return a.unionByName(b).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


#: Folders of stored graphs by the folder of their tables, as store() left them in this process.
STORED: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the graph of the tables once; graph() reads it from then on. Tables that change afterwards need another store()."""
    STORED.pop(sf_dir, None)
    stores.save(graph(spark, sf_dir), folder)
    STORED[sf_dir] = folder


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    if sf_dir in STORED:
        return stores.load(spark, STORED[sf_dir])
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), observed=observed(spark, sf_dir), files=files(spark, sf_dir))


# -- the same in SQL ------------------------------------------------------------------------------------------------
def _id(kind: str, key: str) -> str:
    return f"{key}::bigint + {BASE[kind]}000000000000"


SQL_NODES = f"""nodes as (
select {_id('region', 'r_regionkey')} as id, 'region' as kind, r_name as name, 'r/' || r_regionkey as path, r_name as signature, true as exported from region
union all select {_id('nation', 'n_nationkey')}, 'nation', n_name, 'r/' || n_regionkey || '/n/' || n_nationkey, n_name, n_nationkey % 2 = 0 from nation
union all select {_id('customer', 'c_custkey')}, 'customer', c_name, 'r/' || n_regionkey || '/n/' || c_nationkey || '/c/' || c_custkey, c_mktsegment, c_acctbal >= 0 from customer join nation on c_nationkey = n_nationkey
union all select {_id('supplier', 's_suppkey')}, 'supplier', s_name, 'r/' || n_regionkey || '/n/' || s_nationkey || '/s/' || s_suppkey, null, s_acctbal >= 0 from supplier join nation on s_nationkey = n_nationkey
union all select {_id('part', 'p_partkey')}, 'part', p_name, 'p/' || p_brand || '/' || p_partkey, p_type, p_size >= 25 from part
union all select {_id('order', 'o_orderkey')}, 'order', 'Order#' || o_orderkey, 'o/' || o_orderstatus || '/' || o_orderkey, o_orderpriority, o_orderstatus = 'F' from orders
union all select {_id('document', 'doc_id')}, 'document', 'doc' || doc_id, 'd/' || source || '/' || lang || '/' || doc_id, lang, lang = 'en' from documents
union all select {_id('page', 'page_id')}, 'page', url, 'w/' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id, null, false from pages)"""

SQL_EDGES = f"""edges as (
select {_id('region', 'n_regionkey')} as src, {_id('nation', 'n_nationkey')} as dst, 'defines' as rel, 0 as confidence from nation
union all select {_id('nation', 'c_nationkey')}, {_id('customer', 'c_custkey')}, 'defines', 0 from customer
union all select {_id('nation', 's_nationkey')}, {_id('supplier', 's_suppkey')}, 'defines', 0 from supplier
union all select {_id('order', 'o_orderkey')}, {_id('customer', 'o_custkey')}, 'references', 100 from orders
union all select {_id('order', 'l_orderkey')}, {_id('part', 'l_partkey')}, 'calls', case when max(l_discount) <= 0.02 then 100 when max(l_discount) <= 0.05 then 90 when max(l_discount) <= 0.07 then 85 else 40 end from lineitem group by l_orderkey, l_partkey
union all select distinct {_id('supplier', 'l_suppkey')}, {_id('part', 'l_partkey')}, 'imports', 90 from lineitem
union all select {_id('order', 'o_orderkey')}, {_id('order', 'after')}, 'data_flows', 85 from (select o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as after from orders) where after is not null
union all select {_id('part', 'p_partkey')}, {_id('part', 'f')}, 'of_type', 100 from part join (select p_brand as b, min(p_partkey) as f from part group by p_brand) on p_brand = b where p_partkey <> f)"""

SQL_FILES = """files as (select 'd/' || source || '/' || lang || '/' || doc_id as path, coalesce(text, '') as text, lang, octet_length(encode(coalesce(text, '')))::bigint as size, case when doc_id % 7 = 0 then 1 else 0 end as error_nodes,
case when doc_id % 7 = 0 then trunc(octet_length(encode(coalesce(text, ''))) * (doc_id % 20) / 100)::bigint else 0 end as error_bytes, md5(coalesce(text, '')) as digest from documents)"""

SQL_OBSERVED = f"""observed as (select src, dst, count(*) as cnt from (select {_id('order', 'l_orderkey')} as src, {_id('part', 'l_partkey')} as dst from lineitem where l_linenumber <= 2
union all select {_id('order', 'l_orderkey')}, {_id('part', 'l_partkey + 1')} from lineitem where l_linenumber = 1) group by src, dst)"""


def sql(body: str, *tables: str) -> str:
    """body with the named tables of the graph in front."""
    every = {"nodes": SQL_NODES, "edges": SQL_EDGES, "files": SQL_FILES, "observed": SQL_OBSERVED}
    recursive = "recursive " if "union select" in body and "with recursive" not in body and "walk" in body else ""
    head = ",\n".join(every[t] for t in tables)
    if not head:
        return body
    return f"with {recursive}{head}" + (f",\n{body[5:]}" if body.startswith("with ") else f"\n{body}")
