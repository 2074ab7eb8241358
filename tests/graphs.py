"""A small graph of a bakery's code."""

from tessera.catalog import Graph

NODES = [(20, "function", "bake", "app/oven.py", "def bake(t)", True, "h0"), (21, "function", "knead", "app/dough.py", "def knead()", False, "h1"), (22, "function", "weigh", "app/dough.py", None, True, "h2"), (23, "function", "order", "app/shop.py", "def order()", True, "h3"), (24, "method", "deliver", "app/shop.py", "def deliver(self)", False, "h4"), (25, "class", "Oven", "app/oven.py", "", True, "h5"), (26, "function", "wash", "lib/sink.py", "def wash()", False, "h6")]
EDGES = [(23, 20, "calls", 90), (23, 22, "calls", 60), (20, 21, "calls", 100), (21, 22, "calls", 100), (24, 22, "calls", 85), (22, 26, "calls", 95), (20, 25, "data_flows", 100)]


def golden(spark):
    nodes = spark.createDataFrame(NODES, "id bigint, kind string, name string, path string, signature string, exported boolean, content_hash string")
    return Graph(nodes, spark.createDataFrame(EDGES, "src bigint, dst bigint, rel string, confidence int"))
