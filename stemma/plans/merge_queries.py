"""Changes of versioned tables made of the given ones (SNK-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.registry import Tables, query
from stemma.session import scratch
from stemma.sources.versioned import VersionedTable

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(t: Tables) -> VersionedTable:
    """Two thirds of the orders, by ranges of their key."""
    out = VersionedTable(t.spark, scratch(t.spark, "orders"), ["o_orderkey"])
    out.create(t.orders.select(*ORDERS).where("o_orderkey % 3 <> 0"))
    return out


BASE = f"SELECT {', '.join(ORDERS)} FROM orders WHERE o_orderkey % 3 <> 0"


@query(f"""SELECT o_orderkey, o_custkey, 'R' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT * FROM ({BASE}) WHERE o_orderkey % 5 <> 0""")
def merge_replace(t: Tables) -> DataFrame:
    """SNK-03: a fifth of the orders is replaced or added; each is given twice, and the dearer one counts."""
    orders = _orders(t)
    new = t.orders.where("o_orderkey % 5 = 0").select("o_orderkey", "o_custkey", F.lit("R").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    orders.replace(new.unionByName(new.withColumn("o_totalprice", F.col("o_totalprice") - 2)), F.col("o_totalprice"))
    return orders.read()


@query(f"""{BASE} UNION ALL SELECT o_orderkey, o_custkey, 'I', o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def merge_ignore(t: Tables) -> DataFrame:
    """SNK-02: orders of even keys are added if they are not there."""
    orders = _orders(t)
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", F.lit("I").alias("o_orderstatus"), "o_totalprice")
    orders.ignore(new, F.col("o_totalprice"))
    return orders.read()


@query("""SELECT c_custkey, CASE WHEN n > 12 THEN 'many' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN n > 0 THEN n ELSE 0 END AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def merge_update(t: Tables) -> DataFrame:
    """SNK-05: customers get the number of their orders; those of many another segment, others keep theirs."""
    customers = VersionedTable(t.spark, scratch(t.spark, "customers"), ["c_custkey"])
    customers.create(t.customer.select("c_custkey", "c_mktsegment", F.lit(0).cast("long").alias("orders")))
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    customers.update(n.select("c_custkey", F.when(F.col("orders") > 12, "many").alias("c_mktsegment"), "orders"))
    return customers.read()


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 FROM lineitem WHERE l_orderkey % 4 = 0""")
def merge_swap(t: Tables) -> DataFrame:
    """SNK-01, SNK-04: items of some orders are imported anew, twice over, and the table has them once; others were appended to it."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    items = VersionedTable(t.spark, scratch(t.spark, "items"), ["l_orderkey", "l_linenumber"])
    items.create(t.lineitem.select(*columns).where("l_orderkey % 2 = 0"))
    items.append(t.lineitem.select(*columns).where("l_orderkey % 2 <> 0"))
    new = t.lineitem.where("l_orderkey % 4 = 0").select(*columns[:3], (F.col("l_quantity") * 2).alias("l_quantity"))
    for _ in range(2):
        items.swap(new.select("l_orderkey").distinct(), ["l_orderkey"], new)
    return items.read()


@query("""SELECT v AS version, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT 1 AS v, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0 UNION ALL SELECT 3, o_orderkey FROM orders) GROUP BY 1""")
def merge_versions(t: Tables) -> DataFrame:
    """SNK-01..04: every version stays readable while later ones are written."""
    orders, new = _orders(t), t.orders.select(*ORDERS)
    orders.replace(new.where("o_orderkey % 5 = 0"), F.col("o_totalprice"))
    orders.ignore(new, F.col("o_totalprice"))
    out = None
    for v in (1, 2, 3):
        one = orders.read(v).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(v).alias("version"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out
