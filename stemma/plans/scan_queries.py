"""Running values over tables as one sequence each (WIN-02..07), and over keys however many rows they have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators.scan import dealt, interpolated, running
from stemma.plans.registry import Tables, query

ORDER = ["ts", "event_id"]
BACK = "ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"


def _events(t: Tables, **columns) -> DataFrame:
    return t.events.select("user_id", *ORDER, *[c.alias(n) for n, c in columns.items()])


@query(f"""SELECT event_id, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE coalesce(max(n) OVER ({BACK}), 0) END AS filled
FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id % 100 END AS n FROM events)""")
def long_running_max(t: Tables) -> DataFrame:
    """WIN-03 over all events in order of time."""
    e = dealt(_events(t, n=F.when(F.col("event_type") == "click", F.col("event_id") % 100)), [], ORDER)
    top = running(e, [], ORDER, {"top": ("max", F.col("n"))})
    return top.select("event_id", F.when(F.coalesce("n", F.lit(0)) > 0, F.col("n")).otherwise(F.coalesce("top", F.lit(0))).alias("filled"))


@query(f"""SELECT event_id, last_value(p IGNORE NULLS) OVER ({BACK}) AS before, first_value(p IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
count(p) OVER ({BACK}) AS n, sum(CASE WHEN p IS NOT NULL THEN event_id % 7 END) OVER ({BACK})::BIGINT AS total FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events)""")
def long_anchors(t: Tables) -> DataFrame:
    """WIN-04, WIN-07, WIN-10 over all events: the purchases before and after each event, how many there were, and a running sum."""
    e = dealt(_events(t, p=F.when(F.col("event_type") == "purchase", F.col("event_id"))), [], ORDER)
    p = F.col("p")
    values = {"before": ("last", p), "after": ("next", p), "n": ("count", p), "total": ("sum", F.when(p.isNotNull(), F.col("event_id") % 7))}
    return running(e, [], ORDER, values).select("event_id", *values)


@query(f"""SELECT event_id, sum(c) OVER ({BACK})::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events)""")
def long_run_ids(t: Tables) -> DataFrame:
    """WIN-06, WIN-08 over all events: the number of the run of equal types. An event's predecessor is a running value as well: the last
    place before it, which is found by the count."""
    e = running(dealt(_events(t, kind=F.col("event_type")), [], ORDER), [], ORDER, {"k": ("count", F.lit(1))})
    after = e.select((F.col("k") + 1).alias("k"), F.struct("kind").alias("before"))
    starts = e.join(after, "k", "left").select(*ORDER, F.when(F.col("before")["kind"].eqNullSafe(F.col("kind")) & F.col("before").isNotNull(), 0).otherwise(1).alias("c"))
    return running(dealt(starts, [], ORDER), [], ORDER, {"run": ("sum", F.col("c"))}).select("event_id", "run")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN l_orderkey * 2 END AS n, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
f AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN k END IGNORE NULLS) OVER w AS bk, last_value(n IGNORE NULLS) OVER w AS bn,
 first_value(CASE WHEN n IS NOT NULL THEN k END IGNORE NULLS) OVER v AS ak, first_value(n IGNORE NULLS) OVER v AS an
 FROM s WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING), v AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, (CASE WHEN n IS NOT NULL THEN n WHEN bk IS NULL AND ak IS NULL THEN k WHEN bk IS NULL THEN greatest(1, an - (ak - k)) WHEN ak IS NULL THEN bn + (k - bk) ELSE bn + trunc((an - bn) * (k - bk) / (ak - bk)) END)::INT AS line_number FROM f""")
def long_interpolation(t: Tables) -> DataFrame:
    """WIN-05, SCL-20 over all line items in order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    l = t.lineitem.select(*order, F.when(F.col("l_partkey") % 9 == 0, F.col("l_orderkey") * 2).alias("n"))
    return interpolated(l, "n", [], order).select("l_orderkey", "l_linenumber", "line_number")


@query("""SELECT event_id, row_number() OVER w AS n_in_type, max(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def hot_key_counter(t: Tables) -> DataFrame:
    """WIN-02, WIN-03, WIN-11 by a key of which a few values hold all rows."""
    keys = ["event_type"]
    e = dealt(t.events.select(*keys, *ORDER), keys, ORDER)
    return running(e, keys, ORDER, {"n_in_type": ("count", F.lit(1)), "top": ("max", F.col("event_id"))}).select("event_id", "n_in_type", "top")
