"""Relational operators on the driver's tables: filters, joins, aggregates, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.operators.citations import band_join, nearest
from stemma.operators.fts import page, relevance_tier
from stemma.operators.views import first_per_group, stats_row, table_counts
from stemma.plans.registry import Tables, query
from stemma.session import checkpointed
from stemma.sources.markup import fill_running_max, interpolate_numbers, run_ids, scene_counter

#: Rows that a partition makes where a join gives many for one.
OUT = 2_000_000

# ---- filters and projections


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    """FLT-01."""
    return t.customer.where("c_custkey = 42").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 7, 15) AND p_brand LIKE 'brand#1%' OR p_size IN (49) ", "in_list")
def in_list(t: Tables) -> DataFrame:
    """FLT-02."""
    return t.part.where((F.col("p_size").isin(1, 7, 15) & F.startswith("p_brand", F.lit("brand#1"))) | F.col("p_size").isin(49)).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def in_subquery(t: Tables) -> DataFrame:
    """FLT-03."""
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND (0 = 0 OR l_linenumber = 0)")
def between_band(t: Tables) -> DataFrame:
    """FLT-06 and FLT-07: a band, and a predicate that a parameter of 0 switches off."""
    line = F.lit(0)
    return t.lineitem.where(F.col("l_quantity").between(10, 12) & ((line == 0) | (F.col("l_linenumber") == line))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'e%' OR p_name ILIKE '%GEAR'")
def ilike_prefix(t: Tables) -> DataFrame:
    """FLT-08."""
    return t.part.where(F.col("p_type").ilike("e%") | F.col("p_name").ilike("%GEAR")).select("p_partkey", "p_type")


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'click' OR event_type IS NULL")
def not_equal_or_null(t: Tables) -> DataFrame:
    """FLT-10."""
    return t.events.where(~F.col("event_type").eqNullSafe("click")).select("event_id", "user_id")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' ELSE 'untagged' END AS tag
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coalesce_case(t: Tables) -> DataFrame:
    """FLT-12 and FLT-13."""
    tag = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("untagged")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), tag.alias("tag"))


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '00') OR contains(lower(s_name), '7') OR contains(CAST(s_nationkey AS VARCHAR), '3')")
def client_filter(t: Tables) -> DataFrame:
    """FLT-14: a substring in any of several columns."""
    has = lambda c, q: F.contains(F.lower(F.col(c).cast("string")), F.lit(q))
    return t.supplier.where(has("s_name", "00") | has("s_name", "7") | has("s_nationkey", "3")).select("s_suppkey")


@query("SELECT o_orderstatus AS state, count(*)::BIGINT AS n, count(*) FILTER (o_totalprice > 100000)::BIGINT AS large FROM orders GROUP BY 1")
def state_counts(t: Tables) -> DataFrame:
    """FLT-15."""
    return t.orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT doc_id, source FROM documents WHERE list_contains(string_split('src1,src5,src7', ','), source)")
def source_toggle(t: Tables) -> DataFrame:
    """FLT-16."""
    return t.documents.where(F.array_contains(F.split(F.lit("src1,src5,src7"), ","), F.col("source"))).select("doc_id", "source")


@query("SELECT DISTINCT lang, source FROM documents")
def distinct_projection(t: Tables) -> DataFrame:
    """FLT-17."""
    return t.documents.select("lang", "source").distinct()


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (l.toxic <> 1 OR l.toxic IS NULL) AND d.source NOT IN ('src3')")
def license_filter(t: Tables) -> DataFrame:
    """FLT-18: restricted rows go, untagged ones stay, and a source is left out."""
    restricted = t.labels.where("toxic = 1").select("doc_id")
    return t.documents.where("source <> 'src3'").join(restricted, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'middle' END AS kind FROM part WHERE p_size <= 30")
def route_types(t: Tables) -> DataFrame:
    """FLT-19."""
    kind = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "middle")
    return t.part.select("p_partkey", kind.alias("kind")).where("kind IS NOT NULL")


# ---- joins


@query("SELECT r_name, n_name, c_custkey, o_orderkey, l_linenumber, p_brand, s_name, l_quantity FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE r_name = 'ASIA' AND p_size < 5")
def join_chain(t: Tables) -> DataFrame:
    """JN-01 and JN-02: seven tables; the two smallest are fixed in size."""
    asia = F.broadcast(t.nation.join(F.broadcast(t.region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")))
    buyers = t.customer.join(asia, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t.lineitem.join(t.part.where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).select("r_name", "n_name", "c_custkey", "o_orderkey", "l_linenumber", "p_brand", "s_name", "l_quantity")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON o_custkey = c_custkey")
def left_join(t: Tables) -> DataFrame:
    """JN-03."""
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


@query("""SELECT o_orderkey, l_partkey, l_quantity FROM (SELECT o.o_orderkey, l.l_partkey, l.l_quantity, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY CASE WHEN l_suppkey = 3 THEN 0 ELSE 1 END, l_quantity DESC, l_partkey, l_suppkey, l_linenumber) AS rn
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey) WHERE rn = 1""")
def best_match_per_key(t: Tables) -> DataFrame:
    """JN-04: a left join to the best row of each key: the preferred supplier, then quantity; the pick is an aggregate before the join."""
    prefer = F.when(F.col("l_suppkey") == 3, 0).otherwise(1)
    best = t.lineitem.groupBy("l_orderkey").agg(F.min_by(F.struct("l_partkey", "l_quantity"), F.struct(prefer, -F.col("l_quantity"), "l_partkey", "l_suppkey", "l_linenumber")).alias("b"))
    return t.orders.select("o_orderkey").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "b.l_partkey", "b.l_quantity")


@query("SELECT s_suppkey, coalesce((SELECT n_name FROM nation WHERE n_nationkey = s_nationkey), '?') AS nation FROM supplier")
def scalar_subquery(t: Tables) -> DataFrame:
    """JN-05."""
    return t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("?")).alias("nation"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_editions(t: Tables) -> DataFrame:
    """JN-06, FLT-05."""
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_unmatched(t: Tables) -> DataFrame:
    """JN-07, FLT-04."""
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def not_exists_pair(t: Tables) -> DataFrame:
    """FLT-05."""
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT a.l_suppkey AS a_id, b.l_suppkey AS b_id FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey", "pairs_with_shared_key")
def pairs_with_shared_key(t: Tables) -> DataFrame:
    """JN-08, SET-03: pairs of suppliers that share a part. A part's suppliers are a sorted set, and each goes on with the rest of it as one row:
    a pair is made where all rows of its smaller supplier are, and is not shuffled."""
    held = t.lineitem.where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    sets = checkpointed(held.where(F.size("s") > 1).select("s"))
    made = sets.agg(F.sum(F.size("s").cast("long") * (F.size("s") - 1) / 2)).first()[0] or 0
    each = sets.select("s", F.posexplode("s").alias("i", "a_id")).where(F.col("i") < F.size("s") - 1)
    rest = each.select("a_id", F.slice("s", F.col("i") + 2, F.size("s")).alias("rest"))
    return rest.repartition(1 + int(made // OUT), "a_id").select("a_id", F.explode("rest").alias("b_id")).distinct()


@query("""WITH l AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT coalesce(a.pair, b.pair)::BIGINT AS pair, coalesce(a.k, b.k)::INT AS k, a.line AS a_line, b.line AS b_line FROM (SELECT * FROM l WHERE side = 0) a FULL JOIN (SELECT * FROM l WHERE side = 1) b ON a.pair = b.pair AND a.k = b.k""")
def scene_full_outer(t: Tables) -> DataFrame:
    """JN-09, ALN-06: the lines of each two documents with neighbouring ids side by side by position."""
    lines = t.documents.select((F.col("doc_id") / 2).cast("long").alias("pair"), (F.col("doc_id") % 2).alias("side"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    side = lambda n, name: lines.where(F.col("side") == n).select("pair", (F.col("p") + 1).alias("k"), F.col("line").alias(name))
    return side(0, "a_line").join(side(1, "b_line"), ["pair", "k"], "full").select("pair", "k", "a_line", "b_line")


@query("""SELECT p_partkey, s_suppkey FROM (SELECT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) AS rn FROM part JOIN supplier
ON p_size = s_nationkey AND starts_with(lower(s_name), lower(substr(p_name, 1, 1)))) WHERE rn = 1""")
def prefix_theta_join(t: Tables) -> DataFrame:
    """JN-10, FLT-09: an equi-key with a prefix test, the first row of each key. A prefix is the lower case of one character at most, so it
    is a key as well: the first supplier of each nation and prefix is found before the join. Of one character lower() may make two."""
    name = F.lower("s_name")
    begun = t.supplier.where("s_nationkey IS NOT NULL").select("s_nationkey", "s_suppkey", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.substring(name, F.lit(1), n)))).alias("prefix"))
    first = begun.where("prefix IS NOT NULL").groupBy("s_nationkey", "prefix").agg(F.min("s_suppkey").alias("s_suppkey"))
    asked = t.part.select("p_partkey", "p_size", F.lower(F.substring("p_name", 1, 1)).alias("prefix"))
    j = asked.join(first, (asked["p_size"] == first["s_nationkey"]) & (asked["prefix"] == first["prefix"]))
    return j.groupBy("p_partkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("""SELECT e.event_id, o.o_orderkey FROM (SELECT * FROM events WHERE event_type = 'purchase') e JOIN orders o ON abs(e.event_id - o.o_orderkey) <= 10""")
def band_join_10(t: Tables) -> DataFrame:
    """JN-11: a band of ten on each side, met in buckets."""
    e = t.events.where("event_type = 'purchase'").select("event_id")
    return band_join(e, t.orders.select("o_orderkey"), "event_id", "o_orderkey", 10).select("event_id", "o_orderkey")


@query("""SELECT event_id, o_orderkey FROM (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.k - o.o_orderkey), o.o_orderkey) AS rn
FROM (SELECT event_id, event_id * 7 % 3001 AS k FROM events) e JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey BETWEEN e.k - 10 AND e.k + 10) WHERE rn = 1""")
def nearest_line_10(t: Tables) -> DataFrame:
    """JN-12, JN-13, SRT-04: the nearest key within ten, the smaller one on ties."""
    e = t.events.select("event_id", (F.col("event_id") * 7 % 3001).alias("k")).withColumn("g", F.lit(1))
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey").withColumn("g", F.lit(1))
    return nearest(e, o, "k", "o_orderkey", 10, ["g"], "event_id", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("""SELECT e.event_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts >= e.ts) AS next_ts FROM events e WHERE e.event_type = 'click'""")
def next_line(t: Tables) -> DataFrame:
    """JN-14: the next purchase of the user at or after each click: a running minimum from the end, without a join."""
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.currentRow, W.unboundedFollowing)
    return t.events.withColumn("next_ts", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)).where("event_type = 'click'").select("event_id", "next_ts")


@query("""SELECT s.o_custkey, o.o_orderkey FROM (SELECT o_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) s
JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O') o ON o.o_custkey = s.o_custkey AND o.o_orderkey BETWEEN s.lo AND s.hi""")
def range_contains(t: Tables) -> DataFrame:
    """JN-15, AGG-08: open orders between the first and the last filled one of their customer."""
    s = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(s, "o_custkey").where("o_orderkey BETWEEN lo AND hi").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", "hash_lookups")
def hash_lookups(t: Tables) -> DataFrame:
    """JN-16: lookups in dimensions of fixed size."""
    dim = F.broadcast(t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")))
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(dim, F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "n_name", "r_name")


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT g, a AS from_id, b AS to_id FROM m UNION ALL SELECT g, b, a FROM m""")
def symmetric_mapping(t: Tables) -> DataFrame:
    """JN-17."""
    m = t.lineitem.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return m.select("g", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("g", F.col("p.x").alias("from_id"), F.col("p.y").alias("to_id"))


@query("SELECT a.c_custkey, b.n_nationkey FROM customer a JOIN nation b ON upper(a.c_name) = upper('cUSTOMER#' || lpad(b.n_nationkey::VARCHAR, 9, '0'))")
def case_insensitive_join(t: Tables) -> DataFrame:
    """JN-19."""
    named = t.nation.select("n_nationkey", F.concat(F.lit("cUSTOMER#"), F.lpad(F.col("n_nationkey").cast("string"), 9, "0")).alias("name"))
    return t.customer.join(F.broadcast(named), F.upper("c_name") == F.upper("name")).select("c_custkey", "n_nationkey")


@query("""SELECT a.p_partkey AS id, b.p_partkey AS alias_id FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_size = b.p_size""")
def alias_expansion(t: Tables) -> DataFrame:
    """JN-20: n to m by equal titles. The rows that a title gives are counted first: partitions have about OUT of them, and a title of more is
    dealt over several."""
    title = ["p_type", "p_brand", "p_size"]
    n = checkpointed(t.part.groupBy(*title).agg(F.count("*").alias("n")))
    made = n.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    slices = F.ceil(F.col("n") * F.col("n") / OUT).cast("int")
    one = t.part.select(*title, F.col("p_partkey").alias("id")).join(n, title).select(*title, "id", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"))
    other = t.part.select(*title, F.col("p_partkey").alias("alias_id")).join(n, title).select(*title, "alias_id", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    keys, parts = [*title, "slice"], 1 + int(made // OUT)
    return one.repartition(parts, *keys).hint("merge").join(other.repartition(parts, *keys), keys).select("id", "alias_id")


@query("SELECT a.l_orderkey, a.l_partkey AS a_part, b.l_partkey AS b_part, abs(a.l_quantity - b.l_quantity) AS d FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey")
def pairs_in_scene(t: Tables) -> DataFrame:
    """JN-21: all pairs within a key."""
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").distinct()
    other = l.select("l_orderkey", F.col("l_partkey").alias("b_part"), F.col("l_quantity").alias("_q"))
    return l.withColumnRenamed("l_partkey", "a_part").join(other, "l_orderkey").where("a_part < b_part").select("l_orderkey", "a_part", "b_part", F.abs(F.col("l_quantity") - F.col("_q")).alias("d"))


# ---- aggregates


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS orders, (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM part)::BIGINT AS parts, (SELECT count(*) FROM documents)::BIGINT AS documents", "stats_row")
def stats(t: Tables) -> DataFrame:
    """AGG-01, API-02."""
    return stats_row(orders=t.orders, customers=t.customer, parts=t.part, documents=t.documents)


@query("SELECT 'orders' AS table_name, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'pages', count(*) FROM pages", "table_counts")
def counts(t: Tables) -> DataFrame:
    """SET-02."""
    return table_counts(orders=t.orders, lineitem=t.lineitem, pages=t.pages)


@query("SELECT count(DISTINCT l_suppkey)::BIGINT AS suppliers, count(DISTINCT (l_partkey, l_suppkey))::BIGINT AS pairs FROM lineitem")
def count_distincts(t: Tables) -> DataFrame:
    """AGG-02, AGG-17: the pair count first makes pairs distinct, so that two plain counts are left."""
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    return pairs.agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("pairs"))


@query("SELECT upper(substr(p_name, 1, 1)) AS letter, count(*)::BIGINT AS n FROM part GROUP BY 1")
def letter_counts(t: Tables) -> DataFrame:
    """AGG-03."""
    return t.part.groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*)::BIGINT AS n, count(quality)::BIGINT AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def source_counts(t: Tables) -> DataFrame:
    """AGG-04, AGG-19."""
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS filled, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def cond_sums(t: Tables) -> DataFrame:
    """AGG-05."""
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count("*").alias("n"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 3) AS mean_value FROM events GROUP BY 1")
def count_and_mean(t: Tables) -> DataFrame:
    """AGG-06."""
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean_value"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_gt(t: Tables) -> DataFrame:
    """AGG-07."""
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT lang, n_chars, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1, 2")
def dedupe_bare_group(t: Tables) -> DataFrame:
    """AGG-09: the row with the smallest id stands for its group."""
    return first_per_group(t.documents.select("lang", "n_chars", "doc_id", "source"), ["lang", "n_chars"], ["doc_id"])


@query("SELECT l.quality, l.toxic, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY coalesce(l.quality, -1), coalesce(l.toxic, -1), l.quality, l.toxic")
def null_safe_group(t: Tables) -> DataFrame:
    """AGG-10."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT max(ts) AS built_at FROM events")
def max_timestamp(t: Tables) -> DataFrame:
    """AGG-11, API-01."""
    return t.events.agg(F.max("ts").alias("built_at"))


@query("SELECT lang, arg_min(source, (-n, source)) AS top_source FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def most_frequent(t: Tables) -> DataFrame:
    """AGG-12."""
    n = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("top_source"))


@query("SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS line_count FROM customer GROUP BY 1, 2")
def scene_line_counts(t: Tables) -> DataFrame:
    """AGG-13."""
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("line_count"))


@query("SELECT c_custkey, list_sort(list(o_orderkey)) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def collect_per_key(t: Tables) -> DataFrame:
    """AGG-14."""
    return t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))


@query("SELECT role, min(conv_id * 1000 + turn)::BIGINT AS first_at, list(turn ORDER BY conv_id, turn)[1:5] AS first_turns FROM conversations GROUP BY 1")
def ordered_groups(t: Tables) -> DataFrame:
    """AGG-15: groups in the order of their first row, with the first members in order."""
    at = F.struct("conv_id", "turn")
    return t.conversations.groupBy("role").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"), F.transform(F.slice(F.array_sort(F.collect_list(at)), 1, 5), lambda x: x["turn"]).alias("first_turns"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::BIGINT AS a, count(*) FILTER (l_returnflag = 'N')::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS r FROM lineitem GROUP BY 1")
def pivot_stats(t: Tables) -> DataFrame:
    """AGG-16."""
    p = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return p.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'unlabelled' ELSE 'rest' END AS bucket FROM documents)
SELECT bucket, count(*)::BIGINT AS n, list_sort(list(doc_id))[1:10] AS samples FROM b GROUP BY 1""")
def bucket_report(t: Tables) -> DataFrame:
    """AGG-18: one bucket for each row, its size and its first ten rows; samples are cut in a window before they are collected."""
    known = t.labels.select("doc_id").distinct().withColumn("_l", F.lit(True))
    bucket = F.when(F.col("n_chars") == 0, "empty").when(F.col("n_chars") < 200, "short").when(F.col("lang") != "en", "foreign").when(F.col("_l").isNull(), "unlabelled").otherwise("rest")
    b = t.documents.select("doc_id", "n_chars", "lang").join(known, "doc_id", "left").select("doc_id", bucket.alias("bucket"))
    first = b.withColumn("rn", F.row_number().over(W.partitionBy("bucket").orderBy("doc_id"))).where("rn <= 10").groupBy("bucket").agg(F.array_sort(F.collect_list("doc_id")).alias("samples"))
    return b.groupBy("bucket").agg(F.count("*").alias("n")).join(first, "bucket")


# ---- windows


@query("""SELECT l_orderkey, l_suppkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_quantity * l_discount DESC, l_partkey, l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def top_per_pair(t: Tables) -> DataFrame:
    """WIN-01."""
    w = W.partitionBy("l_orderkey", "l_suppkey").orderBy((F.col("l_quantity") * F.col("l_discount")).desc(), "l_partkey", "l_linenumber", "l_quantity")
    return t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INT AS n_in_role FROM conversations", "scene_counter")
def scene_counter_(t: Tables) -> DataFrame:
    """WIN-02, WIN-11."""
    return t.conversations.select("conv_id", "turn", scene_counter(["conv_id", "role"], ["turn"]).alias("n_in_role"))


@query("""SELECT event_id, CASE WHEN coalesce(n, 0) > 0 THEN n ELSE coalesce(max(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) END AS filled
FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id % 100 END AS n FROM events)""")
def running_max_fill(t: Tables) -> DataFrame:
    """WIN-03, SRC-20."""
    e = t.events.withColumn("n", F.when(F.col("event_type") == "click", F.col("event_id") % 100))
    return e.select("event_id", fill_running_max(F.col("n"), ["user_id"], ["ts", "event_id"]).alias("filled"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS anchor FROM events""")
def ffill_anchor(t: Tables) -> DataFrame:
    """WIN-04, WIN-07, WIN-10."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return t.events.select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w), F.lit(0)).alias("anchor"))


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn * 3) % 5 = 0 THEN (turn * 4 + conv_id % 3)::BIGINT END AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT *, last_value(CASE WHEN n IS NOT NULL THEN k END IGNORE NULLS) OVER w AS bk, last_value(n IGNORE NULLS) OVER w AS bn,
 first_value(CASE WHEN n IS NOT NULL THEN k END IGNORE NULLS) OVER v AS ak, first_value(n IGNORE NULLS) OVER v AS an
 FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT conv_id, turn, (CASE WHEN n IS NOT NULL THEN n WHEN bk IS NULL AND ak IS NULL THEN k WHEN bk IS NULL THEN greatest(1, an - (ak - k)) WHEN ak IS NULL THEN bn + (k - bk) ELSE bn + trunc((an - bn) * (k - bk) / (ak - bk)) END)::INT AS line_number FROM f""")
def interpolate_gaps(t: Tables) -> DataFrame:
    """WIN-05, SCL-20."""
    mark = F.when((F.col("conv_id") * 7 + F.col("turn") * 3) % 5 == 0, F.col("turn") * 4 + F.col("conv_id") % 3)
    return interpolate_numbers(t.conversations.select("conv_id", "turn", mark.alias("n")), "n", ["conv_id"], ["turn"]).select("conv_id", "turn", "line_number")


@query("""SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run
FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)""")
def run_segments(t: Tables) -> DataFrame:
    """WIN-06."""
    return t.events.select("event_id", run_ids(F.col("event_type"), ["user_id"], ["ts", "event_id"]).alias("run"))


@query("SELECT conv_id, turn, concat(role, ' ', lead(role) OVER (PARTITION BY conv_id ORDER BY turn)) AS pair, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def adjacent_nav(t: Tables) -> DataFrame:
    """WIN-08, WIN-09, API-19."""
    w = W.partitionBy("conv_id").orderBy("turn")
    pair = F.concat("role", F.lit(" "), F.coalesce(F.lead("role").over(w), F.lit("")))
    return t.conversations.select("conv_id", "turn", pair.alias("pair"), F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("next"))


# ---- order, limits, sets


@query("SELECT doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY quality NULLS FIRST, doc_id)::INT AS place FROM documents LEFT JOIN labels USING (doc_id)")
def order_nulls_first(t: Tables) -> DataFrame:
    """SRT-01."""
    d = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", "quality", F.row_number().over(W.partitionBy("source").orderBy(F.asc_nulls_first("quality"), "doc_id")).alias("place"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 20")
def offset_page(t: Tables) -> DataFrame:
    """SRT-02: a limit over the most is the default of 50."""
    return page(t.part.select("p_partkey", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")], limit=500, offset=20)


@query("SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 25")
def keyset_page(t: Tables) -> DataFrame:
    """SRT-03."""
    return t.documents.where("doc_id > 100").select("doc_id", "source").orderBy("doc_id").limit(25)


@query("SELECT o_orderkey, abs(o_orderkey - 777)::BIGINT AS d FROM orders ORDER BY d, o_orderkey LIMIT 100")
def topk_nearest(t: Tables) -> DataFrame:
    """SRT-04."""
    return t.orders.select("o_orderkey", F.abs(F.col("o_orderkey") - 777).alias("d")).orderBy("d", "o_orderkey").limit(100)


@query("""SELECT p_partkey, tier, row_number() OVER (PARTITION BY p_size ORDER BY tier, p_retailprice DESC, p_name, p_partkey)::INT AS place FROM (SELECT *, CASE WHEN lower(p_name) = 'part 1' THEN 0 WHEN starts_with(lower(p_name), 'part 1') THEN 1 ELSE 2 END AS tier FROM part)""")
def tiered_relevance(t: Tables) -> DataFrame:
    """SRT-05."""
    scored = t.part.withColumn("tier", relevance_tier("p_name", "part 1"))
    w = W.partitionBy("p_size").orderBy("tier", F.col("p_retailprice").desc(), "p_name", "p_partkey")
    return scored.select("p_partkey", "tier", F.row_number().over(w).alias("place"))


@query("""SELECT 'documents' AS source, doc_id AS id, substr(text, 1, 40) AS head FROM documents WHERE contains(lower(text), 'licen') UNION ALL SELECT 'pages', page_id, substr(html, 1, 40) FROM pages WHERE contains(lower(html), 'track(1')""")
def union_search(t: Tables) -> DataFrame:
    """SET-01, FTS-08."""
    hit = lambda df, name, key, col, q: df.where(F.contains(F.lower(col), F.lit(q))).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.substring(col, 1, 40).alias("head"))
    return hit(t.documents, "documents", "doc_id", "text", "licen").unionByName(hit(t.pages, "pages", "page_id", "html", "track(1"))


@query("""(SELECT 'c' AS kind, c_custkey AS id FROM customer WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5) UNION ALL (SELECT 's', s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)""")
def two_limited_sets(t: Tables) -> DataFrame:
    """SET-05: two sets, each with a limit of its own."""
    c = t.customer.where("c_acctbal < 0").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id")).orderBy("id").limit(5)
    return c.unionByName(t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id")).orderBy("id").limit(5))


@query("SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size = 7")
def set_intersection(t: Tables) -> DataFrame:
    """SET-03, SET-04."""
    return t.lineitem.select("l_partkey").intersect(t.part.where("p_size = 7").select("p_partkey"))
