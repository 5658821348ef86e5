"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import collections as fn
from sparkloom.operators import alignment, kvs, membership, sorting
from sparkloom.operators.graph import Graph
from sparkloom.plans import combinators
from sparkloom.plans.materialize import materialize, shared_dir
from sparkloom.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark, sf_dir: str) -> DataFrame:
    """The store of customers: name -> key."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))


def keys_of(orders: DataFrame, spark, sf_dir: str) -> DataFrame:
    """Keys to look up: the customers' of the orders, and as many that aren't there."""
    o = orders.select(F.col("o_custkey").alias("c_custkey"))
    there = o.join(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_name").alias("key"))
    return there.unionAll(o.select(F.concat(F.lit("none-"), F.col("c_custkey").cast("string"))))


def wanted(spark, sf_dir: str) -> DataFrame:
    """The keys of all orders, and as many absent ones."""
    return keys_of(table(spark, sf_dir, "orders"), spark, sf_dir)


WANTED = """WITH wanted AS (SELECT c_name AS key FROM orders JOIN customer ON o_custkey = c_custkey
 UNION ALL SELECT 'none-' || o_custkey FROM orders), kv AS (SELECT c_name AS key, c_custkey AS value FROM customer) """

#: The bucket of `key` among n: the first eight hexadecimal digits of its MD5 digest, modulo n.
DIGITS = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', md5(key)[i]) - 1) * CAST(pow(16, 8 - i) AS BIGINT)))"


def bucket_sql(n: int) -> str:
    return f"CAST({DIGITS} % {n} AS BIGINT)"


# --- keyed store ----------------------------------------------------------------------------------


@query("SELECT c_name AS key, c_custkey AS value FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def kv_get(spark, sf_dir):
    kv = customers(spark, sf_dir)
    return kvs.get(kv, kv.agg(F.min("key")).first()[0])


@query(WANTED + "SELECT DISTINCT key, value FROM wanted JOIN kv USING (key)")
def kv_multi_get(spark, sf_dir):
    return kvs.multi_get(customers(spark, sf_dir), wanted(spark, sf_dir))


@query(WANTED + """SELECT key, CASE WHEN value IS NULL THEN 'not_found' ELSE 'found' END AS status, value FROM (SELECT DISTINCT
 key FROM wanted) LEFT JOIN kv USING (key)""")
def kv_multi_get_batch(spark, sf_dir):
    return kvs.multi_get_batch(customers(spark, sf_dir), wanted(spark, sf_dir))


@query(WANTED + """SELECT CASE WHEN value IS NULL THEN key || ': not found' ELSE key || ': ' || value END AS line FROM (SELECT
 DISTINCT key FROM wanted) LEFT JOIN kv USING (key)""")
def kv_result_lines(spark, sf_dir):
    return kvs.result_lines(kv_multi_get_batch(spark, sf_dir))


@query(WANTED + f"SELECT DISTINCT key, {bucket_sql(16)} AS bucket FROM wanted JOIN kv USING (key)")
def kv_get_ref(spark, sf_dir):
    return kvs.get_ref(customers(spark, sf_dir), wanted(spark, sf_dir), 16)


@query(f"SELECT c_name AS key, c_custkey AS value FROM (SELECT *, c_name AS key FROM customer) WHERE {bucket_sql(16)} BETWEEN 4 AND 6")
def kv_bucket_scan(spark, sf_dir):
    """Three of the sixteen buckets of a store that is kept by bucket."""
    path = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    return kvs.bucket_scan(kvs.save_buckets(customers(spark, sf_dir), 16, path), 16, 4, 7)


def updates(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("key"),
        F.floor(F.col("value")).cast("long").alias("value"), F.col("event_id").alias("seq"))


UPDATES = "SELECT 'key-' || user_id AS key, CAST(floor(value) AS BIGINT) AS value, event_id AS seq FROM events"


@query(f"SELECT key, arg_max_null(value, seq) AS value FROM ({UPDATES}) GROUP BY key UNION ALL SELECT c_name, c_custkey FROM customer")
def kv_put(spark, sf_dir):
    return kvs.put(customers(spark, sf_dir), updates(spark, sf_dir))


@query(f"SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM ({UPDATES})")
def kv_put_with_old(spark, sf_dir):
    return kvs.put_with_old(kvs.empty(spark, "long"), updates(spark, sf_dir)).select("key", "seq", "value", "old")


@query("""WITH RECURSIVE n AS (SELECT 'key-' || user_id AS key, count(*) AS n FROM events GROUP BY ALL), steps(i, v) AS (
 SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, CASE WHEN v < 100000 THEN v * 2 ELSE v + 1 END FROM steps WHERE i < (SELECT max(n) FROM n))
 SELECT key, v AS value FROM n JOIN steps ON i = n""")
def kv_read_modify_write(spark, sf_dir):
    return kvs.read_modify_write(kvs.empty(spark, "long"), updates(spark, sf_dir).select("key"))


@query(f"SELECT key, arg_max_null(value, seq) AS value FROM ({UPDATES}) WHERE seq <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events) GROUP BY key")
def kv_at_version(spark, sf_dir):
    """The store as of the middle one of all versions."""
    history = updates(spark, sf_dir).withColumnRenamed("seq", "version")
    low, high = history.agg(F.min("version"), F.max("version")).first()
    return kvs.at_version(history, ((low or 0) + (high or 0)) // 2)


@query(f"SELECT CAST({bucket_sql(16)} // 4 AS INTEGER) AS chunk, count(*) AS n FROM (SELECT c_name AS key FROM customer) GROUP BY ALL")
def kv_visit_chunks(spark, sf_dir):
    return kvs.visit_chunks(customers(spark, sf_dir), 16, 4)


def _halves(spark, sf_dir):
    """Two stores with some keys in common: customers' and suppliers' numbers."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    number = F.col("s_suppkey") + (c.count() - s.count() // 2)  # so that either store has keys of its own
    key = lambda k: F.concat(F.lit("key-"), k.cast("string")).alias("key")
    first = c.select(key(F.col("c_custkey")), (F.col("c_custkey") * 3).alias("value"))
    return first, s.select(key(number), (number * 2 + F.floor("s_acctbal").cast("long")).alias("value"))


HALVES = """WITH h AS (SELECT (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier) // 2 AS half),
 a AS (SELECT 'key-' || c_custkey AS key, c_custkey * 3 AS value FROM customer),
 b AS (SELECT 'key-' || (s_suppkey + half) AS key, (s_suppkey + half) * 2 + CAST(floor(s_acctbal) AS BIGINT) AS value FROM supplier, h) """


@query(HALVES + "SELECT key, greatest(a.value, b.value) AS value FROM a FULL JOIN b USING (key)")
def kv_union_max(spark, sf_dir):
    return kvs.union(*_halves(spark, sf_dir), F.greatest)


@query(HALVES + "SELECT key, greatest(a.value, b.value) AS value FROM a JOIN b USING (key)")
def kv_intersection_max(spark, sf_dir):
    return kvs.intersection(*_halves(spark, sf_dir), F.greatest)


@query(HALVES + "SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM b)")
def kv_difference(spark, sf_dir):
    return kvs.difference(*_halves(spark, sf_dir))


@query(HALVES + "SELECT key, value FROM a UNION ALL SELECT key, value FROM b WHERE key NOT IN (SELECT key FROM a)")
def kv_merge_partials(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return kvs.merge_partials(a, kvs.difference(b, a))


# --- graphs ---------------------------------------------------------------------------------------


def parts_graph(spark, sf_dir: str) -> Graph:
    """Parts that share an order, each pair once."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()  # noqa: E741
    pairs = l.join(l.withColumnRenamed("l_partkey", "dst"), "l_orderkey").filter(F.col("l_partkey") < F.col("dst"))
    return Graph(pairs.select(F.col("l_partkey").alias("src"), "dst").distinct(), directed=False).written("parts")


PARTS = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
 e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey),
 s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) """


def supply_graph(spark, sf_dir: str) -> Graph:
    """Directed: from each supplier to the parts it shipped, one line for each shipment; parts are numbered from 1000000 on."""
    return Graph(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")))


SUPPLY = "WITH RECURSIVE e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) "


@query(PARTS + "SELECT count(*) AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst")
def triangle_count(spark, sf_dir):
    return parts_graph(spark, sf_dir).triangles()


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst
 FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
 d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY src), o AS (SELECT s.src, s.dst, count(*) AS times FROM s JOIN d x ON s.src = x.id
 JOIN d y ON s.dst = y.id WHERE y.degree > x.degree OR (y.degree = x.degree AND s.dst >= s.src) GROUP BY s.src, s.dst)
 SELECT CAST(coalesce(sum(v.times * least(w.times, u.times)), 0) AS BIGINT) AS n FROM o v JOIN o w ON v.src = w.src JOIN o u ON u.src = v.dst AND u.dst = w.dst""")
def triangle_count_parity(spark, sf_dir):
    """Suppliers of different parts of an order, a line for each pair: repeats and loops count."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()  # noqa: E741
    pairs = l.join(l.withColumnsRenamed({"l_partkey": "other", "l_suppkey": "dst"}), "l_orderkey").filter(F.col("l_partkey") < F.col("other"))
    return Graph(pairs.select(F.col("l_suppkey").alias("src"), "dst"), directed=False).triangles(parity=True)


@query(SUPPLY + """SELECT (SELECT count(*) FROM v) AS n_verts, (SELECT count(*) FROM e) AS n_edges, true AS is_directed, (SELECT
 min(id) FROM v) AS min_vertex_id, (SELECT max(id) FROM v) AS max_vertex_id""")
def graph_stats(spark, sf_dir):
    return supply_graph(spark, sf_dir).stats()


@query(SUPPLY + "SELECT id, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id")
def graph_out_degrees(spark, sf_dir):
    return supply_graph(spark, sf_dir).out_degrees()


@query(SUPPLY + "SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON id = dst GROUP BY id")
def graph_in_degrees(spark, sf_dir):
    return supply_graph(spark, sf_dir).in_degrees()


@query(PARTS + "SELECT src AS id, count(*) AS degree, CAST(sum(dst) AS BIGINT) AS total FROM s GROUP BY src")
def graph_adjacency(spark, sf_dir):
    total = F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")
    return parts_graph(spark, sf_dir).adjacency().select("id", F.size("neighbours").cast("long").alias("degree"), total)


@query(SUPPLY + "SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS sources FROM e GROUP BY dst")
def graph_incoming(spark, sf_dir):
    return supply_graph(spark, sf_dir).incoming().select("id", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query(PARTS + ", d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY src) SELECT s.src, s.dst, degree FROM s JOIN d ON s.dst = id")
def graph_neighbour_degrees(spark, sf_dir):
    return parts_graph(spark, sf_dir).neighbour_degrees()


@query(PARTS + """, d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY src) SELECT s.src AS id, string_agg(s.dst, ','
 ORDER BY y.degree, s.dst) AS neighbours FROM s JOIN d x ON s.src = x.id JOIN d y ON s.dst = y.id WHERE y.degree > x.degree OR
 (y.degree = x.degree AND s.dst >= s.src) GROUP BY s.src""")
def graph_effective_neighbours(spark, sf_dir):
    return parts_graph(spark, sf_dir).effective_neighbours().select("id",
        F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(SUPPLY + ", r AS (SELECT min(id) AS id FROM v UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r")
def graph_reached_from_lowest(spark, sf_dir):
    return supply_graph(spark, sf_dir).reached().select("id")


@query(SUPPLY + "SELECT id, true AS discovered, coalesce(min(src), id) AS root FROM v LEFT JOIN e ON id = dst GROUP BY id")
def graph_discovered(spark, sf_dir):
    return supply_graph(spark, sf_dir).discovered()


@query(SUPPLY + """, r AS (SELECT min(id) AS id FROM v UNION SELECT e.dst FROM r JOIN e ON r.id = e.src) SELECT CASE WHEN id > 0
 THEN (id - 1) // 32768 + 1 ELSE id // 32768 END AS bucket, count(*) AS n FROM r GROUP BY ALL""")
def graph_discovered_bitmap(spark, sf_dir):
    """Bits set in each bucket of 32768 ids, of what the lowest id reaches."""
    g = supply_graph(spark, sf_dir)
    return g.bitmap(g.reached()).select("bucket", F.bitmap_count("bits").alias("n"))


@query(f"""WITH e AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
 d AS (SELECT id, CAST(id AS VARCHAR) AS key, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id)
 SELECT {bucket_sql(8)} AS part, count(*) AS n_verts, CAST(sum(degree) AS BIGINT) AS n_edges FROM d GROUP BY 1
 UNION ALL SELECT NULL, count(*), CAST(sum(degree) AS BIGINT) FROM d""")
def graph_partition_stats(spark, sf_dir):
    return supply_graph(spark, sf_dir).partition_stats(8)


@query(SUPPLY + """, more AS (SELECT s_suppkey AS src, p_partkey + 2000000 AS dst FROM supplier JOIN part ON s_suppkey = p_partkey),
 x AS (SELECT id FROM v UNION SELECT src FROM more UNION SELECT dst FROM more UNION SELECT c_custkey + 3000000 FROM customer),
 f AS (SELECT * FROM e UNION ALL SELECT * FROM more) SELECT id, count(src) AS degree FROM x LEFT JOIN f ON id = src GROUP BY id""")
def graph_inserted(spark, sf_dir):
    """Degrees after inserting an edge for each supplier and a vertex for each customer."""
    s, p, c = (table(spark, sf_dir, n) for n in ("supplier", "part", "customer"))
    more = s.join(p, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("src"), (F.col("p_partkey") + 2000000).alias("dst"))
    g = supply_graph(spark, sf_dir).insert_edges(more).insert_vertices(c.select((F.col("c_custkey") + 3000000).alias("id")))
    return g.out_degrees()


def chain_graph(spark, sf_dir: str, directed: bool) -> Graph:
    """From each order of a customer to the customer's next one."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chained = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), after.alias("dst"))
    return Graph(chained.filter("dst IS NOT NULL"), directed).insert_vertices(chained.select(F.col("src").alias("id"))).written("chains")


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def graph_chain_components(spark, sf_dir):
    """Components many steps wide: the lowest order of each customer."""
    return chain_graph(spark, sf_dir, False).components()


@query("""SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS depth FROM orders
 WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 1)""")
def graph_chain_reached(spark, sf_dir):
    """What the lowest order leads to, and in how many steps."""
    return chain_graph(spark, sf_dir, True).reached()


def nation_graph(spark, sf_dir: str) -> Graph:
    """Nations joined with their region: five components."""
    return Graph(table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 1000).cast("long").alias("src"),
        F.col("n_nationkey").cast("long").alias("dst")), directed=False)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS component
 FROM nation UNION ALL SELECT CAST(n_regionkey + 1000 AS BIGINT), CAST(min(n_nationkey) AS BIGINT) FROM nation GROUP BY
 n_regionkey""")
def graph_components(spark, sf_dir):
    return nation_graph(spark, sf_dir).components()


@query(SUPPLY + """, d AS (SELECT id, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id),
 p AS (SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100) AS BIGINT) AS part, degree FROM d)
 SELECT part, count(*) AS n_verts, CAST(sum(degree) AS BIGINT) AS n_edges FROM p GROUP BY part""")
def graph_repartitioned(spark, sf_dir):
    return supply_graph(spark, sf_dir).repartitioned(100)


@query()
def graph_pagerank(spark, sf_dir):
    return parts_graph(spark, sf_dir).pagerank()


ROUNDS = 6
RANKS = SUPPLY + ", n AS (SELECT count(*) AS n FROM v), d AS (SELECT id, count(src) AS degree FROM v LEFT JOIN e ON id = src GROUP BY id), r0 AS (SELECT id, degree, 1.0::DOUBLE / n AS rank FROM d, n)"
for _k in range(ROUNDS):
    RANKS += f""", g{_k} AS (SELECT dst AS id, sum(rank / degree) AS got FROM e JOIN r{_k} ON src = id GROUP BY dst),
 l{_k} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{_k} WHERE degree = 0),
 r{_k + 1} AS (SELECT id, degree, 0.15 / n + 0.85 * (coalesce(got, 0) + loose / n) AS rank FROM r{_k} LEFT JOIN g{_k} USING (id), l{_k}, n)"""


@query(RANKS + f" SELECT id, round(rank, 9) AS rank FROM r{ROUNDS}")
def graph_pagerank_rounds(spark, sf_dir):
    """A fixed number of rounds over a graph with repeated lines and loose ends."""
    return supply_graph(spark, sf_dir).pagerank(rounds=ROUNDS).select("id", F.round("rank", 9).alias("rank"))


@query(r"""WITH t AS (SELECT CASE WHEN l_linenumber = 1 THEN '# ' ELSE '' END || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN
 ' ' ELSE chr(9) END || l_partkey AS value FROM lineitem) SELECT CAST(regexp_extract(value, '^[0-9]+') AS BIGINT) AS src,
 CAST(regexp_extract(value, '[0-9]+$') AS BIGINT) AS dst FROM t WHERE value NOT LIKE '#%'""")
def parse_edge_lines(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.select(F.concat(F.when(F.col("l_linenumber") == 1, "# ").otherwise(""), F.col("l_orderkey").cast("string"),
        F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise("\t"), F.col("l_partkey").cast("string")).alias("value"))
    return readers.parse_edges(lines)


# --- sorting, alignment, membership, functions ------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber)
 AS place FROM lineitem""")
def sorted_lineitems(spark, sf_dir):
    """The place of each row in the order by price: ranges, then ranks within each and the counts before it."""
    order = ["l_extendedprice", "l_orderkey", "l_linenumber"]
    l = table(spark, sf_dir, "lineitem").select(*order)  # noqa: E741
    dealt = materialize(l.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "sorted")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_b"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_r", rank).join(F.broadcast(base), "_p").select("l_orderkey", "l_linenumber", "l_extendedprice",
        (F.col("_r") + F.col("_b")).alias("place"))


@query("SELECT count(*) AS n, true AS ordered FROM range(160000)")
def sort_collection(spark, sf_dir):
    """Sorts a synthetic collection by ranges and checks that its parts follow each other."""
    parts = sorting.part_summary(readers.sort_input(spark, 16, 10_000), "v", 16)
    w = Window.orderBy("part")  # 16 rows
    return parts.select("n", (F.coalesce(F.lag("high").over(w),
        F.col("low")) <= F.col("low")).alias("ok")).agg(F.sum("n").alias("n"), F.every("ok").alias("ordered"))


@query()
def alignment_scores(spark, sf_dir):
    """Benchmark items against themselves read backwards."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.reverse("text").alias("back"))
    return alignment.align(b, "text", "back", chunks=4, keep=("item_id",))


#: One cell a step: prev and cur are the rows above and at i.
CELLS = """WITH RECURSIVE cells AS (SELECT n_nationkey AS id, n_name AS a, reverse(n_name) AS b, 1 AS i, 1 AS j,
 list_transform(range(length(n_name) + 1), lambda x: 0) AS prev, [0] AS cur FROM nation UNION ALL
 SELECT id, a, b, CASE WHEN j = length(a) THEN i + 1 ELSE i END, CASE WHEN j = length(a) THEN 1 ELSE j + 1 END,
 CASE WHEN j = length(a) THEN list_append(cur, cell) ELSE prev END, CASE WHEN j = length(a) THEN [0] ELSE list_append(cur, cell) END
 FROM (SELECT *, CAST(CASE WHEN a[j] = b[i] THEN prev[j] + 2 ELSE greatest(0, prev[j] - 1, cur[j] - 1, prev[j + 1] - 1) END AS INTEGER) AS cell
 FROM cells WHERE i <= length(b)))
 SELECT id, prev[length(a) + 1] AS score FROM cells WHERE i = length(b) + 1 AND j = 1"""


@query(CELLS)
def alignment_names(spark, sf_dir):
    """Nations' names against themselves read backwards."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", F.reverse("n_name").alias("back"))
    return alignment.align(n, "n_name", "back", chunks=3)


@query("SELECT CAST(2 * sum(length(n_name)) AS INTEGER) AS score FROM nation")
def alignment_long_self_score(spark, sf_dir):
    """All nations' names, one after another, against the same, its blocks dealt to tasks."""
    n = table(spark, sf_dir, "nation").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "").alias("text"))  # 25 names
    return alignment.align_long(n.select(F.col("text").alias("a"), F.col("text").alias("b")), "a", "b", 64)


@query("SELECT 0 AS score")
def alignment_synthetic(spark, sf_dir):
    """The synthetic pair of one kilobyte: no letter agrees."""
    return alignment.align_long(readers.alignment_input(spark, 1), "a", "b", 256)


@query("SELECT item_id, 2 * length(text) AS score FROM benchmark")
def alignment_self_scores(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.col("text").alias("same"))
    return alignment.align(b, "text", "same", chunks=3, keep=("item_id",)).withColumn("score", F.col("score").cast("long"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS here FROM part")
def member_exact(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return membership.member(table(spark, sf_dir, "part").select("p_partkey"), keys, "p_partkey")


@query()
def member_cuckoo(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return membership.approximate_member(table(spark, sf_dir, "part").select("p_partkey"), keys, "p_partkey")


@query("SELECT CAST(0 AS BIGINT) AS missed, true AS rate_kept, count(*) AS probes FROM part")
def member_cuckoo_faults(spark, sf_dir):
    """Keys that the filters miss, and whether they take other parts for keys more often than 2.3 % by more than chance (5 deviations)."""
    exact, near = member_exact(spark, sf_dir), member_cuckoo(spark, sf_dir).withColumnRenamed("here", "near")
    got = exact.join(near, "p_partkey").agg(F.count_if(F.expr("here AND NOT near")).alias("missed"),
        F.count_if(F.expr("near AND NOT here")).alias("false"), F.count_if(~F.col("here")).alias("others"), F.count(F.lit(1)).alias("probes"))
    most = F.col("others") * 0.023 + 5 * F.sqrt(F.col("others") * 0.023) + 1
    return got.select("missed", (F.col("false") <= most).alias("rate_kept"), "probes")


@query("""WITH p AS (SELECT l_orderkey, list(l_partkey % 5 ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey),
 a AS (SELECT l_orderkey, p, p[1:3] AS a, p[3:6] AS b FROM p)
 SELECT l_orderkey, CAST(list_sum(list_transform([0, 1, 2, 3, 4], lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS BIGINT) AS shared,
 CASE WHEN len(p) > 1 THEN p[2] END AS second, CAST(list_position(p, 0) - 1 AS BIGINT) AS zero, CAST(list_sum(p[2:4]) AS BIGINT) AS part_sum,
 CASE WHEN len(p) > 1 THEN CAST(list_sum(p) - p[2] + 100 AS BIGINT) END AS put_sum, CAST(list_sum(p) + CASE WHEN len(p) < 4 THEN 7 ELSE 0 END AS BIGINT) AS pushed_sum FROM a""")
def array_functions(spark, sf_dir):
    """Overlap, places, finds, cuts and bounded pushes over the parts of each order, modulo 5."""
    numbers = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 5)
    p = F.col("p")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)
    cut = fn.array_cut(p, 1, 3)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(numbers.alias("p")).select(
        "l_orderkey", fn.multiset_overlap(fn.array_truncate(p, 3), fn.array_cut(p, 2, 4)).cast("long").alias("shared"), fn.array_pop_at(p, 1).alias("second"),
        fn.array_find(p, lambda x: x == 0).cast("long").alias("zero"), F.when(F.size(cut) > 0, total(cut)).alias("part_sum"),
        total(fn.array_push_at(p, 1, F.lit(100).cast("long"))).alias("put_sum"),
            total(fn.array_bounded_push(p, F.lit(7).cast("long"), 4)).alias("pushed_sum"))


@query("""SELECT event_id, hex(encode(props)[3:7]) AS part, (event_id >> 3) & 1 = 1 AS bit, event_id | 16 AS marked FROM (SELECT
 *, props AS p FROM events WHERE octet_length(encode(props)) >= 7) UNION ALL SELECT event_id, NULL, (event_id >> 3) & 1 = 1,
 event_id | 16 FROM events WHERE octet_length(encode(props)) < 7""")
def bytes_and_bits(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.hex(fn.string_slice(F.col("props"), 2, 7)).alias("part"),
        fn.bit_is_set(e, F.lit(3)).alias("bit"), fn.bit_set(e, 4).alias("marked"))


@query("""SELECT event_id, CASE WHEN props = '' THEN 0 WHEN props LIKE '%,' THEN len(string_split(props, ',')) - 1 ELSE
 len(string_split(props, ',')) END AS n, octet_length(encode(props)) AS bytes FROM events""")
def split_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.size(fn.split_string(F.col("props"), ",")).cast("long").alias("n"),
        fn.string_bytes(F.col("props")).cast("long").alias("bytes"))


@query("""WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
 SELECT l_orderkey, p[len(p)] AS last, len(p) - 1 AS left_over, CAST(list_sum(p[1:2]) AS BIGINT) AS first_two FROM a""")
def array_edits(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber",
        "l_partkey"))), lambda x: x["l_partkey"]).alias("p"))  # noqa: E741
    popped = fn.array_pop(F.col("p"))
    return l.select("l_orderkey", popped["last"].alias("last"), F.size(popped["rest"]).cast("long").alias("left_over"),
        F.aggregate(fn.array_truncate(F.col("p"), 2), F.lit(0).cast("long"), lambda a, x: a + x).alias("first_two"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def fold_partials(spark, sf_dir):
    """Counts of each return flag's rows, folded pairwise by a combinator."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    parts = [combinators.spawn(lambda f=f: l.filter(F.col("l_returnflag") == f).groupBy("l_suppkey").count()) for f in ("A", "N", "R")]
    both = lambda a, b: a.unionByName(b).groupBy("l_suppkey").agg(F.sum("count").alias("count"))
    return combinators.fold(both, parts).result().withColumnRenamed("count", "n")


@query()
def workload(spark, sf_dir):
    return readers.kv_workload(spark, 10_000, zipf=0.99, width=4)


@query("SELECT 20000 AS n, true AS dense, true AS mixed, true AS in_range, true AS valued, true AS begun_anew, true AS skewed")
def workload_shape(spark, sf_dir):
    """What holds for any workload: dense numbers, the mix of reads within 5 deviations, keys and values in range, a new start after each reseed, and keys as skewed as their law."""
    w = readers.kv_workload(spark, 20_000, 1000, 0.5, zipf=0.99, width=4, reseed=10_000)
    rmw = readers.kv_workload(spark, 20_000, 1000, 0.5, write="rmw")
    rank = F.transform("keys", lambda k: F.substring(k, 5, 10).cast("long"))
    got = w.withColumn("rank", rank).agg(
        F.count(F.lit(1)).cast("int").alias("n"),
            ((F.min("seq") == 0) & (F.max("seq") == F.count(F.lit(1)) - 1) & (F.count_distinct("seq") == F.count(F.lit(1)))).alias("dense"),
        (F.abs(F.count_if(F.col("op") == "mget") - 10_000) < 5 * 71).alias("mixed"),
            F.every((F.array_min("rank") >= 0) & (F.array_max("rank") < 1000) & (F.size("rank") == F.when(F.col("op") == "mget",
            4).otherwise(1))).alias("in_range"),
        F.every(F.when(F.col("op") == "put", F.col("value").between(0, 999_999)).otherwise(F.col("value").isNull())).alias("valued"),
        (F.max_by("keys", F.struct(F.col("seq") == 0, "seq")) != F.max_by("keys", F.struct(F.col("seq") == 10_000, "seq"))).alias("begun_anew"),
        (F.count_if(F.get("rank", F.lit(0)) == 0) > 20 * F.count_if(F.get("rank", F.lit(0)) == 500)).alias("skewed"))
    other = rmw.agg(F.every((F.col("op").isin("get", "rmw")) & F.col("value").isNull()).alias("ok"))
    return got.join(other).select("n", "dense", "mixed", "in_range", (F.col("valued") & F.col("ok")).alias("valued"),
        "begun_anew", "skewed")  # one row each
