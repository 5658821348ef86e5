import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkloom.functions import collections as fn
from sparkloom.operators import alignment, kvs, membership, wedges
from sparkloom.operators.graph import Graph
from sparkloom.operators.membership import Cuckoo
from sparkloom.plans import combinators
from sparkloom.sources import readers
from sparkloom.streaming import store as streaming


def graph(spark, pairs, directed=True):
    return Graph(spark.createDataFrame(pairs, "src long, dst long"), directed)


def test_edge_lines(spark):
    lines = spark.createDataFrame([("# c",), ("1 2",), ("2\t3",), ("x 4",), ("1 2",)], "value string")
    edges = readers.parse_edges(lines)
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 2), (2, 3)]
    assert tuple(Graph(edges, False).stats().first()) == (3, 3, False, 1, 3)


@pytest.mark.parametrize("partitions", [None, 5])
def test_read_graph(spark, tmp_path, partitions):
    (tmp_path / "a.txt").write_text("# from to\n1 2\n2\t3\n")
    (tmp_path / "b.txt").write_text("3 1\n4 4\nx y\n")
    g = readers.read_graph(spark, str(tmp_path), True, partitions)
    assert tuple(g.stats().first()) == (4, 4, False, 1, 4) and g.triangles().first()["n"] == 1
    assert partitions is None or g.lines.rdd.getNumPartitions() == partitions
    assert {r["part"]: r["n_verts"] for r in g.partition_stats(3).collect()}[None] == 4


def test_lines_of_keys_never_looked_up(spark):
    rows = spark.createDataFrame([("a", "found", 1), ("b", "not_found", None), ("c", None, None)], "key string, status string, value int")
    assert sorted(r["line"] for r in kvs.result_lines(rows).collect()) == ["a: 1", "b: not found", "c: never looked up"]


def test_kept_buckets_are_scanned_alone(spark, tmp_path):
    kv = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "key string, value int")
    kept = kvs.save_buckets(kv, 10, str(tmp_path / "store"))
    parts = [kvs.bucket_scan(kept, 10, a, b) for a, b in fn.group_buckets(10, 4)[:-1]] + [kvs.bucket_scan(kept, 10, 9, 10)]
    seen = [sorted(map(tuple, p.collect())) for p in parts]
    assert seen[0] == sorted(map(tuple, kvs.bucket_scan(kv, 10, 0, 3).collect())) and sum(map(len, seen)) == 200
    assert "PartitionFilters: [isnotnull(bucket" in parts[0]._jdf.queryExecution().toString()


def test_triangles(spark):
    assert graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4)], False).triangles().first()[0] == 1
    assert graph(spark, [(a, b) for a in range(4) for b in range(a)], False).triangles().first()[0] == 4


def test_reach_and_components(spark):
    assert {r["id"] for r in graph(spark, [(0, 1), (1, 2), (3, 0)]).reached().collect()} == {0, 1, 2}
    assert dict(map(tuple, graph(spark, [(1, 2), (3, 4)], False).components().collect())) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert graph(spark, []).reached().count() == 0


@pytest.mark.parametrize("many", [1, 1_000_000])
def test_pagerank_sums_to_one(spark, monkeypatch, many):
    monkeypatch.setattr("sparkloom.operators.graph.MANY", many)
    ranks = dict(map(tuple, graph(spark, [(1, 2), (2, 3), (3, 1), (4, 1)]).pagerank().collect()))
    assert sum(ranks.values()) == pytest.approx(1) and ranks[1] > ranks[4]


def test_pagerank_says_where_it_does_not_converge(spark):
    star = graph(spark, [(0, 1), (0, 2), (0, 3)], False)  # ranks swing between the middle and the ends
    with pytest.raises(RuntimeError):
        star.pagerank(most=2)


def test_store(spark):
    kv = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    keys = spark.createDataFrame([("a",), ("c",), ("a",)], "key string")
    assert [tuple(r) for r in kvs.multi_get(kv, keys).collect()] == [("a", 1)]
    assert sorted(map(tuple, kvs.multi_get_batch(kv, keys).collect())) == [("a", "found", 1), ("c", "not_found", None)]
    put = kvs.put(kv, spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("d", 9, 1)], "key string, value int, seq long"))
    assert dict(map(tuple, put.collect())) == {"a": 7, "b": 2, "d": 9}
    with pytest.raises(ValueError):
        kvs.visit_chunks(kv, 10, 4)


@pytest.mark.parametrize("n,value", [(1, 1), (2, 2), (17, 65536), (18, 131072), (19, 131073)])
def test_read_modify_write(spark, n, value):
    out = kvs.read_modify_write(kvs.empty(spark, "long"), spark.range(n).select(F.lit("k").alias("key")))
    assert out.first()["value"] == value


def test_rmw_after_matches_steps(spark):
    starts = [None, 0, 1, 3, 3125, 50000, 99999, 100000, 123456]
    rows = [(s, n) for s in starts for n in (0, 1, 2, 5, 20, 40)]
    got = spark.createDataFrame(rows, "s long, n int").select("s", "n", fn.rmw_after(F.col("s"), F.col("n")).alias("v")).collect()
    for r in got:
        v = r["s"]
        for _ in range(r["n"]):
            v = streaming.step(v)
        assert r["v"] == v, r


def test_rmw_of_negative_starts_is_exact(spark):
    rows = [(s, n) for s in (-1, -3, -100000, 0) for n in (0, 1, 40, 45)] + [(-1, 50), (-1, 62)]
    for r in spark.createDataFrame(rows, "s long, n int").select("s", "n", fn.rmw_after(F.col("s"), F.col("n")).alias("v")).collect():
        v = r["s"]
        for _ in range(r["n"]):
            v = streaming.step(v)
        assert r["v"] == v, r
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(-3, 63)], "s long, n int").select(fn.rmw_after(F.col("s"), F.col("n"))).collect()


def test_split_and_maps(spark):
    one = spark.createDataFrame([("a,b,",), ("",), (",a",), ("a,,",)], "s string")
    assert [r[0] for r in one.select(fn.split_string(F.col("s"), ",")).collect()] == [["a", "b"], [], ["", "a"], ["a", ""]]
    m = spark.sql("SELECT map('a', 1, 'b', 5) AS x, map('b', 3, 'c', 4) AS y")
    got = m.select(fn.map_union(F.col("x"), F.col("y"), F.greatest), fn.map_difference(F.col("x"), F.col("y")), fn.map_intersection(F.col("x"), F.col("y"), F.least)).first()
    assert tuple(got) == ({"a": 1, "b": 5, "c": 4}, {"a": 1}, {"b": 3})
    assert fn.group_buckets(10, 4) == [(0, 3), (3, 6), (6, 9), (9, 10)]


def brute(a, b):
    h = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i, y in enumerate(b, 1):
        for j, x in enumerate(a, 1):
            h[i][j] = h[i - 1][j - 1] + 2 if x == y else max(0, h[i - 1][j - 1] - 1, h[i][j - 1] - 1, h[i - 1][j] - 1)
    return h[-1][-1]


def test_alignment():
    assert [alignment.score(*p) for p in (("a", "a"), ("ab", "ab"), ("aaa", "bbb"), ("ab", "ba"), ("", ""), ("a", "ab"))] == [2, 4, 0, 1, 0, None]
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 24)
        a, b = ("".join(rng.choice("abc") for _ in range(n)) for _ in range(2))
        assert {alignment.score(a, b, k) for k in (1, 2, 5)} == {brute(a, b)}


def test_cuckoo():
    f = Cuckoo(128, 5)
    assert not f.contains(42) and f.add(42) and f.contains(42) and f.delete(42) and not f.contains(42) and not f.delete(42)
    f = Cuckoo(1000, 12)
    assert all(map(f.add, range(900))) and all(map(f.contains, range(900)))


def test_cuckoo_keeps_what_it_accepted_when_it_is_full():
    f = Cuckoo(90, 10)
    f.table = f.table[:8].copy()
    taken = [k for k in range(400) if f.add(k)]
    assert len(taken) < 400 and f.items == len(taken) == np.count_nonzero(f.table) and all(map(f.contains, taken))


@pytest.mark.parametrize("bits", [5, 10, 16])
def test_cuckoo_rate_is_as_said(bits):
    f = Cuckoo(20_000, bits)
    assert all(map(f.add, range(20_000)))
    asked = np.array([f.hash_of(k) for k in range(10**6, 10**6 + 50_000)], np.uint64)
    found = f.contain(asked).mean()
    assert found <= 1.2 * f.false_rate() + 5 * (f.false_rate() / 50_000) ** 0.5


def test_cuckoo_parts_and_probe_tasks(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    probes = keys.unionAll(spark.range(4000).select(F.concat(F.lit("x"), "id").alias("k"))).unionAll(spark.createDataFrame([(None,)], "k string"))
    got = dict(map(tuple, membership.approximate_member(probes, keys, "k", part_keys=700, part_probes=300).collect()))
    assert len(got) == 7000 and all(got[f"k{i}"] for i in range(3000)) and sum(got[f"x{i}"] for i in range(4000)) < 200
    assert not any(r["here"] for r in membership.approximate_member(probes, keys.limit(0), "k").collect())


def test_long_alignment_in_blocks(spark):
    rng = random.Random(4)
    for n, size in ((1, 4), (7, 3), (12, 4), (30, 7)):
        a, b = ("".join(rng.choice("abc") for _ in range(n)) for _ in range(2))
        pair = spark.createDataFrame([(a, b)], "a string, b string")
        assert alignment.align_long(pair, "a", "b", size).collect() == [(alignment.score(a, b),)]
    for a, b, want in (("", "", 0), ("a", "ab", None), (None, "a", None)):
        assert alignment.align_long(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", 4).first()["score"] == want
    assert readers.alignment_input(spark, 2).select(F.length("a"), F.length("b")).first() == (2048, 2048)


def test_roots_of_restarted_searches(spark):
    got = {r["id"]: r["root"] for r in graph(spark, [(5, 1), (1, 2), (2, 3), (4, 3), (3, 1), (7, 8)]).discovered().collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 7: 7, 8: 7}


def test_triangles_with_repeats_and_loops(spark):
    def brute(lines):
        near = {}
        for a, b in [*lines, *((b, a) for a, b in lines)]:
            near.setdefault(a, []).append(b)
        rank = lambda v: (len(near[v]), v)
        later = {v: Counter(u for u in ns if rank(u) >= rank(v)) for v, ns in near.items()}
        return sum(n * sum((later[v] & later[u]).values()) for v, us in later.items() for u, n in us.items())

    rng = random.Random(8)
    lines = [(rng.randint(0, 7), rng.randint(0, 7)) for _ in range(40)]
    assert graph(spark, lines, False).triangles(parity=True).first()["n"] == brute(lines)
    simple = sorted({(min(e), max(e)) for e in lines if e[0] != e[1]})
    assert graph(spark, simple, False).triangles(parity=True).first() == graph(spark, simple, False).triangles().first()


def test_triangles_with_repeats_move_edges_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    times = np.triu(rng.integers(0, 4, (240, 240)))
    lines = [(int(a), int(b)) if k % 2 else (int(b), int(a)) for a, b in np.argwhere(times) for k in range(times[a, b])] + [(None, 7), (7, None)]
    both = np.triu(times, 1) + np.triu(times, 1).T + np.diag(2 * np.diag(times))
    degree = both.sum(axis=1) + 2 * (np.arange(240) == 7)
    later = both * ((degree[None] > degree[:, None]) | ((degree[None] == degree[:, None]) & (np.arange(240)[None] >= np.arange(240)[:, None])))
    want = sum(int(later[v, u] * np.minimum(later[v], later[u]).sum()) for v, u in np.argwhere(later))
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger graphs
    try:
        for held in (wedges.TASK_EDGES, 3000):  # as few groups as there may be, and more
            monkeypatch.setattr(wedges, "TASK_EDGES", held)
            before = moved()
            assert graph(spark, lines, False).triangles(parity=True).first()["n"] == want
            assert moved() - before < 5 * len(lines)  # there are over 20 wedges a line
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    directed = np.where(rng.random((240, 240)) < 0.2, times, 0)
    directed = directed + np.tril(rng.integers(0, 2, (240, 240)))
    degree = directed.sum(axis=1)
    later = directed * ((degree[None] > degree[:, None]) | ((degree[None] == degree[:, None]) & (np.arange(240)[None] >= np.arange(240)[:, None])))
    lines = [(int(a), int(b)) for a, b in np.argwhere(directed) for _ in range(directed[a, b])]
    want = sum(int(later[v, u] * np.minimum(later[v], later[u]).sum()) for v, u in np.argwhere(later))
    assert graph(spark, lines).triangles(parity=True).first()["n"] == want
    assert graph(spark, [(None, 1)], False).triangles(parity=True).first()["n"] == 0


@pytest.mark.parametrize("places", [wedges.FEW_PLACES, 0])
def test_wedges_are_looked_up_in_pieces(monkeypatch, places):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(wedges, "FEW_PLACES", places)
    monkeypatch.setattr(wedges, "WEDGES", 11)
    monkeypatch.setattr(wedges, "ENTRIES", 64)
    for n in (1, 2, 9, 30):
        times = np.where(rng.random((n, n)) < 0.5, rng.integers(0, 300, (n, n)), 0)
        src, dst = np.nonzero(times)
        want = sum(int(times[v, u] * np.minimum(times[v], times[u]).sum()) for v, u in zip(src, dst))
        edges = src.astype(np.int32), dst.astype(np.int32), times[src, dst].astype(np.uint16), n
        assert wedges.counted(*edges) == want
        split = n // 3
        inner = sum(int(t[v, u] * np.minimum(t[v], t[u]).sum()) for t in (times[:split, :split], times[split:, split:]) for v, u in np.argwhere(t))
        assert wedges.counted(*edges, split) == want - inner


def test_triangles_of_near_ids_move_to_few_tasks(spark, monkeypatch):
    lines = [(a, b) for k in range(0, 640, 10) for a in range(k, k + 13) for b in range(k, a)]  # cliques that share vertices
    monkeypatch.setattr(wedges, "TASK_EDGES", 800)
    g = graph(spark, lines, False)
    entries = g._entries()
    groups = wedges.groups_for(entries, entries.count())
    assert groups.span == (0, 642) and groups.met.sum(axis=1).max() <= 2 and groups.tasks() < 3 * len(groups.met)
    near = {}
    for a, b in [*lines, *((b, a) for a, b in lines)]:
        near.setdefault(a, []).append(b)
    later = {v: Counter(u for u in ns if (len(near[u]), u) >= (len(ns), v)) for v, ns in near.items()}
    want = sum(n * sum((later[v] & later[u]).values()) for v, us in later.items() for u, n in us.items())
    assert g.triangles(parity=True).first()["n"] == want


def test_combinators():
    one = combinators.spawn(lambda: 1)
    assert combinators.then(lambda x, y: x + y, one, 2).result() == 3
    assert combinators.fold(lambda a, b: a + b, [combinators.spawn(lambda i=i: i) for i in range(7)]).result() == 21
    with pytest.raises(TypeError):
        combinators.task(lambda *a: a)


def test_streamed_puts_are_those_of_a_table(spark, tmp_path):
    rows = [("a", 1, -5), ("a", None, -4), ("b", 2**60 + 1, 3), ("b", None, 2), ("c", None, -1), ("d", 7, None), ("e", -3, -(2**63))]
    updates = spark.createDataFrame(rows, "key string, value long, seq long")
    want = dict(map(tuple, kvs.put(kvs.empty(spark, "long"), updates).collect()))
    assert want == {"a": None, "b": 2**60 + 1, "c": None, "e": -3}
    updates.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in"))
    q = streaming.put_stream(stream).writeStream.format("memory").queryName("odd_puts").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: r["value"] for r in spark.sql("SELECT * FROM odd_puts").collect()} == want


def test_streams(spark, tmp_path):
    updates = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "key string, value long, seq long")
    updates.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in"))
    for name, out, want in (("puts", streaming.put_stream(stream).select("key", "value"), {"a": 2, "b": 5}), ("rmws", streaming.rmw_stream(stream.select("key")), {"a": 2, "b": 1})):
        q = out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert dict(map(tuple, spark.sql(f"SELECT * FROM {name}").collect())) == want


def test_refs_of_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    names = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.expr("c_custkey = o_custkey")).select("c_name").distinct()
    got = __spark_entry__.queries()["kv_get_ref"](spark, sf)
    assert sorted(r["key"] for r in got.collect()) == sorted(r[0] for r in names.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
