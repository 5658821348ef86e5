"""Graphs as DataFrames of edges. Loops end when a join finds nothing new; lineage is cut by written tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.collections import bucket_of
from sparkloom.operators.wedges import groups_for, weighted_triangles
from sparkloom.plans.materialize import bucketed, materialize, remove


#: Vertices from which a graph's tables are dealt to buckets, and up to which all tasks get their degrees.
MANY, FEW = 1_000_000, 200_000


@dataclass(frozen=True)
class Graph:
    """lines(src, dst): one row for each input line, with repeats and loops. alone(id): vertices that need no line."""

    lines: DataFrame
    directed: bool = True
    alone: DataFrame | None = None

    @cached_property
    def edges(self) -> DataFrame:
        """Out-edges; an undirected line counts both ways."""
        return self.lines if self.directed else self.lines.unionAll(self.lines.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    @cached_property
    def vertices(self) -> DataFrame:
        ids = self.lines.select(F.explode(F.array("src", "dst")).alias("id"))
        return (ids if self.alone is None else ids.unionAll(self.alone.select("id"))).distinct()

    def insert_edges(self, new: DataFrame) -> Graph:
        """The graph with further lines (src, dst); vertices that weren't there come with them."""
        return Graph(self.lines.unionByName(new.select("src", "dst")), self.directed, self.alone)

    def insert_vertices(self, new: DataFrame) -> Graph:
        """The graph with further vertices (id), with or without edges; those that are there stay as they are."""
        ids = new.select("id")
        return Graph(self.lines, self.directed, ids if self.alone is None else self.alone.select("id").unionAll(ids))

    def written(self, tag: str = "lines") -> Graph:
        """The same graph with its lines in a table, for queries that read them several times."""
        return Graph(materialize(self.lines, tag), self.directed, self.alone)

    def stats(self) -> DataFrame:
        """n_verts, n_edges (lines), is_directed, min_vertex_id, max_vertex_id. Vertices are made distinct before one final aggregate."""
        n = self.lines.agg(F.count(F.lit(1)).alias("n_edges"))
        v = self.vertices.agg(F.count(F.lit(1)).alias("n_verts"), F.min("id").alias("min_vertex_id"), F.max("id").alias("max_vertex_id"))
        return v.crossJoin(n).select("n_verts", "n_edges", F.lit(self.directed).alias("is_directed"), "min_vertex_id",
            "max_vertex_id")  # one row each

    def partition_stats(self, parts: int) -> DataFrame:
        """part, n_verts, n_edges (adjacency lengths) of the vertices dealt to parts by bucket, and of all in the row whose part is null."""
        part = bucket_of(F.col("id").cast("string"), parts)
        return self.out_degrees().rollup(part.alias("part")).agg(F.count(F.lit(1)).alias("n_verts"),
            F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("n_edges"))

    def out_degrees(self) -> DataFrame:
        """id, degree of all vertices, repeats counted."""
        n = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def in_degrees(self) -> DataFrame:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).out_degrees()

    def adjacency(self) -> DataFrame:
        """id, neighbours in order."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))

    def incoming(self) -> DataFrame:
        """id, sources in order."""
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("sources"))

    def neighbour_degrees(self) -> DataFrame:
        """src, dst, degree of dst."""
        return self.edges.join(self.out_degrees().withColumnRenamed("id", "dst"), "dst").select("src", "dst", "degree")

    def oriented(self) -> DataFrame:
        """Edges towards the vertex with the higher (degree, id); loops stay. ds, dd: the degrees."""
        d = materialize(self.out_degrees(), "degrees")
        e = self.edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")),
            "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
        return e.filter((F.col("dd") > F.col("ds")) | ((F.col("dd") == F.col("ds")) & (F.col("dst") >= F.col("src")))).select("src",
            "dst", "ds", "dd")

    def effective_neighbours(self) -> DataFrame:
        """id, neighbours that the orientation keeps, by (degree, id)."""
        listed = F.sort_array(F.collect_list(F.struct("dd", "dst")))
        return self.oriented().groupBy(F.col("src").alias("id")).agg(F.transform(listed, lambda x: x["dst"]).alias("neighbours"))

    def _entries(self) -> DataFrame:
        """src, dst, times: entries of the adjacency lists, as many of them as times says. Of an undirected line's two entries there is
        the one from the lower id alone; both are the same where it is a loop, which counts twice."""
        if self.directed:
            return self.lines.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))
        low = F.col("src") <= F.col("dst")
        lines = self.lines.select(F.when(low, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(low, F.col("dst")).otherwise(F.col("src")).alias("dst"))
        twice = F.when(F.col("src") == F.col("dst"), 2).otherwise(1)
        return lines.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).withColumn("times", F.col("times") * twice)

    def _entry_degrees(self, entries: DataFrame) -> DataFrame:
        """id, degree of the vertices with out-edges; entries as _entries() gives them."""
        ends = entries.select(F.col("src").alias("id"), "times")
        if not self.directed:
            ends = ends.unionAll(entries.filter("NOT src <=> dst").select("dst", "times"))
        return ends.filter("id IS NOT NULL").groupBy("id").agg(F.sum("times").alias("degree"))

    def _oriented_entries(self, entries: DataFrame, degrees: DataFrame) -> DataFrame:
        """src, dst, times of the entries, without null ends, towards the vertex with the higher (degree, id); loops stay."""
        d = F.broadcast(degrees) if degrees.count() <= FEW else degrees
        e = entries
        for end, degree in (("src", "ds"), ("dst", "dd")):
            e = e.join(d.select(F.col("id").alias(end), F.col("degree").alias(degree)), end, "left")
        ds, dd = (F.coalesce(c, F.lit(0)) for c in ("ds", "dd"))
        up = (dd > ds) | ((dd == ds) & (F.col("dst") >= F.col("src")))
        if self.directed:
            return e.filter(up).select("src", "dst", "times")
        return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"), "times")

    def triangles(self, parity: bool = False) -> DataFrame:
        """n: triangles. Each wedge starts at its lowest vertex, whose out-degree the orientation bounds by the square root of
        the edges, is made once, with its ends in order, and all wedges of an edge move as one list. Repeated lines and loops don't count; with parity they do: each
        oriented entry v-u adds, for each w, the lesser number of entries v-w and u-w; there wedges don't move at all, but blocks of edges (wedges.py)."""
        if parity:
            e = materialize(self._entries(), "entries")
            d = materialize(self._entry_degrees(e), "degrees")
            linked = e.filter("src IS NOT NULL AND dst IS NOT NULL")
            groups = groups_for(linked, e.count())
            n = materialize(weighted_triangles(self._oriented_entries(linked, d), groups), "counts")
            remove(e)
            remove(d)
            return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
        ordered = F.sort_array(F.collect_set(F.struct("dd", "dst")))
        after = materialize(self.oriented().filter("src <> dst").groupBy("src").agg(F.transform(ordered,
            lambda x: x["dst"]).alias("others")), "oriented")
        # Each neighbour gets what follows it in the list, and counts how much of that its own list holds.
        wedges = after.select(F.posexplode("others").alias("at", "dst"), "others").select("dst",
            F.slice("others", F.col("at") + 2, F.size("others")).alias("ends"))
        met = wedges.filter(F.size("ends") > 0).join(after.select(F.col("src").alias("dst"), "others"), "dst")
        return met.agg(F.coalesce(F.sum(F.size(F.array_intersect("ends", "others"))), F.lit(0)).cast("long").alias("n"))

    def reached(self, start: int | None = None) -> DataFrame:
        """id, depth of what out-edges reach from start (the lowest id)."""
        frontier = self.vertices.agg(F.min("id").alias("id")) if start is None else self.vertices.filter(F.col("id") == start)
        seen = materialize(frontier.filter("id IS NOT NULL").select("id", F.lit(0).alias("depth")), "seen")
        out, frontier, depth = seen, seen, 0
        links = materialize(self.edges.select("src", "dst").distinct(), "links")
        while not frontier.isEmpty():
            depth += 1
            new = links.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
            frontier = materialize(new.join(out.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")), "frontier")
            out = out.unionAll(frontier)
        return out

    def _lowest(self, links: DataFrame, name: str) -> DataFrame:
        """id, name: the lowest id from which links (src, dst, distinct) lead to the vertex. The lowest label of what points to it, then that label's label, until nothing changes."""
        links = materialize(links, "links")
        labels = materialize(self.vertices.select("id", F.col("id").alias("label")), "labels")
        while True:
            near = links.join(labels.select(F.col("id").alias("src"), "label"),
                "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("near"))
            step = labels.select("id", "label").join(near, "id", "left").select("id", F.col("label").alias("old"),
                F.least("label", "near").alias("to"))
            jump = labels.select(F.col("id").alias("to"), F.col("label").alias("next"))
            now = materialize(step.join(jump, "to", "left").select("id", "old", F.least("to", "next").alias("label")), "labels")
            remove(labels)
            labels = now
            if now.filter("label <> old").isEmpty():
                remove(links)
                return labels.select("id", F.col("label").alias(name))

    def components(self) -> DataFrame:
        """id, component: the lowest id that edges, either way, connect."""
        return self._lowest(self.lines.select("src", "dst").unionAll(self.lines.select("dst", "src")).distinct(), "component")

    def discovered(self) -> DataFrame:
        """id, discovered, root of a search over out-edges that starts anew from the lowest undiscovered id until none is left.
        The start that finds a vertex is the lowest id that leads to it: whatever found that one would lead to the vertex too."""
        return self._lowest(self.edges.select("src", "dst").distinct(), "root").select("id", F.col("root").isNotNull().alias("discovered"), "root")

    def bitmap(self, found: DataFrame) -> DataFrame:
        """bucket, bits: the ids of found, packed."""
        return found.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))

    def repartitioned(self, most: int) -> DataFrame:
        """part, n_verts, n_edges after dealing the vertices, in order, to parts of at most `most`; n_edges sums adjacency lengths. Ranks come from range partitions' counts, so no task holds all vertices."""
        d = materialize(self.out_degrees().repartitionByRange("id").sortWithinPartitions("id").withColumn("_p", F.spark_partition_id()), "degrees")
        from pyspark.sql.window import Window

        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        base = d.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))  # a row for each partition
        rank = F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1
        dealt = d.withColumn("_r", rank).join(F.broadcast(base), "_p")
        return dealt.groupBy(((F.col("_base") + F.col("_r")) / most).cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n_verts"),
            F.sum("degree").alias("n_edges"))

    def pagerank(self, damping: float = 0.85, tolerance: float = 1e-6, most: int | None = None, rounds: int | None = None) -> DataFrame:
        """id, rank (they sum to 1): power iteration until the ranks move less than tolerance in all, or for just `rounds` rounds; more than `most` rounds are an error. Vertices without out-edges spread their rank evenly."""
        n = self.vertices.count()
        if not n:
            return self.vertices.select("id", F.lit(0.0).alias("rank"))
        d = materialize(self.out_degrees(), "degrees")
        # An edge carries the share of its source's rank that it passes on; repeated lines are one edge with a larger share.
        share = F.count(F.lit(1)) / F.first("degree")
        shares = self.edges.join(d.select(F.col("id").alias("src"), "degree"), "src").groupBy("src", "dst").agg(share.alias("share"))
        parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def written(df: DataFrame, by: str, tag: str, dealt: bool = False) -> DataFrame:
            """Large graphs' tables are dealt alike once, so that in a round only what vertices are given moves; a small one's buckets would be many tiny files."""
            return bucketed(df, by, parts, tag, dealt) if n >= MANY else materialize(df, tag)

        links = written(shares, "src", "links")
        ranks = written(d.select("id", "degree", F.lit(1.0 / n).alias("rank")), "id", "ranks")
        loose = d.filter("degree = 0").count() / n
        for k in count(1):  # a damping under 1 shrinks each move by it, so the end is reached
            given = links.join(ranks.select(F.col("id").alias("src"), "rank"),
                "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            fresh = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)
            step = ranks.select("id", "degree", "rank").join(given, "id", "left")
            now = written(step.select("id", "degree", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("moved")), "id", "ranks", dealt=True)
            moved, loose = now.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0))).first()
            remove(ranks)
            ranks = now
            if k == rounds or (rounds is None and moved < tolerance):
                remove(links)
                return ranks.select("id", "rank")
            if k == most:
                break
        raise RuntimeError(f"after {most} rounds the ranks still move by {tolerance} or more")
