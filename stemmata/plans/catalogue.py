"""Every operator as a query over the test tables, with SQL that says the same where SQL can.

Profiles: each vector of `embeddings` as 64 alleles (0 is missing), and each nation as 12 alleles made of its keys. Graphs: suppliers to
parts by `lineitem`, as a general digraph with parallel edges, or with parts numbered apart, which has no cycles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.functions import alleles as al
from stemmata.functions.distances import DIRECTIONAL, HAMMING, directional_hamming, hamming
from stemmata.operators import arborescence, complete, dynamic, graph, lsh, neighbour_joining, pairs, statistics, trees
from stemmata.runtime import work_path
from stemmata.sources import profiles as readers
from stemmata.sources.gone import without
from stemmata.streaming import graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What the SQL of queries starts from.
VIEWS = {
    "profiles": "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4) + 2 AS BIGINT)) AS alleles FROM embeddings",
    "nations": "SELECT CAST(n_nationkey AS BIGINT) AS id, list_transform(range(1, 13), lambda j: CAST((n_nationkey * (7 * j + 3) + n_regionkey * j * j) % 5 AS BIGINT)) AS alleles FROM nation",
    "edges": "SELECT l_suppkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS w, l_orderkey * 10 + l_linenumber AS ord FROM lineitem",
    "dag": "SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem",
    "pairs": "SELECT a.id AS src, b.id AS dst, CAST(list_sum(list_transform(list_zip(a.alleles, b.alleles), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS w FROM profiles a, profiles b WHERE a.id <> b.id",
    "directed": "SELECT a.id AS src, b.id AS dst, CAST(list_sum(list_transform(list_zip(a.alleles, b.alleles), lambda z: CASE WHEN z[2] IN (-1, 0) AND z[1] NOT IN (-1, 0) THEN 1 WHEN z[1] IN (-1, 0) AND z[2] NOT IN (-1, 0) THEN 0 WHEN z[1] > z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS w FROM profiles a, profiles b WHERE a.id <> b.id",
    "npairs": "SELECT a.id AS src, b.id AS dst, CAST(list_sum(list_transform(list_zip(a.alleles, b.alleles), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS w FROM nations a, nations b WHERE a.id <> b.id",
    "tree": "SELECT min(x.src) AS src, x.dst, CAST(x.dst AS BIGINT) AS w FROM (SELECT CAST((n_nationkey - 1) // 2 AS BIGINT) AS src, CAST(n_nationkey AS BIGINT) AS dst FROM nation WHERE n_nationkey > 0) x GROUP BY x.dst",
    "forest": "SELECT CAST(n_nationkey AS BIGINT) AS fid, CASE WHEN n_nationkey > 4 THEN CAST(n_nationkey // 3 AS BIGINT) END AS parent_fid, CAST(n_nationkey % 7 AS BIGINT) AS y FROM nation",
}


def _with(text: str, *names: str) -> str:
    order = ["profiles", "nations", "edges", "dag", "pairs", "directed", "npairs", "tree", "forest"]
    need = set(names)
    for name in reversed(order):
        if name in need:
            need |= {v for v in order if f" {v} " in f"{VIEWS[name]} ".replace(",", " ") and v != name}
    held = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order if v in need)
    return f"WITH RECURSIVE {held}{', ' if held and text.startswith('+') else ' ' if held else ''}{text.lstrip('+')}" if held else text


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query; SQL that starts with + goes on with its own common table expressions."""

    def registered(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _with(sql, *views)
        return f

    return registered


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: (F.floor(x.cast("double") * 4) + 2).cast("bigint")).alias("alleles"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    made = F.array(*[((key * (7 * j + 3) + region * j * j) % 5).cast("bigint") for j in range(1, 13)])
    return _read(spark, sf, "nation").select(key.cast("bigint").alias("id"), made.alias("alleles"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "lineitem")
    return rows.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def dag(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("src", (F.col("dst") + 1_000_000).alias("dst"), "w")


def tree(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return _read(spark, sf, "nation").where(key > 0).select(F.floor((key - 1) / 2).cast("bigint").alias("src"), key.alias("dst"), key.alias("w"))


def forest(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    return _read(spark, sf, "nation").select(key.alias("fid"), F.when(key > 4, F.floor(key / 3).cast("bigint")).alias("parent_fid"), (key % 7).alias("y"))


# Profiles


@query("profile_normalise", "SELECT event_id, CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9]+$') THEN coalesce(try_cast(trim(t) AS BIGINT), -1) ELSE -1 END AS allele FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' ?' WHEN event_id % 5 = 1 THEN 'N' WHEN event_id % 5 = 2 THEN ' ' || CAST(user_id AS VARCHAR) || ' ' WHEN event_id % 5 = 3 THEN CAST(value AS VARCHAR) ELSE '99999999999999999999' END AS t FROM events)")
def _(spark, sf):
    k = F.col("event_id") % 5
    token = F.when(k == 0, " ?").when(k == 1, "N").when(k == 2, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))).when(k == 3, F.col("value").cast("string")).otherwise("99999999999999999999")
    return _read(spark, sf, "events").select("event_id", al.normalise_allele(token).alias("allele"))


@query("missing_positions", "SELECT id, list_filter(range(0, len(alleles)), lambda i: alleles[i + 1] IN (-1, 0))::INTEGER[] AS places FROM profiles", "profiles")
def _(spark, sf):
    return profiles(spark, sf).select("id", al.missing_positions(F.col("alleles")).alias("places"))


@query("missing_by_locus", "SELECT CAST(pos - 1 AS INTEGER) AS pos, count(*) FILTER (a IN (-1, 0)) AS n_missing, count(*) AS n FROM (SELECT unnest(alleles) AS a, generate_subscripts(alleles, 1) AS pos FROM profiles) GROUP BY pos", "profiles")
def _(spark, sf):
    return statistics.missing_by_locus(profiles(spark, sf))


@query("compare_alleles", "SELECT id, CASE WHEN alleles[1] < alleles[2] THEN -1 WHEN alleles[1] > alleles[2] THEN 1 ELSE 0 END AS first_second, alleles[3] AS third, alleles = list_reverse(alleles) AS palindrome FROM profiles", "profiles")
def _(spark, sf):
    a = F.col("alleles")
    first_second = al.compare_at(a, F.slice(a, 2, 63), 0)
    return profiles(spark, sf).select("id", first_second.alias("first_second"), al.allele_at(a, 2).alias("third"), al.same_profile(a, F.reverse(a)).alias("palindrome"))


@query("nucleotide_pack", "SELECT id, seq, CASE WHEN regexp_matches(seq, '^[ACGT]*$') THEN array_to_string(list_transform(string_split(seq, ''), lambda c: CASE c WHEN 'A' THEN '00' WHEN 'C' THEN '01' WHEN 'G' THEN '10' ELSE '11' END), '') END AS bits FROM (SELECT id, array_to_string(list_transform(alleles, lambda a: CASE a WHEN 0 THEN CASE WHEN id % 2 = 0 THEN '?' ELSE 'A' END WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END), '') AS seq FROM profiles)", "profiles")
def _(spark, sf):
    letters = F.transform("alleles", lambda a: F.when(a == 0, F.when(F.col("id") % 2 == 0, "?").otherwise("A")).when(a == 1, "C").when(a == 2, "G").otherwise("T"))
    return profiles(spark, sf).select("id", F.array_join(letters, "").alias("seq")).select("id", "seq", al.pack_nucleotides(F.col("seq")).alias("bits"))


@query("padded_profiles", "SELECT id, list_concat(alleles[1:1 + id % 60], list_transform(range(0, 59 - id % 60), lambda i: CAST(0 AS BIGINT))) AS alleles FROM profiles", "profiles")
def _(spark, sf):
    short = F.slice("alleles", F.lit(1), (F.col("id") % 60 + 1).cast("int"))
    return profiles(spark, sf).select("id", al.padded(short, 60).alias("alleles"))


@query("valid_points", "SELECT id, id - 5 >= 0 AND len(alleles) > 0 AS valid FROM profiles", "profiles")
def _(spark, sf):
    return profiles(spark, sf).select("id", al.valid_point(F.col("id") - 5, F.col("alleles")).alias("valid"))


@query("positional_ids", "SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 + 100 AS id FROM customer")
def _(spark, sf):
    return pairs.numbered(_read(spark, sf, "customer"), ["c_nationkey", "c_custkey"], 100).select("c_custkey", "id")


# Distances and statistics


@query("hamming_pairs", "SELECT src, dst, w FROM pairs", "pairs")
def _(spark, sf):
    return pairs.all_pairs(profiles(spark, sf), HAMMING)


@query("directional_pairs", "SELECT src, dst, w FROM directed", "directed")
def _(spark, sf):
    return pairs.all_pairs(profiles(spark, sf), DIRECTIONAL)


@query("distance_columns", "SELECT p.src, p.dst, p.w AS hamming, d.w AS directional FROM npairs p JOIN (SELECT a.id AS src, b.id AS dst, CAST(list_sum(list_transform(list_zip(a.alleles, b.alleles), lambda z: CASE WHEN z[2] IN (-1, 0) AND z[1] NOT IN (-1, 0) THEN 1 WHEN z[1] IN (-1, 0) AND z[2] NOT IN (-1, 0) THEN 0 WHEN z[1] > z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS w FROM nations a, nations b) d USING (src, dst)", "npairs", "nations")
def _(spark, sf):
    rows = nations(spark, sf)
    a, b = rows.toDF("src", "u"), rows.toDF("dst", "v")
    return a.crossJoin(b).where("src <> dst").select("src", "dst", hamming(F.col("u"), F.col("v")).alias("hamming"), directional_hamming(F.col("u"), F.col("v")).alias("directional"))


@query("directional_asymmetry", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(CASE WHEN src < dst THEN w ELSE -w END) AS BIGINT) AS excess FROM directed GROUP BY ALL", "directed")
def _(spark, sf):
    return pairs.asymmetry(profiles(spark, sf), DIRECTIONAL)


@query("matrix_upper", "SELECT src, dst, w FROM pairs WHERE src < dst", "pairs")
def _(spark, sf):
    return pairs.upper_pairs(profiles(spark, sf))


@query("matrix_mirrored", "SELECT src, dst, w FROM npairs", "npairs")
def _(spark, sf):
    return pairs.mirrored(pairs.upper_pairs(nations(spark, sf)))


@query("graph_to_matrix", "SELECT least(src, dst) AS i, greatest(src, dst) AS j, CAST(max({'ord': ord, 'w': w}).w AS DOUBLE) AS d FROM edges WHERE src <> dst GROUP BY ALL", "edges")
def _(spark, sf):
    return pairs.to_matrix(edges(spark, sf))


@query("incremental_pairs", "SELECT src, dst, w FROM pairs WHERE src >= 450 OR dst >= 450", "pairs")
def _(spark, sf):
    rows = profiles(spark, sf)
    return pairs.incremental_pairs(rows.where("id >= 450"), rows.where("id < 450"))


@query("distance_stats", "SELECT CAST(count(*) AS BIGINT) AS n, max(w) AS max, min(w) AS min, round(avg(w), 9) AS mean, CAST(median(w) AS DOUBLE) AS median, (SELECT w FROM (SELECT w, count(*) AS c FROM directed WHERE src < dst GROUP BY w) ORDER BY c DESC, w LIMIT 1) AS mode FROM directed WHERE src < dst", "directed")
def _(spark, sf):
    return statistics.distance_stats(profiles(spark, sf), DIRECTIONAL).withColumn("mean", F.round("mean", 9)).withColumn("median", F.col("median").cast("double"))


@query("distance_histogram", "SELECT w, CAST(count(*) AS BIGINT) AS n FROM pairs WHERE src < dst GROUP BY w", "pairs")
def _(spark, sf):
    return pairs.distance_histogram(profiles(spark, sf))


@query("nearest_profiles", "SELECT x.s AS src, dst, x.w AS w FROM (SELECT dst, min({'w': w, 's': src}) AS x FROM pairs GROUP BY dst)", "pairs")
def _(spark, sf):
    return pairs.nearest(profiles(spark, sf))


_ENTROPY = "+counts AS (SELECT CAST(pos - 1 AS INTEGER) AS pos, a, count(*) AS n FROM (SELECT unnest(alleles) AS a, generate_subscripts(alleles, 1) AS pos FROM profiles) GROUP BY ALL), entropies AS (SELECT pos, round(-sum(n / total * log2(n / total)), 9) + 0.0 AS entropy FROM (SELECT pos, n, sum(n) OVER (PARTITION BY pos) AS total FROM counts) GROUP BY pos) "


@query("locus_entropy", _ENTROPY + "SELECT pos, entropy FROM entropies", "profiles")
def _(spark, sf):
    return statistics.locus_entropy(profiles(spark, sf)).withColumn("entropy", F.round("entropy", 9))


@query("top_entropy_loci", _ENTROPY + "SELECT pos, entropy FROM entropies ORDER BY entropy DESC, pos LIMIT 10", "profiles")
def _(spark, sf):
    return statistics.top_entropy(statistics.locus_entropy(profiles(spark, sf)).withColumn("entropy", F.round("entropy", 9)), 10)


# Graphs


@query("incoming_edges", "SELECT src, dst, w FROM edges WHERE dst = 7", "edges")
def _(spark, sf):
    return graph.incoming(edges(spark, sf), 7).select("src", "dst", "w")


@query("incoming_up_to", "SELECT src, dst, w FROM edges WHERE dst = 7 AND dst <= 9", "edges")
def _(spark, sf):
    return graph.incoming(edges(spark, sf), 7, up_to=9).select("src", "dst", "w")


@query("outgoing_edges", "SELECT src, dst, w FROM edges WHERE src = 3 AND dst <> 3", "edges")
def _(spark, sf):
    return graph.outgoing(edges(spark, sf), 3).select("src", "dst", "w")


@query("edges_up_to", "SELECT src, dst, w FROM edges WHERE src = 3 AND dst <> 3 AND dst <= 50", "edges")
def _(spark, sf):
    return graph.outgoing(edges(spark, sf), 3, up_to=50).select("src", "dst", "w")


@query("adjacency", "SELECT src, dst, min({'ord': ord, 'w': w}).w AS w FROM edges GROUP BY src, dst", "edges")
def _(spark, sf):
    return graph.adjacency(edges(spark, sf))


@query("edge_exists", "SELECT s_suppkey AS src, CAST(s_nationkey AS BIGINT) AS dst FROM supplier WHERE EXISTS (SELECT 1 FROM edges e WHERE e.src = s_suppkey AND e.dst = s_nationkey)", "edges")
def _(spark, sf):
    wanted = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    return graph.existing(edges(spark, sf), wanted)


@query("edge_counts", "SELECT dst, count(*) AS n FROM edges GROUP BY dst", "edges")
def _(spark, sf):
    return graph.edge_counts(edges(spark, sf))


@query("edge_order", "SELECT src, dst, w FROM edges ORDER BY w, src, dst", "edges")
def _(spark, sf):
    return graph.ordered_edges(edges(spark, sf).select("src", "dst", "w"))


@query("isolated_nodes", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)", "edges")
def _(spark, sf):
    return graph.isolated(_read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), edges(spark, sf))


@query("graph_add_batch", "SELECT src, dst, w FROM edges UNION ALL SELECT o_custkey, o_custkey + 1, CAST(floor(o_totalprice) AS BIGINT) FROM orders", "edges")
def _(spark, sf):
    new = _read(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.floor("o_totalprice").cast("bigint").alias("w"))
    return graph.add_edges(edges(spark, sf).select("src", "dst", "w"), new)


@query("node_upsert", "SELECT id, alleles FROM nations WHERE id NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT CAST(r_regionkey AS BIGINT), [CAST(r_regionkey AS BIGINT)] FROM region", "nations")
def _(spark, sf):
    new = _read(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.array(F.col("r_regionkey").cast("bigint")).alias("alleles"))
    return graph.add_nodes(nations(spark, sf), new)


@query("graph_remove_batch", "SELECT src, dst, w FROM edges WHERE src NOT IN (SELECT n_nationkey FROM nation) AND dst NOT IN (SELECT n_nationkey FROM nation)", "edges")
def _(spark, sf):
    ids = _read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    nodes = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return graph.remove_nodes(nodes, edges(spark, sf), ids)[1].select("src", "dst", "w")


@query("remove_incoming", "SELECT src, dst, w FROM edges WHERE dst NOT IN (SELECT n_nationkey FROM nation)", "edges")
def _(spark, sf):
    return graph.remove_incoming(edges(spark, sf), _read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))).select("src", "dst", "w")


@query("remove_outgoing", "SELECT src, dst, w FROM edges WHERE src NOT IN (SELECT n_nationkey FROM nation)", "edges")
def _(spark, sf):
    return graph.remove_outgoing(edges(spark, sf), _read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))).select("src", "dst", "w")


@query("remove_one_parallel_edge", "SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ord, w) AS n FROM edges) WHERE n > 1", "edges")
def _(spark, sf):
    all_ = edges(spark, sf)
    return graph.remove_edges(all_, all_.select("src", "dst").distinct(), ["ord", "w"]).select("src", "dst", "w")


_LABELS = "+labels AS (SELECT DISTINCT v, v % 10 AS c, v % 4 AS off FROM (SELECT src AS v FROM edges UNION SELECT dst FROM edges)), charged AS (SELECT e.src, e.dst, e.w, a.c AS csrc, b.c AS cdst, e.w + b.off AS adj FROM edges e JOIN labels a ON a.v = e.src JOIN labels b ON b.v = e.dst) "


def _labels(all_: DataFrame) -> DataFrame:
    ends = all_.select(F.col("src").alias("v")).unionByName(all_.select(F.col("dst").alias("v"))).distinct()
    return ends.select("v", (F.col("v") % 10).alias("c"), (F.col("v") % 4).alias("off"))


@query("min_in_edge", "SELECT dst, x.w AS w, x.s AS src FROM (SELECT dst, min({'w': w, 's': src}) AS x FROM edges GROUP BY dst)", "edges")
def _(spark, sf):
    return graph.min_in_edges(edges(spark, sf).select("src", "dst", "w"))


@query("adjusted_weights", _LABELS + "SELECT src, dst, w, adj FROM charged", "edges")
def _(spark, sf):
    all_ = edges(spark, sf).select("src", "dst", "w")
    return graph.adjusted(all_, _labels(all_).select("v", "off"))


@query("cross_component_edges", _LABELS + "SELECT src, dst, w, csrc, cdst FROM charged WHERE csrc <> cdst", "edges")
def _(spark, sf):
    all_ = edges(spark, sf).select("src", "dst", "w")
    return graph.labelled(all_, _labels(all_).select("v", "c")).where("csrc <> cdst")


@query("min_safe_edge_scc", _LABELS + "SELECT cdst, x.adj AS adj, x.s AS src, x.d AS dst FROM (SELECT cdst, min({'adj': adj, 's': src, 'd': dst}) AS x FROM charged WHERE csrc <> cdst GROUP BY cdst)", "edges")
def _(spark, sf):
    all_ = edges(spark, sf).select("src", "dst", "w")
    labels = _labels(all_)
    return graph.min_safe_edges(all_, labels.select("v", "c"), labels.select("v", "off")).select("cdst", "adj", "src", "dst")


@query("max_cycle_edge", "SELECT x.s AS src, x.d AS dst, x.w AS w FROM (SELECT max({'w': w, 's': src, 'd': dst}) AS x FROM edges)", "edges")
def _(spark, sf):
    return graph.max_in_cycle(edges(spark, sf))


@query("component_members", _LABELS + "SELECT c, list_sort(list(DISTINCT v)) AS vs FROM labels GROUP BY c", "edges")
def _(spark, sf):
    return graph.members(_labels(edges(spark, sf)).select("v", "c"))


@query("tree_cost", "SELECT CAST(sum(w) AS BIGINT) AS cost FROM tree", "tree")
def _(spark, sf):
    return graph.cost(tree(spark, sf))


@query("graph_counts", "SELECT count(DISTINCT v) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, max(v) + 1 AS next_id FROM (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges)", "edges")
def _(spark, sf):
    all_ = edges(spark, sf)
    ends = all_.select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.agg(F.countDistinct("v").alias("n_nodes"), (F.count("*") / 2).cast("bigint").alias("n_edges"), (F.max("v") + 1).alias("next_id"))


# Hashing


_SAMPLES = lsh.draw(6, 4, low=0, high=64)
_KEYS = "+bucketed AS (" + " UNION ALL ".join(f"SELECT id, alleles, {t} AS tbl, [{', '.join(f'alleles[{i + 1}]' for i in s)}] AS key FROM profiles" for t, s in enumerate(_SAMPLES)) + ")"
_FOUND = _KEYS + ", found AS (SELECT q, cand, min(tbl) AS tbl, min(w) AS w FROM (SELECT a.id AS q, b.id AS cand, a.tbl, CAST(list_sum(list_transform(list_zip(a.alleles, b.alleles), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS BIGINT) AS w FROM bucketed a JOIN bucketed b ON a.tbl = b.tbl AND a.key = b.key AND a.id <> b.id) WHERE w <= 40 GROUP BY q, cand) "


@query("lsh_buckets", _KEYS + " SELECT id, tbl, key FROM bucketed", "profiles")
def _(spark, sf):
    return lsh.buckets(profiles(spark, sf), _SAMPLES).select("id", "tbl", "key")


@query("lsh_candidates", _FOUND + "SELECT q, cand, w, tbl FROM found", "profiles")
def _(spark, sf):
    table = lsh.buckets(profiles(spark, sf), _SAMPLES)
    return lsh.candidates(table, table, 40)


@query("lsh_first_k", _FOUND + "SELECT q, cand, w, tbl, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tbl, cand) AS place FROM found) WHERE place <= 3", "profiles")
def _(spark, sf):
    table = lsh.buckets(profiles(spark, sf), _SAMPLES)
    return lsh.first_k(lsh.candidates(table, table, 40, k=3), 3)


@query("knn_directed_graph", _FOUND + "SELECT cand AS src, q AS dst, w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tbl, cand) AS place FROM found WHERE cand < q) WHERE place <= 3", "profiles")
def _(spark, sf):
    return lsh.knn_graph(profiles(spark, sf), _SAMPLES, 3, 40)


@query("neighbour_edges", _FOUND + "SELECT cand AS src, q AS dst, w FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tbl, cand) AS place FROM found WHERE q = 77) WHERE place <= 5", "profiles")
def _(spark, sf):
    return lsh.neighbour_edges(profiles(spark, sf), _SAMPLES, 77, 5, 40)


# Arborescences


_PRIM = "+steps AS (SELECT CAST(0 AS BIGINT) AS n, [0::BIGINT] AS held, CAST(0 AS BIGINT) AS cost UNION ALL SELECT s.n + 1, list_append(s.held, x.v), s.cost + x.w FROM steps s, LATERAL (SELECT dst AS v, w FROM npairs p WHERE list_contains(s.held, p.src) AND NOT list_contains(s.held, p.dst) ORDER BY w, dst LIMIT 1) x) SELECT max(cost) AS cost FROM steps"
_SPAN = "+spans AS (SELECT t, id, id AS far FROM nations, range(0, 13) r(t) UNION SELECT s.t, s.id, p.dst FROM spans s JOIN npairs p ON p.src = s.far AND p.w <= s.t) SELECT CAST(sum(n - 1) AS BIGINT) AS cost FROM (SELECT t, count(DISTINCT least_far) AS n FROM (SELECT t, id, min(far) AS least_far FROM spans GROUP BY t, id) GROUP BY t)"


@query("mwa_symmetric_cost", _SPAN, "npairs", "nations")
def _(spark, sf):
    """Of a symmetric graph the minimum spanning tree costs as much: components at each distance tell its cost."""
    return graph.cost(arborescence.minimum_arborescence(pairs.all_pairs(nations(spark, sf))))


@query("mwa_acyclic", "SELECT x.s AS src, dst, x.w AS w FROM (SELECT dst, min({'w': w, 's': src}) AS x FROM dag GROUP BY dst)", "dag")
def _(spark, sf):
    return arborescence.minimum_arborescence(dag(spark, sf))


@query("mwa_directed")
def _(spark, sf):
    return complete.minimum_complete(profiles(spark, sf), DIRECTIONAL)


@query("mwa_on_demand")
def _(spark, sf):
    found = complete.minimum_complete(profiles(spark, sf))
    return trees.validate(found, None, profiles(spark, sf))


@query("mwa_approx")
def _(spark, sf):
    from stemmata.plans.commands import approximate_tree

    return approximate_tree(profiles(spark, sf), _SAMPLES, 40, 8, HAMMING)


@query("mwa_forest")
def _(spark, sf):
    return arborescence.minimum_arborescence(edges(spark, sf).select("src", "dst", "w"))


def _optimum(rows: str, doublings: int = 11) -> str:
    """SQL of (cost, n_edges) of the minimum arborescence, or forest of fewest trees, of the graph that `rows` selects (src, dst, w).

    By duality: in each round every component's lightest incoming edge, and components on cycles of these become one, whose incoming edges cost less by what the members were charged.
    The charges sum up to the cost; no tree is built. Cycles are found by doubling pointers, so paths of edges may have 2 ** doublings steps.
    """
    round_ = [
        "now AS MATERIALIZED (SELECT * FROM walk WHERE NOT done)",
        "best AS MATERIALIZED (SELECT c, min(x) AS x FROM (SELECT b.c, {'adj': e.w + b.off, 's': e.src, 'd': e.dst, 'cs': a.c} AS x FROM links e JOIN now a ON a.v = e.src JOIN now b ON b.v = e.dst WHERE a.c <> b.c "
        "UNION ALL SELECT c, {'adj': big + off, 's': -1, 'd': v, 'cs': -1} FROM now, big) GROUP BY c)",
        "j0 AS MATERIALIZED (SELECT c, x.cs AS t FROM best)",
        *[f"j{k + 1} AS MATERIALIZED (SELECT a.c, coalesce(b.t, -1) AS t FROM j{k} a LEFT JOIN j{k} b ON b.c = a.t)" for k in range(doublings)],
        f"m0 AS MATERIALIZED (SELECT c, t, least(c, t) AS l FROM j0 WHERE c IN (SELECT t FROM j{doublings}))",
        *[f"m{k + 1} AS MATERIALIZED (SELECT a.c, b.t, least(a.l, b.l) AS l FROM m{k} a JOIN m{k} b ON b.c = a.t)" for k in range(doublings)],
        f"gain AS MATERIALIZED (SELECT count(*) FILTER (c IN (SELECT c FROM m{doublings})) AS n, coalesce(sum(x.adj) FILTER (c IN (SELECT c FROM m{doublings})), 0) AS inner_, sum(x.adj) AS whole, count(*) FILTER (x.cs = -1) AS roots FROM best)",
    ]
    step = f"SELECT now.v, coalesce(m.l, now.c), CASE WHEN n = 0 THEN roots WHEN m.c IS NULL THEN now.off ELSE now.off - b.x.adj END, CASE WHEN n = 0 THEN paid + whole - roots * big ELSE paid + inner_ END, n = 0 FROM now LEFT JOIN m{doublings} m ON m.c = now.c LEFT JOIN best b ON b.c = now.c, gain, big"
    kinds = "CAST(v AS BIGINT) AS v, CAST(v AS BIGINT) AS c, CAST(0 AS HUGEINT) AS off, CAST(0 AS HUGEINT) AS paid, false AS done"
    return (
        f"+given AS ({rows}), links AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM given WHERE src <> dst GROUP BY src, dst), big AS MATERIALIZED (SELECT 1 + 2 * sum(abs(w)) AS big FROM links), "
        f"walk(v, c, off, paid, done) AS (SELECT {kinds} FROM (SELECT src AS v FROM links UNION SELECT dst FROM links) UNION ALL (WITH {', '.join(round_)} {step})) "
        "SELECT CAST(max(paid) AS BIGINT) AS cost, CAST(count(*) - max(off) AS BIGINT) AS n_edges FROM walk WHERE done"
    )


def _paid(tree: DataFrame) -> DataFrame:
    return tree.agg(F.sum("w").alias("cost"), F.count("*").alias("n_edges"))


_LINES = "SELECT src, dst, w FROM edges"


@query("mwa_forest_cost", _optimum(_LINES), "edges")
def _(spark, sf):
    return _paid(arborescence.minimum_arborescence(edges(spark, sf).select("src", "dst", "w")))


_LOOPS = "SELECT src, dst, w FROM dag UNION ALL SELECT l_partkey + 1000000, l_suppkey, 60 + l_linenumber FROM lineitem WHERE l_suppkey % 10 = 3"


def _loops(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers to parts, and back to every tenth supplier: a graph whose cycles nest a few times."""
    back = _read(spark, sf, "lineitem").where("l_suppkey % 10 = 3").select((F.col("l_partkey") + 1_000_000).alias("src"), F.col("l_suppkey").alias("dst"), (60 + F.col("l_linenumber")).cast("bigint").alias("w"))
    return dag(spark, sf).unionByName(back)


@query("mwa_rounds_cost", _optimum(_LOOPS), "dag")
def _(spark, sf):
    """Without the task that ends the work: rounds of joins alone."""
    return _paid(arborescence.minimum_arborescence(_loops(spark, sf), kernel_edges=0))


@query("mwa_directed_cost", _optimum("SELECT src, dst, w FROM directed"), "directed")
def _(spark, sf):
    return _paid(complete.minimum_complete(profiles(spark, sf), DIRECTIONAL))


@query("mwa_on_demand_cost", _optimum("SELECT src, dst, w FROM pairs"), "pairs")
def _(spark, sf):
    return _paid(complete.minimum_complete(profiles(spark, sf)))


# Trees


@query("arborescence_validate", "SELECT CAST(25 AS BIGINT) AS n_nodes, count(*) AS n_edges, CAST(0 AS BIGINT) AS foreign, CAST(0 AS BIGINT) AS crowded, CAST(1 AS BIGINT) AS n_roots, CAST(25 AS BIGINT) AS n_reached, true AS valid FROM tree", "tree")
def _(spark, sf):
    held = tree(spark, sf)
    return trees.validate(held, held, nations(spark, sf))


_LEVELS = "+levels AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS INTEGER) AS level UNION ALL SELECT t.dst, l.level + 1 FROM levels l JOIN tree t ON t.src = l.id) "


@query("bfs_levels", _LEVELS + "SELECT id, level FROM levels", "tree")
def _(spark, sf):
    return trees.reach(tree(spark, sf), spark.createDataFrame([(0,)], "id bigint"))


@query("tree_depths", _LEVELS + "SELECT id, CAST(0 AS BIGINT) AS root, CAST(level AS BIGINT) AS depth FROM levels", "tree")
def _(spark, sf):
    return trees.depths(tree(spark, sf))


_ANC = "+above AS (SELECT fid, fid AS anc, 0 AS dist FROM forest UNION ALL SELECT a.fid, f.parent_fid, a.dist + 1 FROM above a JOIN forest f ON f.fid = a.anc WHERE f.parent_fid IS NOT NULL) "


@query("forest_ancestors", _ANC + "SELECT fid, anc, dist FROM above", "forest")
def _(spark, sf):
    return trees.ancestors(forest(spark, sf)).select("fid", "anc", "dist")


@query("forest_lca", _ANC + "SELECT p.fid AS a, q.fid AS b, (SELECT arg_min(x.anc, x.dist) FROM above x JOIN above y ON x.anc = y.anc WHERE x.fid = p.fid AND y.fid = q.fid) AS lca FROM forest p, forest q WHERE p.fid < q.fid", "forest")
def _(spark, sf):
    held = forest(spark, sf)
    a, b = held.select(F.col("fid").alias("a")), held.select(F.col("fid").alias("b"))
    return trees.lowest_common_ancestor(held, a.crossJoin(b).where("a < b"))


@query("reduction_quantities", _ANC + "SELECT a.fid, CAST(sum(f.y) AS BIGINT) AS r FROM above a JOIN forest f ON f.fid = a.anc GROUP BY a.fid", "forest")
def _(spark, sf):
    return trees.reduction_quantities(forest(spark, sf)).select("fid", "r")


@query("candidate_ancestors", _ANC + "SELECT f.fid, a.dist, f.y FROM above a JOIN forest f ON f.fid = a.anc WHERE a.fid = 23 AND f.y > 1", "forest")
def _(spark, sf):
    return trees.candidate_ancestors(forest(spark, sf).withColumn("w", F.col("y")), 23, 1).select("fid", "dist", "y")


_LEAF = "fid NOT IN (SELECT parent_fid FROM forest WHERE parent_fid IS NOT NULL)"


def _leafed(spark: SparkSession, sf: str) -> DataFrame:
    """The forest with its leaves as the simple nodes."""
    held = forest(spark, sf)
    above = held.where("parent_fid IS NOT NULL").select(F.col("parent_fid").alias("fid"), F.lit(False).alias("leaf")).distinct()
    return held.join(above, "fid", "left").withColumn("is_simple", F.coalesce("leaf", F.lit(True))).drop("leaf")


@query("contracted_sets", _ANC + f"SELECT anc AS fid, fid AS v FROM above WHERE dist > 0 AND {_LEAF}", "forest")
def _(spark, sf):
    return trees.contracted_sets(_leafed(spark, sf))


@query("contracted_with", _ANC + "SELECT anc AS fid FROM above WHERE dist > 0 AND fid IN (20, 23) GROUP BY anc HAVING count(DISTINCT fid) = 2", "forest")
def _(spark, sf):
    return trees.contracted_with(forest(spark, sf), 20, 23).select("fid")


@query("potentials", _ANC + f"SELECT a.fid AS v, CAST(sum(f.y) AS BIGINT) AS off FROM above a JOIN forest f ON f.fid = a.anc WHERE a.{_LEAF} GROUP BY a.fid", "forest")
def _(spark, sf):
    return trees.potentials(_leafed(spark, sf).withColumn("v", F.when(F.col("is_simple"), F.col("fid"))))


@query("forest_of_edge", "SELECT fid FROM forest WHERE fid % 4 = 1 AND y > 2", "forest")
def _(spark, sf):
    held = forest(spark, sf).select("fid", "parent_fid", (F.col("fid") % 4).alias("src"), F.col("y").alias("dst"))
    wanted = spark.range(3, 7).select(F.lit(1).cast("bigint").alias("src"), F.col("id").alias("dst"))
    return trees.forest_of_edge(held, wanted).select("fid")


@query("decompose_roots", _ANC + ", gone AS (SELECT DISTINCT anc FROM above WHERE fid IN (20, 23) AND dist > 0) SELECT fid, CASE WHEN parent_fid NOT IN (SELECT anc FROM gone) THEN parent_fid END AS parent_fid FROM forest WHERE fid NOT IN (SELECT anc FROM gone)", "forest")
def _(spark, sf):
    return trees.decompose(forest(spark, sf), spark.createDataFrame([(20,), (23,)], "fid bigint")).select("fid", "parent_fid")


_CC = "+links AS (SELECT CAST(c_custkey + 1000 AS BIGINT) AS a, CAST(c_nationkey AS BIGINT) AS b FROM customer), reached AS (SELECT v, v AS far FROM (SELECT a AS v FROM links UNION SELECT b FROM links) UNION SELECT r.v, l.b FROM reached r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.far) SELECT v, min(far) AS c FROM reached GROUP BY v"


@query("connected_components", "WITH RECURSIVE " + _CC.lstrip("+"))
def _(spark, sf):
    links = _read(spark, sf, "customer").select((F.col("c_custkey") + 1000).alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
    return trees.connected_components(links)


# Neighbour joining


_MATRIX = "+matrix AS (SELECT src AS i, dst AS j, CAST(w AS DOUBLE) AS d FROM npairs WHERE src < dst), sums AS (SELECT src AS i, CAST(sum(w) AS DOUBLE) AS r FROM npairs GROUP BY src), q AS (SELECT m.i, m.j, m.d, 23 * m.d - a.r - b.r AS q, a.r AS ri, b.r AS rj FROM matrix m JOIN sums a ON a.i = m.i JOIN sums b ON b.i = m.j) "


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.upper_pairs(nations(spark, sf)).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("d"))


@query("nj_row_sums", _MATRIX + "SELECT i, r FROM sums", "npairs")
def _(spark, sf):
    return neighbour_joining.row_sums(_matrix(spark, sf))


@query("nj_q_matrix", _MATRIX + "SELECT i, j, d, q FROM q", "npairs")
def _(spark, sf):
    return neighbour_joining.q_matrix(_matrix(spark, sf)).select("i", "j", "d", "q")


@query("nj_first_join", _MATRIX + "SELECT i, j, q, round(d / 2 + (ri - rj) / 46, 9) AS di, round(d - (d / 2 + (ri - rj) / 46), 9) AS dj FROM q ORDER BY q, i, j LIMIT 1", "npairs")
def _(spark, sf):
    return neighbour_joining.first_join(_matrix(spark, sf)).withColumn("di", F.round("di", 9)).withColumn("dj", F.round("dj", 9))


@query("nj_tree")
def _(spark, sf):
    return neighbour_joining.neighbour_joining(_matrix(spark, sf))


# Updates


def _state(spark: SparkSession, sf: str) -> dynamic.State:
    return dynamic.start(pairs.all_pairs(nations(spark, sf)))


def _costs(state: dynamic.State) -> DataFrame:
    return graph.cost(state.tree)


def _changed(rows: str) -> str:
    """Components at each weight of a symmetric graph whose edges `rows` changes."""
    return "+changed AS (" + rows + "), spans AS (SELECT t, id, id AS far FROM (SELECT DISTINCT src AS id FROM changed), range(0, 13) r(t) UNION SELECT s.t, s.id, p.dst FROM spans s JOIN changed p ON p.src = s.far AND p.w <= s.t) SELECT CAST(sum(n - 1) AS BIGINT) AS cost FROM (SELECT t, count(DISTINCT least_far) AS n FROM (SELECT t, id, min(far) AS least_far FROM spans GROUP BY t, id) GROUP BY t)"


@query("dyn_add_edge", _changed("SELECT src, dst, w FROM npairs UNION ALL SELECT 3, 9, 1 UNION ALL SELECT 9, 3, 1"), "npairs")
def _(spark, sf):
    return _costs(dynamic.add_edge(dynamic.add_edge(_state(spark, sf), 3, 9, 1), 9, 3, 1))


@query("dyn_remove_edge", _changed("SELECT src, dst, w FROM npairs WHERE NOT (src IN (0, 1) AND dst IN (0, 1))"), "npairs")
def _(spark, sf):
    return _costs(dynamic.remove_edge(dynamic.remove_edge(_state(spark, sf), 0, 1), 1, 0))


@query("dyn_update_edge", _changed("SELECT src, dst, CASE WHEN src IN (5, 6) AND dst IN (5, 6) THEN 2 ELSE w END AS w FROM npairs"), "npairs")
def _(spark, sf):
    return _costs(dynamic.update_edge(dynamic.update_edge(_state(spark, sf), 5, 6, 2), 6, 5, 2))


@query("dyn_add_node", _changed("SELECT src, dst, w FROM npairs UNION ALL SELECT 25, id, 3 + id % 4 FROM nations UNION ALL SELECT id, 25, 3 + id % 4 FROM nations"), "npairs", "nations")
def _(spark, sf):
    ids = nations(spark, sf).select("id", (3 + F.col("id") % 4).alias("w"))
    new = ids.select(F.lit(25).cast("bigint").alias("src"), F.col("id").alias("dst"), "w").unionByName(ids.select(F.col("id").alias("src"), F.lit(25).cast("bigint").alias("dst"), "w"))
    return _costs(dynamic.add_node(_state(spark, sf), 25, new))


@query("dyn_remove_node", _changed("SELECT src, dst, w FROM npairs WHERE src <> 4 AND dst <> 4"), "npairs")
def _(spark, sf):
    return _costs(dynamic.remove_node(_state(spark, sf), 4))


@query("dyn_batch", _changed("SELECT src, dst, CASE WHEN src + dst = 10 THEN 2 ELSE w END AS w FROM npairs WHERE NOT (src + dst = 20) AND src <> 24 AND dst <> 24"), "npairs")
def _(spark, sf):
    all_ = pairs.all_pairs(nations(spark, sf))
    log = all_.where("src + dst = 10").select(F.lit(1).cast("bigint").alias("seq"), F.lit("update").alias("op"), "src", "dst", F.lit(2).cast("bigint").alias("w"))
    log = log.unionByName(all_.where("src + dst = 20").select(F.lit(2).cast("bigint").alias("seq"), F.lit("remove").alias("op"), "src", "dst", "w"))
    log = log.unionByName(spark.createDataFrame([(3, "remove_node", 24, None, None)], dynamic.LOG))
    return _costs(dynamic.apply_updates(_state(spark, sf), log))


_GONE, _SET, _NODE = "(src + 3 * dst) % 11 = 4", "(src + 5 * dst) % 13 = 6", 17
_UPDATED = f"SELECT src, dst, w FROM edges WHERE NOT ({_GONE}) AND NOT ({_SET}) AND src <> {_NODE} AND dst <> {_NODE} UNION ALL SELECT DISTINCT src, dst, CAST(7 AS BIGINT) FROM edges WHERE NOT ({_GONE}) AND {_SET} AND src <> {_NODE} AND dst <> {_NODE}"


def _updated(spark: SparkSession, sf: str, kernel_edges: int) -> DataFrame:
    """One batch over the graph of lineitem: edges go, others get another weight, a node goes."""
    all_ = edges(spark, sf).select("src", "dst", "w")
    met = all_.select("src", "dst").distinct()
    log = met.where(_SET).select(F.lit(1).cast("bigint").alias("seq"), F.lit("update").alias("op"), "src", "dst", F.lit(7).cast("bigint").alias("w"))
    log = log.unionByName(met.where(_GONE).select(F.lit(2).cast("bigint").alias("seq"), F.lit("remove").alias("op"), "src", "dst", F.lit(None).cast("bigint").alias("w")))
    log = log.unionByName(spark.createDataFrame([(3, "remove_node", _NODE, None, None)], dynamic.LOG))
    return _paid(dynamic.apply_updates(dynamic.start(all_, None, kernel_edges), log).tree)


@query("dyn_lineitem", _optimum(_UPDATED), "edges")
def _(spark, sf):
    return _updated(spark, sf, arborescence.KERNEL_EDGES)


@query("dyn_hidden", _optimum(f"SELECT src, dst, w FROM edges WHERE NOT ({_GONE}) AND src <> {_NODE} AND dst <> {_NODE}"), "edges")
def _(spark, sf):
    """As if edges and a node were gone; the graph stays as it is."""
    all_ = edges(spark, sf).select("src", "dst", "w")
    node = spark.createDataFrame([(_NODE,)], "id bigint")
    return _paid(dynamic.without_for_now(dynamic.start(all_), all_.where(_GONE).select("src", "dst"), node).tree)


@query("min_in_edge_hidden", "SELECT dst, min(src) AS src, w FROM (SELECT src, dst, w, min(w) OVER (PARTITION BY dst) AS least FROM edges WHERE (src + dst) % 3 <> 1 AND NOT (src % 7 = 2 AND w < 20)) WHERE w = least GROUP BY dst, w", "edges")
def _(spark, sf):
    """The lightest edge into each part under an overlay of hidden edges: some by ends, some by weight too."""
    all_ = edges(spark, sf).select("src", "dst", "w")
    hidden = all_.where("(src + dst) % 3 = 1 OR src % 7 = 2 AND w < 20").distinct()
    notes = hidden.select(F.lit("edge").alias("kind"), "src", "dst", "w", F.lit(None).cast("bigint").alias("n"))
    return graph.min_in_edges(without(all_, notes)).select("src", "dst", "w")


@query("dyn_rounds", _optimum(f"SELECT src, dst, w FROM ({_LOOPS}) WHERE NOT (src = 1000007) UNION ALL SELECT 1000005, 3, 1"), "dag")
def _(spark, sf):
    """A part's outgoing edges go and one edge comes, by rounds of joins alone."""
    all_ = _loops(spark, sf)
    before = dynamic.start(all_, None, 0)
    added = spark.createDataFrame([(1000005, 3, 1)], "src bigint, dst bigint, w bigint")
    now = all_.where("src <> 1000007").unionByName(added)
    return _paid(dynamic.settled(before, before.nodes, now, all_.where("src = 1000007"), added).tree)


@query("dyn_lineitem_local", _optimum("SELECT src, dst, CASE WHEN src = 2 AND dst = 9 THEN 1 ELSE w END AS w FROM edges WHERE NOT (src = 5 AND dst = 3) UNION ALL SELECT 11, 4, 1"), "edges")
def _(spark, sf):
    """A few changes, which open a small part of the forest."""
    all_ = edges(spark, sf).select("src", "dst", "w")
    before = dynamic.start(all_)
    removed = all_.where("src = 5 AND dst = 3").unionByName(all_.where("src = 2 AND dst = 9"))
    added = all_.where("src = 2 AND dst = 9").select("src", "dst", F.lit(1).cast("bigint").alias("w")).unionByName(spark.createDataFrame([(11, 4, 1)], "src bigint, dst bigint, w bigint"))
    now = all_.where("NOT (src = 5 AND dst = 3) AND NOT (src = 2 AND dst = 9)").unionByName(added)
    return _paid(dynamic.settled(before, before.nodes, now, removed, added).tree)


_CHOICES = ", ".join(f"c{v} AS (SELECT graph, -1 AS p, 0 AS w FROM given UNION ALL SELECT graph, src, w FROM alive WHERE dst = {v})" for v in range(4))
_TRIED = " ".join(f"JOIN c{v} USING (graph)" for v in range(1, 4))


@query(
    "graph_stream",
    "+rows AS (SELECT l_orderkey // 50 AS graph, l_suppkey % 4 AS src, l_partkey % 4 AS dst, CAST(l_quantity AS BIGINT) AS w, l_orderkey * 10 + l_linenumber AS seq, l_linenumber % 5 = 4 AS gone FROM lineitem), "
    "given AS (SELECT graph, max(seq) AS seq FROM rows GROUP BY graph), "
    "nodes AS (SELECT graph, count(DISTINCT v) AS n_nodes FROM (SELECT graph, src AS v FROM rows WHERE NOT gone UNION ALL SELECT graph, dst FROM rows WHERE NOT gone) GROUP BY graph), "
    "alive AS (SELECT graph, src, dst, w FROM rows WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY graph, src, dst ORDER BY seq DESC, w DESC) = 1 AND NOT gone), "
    f"{_CHOICES}, tried AS (SELECT graph, [c0.p, c1.p, c2.p, c3.p] AS p, c0.w + c1.w + c2.w + c3.w AS w FROM c0 {_TRIED}), "
    "steps AS (SELECT graph, w, p, [list_reduce([v, 0, 0, 0, 0], lambda x, y: coalesce(p[x + 1], -1)) FOR v IN [0, 1, 2, 3]] AS ends FROM tried), "
    "best AS (SELECT graph, min({'roots': len(list_filter(p, lambda x: x = -1)), 'w': w}) AS x FROM steps WHERE list_max(ends) = -1 GROUP BY graph) "
    "SELECT CAST(graph AS BIGINT) AS graph, CAST(seq AS BIGINT) AS seq, CAST(coalesce(n_nodes, 0) AS BIGINT) AS n_nodes, CAST(4 - x.roots AS BIGINT) AS n_edges, CAST(x.w AS BIGINT) AS cost FROM best JOIN given USING (graph) LEFT JOIN nodes USING (graph)",
    "edges",
)
def _(spark, sf):
    """Each 50 order keys a graph of four nodes, their items a stream of edges that come and go; SQL tries all choices of edges."""
    path = f"{sf}/lineitem.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{{lineitem}}.parquet")  # a stream takes a file for a folder but by a pattern
    number, op = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.when(F.col("l_linenumber") % 5 == 4, "remove").otherwise("add")
    log = rows.select(F.floor(F.col("l_orderkey") / 50).alias("graph"), number.alias("seq"), op.alias("op"), (F.col("l_suppkey") % 4).alias("src"), (F.col("l_partkey") % 4).alias("dst"), F.col("l_quantity").cast("bigint").alias("w"))
    out = work_path(spark, "graphs")
    graphs.maintain_graphs(log, f"{out}/trees", f"{out}/progress").awaitTermination()
    return graphs.latest(spark, f"{out}/trees").select("graph", "seq", "n_nodes", "n_edges", "cost")


@query("incremental_batches", "SELECT CAST(b AS INTEGER) AS batch, count(*) AS n_edges, min(w) AS least FROM (SELECT unnest(range(CAST(greatest(src, dst) // 100 AS BIGINT), (SELECT CAST(max(id) // 100 + 1 AS BIGINT) FROM profiles))) AS b, w FROM pairs) GROUP BY b", "pairs")
def _(spark, sf):
    counts = pairs.pairs_by_largest(profiles(spark, sf), 100)
    upto = Window.orderBy("since")
    return counts.select(F.col("since").cast("int").alias("batch"), F.sum("n").over(upto).alias("n_edges"), F.min("w").over(upto).alias("least"))


# Logs and series


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM events")
def _(spark, sf):
    return statistics.moving_average(_read(spark, sf, "events"), "value", ["ts", "event_id"], 5, ["user_id"]).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("downsample", "SELECT user_id, CAST(n // 10 AS INTEGER) AS point, round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY ALL")
def _(spark, sf):
    out = statistics.downsample(_read(spark, sf, "events"), ["value", "event_id"], ["ts", "event_id"], 10, ["user_id"])
    return out.select("user_id", "point", F.round("value", 6).alias("value"), F.round("event_id", 6).alias("event_id"))


@query("moving_average_one_series", "SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 6) AS smoothed FROM events")
def _(spark, sf):
    return statistics.moving_average(_read(spark, sf, "events"), "value", ["ts", "event_id"], 101).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("downsample_one_series", "SELECT CAST(n // 50 AS INTEGER) AS point, round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM (SELECT value, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY ALL")
def _(spark, sf):
    out = statistics.downsample(_read(spark, sf, "events"), ["value", "event_id"], ["ts", "event_id"], 50)
    return out.select("point", F.round("value", 6).alias("value"), F.round("event_id", 6).alias("event_id"))


@query("axis_transform", "SELECT p_partkey, round(CASE WHEN p_size > 0 THEN p_size * log2(p_size) ELSE 0 END + p_size * p_size, 6) AS heap, CAST(p_size AS DOUBLE) * p_size * p_size AS plain, round(p_retailprice / 1048576, 12) AS mib, round(p_retailprice / 60000, 9) AS minutes FROM part")
def _(spark, sf):
    n, price = F.col("p_size"), F.col("p_retailprice")
    return _read(spark, sf, "part").select("p_partkey", F.round(statistics.complexity(n, "pairingHeap"), 6).alias("heap"), statistics.complexity(n, "stateless").alias("plain"), F.round(statistics.mebibytes(price), 12).alias("mib"), F.round(statistics.minutes_of_ms(price), 9).alias("minutes"))


@query("record_kinds", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'memory' WHEN event_id % 3 = 1 THEN 'runtime' END AS kind FROM events")
def _(spark, sf):
    k = F.col("event_id") % 3
    text = F.when(k == 0, '{"timestamp": 1, "heap": 2}').when(k == 1, '{"name": "a", "Inference time": [1]}').otherwise('{"k": 1}')
    return _read(spark, sf, "events").select("event_id", statistics.record_kind(text).alias("kind"))


@query("log_parse", "SELECT CAST(event_id AS INTEGER) AS iteration, CAST(floor(value) AS BIGINT) AS pre_process_ms, user_id AS inference_ms FROM events")
def _(spark, sf):
    rows = _read(spark, sf, "events")
    first = F.format_string("Iteration %d - Pre-process time (ms): %d", F.col("event_id"), F.floor("value"))
    second = F.format_string("Inference time (ms): %d", F.col("user_id"))
    one_line = F.col("event_id") % 2 == 0
    lines = rows.select(F.col("event_id"), F.when(one_line, F.array(F.concat(first, F.lit(", "), second))).otherwise(F.array(first, second)).alias("lines"))
    return readers.parse_runtime_lines(lines.select((F.col("event_id") % 16).alias("file"), F.posexplode("lines").alias("k", "value"), "event_id").select("file", (F.col("event_id") * 2 + F.col("k")).alias("ord"), "value"))
