"""Cases in which a table is much longer than what the work needs of it."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from stemmata import runtime
from stemmata.functions.distances import DIRECTIONAL, HAMMING, coded
from stemmata.operators import arborescence, dynamic, graph, lsh, pairs, trees

KIND = "src bigint, dst bigint, w bigint"


def _sunk(seed: int) -> list[tuple[int, int, int]]:
    """A graph of nested cycles among twelve vertices; many more edges lead to vertices that none leaves, through some that only those lie behind."""
    rng = random.Random(seed)
    core = [(rng.randrange(12), rng.randrange(12), rng.randrange(1, 9)) for _ in range(60)]
    behind = [(rng.randrange(12), 12 + rng.randrange(6), rng.randrange(1, 9)) for _ in range(40)]
    return core + behind + [(rng.randrange(18), 100 + rng.randrange(40), rng.randrange(1, 9)) for _ in range(600)]


def test_edges_into_vertices_that_none_leaves_need_no_rounds(spark):
    rows = _sunk(3)
    tree, forest = arborescence.infer(spark.createDataFrame(rows, KIND), None, 150)
    assert sorted(map(tuple, tree.collect())) == sorted(arborescence.arborescence_of(rows))
    assert forest.serial == 1


def test_pairs_of_buckets_are_not_shuffled(spark):
    """Large buckets in several parts: the pairs of brute force, each with its first table; no step but the last shuffles pairs."""
    rng = random.Random(5)
    rows = {n: [rng.choice((-1, 0, 1, 2, 300)) if j > 1 else rng.randrange(2) for j in range(8)] for n in range(90)}
    samples, radius = [[0, 1], [0, 2], [1]], 5
    profiles = spark.createDataFrame(list(rows.items()), "id bigint, alleles array<bigint>")
    table = lsh.buckets(profiles, samples)
    found = lsh.candidates(table, table, radius, DIRECTIONAL, part=7)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapCoGroups")
    lost = (-1, 0)
    cost = lambda u, v: sum(bool(y in lost) if (x in lost) != (y in lost) else x > y for x, y in zip(u, v, strict=True))
    want = set()
    for q, u in rows.items():
        for c, v in rows.items():
            tables = [t for t, s in enumerate(samples) if all(u[i] == v[i] for i in s)]
            if q != c and tables and cost(u, v) <= radius:
                want.add((q, c, cost(u, v), tables[0]))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    first = lsh.first_k(lsh.candidates(table, table, radius, DIRECTIONAL, k=3, part=7), 3).collect()
    for q in rows:
        assert [r["cand"] for r in sorted(first, key=lambda r: r["place"]) if r["q"] == q] == [c for _, c in sorted((t, c) for a, c, _, t in want if a == q)][:3]


def test_pairs_are_reduced_in_their_blocks(spark):
    """Negative ids, alleles of several widths, both distances: as brute force has it, and no shuffle of pairs."""
    rng = random.Random(6)
    rows = {n - 20: [rng.choice((-1, 0, 1, 2, 300, 1 << 40)) for _ in range(6)] for n in range(60)}
    profiles = spark.createDataFrame(list(rows.items()), "id bigint, alleles array<bigint>")
    lost = (-1, 0)
    cost = lambda u, v: sum(bool(y in lost) if (x in lost) != (y in lost) else x > y for x, y in zip(u, v, strict=True))
    way = {(s, d): cost(u, v) for s, u in rows.items() for d, v in rows.items() if s != d}
    excess = pairs.asymmetry(profiles, DIRECTIONAL, block=16)
    assert excess._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert sorted(map(tuple, excess.collect())) == sorted((s, d, w - way[d, s]) for (s, d), w in way.items() if s < d)
    assert {r["w"]: r["n"] for r in pairs.distance_histogram(profiles, DIRECTIONAL, 16).collect()} == Counter(w for (s, d), w in way.items() if s < d)
    assert {r["dst"]: (r["w"], r["src"]) for r in pairs.nearest(profiles, DIRECTIONAL, 16).collect()} == {d: min((way[s, d], s) for s in rows if s != d) for d in rows}
    groups = {(r["since"]): (r["n"], r["w"]) for r in pairs.pairs_by_largest(profiles, 10, DIRECTIONAL, 16).collect()}
    assert groups == {g: (len(x), min(x)) for g in range(-2, 4) if (x := [w for (s, d), w in way.items() if max(s, d) // 10 == g])}


def test_minima_are_kept_in_hash_tables(spark):
    """Ids and weights of both signs up to near the ends of their range, ties: as brute force has it, and no task sorts all its edges for a minimum."""
    rng = random.Random(8)
    ids = [-(1 << 63), -5, 0, 3, (1 << 63) - 1]
    rows = [(rng.choice(ids), rng.choice(ids), rng.choice((-(10**18), -2, 0, 1, 10**18))) for _ in range(80)]
    edges = spark.createDataFrame(rows, KIND)
    found = graph.min_in_edges(edges)
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted(map(tuple, found.select("dst", "w", "src").collect())) == sorted((d, *min((w, s) for s, e, w in rows if e == d)) for d in {d for _, d, _ in rows})
    part, off = {v: k % 2 for k, v in enumerate(ids)}, {v: k % 3 for k, v in enumerate(ids)}
    safe = graph.min_safe_edges(edges, spark.createDataFrame(list(part.items()), "v bigint, c bigint"), spark.createDataFrame(list(off.items()), "v bigint, off bigint"))
    want = [(c, *min((w + off[d], s, d, w, part[s]) for s, d, w in rows if part[d] == c != part[s])) for c in (0, 1)]
    assert sorted(map(tuple, safe.collect())) == want


def test_the_last_task_gets_one_edge_between_two_components(spark, monkeypatch):
    """Parallel edges, and edges into vertices that none leaves, stay with Spark also where they are few enough for the task that ends the work."""
    rows = _sunk(4) * 3
    met = []
    finish = arborescence._finish
    monkeypatch.setattr(arborescence, "CORE_EDGES", 150)
    monkeypatch.setattr(arborescence, "_finish", lambda charged, serial: (met.append(charged.count()), finish(charged, serial))[1])
    tree = arborescence.infer(spark.createDataFrame(rows, KIND))[0]
    assert sum(r["w"] for r in tree.collect()) == sum(w for *_, w in arborescence.arborescence_of(rows))
    assert len(met) == 1 and met[0] <= len({(s, d) for s, d, _ in rows if s < 18 and d < 18}) + 18


def test_cycles_among_many_components_do_not_go_through_the_driver(spark, monkeypatch):
    """Rings, trees that hang on them or on the root, and loops of two: as a walk finds them, also where no task may hold them all; what none leads to is left out at once."""
    rng = random.Random(9)
    step = {c: (c + 1 if c % 40 else c - 39) for c in range(1, 121)} | {c: rng.randrange(1, c) for c in range(121, 700)} | {700: 701, 701: 700}
    step |= {c: arborescence.ROOT if c < 720 else rng.randrange(702, c) for c in range(702, 900)}
    best = spark.createDataFrame(list(step.items()), "c bigint, csrc bigint")
    want = {c: (c - 1) // 40 * 40 + 1 for c in range(1, 121)} | {700: 700, 701: 700}
    plans, cut = [], arborescence.cut
    monkeypatch.setattr(arborescence, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(runtime, "SMALL", 0)
    for most in (0, 50, 300):
        plans.clear()
        monkeypatch.setattr(arborescence, "KERNEL_NODES", most)
        assert dict(map(tuple, arborescence._on_cycles(best).collect())) == want
        assert not any("Broadcast" in p for p in plans)
    assert 0 < len(plans) < 10


def test_an_update_does_not_send_the_forest_through_the_driver(spark, monkeypatch):
    """An edge to a new vertex comes: nodes and vertices are looked up by merged joins, and the tree is that of the changed graph."""
    rows, come = _sunk(7), (3, 150, 2)
    before = dynamic.start(spark.createDataFrame(rows, KIND))
    plans = []
    for held in (dynamic, trees):
        monkeypatch.setattr(held, "cut", lambda df, cut=held.cut: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(runtime, "SMALL", 0)
    trees.lifted(before.seed.nodes)
    assert plans and not any("Broadcast" in p for p in plans)
    plans.clear()
    now, new = spark.createDataFrame([*rows, come], KIND), spark.createDataFrame([come], KIND)
    nodes = before.nodes.unionByName(spark.createDataFrame([(150,)], "id bigint"))
    tree = dynamic.settled(before, nodes, now, new.limit(0), new).tree
    assert sum(r["w"] for r in tree.collect()) == sum(w for *_, w in arborescence.arborescence_of([*rows, come]))
    compared = [p for p in plans if "LeftAnti" in p and "src" not in p]  # vertices by their ids alone
    assert len(compared) == 2 and not any("Broadcast" in p for p in compared)


def test_new_profiles_are_measured_once_both_ways(spark):
    """Both distances, ids of both signs: as brute force has it; one step measures the ways to and from existing profiles."""
    rng = random.Random(10)
    rows = {n - 30: [rng.choice((-3, -1, 0, 1, 2, 300)) for _ in range(6)] for n in range(70)}
    profiles = spark.createDataFrame(list(rows.items()), "id bigint, alleles array<bigint>")
    lost = (-1, 0)
    cost = lambda u, v: sum(bool(y in lost) if (x in lost) != (y in lost) else x > y for x, y in zip(u, v, strict=True))
    apart = lambda u, v: sum(x != y for x, y in zip(u, v, strict=True))
    for distance, way in ((DIRECTIONAL, cost), (HAMMING, apart)):
        found = pairs.incremental_pairs(profiles.where("id >= 20"), profiles.where("id < 20"), distance)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
        assert sorted(map(tuple, found.collect())) == sorted((s, d, way(u, v)) for s, u in rows.items() for d, v in rows.items() if s != d and max(s, d) >= 20)


def test_a_task_gives_a_bounded_batch_of_edges(monkeypatch):
    """Blocks against themselves and others, in any order of ids, alleles above and below the missing ones: no batch has over OUT edges, and together they are those of brute force."""
    rng = random.Random(11)
    lost = (-1, 0)
    cost = lambda u, v: sum(bool(y in lost) if (x in lost) != (y in lost) else x > y for x, y in zip(u, v, strict=True))
    monkeypatch.setattr(pairs, "OUT", 64)
    for least in (-3, -1, 0):
        rows = {n: [rng.randrange(least, 4) for _ in range(9)] for n in rng.sample(range(-99, 99), 40)}
        blocks = [list(rows)[:25], list(rows)[25:]]
        kind = pa.list_(pa.struct([("id", pa.int64()), ("alleles", pa.list_(pa.int64()))]))
        held = [[{"id": n, "alleles": rows[n]} for n in b] for b in blocks]
        met = [(0, 0), (0, 1), (1, 1)]
        table = pa.RecordBatch.from_arrays([pa.array([held[i] for i, _ in met], kind), pa.array([held[j] for _, j in met], kind), pa.array([i == j for i, j in met])], ["one", "two", "same"])
        for ordered in (False, True):
            out = list(pairs._kernel(DIRECTIONAL, ordered)([table]))
            assert max(map(len, out)) <= 64
            got = [tuple(r.values()) for b in out for r in b.to_pylist()]
            assert sorted(got) == sorted((s, d, cost(u, v)) for s, u in rows.items() for d, v in rows.items() if (s < d if ordered else s != d))


_lost = (-1, 0)
_COSTS = {HAMMING: lambda x, y: x != y, DIRECTIONAL: lambda x, y: bool(y in _lost) if (x in _lost) != (y in _lost) else x > y}


def _profile_cases() -> list[dict[int, list[int]]]:
    """Alleles below, at and above the missing ones, all alike, far from 0; one locus up to several words of loci; ids of both signs."""
    rng = random.Random(12)
    values = [((-1, 0, 1, 4), 64), ((-1, 0), 1), ((-7, -2, -1, 0, 1, 300), 65), ((1 << 40, (1 << 40) + 5), 130), ((3,), 63), ((-(1 << 63), 1 - (1 << 63)), 3), ((-1, 2, (1 << 31) - 3), 4)]
    return [{n - 20: [rng.choice(v) for _ in range(width)] for n in range(45)} for v, width in values]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_are_joined_and_no_pair_is_shuffled(spark, monkeypatch):
    """As brute force has it, for both distances; Spark joins the profiles itself, by a merge in cells that hold a bounded side, and nothing goes through the driver."""
    monkeypatch.setattr(pairs, "SIDE", 9)
    for rows in _profile_cases():
        for distance, costs in _COSTS.items():
            found = pairs.all_pairs(spark.createDataFrame(list(rows.items()), "id bigint, alleles array<bigint>"), distance)
            got = sorted(map(tuple, found.collect()))
            assert got == sorted((s, d, sum(map(costs, u, v))) for s, u in rows.items() for d, v in rows.items() if s != d)
            assert "MapInArrow" not in _plan(found) and "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found) and "Cartesian" not in _plan(found)


def test_pairs_that_no_planes_hold_go_to_the_kernel(spark):
    """Alleles too far apart for planes: blocks as before, with the same result. Null ids have no pairs, repeated ones none with each other; an empty table has none."""
    kind = "id bigint, alleles array<bigint>"
    rows = {n: [(-(1 << 63), 0, (1 << 63) - 1)[(n + k) % 3] for k in range(5)] for n in range(7)}
    far = pairs.all_pairs(spark.createDataFrame(list(rows.items()), kind))
    assert "MapInArrow" in _plan(far)
    assert sorted(map(tuple, far.collect())) == sorted((s, d, sum(x != y for x, y in zip(u, v, strict=True))) for s, u in rows.items() for d, v in rows.items() if s != d)
    odd = spark.createDataFrame([(1, [1, 2]), (None, [2, 2]), (1, [1, 1]), (2, [1, 1])], kind)
    assert sorted(map(tuple, pairs.all_pairs(odd).collect())) == [(1, 2, 0), (1, 2, 1), (2, 1, 0), (2, 1, 1)]
    assert pairs.all_pairs(odd.limit(0)).collect() == []


def test_upper_pairs_are_joined_and_no_pair_is_shuffled(spark, monkeypatch):
    """Each pair once, from the smaller to the larger id in whichever parts they lie; the way of a directional distance is that one. Null and repeated ids have no pairs of their own."""
    monkeypatch.setattr(pairs, "SIDE", 9)
    kind = "id bigint, alleles array<bigint>"
    for rows in _profile_cases():
        for distance, costs in _COSTS.items():
            found = pairs.upper_pairs(spark.createDataFrame(list(rows.items()), kind), distance)
            got = sorted(map(tuple, found.collect()))
            assert got == sorted((s, d, sum(map(costs, u, v))) for s, u in rows.items() for d, v in rows.items() if s < d)
            assert "MapInArrow" not in _plan(found) and "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found) and "Cartesian" not in _plan(found)
    monkeypatch.setattr(pairs, "SIDE", 1)
    odd = spark.createDataFrame([(1, [1, 2]), (None, [2, 2]), (1, [1, 1]), (2, [1, 1]), (3, [0, 1])], kind)
    assert sorted(map(tuple, pairs.upper_pairs(odd).collect())) == [(1, 2, 0), (1, 2, 1), (1, 3, 1), (1, 3, 2), (2, 3, 1)]


def test_pairs_to_be_reduced_meet_in_cells_that_follow_the_tasks(spark, monkeypatch):
    """However many blocks there are, copies of a profile follow the number of tasks; none goes through the driver. Repeated ids have no pair together, in whichever parts they lie; as brute force has it."""
    rng = random.Random(13)
    rows = [(rng.choice([n - 40, 7, -3]), [rng.choice((-1, 0, 1, 2)) for _ in range(70)]) for n in range(90)]
    profiles = spark.createDataFrame([*rows, (None, [0] * 70)], "id bigint, alleles array<bigint>")
    met = pairs._paired(profiles, 2)
    assert met.count() <= 45 and "SortMergeJoin" in _plan(met) and "Broadcast" not in _plan(met) and "Cartesian" not in _plan(met)
    monkeypatch.setattr(pairs, "PART_BYTES", 8 * 70 * 5)
    for block in (3, 512):
        for distance, costs in _COSTS.items():
            way = [(s, d, sum(map(costs, u, v))) for s, u in rows for d, v in rows if s != d]
            assert {r["w"]: r["n"] for r in pairs.distance_histogram(profiles, distance, block).collect()} == Counter(w for s, d, w in way if s < d)
            assert {r["dst"]: (r["w"], r["src"]) for r in pairs.nearest(profiles, distance, block).collect()} == {e: min((w, s) for s, d, w in way if d == e) for e in {d for _, d, _ in way}}
            found = {r["since"]: (r["n"], r["w"]) for r in pairs.pairs_by_largest(profiles, 10, distance, block).collect()}
            assert found == {g: (len(x), min(x)) for g in range(-4, 5) if (x := [w for s, d, w in way if max(s, d) // 10 == g])}
            excess = [(s, d, sum(map(costs, u, v)) - sum(map(costs, v, u))) for s, u in rows for d, v in rows if s < d]
            assert sorted(map(tuple, pairs.asymmetry(profiles, distance, block).collect())) == sorted(excess)


def test_kernels_in_planes_are_those_of_brute_force():
    """Loci of one word, several and a part of one; alleles in planes and beyond, below and above the missing ones; distances beyond a byte; more rows than a step holds."""
    rng = random.Random(14)
    for least, most, width in ((-1, 4, 64), (-3, 4, 70), (3, 3, 5), (-1, 200, 130), (-5, 400, 9), (1, 2, 300)):
        u, v = ([[rng.randint(least, most) for _ in range(width)] for _ in range(n)] for n in (9, 7))
        for distance, costs in _COSTS.items():
            assert distance.block(np.array(u), np.array(v)).tolist() == [[sum(map(costs, x, y)) for y in v] for x in u]
            held = coded(np.array(u), np.array(v))
            assert (held is None) == (most == 400) and (held is None or distance.bits(*held).tolist() == distance.block(np.array(u), np.array(v)).tolist())


def test_sources_of_edges_into_single_vertices_are_not_looked_up(spark, monkeypatch):
    """Only edges into contracted components are joined with what their sources are in; a stored table isn't written again. The tree of an updated graph is that of the graph itself."""
    rows = _sunk(15)
    met, written = [], []
    between, cut = arborescence._between, arborescence.cut
    monkeypatch.setattr(arborescence, "_between", lambda real, labels, asked, big, plain=False: (met.append(plain or asked.where("c = v").isEmpty()), between(real, labels, asked, big, plain))[1])
    before = dynamic.start(spark.createDataFrame(rows, KIND), None, 150)
    monkeypatch.setattr(arborescence, "cut", lambda df: (written.append(df.columns == ["src", "dst", "w"] and df.count() > 600), cut(df))[1])
    log = spark.createDataFrame([(1, "remove", s, d, None) for s, d, _ in rows[:9]] + [(2, "add", 3, 2, 1), (3, "remove_node", 5, None, None)], dynamic.LOG)
    after = dynamic.apply_updates(before, log)
    gone = {(s, d) for s, d, _ in rows[:9]} | {(3, 2)}
    left = [(s, d, w) for s, d, w in rows if (s, d) not in gone and 5 not in (s, d)] + [(3, 2, 1)]
    assert len(left) > 600 and not any(written) and met and sum(not x for x in met) <= 2  # those of the task that ends the work
    nodes = [r["id"] for r in after.nodes.collect()]
    want = arborescence.arborescence_of(left, nodes)
    found = after.tree.collect()
    assert (len(found), sum(r["w"] for r in found)) == (len(want), sum(w for *_, w in want))
