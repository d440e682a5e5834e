"""Graph operators on literal and random graphs, against plain Python."""

import random

import pytest

from graphmill.lineage import cut_by
from graphmill.operators import graph
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "s long, t long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def shortest(pairs, root):
    out, frontier, hop = {root: 0}, [root], 0
    while frontier:
        hop += 1
        frontier = sorted({t for s, t in pairs if s in frontier and t not in out})
        out |= dict.fromkeys(frontier, hop)
    return out


def components(ids, pairs):
    reach = {i: set(shortest(pairs, i)) for i in ids}
    return {i: min(j for j in ids if j in reach[i] and i in reach[j]) for i in ids}


def random_graph(seed, n=25, m=45):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    pairs, ids = random_graph(seed), range(25)
    e, n = edges(spark, pairs), nodes(spark, ids)
    reached = {(r.root, r.node): r.hop for r in graph.reach(e, n.selectExpr("node as root", "node")).collect()}
    assert reached == {(i, j): h for i in ids for j, h in shortest(pairs, i).items()}
    comps = graph.scc(n, e)
    expected = components(ids, pairs)
    assert {r.node: r.comp for r in comps.collect()} == expected
    assert {(r.from_comp, r.to_comp) for r in graph.condensation(comps, e).collect()} == {(expected[s], expected[t]) for s, t in pairs if expected[s] != expected[t]}
    sizes = {c: sum(v == c for v in expected.values()) for c in expected.values()}
    assert {(r.cycle, r.node) for r in graph.cycles(comps, e).collect()} == {(expected[i], i) for i in ids if sizes[expected[i]] > 1} | {(s, s) for s, t in pairs if s == t}


def one_path_counts(ids, pairs):
    counts = {}
    for root in ids:
        hops = shortest(pairs, root)
        parent = {t: min(s for s, x in pairs if x == t and hops.get(s) == h - 1) for t, h in hops.items() if h}
        for node in parent:
            while node != root:
                counts[parent[node], node] = counts.get((parent[node], node), 0) + 1
                node = parent[node]
    return counts


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3)], [(1, 3), (2, 3), (3, 4), (4, 5), (4, 6)], random_graph(7)])
def test_bridges(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    got = {(r.s, r.t): r.betweenness for r in graph.bridge_edges(nodes(spark, ids), edges(spark, pairs), None).collect()}
    assert got == one_path_counts(ids, pairs)


@pytest.mark.parametrize("blocks", [2, 5])
def test_bridges_of_all_sources_in_blocks(spark, blocks):
    pairs = random_graph(11)
    ids = sorted({x for p in pairs for x in p})
    got = {(r.s, r.t): r.betweenness for r in graph.bridge_edges(nodes(spark, ids), edges(spark, pairs), None, blocks).collect()}
    assert got == one_path_counts(ids, pairs)
    assert graph.bridge_blocks(10, 10) == 1 and graph.bridge_blocks(1 << 20, 1 << 20) == 1 << 13


def test_sides_of_a_node(spark):
    marked = spark.createDataFrame([(1, 2, False), (2, 3, False), (4, 1, True), (1, 4, True), (5, 1, False), (1, 5, False), (6, 1, False), (1, 1, True)], "s long, t long, circular boolean")
    assert {(r.neighbor, r.side) for r in graph.neighbor_sides(marked, 1).collect()} == {(2, "down"), (4, "circular"), (5, "both"), (6, "up")}


def test_a_chain_has_two_bridges_of_two(spark):
    assert rows(graph.bridge_edges(nodes(spark, [1, 2, 3]), edges(spark, [(1, 2), (2, 3)]))) == [(1, 2, 2), (2, 3, 2)]


def test_no_edges(spark):
    n, e = nodes(spark, [1, 2]), edges(spark, [])
    assert graph.bridge_edges(n, e).count() == 0
    assert rows(graph.scc(n, e)) == [(1, 1), (2, 2)]
    assert graph.cycles(graph.scc(n, e), e).count() == 0


def test_two_hop_leaves_out_seeds(spark):
    assert rows(graph.two_hop(edges(spark, [(1, 2), (2, 3), (1, 4), (3, 5), (2, 1)]), nodes(spark, [1]))) == [(2,), (3,), (4,)]


def test_blast_counts_a_caller_once_with_its_first_edge(spark):
    e = spark.createDataFrame([(1, 9, "calls", 0), (1, 9, "extends", 1), (2, 9, "implements", 0), (9, 9, "calls", 0), (3, 1, "uses_type", 0)], "source long, target long, edge_type string, edge_ord int")
    assert rows(graph.blast_scores(e)) == [(1, 1, 0.5), (9, 2, 2.2)]
    assert rows(graph.max_blast(e)) == [(2.2,)]
    assert rows(graph.max_blast(e.limit(0))) == [(0.0,)]


def test_dependents_of_a_cycle_leave_out_the_origin(spark):
    got = graph.dependents(edges(spark, [(1, 2), (2, 1), (3, 1)]), nodes(spark, [1]))
    assert rows(got) == [(1, 2, 1), (1, 3, 1)]


def test_flows_end_at_models_and_mark_odd_edges(spark):
    #  1 route -> 2 service -> 3 model -> 4 ; 1 -> 5 persistence: three layers skipped; 2 -> 1 is a cycle with 1
    e = edges(spark, [(1, 2), (2, 3), (3, 4), (1, 5), (2, 6), (6, 7)])
    layers = spark.createDataFrame([(1, 1), (2, 3), (3, 4), (4, 1), (5, 5), (6, 2), (7, -1)], "node long, layer int")
    n = nodes(spark, range(1, 8))
    steps, anomalies, capped = graph.flows(nodes(spark, [1]), graph.scc(n, e), layers, e)
    assert rows(steps) == [(1, 1, 0, 1), (1, 2, 1, 3), (1, 3, 2, 4), (1, 5, 1, 5), (1, 6, 2, 2), (1, 7, 3, -1)]
    assert rows(anomalies) == [(1, 1, 5, "skip-layer"), (1, 2, 6, "backward"), (1, 6, 7, "backward")]
    assert capped.count() == 0
    _, _, capped = graph.flows(nodes(spark, [1]), graph.scc(n, e), layers, e, most_depth=2)
    assert rows(capped) == [(1,)]


def test_seams_score_lower_the_more_both_sides_change_together(spark):
    bridges = spark.createDataFrame([(1, 2, 8)], "s long, t long, betweenness long")
    comps = spark.createDataFrame([(1, 1), (2, 2)], "node long, comp long")
    pairs = lambda c: spark.createDataFrame([(1, 2, c)], "file_a long, file_b long, confidence double")
    low, high = (graph.seams(bridges, comps, pairs(c), 10).first().score for c in (0.1, 1.0))
    assert (low, high) == (83, 56)


def test_federation_takes_the_first_rule(spark):
    e = spark.createDataFrame([("src/a.ts", "../../other/x.ts"), ("src/a.ts", "@org/lib/deep"), ("src/a.ts", "~shared/y"), ("src/a.ts", "react")], "source string, target string")
    sisters = spark.createDataFrame([("other", "/w/other", "other-pkg"), ("lib", "/w/lib", "@org/lib")], "name string, path string, package string")
    aliases = spark.createDataFrame([("~shared", "/w/lib/src")], "prefix string, base string")
    got = rows(graph.federation_edges(e, sisters, aliases, "/w/me"))
    assert got == [("src/a.ts", "../../other/x.ts", "other", 1), ("src/a.ts", "@org/lib/deep", "lib", 2), ("src/a.ts", "~shared/y", "lib", 3)]


@pytest.mark.parametrize("most, hops", [(1, None), (3, None), (3, 3), (8, 2)])
def test_ways_through_hubs_are_all_ways(spark, most, hops):
    pairs = sorted({(min(p), max(p)) for p in random_graph(most, 25, 60) if p[0] != p[1]})
    expected = {(i, j): h for i in range(0, 25, 2) for j, h in shortest(pairs, i).items() if hops is None or h <= hops}
    got = graph.reach_through(edges(spark, pairs), nodes(spark, range(0, 25, 2)), hops, most, 1).collect()
    assert len(got) == len(expected) and {(r.root, r.node): r.hop for r in got} == expected
    sizes = spark.createDataFrame([(i, i + 1) for i in range(25)], "node long, n long")
    above = {j: sum(i + 1 for i in range(25) if i != j and j in shortest(pairs, i)) for j in range(25)}
    assert {r.node: r.above for r in graph._weight_above(edges(spark, pairs), sizes, most, 1).collect()} == {j: n for j, n in above.items() if n}


def test_pairs_through_a_hub_are_never_a_frontier(spark, monkeypatch):
    # 40 nodes before a hub, 40 after it: 1,600 pairs; half of the latter reach a node of their own, one is reached around
    e = edges(spark, [(i, 100) for i in range(40)] + [(100, i) for i in range(200, 240)] + [(i, i + 100) for i in range(200, 220)] + [(0, 300)])
    made, plain = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda *a: made.append(plain(*a)) or made[-1])
    got = {(r.root, r.node): r.hop for r in graph.reach_through(e, nodes(spark, range(40))).collect()}
    assert len(got) == 40 + 40 + 1600 + 800 and got[0, 300] == 1 and got[1, 300] == 3 and got[39, 239] == 2
    assert sum(df.count() for df in made) < 300


def test_entries_of_a_cycle_share_one_trace(spark, monkeypatch):
    ring = [(i, (i + 1) % 30) for i in range(30)] + [(0, 50), (50, 51)]
    ids = [*range(30), 50, 51]
    e, n = edges(spark, ring), nodes(spark, ids)
    asked, plain = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, roots, *a: asked.append(roots) or plain(edges, roots, *a))
    comps = graph.cut(graph.scc(n, e))
    asked.clear()
    steps, _, _ = graph.flows(nodes(spark, range(30)), comps, spark.createDataFrame([(i, 1) for i in ids], "node long, layer int"), e)
    assert rows(steps) == sorted([(i, c, h, 1) for i in range(30) for c, h in ((0, 0), (50, 1), (51, 2))], key=repr)
    assert [r.count() for r in asked] == [1]


def test_sources_that_pass_an_edge_together_are_one_row(spark):
    # 40 sources before one node: the edge behind it is one row, not one for each of them
    e = edges(spark, [(i, 100) for i in range(40)] + [(100, 101)])
    first, second = graph._levels(e, nodes(spark, range(40)))
    assert first.count() == 40 and second.count() < 10


@pytest.mark.parametrize("seed", range(4))
def test_components_of_edges_in_several_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "EDGES_OF_TASK", 8, raising=False)
    pairs, ids = random_graph(20 + seed, 30, 30 + 8 * seed), range(30)
    expected = components(ids, pairs)
    assert {r.node: r.comp for r in graph.scc(nodes(spark, ids), edges(spark, pairs + pairs[:5])).collect()} == expected
    named = spark.createDataFrame([(f"f{s:02}", f"f{t:02}") for s, t in pairs], "s string, t string")
    got = graph.scc(spark.createDataFrame([(f"f{i:02}",) for i in ids], "node string"), named)
    assert {r.node: r.comp for r in got.collect()} == {f"f{i:02}": f"f{c:02}" for i, c in expected.items()}


def test_components_look_both_ways_in_one_round(spark, monkeypatch):
    # a ring of 12: its smallest id goes round once, forward and backward together, and each round is one table
    tables = []
    for name in ("cut", "cut_by"):
        monkeypatch.setattr(graph, name, lambda *a, plain=getattr(graph, name, None): tables.append(a) or plain(*a), raising=False)
    assert rows(graph.scc(nodes(spark, range(12)), edges(spark, [(i, (i + 1) % 12) for i in range(12)]))) == sorted([(i, 0) for i in range(12)], key=repr)
    assert len(tables) <= 18


def test_tables_in_buckets_meet_without_a_shuffle(spark):
    a, b = (cut_by(spark.range(50).repartition(3, "id"), "id", 3) for _ in range(2))
    both = a.hint("shuffle_hash").join(b, "id")
    assert both.count() == 50
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]


def test_bridges_write_nothing_by_source_and_node(spark, monkeypatch):
    """A graph that a task can hold is written once, however far its levels go; larger ones give the same."""
    pairs = [(k, k + 1) for k in range(12)] + [(0, 7), (3, 9), (9, 2), (5, 1), (12, 0)]
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": written.append(name) or cut(df, name))
    got = rows(graph.bridge_edges(nodes(spark, [0, 3, 99, 12]), edges(spark, pairs), None))
    assert written == ["bridges-edges"]
    monkeypatch.setattr(graph, "MOST_AT_HAND", 0)
    assert got == rows(graph.bridge_edges(nodes(spark, [0, 3, 99, 12]), edges(spark, pairs), None)) and len(written) > 10
