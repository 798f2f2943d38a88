"""The graph engine against fixed cases, exact expectations and its own invariants."""

import importlib.util

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from walkgraph import errors
from walkgraph.config import EngineConfig, WalkConfig
from walkgraph.functions import rng, scalars
from walkgraph.operators import arbiter, events, rank, setops, walks, walkstore
from walkgraph.operators.graph import Delta, GraphStore, random_graph
from walkgraph.operators.walkstore import WalkStore
from walkgraph.plans.queries import _SHARE, QUERIES, SQL
from walkgraph.schemas import EDGES, EVENTS, NODES
from walkgraph.sources.state import StateStore

KEYS = {
    "ann": "04c915daefee38317fa734444acee390a8269fe5810b2241e5e6dd343dfbecc9",
    "bob": "50d94fc2d8580c682b071a542f8b1e31a200b0508bab95a33bef0855df281d63",
    "cat": "f683e87035f7ad4f44e0b98cfbd9537e16455a92cd38cefc4cb31db7557f5ef2",
    "dan": "6e468422dfb74a5738702a8823b9b28168abab8655faacb6853cd0ee15deee93",
}
INVALID = "6e468422dfb74a5738702a8823b9b28168abab8655faacb6953cd0ee15deee93"
#: Ranks of small graphs. Fixed values of the tests: edges, nodes, global and from node 0.
GRAPHS = {
    "dandlings": ([], 5, [0.2] * 5, [1, 0, 0, 0, 0]),
    "triangle": ([(0, 1), (1, 2), (2, 0)], 3, [0.33333] * 3, [0.38873, 0.33042, 0.28086]),
    "triangle plus one": ([(0, 1), (0, 3), (1, 2), (2, 0)], 4, [0.29700, 0.20616, 0.25522, 0.24161], [0.45223, 0.19220, 0.16337, 0.19220]),
    "acyclic 1": ([(0, 1), (0, 2), (2, 3), (3, 1)], 5, [0.11185, 0.36950, 0.15943, 0.24736, 0.11185], [0.39709, 0.29069, 0.16876, 0.14345, 0]),
    "acyclic 2": ([(0, 1), (0, 2), (4, 3), (4, 5)], 6, [0.12987, 0.18506, 0.18506, 0.18506, 0.12987, 0.18506], [0.54054, 0.22973, 0.22973, 0, 0, 0]),
    "acyclic 3": ([(0, 1), (0, 2), (3, 1), (3, 2)], 4, [0.17544, 0.32456, 0.32456, 0.17544], [0.54054, 0.22973, 0.22973, 0]),
    "acyclic 4": ([(0, 1), (0, 2), (3, 1)], 4, [0.17544, 0.39912, 0.25, 0.17544], [0.54054, 0.22973, 0.22973, 0]),
    "cyclic 50": ([(i, (i + 1) % 50) for i in range(50)], 50, [1 / 50] * 50, [0.15 * 0.85**i for i in range(50)]),
}
#: Changes of one node's follows: (node, removed, added).
DELTAS = {
    "dandlings": [(0, [], [1]), (0, [], [1, 2]), (0, [], [1, 2, 3]), (0, [], [1, 2, 3, 4])],
    "acyclic 1": [(0, [1, 2], []), (0, [1], []), (0, [2], [3]), (0, [1], [4]), (0, [1, 2], [3, 4]), (4, [], [0]), (4, [], [0, 1])],
    "acyclic 2": [(0, [1], []), (0, [], [3]), (0, [1], [3, 5]), (1, [], [2])],
    "acyclic 3": [(0, [1, 2], []), (0, [], [3]), (0, [1, 2], [3])],
    "acyclic 4": [(0, [2], []), (0, [1], [3]), (0, [1, 2], [3])],
    "cyclic 50": [(0, [1], []), (0, [], [25]), (0, [1], [25])],
}


def graph_of(spark, edges, n, status="active"):
    nodes = spark.createDataFrame([(i, str(i), status, None, None, None) for i in range(n)], NODES)
    return GraphStore(nodes, spark.createDataFrame(edges, EDGES))


def scores(df, n):
    found = {r["node"]: r["score"] for r in df.collect()}
    return [found.get(i, 0.0) for i in range(n)]


def l1(a, b):
    return sum(abs(x - y) for x, y in zip(a, b))


def side_by_side(spark, graphs):
    """One graph of several, each with ids of its own: (edges, nodes) -> GraphStore."""
    edges = [(100 * k + a, 100 * k + b) for k, (own, _) in enumerate(graphs) for a, b in own]
    nodes = spark.createDataFrame([(100 * k + i, str(100 * k + i), "active", None, None, None) for k, (_, n) in enumerate(graphs) for i in range(n)], NODES)
    return GraphStore(nodes, spark.createDataFrame(edges, EDGES))


def apart(ranks, k, n):
    """The scores of the k-th of them, as if it were alone."""
    own = [ranks.get(100 * k + i, 0.0) for i in range(n)]
    return [x / sum(own) for x in own]


def test_ranks(spark):
    config = WalkConfig(walks_per_node=5000)
    graph = side_by_side(spark, [(edges, n) for edges, n, _, _ in GRAPHS.values()])
    found = {r["node"]: r["score"] for r in rank.global_rank(walks.kept(walks.generate_all(graph, config, fast=True))).collect()}
    for k, (name, (_, n, whole, _)) in enumerate(GRAPHS.items()):
        assert l1(apart(found, k, n), whole) <= 0.01, name
    small = side_by_side(spark, [(edges, n) for edges, n, _, _ in GRAPHS.values() if n < 50])
    found = {r["node"]: r["score"] for r in rank.exact(small.nodes, small.edges, 0.85).collect()}
    mine = {r["node"]: r["score"] for r in rank.exact(small.nodes, small.edges, 0.85, small.nodes.where("id % 100 = 0")).collect()}
    for k, (name, (_, n, whole, own)) in enumerate(g for g in GRAPHS.items() if g[1][1] < 50):
        assert l1(apart(found, k, n), whole) <= 0.001 and l1(apart(mine, k, n), own) <= 0.001, name


def test_personalized_ranks(spark):
    """All graphs but the two triangles, whose personalized ranks a stitched walk doesn't give."""
    config = WalkConfig(walks_per_node=1000)
    chosen = {k: g for k, g in GRAPHS.items() if not k.startswith("triangle")}
    graph = side_by_side(spark, [(edges, n) for edges, n, _, _ in chosen.values()])
    found = walks.kept(walks.generate_all(graph, config, fast=True))
    out = rank.personalized(graph, found, [100 * k for k in range(len(chosen))], 200, config)
    ranks = {r["node"]: r["score"] for r in out.collect()}
    for k, (name, (_, n, _, own)) in enumerate(chosen.items()):
        assert l1(apart(ranks, k, n), own) <= 0.01, name


def test_personalized_by_joins(spark):
    edges, n, _, own = GRAPHS["acyclic 1"]
    graph, config = graph_of(spark, edges, n), WalkConfig(walks_per_node=10)
    found = walks.kept(walks.generate_all(graph, config))
    out = walks.kept(rank.personalized(graph, found, [0, 4], 100, config, by_join=True))
    assert l1(scores(out.where("source = 0"), n), own) <= 0.02
    assert [tuple(r) for r in out.where("source = 4").collect()] == [(4, 4, 1.0)]
    with pytest.raises(errors.EmptyWalkStore):
        rank.personalized(graph, found.limit(0), [0], 5, config)


def test_ranks_after_updates(spark):
    """Walks of changed graphs, updated by the inverse changes, have the golden ranks: all graphs and changes side by side."""
    config = WalkConfig(walks_per_node=5000)
    cases = [(name, *delta) for name, deltas in DELTAS.items() for delta in deltas]
    before = side_by_side(spark, [(sorted({e for e in GRAPHS[name][0] if e not in {(node, x) for x in removed}} | {(node, x) for x in added}), GRAPHS[name][1]) for name, node, removed, added in cases])
    after = walks.kept(side_by_side(spark, [(GRAPHS[name][0], GRAPHS[name][1]) for name, *_ in cases]).edges)
    found = walks.kept(walks.generate_all(before, config, fast=True))
    for k, (name, node, removed, added) in enumerate(cases):
        shift = lambda ids: [100 * k + x for x in sorted(ids)]  # noqa: B023, E731
        common = {d for s, d in GRAPHS[name][0] if s == node} - set(removed)
        own = walks.kept(found.where(f"path[0] div 100 = {k}"))
        out, changed = walks.update(own, after, 100 * k + node, shift(added), shift(common), shift(removed), config)
        ranks = {r["node"]: r["score"] for r in rank.global_rank(out).collect()}
        assert changed > 0 and l1(apart(ranks, k, GRAPHS[name][1]), GRAPHS[name][2]) <= 0.015, cases[k]


def test_updates_agree_in_both_plans(spark):
    graph, config = random_graph(spark, 40, 4, seed=3), WalkConfig(walks_per_node=5)
    found = walks.kept(walks.generate_all(graph, config))
    mine = sorted(r["dst"] for r in graph.edges.where("src = 7").collect())
    added = [x for x in range(5) if x not in mine and x != 7]
    edges = walks.kept(graph.update(Delta(3, 7, tuple(mine[:2]), tuple(added))).edges)
    (a, n), (b, m) = (walks.update(found, edges, 7, mine[:2], mine[2:], added, config, by_join=k) for k in (False, True))
    assert n == m > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    hit = found.where("size(path) > 1").select("walk_id", F.slice("path", 1, 1).alias("path"))
    c, d = (walks.regrow(hit, edges, config, 9, by_join=k) for k in (False, True))
    assert c.exceptAll(d).isEmpty() and d.exceptAll(c).isEmpty()


def test_distance_is_as_expected(spark):
    """Ranks of two independent sets of walks differ by no more than the gate for their count."""
    graph = random_graph(spark, 200, 20)
    a, b = (walks.kept(walks.generate_all(graph, WalkConfig(walks_per_node=50, seed=s), fast=True)) for s in (1, 2))
    found = rank.distance(rank.global_rank(a), rank.global_rank(b)).first()["distance"]
    assert 0 < found <= 2 * rank.expected_distance(200, 200, 50)
    assert rank.expected_distance(20_000, 40_000, 100) == pytest.approx(0.1)


def test_personalized(spark):
    edges, n, _, own = GRAPHS["acyclic 1"]
    graph = graph_of(spark, edges, n)
    config = WalkConfig(walks_per_node=1000)
    found = walks.kept(walks.generate_all(graph, config, fast=True))
    out = rank.personalized(graph, found, [0, 4], 5, config)
    assert l1(scores(out.where("source = 0"), n), own) <= 0.01
    assert [tuple(r) for r in out.where("source = 4").collect()] == [(4, 4, 1.0)]
    with pytest.raises(errors.NodeNotFound):
        rank.personalized(graph, found, [9], 5, config)
    with pytest.raises(errors.InvalidTopK):
        rank.personalized(graph, found, [0], 0, config)


@pytest.mark.parametrize("old", [[], [1], [2], [1, 2, 4], [3, 4]])
def test_incremental_update(spark, old):
    """Walks made under old follows of node 0, then updated to [1, 2], are those of the graph as it is."""
    edges, n, whole, _ = GRAPHS["acyclic 1"]
    config = WalkConfig(walks_per_node=3000)
    before = graph_of(spark, [e for e in edges if e[0] != 0] + [(0, x) for x in old], n)
    after = graph_of(spark, edges, n)
    found = walks.kept(walks.generate_all(before, config, fast=True))
    removed, common, added = sorted({*old} - {1, 2}), sorted({*old} & {1, 2}), sorted({1, 2} - {*old})
    out, changed = walks.update(found, after.edges, 0, removed, common, added, config)
    assert changed > 0 and l1(scores(rank.global_rank(out), n), whole) <= 0.015
    hops = out.select(F.explode(F.expr("transform(sequence(1, size(path)), i -> struct(get(path, i-1) as src, get(path, i) as dst))")).alias("h")).select("h.*").where("dst is not null")
    assert hops.distinct().join(after.edges, ["src", "dst"], "left_anti").isEmpty()
    assert out.where("size(array_distinct(path)) <> size(path)").isEmpty()
    if removed and common:  # a walk that had a next node has one again: no second toss
        cut = found.where(F.col("path")[0] == 0).where(F.array_contains(F.array(*[F.lit(x) for x in removed]), F.get("path", F.lit(1)).cast("int")))
        assert out.join(cut.select("walk_id"), "walk_id", "left_semi").where("size(path) < 2").isEmpty()


def test_walks_agree_in_both_plans(spark):
    graph = random_graph(spark, 60, 5)
    config = WalkConfig(walks_per_node=5)
    a, b = (walks.generate(graph.nodes, graph.edges, config, by_join=k) for k in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 300


def test_walk_pieces(spark):
    adj = walks.Adjacency(np.array([0, 0, 5]), np.array([7, 5, 0]))
    assert adj.follows(0).tolist() == [5, 7] and adj.follows(9).tolist() == []
    config = WalkConfig()
    edges = spark.createDataFrame([(0, 7), (0, 5), (5, 0)], EDGES)
    cut = spark.createDataFrame([(1, [0, 9], 1)], "walk_id long, path array<long>, cut int")
    for candidates, want in (([], [0]), ([0], [0]), ([7], [0, 7])):
        assert walks.grafted(cut, edges, candidates, config, 1, False).first()["path"] == want
    assert rank.crop([0, 1, 2, 3], 0) == [1, 2, 3]
    with pytest.raises(errors.NodeNotInWalk):
        rank.crop([1], 2)
    assert [rank.required_length(k, 0.85) for k in (5, 100, 200)] == [29379, 374894, 675747]
    w = rank.PersonalizedWalk(0, 3)
    w.move(1), w.move(2), w.append([3, 1])
    assert w.all == [0, 1, 2, 3] and w.current == [0] and w.reached()
    cache = rank.WalkCache([[0, 1], [1, 0]])
    assert cache.next(0) == [0, 1] and cache.next(0) is None and cache.next(1) == [1, 0]


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.format_walk(F.lit([0, 1, 5])).alias("f"), scalars.parse_walk(F.lit("0,1,5")).alias("p"), scalars.parse_walk(F.lit("")).alias("e"),
        scalars.parse_ids(F.lit("1,x")).alias("bad"), scalars.unique_sorted(F.lit([1, 2, 3, 4, 2, 3])).alias("u"),
        scalars.partition(F.lit([0, 1, 2, 4]), F.lit([1, 2, 3])).alias("s"),
        scalars.trim_cycles(F.lit([0, 1, 2, 3]), F.lit([4, 2, 6])).alias("t1"), scalars.trim_cycles(F.lit([0, 1, 2]), F.lit([3, 4, 5])).alias("t2"),
        scalars.invalid_step(F.lit([1, 2, 3]), F.lit(1), F.lit([2])).alias("c1"), scalars.invalid_step(F.lit([1]), F.lit(1), F.lit([2])).alias("c2"),
        scalars.crop_walk(F.lit([0, 1, 2]), F.lit(0)).alias("cr"), scalars.starts_with(F.lit([1, 2]), F.lit(1)).alias("sw"),
    ).first()
    assert (one["f"], one["p"], one["e"], one["bad"], one["u"]) == ("0,1,5", [0, 1, 5], None, None, [1, 2, 3, 4])
    assert (one["s"]["removed"], one["s"]["common"], one["s"]["added"]) == ([0, 4], [1, 2], [3])
    assert (one["t1"], one["t2"], one["c1"], one["c2"], one["cr"], one["sw"]) == ([4], [3, 4, 5], 1, None, [1, 2], True)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.range(1).select(scalars.parse_walk(F.lit("0.33,1"))).collect()
    assert all(map(scalars.on_curve, KEYS.values())) and not scalars.on_curve(INVALID) and not scalars.on_curve(None)


def test_walks_to_update_in_single_precision(spark):
    """Shares just at a half, and counts that single precision doesn't hold, against the SQL and the operator on one node."""
    draw = np.random.default_rng(1)
    n = draw.integers(1, 10**9, 500)
    large = zip((n * draw.random(500)).astype(int).tolist(), n.tolist(), draw.integers(1, 10**9, 500).tolist())
    small = [(k, n, visits) for n in (12, 24) for k in range(n + 1) for visits in range(1, 241)]
    rows = spark.createDataFrame([(7, 24, 108), *small, *large], "k long, n long, visits long")
    found = rows.select("k", "n", "visits", scalars.walks_to_update(F.col("k"), F.col("n"), F.col("visits")).alias("n_walks")).toArrow()
    con = duckdb.connect()
    con.register("found", found)
    assert con.sql(f"SELECT * FROM found WHERE n_walks IS DISTINCT FROM {_SHARE}").fetchall() == []
    assert [r for r in found.to_pylist() if r["n_walks"] != walks.sample_size(r["k"], r["n"], r["visits"])] == []
    assert found.to_pylist()[0]["n_walks"] == 31


def test_graph_store(spark):
    graph = graph_of(spark, [(0, 1)], 3)
    assert {r["id"]: r["list"] for r in graph.follows(0, 1).collect()} == {0: [1], 1: []}
    with pytest.raises(errors.NodeNotFound):
        graph.follows(9)
    assert {r["id"]: r["n"] for r in graph.follower_counts(1, 69).collect()} == {1: 1, 69: 0}
    after = graph.update(Delta(3, 0, (1,), (2,)))
    assert {r["id"]: r["list"] for r in after.followers(1, 2).collect()} == {1: [], 2: [0]}
    assert graph.update(Delta(77, 0)) is graph
    with pytest.raises(errors.MissingDelta):
        graph.update(None)
    with pytest.raises(errors.NodeAlreadyExists):
        graph.add_node("0")
    more = graph.add_node("new")
    assert more.node_by_key("new")["id"] == 3 and more.node_by_key("new")["status"] == "inactive"
    assert [r["id"] for r in more.node_ids("new", "none", "0").orderBy("pos").collect()] == [3, None, 0]
    assert graph.update(Delta(-1, 0)).node_by_id(0)["status"] == "inactive"
    with pytest.raises(errors.EmptyGraph):
        walks.generate_all(GraphStore.create(spark), WalkConfig())
    assert GraphStore.from_pubkeys(spark, ["b", "a"]).size() == 2


def test_walk_store(spark):
    store = WalkStore.create(spark, walks_per_node=1).add([[0, 1, 2], [1, 2, 0], [2, 0, 1]])
    assert store.total_visits() == 9 and [r["path"] for r in store.get(2, 0).collect()] == [[2, 0, 1], [0, 1, 2]]
    left = store.remove(0, 1)
    assert left.total_visits() == 3 and left.add([[5]]).last_id() == 3
    for bad in (lambda: store.remove(0, 9), lambda: store.get(9)):
        with pytest.raises(errors.WalkNotFound):
            bad()
    with pytest.raises(errors.EmptyWalk):
        store.add([[1], []])
    one = WalkStore.create(spark).add([[0, 1, 2, 3]])
    cut = lambda k, new: one.prune_graft(0, k, new).get(0).first()["path"]
    assert cut(2, []) == [0, 1] and cut(4, [4, 5]) == [0, 1, 2, 3, 4, 5] and cut(1, [4, 5]) == [0, 4, 5]
    with pytest.raises(errors.InvalidWalkIndex):
        one.prune(0, 99)
    assert {r["walk_id"] for r in store.visiting_all(0, 1).collect()} == {0, 1, 2} and store.visiting_all().isEmpty()
    assert store.visiting(6, 0, 1).count() == 3 and store.visiting(0, 0).isEmpty() and store.visiting(-1, 0).count() == 3
    with pytest.raises(ValueError):
        store.visiting(-2, 0)
    assert walkstore.inconsistencies(store.walks, walkstore.visits(store.walks)).isEmpty()
    with pytest.raises(errors.InvalidAlpha):
        WalkStore.create(spark, alpha=1.0)
    with pytest.raises(errors.EmptyWalkStore):
        rank.global_rank(WalkStore.create(spark).walks)
    assert {r["node"]: r["visits"] for r in store.visit_counts(0, 69).collect()} == {0: 3, 69: 0}


def event(i, author, kind, at, follows):
    return (f"e{i}", KEYS[author], kind, at, [["p", KEYS.get(f, f)] for f in follows] + [["e", "x"], ["p"]])


def people(spark):
    rows = [(0, KEYS["ann"], "inactive", 69), (1, KEYS["bob"], "active", 69), (2, KEYS["cat"], "inactive", 69)]
    nodes = spark.createDataFrame(rows, "id long, pubkey string, status string, at long")
    empty = [F.lit(None).cast("timestamp").alias(c) for c in ("promotion_ts", "demotion_ts")]
    return GraphStore(nodes.select("id", "pubkey", "status", F.timestamp_seconds("at").alias("added_ts"), *empty), spark.createDataFrame([(0, 1)], EDGES))


def test_events(spark):
    graph = people(spark)
    batch = spark.createDataFrame([event(0, "bob", 3, 5, ["dan", "ann", "bob", "dan"]), event(1, "bob", 3, 4, ["cat"]), event(2, "cat", 3, 9, ["dan", "bob"]), event(3, "dan", 3, 9, ["cat"]), event(4, "bob", 0, 1, [])], EVENTS)
    newest = events.latest(batch)
    assert {r["id"] for r in newest.collect()} == {"e0", "e2", "e3", "e4"}
    after, deltas = events.apply_graph(newest, graph, F.current_timestamp())
    assert after.node_by_key(KEYS["dan"])["id"] == 3
    assert {(r["src"], r["dst"]) for r in after.edges.collect()} == {(0, 1), (1, 0), (1, 3), (2, 1), (2, 3)}
    none, _ = events.apply_graph(spark.createDataFrame([event(0, "bob", 3, 5, [INVALID]), event(1, "cat", 3, 5, ["dan"])], EVENTS), graph, F.current_timestamp())
    assert none.size() == 3
    stored = events.merged(batch, spark.createDataFrame([], EVENTS))
    assert events.replaced(batch, stored).isEmpty() and stored.count() == 4


@pytest.mark.parametrize("apply", [events.apply_serial, events.apply_bulk])
def test_events_change_walks(spark, apply):
    graph, config = people(spark), WalkConfig(walks_per_node=2000)
    found = walks.kept(walks.generate_all(graph, config))
    batch = spark.createDataFrame([event(0, "ann", 3, 5, ["bob", "cat"]), event(1, "bob", 3, 6, ["cat"])], EVENTS)
    after, out, changed = apply(batch, graph, found, config, F.current_timestamp())
    exact = scores(rank.exact(graph.nodes, after.edges, 0.85), 3)
    assert changed > 0 and l1(scores(rank.global_rank(out), 3), exact) <= 0.02


def test_arbiter(spark):
    graph = people(spark)
    found = spark.createDataFrame([(1, [1])], "walk_id long, path array<long>")
    one = WalkConfig(walks_per_node=1)
    down, left, keys = arbiter.scan(graph, found, F.current_timestamp(), EngineConfig(promotion_multiplier=9.0, demotion_multiplier=2.0), one)
    assert down.node_by_id(1)["status"] == "inactive" and left.isEmpty() and keys.isEmpty()
    up, more, keys = arbiter.scan(graph, found, F.current_timestamp(), EngineConfig(promotion_multiplier=0.0, demotion_multiplier=0.0), one)
    assert {r["status"] for r in up.nodes.collect()} == {"active"} and {r["pubkey"] for r in keys.collect()} == {KEYS["ann"], KEYS["cat"]}
    assert sorted(r["path"][0] for r in more.collect()) == [0, 1, 2]
    assert arbiter.threshold(1.05, 100) == 105 and not arbiter.is_due(0, 0, 0.85, EngineConfig())


def test_setops(spark):
    rows = spark.createDataFrame([(i,) for i in range(23)], "x long")
    out = setops.batches(rows, ["x"], 5, "b").collect()
    assert all(r["b"] == r["x"] // 5 for r in out) and len(out) == 23
    paths = spark.createDataFrame([(0, [1, 2]), (1, [2, 0]), (2, [0, 1]), (3, [0])], "walk_id long, path array<long>")
    assert [r["path"] for r in setops.sorted_walks(paths).collect()] == [[0], [0, 1], [1, 2], [2, 0]]


def test_state(spark, tmp_path):
    state = StateStore(spark, str(tmp_path / "s"))
    assert state.version() is None
    for k in range(4):
        assert state.commit({"t": spark.range(k + 1)}, {"batch": str(k)}) == k
    assert state.read("t").count() == 4 and state.properties() == {"batch": "3"}
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]


def test_a_commit_that_dies(spark, tmp_path, monkeypatch):
    """Whatever step of a commit fails, the former version is in force, and the next commit goes through."""
    at = str(tmp_path / "s")
    StateStore(spark, at).commit({"t": spark.range(1)}, {"batch": "0"})

    class Dies(Exception):
        pass

    def die(*_, **__):
        raise Dies

    class Broken:
        """A file system that fails in one call."""

        def __init__(self, fs, name):
            self.fs, self.name = fs, name

        def __getattr__(self, name):
            return die if name == self.name else getattr(self.fs, name)

    for name in ("create", "_switch", "write"):
        state = StateStore(spark, at)
        frame = spark.range(2)
        if name == "create":
            state._fs = Broken(state._fs, "create")
        elif name == "_switch":
            state._switch = die
        else:
            frame = spark.range(2).select(F.raise_error(F.lit("dies")).cast("long").alias("id"))
        with pytest.raises(Exception):
            state.commit({"t": frame}, {"batch": "1"})
        again = StateStore(spark, at)
        assert again.version() == 0 and again.read("t").count() == 1 and again.properties() == {"batch": "0"}
    assert StateStore(spark, at).commit({"t": spark.range(3)}, {"batch": "1"}) == 1
    # And one that dies after the switch has the new version in force.
    state = StateStore(spark, at)
    state._fs = Broken(state._fs, "delete")
    for k in (2, 3):
        with pytest.raises(Dies):
            state.commit({"t": spark.range(k + 2)}, {"batch": str(k)})
        assert StateStore(spark, at).read("t").count() == k + 2


def engine_of(spark, tmp_path, **options):
    from walkgraph.streaming.pipeline import Engine

    (tmp_path / "in").mkdir()
    settings = {"promotion_wait_period": 0, "walks": WalkConfig(walks_per_node=5), **options}
    return Engine(spark, EngineConfig(state_path=str(tmp_path / "state"), events_path=str(tmp_path / "in"), **settings))


def put(tmp_path, lines):
    import json

    names = ("id", "pubkey", "kind", "created_at", "tags")
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(dict(zip(names, e))) for e in lines))


def test_engine_stream(spark, tmp_path):
    engine = engine_of(spark, tmp_path)
    engine.start([KEYS["ann"], KEYS["bob"]])
    put(tmp_path, [event(0, "ann", 3, 5, ["bob"]), event(1, "ann", 3, 4, ["cat"]), event(2, "dan", 3, 9, ["cat"])])
    engine.run(str(tmp_path / "ck"), once=True).awaitTermination(120)
    graph = engine.graph()
    assert graph.edges.count() == 1 and graph.size() == 2
    held = engine.state.properties()
    engine.process(spark.createDataFrame([event(9, "ann", 3, 99, [])], EVENTS), int(held["batch"]))
    assert engine.graph().edges.count() == 1  # a batch that comes again changes nothing


def test_engine_feeds_itself(spark, tmp_path):
    """Promoted keys are fetched, in spite of a source that fails, and their lists become edges."""
    from walkgraph.streaming.pipeline import fetch_batch

    engine = engine_of(spark, tmp_path, query_batch_size=2, promotion_multiplier=0.1, demotion_multiplier=0.0, node_arbiter_activation_threshold=0.0, display_stats=True)
    engine.start([KEYS["ann"], KEYS["bob"]])
    source = spark.createDataFrame([event(5, "ann", 3, 50, ["bob", "cat"]), event(6, "bob", 3, 50, ["ann", "dan"]), event(7, "bob", 0, 50, [])], EVENTS)
    asked = []

    def fetch(keys):
        asked.append(keys)
        if len(asked) <= 2:
            raise OSError("not now")
        return fetch_batch(keys, source)

    put(tmp_path, [event(0, "ann", 3, 5, ["bob"])])
    engine.run(str(tmp_path / "ck"), once=True, fetch=fetch).awaitTermination(240)
    assert asked[0] == asked[1] == asked[2] == sorted([KEYS["ann"], KEYS["bob"]])
    names = {r["id"]: r["pubkey"] for r in engine.graph().nodes.collect()}
    key = {v: k for k, v in KEYS.items()}
    assert {(key[names[r["src"]]], key[names[r["dst"]]]) for r in engine.graph().edges.collect()} == {("ann", "bob"), ("ann", "cat"), ("bob", "ann"), ("bob", "dan")}
    assert engine.promotions().isEmpty() and engine.stats()["nodes"] == 4 and engine.stats()["events"] == 4


def test_arbitration_that_comes_again(spark, tmp_path):
    """Keys wait until they are fetched; a scan that changes nothing adds none, and one whose commit dies neither."""
    engine = engine_of(spark, tmp_path, promotion_multiplier=0.1, demotion_multiplier=0.0)
    engine.start([KEYS["ann"], KEYS["bob"]])
    commit = engine.state.commit
    engine.state.commit = lambda *_: (_ for _ in ()).throw(OSError("dies"))
    with pytest.raises(OSError):
        engine.arbitrate(force=True)
    assert engine.promotions().isEmpty() and engine.graph().nodes.where("status = 'active'").isEmpty()
    engine.state.commit = commit
    for _ in range(2):
        assert engine.arbitrate(force=True)
        assert sorted(r["pubkey"] for r in engine.promotions().collect()) == sorted([KEYS["ann"], KEYS["bob"]])

    def broken(keys):
        raise OSError("never")

    assert engine.fetch_promoted(broken) == 0 and engine.promotions().count() == 2


def test_walk_ids_are_not_given_twice(spark):
    """Walks that were added before a node is promoted keep their ids to themselves."""
    graph = graph_of(spark, [(0, 1), (1, 2)], 4)
    config = WalkConfig(walks_per_node=3)
    first = walks.generate(graph.nodes.where("id < 2"), graph.edges, config)
    store = WalkStore(walks.kept(first), config).add([[3, 0], [3, 1], [3, 2]])
    nodes = graph.nodes.withColumn("status", F.when(F.col("id") == 2, "inactive").otherwise(F.col("status"))).withColumn("added_ts", F.timestamp_seconds(F.lit(0)))
    wanted = EngineConfig(promotion_multiplier=0.0, demotion_multiplier=0.0)
    _, out, keys = arbiter.scan(GraphStore(nodes, graph.edges), walks.kept(store.walks), F.current_timestamp(), wanted, config)
    ids = sorted(r["walk_id"] for r in out.collect())
    assert keys.count() == 1 and ids == list(range(12))


def test_config():
    found = EngineConfig.from_env({"INIT_PUBKEYS": "a, b", "PROMOTION_MULTIPLIER": "2", "QUERY_BATCH_SIZE": "7", "DISPLAY_STATS": "true"})
    assert (found.init_pubkeys, found.promotion_multiplier, found.query_batch_size, found.display_stats) == (("a", "b"), 2.0, 7, True)
    assert rng.limit(0.85) == 3650722201


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "supplier", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found, want = QUERIES[name](spark, data), con.sql(SQL[name])
    order = sorted(found.columns)
    assert order == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in found.select(*order).collect()))) == sorted(map(str, want.select(*order).fetchall()))


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The pipeline is there only with the subpackage that it calls.
    assert ("pipeline" in entry.queries()) <= (importlib.util.find_spec("walkgraph.llm") is not None)


def test_registered_functions(spark):
    from walkgraph.functions.register import register

    edges, n, _, own = GRAPHS["acyclic 1"]
    graph, config = graph_of(spark, edges, n), WalkConfig(walks_per_node=7)
    register(spark, graph.edges, config)
    found = spark.sql("SELECT w.* FROM range(5) AS n, LATERAL random_walks(n.id) AS w")
    assert found.exceptAll(walks.generate_all(graph, config)).isEmpty() and found.count() == 35
    assert l1(scores(spark.sql("SELECT * FROM personalized_rank(0L, 20000)"), n), own) <= 0.03
    assert spark.sql(f"SELECT is_valid_pubkey('{KEYS['cat']}')").first()[0] and not spark.sql(f"SELECT is_valid_pubkey('{INVALID}')").first()[0]
