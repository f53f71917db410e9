import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from sendero.functions import geo
from sendero.operators import graph, roads, routes
from sendero.plans.session import cut

WAYS = "id bigint, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


@pytest.mark.parametrize(
    "tags, want",
    [
        ({"highway": "track"}, (20, True, True)),
        ({"highway": "footway"}, None),
        ({"highway": "footway", "motor_vehicle": "yes"}, (20, True, True)),
        ({"highway": "residential", "access": "no", "motor_vehicle": "yes"}, (40, True, True)),
        ({"highway": "primary", "oneway": "-1"}, (80, False, True)),
        ({"highway": "tertiary", "junction": "roundabout"}, (60, True, False)),
        ({"highway": "service", "access": "unknown"}, (30, True, True)),
        ({"highway": "service", "vehicle": "unknown", "access": "private"}, None),
        ({"highway": "proposed"}, None),
        ({"oneway": "yes"}, None),
    ],
)
def test_resolve_way(spark, tags, want):
    got = spark.createDataFrame([(tags,)], "tags map<string,string>").select(roads.resolve_way("tags").alias("w")).first().w
    assert (tuple(got) if got else None) == want


def lattice(spark, side, seed=0, oneways=0.15):
    """Ways of a street lattice, their restrictions, and the same graph as plain Python."""
    rng = random.Random(seed)
    lat = lambda r: 38.0 + 0.002 * r
    lng = lambda c: -0.9 + 0.002 * c
    ways = []
    for r in range(side):
        ways.append((r, {"highway": rng.choice(["track", "primary"]), "name": f"R{r}"}, [(lat(r), lng(c)) for c in range(side)]))
    for c in range(side):
        tags = {"highway": "residential"}
        if rng.random() < oneways:
            tags["oneway"] = rng.choice(["yes", "-1"])
        ways.append((100 + c, tags, [(lat(r), lng(c)) for r in range(side)]))
    return spark.createDataFrame(ways, WAYS)


def build(spark, side, seed):
    nodes, edges = roads.morton_renumber(roads.segmentize(lattice(spark, side, seed)))
    dedges = roads.directed_edges(edges)
    rng = random.Random(seed)
    es = {r.edge_id: r for r in edges.collect()}
    at = {}
    for e in es.values():
        at.setdefault(e.a, []).append(e.edge_id), at.setdefault(e.b, []).append(e.edge_id)
    bans = set()
    for via in rng.sample(sorted(at), len(at) // 3):
        bans.add((via, rng.choice(at[via]), rng.choice(at[via])))
    return nodes, edges, dedges, spark.createDataFrame(sorted(bans), "via bigint, from_edge bigint, to_edge bigint"), bans


def reference_cost(nodes, states, bans, origin, goal):
    """Dijkstra over directed edges."""
    if origin == goal:
        return 0

    def bearing(s):
        (la1, ln1), (la2, ln2) = (map(math.radians, nodes[s.tail]), map(math.radians, nodes[s.head]))
        y = math.sin(ln2 - ln1) * math.cos(la2)
        x = math.cos(la1) * math.sin(la2) - math.sin(la1) * math.cos(la2) * math.cos(ln2 - ln1)
        return math.degrees(math.atan2(y, x))

    out = {}
    for s in states:
        out.setdefault(s.tail, []).append(s)
    heap = [(s.cost_cs, s.state_id, s) for s in out.get(origin, [])]
    heapq.heapify(heap)
    done = set()
    while heap:
        g, sid, s = heapq.heappop(heap)
        if sid in done:
            continue
        done.add(sid)
        if s.head == goal:
            return g
        for q in out.get(s.head, []):
            if (s.head, s.edge_id, q.edge_id) in bans:
                continue
            turn = abs((bearing(q) - bearing(s) + 180) % 360 - 180)
            heapq.heappush(heap, (g + q.cost_cs + (9000 if turn >= 150 else 0), q.state_id, q))
    return None


@pytest.mark.parametrize("seed, block", [(1, 13)])
def test_routes_equal_a_plain_search(spark, seed, block):
    nodes, edges, dedges, bans, ban_set = build(spark, 5, seed)
    turns = roads.turn_graph(dedges, nodes, bans)
    xy = {r.node_id: (r.lat, r.lng) for r in nodes.collect()}
    states = dedges.collect()
    rng = random.Random(seed)
    pairs = [(i, rng.randrange(25), rng.randrange(25)) for i in range(12)] + [(12, 3, 3)]
    ods = spark.createDataFrame(pairs, "od_id bigint, origin bigint, goal bigint")
    got = {r.od_id: r.cost_cs for r in graph.od_costs(ods, turns, dedges, block).collect()}
    want = {i: reference_cost(xy, states, ban_set, o, g) for i, o, g in pairs}
    assert got == want

    requests = spark.createDataFrame(
        [(i, xy[o][0] + 1e-5, xy[o][1], xy[g][0], xy[g][1] + 1e-5) for i, o, g in pairs] + [(99, 50.0, 0.0, 38.0, -0.9)],
        "od_id bigint, from_lat double, from_lng double, to_lat double, to_lng double",
    )
    main = nodes.select("node_id")
    tables = routes.compute_routes(requests, nodes, edges, dedges, turns, main, roads.degrees(edges), block)
    summary = {r.od_id: r for r in tables.summary.collect()}
    assert summary[99].reason == "origin_off_road"
    arcs = {(r.p, r.q): r.cost_cs for r in turns.collect()}
    by_ends = {}
    for s in states:
        by_ends[(s.tail, s.head)] = s
    walk = {}
    for r in tables.points.orderBy("od_id", "pos").collect():
        walk.setdefault(r.od_id, []).append(r)
    for i, o, g in pairs:
        if want[i] is None:
            assert summary[i].reason == "unreachable" and i not in walk
            continue
        assert summary[i].search_cost_s == want[i] / 100
        line = [r.node for r in walk[i]]
        assert line[0] == o and line[-1] == g and [r.pos for r in walk[i]] == list(range(len(line)))
        hops = [by_ends[pair] for pair in zip(line, line[1:])]
        total = hops[0].cost_cs + sum(arcs[(p.state_id, q.state_id)] for p, q in zip(hops, hops[1:])) if hops else 0
        assert total == want[i]
        assert abs(summary[i].duration_s - sum(h.cost_cs for h in hops) / 100) < 1e-9
    steps = {}
    for r in tables.steps.orderBy("od_id", "step").collect():
        steps.setdefault(r.od_id, []).append(r)
    assert [s.type for s in steps[12]] == ["depart", "arrive"]
    for i, s in steps.items():
        assert s[0].type == "depart" and s[-1].type == "arrive" and s[-1].dist_m == 0.0
        assert abs(sum(x.dist_m for x in s) - summary[i].distance_m) < 1e-6


def brute_scc(pairs):
    out, nodes = {}, set()
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        nodes |= {a, b}

    def reach(s):
        seen, stack = {s}, [s]
        while stack:
            for n in out.get(stack.pop(), []):
                if n not in seen:
                    seen.add(n), stack.append(n)
        return seen

    r = {n: reach(n) for n in nodes}
    comps = {frozenset(m for m in r[n] if n in r[m]) for n in nodes}
    return max(comps, key=lambda c: (len(c), -min(c)))


@pytest.mark.parametrize("seed", [2])
def test_largest_scc(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(46)] + [(50, 51), (51, 50)]
    dedges = spark.createDataFrame(pairs, "tail bigint, head bigint")
    got = {r.node_id for r in graph.largest_scc(dedges, block=8).collect()}
    assert got == set(brute_scc(pairs))


@pytest.mark.parametrize("links", [200_000, 0, 9])
def test_rings_do_not_take_a_round_each(spark, monkeypatch, links):
    rounds = []
    kept = graph._pivots
    monkeypatch.setattr(graph, "_pivots", lambda *a: rounds.append(1) or kept(*a))
    monkeypatch.setattr(graph, "LINKS_IN_BLOCK", links)
    pairs = [(10 * k + i, 10 * k + (i + 1) % (k + 3)) for k in range(6) for i in range(k + 3)]
    pairs += [(10 * k + i, 10 * k + (i + 2) % (k + 3)) for k in range(6) for i in range(k + 3)]  # no chains
    pairs += [(-k, 10 * (k % 6)) for k in range(1, 9)] + [(10 * (k % 6), -k) for k in range(1, 9, 2)]
    got = {r.node_id for r in graph.largest_scc(spark.createDataFrame(pairs, "tail bigint, head bigint"), block=4).collect()}
    assert got == set(brute_scc(pairs))
    assert len(rounds) <= 2


def test_snap_equals_brute_force(spark):
    rng = random.Random(4)
    nodes = [(i, 38 + rng.random() * 0.03, -0.9 + rng.random() * 0.03) for i in range(60)]
    points = [(i, 37.99 + rng.random() * 0.05, -0.91 + rng.random() * 0.05) for i in range(150)]
    n = spark.createDataFrame(nodes, "node_id bigint, lat double, lng double")
    p = spark.createDataFrame(points, "point_id bigint, lat double, lng double")
    dist = geo.haversine_m("p.lat", "p.lng", "n.lat", "n.lng")
    brute = p.alias("p").crossJoin(n.alias("n")).select("p.point_id", F.struct(dist.alias("d"), "n.node_id").alias("s"))
    want = {r.point_id: r.s.node_id for r in brute.filter("s.d <= 500").groupBy("point_id").agg(F.min("s").alias("s")).collect()}
    got = {r.point_id: r.node_id for r in routes.snap_to_nodes(p, n).collect()}
    assert got == want and 0 < len(want) < 150


def test_restriction_fixture(spark):
    # a cross: via node v in the middle of four ways
    arm = lambda la, ln: [(38.0, -0.9), (38.0 + la, -0.9 + ln)]
    ways = [(1, {"highway": "track"}, arm(0.001, 0)), (2, {"highway": "track"}, arm(0, 0.001)),
            (3, {"highway": "track"}, arm(-0.001, 0)), (4, {"highway": "track"}, arm(0, -0.001))]
    nodes, edges = roads.morton_renumber(roads.segmentize(spark.createDataFrame(ways, WAYS)))
    m = lambda f, v, t: [("way", f, "from"), ("node", v, "via"), ("way", t, "to")]
    only = {"restriction": "only_straight_on"}
    rels = [
        (1, only, m(1, 77, 3)), (2, {"restriction": "no_left_turn"}, m(2, 77, 4)), (3, {"restriction": "no_left_turn"}, m(2, 77, 4)),
        (4, {"restriction:conditional": "no_left_turn @ x"}, m(2, 77, 4)), (5, {"restriction": "odd"}, m(2, 77, 4)),
        (6, {"restriction": "no_entry", "except": "bicycle; motorcar"}, m(2, 77, 4)), (7, {"restriction": "no_entry"}, [("way", 9, "via")]),
        (8, {"restriction": "no_entry"}, []), (9, {"restriction": "no_entry"}, m(2, 78, 4)), (10, {"restriction": "no_entry"}, m(2, 77, 99)), (11, {}, []),
    ]
    rels = spark.createDataFrame(rels, "id bigint, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>")
    spots = spark.createDataFrame([(77, 38.0000001, -0.9), (78, 39.0, 0.0)], "id bigint, lat double, lon double")
    way_of = {r.edge_id: r.way_id for r in edges.collect()}
    bans = roads.turn_bans(rels, spots, nodes, edges)
    assert {(way_of[r.from_edge], way_of[r.to_edge]) for r in bans.collect()} == {(1, 1), (1, 2), (1, 4), (2, 4)}
    located = roads.locate_via(roads.described_restrictions(rels), spots, nodes)
    report = {r.reason: r.n for r in roads.restriction_report(located, edges).collect()}
    assert report == {"relations": 11, "kept_relations": 3, "conditional": 1, "unknown_type": 1, "excepted": 1, "via_way": 1,
                      "no_via_node": 1, "via_off_graph": 1, "edge_off_graph": 1, "kept_rows": 4, "interior_via": 0}
    assert {r.violations for r in roads.check_bans(bans, nodes, edges).collect()} == {0}
    bad = bans.unionByName(bans.limit(1)).unionByName(spark.createDataFrame([(999, 0, 0)], bans.schema))
    checks = {r.check: r.violations for r in roads.check_bans(bad, nodes, edges).collect()}
    assert checks == {"unknown_via": 1, "from_not_at_via": 1, "to_not_at_via": 1, "duplicates": 1}


def test_dense_ids_and_deltas(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k", "id AS v")
    got = [(r.i, r.k) for r in roads.dense_ids(df, ["k"], "i", parts=7).collect()]
    assert sorted(i for i, _ in got) == list(range(1000)) and [k for _, k in sorted(got)] == sorted(k for _, k in got)
    numbered = roads.dense_ids(df, ["k"], "i", parts=7)
    assert roads.check_roundtrip(numbered, ["k", "v"], "i", block=64).count() == 0
    encoded = roads.delta_encode(numbered, ["k"], "i", block=64)
    assert encoded.agg(F.max(F.when(F.col("i") % 64 != 0, F.col("k")))).first()[0] < 10


def test_box_and_tiles(spark):
    pts = spark.createDataFrame([(38.0, -0.9), (38.3, -0.85)], "lat double, lng double")
    tiles = roads.tile_grid(roads.bbox(pts, 0.0)).collect()
    assert len(tiles) == 3 and max(t.north - t.south for t in tiles) <= 0.12
    with pytest.raises(Exception, match="no coordinates"):
        roads.bbox(pts.limit(0)).collect()


def test_segments_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(roads, "BLOCK", 4)
    v = spark.range(10).selectExpr("1 AS w", "id AS pos", "38 + id * 0.001D AS lat", "-0.9D AS lng")
    got = sorted((r.pos, round(r.b_lat - r.a_lat, 6)) for r in roads.chain_segments(v, ["w"]).collect())
    assert got == [(i, 0.001) for i in range(9)]
    m = routes.measured_points(v, ["w"])
    assert abs(m.agg(F.max("cum_m")).first()[0] - 9 * 111.1949) < 0.01
    small = routes.running_sum(v.withColumn("one", F.lit(1.0)), ["w"], "pos", "one", "s", block=3)
    assert [r.s for r in small.orderBy("pos").collect()] == [float(i) for i in range(1, 11)]


def test_block_searches_are_not_put_together_by_their_small_size(spark):
    rows = spark.range(64).selectExpr("id AS block", "CAST(0 AS BIGINT) AS grp", "id")

    def kernel(key, labels, arcs):
        return labels[["block"]]

    out = graph._by_block(rows, rows, kernel, "block bigint").withColumn("task", F.spark_partition_id())
    found = cut(out).collect()
    assert sorted(r["block"] for r in found) == list(range(64))
    assert len({r["task"] for r in found}) > spark.sparkContext.defaultParallelism
