"""Road network, routing and tracks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sendero.functions import fixed_values as fx
from sendero.functions import geo, guidance
from sendero.operators import chains, components, graph, roads, routes, tracks
from sendero.plans.session import cut

from . import inputs as inp
from . import sql
from .functions import _BITS, registry
from .inputs import Tables, duck

QUERIES, ORACLES, query = registry()

NODES, EDGES, VERTICES, FIXES = duck(inp.NODES), duck(inp.EDGES), duck(inp.WAY_VERTICES), duck(inp.FIXES)


def both_ways(edges: str) -> str:
    return f"(SELECT edge_id * 2 AS state_id, edge_id, a AS tail, b AS head, cost_cs FROM ({edges}) UNION ALL SELECT edge_id * 2 + 1, edge_id, b, a, cost_cs FROM ({edges}) WHERE NOT oneway)"


DEDGES = both_ways(EDGES)


def nodes(t: Tables):
    return t(inp.NODES).withColumns({"mlat": geo.micro("lat"), "mlng": geo.micro("lng")})


def edges(t: Tables):
    return cut(t(inp.EDGES), "edges")


@query("u03_directed_edges", f"SELECT * FROM {DEDGES}")
def u03(t):
    return roads.directed_edges(t(inp.EDGES))


@query("a07_bounding_box", f"SELECT round(min(lat) - 0.05, 6) AS south, round(min(lng) - 0.05, 6) AS west, round(max(lat) + 0.05, 6) AS north, round(max(lng) + 0.05, 6) AS east FROM ({duck(inp.PLACES)})")
def a07(t):
    box = roads.bbox(t(inp.PLACES), fx.MAP_MARGIN_DEG)
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query("a08_dictionaries", f"SELECT DISTINCT 'class' AS kind, cls AS value FROM ({EDGES}) UNION SELECT DISTINCT 'name', name FROM ({EDGES}) WHERE name IS NOT NULL")
def a08(t):
    return roads.dictionaries(t(inp.EDGES))


@query("a09_degrees", f"SELECT node, count(*) AS degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT a AS node, 1 AS o FROM ({EDGES}) UNION ALL SELECT b, CASE WHEN oneway THEN 0 ELSE 1 END FROM ({EDGES})) GROUP BY node")
def a09(t):
    return roads.degrees(t(inp.EDGES))


@query("a10_component_sizes", "SELECT comp, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, comp) = 1 AS largest FROM (SELECT CAST(c_nationkey AS BIGINT) AS comp, count(*) AS n FROM customer GROUP BY 1)")
def a10(t):
    members = t("SELECT c_custkey AS vertex, CAST(c_nationkey AS BIGINT) AS comp FROM {customer}")
    return components.component_sizes(members).withColumn("share", F.round("share", 6))


@query("w02_segments", f"SELECT * FROM (SELECT way_id, pos, lat AS a_lat, lng AS a_lng, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM ({VERTICES}) WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE b_lat IS NOT NULL")
def w02(t):
    return roads.chain_segments(t(inp.WAY_VERTICES), ["way_id"])


SEGMENTS = f"""(SELECT s.way_id, pos, CASE WHEN one < 0 THEN b_lat ELSE a_lat END AS a_lat, CASE WHEN one < 0 THEN b_lng ELSE a_lng END AS a_lng,
   CASE WHEN one < 0 THEN a_lat ELSE b_lat END AS b_lat, CASE WHEN one < 0 THEN a_lng ELSE b_lng END AS b_lng, speed, one <> 0 AS oneway, highway AS cls
 FROM (SELECT way_id, pos + 1 AS pos, lat AS a_lat, lng AS a_lng, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM ({VERTICES}) WINDOW w AS (PARTITION BY way_id ORDER BY pos)) s
 JOIN (SELECT way_id, highway, CASE highway WHEN 'track' THEN 20 WHEN 'residential' THEN 40 WHEN 'primary' THEN 80 WHEN 'service' THEN 30 WHEN 'footway' THEN CASE WHEN motor_vehicle = 'yes' THEN 20 END END AS speed,
      CASE motor_vehicle WHEN 'yes' THEN true WHEN 'no' THEN false ELSE CASE access WHEN 'private' THEN false ELSE true END END AS allowed,
      CASE oneway WHEN 'yes' THEN 1 WHEN '-1' THEN -1 WHEN 'no' THEN 0 ELSE CASE WHEN junction = 'roundabout' THEN 1 ELSE 0 END END AS one FROM ({duck(inp.WAY_TAGS)})) g ON g.way_id = s.way_id
 WHERE b_lat IS NOT NULL AND speed IS NOT NULL AND allowed AND (a_lat <> b_lat OR a_lng <> b_lng))"""


def ways(t: Tables):
    """Ways with tags from orders and their vertices from the order lines."""
    keys = ["highway", "motor_vehicle", "access", "oneway", "junction"]
    tags = F.map_filter(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
    line = F.array_sort(F.collect_list(F.struct("pos", "lat", F.col("lng").alias("lon"))))
    shapes = t(inp.WAY_VERTICES).groupBy("way_id").agg(line.alias("line"))
    geometry = F.transform("line", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return t(inp.WAY_TAGS).join(shapes, "way_id").select(F.col("way_id").alias("id"), tags.alias("tags"), geometry.alias("geometry"))


MEASURED = f"SELECT *, {sql.haversine('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS length_m FROM {SEGMENTS}"


@query(
    "w02_x16_segmentize",
    f"SELECT way_id, pos, a_lat, a_lng, b_lat, b_lng, oneway, cls, round(length_m, 3) AS length_m, CAST(greatest(1, round_even(360 * length_m / speed, 0)) AS INTEGER) AS cost_cs FROM ({MEASURED})",
)
def segmentize(t):
    columns = ["way_id", "pos", "a_lat", "a_lng", "b_lat", "b_lng", "oneway", "cls"]
    return roads.segmentize(ways(t)).select(*columns, F.round("length_m", 3).alias("length_m"), "cost_cs")


MICRO = "CAST(round_even({0} * 1000000, 0) AS BIGINT)"
RENUMBERED = f"""WITH seg AS (SELECT *, {MICRO.format('a_lat')} AS ay, {MICRO.format('a_lng')} AS ax, {MICRO.format('b_lat')} AS b_y, {MICRO.format('b_lng')} AS b_x FROM ({MEASURED})),
  spots AS (SELECT DISTINCT my, mx FROM (SELECT ay AS my, ax AS mx FROM seg UNION ALL SELECT b_y, b_x FROM seg)),
  nodes AS (SELECT my, mx, row_number() OVER (ORDER BY m) - 1 AS node_id FROM (SELECT *, {_BITS} AS m FROM (SELECT *, my + 200000000 AS y, mx + 200000000 AS x FROM spots)))"""


@query("w10_morton_nodes", f"{RENUMBERED} SELECT node_id, my AS mlat, mx AS mlng FROM nodes")
def w10_nodes(t):
    return roads.morton_nodes(roads.segmentize(ways(t))).select("node_id", "mlat", "mlng")


@query(
    "w10_edge_ids",
    f"""{RENUMBERED} SELECT row_number() OVER (ORDER BY a.node_id, b.node_id, way_id, pos) - 1 AS edge_id, a.node_id AS a, b.node_id AS b, way_id
    FROM seg JOIN nodes a ON a.my = ay AND a.mx = ax JOIN nodes b ON b.my = b_y AND b.mx = b_x""",
)
def w10_edges(t):
    return roads.morton_renumber(cut(roads.segmentize(ways(t)), "segments"))[1].select("edge_id", "a", "b", "way_id")


CODED = "SELECT o_orderkey AS k, o_custkey AS u, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM {orders}"


@query("w05_delta_encode", f"SELECT k, k // 4096 AS block, u - coalesce(lag(u) OVER w, 0) AS u, v - coalesce(lag(v) OVER w, 0) AS v FROM ({duck(CODED)}) WINDOW w AS (PARTITION BY k // 4096 ORDER BY k)")
def w05(t):
    return roads.delta_encode(t(CODED), ["u", "v"], "k")


@query("w06_delta_decode", f"SELECT k, u, v FROM ({duck(CODED)})")
def w06(t):
    return roads.delta_decode(roads.delta_encode(t(CODED), ["u", "v"], "k"), ["u", "v"], "k")


@query("q02_roundtrip", f"SELECT k, u, v FROM ({duck(CODED)}) WHERE false")
def q02(t):
    return roads.check_roundtrip(t(CODED), ["u", "v"], "k")


AROUND = f"(SELECT *, lag(lat) OVER w AS p_lat, lag(lng) OVER w AS p_lng, lead(lat) OVER w AS n_lat, lead(lng) OVER w AS n_lng FROM ({VERTICES}) WINDOW w AS (PARTITION BY way_id ORDER BY pos))"


@query(
    "w03_cumulative_distance",
    f"SELECT way_id, pos, round(sum(d) OVER (PARTITION BY way_id ORDER BY pos), 3) AS cum_m FROM (SELECT way_id, pos, coalesce({sql.haversine('p_lat', 'p_lng', 'lat', 'lng')}, 0) * (CASE WHEN p_lat IS NULL THEN 0 ELSE 1 END) AS d FROM {AROUND})",
)
def w03(t):
    return routes.measured_points(t(inp.WAY_VERTICES), ["way_id"]).select("way_id", "pos", F.round("cum_m", 3).alias("cum_m"))


@query(
    "w04_heading_change",
    f"SELECT way_id, pos, round({sql.wrap('(o - i)')}, 6) AS turn FROM (SELECT *, {sql.bearing('p_lat', 'p_lng', 'lat', 'lng')} AS i, {sql.bearing('lat', 'lng', 'n_lat', 'n_lng')} AS o FROM {AROUND}) WHERE i IS NOT NULL AND o IS NOT NULL",
)
def w04(t):
    around = routes.with_neighbours(t(inp.WAY_VERTICES), ["way_id"], "pos", ["lat", "lng"])
    return routes.with_turns(around).filter("turn_deg IS NOT NULL").select("way_id", "pos", F.round("turn_deg", 6).alias("turn"))


# --- restrictions ---------------------------------------------------------------------------------------

RESTRICTIONS = duck(inp.RESTRICTIONS)


def restrictions(t: Tables):
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), F.col(ref).cast("bigint").alias("ref"), F.lit(role).alias("role"))
    return t(inp.RESTRICTIONS).select(
        F.col("rel_id").alias("id"),
        F.create_map(F.lit("restriction"), F.col("restriction"), F.lit("except"), F.col("except_val")).alias("tags"),
        F.array(member("way", "from_way", "from"), member("node", "via", "via"), member("way", "to_way", "to")).alias("members"),
    )


def osm_nodes(t: Tables):
    return t(inp.NODES).select(F.col("node_id").alias("id"), (F.col("lat") + 1e-8).alias("lat"), F.col("lng").alias("lon"))


def located(t: Tables):
    return roads.locate_via(roads.described_restrictions(restrictions(t)), osm_nodes(t), nodes(t))


VERDICT = "CASE WHEN restriction = 'other' THEN 'unknown_type' WHEN except_val <> '' THEN 'excepted' END"


@query("j10_locate_via", f"SELECT rel_id, {VERDICT} AS verdict, node_id AS via FROM ({RESTRICTIONS}) r LEFT JOIN ({NODES}) n ON n.node_id = r.via")
def j10(t):
    return located(t).select("rel_id", "verdict", "via")


@query("j11_incident_edges", f"SELECT rel_id, via, from_way AS way_id, edge_id FROM ({RESTRICTIONS}) JOIN ({EDGES}) e ON way_id = from_way AND (a = via OR b = via)")
def j11(t):
    asked = t(inp.RESTRICTIONS).select("rel_id", "via", F.col("from_way").alias("way_id"))
    return roads.incident_edges(asked, edges(t)).select("rel_id", "via", "way_id", "edge_id")


BANS = f"""(SELECT DISTINCT rel_id, via, f.edge_id AS from_edge, x.edge_id AS to_edge FROM (SELECT * FROM ({RESTRICTIONS}) WHERE {VERDICT} IS NULL) r
  JOIN ({EDGES}) f ON f.way_id = from_way AND (f.a = via OR f.b = via) JOIN ({EDGES}) x ON (x.a = via OR x.b = via)
  WHERE EXISTS (SELECT 1 FROM ({EDGES}) g WHERE g.way_id = to_way AND (g.a = via OR g.b = via))
  AND CASE WHEN restriction LIKE 'no_%' THEN x.way_id = to_way ELSE x.way_id <> to_way END)"""


@query("j12_u02_turn_bans", f"SELECT DISTINCT via, from_edge, to_edge FROM {BANS}")
def j12(t):
    return roads.turn_bans(restrictions(t), osm_nodes(t), nodes(t), edges(t))


TOUCH = lambda way: f"(SELECT count(*) FROM ({EDGES}) e WHERE e.way_id = {way} AND (e.a = via OR e.b = via))"
REPORT = f"""WITH r AS (SELECT rel_id, {VERDICT} AS verdict, node_id AS on_graph, {TOUCH('from_way')} AS nf, {TOUCH('to_way')} AS nt FROM ({RESTRICTIONS}) LEFT JOIN ({NODES}) n ON n.node_id = via),
  j AS (SELECT *, CASE WHEN verdict IS NOT NULL THEN verdict WHEN on_graph IS NULL THEN 'via_off_graph' WHEN rel_id IN (SELECT rel_id FROM {BANS}) THEN 'kept_relations' WHEN nf = 0 OR nt = 0 THEN 'edge_off_graph' ELSE 'ignored' END AS reason FROM r)
  SELECT reason, count(*) AS n FROM j WHERE reason <> 'ignored' GROUP BY reason UNION ALL SELECT 'relations', count(*) FROM j
  UNION ALL SELECT 'interior_via', CAST(coalesce(sum((CASE WHEN nf > 1 THEN 1 ELSE 0 END) + (CASE WHEN nf > 0 AND nt > 1 THEN 1 ELSE 0 END)), 0) AS BIGINT) FROM j WHERE verdict IS NULL AND on_graph IS NOT NULL
  UNION ALL SELECT 'kept_rows', count(*) FROM (SELECT DISTINCT via, from_edge, to_edge FROM {BANS})"""


@query("a12_restriction_report", REPORT)
def a12(t):
    return roads.restriction_report(cut(located(t), "located"), edges(t))


@query("q03_check_bans", """SELECT unnest(['unknown_via', 'from_not_at_via', 'to_not_at_via', 'duplicates']) AS "check", CAST(0 AS BIGINT) AS violations""")
def q03(t):
    kept = edges(t)
    return roads.check_bans(cut(roads.turn_bans(restrictions(t), osm_nodes(t), nodes(t), kept), "bans"), nodes(t), kept)


# every ban again, once at a node that is not there and once from an edge that is not there
@query(
    "q03_broken_bans",
    f"""WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT via, from_edge, to_edge FROM {BANS}))
    SELECT 'unknown_via' AS "check", n AS violations FROM n UNION ALL SELECT 'from_not_at_via', 2 * n FROM n UNION ALL SELECT 'to_not_at_via', n FROM n UNION ALL SELECT 'duplicates', n FROM n""",
)
def q03_broken(t):
    kept = edges(t)
    bans = cut(roads.turn_bans(restrictions(t), osm_nodes(t), nodes(t), kept).select("via", "from_edge", "to_edge").distinct(), "bans")
    lost = bans.withColumn("via", F.col("via") + 1_000_000_000)
    loose = bans.withColumn("from_edge", F.col("from_edge") + 1_000_000_000)
    return roads.check_bans(bans.unionByName(bans).unionByName(lost).unionByName(loose), nodes(t), kept)


def turns_of(dedges: str, sites: str, bans: str) -> str:
    aimed = f"(SELECT d.*, {sql.bearing('m.lat', 'm.lng', 'n.lat', 'n.lng')} AS brg FROM {dedges} d JOIN ({sites}) m ON m.node_id = tail JOIN ({sites}) n ON n.node_id = head)"
    return f"""(SELECT p.state_id AS p, q.state_id AS q, p.head AS via, CAST(q.cost_cs + CASE WHEN abs({sql.wrap('(q.brg - p.brg)')}) >= 150 THEN 9000 ELSE 0 END AS BIGINT) AS cost_cs
  FROM {aimed} p JOIN {aimed} q ON q.tail = p.head WHERE NOT EXISTS (SELECT 1 FROM {bans} b WHERE b.via = p.head AND b.from_edge = p.edge_id AND b.to_edge = q.edge_id))"""


TURNS = turns_of(DEDGES, NODES, BANS)


def network(t: Tables):
    """(nodes, edges, directed edges, turns) of the lattice with its restrictions."""
    kept = edges(t)
    dedges = cut(roads.directed_edges(kept), "dedges")
    sites = cut(nodes(t), "nodes")
    bans = roads.turn_bans(restrictions(t), osm_nodes(t), sites, kept)
    return sites, kept, dedges, cut(roads.turn_graph(dedges, sites, bans), "turns")


@query("j13_turn_graph", f"SELECT * FROM {TURNS}")
def j13(t):
    return network(t)[3]


# --- iterative jobs ----------------------------------------------------------------------------------------


REACH = f"""WITH RECURSIVE d AS (SELECT DISTINCT tail, head FROM {DEDGES}), hub AS (SELECT tail AS node FROM d GROUP BY tail ORDER BY count(*) DESC, tail LIMIT 1),
  f(node) AS (SELECT node FROM hub UNION SELECT head FROM f JOIN d ON tail = node), b(node) AS (SELECT node FROM hub UNION SELECT tail FROM b JOIN d ON head = node)"""


# the pivot's component is the largest as it holds more than half of the nodes
@query("g02_largest_scc", f"{REACH} SELECT node AS node_id FROM f WHERE node IN (SELECT node FROM b)")
def g02(t):
    return graph.largest_scc(cut(roads.directed_edges(t(inp.EDGES)), "dedges"))


PAIRS = "SELECT c_custkey AS od_id, 1 + (c_custkey * 7919) % (n - 1) AS origin, 1 + (c_custkey * 104729 + c_nationkey * 31) % (n - 1) AS goal FROM {customer} JOIN (SELECT count(*) AS n FROM {part}) c ON true WHERE c_custkey % 50 = 0"


def costs_of(pairs: str, turns: str, dedges: str) -> str:
    return f"""WITH RECURSIVE ods AS MATERIALIZED ({pairs}), turns AS MATERIALIZED (SELECT * FROM {turns}), dedges AS MATERIALIZED (SELECT * FROM {dedges}),
  best(origin, state, cost) USING KEY (origin, state) AS (
    SELECT DISTINCT origin, state_id, CAST(cost_cs AS BIGINT) FROM ods JOIN dedges ON tail = origin WHERE origin <> goal
    UNION
    SELECT n.origin, n.state, n.cost FROM (SELECT b.origin, q AS state, min(b.cost + turns.cost_cs) AS cost FROM best b JOIN turns ON p = b.state GROUP BY 1, 2) n
    LEFT JOIN recurring.best r ON r.origin = n.origin AND r.state = n.state WHERE r.cost IS NULL OR n.cost < r.cost),
  costs AS (SELECT od_id, origin, goal, CASE WHEN origin = goal THEN 0 ELSE (SELECT min(b.cost) FROM best b JOIN dedges d ON d.state_id = b.state WHERE d.head = goal AND b.origin = ods.origin) END AS cost_cs FROM ods)"""


COSTS = costs_of(duck(PAIRS), TURNS, DEDGES)
# equally dear paths: the smallest predecessor, from the goal backwards; edges that leave the origin begin a path
WALK = """ends AS (SELECT od_id, o.origin, goal, arg_min(b.state, (b.cost, b.state)) AS state FROM ods o JOIN dedges d ON d.head = goal JOIN best b ON b.state = d.state_id AND b.origin = o.origin WHERE o.origin <> goal GROUP BY 1, 2, 3),
  prev AS MATERIALIZED (SELECT b.origin, b.state, min(t.p) AS up FROM best b JOIN dedges d ON d.state_id = b.state AND d.tail <> b.origin JOIN turns t ON t.q = b.state JOIN best a ON a.origin = b.origin AND a.state = t.p WHERE a.cost + t.cost_cs = b.cost GROUP BY 1, 2),
  walk(od_id, origin, state, back) AS (SELECT od_id, origin, state, 0 FROM ends UNION ALL SELECT w.od_id, w.origin, up, back + 1 FROM walk w JOIN prev p ON p.origin = w.origin AND p.state = w.state),
  sized AS (SELECT od_id, max(back) AS last FROM walk GROUP BY 1)"""


@query("g03_od_costs", f"{COSTS} SELECT * FROM costs")
def g03(t):
    sites, _, dedges, turns = network(t)
    return graph.od_costs(t(PAIRS), turns, dedges, nodes=sites)


@query("g03_od_costs_in_blocks", f"{COSTS} SELECT * FROM costs")
def g03_blocks(t):
    sites, _, dedges, turns = network(t)
    return graph.od_costs(t(PAIRS), turns, dedges, block=512, nodes=sites)


# --- chains of orders


CHAIN_DEDGES = both_ways(duck(inp.CHAIN_EDGES))
CHAIN_TURNS = turns_of(CHAIN_DEDGES, duck(inp.CHAIN_NODES), f"({duck(inp.CHAIN_BANS)})")


def chain_network(t: Tables):
    """(nodes, directed edges, turns) of the chains of orders."""
    dedges = cut(roads.directed_edges(t(inp.CHAIN_EDGES)), "dedges")
    sites = cut(t(inp.CHAIN_NODES), "nodes")
    return sites, dedges, cut(roads.turn_graph(dedges, sites, t(inp.CHAIN_BANS)), "turns")


@query("g06_chain_costs", f"{costs_of(duck(inp.CHAIN_PAIRS), CHAIN_TURNS, CHAIN_DEDGES)} SELECT * FROM costs")
def g06_costs(t):
    sites, dedges, turns = chain_network(t)
    return graph.od_costs(t(inp.CHAIN_PAIRS), turns, dedges, nodes=sites)


@query(
    "g06_contract_chains",
    f"""WITH e AS (SELECT *, way_id AS road FROM ({duck(inp.CHAIN_EDGES)})), d AS (SELECT edge_id, road, a AS tail, b AS head, cost_cs, 1 AS way FROM e UNION ALL SELECT edge_id, road, b, a, cost_cs, -1 FROM e WHERE NOT oneway),
    g AS (SELECT d.*, {sql.bearing('m.lat', 'm.lng', 'n.lat', 'n.lng')} AS brg FROM d JOIN ({duck(inp.CHAIN_NODES)}) m ON m.node_id = tail JOIN ({duck(inp.CHAIN_NODES)}) n ON n.node_id = head),
    w AS (SELECT *, lag(brg) OVER v AS before, row_number() OVER v AS nth FROM g WINDOW v AS (PARTITION BY road, way ORDER BY edge_id * way))
    SELECT first(tail ORDER BY nth) AS tail, last(head ORDER BY nth) AS head, min(CASE WHEN nth = 1 THEN edge_id END) AS first_edge, count(*) AS edges,
      CAST(sum(cost_cs + CASE WHEN before IS NOT NULL AND abs({sql.wrap('(brg - before)')}) >= 150 THEN 9000 ELSE 0 END) AS BIGINT) AS cost_cs FROM w GROUP BY road, way""",
)
def g06(t):
    sites, dedges, turns = chain_network(t)
    made = chains.contract_chains(dedges, turns, graph.ends_of(t(inp.CHAIN_PAIRS)))
    heads = dedges.select(F.col("state_id").alias("state"), "head")
    size = made.members.groupBy("first").agg(F.count("*").alias("edges"))
    rows = made.starts.filter("NOT back").join(heads, "state").join(size, "first")
    edge = dedges.select(F.col("state_id").alias("first"), F.col("edge_id").alias("first_edge"))
    return rows.join(edge, "first").select("tail", "head", "first_edge", "edges", "cost_cs")


LINKS = f"(SELECT tail, head FROM ({duck(inp.CHAIN_LINKS)}) WHERE head IS NOT NULL)"


# customer 1 is on a ring, which is the largest component where no other ring is as large
@query(
    "g02_long_chains",
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT tail, head FROM {LINKS}),
    f(node) AS (SELECT 1 UNION SELECT head FROM f JOIN d ON tail = node), b(node) AS (SELECT 1 UNION SELECT tail FROM b JOIN d ON head = node)
    SELECT CAST(node AS BIGINT) AS node_id FROM f WHERE node IN (SELECT node FROM b)""",
)
def g02_chains(t):
    # suppliers after all customers, so that of equally large rings that of the smallest customer is taken
    last = t.table("customer").agg(F.max("c_custkey")).first()[0] + 1
    after = lambda c: F.when(F.col(c) < 0, last - F.col(c)).otherwise(F.col(c)).alias(c)
    links = t(inp.CHAIN_LINKS).filter("head IS NOT NULL").select(after("tail"), after("head"))
    node = F.col("node_id")
    return graph.largest_scc(cut(links, "links")).select(F.when(node > last, last - node).otherwise(node).alias("node_id"))


def requests(t: Tables):
    """The same pairs as positions a few metres off their nodes."""
    at = lambda end: t(inp.NODES).select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lng").alias(f"{end}_lng"))
    return (
        t(PAIRS).join(at("origin"), "origin").join(at("goal"), "goal")
        .select("od_id", (F.col("origin_lat") + 2e-5).alias("from_lat"), F.col("origin_lng").alias("from_lng"), F.col("goal_lat").alias("to_lat"), (F.col("goal_lng") + 2e-5).alias("to_lng"))
    )


def routed(t: Tables) -> routes.RouteTables:
    sites, kept, dedges, turns = network(t)
    main = cut(graph.largest_scc(dedges), "main")
    return routes.compute_routes(requests(t), sites, kept, dedges, turns, main, roads.degrees(kept))


@query("g04_routes", f"{COSTS} SELECT od_id, CASE WHEN cost_cs IS NULL THEN 'unreachable' END AS reason, round(cost_cs / 100.0, 2) AS search_cost_s FROM costs")
def g04(t):
    return routed(t).summary.select("od_id", "reason", F.round("search_cost_s", 2).alias("search_cost_s"))


@query(
    "g04_route_points",
    f"""{COSTS}, {WALK},
    pts AS (SELECT od_id, last - back AS pos, tail AS node, edge_id FROM walk JOIN sized USING (od_id) JOIN dedges ON state_id = state
      UNION ALL SELECT od_id, last + 1, goal, NULL FROM ends JOIN sized USING (od_id) UNION ALL SELECT od_id, 0, goal, NULL FROM ods WHERE origin = goal)
    SELECT od_id, CAST(pos AS BIGINT) AS pos, node, lat, lng, e.name FROM pts JOIN ({NODES}) ON node_id = node LEFT JOIN ({EDGES}) e USING (edge_id)""",
)
def g04_points(t):
    return routed(t).points.select("od_id", "pos", "node", "lat", "lng", "name")


STEP_POINTS = f"SELECT p.route_id AS od_id, pos, lat, lng, node, CASE WHEN node % 3 = 0 THEN c_name END AS name FROM (SELECT *, route_id + (SELECT count(DISTINCT user_id) FROM {{events}}) * pos AS node FROM ({inp.ROUTE_POINTS}) z) p JOIN {{customer}} ON c_custkey = node"
DEGREES = "SELECT c_custkey AS node, CAST(1 + c_nationkey % 5 AS BIGINT) AS degree FROM {customer}"
STEPS = f"""WITH pts AS ({duck(STEP_POINTS)}), w AS (SELECT *, lag(lat) OVER v AS p_lat, lag(lng) OVER v AS p_lng, lead(lat) OVER v AS n_lat, lead(lng) OVER v AS n_lng FROM pts WINDOW v AS (PARTITION BY od_id ORDER BY pos)),
  m AS (SELECT *, CASE WHEN p_lat IS NULL THEN 0 ELSE {sql.haversine('p_lat', 'p_lng', 'lat', 'lng')} END AS hop, {sql.bearing('p_lat', 'p_lng', 'lat', 'lng')} AS i, {sql.bearing('lat', 'lng', 'n_lat', 'n_lng')} AS o FROM w),
  c AS (SELECT *, sum(hop) OVER (PARTITION BY od_id ORDER BY pos) AS cum, {sql.wrap('(o - i)')} AS turn FROM m JOIN ({duck(DEGREES)}) USING (node)),
  s AS (SELECT od_id, pos AS "at", 0 AS nth, 'depart' AS type, CASE WHEN n_lat IS NULL THEN NULL ELSE name END AS name, cum FROM c WHERE p_lat IS NULL
    UNION ALL SELECT od_id, pos, 1, {sql.turn_kind('turn')}, name, cum FROM c WHERE p_lat IS NOT NULL AND n_lat IS NOT NULL AND abs(turn) >= 25 AND degree >= 3
    UNION ALL SELECT od_id, pos, 2, 'arrive', NULL, cum FROM c WHERE n_lat IS NULL),
  steps AS (SELECT od_id, row_number() OVER k - 1 AS step, "at", type, name, coalesce(lead(cum) OVER k - cum, 0) AS dist_m FROM s WINDOW k AS (PARTITION BY od_id ORDER BY "at", nth))"""


@query("g05_w12_route_steps", f"""{STEPS} SELECT od_id, step, "at", type, name, round(dist_m, 3) AS dist_m FROM steps""")
def g05(t):
    return routes.route_steps(t(STEP_POINTS), t(DEGREES)).withColumn("dist_m", F.round("dist_m", 3))


@query("j09_snap", f"SELECT event_id AS point_id, node_id, round(d, 3) AS dist_m FROM (SELECT event_id, arg_min(node_id, (d, node_id)) AS node_id, min(d) AS d FROM (SELECT event_id, node_id, {sql.haversine('f.lat', 'f.lng', 'n.lat', 'n.lng')} AS d FROM ({FIXES}) f JOIN ({NODES}) n ON true) GROUP BY event_id) WHERE d <= 500")
def j09(t):
    points = t(inp.FIXES).select(F.col("event_id").alias("point_id"), "lat", "lng")
    return routes.snap_to_nodes(points, nodes(t)).select("point_id", "node_id", F.round("dist_m", 3).alias("dist_m"))


NEAREST = f"""(SELECT event_id AS fix_id, min(d) AS dist_m, arg_min(pos, (d, pos)) AS point_index FROM (SELECT f.event_id, pos, CASE WHEN n_lat IS NULL THEN {sql.haversine('f.lat', 'f.lng', 'r.lat', 'r.lng')} ELSE {sql.segment_dist('f.lat', 'f.lng', 'r.lat', 'r.lng', 'n_lat', 'n_lng')} END AS d
  FROM ({FIXES}) f JOIN (SELECT *, lead(lat) OVER w AS n_lat, lead(lng) OVER w AS n_lng FROM ({duck(inp.ROUTE_POINTS)}) WINDOW w AS (PARTITION BY route_id ORDER BY pos)) r ON route_id = session_id WHERE n_lat IS NOT NULL OR pos = 0) GROUP BY 1)"""


@query("j15_nearest_on_route", f"SELECT fix_id, round(dist_m, 3) AS dist_m, point_index FROM {NEAREST}")
def j15(t):
    fixes = t(inp.FIXES).select(F.col("event_id").alias("fix_id"), F.col("session_id").alias("route_id"), "lat", "lng")
    return routes.nearest_on_route(fixes, t(inp.ROUTE_POINTS)).withColumn("dist_m", F.round("dist_m", 3))


STREAKS = """WITH f AS (SELECT user_id AS session_id, ts, event_id, CASE WHEN value > 35 THEN 1 ELSE 0 END AS off FROM events),
  g AS (SELECT *, sum(1 - off) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS isl FROM f),
  h AS (SELECT *, row_number() OVER (PARTITION BY session_id, isl, off ORDER BY ts, event_id) AS rn FROM g)
  SELECT session_id, event_id AS fix_id, CASE WHEN off = 1 THEN rn ELSE 0 END AS streak, off = 1 AND rn % 2 = 0 AS reroute FROM h"""


@query("w07_off_route_streaks", STREAKS)
def w07(t):
    fixes = t("SELECT user_id AS session_id, ts, event_id AS fix_id, value AS dist_m FROM {events}")
    return tracks.off_route_streaks(fixes).select("session_id", "fix_id", "streak", "reroute")


def step_arrays(t: Tables):
    steps = cut(routes.route_steps(t(STEP_POINTS), t(DEGREES)), "steps")
    listed = F.array_sort(F.collect_list(F.struct("step", "at", "type", "name")))
    return steps.groupBy(F.col("od_id").alias("session_id")).agg(listed.alias("steps"))


@query(
    "w08_upcoming_step",
    f"""{STEPS}, q AS (SELECT event_id, user_id AS od_id, event_id % 12 AS idx FROM events WHERE user_id IN (SELECT od_id FROM steps))
    SELECT event_id, (SELECT arg_min(type, step) FROM steps s WHERE s.od_id = q.od_id AND type <> 'depart' AND "at" >= idx) AS type,
    (SELECT CAST(count(*) AS INTEGER) FROM steps s WHERE s.od_id = q.od_id AND type NOT IN ('depart', 'arrive') AND "at" >= idx) AS turns FROM q""",
)
def w08(t):
    fixes = t("SELECT user_id AS session_id, event_id, event_id % 12 AS idx FROM {events}").join(step_arrays(t), "session_id")
    return fixes.select("event_id", guidance.upcoming_step("steps", "idx")["type"].alias("type"), guidance.pending_turns("steps", "idx").alias("turns"))


@query(
    "q06_network_gate",
    f"""{COSTS}, {REACH.replace('WITH RECURSIVE ', '').replace('d AS', 'dd AS', 1).replace('FROM d ', 'FROM dd ').replace('JOIN d ', 'JOIN dd ')},
    v AS (SELECT 'main_share' AS "check", (SELECT count(*) FROM f WHERE node IN (SELECT node FROM b)) / (SELECT count(*) FROM ({NODES})) AS value
      UNION ALL SELECT 'od_connected', count(cost_cs) / count(*) FROM costs
      UNION ALL SELECT 'snap_max_m', max(d) FROM (SELECT min({sql.haversine('f.lat', 'f.lng', 'n.lat', 'n.lng')}) AS d FROM ({FIXES}) f JOIN ({NODES}) n ON true GROUP BY event_id) WHERE d <= 500
      UNION ALL SELECT 'snap_avg_m', avg(d) FROM (SELECT min({sql.haversine('f.lat', 'f.lng', 'n.lat', 'n.lng')}) AS d FROM ({FIXES}) f JOIN ({NODES}) n ON true GROUP BY event_id) WHERE d <= 500)
    SELECT "check", round(value, 3) AS value, CASE "check" WHEN 'main_share' THEN value > 0.95 WHEN 'od_connected' THEN value >= 1 ELSE value <= 500 END AS ok FROM v""",
)
def q06(t):
    sites, _, dedges, turns = network(t)
    points = t(inp.FIXES).select(F.col("event_id").alias("point_id"), "lat", "lng")
    gate = routes.network_gate(graph.largest_scc(dedges), sites, graph.od_costs(t(PAIRS), turns, dedges, nodes=sites), cut(routes.snap_to_nodes(points, sites), "snaps"))
    return gate.withColumn("value", F.round("value", 3))
