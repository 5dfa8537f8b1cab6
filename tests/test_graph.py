import random
from collections import deque

import pytest
from timeweft.operators import graph as G
from timeweft.operators import traverse as TR
from timeweft.ql.compiler import query, rendered
from timeweft.ql.syntax import Binary, Literal, Name, Not, QueryError, parse
from timeweft.sources.tables import Graph

NODES = "id string, type string, valid_from long, valid_to long, deleted boolean, ts_us long"
EDGES = "id string, src string, dst string, relation string, valid_from long, valid_to long, deleted boolean, adj_pos long, ts_us long"
PROPS = "owner_kind string, owner_id string, prop string, value string, num double, tombstone boolean, ts_us long"
LOG = "tenant string, key string, ts_us long, hlc_node tinyint, hlc_seq smallint, value string, num double, tombstone boolean, size_bytes long"
MIN = 60_000_000


def number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def graph(spark, nodes=(), edges=(), props=(), log=()):
    """nodes: (id, type[, from, to, deleted, ts]); edges: (id, src, dst, relation[, from, to, deleted, ts]); props: (kind, owner, prop, value, ts); log: (key, ts, value)."""
    n = [(i, t, *r, *[0, None, False, 0][len(r) :]) for i, t, *r in nodes]
    e = []
    for k, (i, a, b, rel, *r) in enumerate(edges):
        start, end, gone, ts = list(r) + [0, None, False, 0][len(r) :]
        e.append((i, a, b, rel, start, end, gone, k, ts))
    p = [(kind, o, name, v, number(v), v is None, ts) for kind, o, name, v, ts in props]
    lines = [("default", k, ts, 0, 0, v, number(v), v is None, len(v or "")) for k, ts, v in log]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Graph(make(n, NODES), make(e, EDGES), make(p, PROPS), make(lines, LOG))


@pytest.fixture(scope="module")
def factory(spark):
    return graph(
        spark,
        [("sensor_1", "sensor"), ("sensor_2", "sensor"), ("sensor_3", "sensor"), ("machine_1", "machine"), ("machine_2", "machine")],
        [("e1", "sensor_1", "machine_1", "monitors"), ("e2", "sensor_2", "machine_1", "monitors"), ("e3", "sensor_3", "machine_2", "monitors"), ("loop", "machine_2", "machine_2", "self")],
        [("node", "machine_1", "type", "hydraulic_press", 0), ("node", "machine_2", "type", "lathe", 0), ("edge", "e1", "weight", "0.4", 0), ("node", "sensor_1", "rank", "10", 0), ("node", "sensor_2", "rank", "9", 0)],
        [("temp:sensor_1", 5, "20.5"), ("temp:sensor_1", 9, "21"), ("temp:sensor_2", 5, "x"), ("temp:sensor_2", 6, None)],
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_match(factory):
    q = 'MATCH (s:sensor)-[r:monitors]->(m:machine) WHERE m.type = "hydraulic_press" RETURN s.id ORDER BY s.id'
    assert rows(query(factory, q)) == [("sensor_1",), ("sensor_2",)]
    assert query(factory, "MATCH (s:sensor)-[r:monitors]->(m:machine) RETURN s.id, m.id").count() == 3
    assert query(factory, "MATCH (m:machine)<-[r:monitors]-(s) RETURN s.id").count() == 3


def test_missing_property_compares_as_text(factory):
    assert query(factory, "MATCH (s:sensor)-[r:monitors]->(m) WHERE r.weight > 0.5 RETURN s.id").count() == 2
    assert query(factory, "MATCH (s:sensor)-[r:monitors]->(m) WHERE r.weight < 0.5 RETURN s.id").count() == 1
    assert query(factory, "MATCH (s:sensor)-[r:monitors]->(m) WHERE r.weight > 0.5 RETURN s.id", nulls="sql").count() == 0


def test_self_loop_counts_twice_in_both_directions(factory):
    assert query(factory, "MATCH (a:machine)-[r:self]-(b) RETURN a.id").count() == 2
    assert query(factory, "MATCH (a:machine)-[r:self]->(a) RETURN a.id").count() == 1


def test_order_offset_limit(factory):
    q = "MATCH (s:sensor) RETURN s.id, s.rank ORDER BY s.rank {} LIMIT {} OFFSET {}"
    assert [r[0] for r in rows(query(factory, q.format("ASC", 3, 0)))] == ["sensor_2", "sensor_1", "sensor_3"]
    assert [r[0] for r in rows(query(factory, q.format("DESC", 3, 0)))] == ["sensor_3", "sensor_1", "sensor_2"]
    assert [r[0] for r in rows(query(factory, q.format("ASC", 1, 1)))] == ["sensor_1"]
    assert query(factory, q.format("ASC", 0, 0)).count() == 0


def test_projection(factory):
    df = query(factory, 'MATCH (s:sensor) RETURN s.id, s.id, s.rank + "/" + s.id, s.nothing, s ORDER BY s.id LIMIT 1')
    assert df.columns == ["s.id", "s.rank+/+s.id", "s.nothing", "s"] and rows(df) == [("sensor_1", "10/sensor_1", None, None)]
    assert set(query(factory, "MATCH (s:sensor) RETURN *").columns) == {"s.id", "s.rank", "s.type"}
    assert rows(query(factory, "MATCH (s:sensor) RETURN count(*), avg(s.rank)")) == [(3, 9.5)]


def test_fetch(factory):
    q = 'MATCH (s:sensor) FETCH latest("temp:" + s.id) AS s.t, history("temp:" + s.id) AS h RETURN s.id, s.t, h ORDER BY s.id'
    assert rows(query(factory, q)) == [("sensor_1", "21", "5:20.5000;9:21.0000"), ("sensor_2", None, "5:0.0000;6:0.0000"), ("sensor_3", None, None)]
    assert rows(query(factory, 'MATCH (s:sensor) RETURN latest("temp:" + s.id) ORDER BY s.id LIMIT 1')) == [("21",)]
    assert rows(query(factory, 'GET history("temp:sensor_1") LAST 1')) == [(9, "21", False)]
    assert rows(query(factory, 'GET history("temp:sensor_1") DOWNSAMPLE AVG(1)')) == [(7, 20.75)]


def test_show_and_describe(factory):
    assert rows(query(factory, "SHOW NODES LIMIT 1")) == [("machine_1", "machine", "type")]
    assert query(factory, 'SHOW EDGES WHERE relation = "monitors" ORDER BY id DESC LIMIT 2').first()["id"] == "e3"
    assert query(factory, "SHOW KEYS").count() == 5 * 3 + 4 + 5 + 2
    d = query(factory, 'DESCRIBE NODE "machine_1"').first()
    assert d["type"] == "machine"
    assert query(factory, "DESCRIBE EDGES").count() == 4
    assert rows(rendered(query(factory, 'DESCRIBE EDGE "e1"').select("id", "valid_to", "weight"))) == [("e1", "<nil>", "0.4")]


def test_meta(factory):
    assert rows(query(factory, 'META "temp:*" WHERE total_writes > 1 RETURN key, avg_value ORDER BY key')) == [("temp:sensor_1", 20.75), ("temp:sensor_2", 0.0)]


def test_bitemporal(spark):
    g = graph(spark, [("a", "t", 10, 20, False, 5), ("a", "t", 10, 15, True, 14)], [("e", "a", "a", "r", 10, None, False, 10)])
    assert G.nodes_at(g, 12).count() == 1 and G.nodes_at(g, 9).count() == 0 and G.nodes_at(g, 14).count() == 0
    assert G.nodes_at(g, 4, check_valid=False).count() == 0


def test_diff(spark):
    g = graph(
        spark, [("A", "d"), ("B", "d")],
        [("new", "A", "B", "r", 0, None, False, 150), ("old", "B", "A", "r", 0, None, False, 50), ("old", "B", "A", "r", 0, 150, True, 150), ("w", "A", "B", "r", 0, None, False, 50)],
        [("edge", "w", "weight", "1", 50), ("edge", "w", "weight", "2", 150)],
    )
    assert rows(G.diff(g, 100, 200).orderBy("edge_id").select("edge_id", "change", "weight_before", "weight_after")) == [("new", "added", None, None), ("old", "removed", None, None), ("w", "changed", 1.0, 2.0)]
    assert G.diff(g, 100, 200, from_type="nothing").count() == 0


def test_writes(spark):
    g = graph(spark, [("a", "t", 10, 100), ("b", "t", 20, None), ("c", "t", 0, 5, True, 3)], [("ab", "a", "b", "r", 30, 90), ("bb", "b", "b", "r", 30, 90)])
    new = spark.createDataFrame([("ok", "a", "b", "r", 20, 100), ("early", "a", "b", "r", 10, 100), ("open", "a", "b", "r", 20, None), ("dead", "a", "c", "r", 20, 30)], "id string, src string, dst string, relation string, valid_from long, valid_to long")
    good, bad = G.create_edges(g, new, 50)
    assert [r.id for r in good.collect()] == ["ok"] and bad.count() == 3
    nodes, edges = G.delete_nodes(g, spark.createDataFrame([("b",)], "id string"), 60)
    assert [r.id for r in nodes.collect()] == ["b"] and sorted(r.id for r in edges.collect()) == ["ab", "bb"]
    assert G.create_nodes(spark.createDataFrame([("t",)], "type string"), 1).first().id
    kept, refused = G.set_props(g, "node", spark.createDataFrame([("a", "p", "7"), ("c", "p", "7")], "owner_id string, prop string, value string"), 5)
    assert kept.first().num == 7.0 and refused.first().owner_id == "c"


def joins(df, kind):
    return df._jdf.queryExecution().analyzed().toString().count(f"Join {kind}")


def test_only_relations_and_sides_that_fail_are_looked_at(spark):
    nodes = [("a", "t", 10, 100), ("b", "t", 0, None), ("c", "t", 0, None), ("gone", "t", 0, 5, True, 3)]
    fine = [(f"f{i}", "b", "c", "fine", i, None) for i in range(5)]
    late = [("early", "a", "b", "late", 9, 50), ("open", "a", "b", "late", 20, None), ("long", "a", "b", "late", 20, 101), ("ok", "a", "b", "late", 10, 100), ("dead", "a", "b", "late", 1, 50), ("dead", "a", "b", "late", 1, 50, True, 70)]
    late += [("mended", "a", "b", "late", 1, 50), ("mended", "a", "b", "late", 11, 50, False, 70), ("spoilt", "a", "b", "late", 11, 50), ("spoilt", "a", "b", "late", 1, 50, False, 70), ("never", "a", "b", "late", None, 50)]
    got = G.edge_validity_violations(graph(spark, nodes, fine + late))
    assert {r.id: r.reason for r in got.collect()} == dict.fromkeys(("early", "open", "long", "spoilt", "never"), "edge outside node validity")
    assert joins(got, "LeftOuter") == 1
    lost = [("x", "b", "nowhere", "lost", 1, None), ("y", "b", "gone", None, 1, None), ("z", None, "b", None, 1, None)]
    got = G.edge_validity_violations(graph(spark, nodes, fine + late + lost))
    assert {r.id for r in got.filter("reason = 'node not found'").collect()} == {"x", "y", "z"} and got.count() == 8
    assert G.edge_validity_violations(graph(spark, nodes, fine)).count() == 0
    several = G.MANY
    try:
        G.MANY = 1
        assert G.edge_validity_violations(graph(spark, nodes, fine + late + lost)).count() == 8
    finally:
        G.MANY = several


def test_deletion_looks_at_relations_of_the_nodes_only(spark):
    nodes = [(n, "t") for n in "abcd"]
    edges = [("ab", "a", "b", "to", 0, None), ("bc", "b", "c", "to", 0, None), ("bb", "b", "b", "to", 0, None), ("was", "b", "c", "to", 0, None), ("was", "b", "c", "to", 0, 9, True, 9), ("cd", "c", "d", "in", 0, None), ("db", "d", "b", "in", 0, None), ("none", "c", "b", None, 0, None), ("cc", "c", "c", "far", 0, None)]
    g = graph(spark, nodes, edges)
    found = lambda *ids: G.delete_nodes(g, spark.createDataFrame([(i,) for i in ids], "id string"), 60)[1]
    assert sorted(r.id for r in found("b").collect()) == ["ab", "bb", "bc", "db", "none"]
    assert all(r.deleted and r.valid_to == r.ts_us == 60 for r in found("b").collect())
    one = found("a")
    assert [r.id for r in one.collect()] == ["ab"] and joins(one, "LeftSemi") == 1
    assert found("nowhere").count() == 0 and found("nowhere").columns == one.columns
    several = G.MANY
    try:
        G.MANY = 1
        assert sorted(r.id for r in found("b").collect()) == ["ab", "bb", "bc", "db", "none"]
    finally:
        G.MANY = several


def test_edges_are_dealt_straight_to_files(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        touched = G.delete_nodes(graph(spark, [("a", "t")], [("aa", "a", "a", "r")]), spark.createDataFrame([("a",)], "id string"), 60)[1]
        assert "RepartitionByExpression [id" in (plan := touched._jdf.queryExecution().analyzed().toString()) and f", {G.STRAIGHT}" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_resolve(spark):
    g = graph(spark, [("n2", "t"), ("n1", "t"), ("gone", "t", 0, None, True)], [], [("node", "n2", "name", "pump", 0), ("node", "n1", "name", "pump", 0), ("node", "gone", "name", "x", 0)])
    assert [G.resolve(g, k).collect() for k in ("x", "nothing")] == [[], []]
    assert G.resolve(g, "pump").first().id == "n1" and G.resolve(g, "gone").first().id == "gone"


def test_traverse_valid_time(spark):
    g = graph(spark, [(x, "t") for x in "abcd"], [("e1", "a", "b", "calls", 1000, 3000), ("e2", "a", "c", "calls", 2000, 5000), ("e3", "b", "d", "calls", 1000, 4000)], [("node", "b", "p", "v", 0)])
    got = TR.bfs(g, "a", 2500, max_depth=2, properties=True).orderBy("depth", "rank").collect()
    assert [(r.node_id, r.depth, r.via_edge) for r in got] == [("b", 1, "e1"), ("c", 1, "e2"), ("d", 2, "e3")] and got[0].properties == {"p": "v"}
    assert TR.bfs(g, "a", 1500).count() == 2
    assert tuple(TR.shortest_path(g, "a", "d", 2500).first()) == (["a", "b", "d"], 2)
    assert TR.shortest_path(g, "d", "a", 2500).count() == 0 and TR.shortest_path(g, "a", "a", 1).first().length == 0
    assert TR.bfs(g, "d", 2500, "in", ["calls"]).count() == 2


def chain(spark, times, weights=None, relation="r"):
    names = [n for n, _ in times]
    edges = [(f"e{i}", a, b, relation) for i, (a, b) in enumerate(zip(names, names[1:], strict=False))]
    props = [("node", n, "state", "1", t) for n, t in times] + [("edge", f"e{i}", "weight", str(w), 0) for i, w in enumerate(weights or [])]
    return graph(spark, [(n, "t") for n in names], edges, props)


def test_causal_scenarios(spark):
    t0 = 1000 * MIN
    r = TR.causal(chain(spark, [("pump_3", t0), ("press_7", t0 + 22 * MIN)]), "pump_3", t0, 5, 30 * MIN).collect()
    assert [(x.node_id, x.depth, x.delta) for x in r] == [("press_7", 1, 22 * MIN)]
    assert TR.causal(chain(spark, [("a", t0), ("b", t0 + 60 * MIN)]), "a", t0, 5, 30 * MIN).count() == 0
    g = chain(spark, [("redis", t0), ("checkout", t0 + 3 * MIN), ("payment", t0 + 5 * MIN), ("queue", t0 + 8 * MIN)], [1, 0.9, 0.9])
    c = [x.confidence for x in TR.causal(g, "redis", t0, 5, 15 * MIN).orderBy("depth").collect()]
    assert abs(c[0] - 0.95) < 0.05 and abs(c[1] - 0.82) < 0.08 and abs(c[2] - 0.71) < 0.08
    g = chain(spark, [("node_42", t0 - 15 * MIN), ("redis_main", t0 - 12 * MIN), ("checkout", t0)])
    r = TR.causal(g, "checkout", t0, 5, 15 * MIN, "backward").orderBy("depth").collect()
    assert [x.delta for x in r] == [-12 * MIN, -15 * MIN] and r[1].path == ["checkout", "redis_main", "node_42"]
    with pytest.raises(ValueError):
        TR.causal(g, "checkout", t0, 0, MIN)


def test_time_factor(spark):
    from pyspark.sql import functions as F

    f = lambda d, w: spark.range(1).select(TR.time_factor(F.lit(d * MIN), w * MIN).alias("x")).first().x
    assert abs(f(22, 60) - 0.912) < 0.001 and abs(f(3, 15) - 0.951) < 0.001 and f(-1, 15) == 1.0


def fifo(start, at, depth, w, edges, moves, weights, least):
    """The search as a queue: the first that comes marks a node."""
    change = max([t for t in moves.get(start, []) if at - w <= t <= at], default=at)
    seen, todo, out = {start}, deque([(start, change, 0, 1.0, [start])]), []
    import math

    while todo:
        n, t, d, c, path = todo.popleft()
        if d >= depth:
            continue
        for eid, a, b in edges:
            if a != n or b in seen:
                continue
            ahead = [x for x in moves.get(b, []) if t <= x <= t + w]
            behind = [x for x in moves.get(b, []) if t - w <= x <= t]
            if not ahead and not behind:
                continue
            now = min(ahead) if ahead else max(behind)
            conf = c * (1.0 if now - t <= 0 else math.exp(-0.25 * (now - t) / w)) * weights.get(eid, 1.0)
            if conf < least:
                continue
            seen.add(b)
            out.append((b, d + 1, now - at, round(conf, 9), tuple(path + [b]), eid))
            todo.append((b, now, d + 1, conf, path + [b]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_causal_against_a_queue(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(f"e{k}", r.choice(nodes), r.choice(nodes)) for k in range(22)]
    moves = {n: sorted(r.sample(range(1, 60), r.randrange(0, 3))) for n in nodes}
    weights = {e: round(r.uniform(0.4, 1), 2) for e, _, _ in edges if r.random() < 0.7}
    g = graph(spark, [(n, "t") for n in nodes], [(e, a, b, "r") for e, a, b in edges], [("node", n, "p", "1", t) for n, ts in moves.items() for t in ts] + [("edge", e, "weight", str(w), 0) for e, w in weights.items()])
    got = TR.causal(g, "n0", 30, 4, 20, min_confidence=0.3).orderBy("depth", "rank").collect()
    assert [(x.node_id, x.depth, x.delta, round(x.confidence, 9), tuple(x.path), x.via_edge) for x in got] == fifo("n0", 30, 4, 20, edges, moves, weights, 0.3)


def test_diamond_reaches_by_the_second_parent(spark):
    """b comes first but its child's change is out of its window; c still reaches the child."""
    g = graph(spark, [(x, "t") for x in "abcd"], [("e1", "a", "b", "r"), ("e2", "a", "c", "r"), ("e3", "b", "d", "r"), ("e4", "c", "d", "r")], [("node", n, "p", "1", t) for n, t in (("a", 100), ("b", 101), ("c", 109), ("d", 118))])
    assert [r.via_edge for r in TR.causal(g, "a", 100, 3, 10).orderBy("depth", "rank").collect()] == ["e1", "e2", "e4"]


def test_reading_key_counts_as_change(spark):
    g = graph(spark, [("a", "t"), ("b", "t")], [("e", "a", "b", "r")], [("node", "a", "p", "1", 100), ("node", "b", "readingKey", "k", 1)], [("k", 105, "9")])
    assert query(g, 'CAUSAL FROM a DEPTH 2 WINDOW "10us" RETURN node_id', at=100).first()[0] == "b"
    assert TR.causal(g, "a", 100, 2, 10).first().delta == 5


def test_parser():
    s = parse('match (a:x)-[r:y]->(b)<-[]-(c) where NOT a.b = "c" // note\n and a.x >= 1.5 return a.b, count(*) limit 3;')
    assert s.head == "match" and [type(e).__name__ for e in s.subject] == ["NodePattern", "EdgePattern"] * 2 + ["NodePattern"]
    assert s.clauses["where"] == Binary("AND", Binary("=", Not(Name(("a", "b"))), Literal("c", "c")), Binary(">=", Name(("a", "x")), Literal(1.5, "1.5")))
    assert s.clauses["limit"] == 3 and [e.direction for e in s.subject[1::2]] == ["out", "in"]
    assert parse("CAUSAL FROM x WINDOW 1h30m DEPTH 2").clauses == {"window": "1h30m", "depth": 2}
    assert parse('DIFF (a)-[]-(b) BETWEEN "x" AND "y" RETURN from, to').clauses["between"] == ("x", "y")
    assert parse("MATCH (a) LIMIT 1 LIMIT 2").clauses["limit"] == 2


@pytest.mark.parametrize("text", ["", "FOO", "MATCH (a", "MATCH (a) WHERE", 'GET history("a") ORDER BY x', "MATCH (a) LIMIT x", 'MATCH (a) AT 5', "MATCH (a) ~", '"open', "SHOW THINGS", "MATCH (a)-[r->(b)"])
def test_parse_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_bad_time(factory):
    with pytest.raises(QueryError):
        query(factory, 'MATCH (a) AT "soon"')
