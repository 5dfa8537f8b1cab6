"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import micros
from ..operators import graph as G
from ..operators import series as S
from ..operators import stats, store, traverse
from ..ql.compiler import query
from ..sources.tables import Graph, commerce_graph, event_log, read, us, user_graph
from . import twins

T = micros("2024-01-15")
HOUR = 3_600_000_000
D1, D2 = micros("1998-01-01"), micros("1998-02-01")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def sig(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounds floating columns, which engines add up in different orders."""
    return df.withColumns({c: F.round(F.col(c), digits) for c, t in df.dtypes if t == "double" and (not columns or c in columns)})


# Key-value reads

_LAST = "SELECT * FROM log {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us DESC) = 1"


@registered(f"WITH {twins.LOG} SELECT key, ts_us, value FROM ({_LAST.format(where='')}) WHERE NOT tombstone")
def kv_current(spark, sf):
    return store.get(event_log(spark, sf)).select("key", "ts_us", "value")


@registered(f"WITH {twins.LOG} SELECT key, ts_us, value FROM ({_LAST.format(where=f'WHERE ts_us <= {T}')}) WHERE NOT tombstone")
def kv_get_at(spark, sf):
    return store.get(event_log(spark, sf), T).select("key", "ts_us", "value")


@registered(f"WITH {twins.LOG} SELECT ts_us, value, tombstone FROM log WHERE key = 'node:user_3:prop:click' AND ts_us BETWEEN {T} AND {T + 240 * HOUR}")
def kv_history_range(spark, sf):
    return store.history(event_log(spark, sf), "node:user_3:prop:click", T, T + 240 * HOUR).select("ts_us", "value", "tombstone")


@registered(f"WITH {twins.LOG} SELECT ts_us, value, tombstone FROM log WHERE key = 'node:user_3:prop:click' ORDER BY ts_us DESC LIMIT 10")
def kv_history_last_n(spark, sf):
    return store.history(event_log(spark, sf), "node:user_3:prop:click", limit=10, reverse=True).select("ts_us", "value", "tombstone")


@registered(f"WITH {twins.LOG} SELECT DISTINCT key FROM log WHERE starts_with(key, 'node:user_1')")
def kv_scan_prefix(spark, sf):
    return store.scan_prefix(event_log(spark, sf), "node:user_1")


@registered(f"WITH {twins.LOG}, l AS ({_LAST.format(where='')}) SELECT (SELECT count(*) FROM l) AS keys, (SELECT count(*) FROM log) AS versions, (SELECT count(*) FROM l WHERE tombstone) AS tombstoned_keys")
def kv_store_stats(spark, sf):
    return store.store_stats(event_log(spark, sf))


@registered(
    f"""WITH {twins.LOG}, m AS (SELECT *, max(ts_us) FILTER (tombstone) OVER (PARTITION BY key) AS grave, max(ts_us) OVER (PARTITION BY key) AS last FROM log)
SELECT key, ts_us, value FROM m WHERE grave IS NULL OR (grave < last AND ts_us > grave)"""
)
def kv_compaction(spark, sf):
    return store.compact(event_log(spark, sf)).select("key", "ts_us", "value")


@registered(
    f"""WITH {twins.LOG}, p AS (SELECT event_id, 'node:user_' || user_id || ':prop:' || event_type AS key, epoch_us(ts) - {HOUR} AS probe FROM events),
j AS (SELECT p.event_id, p.key, p.probe, l.value, l.tombstone FROM p ASOF LEFT JOIN log l ON p.key = l.key AND p.probe >= l.ts_us)
SELECT event_id, key, probe, CASE WHEN NOT tombstone THEN value END AS value FROM j"""
)
def kv_asof_join(spark, sf):
    """The value of each event's key one hour before the event."""
    key = F.concat(F.lit("node:user_"), F.col("user_id").cast("string"), F.lit(":prop:"), "event_type")
    probes = read(spark, sf, "events").select("event_id", key.alias("key"), (us("ts") - HOUR).alias("at"))
    return store.asof(probes, event_log(spark, sf)).select("event_id", "key", F.col("at").alias("probe"), "value")


@registered(f"SELECT 'nation_' || n_nationkey AS key, n_name AS value, {T} AS ts_us, row_number() OVER (ORDER BY 'nation_' || n_nationkey) - 1 AS hlc_seq FROM nation")
def kv_batchset_order(spark, sf):
    rows = read(spark, sf, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return store.batch_set(rows, T).select("key", "value", "ts_us", F.col("hlc_seq").cast("bigint").alias("hlc_seq"))


@registered("SELECT sha256(text) AS hash, max(strlen(text)) AS size, count(*) AS refs FROM documents WHERE strlen(text) > 4096 GROUP BY 1")
def blob_dedup(spark, sf):
    return store.blob_references(read(spark, sf, "documents"), larger_than=4096)[1]


# Statistics of keys

_META = """SELECT key, count(*) AS total_writes, list(ts_us ORDER BY ts_us) AS times, coalesce(min(num), 'Infinity'::DOUBLE) AS min_value, coalesce(max(num), '-Infinity'::DOUBLE) AS max_value,
  coalesce(avg(num), 0) AS avg_value, coalesce(stddev_pop(num), 0) AS stddev_value, count(DISTINCT value) AS cardinality, sum(coalesce(strlen(value), 0)) AS size_bytes, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM log"""
_RATE = """CASE WHEN len(times) < 2 THEN 0 ELSE list_reduce([1e6 / greatest(times[i + 1] - times[i], 1) FOR i IN range(1, len(times))], lambda a, x: a + (x - a) * 0.05) END"""


def _meta_sql(where: str) -> str:
    return f"""WITH {twins.LOG}, m AS ({_META} {where} GROUP BY key)
SELECT key, total_writes, min_value, max_value, round(avg_value, 6) AS avg_value, round(stddev_value, 6) AS stddev_value, cardinality, CAST(size_bytes AS BIGINT) AS size_bytes, first_seen, last_seen, round({_RATE}, 9) AS write_rate FROM m"""


@registered(_meta_sql(""))
def meta_all(spark, sf):
    out = stats.key_meta(event_log(spark, sf), exact=True)
    return sig(sig(out, "avg_value", "stddev_value"), "write_rate", digits=9)


@registered(_meta_sql("WHERE key SIMILAR TO 'node:user_[0-4]:prop:[^/]*'"))
def meta_filtered(spark, sf):
    out = stats.key_meta(event_log(spark, sf), "node:user_[0-4]:prop:*", exact=True)
    return sig(sig(out, "avg_value", "stddev_value"), "write_rate", digits=9)


@registered(f"WITH {twins.LOG} SELECT key, count(*) AS total_writes FROM log WHERE key SIMILAR TO 'node:user_.:prop:[^/]*' GROUP BY key HAVING count(*) > 12")
def meta_where(spark, sf):
    g = Graph(None, None, None, event_log(spark, sf))
    return query(g, 'META "node:user_?:prop:*" WHERE total_writes > 12 RETURN key, total_writes')


# Downsampling


def user_series(spark, sf) -> DataFrame:
    return read(spark, sf, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), us("ts").alias("ts_us"), "value")


_SERIES = """s AS (SELECT 'user_' || user_id AS key, epoch_us(ts) AS ts_us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
b AS (SELECT s.*, (SELECT max(k) FROM range({buckets}) r(k) WHERE CAST(floor(k * (n / CAST({buckets} AS DOUBLE))) AS BIGINT) <= i) AS b FROM s)"""


@registered(f"WITH {_SERIES.format(buckets=10)} SELECT key, CAST(sum(ts_us) AS BIGINT) // count(*) AS ts_us, round(avg(value), 6) AS value FROM b GROUP BY key, CASE WHEN n <= 10 THEN i ELSE b END")
def ds_avg(spark, sf):
    return sig(S.average(user_series(spark, sf), 10))


@registered(
    f"""WITH {_SERIES.format(buckets=8)}, e AS (SELECT key, arg_min(ts_us, (value, i)) AS lt, min(value) AS lv, arg_max(ts_us, (value, -i)) AS ht, max(value) AS hv FROM b WHERE n > 16 GROUP BY key, b)
SELECT key, lt AS ts_us, lv AS value FROM e UNION ALL SELECT key, ht, hv FROM e UNION ALL SELECT key, ts_us, value FROM b WHERE n <= 16"""
)
def ds_minmax(spark, sf):
    return S.min_max(user_series(spark, sf), 8)


def _lttb_sql(series: str, n: int, half_open: bool = False) -> str:
    """The sampler unrolled: one CTE for each pick."""
    e = lambda k: f"(CAST(floor(({k}) * ((n - 2) / CAST({n - 2} AS DOUBLE))) AS BIGINT) + 1)"
    out = [series, "p0 AS (SELECT key, n, ts_us AS pts, value AS pv FROM s WHERE i = 0)"]
    for k in range(1, n - 1):
        own = f"s.i >= {e(k - 1)} AND s.i <= least({e(k)}, s.n - 1)" if not half_open else f"s.i >= {e(k - 1)} AND s.i < least({e(k)}, s.n - 1)"
        nxt = f"s.i >= {e(k)} AND s.i <= least({e(k + 1)}, s.n - 1)" if not half_open else f"s.i >= least({e(k)}, s.n - 1) AND s.i < least({e(k + 1)}, s.n)"
        out.append(f"m{k} AS (SELECT key, avg(CAST(ts_us AS DOUBLE)) AS mx, avg(value) AS my FROM s WHERE {nxt.replace('(n -', '(s.n -')} GROUP BY key)")
        area = f"abs((p.pts - m.mx) * (s.value - p.pv) - (p.pts - s.ts_us) * (m.my - p.pv)) * 0.5"
        out.append(f"p{k} AS (SELECT s.key, any_value(s.n) AS n, arg_max(s.ts_us, ({area}, -s.i)) AS pts, arg_max(s.value, ({area}, -s.i)) AS pv FROM s JOIN p{k - 1} p USING (key) JOIN m{k} m USING (key) WHERE {own.replace('(n -', '(s.n -')} GROUP BY s.key)")
    picks = " UNION ALL ".join(f"SELECT key, pts AS ts_us, pv AS value FROM p{k} WHERE n > {n}" for k in range(n - 1))
    return f"WITH {', '.join(out)} {picks} UNION ALL SELECT key, ts_us, value FROM s WHERE i = n - 1 AND n > {n} UNION ALL SELECT key, ts_us, value FROM s WHERE n <= {n}"


_PLACED = "s AS (SELECT 'user_' || user_id AS key, epoch_us(ts) AS ts_us, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


@registered(_lttb_sql(_PLACED, 12))
def ds_lttb(spark, sf):
    return S.lttb(user_series(spark, sf), 12)


@registered(
    f"""WITH s AS (SELECT 'user_' || user_id AS key, epoch_us(ts) AS ts_us, value, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS f FROM events)
SELECT key, f + ((ts_us - f) // {48 * HOUR}) * {48 * HOUR} + {24 * HOUR} AS ts_us, round(avg(value), 6) AS value FROM s GROUP BY 1, 2"""
)
def ds_retention_avg(spark, sf):
    return sig(S.time_average(user_series(spark, sf), 48 * HOUR))


@registered(
    f"""WITH s AS (SELECT 'user_' || user_id AS key, epoch_us(ts) AS ts_us, value, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS f FROM events),
b AS (SELECT key, f + ((ts_us - f) // {48 * HOUR}) * {48 * HOUR} + {24 * HOUR} AS mid, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1, 2)
SELECT key, mid AS ts_us, lo AS value FROM b UNION ALL SELECT key, mid + 1, hi FROM b"""
)
def ds_retention_minmax(spark, sf):
    return S.time_min_max(user_series(spark, sf), 48 * HOUR)


def _retention_lttb_sql(interval: int, most: int) -> str:
    """The sampler once for each number of points that a span of up to ``most`` intervals gives."""
    span = "(max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id))"
    series = f"{_PLACED[:-len(' FROM events)')]}, greatest(3, {span} // {interval} + 1) AS target FROM events QUALIFY target = {{n}})"
    return " UNION ALL ".join(f"SELECT * FROM ({_lttb_sql(series.format(n=n), n, half_open=True)})" for n in range(3, most + 2))


@registered(_retention_lttb_sql(48 * HOUR, 15))
def ds_retention_lttb(spark, sf):
    return S.time_lttb(user_series(spark, sf), 48 * HOUR)


# Catalogue

_NOW = twins.snapshot(None)


@registered(
    f"WITH {twins.USERS}, {_NOW} SELECT n.id, n.type, coalesce(string_agg(DISTINCT p.prop, ', ' ORDER BY p.prop), '') AS properties FROM nodes_at n LEFT JOIN props p ON p.owner_kind = 'node' AND p.owner_id = n.id GROUP BY n.id, n.type"
)
def show_nodes(spark, sf):
    return query(user_graph(spark, sf), "SHOW NODES")


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT id, src AS \"from\", dst AS \"to\", relation FROM edges_at WHERE relation = 'part_of'")
def show_edges(spark, sf):
    return query(commerce_graph(spark, sf), 'SHOW EDGES WHERE relation = "part_of"')


@registered(
    f"""WITH {twins.USERS}, k AS (SELECT key FROM log UNION SELECT 'node:' || id || ':meta' FROM nodes UNION SELECT 'graph:adj:' || id || ':out' FROM nodes
UNION SELECT 'graph:adj:' || id || ':in' FROM nodes UNION SELECT 'edge:' || id || ':meta' FROM edges UNION SELECT owner_kind || ':' || owner_id || ':prop:' || prop FROM props)
SELECT key FROM k"""
)
def show_keys(spark, sf):
    return query(user_graph(spark, sf), "SHOW KEYS")


@registered(
    f"""WITH {twins.USERS}, {twins.snapshot(T, False)}, p AS (PIVOT (SELECT owner_id, prop, value FROM props_at WHERE owner_kind = 'node') ON prop IN ('click', 'error', 'login', 'purchase', 'signup', 'view') USING any_value(value) GROUP BY owner_id)
SELECT n.id, n.type, n.valid_from, n.valid_to, p.click, p.purchase FROM nodes_at n LEFT JOIN p ON p.owner_id = n.id"""
)
def describe_nodes_at(spark, sf):
    return G.describe(user_graph(spark, sf), "node", T, names=["click", "purchase"])


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(D1, False)}
SELECT e.id, e.src AS "from", e.dst AS "to", e.relation, e.valid_from, e.valid_to, w.num AS weight, q.num AS quantity FROM edges_at e
LEFT JOIN props_at w ON w.owner_kind = 'edge' AND w.owner_id = e.id AND w.prop = 'weight' LEFT JOIN props_at q ON q.owner_kind = 'edge' AND q.owner_id = e.id AND q.prop = 'quantity'
WHERE e.relation = 'contains'"""
)
def describe_edges_at(spark, sf):
    rows = query(commerce_graph(spark, sf), 'DESCRIBE EDGES AT "1998-01-01" WHERE relation = "contains"')
    return rows.withColumns({c: F.col(c).try_cast("double") for c in ("weight", "quantity")})


# Patterns

_HOP = "SELECT src AS node, dst AS nbr, id, relation FROM edges_at"
_BACK = "SELECT dst AS node, src AS nbr, id, relation FROM edges_at"


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns])


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT e.src AS c_id, e.dst AS n_id FROM edges_at e JOIN nodes_at c ON c.id = e.src JOIN nodes_raw n ON n.id = e.dst WHERE c.type = 'customer' AND n.type = 'nation' AND e.relation = 'located_in'")
def match_1hop_out(spark, sf):
    return _flat(query(commerce_graph(spark, sf), "MATCH (c:customer)-[r:located_in]->(n:nation) RETURN c.id, n.id"))


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT n.id AS n_id, e.id AS r_id, e.src AS s_id FROM nodes_at n JOIN edges_at e ON e.dst = n.id JOIN nodes_raw s ON s.id = e.src WHERE n.type = 'nation' AND s.type = 'supplier' AND e.relation = 'located_in'")
def match_1hop_in(spark, sf):
    return _flat(query(commerce_graph(spark, sf), "MATCH (n:nation)<-[r:located_in]-(s:supplier) RETURN n.id, r.id, s.id"))


@registered(f"WITH {twins.USERS}, {twins.snapshot(T)}, h AS ({_HOP} UNION ALL {_BACK}) SELECT a.id AS a_id, h.id AS r_id, h.relation AS r_relation, b.id AS b_id FROM nodes_at a JOIN h ON h.node = a.id JOIN nodes_raw b ON b.id = h.nbr")
def match_1hop_both(spark, sf):
    return _flat(query(user_graph(spark, sf), 'MATCH (a:user)-[r]-(b:user) AT "2024-01-15" RETURN a.id, r.id, r.relation, b.id'))


@registered(
    f"""WITH {twins.COMMERCE}, {_NOW} SELECT r.id AS r_id, count(*) AS customers FROM edges_at e JOIN nodes_at c ON c.id = e.src AND c.type = 'customer' JOIN nodes_raw n ON n.id = e.dst
JOIN edges_at f ON f.src = n.id AND f.relation = 'part_of' JOIN nodes_raw r ON r.id = f.dst WHERE e.relation = 'located_in' GROUP BY 1"""
)
def match_2hop(spark, sf):
    rows = _flat(query(commerce_graph(spark, sf), "MATCH (c:customer)-[:located_in]->(n:nation)-[:part_of]->(r:region) RETURN c.id, r.id"))
    return rows.groupBy("r_id").agg(F.count(F.lit(1)).alias("customers"))


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(D1)}, hops AS (
SELECT c.id AS c, p.dst AS o FROM nodes_at c JOIN edges_at p ON p.src = c.id AND p.relation = 'placed' WHERE c.type = 'customer'),
x AS (SELECT hops.c, t.dst AS part FROM hops JOIN edges_at t ON t.src = hops.o AND t.relation = 'contains'),
y AS (SELECT x.c, s.dst AS s FROM x JOIN edges_at s ON s.src = x.part AND s.relation = 'supplied_by')
SELECT y.c AS c_id, y.s AS s_id, l.dst AS n_id FROM y JOIN edges_at l ON l.src = y.s AND l.relation = 'located_in'"""
)
def match_4hop_mixed(spark, sf):
    q = 'MATCH (c:customer)-[:placed]->(o:order)-[:contains]->(p:part)-[:supplied_by]->(s:supplier)-[:located_in]->(n:nation) AT "1998-01-01" RETURN c.id, s.id, n.id'
    return _flat(query(commerce_graph(spark, sf), q))


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(D2)} SELECT o.id AS o_id, e.id AS r_id, round(w.num, 6) AS r_weight, e.dst AS p_id FROM nodes_at o JOIN edges_at e ON e.src = o.id AND e.relation = 'contains'
LEFT JOIN props_at w ON w.owner_kind = 'edge' AND w.owner_id = e.id AND w.prop = 'weight' WHERE o.type = 'order'"""
)
def match_at(spark, sf):
    rows = _flat(query(commerce_graph(spark, sf), 'MATCH (o:order)-[r:contains]->(p:part) AT "1998-02-01" RETURN o.id, r.id, r.weight, p.id'))
    return rows.withColumn("r_weight", F.round(F.col("r_weight").try_cast("double"), 6))


@registered(
    f"""WITH {twins.COMMERCE}, {_NOW} SELECT e.src AS c_id, e.dst AS n_id FROM edges_at e JOIN nodes_at c ON c.id = e.src AND c.type = 'customer'
LEFT JOIN props_at p ON p.owner_kind = 'node' AND p.owner_id = c.id AND p.prop = 'c_acctbal' LEFT JOIN props_at x ON x.owner_kind = 'edge' AND x.owner_id = e.id AND x.prop = 'weight'
WHERE e.relation = 'located_in' AND (CASE WHEN x.num IS NULL THEN '<nil>' > '0.5' ELSE x.num > 0.5 END) AND (CASE WHEN p.num IS NULL THEN '<nil>' > '5000' ELSE p.num > 5000 END)"""
)
def match_where_nil(spark, sf):
    """A missing weight compares as text, so the first condition holds everywhere."""
    return _flat(query(commerce_graph(spark, sf), "MATCH (c:customer)-[r:located_in]->(n:nation) WHERE r.weight > 0.5 AND c.c_acctbal > 5000 RETURN c.id, n.id"))


@registered(
    f"""WITH {twins.COMMERCE}, {_NOW} SELECT c.id AS c_id, CAST(p.num AS DOUBLE) AS c_c_acctbal FROM nodes_at c JOIN props_at p ON p.owner_kind = 'node' AND p.owner_id = c.id AND p.prop = 'c_acctbal'
WHERE c.type = 'customer' ORDER BY p.num DESC, c.id LIMIT 10 OFFSET 5"""
)
def match_order_limit_offset(spark, sf):
    rows = _flat(query(commerce_graph(spark, sf), "MATCH (c:customer) RETURN c.id, c.c_acctbal ORDER BY c.c_acctbal DESC LIMIT 10 OFFSET 5"))
    return rows.withColumn("c_c_acctbal", F.col("c_c_acctbal").try_cast("double"))


@registered(f"WITH {twins.USERS}, {twins.snapshot(T)}, h AS ({_HOP} UNION ALL {_BACK}) SELECT a.id AS a_id, b.id AS b_id, count(*) AS ways FROM nodes_at a JOIN edges_at e ON e.src = a.id JOIN nodes_raw b ON b.id = e.dst JOIN h ON h.node = b.id AND h.nbr = a.id GROUP BY 1, 2")
def match_cycle(spark, sf):
    rows = _flat(query(user_graph(spark, sf), 'MATCH (a:user)-[x]->(b:user)-[y]-(a) AT "2024-01-15" RETURN a.id, b.id'))
    return rows.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("ways"))


@registered(
    f"""WITH {twins.USERS}, {twins.snapshot(T)}, l AS ({_LAST.format(where='')}) SELECT a.id AS a_id, v.value AS a_seen FROM nodes_at a LEFT JOIN (SELECT * FROM l WHERE NOT tombstone) v ON v.key = 'node:' || a.id || ':prop:click'"""
)
def match_fetch_latest(spark, sf):
    return _flat(query(user_graph(spark, sf), 'MATCH (a:user) AT "2024-01-15" FETCH latest("node:" + a.id + ":prop:click") AS a.seen RETURN a.id, a.seen'))


@registered(
    f"""WITH {twins.USERS}, {twins.snapshot(T)}, r AS (SELECT key, ts_us, coalesce(num, 0) AS num, row_number() OVER (PARTITION BY key ORDER BY ts_us DESC) AS k FROM log),
f AS (SELECT key, string_agg(printf('%d:%.4f', ts_us, num), ';' ORDER BY ts_us DESC) AS h FROM r WHERE k <= 3 GROUP BY key)
SELECT a.id AS a_id, f.h AS h FROM nodes_at a LEFT JOIN f ON f.key = 'node:' || a.id || ':prop:view'"""
)
def match_fetch_history(spark, sf):
    return _flat(query(user_graph(spark, sf), 'MATCH (a:user) AT "2024-01-15" FETCH history("node:" + a.id + ":prop:view") LAST 3 AS h RETURN a.id, h'))


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT p.value || '/' || n.id AS k, n.id AS n_id FROM nodes_at n JOIN props_at p ON p.owner_kind = 'node' AND p.owner_id = n.id AND p.prop = 'n_name' WHERE n.type = 'nation'")
def match_concat_key(spark, sf):
    rows = query(commerce_graph(spark, sf), 'MATCH (n:nation) RETURN n.n_name + "/" + n.id, n.id')
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("k"), F.col("`n.id`").alias("n_id"))


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT p.value AS c_c_mktsegment, count(*) AS n, round(avg(b.num), 6) AS bal FROM nodes_at c JOIN props_at p ON p.owner_kind = 'node' AND p.owner_id = c.id AND p.prop = 'c_mktsegment' JOIN props_at b ON b.owner_kind = 'node' AND b.owner_id = c.id AND b.prop = 'c_acctbal' WHERE c.type = 'customer' GROUP BY 1")
def match_aggregate(spark, sf):
    rows = query(commerce_graph(spark, sf), "MATCH (c:customer) RETURN c.c_mktsegment, count(*), avg(c.c_acctbal)")
    return rows.select(F.col("`c.c_mktsegment`").alias("c_c_mktsegment"), F.col("`count(*)`").alias("n"), F.round("`avg(c.c_acctbal)`", 6).alias("bal"))


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(None, False)} SELECT o.id AS o_id, e.id AS r_id FROM nodes_at o JOIN edges_at e ON e.src = o.id AND e.relation = 'contains' JOIN nodes_raw p ON p.id = e.dst
WHERE o.type = 'order' AND e.valid_from < {D2} AND e.valid_to > {D1} AND o.valid_from < {D2}"""
)
def match_during(spark, sf):
    return _flat(query(commerce_graph(spark, sf), 'MATCH (o:order)-[r:contains]->(p:part) DURING "1998-01-01" TO "1998-02-01" RETURN o.id, r.id'))


_DIFF = f"""WITH {twins.COMMERCE}, {twins.snapshot(D1, False, '_a')}, {twins.snapshot(D2, False, '_b')},
a AS (SELECT e.*, coalesce(p.num, 0) AS w FROM edges_at_a e LEFT JOIN props_at_a p ON p.owner_kind = 'edge' AND p.owner_id = e.id AND p.prop = 'weight' WHERE relation = 'contains'),
b AS (SELECT e.*, coalesce(p.num, 0) AS w FROM edges_at_b e LEFT JOIN props_at_b p ON p.owner_kind = 'edge' AND p.owner_id = e.id AND p.prop = 'weight' WHERE relation = 'contains'),
j AS (SELECT coalesce(a.id, b.id) AS edge_id, coalesce(b.src, a.src) AS "from", coalesce(b.dst, a.dst) AS "to", coalesce(b.relation, a.relation) AS relation,
  CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.w <> b.w THEN 'changed' END AS change, a.w AS wa, b.w AS wb FROM a FULL JOIN b ON a.id = b.id)
SELECT edge_id, "from", "to", relation, change, CASE WHEN change = 'changed' THEN round(wa, 6) END AS weight_before, CASE WHEN change = 'changed' THEN round(wb, 6) END AS weight_after FROM j
WHERE change IS NOT NULL AND "from" IN (SELECT id FROM nodes WHERE type = 'order' AND ts_us <= {D2})"""


@registered(_DIFF)
def diff_edges(spark, sf):
    return sig(query(commerce_graph(spark, sf), 'DIFF (o:order)-[r:contains]->(p:part) BETWEEN "1998-01-01" AND "1998-02-01"'))


@registered(
    f"""WITH {twins.COMMERCE}, n AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_us DESC) = 1), e AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts_us DESC) = 1)
SELECT 'node' AS what, type, count(*) AS total, count(*) FILTER (NOT deleted) AS active, count(*) FILTER (deleted) AS deleted FROM n GROUP BY type
UNION ALL SELECT 'edge', relation, count(*), count(*) FILTER (NOT deleted), count(*) FILTER (deleted) FROM e GROUP BY relation"""
)
def graph_stats(spark, sf):
    return G.graph_stats(commerce_graph(spark, sf))


@registered(
    f"""WITH {twins.USERS}, {twins.snapshot(T)} SELECT src AS node, 'out' AS direction, string_agg(id, ',' ORDER BY adj_pos) AS edge_ids FROM edges_at GROUP BY 1
UNION ALL SELECT dst, 'in', string_agg(id, ',' ORDER BY adj_pos) FROM edges_at GROUP BY 1"""
)
def adjacency_lists(spark, sf):
    return G.adjacency(user_graph(spark, sf), T).withColumn("edge_ids", F.array_join("edge_ids", ","))


@registered(
    f"""WITH {twins.USERS}, l AS ({_LAST.format(where='')}) SELECT (SELECT count(*) FROM l) AS keys, (SELECT count(*) FROM log) AS versions, (SELECT count(*) FROM l WHERE tombstone) AS tombstoned_keys,
(SELECT count(*) FROM nodes) AS nodes_total, (SELECT count(*) FROM nodes) AS nodes_active, 0 AS nodes_deleted, (SELECT count(*) FROM edges) AS edges_total, (SELECT count(*) FROM edges) AS edges_active, 0 AS edges_deleted,
(SELECT CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) FROM log) AS bytes"""
)
def service_stats(spark, sf):
    return stats.service_stats(user_graph(spark, sf), event_log(spark, sf))


@registered("SELECT epoch_us(o_orderdate) AS ts_us, o_orderkey AS key, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) - 1 AS hlc_seq FROM orders")
def clock_stamps(spark, sf):
    """Orders of one day share a microsecond and get consecutive stamps."""
    rows = read(spark, sf, "orders").select(us("o_orderdate").alias("ts_us"), F.col("o_orderkey").alias("key"))
    return store.stamp(rows).select("ts_us", "key", F.col("hlc_seq").cast("bigint").alias("hlc_seq"))


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(None, False)}, n AS (SELECT type AS tenant, count(*) AS nodes FROM nodes_at GROUP BY 1), e AS (SELECT split_part(src, '_', 1) AS tenant, count(*) AS edges FROM edges_at GROUP BY 1)
SELECT tenant, nodes, coalesce(edges, 0) AS edges FROM n LEFT JOIN e USING (tenant) WHERE nodes > 100 OR coalesce(edges, 0) > 1000"""
)
def quota_check(spark, sf):
    """Node types stand in for tenants."""
    g = commerce_graph(spark, sf)
    nodes = G.nodes_at(g, check_valid=False).groupBy(F.col("type").alias("tenant")).agg(F.count(F.lit(1)).alias("nodes"))
    edges = G.edges_at(g, check_valid=False).groupBy(F.substring_index("src", "_", 1).alias("tenant")).agg(F.count(F.lit(1)).alias("edges"))
    counts = nodes.join(edges, "tenant", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    quotas = nodes.select("tenant", F.lit(100).alias("max_nodes"), F.lit(1000).alias("max_edges"))
    return store.over_quota(counts, quotas).select("tenant", "nodes", "edges")


@registered(f"WITH {twins.COMMERCE}, {_NOW} SELECT p.owner_id AS id FROM props_at p JOIN nodes_at n ON n.id = p.owner_id WHERE p.owner_kind = 'node' AND p.value = 'FURNITURE' ORDER BY 1 LIMIT 1")
def resolve_node(spark, sf):
    return G.resolve(commerce_graph(spark, sf), "FURNITURE")


# Traversal


def _bfs_sql(start: str, depth: int, hops: str, relation: str | None = None) -> list[str]:
    out = [f"adj AS (SELECT * FROM ({hops}) {f'WHERE relation = {relation!r}' if relation else ''})", f"f0 AS (SELECT '{start}' AS node, CAST(0 AS BIGINT) AS rank, '{start}' AS path)", "v0 AS (SELECT node FROM f0)"]
    for k in range(1, depth + 1):
        out.append(f"c{k} AS (SELECT h.nbr, f.rank, h.side, h.pos, h.id AS edge_id, h.relation, f.path || '>' || h.nbr AS path FROM f{k - 1} f JOIN adj h ON h.node = f.node WHERE h.nbr NOT IN (SELECT node FROM v{k - 1}) QUALIFY row_number() OVER (PARTITION BY h.nbr ORDER BY f.rank, h.side, h.pos, h.id) = 1)")
        out.append(f"f{k} AS (SELECT nbr AS node, row_number() OVER (ORDER BY rank, side, pos, edge_id) - 1 AS rank, path, edge_id, relation, {k} AS depth FROM c{k})")
        out.append(f"v{k} AS (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM f{k})")
    return out


_ALL = "SELECT src AS node, dst AS nbr, id, relation, 0 AS side, adj_pos AS pos FROM edges_at"
_INC = "SELECT dst AS node, src AS nbr, id, relation, 1 AS side, adj_pos AS pos FROM edges_at"


def _levels(depth: int, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM f{k}" for k in range(1, depth + 1))


_TRAVERSED = "node AS node_id, depth, edge_id AS via_edge, relation AS via_relation, rank"


@registered(f"WITH {twins.USERS}, {twins.snapshot(T)}, {', '.join(_bfs_sql('user_0', 3, _ALL))} {_levels(3, _TRAVERSED)}")
def traverse_out(spark, sf):
    return traverse.bfs(user_graph(spark, sf), "user_0", T, "out", None, 3).drop("path")


@registered(f"WITH {twins.USERS}, {twins.snapshot(T)}, {', '.join(_bfs_sql('user_0', 4, _ALL + ' UNION ALL ' + _INC, 'influences'))} {_levels(4, _TRAVERSED)}")
def traverse_both_rel(spark, sf):
    return traverse.bfs(user_graph(spark, sf), "user_0", T, "both", ["influences"], 4).drop("path")


@registered(f"WITH {twins.USERS}, {twins.snapshot(T)}, {', '.join(_bfs_sql('user_0', 6, _ALL))}, r AS ({_levels(6, 'node, path, depth')}) SELECT path, depth AS length FROM r WHERE node = 'user_13'")
def shortest_path(spark, sf):
    rows = traverse.shortest_path(user_graph(spark, sf), "user_0", "user_13", T, max_depth=6)
    return rows.select(F.array_join("path", ">").alias("path"), "length")


def _causal_sql(depth: int, window: int, forward: bool, least: float) -> str:
    """The causal search unrolled, one level after another."""
    w = window
    hops = _ALL if forward else "SELECT dst AS node, src AS nbr, id, relation, 1 AS side, adj_pos AS pos FROM edges_at"
    out = [
        f"adj AS (SELECT h.*, coalesce(p.num, 1) AS w FROM ({hops}) h LEFT JOIN props_at p ON p.owner_kind = 'edge' AND p.owner_id = h.id AND p.prop = 'weight')",
        "moves AS (SELECT DISTINCT owner_id AS n, ts_us FROM props WHERE owner_kind = 'node')",
        f"f0 AS (SELECT 'user_0' AS node, CAST(0 AS BIGINT) AS rank, coalesce((SELECT max(ts_us) FROM moves WHERE n = 'user_0' AND ts_us BETWEEN {T - w} AND {T}), {T}) AS t, CAST(1 AS DOUBLE) AS c, 'user_0' AS path)",
        "v0 AS (SELECT node FROM f0)",
    ]
    ahead = f"(SELECT min(ts_us) FROM moves m WHERE m.n = h.nbr AND m.ts_us BETWEEN f.t AND f.t + {w})"
    behind = f"(SELECT max(ts_us) FROM moves m WHERE m.n = h.nbr AND m.ts_us BETWEEN f.t - {w} AND f.t)"
    for k in range(1, depth + 1):
        out.append(f"a{k} AS (SELECT h.nbr, f.rank, h.side, h.pos, h.id AS edge_id, h.relation, h.w, f.t AS pt, f.c AS pc, f.path, {f'coalesce({ahead}, {behind})' if forward else behind} AS t FROM f{k - 1} f JOIN adj h ON h.node = f.node WHERE h.nbr NOT IN (SELECT node FROM v{k - 1}))")
        delta = "(t - pt)" if forward else "(pt - t)"
        out.append(f"b{k} AS (SELECT *, pc * (CASE WHEN {delta} <= 0 THEN 1 ELSE exp(-0.25 * {delta} / {float(w)!r}) END) * w AS c FROM a{k} WHERE t IS NOT NULL)")
        out.append(f"c{k} AS (SELECT * FROM b{k} WHERE c >= {least} QUALIFY row_number() OVER (PARTITION BY nbr ORDER BY rank, side, pos, edge_id) = 1)")
        out.append(f"f{k} AS (SELECT nbr AS node, row_number() OVER (ORDER BY rank, side, pos, edge_id) - 1 AS rank, t, c, path || '>' || nbr AS path, edge_id, relation, {k} AS depth FROM c{k})")
        out.append(f"v{k} AS (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM f{k})")
    return f"WITH {twins.USERS}, {twins.snapshot(T)}, {', '.join(out)} {_levels(depth, f'node AS node_id, depth, t - {T} AS delta, round(c, 6) AS confidence, path, edge_id AS via_edge, relation AS via_rel, rank')}"


def _causal(spark, sf, **options) -> DataFrame:
    rows = traverse.causal(user_graph(spark, sf), "user_0", T, 3, 12 * HOUR, **options)
    return sig(rows.withColumn("path", F.array_join("path", ">")))


@registered(_causal_sql(3, 12 * HOUR, True, 0.0))
def causal_forward(spark, sf):
    return _causal(spark, sf)


@registered(_causal_sql(3, 12 * HOUR, False, 0.0))
def causal_backward(spark, sf):
    return _causal(spark, sf, direction="backward")


@registered(_causal_sql(3, 12 * HOUR, True, 0.6))
def causal_minconf(spark, sf):
    return _causal(spark, sf, min_confidence=0.6)


@registered(_causal_sql(3, 12 * HOUR, True, 0.0).replace("AS node_id, depth, t", "AS node_id, depth, 1.0 * t").replace(", edge_id AS via_edge, relation AS via_rel, rank", "").replace("'>'", "' -> '"))
def causal_ql(spark, sf):
    return sig(query(user_graph(spark, sf), 'CAUSAL FROM user_0 AT "2024-01-15" DEPTH 3 WINDOW 12h RETURN node_id, depth, delta, confidence, path'))


# Writes and retention


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(None, False)} SELECT e.id, e.src, e.dst, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'node not found' ELSE 'edge outside node validity' END AS reason
FROM edges_at e LEFT JOIN nodes_at a ON a.id = e.src LEFT JOIN nodes_at b ON b.id = e.dst
WHERE a.id IS NULL OR b.id IS NULL OR e.valid_from < a.valid_from OR e.valid_from < b.valid_from"""
)
def edge_validity_violations(spark, sf):
    return G.edge_validity_violations(commerce_graph(spark, sf))


@registered(
    f"""WITH {twins.COMMERCE}, {twins.snapshot(None, False)} SELECT 'node' AS what, id, {D2} AS valid_to FROM nodes_at WHERE type = 'supplier'
UNION ALL SELECT DISTINCT 'edge', e.id, {D2} FROM edges_at e WHERE split_part(e.src, '_', 1) = 'supplier' OR split_part(e.dst, '_', 1) = 'supplier'"""
)
def delete_node_cascade(spark, sf):
    g = commerce_graph(spark, sf)
    nodes, edges = G.delete_nodes(g, G.nodes_at(g, kind="supplier", check_valid=False).select("id"), D2)
    return nodes.select(F.lit("node").alias("what"), "id", "valid_to").union(edges.select(F.lit("edge"), "id", "valid_to"))


_LATE = micros("2024-01-30")


@registered(
    f"""WITH {twins.LOG}, l AS ({_LAST.format(where='')}), p AS (SELECT key, ts_us, CASE WHEN starts_with(key, 'node:user_1') THEN {24 * HOUR} ELSE {96 * HOUR} END AS ttl FROM l WHERE NOT tombstone)
SELECT key, ts_us AS last_us, ttl AS ttl_us FROM p WHERE ts_us + ttl <= {_LATE}"""
)
def retention_expired(spark, sf):
    policies = spark.createDataFrame([("node:", 96 * HOUR), ("node:user_1", 24 * HOUR)], "prefix string, ttl_us long")
    return store.expired(event_log(spark, sf), _LATE, policies)


@registered(
    f"""WITH {twins.LOG}, t AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'acme' ELSE 'globex' END AS tenant FROM log),
l AS (SELECT * FROM t WHERE tenant = 'acme' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_us DESC) = 1) SELECT 'acme:' || key AS key, ts_us, value FROM l WHERE NOT tombstone"""
)
def tenant_isolation(spark, sf):
    user = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("bigint")
    log = event_log(spark, sf).withColumn("tenant", F.when(user % 3 == 0, "acme").otherwise("globex"))
    return store.get(store.prefixed(store.for_tenant(log, "acme"))).select("key", "ts_us", "value")


@registered(f"WITH {twins.LOG} SELECT key, value, ts_us, tombstone AS deleted FROM log WHERE key IN ('node:user_1:prop:click', 'node:user_2:prop:view')")
def watch_stream(spark, sf):
    from ..streaming.watch import replay_watch

    return replay_watch(spark, sf, ["node:user_1:prop:click", "node:user_2:prop:view"])


@registered(f"WITH {twins.LOG} SELECT key, count(*) AS total_writes, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS size_bytes, min(num) AS min_value, max(num) AS max_value, round(avg(num), 6) AS avg_value FROM log GROUP BY key")
def keymeta_stream(spark, sf):
    from ..streaming.watch import replay_key_meta

    rows = replay_key_meta(spark, sf)
    rows = rows.withColumns({c: F.when(F.col("n_values") > 0, F.col(c)) for c in ("min_value", "max_value", "avg_value")})
    return sig(rows.select("key", "total_writes", "size_bytes", "min_value", "max_value", "avg_value"), "avg_value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = 'MATCH (c:customer)-[r:located_in]->(n:nation) WHERE n.n_name = "NATION_7" RETURN c.id, n.id ORDER BY c.id LIMIT 10'
    return _flat(query(commerce_graph(spark, sf_dir), q))
