"""DuckDB twins of the relations in ``sources.tables``, as CTEs that every oracle begins with."""

DAY = 86_400_000_000

LOG = """
log AS (
  SELECT 'node:user_' || user_id || ':prop:' || event_type AS key, epoch_us(ts) AS ts_us,
         CASE WHEN event_id % 97 <> 0 THEN CAST(value AS VARCHAR) END AS value,
         CASE WHEN event_id % 97 <> 0 THEN value END AS num, event_id % 97 = 0 AS tombstone,
         'user_' || user_id AS entity_id, event_type AS prop, user_id, event_id
  FROM events)"""

USERS = (
    LOG
    + """,
u AS (SELECT user_id AS i, min(epoch_us(ts)) AS born FROM events GROUP BY 1),
w AS (SELECT max(user_id) + 1 AS n, min(epoch_us(ts)) AS born FROM events),
nodes AS MATERIALIZED (SELECT 'user_' || i AS id, 'user' AS type, born AS valid_from, CAST(NULL AS BIGINT) AS valid_to, false AS deleted, born AS ts_us FROM u),
hops AS (
  SELECT i, (i + 1) % w.n AS j, 'n_' AS p, 'notifies' AS relation, 0 AS o, w.born, '0.9' AS weight FROM u, w
  UNION ALL SELECT i, (i * 7 + 3) % w.n, 'f_', 'influences', 1, w.born, '0.7' FROM u, w),
edges AS MATERIALIZED (
  SELECT p || i AS id, 'user_' || i AS src, 'user_' || j AS dst, relation, born AS valid_from, CAST(NULL AS BIGINT) AS valid_to,
         false AS deleted, i * 2 + o AS adj_pos, born AS ts_us FROM hops WHERE i <> j),
props AS MATERIALIZED (
  SELECT 'node' AS owner_kind, entity_id AS owner_id, prop, value, num, tombstone, ts_us FROM log
  UNION ALL SELECT 'edge', p || i, 'weight', weight, CAST(weight AS DOUBLE), false, born FROM hops WHERE i <> j)"""
)


def _plain(table: str, prefix: str, key: str, src: str, dst: str, relation: str, born: str) -> str:
    return f"SELECT '{prefix}' || {key} AS id, {src} AS src, {dst} AS dst, '{relation}' AS relation, {born} AS valid_from, CAST(NULL AS BIGINT) AS valid_to, false AS deleted, CAST({key} AS BIGINT) AS adj_pos, {born} AS ts_us FROM {table}"


def _props(table: str, kind: str, key: str, columns: dict[str, bool], born: str) -> str:
    one = "SELECT 'node' AS owner_kind, '{k}_' || {key} AS owner_id, '{c}' AS prop, CAST({c} AS VARCHAR) AS value, {n} AS num, false AS tombstone, {b} AS ts_us FROM {t}"
    return " UNION ALL ".join(one.format(k=kind, key=key, c=c, n=f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)", b=born, t=table) for c, numeric in columns.items())


_NODES = (("region", "region", "r_regionkey", "0"), ("nation", "nation", "n_nationkey", "0"), ("customer", "customer", "c_custkey", "0"), ("supplier", "supplier", "s_suppkey", "0"), ("part", "part", "p_partkey", "0"), ("orders", "order", "o_orderkey", "epoch_us(o_orderdate)"))

COMMERCE = (
    "nodes AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT '{k}_' || {key} AS id, '{k}' AS type, CAST({b} AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, false AS deleted, CAST({b} AS BIGINT) AS ts_us FROM {t}" for t, k, key, b in _NODES)
    + f"""),
line AS (SELECT *, epoch_us(l_shipdate) AS born, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || (epoch_us(l_shipdate) // {DAY}) AS lid FROM lineitem),
lines AS (
  SELECT 'ct_' || lid AS id, 'order_' || l_orderkey AS src, 'part_' || l_partkey AS dst, 'contains' AS relation, born, l_returnflag, l_orderkey * 8 + l_linenumber AS adj_pos FROM line
  UNION ALL SELECT 'sb_' || lid, 'part_' || l_partkey, 'supplier_' || l_suppkey, 'supplied_by', born, l_returnflag, l_orderkey * 8 + l_linenumber FROM line),
edges AS MATERIALIZED (
  """
    + " UNION ALL ".join(
        [
            _plain("customer", "cl_", "c_custkey", "'customer_' || c_custkey", "'nation_' || c_nationkey", "located_in", "CAST(0 AS BIGINT)"),
            _plain("supplier", "sl_", "s_suppkey", "'supplier_' || s_suppkey", "'nation_' || s_nationkey", "located_in", "CAST(0 AS BIGINT)"),
            _plain("nation", "np_", "n_nationkey", "'nation_' || n_nationkey", "'region_' || n_regionkey", "part_of", "CAST(0 AS BIGINT)"),
            _plain("orders", "pl_", "o_orderkey", "'customer_' || o_custkey", "'order_' || o_orderkey", "placed", "epoch_us(o_orderdate)"),
            f"SELECT id, src, dst, relation, born, born + 90 * {DAY}, false, adj_pos, born FROM lines",
            f"SELECT id, src, dst, relation, born, born + 30 * {DAY}, true, adj_pos, born + 30 * {DAY} FROM lines WHERE l_returnflag = 'R'",
        ]
    )
    + "),\nprops AS MATERIALIZED ("
    + " UNION ALL ".join(
        [
            _props("region", "region", "r_regionkey", {"r_name": False}, "0"),
            _props("nation", "nation", "n_nationkey", {"n_name": False, "n_regionkey": True}, "0"),
            _props("customer", "customer", "c_custkey", {"c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}, "0"),
            _props("supplier", "supplier", "s_suppkey", {"s_name": False, "s_nationkey": True, "s_acctbal": True}, "0"),
            _props("part", "part", "p_partkey", {"p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True}, "0"),
            _props("orders", "order", "o_orderkey", {"o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "o_orderpriority": False}, "epoch_us(o_orderdate)"),
            *[f"SELECT 'edge', '{p}' || lid, 'quantity', CAST(l_quantity AS VARCHAR), l_quantity, false, born FROM line" for p in ("ct_", "sb_")],
            *[f"SELECT 'edge', '{p}' || lid, 'weight', CAST(1 - l_discount AS VARCHAR), 1 - l_discount, false, born FROM line" for p in ("ct_", "sb_")],
            *[f"SELECT 'edge', '{p}' || lid, 'weight', CAST(1 - l_discount - l_tax AS VARCHAR), 1 - l_discount - l_tax, false, born + 15 * {DAY} FROM line WHERE l_linenumber % 3 = 0" for p in ("ct_", "sb_")],
        ]
    )
    + ")"
)


def snapshot(at: int | None, check_valid: bool = True, tag: str = "") -> str:
    """CTEs ``nodes_at``, ``edges_at`` and ``props_at`` (with ``tag`` behind the name)."""
    seen = f"WHERE ts_us <= {at}" if at is not None else ""
    ok = f"AND valid_from <= {at} AND (valid_to IS NULL OR valid_to > {at})" if at is not None and check_valid else ""
    last = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY ts_us DESC) = 1"
    return f"""nodes_raw{tag} AS MATERIALIZED (SELECT * FROM nodes {seen} {last.format(k='id')}),
nodes_at{tag} AS MATERIALIZED (SELECT * FROM nodes_raw{tag} WHERE NOT deleted {ok}),
edges_at{tag} AS MATERIALIZED (SELECT * FROM (SELECT * FROM edges {seen} {last.format(k='id')}) WHERE NOT deleted {ok}),
props_at{tag} AS MATERIALIZED (SELECT * FROM (SELECT * FROM props {seen} {last.format(k='owner_kind, owner_id, prop')}) WHERE NOT tombstone)"""
