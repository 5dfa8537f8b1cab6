"""The engine's relations, projected from the star-schema tables.

``version_log``   tenant, key, ts_us, hlc_node, hlc_seq, value, num, tombstone, size_bytes, kind, entity_id, prop
``node_versions`` id, type, valid_from, valid_to, deleted, ts_us
``edge_versions`` id, src, dst, relation, valid_from, valid_to, deleted, adj_pos, ts_us
``prop_versions`` owner_kind, owner_id, prop, value, num, tombstone, ts_us
``valid_to`` null is open-ended. Times are microseconds since the Unix epoch.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000


@dataclass(frozen=True)
class Graph:
    """A temporal property graph: its three relations of versions and, for key-value reads, the log."""

    nodes: DataFrame
    edges: DataFrame
    props: DataFrame
    log: DataFrame | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="timeweft-"))
    return sc.getCheckpointDir()


def us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for each user and event type; every 97th event is a tombstone."""
    gone = F.col("event_id") % 97 == 0
    text = F.col("value").cast("string")
    return read(spark, sf_dir, "events").select(
        F.lit("default").alias("tenant"),
        F.concat(F.lit("node:user_"), F.col("user_id").cast("string"), F.lit(":prop:"), "event_type").alias("key"),
        us("ts").alias("ts_us"),
        F.lit(0).cast("tinyint").alias("hlc_node"),
        F.lit(0).cast("smallint").alias("hlc_seq"),
        F.when(~gone, text).alias("value"),
        F.when(~gone, F.col("value")).alias("num"),
        gone.alias("tombstone"),
        F.coalesce(F.octet_length(F.when(~gone, text)), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.lit("node_prop").alias("kind"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_id"),
        F.col("event_type").alias("prop"),
    )


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with one property for each event type, and two edges out of each: to the next user, and to (7i + 3) mod n."""
    events = read(spark, sf_dir, "events")
    log = event_log(spark, sf_dir)
    first = events.groupBy("user_id").agg(F.min(us("ts")).alias("valid_from"))
    nodes = first.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("id"), F.lit("user").alias("type"), "valid_from",
        F.lit(None).cast("bigint").alias("valid_to"), F.lit(False).alias("deleted"), F.col("valid_from").alias("ts_us"),
    )
    whole = events.agg((F.max("user_id") + 1).alias("n"), F.min(us("ts")).alias("born"))  # one row
    users = first.select(F.col("user_id").alias("i")).join(F.broadcast(whole))
    hop = F.explode(F.array(
        F.struct(F.lit("n_").alias("p"), ((F.col("i") + 1) % F.col("n")).alias("j"), F.lit("notifies").alias("relation"), F.lit(0).alias("o")),
        F.struct(F.lit("f_").alias("p"), ((F.col("i") * 7 + 3) % F.col("n")).alias("j"), F.lit("influences").alias("relation"), F.lit(1).alias("o")),
    ))
    edges = users.select("i", "born", hop.alias("e")).filter("i <> e.j").select(
        F.concat("e.p", F.col("i").cast("string")).alias("id"),
        F.concat(F.lit("user_"), F.col("i").cast("string")).alias("src"),
        F.concat(F.lit("user_"), F.col("e.j").cast("string")).alias("dst"),
        "e.relation", F.col("born").alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"),
        F.lit(False).alias("deleted"), (F.col("i") * 2 + F.col("e.o")).alias("adj_pos"), F.col("born").alias("ts_us"),
    )
    weights = edges.select(
        F.lit("edge").alias("owner_kind"), F.col("id").alias("owner_id"), F.lit("weight").alias("prop"),
        F.when(F.col("relation") == "notifies", "0.9").otherwise("0.7").alias("value"),
        F.when(F.col("relation") == "notifies", 0.9).otherwise(0.7).alias("num"), F.lit(False).alias("tombstone"), "ts_us",
    )
    own = log.select(F.lit("node").alias("owner_kind"), F.col("entity_id").alias("owner_id"), "prop", "value", "num", "tombstone", "ts_us")
    return Graph(nodes, edges, own.unionByName(weights), log)


#: Table, node type, key column, property columns.
COMMERCE = (
    ("region", "region", "r_regionkey", ("r_name",)),
    ("nation", "nation", "n_nationkey", ("n_name", "n_regionkey")),
    ("customer", "customer", "c_custkey", ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    ("supplier", "supplier", "s_suppkey", ("s_name", "s_nationkey", "s_acctbal")),
    ("part", "part", "p_partkey", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    ("orders", "order", "o_orderkey", ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")),
)


def _id(kind: str, column) -> F.Column:
    return F.concat(F.lit(f"{kind}_"), F.col(column).cast("string") if isinstance(column, str) else column)


def commerce_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions; each line item is an edge order -> part and one part -> supplier."""
    t = {name: read(spark, sf_dir, name) for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    open_end, false = F.lit(None).cast("bigint"), F.lit(False)
    nodes, props = [], []
    for name, kind, key, columns in COMMERCE:
        born = us("o_orderdate") if name == "orders" else F.lit(0).cast("bigint")
        nodes.append(t[name].select(_id(kind, key).alias("id"), F.lit(kind).alias("type"), born.alias("valid_from"), open_end.alias("valid_to"), false.alias("deleted"), born.alias("ts_us")))
        numeric = dict(t[name].dtypes)
        parts = [F.struct(F.lit(c).alias("prop"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if numeric[c] != "string" else F.lit(None).cast("double")).alias("num")) for c in columns]
        rows = t[name].select(_id(kind, key).alias("owner_id"), born.alias("ts_us"), F.explode(F.array(*parts)).alias("p"))
        props.append(rows.select(F.lit("node").alias("owner_kind"), "owner_id", "p.prop", "p.value", "p.num", false.alias("tombstone"), "ts_us"))

    def plain(df: DataFrame, prefix: str, key: str, src, dst, relation: str, born) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), born.alias("valid_from"), open_end.alias("valid_to"), false.alias("deleted"), F.col(key).cast("bigint").alias("adj_pos"), born.alias("ts_us"))

    zero = F.lit(0).cast("bigint")
    edges = [
        plain(t["customer"], "cl_", "c_custkey", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "located_in", zero),
        plain(t["supplier"], "sl_", "s_suppkey", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "located_in", zero),
        plain(t["nation"], "np_", "n_nationkey", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "part_of", zero),
        plain(t["orders"], "pl_", "o_orderkey", _id("customer", "o_custkey"), _id("order", "o_orderkey"), "placed", us("o_orderdate")),
    ]
    line = t["lineitem"].withColumn("born", us("l_shipdate"))
    line = line.withColumn("lid", F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("born") / DAY)))
    line = line.withColumn("pos", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    # Two relations, two branches with a constant each, so a filter on the relation prunes the other; the first version of
    # each edge and, for returned items, its deletion after 30 days.
    first = F.array(F.struct(false.alias("deleted"), zero.alias("after")))
    both = F.array(F.struct(false.alias("deleted"), zero.alias("after")), F.struct(F.lit(True).alias("deleted"), F.lit(30 * DAY).alias("after")))
    times = line.select("lid", "born", "pos", "l_orderkey", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", both).otherwise(first).alias("times"))
    times = times.select("*", F.explode("times").alias("v"))
    for prefix, relation, src, dst in (("ct_", "contains", _id("order", "l_orderkey"), _id("part", "l_partkey")), ("sb_", "supplied_by", _id("part", "l_partkey"), _id("supplier", "l_suppkey"))):
        edges.append(times.select(
            F.concat(F.lit(prefix), "lid").alias("id"), src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.col("born").alias("valid_from"),
            F.when(F.col("v.deleted"), F.col("born") + 30 * DAY).otherwise(F.col("born") + 90 * DAY).alias("valid_to"), "v.deleted", F.col("pos").alias("adj_pos"), (F.col("born") + F.col("v.after")).alias("ts_us"),
        ))
    weight = 1 - F.col("l_discount")
    owned = F.array(
        F.struct(F.lit("quantity").alias("prop"), F.col("l_quantity").alias("num"), zero.alias("after")),
        F.struct(F.lit("weight").alias("prop"), weight.alias("num"), zero.alias("after")),
        F.struct(F.lit("weight").alias("prop"), F.when(F.col("l_linenumber") % 3 == 0, weight - F.col("l_tax")).alias("num"), F.lit(15 * DAY).alias("after")),
    )
    owned = line.select("lid", "born", owned.alias("owned")).select("lid", "born", F.explode("owned").alias("o")).select("*", F.explode(F.array(F.lit("ct_"), F.lit("sb_"))).alias("p")).filter("o.num is not null")
    props.append(owned.select(F.lit("edge").alias("owner_kind"), F.concat("p", "lid").alias("owner_id"), "o.prop", F.col("o.num").cast("string").alias("value"), "o.num", false.alias("tombstone"), (F.col("born") + F.col("o.after")).alias("ts_us")))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Graph(union(nodes), union(edges), union(props))
