"""Compiles statements to DataFrames by calling the operators, so the language and the API agree."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value, compare, duration, fmt, micros, num, truthy
from ..operators import graph as G
from ..operators import series as S
from ..operators import stats, store, traverse
from ..sources.tables import Graph
from .syntax import Binary, Call, Literal, Name, NodePattern, Not, QueryError, Star, Statement, parse

AGGREGATES: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "stddev": F.stddev_pop}


class Compiler:
    """``at`` stands for now where a statement gives no time; None reads the latest versions. ``nulls``: ``reference`` compares a
    missing value as the text ``<nil>``; ``sql`` has SQL's nulls and plain predicates, which reach the scan."""

    def __init__(self, g: Graph, at: int | None = None, nulls: str = "reference", fetch_as_of: bool = False):
        self.g, self.at, self.nulls, self.fetch_as_of = g, at, nulls, fetch_as_of

    def run(self, text: str) -> DataFrame:
        statement = parse(text)
        return getattr(self, f"_{statement.head}")(statement)

    # Expressions

    def value(self, e, rows: DataFrame) -> Value:
        match e:
            case Literal(str() as v):
                return Value(num(F.lit(v)), F.lit(v), F.lit(v))
            case Literal(bool() as v):
                return Value.of_flag(F.lit(v))
            case Literal(v):
                return Value.of_number(F.lit(v))
            case Name(path):
                return self.column(".".join(path), rows)
            case Binary("+", a, b):
                joined = F.concat(self.value(a, rows).text, self.value(b, rows).text)
                return Value(num(joined), joined, joined)
            case Binary("AND" | "OR" as op, a, b):
                x, y = truthy(self.value(a, rows)), truthy(self.value(b, rows))
                return Value.of_flag(x & y if op == "AND" else x | y)
            case Binary(op, a, b):
                x, y = self.value(a, rows), self.value(b, rows)
                return Value.of_flag(self._sql_compare(op, a, b, x, y) if self.nulls == "sql" else compare(op, x, y))
            case Not(inner):
                return Value.of_flag(~truthy(self.value(inner, rows)))
            case Call("latest", _):
                return self.column(name_of(e), rows)
        return Value.missing()

    def _sql_compare(self, op: str, a, b, x: Value, y: Value) -> Column:
        number = any(isinstance(s, Literal) and isinstance(s.value, float) for s in (a, b))
        l, r = (x.num, y.num) if number else (x.raw.cast("string"), y.raw.cast("string"))
        return {"=": l == r, "!=": l != r, "<": l < r, ">": l > r, "<=": l <= r, ">=": l >= r}[op]

    def column(self, name: str, rows: DataFrame) -> Value:
        kinds = dict(rows.dtypes)
        if name not in kinds:
            return Value.missing()
        c = F.col(f"`{name}`")
        if kinds[name] == "boolean":
            return Value.of_flag(c)
        if name in ("valid_from", "valid_to"):  # rendered, never a number
            return Value(F.lit(None).cast("double"), F.coalesce(c.cast("string"), F.lit("<nil>")), c)
        if kinds[name] != "string":
            return Value.of_number(c) if kinds[name] in ("double", "float") else Value(c.cast("double"), F.coalesce(c.cast("string"), F.lit("<nil>")), c)
        if name.endswith((".id", ".relation", ".__type")) or "." not in name:  # texts that weren't stored as values stay as they are
            return Value(num(c), F.coalesce(c, F.lit("<nil>")), c)
        return Value.of_text(c)

    # Clauses that statements share

    def page(self, rows: DataFrame, s: Statement, ties: Iterable[str] = ()) -> DataFrame:
        """Order (on unprojected rows), then offset, then limit. Numbers sort before texts and a missing value as ``<nil>``; ``ties`` decide the rest."""
        if "order" in s.clauses:
            keys = []
            for e, down in s.clauses["order"]:
                v = self.value(e, rows)
                for k in (v.num.isNull(), v.num, v.text):
                    keys.append(k.desc() if down else k.asc())
            rows = rows.orderBy(*keys, *[F.col(f"`{t}`") for t in ties])
        if "offset" in s.clauses:
            rows = rows.offset(s.clauses["offset"])
        return rows.limit(s.clauses["limit"]) if "limit" in s.clauses else rows

    def where(self, rows: DataFrame, s: Statement) -> DataFrame:
        return rows.filter(truthy(self.value(s.clauses["where"], rows))) if "where" in s.clauses else rows

    def project(self, rows: DataFrame, s: Statement) -> DataFrame:
        """Named after the text of each item; a name that comes twice is there once. ``*`` or no RETURN: all columns but inner ones."""
        items = s.clauses.get("return", [Star()])
        if len(items) == 1 and isinstance(items[0], Star):
            return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not any(p.startswith("__") for p in c.split("."))])
        named = {name_of(e): e for e in items}
        if any(isinstance(e, Call) and (e.name in AGGREGATES or e.name == "count") for e in items):
            plain = [self.value(e, rows).raw.alias(n) for n, e in named.items() if not isinstance(e, Call)]
            made = [self.aggregate(e, rows).alias(n) for n, e in named.items() if isinstance(e, Call)]
            return rows.groupBy(*plain).agg(*made).select(*[F.col(f"`{n}`") for n in named])
        return rows.select(*[self.value(e, rows).raw.alias(n) for n, e in named.items()])

    def aggregate(self, e: Call, rows: DataFrame) -> Column:
        if e.name == "count":
            return F.count(F.lit(1)) if not e.args or isinstance(e.args[0], Star) else F.count(self.value(e.args[0], rows).raw)
        return AGGREGATES[e.name](self.value(e.args[0], rows).num)

    def time(self, s: Statement) -> int | None:
        return stamp(s.clauses["at"]) if "at" in s.clauses else self.at

    # Statements

    def _match(self, s: Statement) -> DataFrame:
        g, at, elements = self.g, self.time(s), s.subject
        nodes = edges = None
        if "during" in s.clauses:
            start, end = map(stamp, s.clauses["during"])
            edges = G.edges_at(g, at, check_valid=False).filter(G.overlaps(start, end))
        want = self._wanted(s)
        first = elements[0]
        if "during" in s.clauses:
            nodes = G.nodes_at(g, at, first.type, check_valid=False).filter(G.overlaps(start, end))
        rows = G.scan(g, at, first.var, first.type, want(first.var, "node"), nodes)
        bound, here = {first.var}, first.var
        for edge, node in zip(elements[1::2], elements[2::2], strict=True):
            again = node.var in bound
            var = f"__again_{node.var}" if again else node.var
            props = {edge.var: want(edge.var, "edge"), var: () if again else want(node.var, "node")}
            rows = G.expand(rows, g, at, here, edge.var, var, edge.direction, edge.relation, node.type, props, edges)
            if again:  # a variable that comes again is the same node
                rows = rows.filter(F.col(f"`{var}.__id`") == F.col(f"`{node.var}.__id`"))
                rows = rows.drop(f"{var}.__id", f"{var}.id", f"{var}.__type")
            bound |= {node.var, edge.var}
            here = node.var
        rows = self.where(rows, s)
        for item in s.clauses.get("fetch", ()):
            rows = self._fetched(rows, item)
        for call in _calls(s.clauses.get("return", ()), "latest"):
            rows = G.fetch_latest(rows, self._log(), self.value(call.args[0], rows).text, name_of(call))
        return self.project(self.page(rows, s, [c for c in rows.columns if c.endswith(".__id")]), s)

    def _wanted(self, s: Statement) -> Callable[[str, str], list[str]]:
        """Which properties of a variable a statement mentions; all there are for ``*`` or no RETURN."""
        c = s.clauses
        used = list(_names([c.get("where"), *c.get("return", ()), *[e for e, _ in c.get("order", ())], *[i["key"] for i in c.get("fetch", ())]]))
        made = {i["alias"] for i in c.get("fetch", ())}
        used = [p for p in used if ".".join(p) not in made]
        all_ = "return" not in c or any(isinstance(e, Star) for e in c["return"])
        known = {k: G.property_names(self.g, k) for k in ("node", "edge")} if all_ else {}
        own = {"node": {"id", "__type", "__id"}, "edge": {"id", "relation", "__id"}}

        def wanted(var: str, kind: str) -> list[str]:
            named = {".".join(p[1:]) for p in used if p[0] == var and len(p) > 1}
            return sorted((named | (set() if var.startswith("__") else set(known.get(kind, ())))) - own[kind])

        return wanted

    def _fetched(self, rows: DataFrame, item: dict) -> DataFrame:
        key = self.value(item["key"], rows).text
        if item["mode"] == "latest":
            return G.fetch_latest(rows, self._log(), key, item["alias"], self.at if self.fetch_as_of else None)
        bounds = {k: stamp(item[k]) if k in item else None for k in ("from", "to")}
        return G.fetch_history(rows, self._log(), key, item["alias"], bounds["from"], bounds["to"], item.get("last"))

    def _log(self) -> DataFrame:
        if self.g.log is None:
            raise QueryError("this graph has no key-value log")
        return self.g.log

    def _causal(self, s: Statement) -> DataFrame:
        c, at = s.clauses, self.time(s)
        if at is None:
            raise QueryError("CAUSAL needs a time: AT, or the compiler's")
        window = duration(c["window"]) if "window" in c else 30_000_000
        direction = "backward" if c.get("backward") else "forward"
        rows = traverse.causal(self.g, s.subject, at, c.get("depth", 5), window, direction)
        names = traverse.display_names(self.g)
        steps = rows.select("node_id", F.posexplode("path").alias("i", "n")).join(names, F.col("n") == F.col("node"), "left")
        shown = steps.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "n").alias("n")))), lambda x: x["n"]), " -> ").alias("path"))
        rows = rows.drop("path").join(shown.withColumnRenamed("node_id", "_n"), F.col("node_id") == F.col("_n")).drop("_n")
        rows = rows.join(names, F.col("node_id") == F.col("node"), "left")
        rows = rows.select(F.coalesce("name", "node_id").alias("node_id"), "depth", F.col("delta").cast("double").alias("delta"), "confidence", "path", "via_edge", "via_rel", F.col("rank").alias("__rank"))
        rows = self.where(rows, s)
        if "order" not in c:
            rows = rows.orderBy("depth", "__rank")
        return self.project(self.page(rows, s, ("depth", "__rank")), s)

    def _diff(self, s: Statement) -> DataFrame:
        if "between" not in s.clauses:
            raise QueryError("DIFF needs BETWEEN")
        t1, t2 = map(stamp, s.clauses["between"])
        first, relation = s.subject[0], next((e.relation for e in s.subject if not isinstance(e, NodePattern)), None)
        rows = self.where(G.diff(self.g, t1, t2, relation, first.type), s)
        rows = rows if "order" in s.clauses else rows.orderBy("edge_id")
        return self.project(self.page(rows, s, ("edge_id",)), s)

    def _history(self, s: Statement) -> DataFrame:
        c = s.clauses
        start, end = map(stamp, c["from"]) if "from" in c else (None, None)
        last = c.get("last")
        rows = store.history(self._log(), s.subject, start, end, last, reverse=last is not None)
        if "downsample" not in c:
            return rows.select(F.col("ts_us").alias("timestamp"), "value", "tombstone")
        # The newest n are sampled from new to old: times count down, so their negatives count up.
        sign = -1 if last is not None else 1
        series = rows.select("key", (F.col("ts_us") * sign).alias("ts_us"), F.coalesce("num", F.lit(0.0)).alias("value"))
        out = S.downsample(series, *c["downsample"])
        return out.orderBy("ts_us").select((F.col("ts_us") * sign).alias("timestamp"), "value")

    def _meta(self, s: Statement) -> DataFrame:
        rows = stats.meta_scan(self._log(), s.subject).withColumn("avg_interval", F.lit(None).cast("double"))
        rows = self.where(rows, s)
        out = self.page(rows, s, ("key",))
        return self.project(out if "return" in s.clauses else out.drop("avg_interval"), s)

    def _show(self, s: Statement) -> DataFrame:
        rows = {"nodes": G.show_nodes, "edges": G.show_edges, "keys": G.show_keys}[s.subject](self.g)
        return self.page(self.where(rows, s), s, rows.columns[:1])

    def _describe(self, s: Statement) -> DataFrame:
        kind, id_ = s.subject
        rows = G.describe(self.g, kind, self.time(s), id_)
        return self.page(self.where(rows, s), s, ("id",))


def stamp(text: str) -> int:
    try:
        return micros(text)
    except ValueError as e:
        raise QueryError(f"not a time: {text!r}") from e


def name_of(e) -> str:
    """The column that an expression makes."""
    match e:
        case Name(path):
            return ".".join(path)
        case Literal(str() as v):
            return v
        case Literal(_, source):
            return source
        case Binary(op, a, b):
            return f"{name_of(a)}{op}{name_of(b)}"
        case Not(inner):
            return f"NOT {name_of(inner)}"
        case Call(name, args):
            return f"{name}({', '.join(map(name_of, args))})"
    return "*"


def _parts(e) -> tuple:
    match e:
        case Binary(_, a, b):
            return (a, b)
        case Not(inner):
            return (inner,)
        case Call(_, args):
            return args
    return ()


def _names(exprs) -> Iterable[tuple[str, ...]]:
    for e in exprs:
        if isinstance(e, Name):
            yield e.path
        yield from _names(_parts(e))


def _calls(exprs, name: str) -> list[Call]:
    out = []
    for e in exprs:
        if isinstance(e, Call) and e.name == name:
            out.append(e)
        out += _calls(_parts(e), name)
    return out


def query(g: Graph, text: str, at: int | None = None, **options) -> DataFrame:
    """Runs one statement."""
    return Compiler(g, at, **options).run(text)


def rendered(rows: DataFrame) -> DataFrame:
    """Every cell as the text that the language's remote interface sends."""
    kinds = dict(rows.dtypes)
    cell = lambda c: fmt(F.col(f"`{c}`").cast("double")) if kinds[c] in ("double", "float") else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("<nil>"))
    return rows.select(*[cell(c).alias(c) for c in rows.columns])
