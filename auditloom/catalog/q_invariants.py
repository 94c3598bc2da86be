"""Invariant and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arith as A
from ..operators import graph as G, invariants as INV
from . import base as B
from .base import q, query, ql, with_ctes

DAY = lambda c="ts": F.datediff(F.col(c).cast("date"), F.lit("2020-01-01"))

SNAP = """snap AS (SELECT 'e' || user_id AS entity, ts, event_id, CASE WHEN event_id % 9 > 0 THEN CAST(round(value * 100) AS BIGINT) END AS value, CASE WHEN event_id % 11 > 0 THEN 'o' || (event_id % 7) END AS owner, 'o' || (event_id % 5) AS caller, event_type AS fn FROM events)"""


def snapshots(spark, sf):
    e, k = B.table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entity"), "ts", "event_id",
        F.when(k % 9 > 0, F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(k % 11 > 0, F.concat(F.lit("o"), (k % 7).cast("string"))).alias("owner"),
        F.concat(F.lit("o"), (k % 5).cast("string")).alias("caller"), F.col("event_type").alias("fn"))


# Checked arithmetic against plain integers small enough for both engines, with forced edge cases.
@query("f32_checked_arithmetic", """
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS HUGEINT) * 1000 AS a, CAST(l_partkey % 13 AS HUGEINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(a + b AS VARCHAR) AS add, CASE WHEN a >= b * 3000 THEN CAST(a - b * 3000 AS VARCHAR) END AS sub, CAST(a * b AS VARCHAR) AS mul, CASE WHEN b <> 0 THEN CAST(a // b AS VARCHAR) END AS div,
  NULL AS overflow FROM x""")
def f32(spark, sf):
    l = B.table(spark, sf, "lineitem")
    a, b = F.col("l_quantity").cast("decimal(38,0)") * 1000, (F.col("l_partkey") % 13).cast("decimal(38,0)")
    big = F.lit("99999999999999999999999999999999999999").cast("decimal(38,0)")
    return l.select(
        "l_orderkey", "l_linenumber", A.inv_add(a, b).cast("string").alias("add"), A.inv_sub(a, b * 3000).cast("string").alias("sub"),
        A.inv_mul(a, b).cast("string").alias("mul"), A.inv_div(a, b).cast("string").alias("div"), A.inv_mul(big, F.lit(2)).cast("string").alias("overflow"))


def _exprs():
    v = F.col("value")
    return {
        "positive": v > 100,
        "owner_calls": A.inv_and(F.col("owner").isNotNull(), F.col("owner") == F.col("caller")),
        "ratio": A.inv_div(F.lit(100000), v - 500) >= 3,
    }


@query("i1_check_invariants", with_ctes(SNAP, body="""
, c AS (SELECT event_id, 'positive' AS invariant, value > 100 AS v FROM snap
  UNION ALL SELECT event_id, 'owner_calls', CASE WHEN owner IS NULL THEN false ELSE owner = caller END FROM snap
  UNION ALL SELECT event_id, 'ratio', CASE WHEN value <> 500 THEN CAST(trunc(100000 / (value - 500)) AS BIGINT) >= 3 END FROM snap)
SELECT event_id, invariant, CASE WHEN v IS NULL THEN 'undecidable' WHEN v THEN 'holds' ELSE 'violated' END AS outcome FROM c"""))
def i1(spark, sf):
    s = snapshots(spark, sf)
    INV.bind_invariants(s, {"positive": ["value"], "owner_calls": ["owner", "caller"], "ratio": ["value"]})
    return INV.check_invariants(s, ["event_id"], _exprs(), ["value", "owner", "caller"]).drop("state")


@query("i2_bind_invariants", with_ctes(SNAP, body="SELECT entity, event_id, CASE WHEN value IS NULL THEN 'undecidable' WHEN value >= 100 THEN 'holds' ELSE 'violated' END AS outcome FROM snap"))
def i2(spark, sf):
    """Bound by name before anything runs: a set that names an unknown variable is refused."""
    df = snapshots(spark, sf)
    try:
        INV.bind_invariants(df, {"lost": ("value", "no_such_column")})
    except ValueError as refused:
        if "no_such_column" not in str(refused):
            raise
    else:
        raise AssertionError("an unknown variable was bound")
    INV.bind_invariants(df, {"floor": ("value",)})
    return INV.check_invariants(df, ["entity", "event_id"], {"floor": F.col("value") >= 100}, ["value"]).select("entity", "event_id", "outcome")


@query("i3_monotonic", with_ctes(SNAP, body="""
, p AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 20000) AS prev FROM snap)
SELECT entity, event_id, value, prev FROM p WHERE value < prev"""))
def i3(spark, sf):
    m = INV.monotonic(snapshots(spark, sf), ["entity"], ["ts", "event_id"], "value", DAY(), F.lit(20000))
    return m.select("entity", "event_id", "value", F.col("prev").cast("long").alias("prev"))


@query("i4_authorised_change", with_ctes(SNAP, body="""
, p AS (SELECT *, last_value(owner IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM snap)
SELECT entity, event_id, owner, prev AS prev_owner, caller FROM p WHERE fn = 'purchase' AND owner <> prev AND caller <> prev"""))
def i4(spark, sf):
    m = INV.authorised_change(snapshots(spark, sf), ["entity"], ["ts", "event_id"], "purchase", DAY())
    return m.select("entity", "event_id", "owner", "prev_owner", "caller")


@query("i5_owner_constant", with_ctes(SNAP, body="""
, g AS (SELECT entity, arg_min(owner, row(ts, event_id)) FILTER (WHERE owner IS NOT NULL) AS genesis FROM snap GROUP BY entity)
SELECT entity, event_id, owner, genesis FROM snap JOIN g USING (entity) WHERE owner <> genesis"""))
def i5(spark, sf):
    return INV.owner_constant(snapshots(spark, sf), ["entity"], ["ts", "event_id"]).select("entity", "event_id", "owner", "genesis")


# Traces: line items of an order as nested calls. Odd lines open, their mirror closes.
TRACE = """li AS (SELECT l_orderkey AS trace_id, l_partkey % 3 AS a, l_suppkey % 4 = 0 AS rev, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
tr AS (SELECT trace_id, i AS seq, 'begin' AS kind, 'c' || a AS address, false AS reverted FROM li UNION ALL SELECT trace_id, 3 * n - 2 * i + 1, 'end', NULL, rev FROM li UNION ALL SELECT trace_id, 3 * n - 2 * i + 2, 'write', 'c' || a, false FROM li)"""


def traces(spark, sf):
    from pyspark.sql import Window

    l = B.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = l.select(
        F.col("l_orderkey").alias("trace_id"), F.concat(F.lit("c"), (F.col("l_partkey") % 3).cast("string")).alias("a"), (F.col("l_suppkey") % 4 == 0).alias("rev"),
        F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    ev = F.array(
        F.struct(F.col("i").cast("long").alias("seq"), F.lit("begin").alias("kind"), F.col("a").alias("address"), F.lit(False).alias("reverted")),
        F.struct((3 * F.col("n") - 2 * F.col("i") + 1).cast("long").alias("seq"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("address"), F.col("rev").alias("reverted")),
        F.struct((3 * F.col("n") - 2 * F.col("i") + 2).cast("long").alias("seq"), F.lit("write").alias("kind"), F.col("a").alias("address"), F.lit(False).alias("reverted")))
    return li.select("trace_id", F.inline(ev))


@query("i6_reentrant_traces", with_ctes(TRACE, body="""
, f AS (SELECT trace_id, 'c' || a AS address, i AS b, 3 * n - 2 * i + 1 AS e, rev FROM li),
re AS (SELECT x.trace_id, x.address, min(x.e) AS first_end FROM f x JOIN f o ON o.trace_id = x.trace_id AND o.address = x.address AND o.b < x.b AND o.e > x.b WHERE NOT x.rev GROUP BY ALL),
w AS (SELECT trace_id, address, max(seq) AS last_write FROM tr WHERE kind = 'write' GROUP BY ALL)
SELECT trace_id, address, first_end, last_write FROM re JOIN w USING (trace_id, address) WHERE last_write >= first_end"""))
def i6(spark, sf):
    return INV.reentrant_traces(traces(spark, sf))


@query("i7_invariants_for", "SELECT p_partkey AS name, s_suppkey AS contract FROM part JOIN supplier ON 't' || (p_partkey % 40) = 't' || (s_suppkey % 40) WHERE p_size % 3 = 0 AND s_suppkey % 3 = 0")
def i7(spark, sf):
    chain = lambda c: F.when(F.col(c) % 3 == 0, "evm").otherwise("solana").alias("chain")
    target = lambda c: F.concat(F.lit("t"), (F.col(c) % 40).cast("string")).alias("target")
    cfg = B.table(spark, sf, "part").select(F.col("p_partkey").alias("name"), chain("p_size"), target("p_partkey"))
    con = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("contract"), chain("s_suppkey"), target("s_suppkey"))
    return INV.invariants_for(cfg, con, "evm").select("name", "contract")


@query("i8_validate_invariant_config", """
SELECT 'duplicate chain' AS problem, p_brand AS subject FROM part GROUP BY p_brand HAVING count(*) > 1
UNION ALL SELECT 'duplicate invariant', p_name FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'unknown chain', p_name || '->' || 'B' || p_size FROM part WHERE 'B' || p_size NOT IN (SELECT p_brand FROM part)
UNION ALL SELECT 'bad sink', lower(n_name) FROM nation""")
def i8(spark, sf):
    p = B.table(spark, sf, "part")
    return INV.validate_invariant_config(
        p.select(F.col("p_brand").alias("id")), p.select(F.col("p_name").alias("name"), F.concat(F.lit("B"), F.col("p_size").cast("string")).alias("chain")),
        B.table(spark, sf, "nation").select(F.lower("n_name").alias("type")))


@query("a23_conservation", """
WITH b AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS summed FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey AS entity, CAST(summed AS VARCHAR) AS summed, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS stated FROM b JOIN orders ON o_orderkey = l_orderkey WHERE summed <> CAST(o_totalprice AS DECIMAL(18,2))""")
def a23(spark, sf):
    b = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    t = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    r = INV.conservation(b, t, "entity", "amount", "total")
    return r.select("entity", F.col("summed").cast("string").alias("summed"), F.col("stated").cast("string").alias("stated"))


@query("j13_cross_phase", """
WITH s AS (SELECT 'u' || user_id AS entity, event_type AS layer, 'v' || (event_id % 3) AS var, CASE WHEN event_id % 2 = 0 THEN 'validation' ELSE 'execution' END AS phase, max(CAST(round(value * 100) AS BIGINT)) AS value FROM events GROUP BY ALL)
SELECT a.entity, a.layer, a.var, a.value AS before, b.value AS after FROM s a JOIN s b USING (entity, layer, var) WHERE a.phase = 'validation' AND b.phase = 'execution' AND NOT (b.value >= a.value)""")
def j13(spark, sf):
    e, k = B.table(spark, sf, "events"), F.col("event_id")
    s = e.groupBy(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("layer"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("var"),
        F.when(k % 2 == 0, "validation").otherwise("execution").alias("phase")).agg(F.max(F.round(F.col("value") * 100).cast("long")).alias("value"))
    return INV.cross_phase(s, "validation", "execution", ">=")


@query("p12_privileged_unguarded", "SELECT l_orderkey, l_linenumber, 'unauthorized_privileged_mutation' AS invariant_id, 'Critical' AS severity FROM lineitem WHERE l_tax <= 0.01")
def p12(spark, sf):
    l = B.table(spark, sf, "lineitem")
    guards = F.when(F.col("l_tax") > 0.01, F.array(F.struct(F.lit("owner").alias("kind"), F.col("l_returnflag").alias("on")))).otherwise(F.array().cast("array<struct<kind:string,on:string>>"))
    return INV.privileged_unguarded(l.withColumn("guards", guards)).select("l_orderkey", "l_linenumber", "invariant_id", "severity")


# Instruction streams: events of a user in order.
_SEQ = "sq AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)"


def _sequence(spark, sf):
    from pyspark.sql import Window

    e = B.table(spark, sf, "events")
    return e.select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"))


@query("r17_followed_by_within", with_ctes(_SEQ, body="""
SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS near FROM sq) WHERE event_type = 'purchase' AND near = 1"""))
def r17(spark, sf):
    s, t = _sequence(spark, sf), F.col("event_type")
    # A small block exercises the edges; the default suits real streams.
    spread, n = s, 3
    return INV.followed_by_within(spread, ["user_id"], "seq", t == "purchase", t == "error", n).select("user_id", "event_id")


@query("r17_not_preceded_by", with_ctes(_SEQ, body="SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS prev FROM sq) WHERE event_type = 'purchase' AND prev <> 'view'"))
def r17b(spark, sf):
    s, t = _sequence(spark, sf), F.col("event_type")
    return INV.not_preceded_by(s, ["user_id"], "seq", t == "purchase", t == "view").select("user_id", "event_id")


# ---- graphs -----------------------------------------------------------------------

# Orders link their customer to another node; the graph has cycles and grows with the table.
EDGES = """n AS (SELECT count(*) AS m FROM customer), edges AS (SELECT DISTINCT o_custkey AS src, o_orderkey % m AS dst FROM orders, n)"""


def edges(spark, sf):
    m = B.table(spark, sf, "customer").agg(F.count("*")).scalar()
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % m).alias("dst")).distinct()


@query("g1_reachable", with_ctes(EDGES, body="").replace("WITH ", "WITH RECURSIVE ") + """
, seeds AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0), walk(node) AS (SELECT node FROM seeds UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.node) SELECT DISTINCT node FROM walk""")
def g1(spark, sf):
    seeds = B.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("root"))
    return G.reachable_set(edges(spark, sf), seeds).select("node")


# Call graphs: small acyclic-ish graphs per nation, one node per customer.
_CALL = """c0 AS (SELECT c_custkey AS k, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
nn AS (SELECT g, max(i) AS m FROM c0 GROUP BY g),
cedge AS (SELECT g, i AS src, i * 2 AS dst FROM c0 JOIN nn USING (g) WHERE i * 2 <= m UNION SELECT g, i, i * 2 + 1 FROM c0 JOIN nn USING (g) WHERE i * 2 + 1 <= m
  UNION SELECT g, i, i + 3 FROM c0 JOIN nn USING (g) WHERE i % 4 = 0 AND i + 3 <= m UNION SELECT g, i, i // 3 FROM c0 WHERE i % 7 = 0 AND i // 3 > 0 UNION SELECT g, i, 1 FROM c0 WHERE i % 10 = 0)"""


def call_edges(spark, sf):
    from pyspark.sql import Window

    c = B.table(spark, sf, "customer")
    w = Window.partitionBy("c_nationkey")
    c0 = c.select(F.col("c_nationkey").alias("g"), F.row_number().over(w.orderBy("c_custkey")).cast("long").alias("i"), F.count("*").over(w).alias("m"))
    i, m = F.col("i"), F.col("m")
    cand = F.array(
        F.when(i * 2 <= m, i * 2), F.when(i * 2 + 1 <= m, i * 2 + 1), F.when((i % 4 == 0) & (i + 3 <= m), i + 3),
        F.when((i % 7 == 0) & (F.floor(i / 3) > 0), F.floor(i / 3)),
        F.when(i % 10 == 0, F.lit(1).cast("long")))
    return c0.select("g", i.alias("src"), F.explode(F.array_compact(cand)).alias("dst")).distinct()


@query("g2_transitive_mutations", with_ctes(_CALL, body="").replace("WITH ", "WITH RECURSIVE ") + """
, ce AS (SELECT g || ':' || src AS src, g || ':' || dst AS dst FROM cedge), r(root, node) AS (SELECT DISTINCT src, src FROM ce UNION SELECT DISTINCT dst, dst FROM ce UNION SELECT r.root, e.dst FROM r JOIN ce e ON e.src = r.node)
SELECT DISTINCT root AS "function", 'var' || (length(node) % 3) || right(node, 1) AS variable FROM r WHERE right(node, 1) IN ('1', '5')""")
def g2(spark, sf):
    name = lambda c: F.concat(F.col("g").cast("string"), F.lit(":"), F.col(c).cast("string"))
    e = call_edges(spark, sf).select(name("src").alias("src"), name("dst").alias("dst"))
    nodes = e.select(F.col("src").alias("function")).unionByName(e.select(F.col("dst").alias("function"))).distinct()
    muts = nodes.filter(F.substring("function", -1, 1).isin("1", "5")).select(
        "function", F.concat(F.lit("var"), (F.length("function") % 3).cast("string"), F.substring("function", -1, 1)).alias("variable"))
    return G.transitive_mutations(e, muts, nodes)


@query("g3_transitive_dependents", with_ctes(_CALL, body="").replace("WITH ", "WITH RECURSIVE ") + """
, ce AS (SELECT g || ':' || src AS src, g || ':' || dst AS dst FROM cedge), r(root, node) AS (SELECT DISTINCT src, src FROM ce UNION SELECT r.root, e.dst FROM r JOIN ce e ON e.src = r.node)
SELECT DISTINCT root AS variable, node AS dependent FROM r WHERE root <> node""")
def g3(spark, sf):
    name = lambda c: F.concat(F.col("g").cast("string"), F.lit(":"), F.col(c).cast("string"))
    e = call_edges(spark, sf).select(name("src").alias("src"), name("dst").alias("dst"))
    return G.transitive_dependents(e, e.select(F.col("src").alias("variable")))


# Dominators by definition: unreachable from the entry once the candidate is taken out.
_DOM = with_ctes(_CALL, body="").replace("WITH ", "WITH RECURSIVE ") + """
, live(g, node) AS (SELECT DISTINCT g, CAST(1 AS BIGINT) FROM cedge UNION SELECT l.g, e.dst FROM live l JOIN cedge e ON e.g = l.g AND e.src = l.node),
av(g, dom, node) AS (SELECT g, node, CAST(1 AS BIGINT) FROM live WHERE node <> 1 UNION SELECT a.g, a.dom, e.dst FROM av a JOIN cedge e ON e.g = a.g AND e.src = a.node WHERE e.dst <> a.dom),
doms AS (SELECT n.g, n.node, d.node AS dom FROM live n JOIN live d ON d.g = n.g LEFT JOIN (SELECT DISTINCT * FROM av) a ON a.g = n.g AND a.dom = d.node AND a.node = n.node WHERE a.g IS NULL)
"""


def _flow_graphs(spark, sf):
    e = call_edges(spark, sf).withColumnRenamed("g", "graph")
    return e, e.select("graph", F.lit(1).cast("long").alias("entry")).distinct()


@query("g4_dominators", _DOM + "SELECT g AS graph, node, dom FROM doms")
def g4(spark, sf):
    return G.dominators(*_flow_graphs(spark, sf))


@query("g5_loops", _DOM + "SELECT DISTINCT e.g AS graph, e.src, e.dst FROM cedge e JOIN doms d ON d.g = e.g AND d.node = e.src AND d.dom = e.dst")
def g5(spark, sf):
    return G.loops(*_flow_graphs(spark, sf))


# Assignments and uses: line items of an order as statements of a function.
_ASSIGN = """st AS (SELECT l_orderkey AS "function", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line, 'v' || (l_partkey % 3) AS target, 'v' || (l_suppkey % 3) AS used, l_returnflag = 'R' AS src FROM lineitem)"""


def statements(spark, sf):
    from pyspark.sql import Window

    l = B.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return l.select(
        F.col("l_orderkey").alias("function"), F.row_number().over(w).cast("long").alias("line"), F.concat(F.lit("v"), (F.col("l_partkey") % 3).cast("string")).alias("target"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 3).cast("string")).alias("used"), (F.col("l_returnflag") == "R").alias("src"))


def _parts(spark, sf):
    s = statements(spark, sf)
    return s, s.select("function", F.col("target").alias("variable"), "line"), s.select("function", F.col("used").alias("variable"), "line")


_DU = """, du AS (SELECT u."function", u.used AS variable, (SELECT max(d.line) FROM st d WHERE d."function" = u."function" AND d.target = u.used AND d.line < u.line) AS def_line, u.line AS use_line FROM st u)"""


@query("g6_def_use", with_ctes(_ASSIGN, body=_DU + ' SELECT "function", variable, def_line, use_line FROM du WHERE def_line IS NOT NULL'))
def g6(spark, sf):
    _, a, u = _parts(spark, sf)
    return G.def_use(a, u)


@query("g6_tainted", with_ctes(_ASSIGN, body=_DU).replace("WITH ", "WITH RECURSIVE ") + """
, tv(f, line) AS (SELECT "function", line FROM st WHERE src UNION SELECT t.f, d.use_line FROM tv t JOIN du d ON d."function" = t.f AND d.def_line = t.line)
SELECT CAST(s."function" AS VARCHAR) AS "function", s.target AS variable, s.line FROM (SELECT DISTINCT * FROM tv) t JOIN st s ON s."function" = t.f AND s.line = t.line""")
def g6b(spark, sf):
    s, a, u = _parts(spark, sf)
    return G.tainted(a, u, s.filter("src").select("function", "line"))
