"""Queries over modules as a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .inputs import EDGES_SQL, MODULES_SQL, import_edges, module, table

LAYER_OF = "n_nationkey % 4"


def _all_nodes(spark, sf):
    return table(spark, sf, "supplier").select(module("s_suppkey").alias("path"))


def _exports(spark, sf):
    """Each module exports three names."""
    return _all_nodes(spark, sf).select("path", F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("name"))


def _named(edges):
    """An edge names one export of its target, by the numbers' arithmetic."""
    n = F.substring("src", 2, 6).cast("int") + F.substring("dst", 2, 6).cast("int")
    return edges.select(F.col("dst").alias("path"), F.element_at(F.array(*[F.lit(x) for x in "abc"]), F.pmod(n, F.lit(3)) + 1).alias("name"))


def _unused_exports(s, d):
    edges = import_edges(s, d)
    whole = edges.filter(F.col("src").endswith("7")).select(F.col("dst").alias("path"))
    return G.unused_exports(_exports(s, d), _named(edges), whole, s.createDataFrame([("m000001",), ("m000002",)], "path string"))


def _layers(s, d):
    n = table(s, d, "nation").select(F.col("n_name").alias("path"), F.concat(F.lit("layer"), F.expr(LAYER_OF).cast("string")).alias("layer"), F.lit(0).alias("ordinal"))
    return n.unionByName(n.filter("path LIKE '%3'").withColumns({"layer": F.lit("other"), "ordinal": F.lit(1)}))


def _forbidden(s, d):
    """Nations 'import' the nations of their region with a larger key."""
    n = table(s, d, "nation")
    edges = n.alias("a").join(n.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).filter("a.n_nationkey < b.n_nationkey").select(F.col("a.n_name").alias("src"), F.col("b.n_name").alias("dst"))
    return G.forbidden_imports(edges, _layers(s, d), s.createDataFrame([("layer0", "layer1"), ("layer2", "layer3"), ("layer1", "layer2")], "layer string, target string"))


def _resolve(s, d):
    """Imports of parts by name, where files exist with some suffixes."""
    p = table(s, d, "part").select("p_partkey")
    name = F.concat(F.lit("lib/p"), F.col("p_partkey").cast("string"))
    suffix = F.when(F.col("p_partkey") % 4 == 0, ".js").when(F.col("p_partkey") % 4 == 1, "/index.ts").when(F.col("p_partkey") % 4 == 2, ".ts")
    files = p.select(F.concat(name, suffix).alias("path")).filter("path IS NOT NULL").unionByName(p.filter("p_partkey % 8 = 0").select(F.concat(name, F.lit(".ts")).alias("path")))
    return G.resolve(p.select(F.col("p_partkey").alias("importer"), name.alias("target")), files)


def _declared(s, d):
    line = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    name = lambda c: F.concat(F.lit("dep"), F.pmod(F.col(c), F.lit(40)).cast("string"))
    declared = line.filter("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("package"), name("l_partkey").alias("name")).distinct()
    used = line.filter("l_quantity > 25").select(F.col("l_suppkey").cast("string").alias("package"), name("l_partkey").alias("name")).distinct()
    return declared, used


def _unused_dependency(s, d):
    declared, used = _declared(s, d)
    peers = s.createDataFrame([("dep0", "dep1"), ("dep1", "dep2"), ("dep5", "dep6"), ("dep6", "dep5")], "name string, peer string")
    return G.unused_dependencies(declared, used, peers)


def _unlisted_dependency(s, d):
    declared, used = _declared(s, d)
    root = s.createDataFrame([("", "dep5"), ("", "dep10")], "package string, name string")
    return G.unlisted_dependencies(used, declared.unionByName(root), s.createDataFrame([("dep0",)], "name string"))


def _rings(s, d):
    return G.rings(import_edges(s, d))


def _shortest(s, d):
    edges = import_edges(s, d)
    return G.shortest_rings(edges, G.rings(edges)).select("ring", F.size("path").alias("length"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"))


QUERIES = {
    "import_edges": import_edges,
    "unused_nodes": lambda s, d: G.unused_files(_all_nodes(s, d), import_edges(s, d), s.createDataFrame([("m000001",)], "path string")),
    "unused_exports": _unused_exports,
    "forbidden_layer": _forbidden,
    "resolve_priority": _resolve,
    "unused_dependency": _unused_dependency,
    "unlisted_dependency": _unlisted_dependency,
    "reachable_closure": lambda s, d: G.closure(import_edges(s, d)),
    "cycle_components": _rings,
    "shortest_cycle": _shortest,
    "clone_components": lambda s, d: G.components(import_edges(s, d).select(F.col("src").alias("u"), F.col("dst").alias("v"))),
}

_NAMED = "SELECT dst AS path, (ARRAY['a', 'b', 'c'])[((substr(src, 2, 6)::INTEGER + substr(dst, 2, 6)::INTEGER) % 3) + 1] AS name FROM edges"
_DEPS = """n AS (SELECT l_suppkey::VARCHAR AS package, 'dep' || (l_partkey % 40)::VARCHAR AS name, l_returnflag, l_quantity FROM lineitem),
declared AS (SELECT DISTINCT package, name FROM n WHERE l_returnflag = 'R'), used AS (SELECT DISTINCT package, name FROM n WHERE l_quantity > 25)"""
_REACH = f"""WITH RECURSIVE {EDGES_SQL}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"""
_RING = "ring AS (SELECT a.src AS node, least(a.src, min(a.dst)) AS ring FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"
SQL = {
    "import_edges": f"WITH {EDGES_SQL} SELECT * FROM edges",
    "unused_nodes": f"WITH {EDGES_SQL}, {MODULES_SQL} SELECT path FROM modules WHERE path <> 'm000001' AND path NOT IN (SELECT dst FROM edges)",
    "unused_exports": f"""WITH {EDGES_SQL}, {MODULES_SQL}, named AS ({_NAMED}), x AS (SELECT path, unnest(ARRAY['a', 'b', 'c']) AS name FROM modules)
SELECT path, name FROM x WHERE path NOT IN ('m000001', 'm000002') AND path NOT IN (SELECT dst FROM edges WHERE src LIKE '%7') AND NOT EXISTS (SELECT 1 FROM named n WHERE n.path = x.path AND n.name = x.name)""",
    "forbidden_layer": f"""SELECT a.n_name AS src, b.n_name AS dst, 'layer' || (a.{LAYER_OF})::VARCHAR AS layer, 'layer' || (b.{LAYER_OF})::VARCHAR AS target FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
WHERE (a.{LAYER_OF}, b.{LAYER_OF}) IN ((0, 1), (2, 3), (1, 2))""",
    "resolve_priority": "SELECT p_partkey AS importer, 'lib/p' || p_partkey AS target, 'lib/p' || p_partkey || CASE WHEN p_partkey % 8 = 0 THEN '.ts' WHEN p_partkey % 4 = 0 THEN '.js' WHEN p_partkey % 4 = 1 THEN '/index.ts' WHEN p_partkey % 4 = 2 THEN '.ts' END AS resolved FROM part",
    "unused_dependency": f"""WITH RECURSIVE {_DEPS}, peers(name, peer) AS (VALUES ('dep0', 'dep1'), ('dep1', 'dep2'), ('dep5', 'dep6'), ('dep6', 'dep5')),
u AS (SELECT package, name FROM used UNION SELECT u.package, p.peer FROM u JOIN peers p ON u.name = p.name)
SELECT package, name FROM declared d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.package = d.package AND u.name = d.name)""",
    "unlisted_dependency": f"WITH {_DEPS} SELECT package, name FROM used u WHERE name NOT IN ('dep5', 'dep10', 'dep0') AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.package = u.package AND d.name = u.name)",
    "reachable_closure": f"{_REACH} SELECT src, dst FROM reach",
    "cycle_components": f"{_REACH}, {_RING} SELECT node, ring FROM ring",
    "shortest_cycle": f"""{_REACH}, {_RING}, inner_edges AS (SELECT r.ring, e.src, e.dst FROM edges e JOIN ring r ON e.src = r.node JOIN ring q ON e.dst = q.node AND r.ring = q.ring),
walk AS (SELECT DISTINCT ring, ring AS node, 1 AS length FROM ring UNION SELECT w.ring, e.dst, w.length + 1 FROM walk w JOIN inner_edges e ON w.ring = e.ring AND w.node = e.src WHERE w.length <= 400)
SELECT ring, min(length)::INTEGER AS length, ring AS first, ring AS last FROM walk WHERE node = ring AND length > 1 GROUP BY ring""",
    "clone_components": f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT src AS u, dst AS v FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
r AS (SELECT u AS node, v AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u) SELECT node, least(node, min(reach)) AS component FROM r GROUP BY node""",
}
