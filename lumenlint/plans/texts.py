"""Queries over texts as files: lines, counts, secrets, markers, paths, repeated blocks, and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import RULES
from ..functions import paths as P
from ..functions.state import materialise
from ..operators import duplication as D
from ..operators import graph as G
from ..operators import text_rules as T
from ..sources import repository as R
from ..sources import texts as X
from .inputs import FILES_SQL, FINDINGS_SQL, KINDS_SQL, LINES_SQL, TEST_SQL, findings, table, text_files


def _words():
    return F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text")


def _windows(spark, sf):
    return D.windows(_docs(spark, sf), _words())


_WINDOWS = r"""t AS (SELECT doc_id AS file, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
wpos AS (SELECT file, w, unnest(range(0, len(w) - 59, 5)) AS start FROM t WHERE len(w) >= 60),
win AS (SELECT file, start::INTEGER AS start, md5(array_to_string(w[start + 1:start + 60], ' ')) AS hash FROM wpos),
pf AS (SELECT hash, file, min(start) AS start FROM win GROUP BY hash, file),
ff AS (SELECT hash, min(file) AS a, arg_min(start, file) AS a_start FROM pf GROUP BY hash HAVING count(*) > 1),
pairs AS (SELECT ff.a, pf.file AS b, ff.a_start, pf.start AS b_start FROM pf JOIN ff ON pf.hash = ff.hash WHERE pf.file <> ff.a),
m AS (SELECT DISTINCT a, b, a_start, b_start, b_start - a_start AS shift FROM pairs),
n AS (SELECT *, CASE WHEN a_start > coalesce(max(a_start + 60) OVER (PARTITION BY a, b, shift ORDER BY a_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM m),
k AS (SELECT *, sum(new) OVER (PARTITION BY a, b, shift ORDER BY a_start ROWS UNBOUNDED PRECEDING) AS island FROM n),
islands AS (SELECT a, b, min(a_start)::INTEGER AS a_start, (max(a_start) + 60)::INTEGER AS a_end, (min(a_start) + shift)::INTEGER AS b_start FROM k GROUP BY a, b, shift, island)"""


def _clusters(spark, sf):
    """Places are runs of overlapping blocks of a document; those that repeat each other are linked."""
    isles = materialise(D.islands(D.star_pairs(_windows(spark, sf))).withColumn("b_end", F.col("b_start") + F.col("a_end") - F.col("a_start")), "islands")
    block = lambda side: isles.select(F.col(side).alias("file"), F.col(f"{side}_start").alias("from"), F.col(f"{side}_end").alias("to"))
    place = materialise(D.places(block("a").unionByName(block("b"))), "places")
    for side, name in (("a", "u"), ("b", "v")):
        at = place.select(F.col("file").alias(side), F.col("from").alias(f"{side}_start"), F.col("to").alias(f"{side}_end"), F.format_string("%012d:%09d", F.col("file"), F.col("place").cast("long")).alias(name))
        isles = isles.join(at, [side, f"{side}_start", f"{side}_end"])
    isles = materialise(isles, "linked-islands")
    found = G.components(isles.select("u", "v"))
    size = found.groupBy("component").agg(F.count("*").alias("copies"))
    span = isles.join(found.select(F.col("node").alias("u"), "component"), "u").groupBy("component").agg(F.max(F.col("a_end") - F.col("a_start")).alias("span"))
    return size.join(span, "component").select("component", "copies", "span", D.span_severity(F.col("span")).alias("severity"), F.when(F.col("copies") > 2, "LOW").otherwise("MEDIUM").alias("confidence"))


def _shaped(spark, sf):
    """Texts of which some begin with a generator's note or a licence banner, and some are one line."""
    n = F.length("text")
    text = F.when(n % 3 == 0, F.translate("text", "\n", " ")).otherwise(F.col("text"))
    text = F.when(n % 5 == 0, F.concat(F.lit("// made by a tool\n// DO NOT EDIT\n"), text)).when(n % 7 == 0, F.concat(F.lit("/*! licence */\n"), text)).otherwise(text)
    files = text_files(spark, sf).withColumn("text", text)
    return files.select("file", R.generated_header(F.col("text")).alias("generated"), R.minified(F.col("text")).alias("minified"))


PATHS = [".env", "api/.env.sample", "src/a.ts.bak", "src/old.js~", "src/a.ts", "x.orig", "notes.tmp", "src/.env.local", "env", "deploy/.environment"]
DIFF = """diff --git a/src/a.ts b/src/a.ts
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,0 +2,3 @@
+one
@@ -9 +12 @@
-old
@@ -20,2 +22,0 @@
-gone
--- a/src/gone.ts
+++ /dev/null
@@ -1,4 +0,0 @@
--- /dev/null
+++ b/new/b.ts
@@ -0,0 +1,7 @@"""
PROSE = """# Title
import Chart from 'charts'
```js
import hidden from 'hidden'
```
  import "./side.css"
~~~
import other from "other"
~~~
import { a, b } from "@site/parts"
imported words from 'nothing'"""
LOCK = """lockfileVersion: '9.0'

packages:

  /left-part@1.3.0:
    resolution: {integrity: x}
    hasBin: true

  '@scope/tool@2.1.0(peer@1.0.0)':
    resolution: {integrity: y}
    peerDependencies:
      react-like: '>=1'
      base: '*'

snapshots:

  other@1.0.0: {}"""
MANIFESTS = [("package.json", '{"name": "root", "dependencies": {"alpha": "1", "@s/beta": "2"}, "devDependencies": {"gamma": "3"}}'), ("packages/a/package.json", '{"peerDependencies": {"alpha": "*"}}'), ("packages/b/package.json", "{broken"), ("src/other.json", '{"dependencies": {"no": "1"}}')]


def _lines_of(spark, text):
    return spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(text.split("\n"))], "file string, line int, text string")


def _values(columns: str, rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else "true" if v is True else "false" if v is False else str(v) if isinstance(v, int) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({columns})"


GLOBS = ["src/**/f1*.ts", "**/f?.ts", "lib/core/*"]
_GLOBS = "|".join(f"({P.glob_regex(g)})" for g in GLOBS)


def _owners(spark, sf):
    """Paths of pages' URLs and, as their roots, the URLs' first one or two parts."""
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/$", "").alias("path")).distinct()
    host = F.substring_index("path", "/", 1)
    roots = p.select(host.alias("root")).unionByName(p.filter("path LIKE '%/en/%'").select(F.concat(host, F.lit("/en")).alias("root"))).distinct().filter("length(root) % 2 = 0")
    return G.nearest_owner(p, roots)


def _directives(spark, sf):
    f = text_files(spark, sf).filter("file LIKE 'docs/%'")
    made = f.select("file", F.concat(F.lit("// lumen-ignore-"), F.when(F.length("text") % 2 == 0, "file").otherwise("next-line"), F.when(F.length("text") % 3 == 0, " sec001, TS002").otherwise("")).alias("text"))
    return T.directives(T.lines(made)).select("file", F.coalesce("at", F.lit(0)).alias("at"), F.array_join("rules", ",").alias("rules"))


QUERIES = {
    "files_union": lambda s, d: text_files(s, d).groupBy(F.substring_index("file", "/", 1).alias("root")).agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars")),
    "line_explode": lambda s, d: T.lines(text_files(s, d)).groupBy("file").agg(F.count("*").alias("lines"), F.max("line").alias("last"), F.max(F.length("text")).alias("longest")),
    "loc_metrics": lambda s, d: text_files(s, d).groupBy(F.substring_index("file", "/", 1).alias("root")).agg(F.sum(T.line_count(F.col("text"))).alias("loc"), F.sum(T.comment_lines(F.col("text"))).alias("comments")),
    "language_histogram": lambda s, d: text_files(s, d).groupBy(P.extension(F.col("file")).alias("extension")).agg(F.count("*").alias("files")),
    "secret_scan": lambda s, d: T.secrets(T.lines(text_files(s, d))),
    "secret_by_source": lambda s, d: T.secrets(T.lines(text_files(s, d))).groupBy(F.element_at(F.split("file", "/"), 2).alias("source"), "what").agg(F.count("*").alias("findings")).filter("source LIKE 'src%'"),
    "comment_markers": lambda s, d: T.markers(T.lines(text_files(s, d).withColumn("text", F.regexp_replace("text", "the ", "// TODO ")))).groupBy("file", "marker").agg(F.count("*").alias("findings")),
    "suppression_directives": _directives,
    "backup_and_env_files": lambda s, d: T.backup_and_env_files(s.createDataFrame([(p,) for p in PATHS], "path string")),
    "glob_filter": lambda s, d: findings(s, d).filter(P.matches_any(F.col("file"), GLOBS)).groupBy("file").agg(F.count("*").alias("findings")),
    "file_kind": lambda s, d: findings(s, d).select("file").distinct().select("file", P.kind_of(F.col("file")).alias("kind")),
    "test_file": lambda s, d: findings(s, d).select("file").distinct().filter(P.is_test(F.col("file"))),
    "generated_by_shape": _shaped,
    "dup_windows": lambda s, d: D.repeated(_windows(s, d), D.parts(_docs(s, d))).groupBy("copies").agg(F.count("*").alias("windows"), F.sum("places").alias("places")),
    "dup_pairs": lambda s, d: D.star_pairs(_windows(s, d)),
    "dup_islands": lambda s, d: D.islands(D.star_pairs(_windows(s, d))),
    "dup_clusters": _clusters,
    "data_windows": lambda s, d: D.data_windows(_docs(s, d), _words(), F.transform(_words(), lambda w: F.when(F.length(w) <= 2, 1).otherwise(0))),
    "nearest_owner_prefix": _owners,
    "diff_hunks": lambda s, d: X.diff_hunks(_lines_of(s, DIFF)),
    "fence_imports": lambda s, d: X.prose_imports(_lines_of(s, PROSE)).select("line", "target"),
    "lock_packages": lambda s, d: X.lock_packages(_lines_of(s, LOCK)).drop("file"),
    "manifest_dependencies": lambda s, d: X.manifest_dependencies(s.createDataFrame(MANIFESTS, "file string, text string")),
    "rule_catalog": lambda s, d: s.createDataFrame([(r, v[0], v[3]) for r, v in RULES.items()], "rule_id string, category string, scope string"),
}
_SECRETS = LINES_SQL + ", s AS (SELECT file, line, CASE " + " ".join("WHEN regexp_matches(text, '{0}') THEN struct_pack(what := '{1}', severity := '{2}', confidence := '{3}', evidence := substr(regexp_extract(text, '({0})', 1), 1, 4) || '***')".format(p.replace("'", "''"), w, sv, c) for w, p, sv, c in T.SECRETS) + " END AS f FROM lines)"
SQL = {
    "files_union": f"WITH {FILES_SQL} SELECT string_split(file, '/')[1] AS root, count(*) AS files, sum(length(text))::BIGINT AS chars FROM files GROUP BY 1",
    "line_explode": f"WITH {LINES_SQL} SELECT file, count(*) AS lines, max(line)::INTEGER AS last, max(length(text))::INTEGER AS longest FROM lines GROUP BY file",
    "loc_metrics": FILES_SQL.join(["WITH ", r""" SELECT string_split(file, '/')[1] AS root, sum(CASE WHEN regexp_matches(text, '\S') THEN len(regexp_split_to_array(text, '\r\n|\r|\n')) ELSE 0 END)::BIGINT AS loc,
sum(len(regexp_extract_all(text, '(?m)^[ \t]*(//|/\*|\*)')))::BIGINT AS comments FROM files GROUP BY 1"""]),
    "language_histogram": f"WITH {FILES_SQL} SELECT '.' || regexp_extract(file, '\\.([^.]+)$', 1) AS extension, count(*) AS files FROM files GROUP BY 1",
    "secret_scan": f"WITH {_SECRETS} SELECT file, line::INTEGER AS line, f.what AS what, f.severity AS severity, f.confidence AS confidence, f.evidence AS evidence FROM s WHERE f IS NOT NULL",
    "secret_by_source": f"WITH {_SECRETS} SELECT string_split(file, '/')[2] AS source, f.what AS what, count(*) AS findings FROM s WHERE f IS NOT NULL AND string_split(file, '/')[2] LIKE 'src%' GROUP BY ALL",
    "comment_markers": r"WITH " + LINES_SQL.replace("regexp_split_to_array(text,", "regexp_split_to_array(replace(text, 'the ', '// TODO '),") + r", m AS (SELECT file, unnest(regexp_extract_all(regexp_extract(text, '(//|#|/\*|<!--)(.*)$', 2), '\b(FIXME|HACK|TODO|XXX)\b')) AS marker FROM lines) SELECT file, marker, count(*) AS findings FROM m GROUP BY ALL",
    "suppression_directives": f"WITH {FILES_SQL} SELECT file, CASE WHEN length(text) % 2 = 0 THEN 0 ELSE 2 END AS at, CASE WHEN length(text) % 3 = 0 THEN 'SEC001,TS002' END AS rules FROM files WHERE file LIKE 'docs/%'",
    "backup_and_env_files": _values("path, rule_id", [(".env", "HYGIENE004"), ("src/a.ts.bak", "HYGIENE003"), ("src/old.js~", "HYGIENE003"), ("x.orig", "HYGIENE003"), ("notes.tmp", "HYGIENE003"), ("src/.env.local", "HYGIENE004")]),
    "glob_filter": f"WITH {FINDINGS_SQL} SELECT file, count(*) AS findings FROM findings WHERE regexp_matches(file, '{_GLOBS}') GROUP BY file",
    "file_kind": f"WITH {FINDINGS_SQL} SELECT DISTINCT file, {KINDS_SQL('file')} AS kind FROM findings",
    "test_file": f"WITH {FINDINGS_SQL} SELECT DISTINCT file FROM findings WHERE {TEST_SQL}",
    "generated_by_shape": f"""WITH {FILES_SQL}, m AS (SELECT file, length(text) AS n, CASE WHEN length(text) % 3 = 0 THEN replace(text, chr(10), ' ') ELSE text END AS t FROM files),
s AS (SELECT file, CASE WHEN n % 5 = 0 THEN '// made by a tool' || chr(10) || '// DO NOT EDIT' || chr(10) || t WHEN n % 7 = 0 THEN '/*! licence */' || chr(10) || t ELSE t END AS text, n % 5 = 0 AS noted, n % 5 <> 0 AND n % 7 = 0 AS banner FROM m)
SELECT file, noted AS generated, length(text) >= 2000 AND (length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 200 OR (banner AND length(text) / (length(text) - length(replace(text, chr(10), '')) + 1) > 120)) AS minified FROM s""",
    "dup_windows": f"WITH {_WINDOWS}, c AS (SELECT hash, count(DISTINCT file) AS copies, count(*) AS places FROM win GROUP BY hash) SELECT copies, count(*) AS windows, sum(places)::BIGINT AS places FROM c WHERE copies > 1 GROUP BY copies",
    "dup_pairs": f"WITH {_WINDOWS} SELECT * FROM pairs",
    "dup_islands": f"WITH {_WINDOWS} SELECT * FROM islands",
    "dup_clusters": f"""WITH RECURSIVE {_WINDOWS}, isl AS (SELECT *, b_start + a_end - a_start AS b_end FROM islands),
bl AS (SELECT a AS file, a_start AS s, a_end AS t FROM isl UNION SELECT b, b_start, b_end FROM isl),
rn AS (SELECT *, max(t) OVER (PARTITION BY file ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bl),
gr AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM rn),
pl AS (SELECT *, lpad(file::VARCHAR, 12, '0') || ':' || lpad((min(s) OVER (PARTITION BY file, g))::VARCHAR, 9, '0') AS node FROM gr),
li AS (SELECT p.node AS u, q.node AS v, a_end - a_start AS span FROM isl JOIN pl p ON a = p.file AND a_start = p.s AND a_end = p.t JOIN pl q ON b = q.file AND b_start = q.s AND b_end = q.t),
e AS (SELECT u, v FROM li UNION SELECT v, u FROM li),
r AS (SELECT DISTINCT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
z AS (SELECT component, count(*) AS copies FROM c GROUP BY 1), s AS (SELECT component, max(span)::INTEGER AS span FROM li JOIN c ON u = node GROUP BY 1)
SELECT component, copies, span, CASE WHEN span >= 240 THEN 'HIGH' WHEN span >= 120 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN copies > 2 THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM z JOIN s USING (component)""",
    "data_windows": f"WITH {_WINDOWS}, l AS (SELECT file, start::INTEGER AS start, len(list_filter(w[start + 1:start + 60], lambda x: length(x) <= 2))::INTEGER AS literals FROM wpos) SELECT * FROM l WHERE literals >= 18",
    "nearest_owner_prefix": r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path FROM pages),
h AS (SELECT path, string_split(path, '/')[1] AS host FROM p), r AS (SELECT DISTINCT root FROM (SELECT host AS root FROM h UNION ALL SELECT host || '/en' FROM h WHERE path LIKE '%/en/%') WHERE length(root) % 2 = 0)
SELECT p.path, arg_max(root, length(root)) AS root FROM p LEFT JOIN r ON starts_with(p.path, r.root || '/') GROUP BY p.path""",
    "diff_hunks": _values("path, start, last", [("src/a.ts", 2, 4), ("src/a.ts", 12, 12), ("new/b.ts", 1, 7)]),
    "fence_imports": _values("line, target", [(2, "charts"), (6, "./side.css"), (10, "@site/parts")]),
    "lock_packages": _values("package, has_bin, peers", [("left-part", True, ""), ("@scope/tool", False, "base,react-like")]),
    "manifest_dependencies": _values("file, package, section", [("package.json", "alpha", "dependencies"), ("package.json", "@s/beta", "dependencies"), ("package.json", "gamma", "devDependencies"), ("packages/a/package.json", "alpha", "peerDependencies")]),
    "rule_catalog": _values("rule_id, category, scope", [(r, v[0], v[3]) for r, v in RULES.items()]),
}
