"""A whole scan: files in, findings, measures and scores out. All parts are DataFrames; only loc and a few counts reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import RULES, look_up
from ..functions.paths import is_test, kind_of
from ..functions.state import materialise
from ..operators import code as C
from ..operators import duplication as D
from ..operators import findings as FD
from ..operators import flows as FL
from ..operators import graph as G
from ..operators import scoring as S
from ..operators import text_rules as T
from ..sources import reports as RS
from ..sources import repository as R
from ..sources import texts as X

#: Modules that come with the runtime.
BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib bun".split()
_ENTRY = r"(^|/)(index|main)\.[cm]?[jt]sx?$"
_TOOL = r"(^|/)[^/]*\.(config|setup)\.[cm]?[jt]sx?$|(^|/)\.[^/]+rc\.[cm]?js$"


@dataclass
class Scan:
    findings: DataFrame
    functions: DataFrame
    edges: DataFrame
    failed: DataFrame
    files: DataFrame
    costs: DataFrame
    scores: DataFrame
    overall: DataFrame
    measures: DataFrame


def finding(df: DataFrame, rule: str, evidence: Column, severity: Column | None = None, confidence: Column | None = None, line: Column | None = None, col: Column | None = None) -> DataFrame:
    """df (with `file`) in the columns of findings; what isn't given is the catalog's, on line 1."""
    c = RULES[rule]
    given = lambda x, default: F.lit(default) if x is None else x
    return df.select(F.lit(rule).alias("rule_id"), F.lit(c[0]).alias("category"), given(severity, c[1]).alias("severity"), given(confidence, c[2]).alias("confidence"), "file", given(line, 1).cast("int").alias("line"), given(col, 1).cast("int").alias("col"), evidence.alias("evidence"))


def resolved_edges(read: DataFrame, files: DataFrame, everything: DataFrame) -> DataFrame:
    """src, dst, kind, names, type_only, line of imports between files, by relative paths and by aliases of the compiler."""
    every = C.relation(read, "edges")
    aliases = RS.path_aliases(everything)
    edges = every.filter("path IS NOT NULL").unionByName(RS.resolve_aliases(every.filter("path IS NULL"), aliases).filter("path IS NOT NULL"))
    # A compiled name (./a.js) stands for its source (a.ts) where only that exists.
    plain = G.resolve(edges.select("file", F.col("path").alias("target"), "kind", "names", "type_only", "line"), files.select(F.col("file").alias("path")))
    bare = plain.filter("resolved IS NULL").drop("resolved").withColumn("target", F.regexp_replace("target", r"\.[cm]?jsx?$", ""))
    both = plain.filter("resolved IS NOT NULL").unionByName(G.resolve(bare, files.select(F.col("file").alias("path"))).filter("resolved IS NOT NULL"))
    return both.select(F.col("file").alias("src"), F.col("resolved").alias("dst"), "kind", "names", "type_only", "line")


def entries(files: DataFrame, everything: DataFrame) -> DataFrame:
    """path of files that something outside of the module graph uses: manifests, scripts, configurations, tests, conventions."""
    paths = files.select(F.col("file").alias("path"))
    by_name = paths.filter(is_test(F.col("path")) | F.col("path").rlike(_TOOL) | F.col("path").rlike(_ENTRY))
    texts = everything.filter(F.col("file").rlike(r"(?i)\.(json|ya?ml|toml|mdx?|html)$|dockerfile|makefile|(^|/)Procfile") & ~F.col("file").rlike(r"(?i)(^|/)docs?/"))
    named = texts.select(F.regexp_replace("file", r"[^/]*$", "").alias("dir"), F.explode(F.regexp_extract_all("text", F.lit(r"(\.{0,2}/?[\w@.-]+(?:/[\w@.-]+)*\.[cm]?[jt]sx?)\b"), 1)).alias("target")).distinct()
    found = named.select(F.explode(F.array(F.concat("dir", F.regexp_replace("target", r"^(\.?/)+", "")), F.regexp_replace("target", r"^(\.?/)+", ""))).alias("named"))
    # Build output (dist/a.js) stands for its source (src/a.ts).
    as_source = F.regexp_replace(F.regexp_replace("named", r"(^|/)(build|dist|lib|out)/", "$1src/"), r"\.[cm]?jsx?$", "")
    stems = found.select("named").unionByName(found.select(as_source.alias("named"))).select(F.regexp_replace("named", r"\.[cm]?[jt]sx?$", "").alias("stem")).distinct()
    return by_name.unionByName(paths.withColumn("stem", F.regexp_replace("path", r"\.[cm]?[jt]sx?$", "")).join(stems, "stem", "left_semi").select("path")).distinct()


def graph_findings(read: DataFrame, files: DataFrame, everything: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """DEAD009, DEAD010 and DEP003."""
    start = materialise(entries(files, everything), "entries")
    links = edges.select("src", "dst").distinct()
    alone = G.unused_files(files.select(F.col("file").alias("path")).filter(kind_of(F.col("path")) == "production"), links, start)
    exports = C.relation(read, "exports").select(F.col("file").alias("path"), "name", "line")
    names = edges.select(F.col("dst").alias("path"), F.explode(F.split("names", ",")).alias("name"))
    whole = names.filter("name = '*'").select("path").distinct()
    left = G.unused_exports(exports, names, whole, start).join(alone, "path", "left_anti")
    run = edges.filter("NOT type_only").select("src", "dst").distinct()
    rings = G.shortest_rings(run, G.rings(run))
    lines = edges.filter("NOT type_only").groupBy("src", "dst").agg(F.min("line").alias("line"))
    hops = rings.select("ring", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", 2, 100_000).alias("b"))).alias("at", "hop"))
    chain = hops.join(lines, (F.col("hop.a") == F.col("src")) & (F.col("hop.b") == F.col("dst"))).groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("at", F.concat_ws(":", "src", F.col("line").cast("string")).alias("text"), "line"))).alias("hops"))
    chain = chain.select(F.col("ring").alias("file"), F.concat_ws(" → ", F.transform("hops", lambda h: h["text"]), F.array("ring")).alias("evidence"), F.element_at("hops", 1)["line"].alias("line"))
    return [
        finding(alone.withColumnRenamed("path", "file"), "DEAD010", F.col("file")),
        finding(left.withColumnRenamed("path", "file"), "DEAD009", F.col("name"), line=F.col("line")),
        finding(chain, "DEP003", F.col("evidence"), line=F.col("line")),
    ]


def dependency_findings(read: DataFrame, everything: DataFrame) -> list[DataFrame]:
    """DEP001 and DEP002. Uses are imports, and mentions in scripts, configurations, style sheets and command files."""
    declared = X.manifest_dependencies(everything).withColumn("package", F.col("package"))
    root = F.regexp_replace("file", r"/?package\.json$", "")
    declared = materialise(declared.select(root.alias("root"), F.col("package").alias("name"), "section").distinct(), "declared")
    imports = C.relation(read, "edges").filter(X.is_bare(F.col("target"))).select("file", X.package_name(F.col("target")).alias("name"), "line")
    owners = G.nearest_owner(imports.select(F.col("file").alias("path")).distinct(), declared.select("root").unionByName(everything.filter(F.col("file").rlike(r"(^|/)package\.json$")).select(root.alias("root"))).distinct())
    aliased = RS.resolve_aliases(C.relation(read, "edges").select("file", "target"), RS.path_aliases(everything)).filter("path IS NOT NULL").select(X.package_name(F.col("target")).alias("name"))
    named = RS.bundler_aliases(everything).select(X.package_name(F.regexp_replace("alias", r"[\^$]|/?\*$|/$", "")).alias("name"))
    imports = imports.join(aliased.unionByName(named).distinct(), "name", "left_anti")
    used = materialise(imports.join(owners, imports["file"] == owners["path"]).select("file", F.coalesce("root", F.lit("")).alias("root"), "name", "line"), "used")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(@[\w.-]+/[\w.-]+|[\w][\w.-]*)"), 1))
    mentions = everything.filter(F.col("file").rlike(r"(?i)(\.config\.[cm]?[jt]s|rc(\.json|\.[cm]?js|\.ya?ml)?|tsconfig[^/]*\.json|\.(ya?ml|css|scss|less|sass)|dockerfile|makefile)$") & ~F.col("file").rlike(r"lock")).select(F.explode(words).alias("name"))
    scripts = everything.filter(F.col("file").rlike(r"(^|/)package\.json$")).select(F.explode(F.map_values(F.from_json(F.try_variant_get(F.try_parse_json("text"), "$.scripts", "string"), "map<string,string>"))).alias("text")).select(F.explode(words).alias("name"))
    seen = mentions.unionByName(scripts).distinct()
    known = used.select("root", "name").distinct()
    unused = declared.filter("section IN ('dependencies', 'devDependencies') AND name NOT LIKE '@types/%'").select("root", "name").distinct().join(known, ["root", "name"], "left_anti").join(seen, "name", "left_anti")
    typed = used.select("name").distinct()
    unused = unused.join(typed.join(declared.filter("root = ''").select("name"), "name", "left_semi"), "name", "left_anti")
    base = everything.sparkSession.createDataFrame([(b,) for b in BUILTINS], "name string")
    missing = G.unlisted_dependencies(used.select(F.col("root").alias("package"), "name"), declared.select(F.col("root").alias("package"), "name"), base)
    first = used.groupBy(F.col("root").alias("package"), "name").agg(F.min(F.struct("file", "line")).alias("at"))
    missing = missing.filter("name NOT LIKE '%:%'").join(first, ["package", "name"]).select(F.col("at.file").alias("file"), F.col("at.line").alias("line"), "name")
    manifest = F.when(F.col("root") == "", F.lit("package.json")).otherwise(F.concat("root", F.lit("/package.json")))
    return [finding(unused.withColumn("file", manifest), "DEP001", F.col("name"), confidence=F.lit("HIGH")), finding(missing, "DEP002", F.col("name"), line=F.col("line"))]


def layer_findings(edges: DataFrame, layers: dict[str, dict]) -> DataFrame:
    """ARCH001. layers: name -> match (globs), cannotImport (names)."""
    from ..functions.paths import matches_any

    spark = edges.sparkSession
    paths = edges.select(F.col("src").alias("path")).unionByName(edges.select(F.col("dst").alias("path"))).distinct()
    which = F
    for name, layer in layers.items():
        which = which.when(matches_any(F.col("path"), layer.get("match", [])), name)
    placed = paths.select("path", which.alias("layer"), F.lit(0).alias("ordinal")).filter("layer IS NOT NULL")
    forbidden = spark.createDataFrame([(n, t) for n, layer in layers.items() for t in layer.get("cannotImport", [])], "layer string, target string")
    bad = G.forbidden_imports(edges.select("src", "dst").distinct(), placed, forbidden).join(edges.groupBy("src", "dst").agg(F.min("line").alias("line")), ["src", "dst"])
    return finding(bad.withColumnRenamed("src", "file"), "ARCH001", F.concat_ws(" → ", "layer", "target"), line=F.col("line"))


def duplicate_findings(files: DataFrame) -> DataFrame:
    """DUP001, one per cluster of places, at its first. Windows, pairs, islands and clusters are joins; nothing is gathered.

    A place is a run of blocks of one file whose lines overlap; places are linked by the blocks that repeat each other.
    """
    windows = materialise(C.code_windows(files), "windows")
    isles = D.islands(D.star_pairs(windows.select("file", "start", "hash")))
    isles = isles.withColumn("a_last", F.col("a_end") - D.WIDTH).withColumn("b_last", F.col("b_start") + F.col("a_last") - F.col("a_start"))
    lines = windows.groupBy("file", "start").agg(F.min("line").alias("line"), F.max("last").alias("last"))
    for side in "ab":
        for start, value, name in (("start", "line", "from"), ("last", "last", "to")):
            at = lines.select(F.col("file").alias(side), F.col("start").alias(f"{side}_{start}"), F.col(value).alias(f"{side}_{name}"))
            isles = isles.join(at, [side, f"{side}_{start}"])
    isles = materialise(isles, "islands")
    block = lambda side: isles.select(F.col(side).alias("file"), F.col(f"{side}_from").alias("from"), F.col(f"{side}_to").alias("to"))
    place = materialise(D.places(block("a").unionByName(block("b"))), "places")
    node = F.concat_ws("\n", "file", F.lpad(F.col("place").cast("string"), 10, "0"))
    for side, name in (("a", "u"), ("b", "v")):
        isles = isles.join(place.select(F.col("file").alias(side), F.col("from").alias(f"{side}_from"), F.col("to").alias(f"{side}_to"), F.col("place").alias(f"{side}_place"), node.alias(name)), [side, f"{side}_from", f"{side}_to"])
    linked = G.components(isles.select("u", "v"))
    size = linked.groupBy("component").agg(F.count("*").alias("copies"))
    first = isles.join(linked.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.min(F.struct(F.col("a").alias("file"), F.col("a_place").alias("line"))).alias("at"), F.max(F.col("a_end") - F.col("a_start")).alias("span"))
    out = first.join(size, "component").select("at.file", "at.line", "span", "copies")
    return finding(out, "DUP001", F.format_string("%d tokens in %d places", F.col("span"), F.col("copies")), D.span_severity(F.col("span")), F.when(F.col("copies") > 2, "LOW").otherwise("MEDIUM"), F.col("line"))


def line_findings(texts: DataFrame, everything: DataFrame) -> list[DataFrame]:
    """SEC001, TS002, HYGIENE003 and HYGIENE004."""
    rows = T.lines(texts)
    secret = T.secrets(rows)
    quiet = F.when(is_test(F.col("file")) | kind_of(F.col("file")).isin("fixture", "example"), "INFO").otherwise(F.col("severity"))
    named = T.backup_and_env_files(everything.select(F.col("file").alias("path"))).withColumnRenamed("path", "file")
    unchecked = T.unchecked_types(rows)
    return [
        finding(secret, "SEC001", F.concat_ws(": ", "what", "evidence"), quiet, F.col("confidence"), F.col("line")),
        finding(unchecked, "TS002", F.lit("type checking switched off"), F.col("severity"), F.col("confidence"), F.col("line")),
        finding(named.filter("rule_id = 'HYGIENE003'"), "HYGIENE003", F.col("file")),
        finding(named.filter("rule_id = 'HYGIENE004'"), "HYGIENE004", F.col("file")),
    ]


def security_findings(read: DataFrame, files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns and data flows in one: a clean flow takes a pattern back, a flow at the same place raises its confidence."""
    rows = materialise(C.relation(read, "flows"), "flows")
    flow = FL.flow_findings(rows, files)
    p = patterns.filter("category = 'security'")
    merged = FD.merge_flows(p.groupBy(*FD.PLACE).agg(F.max_by("confidence", FD.confidence_rank(F.col("confidence"))).alias("confidence")), flow, FL.cleared(rows))
    detail = p.select(*FD.PLACE, "severity", "col", "evidence").unionByName(flow.select(*FD.PLACE, look_up(F.col("rule_id"), {r: v[1] for r, v in RULES.items()}).alias("severity"), "col", "evidence"))
    detail = detail.groupBy(*FD.PLACE).agg(F.min(F.struct("col", "evidence", "severity")).alias("d"))
    both = merged.join(detail, FD.PLACE)
    return both.select("rule_id", F.lit("security").alias("category"), "d.severity", "confidence", "file", "line", "d.col", "d.evidence")


def scan(files: DataFrame, config: dict | None = None, installed: bool = False, external: DataFrame | None = None) -> Scan:
    """files: file, size, text of one repository. config as sources.repository.load_config returns it.

    installed: whether its dependencies are there to be read; if they aren't, findings that need their types are a guess.
    external: another tool's findings. Only code that ships, and the scripts around it, make the score, by its lines.
    """
    config = config or R.DEFAULTS
    roled = materialise(R.roles(files, config["scan"]["include"], config["scan"]["exclude"]), "roles")
    everything = roled.filter("role IN ('source', 'text')")
    source = roled.filter("role = 'source'")
    rules = config.get("rules", {})
    read = C.code_facts(source, {r: v["max"] for r, v in rules.items() if isinstance(v, dict) and isinstance(v.get("max"), int)})
    edges = materialise(resolved_edges(read, source, everything), "edges")
    styles = C.relation(read, "declared").agg(F.coalesce(F.sum("old"), F.lit(0)).alias("old"), F.coalesce(F.sum(F.col("old") + F.col("new")), F.lit(0)).alias("all")).first()
    degraded = FD.types_degraded(installed, not X.manifest_dependencies(everything).isEmpty(), 0, 0)
    patterns = materialise(FD.downgrade_types(C.without_legacy(C.findings(read), styles["all"], styles["old"]), degraded), "patterns")
    layers = config.get("architecture", {}).get("layers", {})
    parts = [
        patterns.filter("category <> 'security'"), security_findings(read, source, patterns), duplicate_findings(source),
        *graph_findings(read, source, everything, edges), *dependency_findings(read, everything), *line_findings(everything, files), *([layer_findings(edges, layers)] if layers else []),
    ]
    off = [r for r, v in rules.items() if isinstance(v, dict) and v.get("enabled") is False]
    found = FD.union_all(parts).filter(~F.col("rule_id").isin(off) if off else F.lit(True))
    severity = {r: v["severity"].upper() for r, v in rules.items() if isinstance(v, dict) and "severity" in v}
    found = found.withColumn("severity", F.coalesce(look_up(F.col("rule_id"), severity), F.col("severity"))) if severity else found
    found = found if external is None else FD.merge_external(found, external)
    found = FD.suppress(found, T.directives(T.lines(source)))
    found = FD.in_scope(found)
    found = found if config["scan"].get("includeNonProduction") else found.filter("NOT hidden")
    found = materialise(FD.number_repeats(FD.fingerprint(found.drop("hidden", "kind"))), "findings")
    scored = kind_of(F.col("file")).isin("production", "script")
    counted = source.select(T.line_count(F.col("text")).alias("n"), T.comment_lines(F.col("text")).alias("c"), is_test(F.col("file")).alias("test"), scored.alias("scored"))
    lines = lambda of, name: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(name)
    measures = counted.agg(F.count("*").alias("files"), lines(F.lit(True), "loc"), lines(F.col("test"), "test_loc"), lines(F.col("scored"), "scored_loc"), F.coalesce(F.sum("c"), F.lit(0)).alias("comments"))
    measures = materialise(measures.withColumn("test_ratio", F.when(F.col("loc") > F.col("test_loc"), F.col("test_loc") / (F.col("loc") - F.col("test_loc"))).otherwise(0.0)), "measures")
    costs = S.rule_costs(found.filter(scored), float(measures.first()["scored_loc"]))
    scores = S.category_scores(costs, bool(layers))
    return Scan(found, C.relation(read, "functions"), edges, C.relation(read, "failed"), roled.select("file", "role"), costs, scores, S.overall(found.filter(scored), scores), measures)


def function_measures(functions: DataFrame) -> DataFrame:
    """One row: functions, mean_lines, and how many are of low (up to 10), medium (up to 25) and high complexity.

    A row counts as often as files says, where functions has that column.
    """
    c, n = F.col("cyclomatic"), F.col("files") if "files" in functions.columns else F.lit(1).cast("long")
    count = lambda of: F.coalesce(F.sum(F.when(of, n)), F.lit(0).cast("long"))
    mean = F.coalesce(F.round(F.sum(F.col("lines") * n) / F.sum(n), 6), F.lit(0.0))
    return functions.agg(count(F.lit(True)).alias("functions"), mean.alias("mean_lines"), count(c <= 10).alias("low"), count((c > 10) & (c <= 25)).alias("medium"), count(c > 25).alias("high"))
