"""Modules as a graph: resolution, ownership, unused parts, layers, rings, closures and components.

Iterations write each round as a table in the shared folder. None collects nodes or edges to the driver; only counts are.
Rings, shortest rings and components of a graph of at most SMALL edges, which are counted, are found in one task by the
textbook algorithm: a round of joins costs more than all of them there. Larger graphs take the joins; results are the same.
The closure of a graph of at most WALKED edges is walked from each node, with the nodes dealt over all tasks.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import materialise
from .components import connected, ring_paths, strongly_connected

SMALL = 100_000  # edges; some tens of MB in one task
WALKED = 2_000_000  # edges; some tens of MB in each task

SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def ancestors(path: Column) -> Column:
    """A path's directories, from the root ('') down to its own."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))


def nearest_owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the deepest root above each path (null without any). An equi join over a path's few ancestors, no prefix join."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    found = up.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").join(found, "path", "left")


def resolve(imports: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """imports (importer, target) with `resolved`: the first existing file among target + suffix, or null."""
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("s")) for i, s in enumerate(suffixes)])
    wanted = imports.select("target").distinct().select("target", F.explode(tries).alias("t")).select("target", "t.rank", F.concat("target", "t.s").alias("path"))
    found = wanted.join(files.select("path"), "path").groupBy("target").agg(F.min_by("path", "rank").alias("resolved"))
    return imports.join(found, "target", "left")


def unused_files(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that no edge leads to and that are no entry. Only direct references count as uses."""
    used = edges.select(F.col("dst").alias("path")).unionByName(entries.select("path")).distinct()
    return files.join(used, "path", "left_anti")


def unused_exports(exports: DataFrame, named: DataFrame, whole: DataFrame, entries: DataFrame) -> DataFrame:
    """exports (path, name) nobody names, in files that nobody imports as a whole and that are no entries."""
    left = exports.join(named.select("path", "name").distinct(), ["path", "name"], "left_anti")
    return left.join(whole.select("path").unionByName(entries.select("path")).distinct(), "path", "left_anti")


def forbidden_imports(edges: DataFrame, layers: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges between layers that are kept apart. layers: path, layer, ordinal (the first layer of a path counts); forbidden: layer, target."""
    first = layers.groupBy("path").agg(F.min_by("layer", "ordinal").alias("layer"))
    both = edges.join(first.select(F.col("path").alias("src"), F.col("layer")), "src").join(first.select(F.col("path").alias("dst"), F.col("layer").alias("target")), "dst")
    return both.join(forbidden, ["layer", "target"], "left_semi").select("src", "dst", "layer", "target")


def unused_dependencies(declared: DataFrame, used: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """declared (package, name) minus used (package, name), where whatever a used one needs as a peer is used as well."""
    if peers is not None:
        used = peer_closure(used, peers)
    return declared.join(used.select("package", "name").distinct(), ["package", "name"], "left_anti")


def peer_closure(used: DataFrame, peers: DataFrame, max_rounds: int = 50) -> DataFrame:
    """used with all peers (name, peer) of what is used, and theirs."""
    used = materialise(used.select("package", "name").distinct(), "used")
    new = used
    for _ in range(max_rounds):
        new = materialise(new.join(peers, "name").select("package", F.col("peer").alias("name")).distinct().join(used, ["package", "name"], "left_anti"), "new-peers")
        if new.isEmpty():
            return used
        used = materialise(used.unionByName(new), "used")
    raise RuntimeError("peers did not settle")


def unlisted_dependencies(imported: DataFrame, declared: DataFrame, builtins: DataFrame) -> DataFrame:
    """imported (package, name), once each, that is neither declared there or at the root ('') nor built in."""
    own = imported.select("package", "name").distinct()
    left = own.join(declared.select("package", "name").distinct(), ["package", "name"], "left_anti")
    return left.join(declared.filter("package = ''").select("name").unionByName(builtins.select("name")).distinct(), "name", "left_anti")


def _in_one_task(df: DataFrame, found: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Runs on a table whose size has been checked."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            yield pd.DataFrame(found(pd.concat(parts, ignore_index=True)), columns=names)

    return df.coalesce(1).mapInPandas(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the nodes as an Arrow stream; where the targets of each begin; the targets. Null leads nowhere, as in a join."""
    edges = list(batches)
    if not edges:
        return
    edges = pa.Table.from_batches(edges)
    ends = pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks]).combine_chunks().dictionary_encode()
    nodes, n = ends.dictionary, len(ends.dictionary)
    src, dst = (ends.indices.slice(at, len(edges)).fill_null(null).to_numpy(zero_copy_only=False) for at, null in ((0, n), (len(edges), n + 1)))
    order = np.lexsort((dst, src))
    starts = np.searchsorted(src[order], np.arange(n + 3)).astype(np.int32)
    out = pa.BufferOutputStream()
    named = pa.record_batch([pa.concat_arrays([nodes, pa.nulls(2, nodes.type)])], names=["node"])
    with pa.ipc.new_stream(out, named.schema) as writer:
        writer.write_batch(named)
    yield pa.RecordBatch.from_pydict({"nodes": [out.getvalue().to_pybytes()], "starts": [starts.tobytes()], "targets": [dst[order].astype(np.int32).tobytes()]})


def _walks(parts: int, size: int = 1 << 16):
    """All pairs of a part's sources. Sources with the same targets are neighbours, so that one walk serves them all."""

    def walked(nodes: pa.Array, starts: np.ndarray, targets: np.ndarray, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sources = np.flatnonzero(np.diff(starts))
        sources = sources[np.argsort(targets[starts[sources]], kind="stable")]
        begin, to, seen, last = array("i", starts.tobytes()), array("i", targets.tobytes()), bytearray(len(nodes)), None
        for source in np.array_split(sources, parts)[part].tolist():
            if (now := to[begin[source] : begin[source + 1]]) != last:
                last, reached = now, now.tolist()
                for node in reached:
                    seen[node] = 1
                for node in reached:  # it grows
                    for other in to[begin[node] : begin[node + 1]]:
                        if not seen[other]:
                            seen[other] = 1
                            reached.append(other)
                for node in reached:
                    seen[node] = 0
                found = np.array(reached, np.int32)
            for at in range(0, len(found), size):
                some = found[at : at + size]
                yield np.full(len(some), source, np.int32), some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = pa.ipc.open_stream(row["nodes"]).read_all()["node"].combine_chunks()
                named = lambda of, nodes=nodes: nodes.take(pa.array(np.concatenate(of)))
                held, pairs = [], 0
                for pair in walked(nodes, np.frombuffer(row["starts"], np.int32), np.frombuffer(row["targets"], np.int32), row["part"]):
                    held.append(pair)
                    pairs += len(pair[1])
                    if pairs >= size:
                        yield pa.record_batch([named([p[0] for p in held]), named([p[1] for p in held])], names=["src", "dst"])
                        held, pairs = [], 0
                if held:
                    yield pa.record_batch([named([p[0] for p in held]), named([p[1] for p in held])], names=["src", "dst"])

    return run


def closure(edges: DataFrame, max_rounds: int = 1000, walked: int = WALKED) -> DataFrame:
    """src, dst of all pairs with a path (of one edge or more). For graphs whose pairs are few enough to be a table.

    Up to `walked` edges, which are counted, every task reads the whole graph and walks from its share of the nodes: the
    work is that of the result, nothing shuffles, and a task holds the graph and one node's walk. Larger graphs take joins.
    Steps of up to eight edges come first, by doubling. Then only pairs that are new in a round are taken on by a step:
    the work is that of the result times a step's width, and the rounds are an eighth of the longest shortest path.
    """
    compose = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    step = materialise(edges.select("src", "dst").distinct(), "steps")
    if step.count() <= walked:
        spark = edges.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        graph = materialise(step.coalesce(1).mapInArrow(_packed, "nodes binary, starts binary, targets binary"), "graph")
        each = spark.range(0, parts, 1, parts).select(F.col("id").cast("int").alias("part")).crossJoin(graph.hint("shuffle_replicate_nl"))
        return each.mapInArrow(_walks(parts), ", ".join(f"{c} {kind}" for c, kind in step.dtypes))
    for _ in range(3):
        step = materialise(step.unionByName(compose(step, step)).distinct(), "steps")
    known = new = step
    for _ in range(max_rounds):
        new = compose(new, step).distinct().alias("n").join(known.alias("k"), F.col("n.src").eqNullSafe(F.col("k.src")) & F.col("n.dst").eqNullSafe(F.col("k.dst")), "left_anti")
        new = materialise(new, "closure")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise RuntimeError("the closure did not settle")


def _spread(label: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """The smallest label that reaches each node. label: node, c; edges: src, dst."""
    for _ in range(max_rounds):
        got = edges.join(label.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("g"))
        label = materialise(label.join(got, "node", "left").select("node", F.least("c", F.coalesce("g", "c")).alias("c"), (F.col("g") < F.col("c")).alias("moved")), "labels")
        if label.filter("moved").isEmpty():
            return label.select("node", "c")
        label = label.select("node", "c")
    raise RuntimeError("labels did not settle")


def rings(edges: DataFrame, max_rounds: int = 200, small: int = SMALL) -> DataFrame:
    """node, ring: the strongly connected components of more than one node, or of one that imports itself; ring is the smallest node.

    Colouring: each node takes the smallest node that reaches it; what reaches that node back within its colour is its
    component. Found ones leave, with all that can't be in a ring, and the rest goes on.
    """
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    if edges.count() <= small:
        return _in_one_task(edges, lambda e: strongly_connected(e["src"].tolist(), e["dst"].tolist()), "node string, ring string")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("ring"))
    found = None
    for _ in range(max_rounds):
        for _ in range(max_rounds):  # nodes without an edge in or out are in no ring
            kept = materialise(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "edges")
            done = kept.count() == edges.count()
            edges = kept
            if done:
                break
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = _spread(materialise(nodes.withColumn("c", F.col("node")), "labels"), edges, max_rounds)
        a, b = colour.select(F.col("node").alias("src"), F.col("c").alias("a")), colour.select(F.col("node").alias("dst"), F.col("c").alias("b"))
        inside = materialise(edges.join(a, "src").join(b, "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a"), "inside")
        # Backwards from each colour's root, within its colour: 0 marks what reaches the root.
        back = _spread(materialise(colour.select("node", F.when(F.col("node") == F.col("c"), 0).otherwise(1).alias("c")), "labels"), inside.select("src", "dst"), max_rounds)
        ring = materialise(back.filter("c = 0").select("node").join(colour, "node").select("node", F.col("c").alias("ring")), "rings")
        found = ring if found is None else found.unionByName(ring)
        gone = ring.select("node")
        edges = materialise(edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges")
    if found is None:
        return loops
    large = found.groupBy("ring").agg(F.count("*").alias("n")).filter("n > 1").select("ring")
    found = materialise(found.join(large, "ring", "left_semi").select("node", "ring"), "rings")
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def shortest_rings(edges: DataFrame, ring: DataFrame, max_rounds: int = 1000, small: int = SMALL) -> DataFrame:
    """ring, path (nodes from the ring's smallest back to it): a shortest one, the first in order among these."""
    own = ring.select(F.col("node").alias("src"), "ring")
    inner = materialise(edges.select("src", "dst").distinct().join(own, "src").join(ring.select(F.col("node").alias("dst"), F.col("ring").alias("r2")), "dst").filter("ring = r2").select("ring", "src", "dst"), "inner")
    if inner.count() <= small:
        return _in_one_task(inner, lambda e: ring_paths(e["ring"].tolist(), e["src"].tolist(), e["dst"].tolist()), "ring string, path array<string>")
    walks = ring.select("ring").distinct().select("ring", F.col("ring").alias("at"), F.array("ring").alias("path"))
    seen, out = walks.select("ring", "at"), None
    for _ in range(max_rounds):
        step = walks.join(inner, (walks["ring"] == inner["ring"]) & (walks["at"] == inner["src"])).select(walks["ring"], F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        step = materialise(step.groupBy("ring", "at").agg(F.min("path").alias("path")), "walks")
        closed = step.filter("at = ring").select("ring", "path")
        out = closed if out is None else out.unionByName(closed)
        out = materialise(out, "closed")
        walks = materialise(step.join(seen, ["ring", "at"], "left_anti").join(out.select("ring"), "ring", "left_anti"), "walks")
        if walks.isEmpty():
            return out
        seen = materialise(seen.unionByName(walks.select("ring", "at")), "seen")
    raise RuntimeError("rings did not close")


def components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """node, component (its smallest reachable node), of nodes with an undirected edge (u, v): large-star and small-star rounds."""
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    if edges.count() <= small:
        kind = dict(edges.dtypes)["u"]
        return _in_one_task(edges, lambda e: connected(e["u"].tolist(), e["v"].tolist()), f"node {kind}, component {kind}")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = materialise(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        edges = materialise(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
    raise RuntimeError("components did not settle")
