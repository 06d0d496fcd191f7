"""Graph operators over edge tables: reachability, cycles, paths, coupling, coverage.

Iterations keep a frontier and a visited table, both written to the working folder
each round; only counts and convergence flags reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocked
from orrery.sources.working import working_table


def clean_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth) of every node reachable from each start, by fewest edges.

    edges: src, dst; starts: start. The start itself is left out, even on a cycle. A
    node once seen from a start isn't expanded again, so cycles end.
    """
    edges = working_table(edges, "edges")
    if (graph := blocked.adjacency(edges)) is not None:
        return blocked.reach_pairs(graph, starts, depth)
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    level = 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        # Each level is written once; what was seen is the union of the levels so far.
        new = working_table(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)), "level")
        if new.isEmpty():
            break
        frontier = new.select("start", "node")
        seen = seen.unionByName(new)
    return seen.where("depth > 0")


def _ranks(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """(node, rank) of nodes with incoming edges, the top rank, and whether a node has it.

    Ranks rise along every edge, save between nodes of the top rank. Edges out of nodes
    without incoming ones are taken away, again and again; that ends when a round takes
    less than a tenth, and what is left (cycles and what is below them, long chains) gets the top rank.
    """
    rest, n, parts, some = edges, edges.count(), [], False
    while n and not some:
        parts.append(rest.select(F.col("dst").alias("node"), F.lit(len(parts) + 1).alias("rank")))
        cut = working_table(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "ranks")
        left = cut.count()
        rest, n, some = cut, left, left > 0.9 * n
    every = edges.select(F.col("dst").alias("node"), F.lit(0).alias("rank")).where("false")
    for p in parts:
        every = every.unionByName(p)
    return working_table(every.groupBy("node").agg(F.max("rank").alias("rank")), "ranks"), len(parts) + (not some), some


def reached_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, node, reached) of the distinct pairs: whether the start reaches the node, other than itself.

    edges: src, dst; pairs: start, node. The closure is not stored: nodes are ranked along
    the edges, and a search goes on only through those that rank below a node asked for.
    """
    edges = working_table(edges, "edges")
    if (graph := blocked.adjacency(edges)) is not None:
        return blocked.reached_pairs(graph, pairs)
    pairs = working_table(pairs.select("start", "node").distinct(), "pairs")
    ranks, top, some = _ranks(edges)
    asked = pairs.where("start <> node").join(ranks.withColumnRenamed("rank", "most"), "node").join(ranks.select(F.col("node").alias("start"), F.col("rank").alias("own")), "start", "left")
    asked = working_table(asked.where((F.coalesce("own", F.lit(0)) < F.col("most")) | (F.col("most") == top)).select("start", "node", "most"), "asked")
    onward = working_table(edges.join(ranks.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "rank"), "edges")
    frontier = working_table(asked.groupBy("start").agg(F.max("most").alias("most")).select("start", F.col("start").alias("node"), "most"), "level")
    seen = frontier.select("start", "node")
    while not frontier.isEmpty():
        step = frontier.join(onward, frontier.node == onward.src).select("start", F.col("dst").alias("node"), "most", "rank").where("rank <= most").distinct()
        if some:  # without cycles a search ends by itself
            step = step.join(seen, ["start", "node"], "left_anti")
        new = working_table(step, "level")
        seen = seen.unionByName(new.select("start", "node"))
        frontier = new.where((F.col("rank") < F.col("most")) | (F.col("most") == top)).drop("rank")
    # The planner can't know how many were found: merged, never sent to every worker.
    found = asked.join(seen.hint("merge"), ["start", "node"], "left_semi").select("start", "node", F.lit(True).alias("reached"))
    return pairs.join(found.hint("merge"), ["start", "node"], "left").select("start", "node", F.coalesce("reached", F.lit(False)).alias("reached"))


def reach_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node, callers, max_depth: how many starts reach each node, itself left out, and from how far."""
    edges = working_table(edges, "edges")
    if (graph := blocked.adjacency(edges)) is not None:
        return blocked.reach_counts(graph, starts)
    return reach(edges, starts).groupBy("node").agg(F.count("*").alias("callers"), F.max("depth").alias("max_depth"))


def reachable_set(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes reachable from any start, starts included; one row a node, so it stays linear."""
    edges = working_table(edges, "edges")
    if (graph := blocked.adjacency(edges)) is not None:
        return blocked.reachable(graph, starts)
    frontier = working_table(starts.select(F.col("start").alias("node")).distinct(), "level")
    seen = frontier
    while True:
        step = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = working_table(step.join(seen, "node", "left_anti"), "level")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def shortest_paths(edges: DataFrame, starts: DataFrame, weight: str) -> DataFrame:
    """(start, node, cost, via) of least total weight: relaxation of improved nodes only, until none improves.

    Weights are not negative, or a cycle might improve for ever.
    """
    edges = working_table(edges, "edges")
    if not edges.where(F.col(weight) < 0).isEmpty():
        raise ValueError("negative weights")
    if (graph := blocked.adjacency(edges, weight)) is not None:
        own = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("bigint").alias("via")).distinct()
        ends = edges.select(F.col("src").alias("start")).union(edges.select("dst"))
        return blocked.path_costs(graph, starts).unionByName(own.join(ends, "start", "left_anti"))
    best = working_table(starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("bigint").alias("via")), "paths")
    active = best
    while True:
        step = active.join(edges, active.node == edges.src).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col(weight)).alias("cost"), F.col("src").alias("via"))
        step = step.groupBy("start", "node").agg(F.min(F.struct("cost", "via")).alias("x")).select("start", "node", "x.cost", "x.via")
        old = best.select("start", "node", F.col("cost").alias("old"))
        active = working_table(step.join(old, ["start", "node"], "left").where("old is null or cost < old - 1e-12").drop("old"), "improved")
        if active.isEmpty():
            break
        best = working_table(best.unionByName(active).groupBy("start", "node").agg(F.min(F.struct("cost", "via")).alias("x")).select("start", "node", "x.cost", "x.via"), "paths")
    return best


def k_paths(edges: DataFrame, start: int, end: int, k: int, depth: int | None = None) -> DataFrame:
    """The k cheapest loopless paths (of at most ``depth`` edges, if given): path, cost.

    Only nodes that lead to the end are entered. Weights are not negative, so once k
    paths are known a partial path dearer than the k-th is dropped; the loop ends when
    no partial path is left.
    """
    spark = edges.sparkSession
    e = working_table(edges.select("src", "dst", "weight"), "edges")
    if not e.where("weight < 0").isEmpty():
        raise ValueError("negative weights")
    back = reach(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), spark.createDataFrame([(end,)], "start bigint"), depth).select("node", "depth")
    back = working_table(back.unionByName(spark.createDataFrame([(end, 0)], "node bigint, depth int")), "back")
    paths = spark.createDataFrame([([start], start, 0.0)], "path array<bigint>, node bigint, cost double")
    order = ("cost", F.size("path"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))
    done, used = paths.where("false"), 0
    while depth is None or used < depth:
        used += 1
        step = paths.join(e, paths.node == e.src).where(~F.array_contains("path", F.col("dst")))
        step = step.join(back.withColumnRenamed("node", "dst"), "dst")
        if depth is not None:
            step = step.where(F.col("depth") <= depth - used)
        step = working_table(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost")), "paths")
        done = working_table(done.unionByName(step.where(F.col("node") == end)).orderBy(*order).limit(k), "done")
        known = done.agg(F.count("*").alias("n"), F.max("cost").alias("cost")).first()
        paths = step.where(F.col("node") != end)
        if known.n == k:
            paths = paths.where(F.col("cost") <= known.cost)
        if paths.isEmpty():
            break
    out = done.orderBy(*order)
    return out.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "cost")


def strong_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of strongly connected components with two nodes or more; component is the least node.

    Nodes without incoming or outgoing edges are trimmed until none is left. Then each
    node takes the least label that reaches it, forward and backward; nodes whose two
    labels agree form components and leave, and edges between labels go. It repeats on
    the rest, so no closure is ever stored.
    """
    rest = working_table(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    found = None
    for _ in range(rounds):
        while True:
            n = rest.count()
            if not n:
                return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
            cut = rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
            cut = cut.join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            cut = working_table(cut, "scc")
            if cut.count() == n:
                break
            rest = cut
        fwd = _least_label(rest, "src", "dst").withColumnRenamed("label", "f")
        bwd = _least_label(rest, "dst", "src").withColumnRenamed("label", "b")
        labels = working_table(fwd.join(bwd, "node"), "scc-labels")
        same = labels.where("f = b").select("node", F.col("f").alias("component"))
        sizes = same.groupBy("component").count().where("count > 1").select("component")
        part = working_table(same.join(sizes, "component", "left_semi").select("node", "component"), "scc-found")
        found = part if found is None else found.unionByName(part)
        gone = same.select("node")
        lab = labels.select("node", F.struct("f", "b").alias("l"))
        left = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = left.join(lab.select(F.col("node").alias("src"), F.col("l").alias("ls")), "src").join(lab.select(F.col("node").alias("dst"), F.col("l").alias("ld")), "dst")
        rest = working_table(left.where("ls = ld").select("src", "dst"), "scc")
    raise RuntimeError("strong components did not settle")


def _least_label(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node from which it is reached along a -> b, itself included."""
    labels = working_table(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        step = edges.join(labels, F.col(a) == F.col("node")).groupBy(b).agg(F.min("label").alias("m")).withColumnRenamed(b, "node")
        new = working_table(labels.join(step, "node", "left").select("node", F.least("label", "m").alias("label"), (F.col("m") < F.col("label")).alias("moved")), "labels")
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def module_edges(edges: DataFrame, owner: DataFrame, node: str, module: str) -> DataFrame:
    """Distinct edges between modules; self-edges go."""
    a = owner.select(F.col(node).alias("src"), F.col(module).alias("src_module"))
    b = owner.select(F.col(node).alias("dst"), F.col(module).alias("dst_module"))
    return edges.join(a, "src").join(b, "dst").where("src_module <> dst_module").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).distinct()


def coupling(edges: DataFrame, abstract_share: DataFrame | None = None) -> DataFrame:
    """Per module: ce, ca, instability, abstractness, distance. Modules of ``abstract_share`` without edges are listed too."""
    ce = edges.groupBy(F.col("src").alias("module")).agg(F.countDistinct("dst").alias("ce"))
    ca = edges.groupBy(F.col("dst").alias("module")).agg(F.countDistinct("src").alias("ca"))
    out = ce.join(ca, "module", "full_outer").fillna(0, ["ce", "ca"])
    i = F.when(F.col("ce") + F.col("ca") == 0, 0.0).otherwise(F.col("ce") / (F.col("ce") + F.col("ca")))
    out = out.withColumn("instability", i)
    if abstract_share is not None:
        out = out.drop("instability").join(abstract_share, "module", "full_outer").fillna(0, ["ce", "ca"]).fillna(0.0, ["abstractness"]).withColumn("instability", i)
    else:
        out = out.withColumn("abstractness", F.lit(0.0))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def greedy_cover(covers: DataFrame, chooser: str, item: str) -> DataFrame:
    """Minimum set, greedily: each round takes the chooser of most uncovered items (least id on ties).

    Every round is an aggregate whose best row alone reaches the driver.
    """
    spark = covers.sparkSession
    left = working_table(covers.select(F.col(chooser).alias("c"), F.col(item).alias("i")).distinct(), "cover")
    chosen = []
    while True:
        top = left.groupBy("c").count().orderBy(F.desc("count"), "c").first()
        if top is None:
            break
        chosen.append((top["c"], top["count"]))
        hit = left.where(F.col("c") == top["c"]).select("i")
        left = working_table(left.join(hit, "i", "left_anti").select("c", "i"), "cover")
    return spark.createDataFrame(chosen, f"{chooser} {covers.schema[chooser].dataType.simpleString()}, newly_covered bigint")


def damped_propagation(edges: DataFrame, sources: DataFrame, damping: float = 0.5, depth: int = 5, least: float = 0.01) -> DataFrame:
    """Undirected breadth-first spread of a delta, halved per hop: (node, delta) summed over sources.

    sources: start, delta. Each source reaches a node once, at its fewest hops.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    hops = reach(both, sources.select("start"), depth)
    d = hops.join(sources, "start").select("node", (F.col("delta") * F.pow(F.lit(damping), F.col("depth"))).alias("delta"))
    return d.where(F.abs("delta") >= least).groupBy("node").agg(F.sum("delta").alias("delta"), F.count("*").alias("sources"))


def resolve_calls(calls: DataFrame, candidates: list[tuple[str, float, DataFrame, list[tuple[str, str]]]], key: str) -> DataFrame:
    """First match by priority: (resolution, confidence, target table, [(call column, target column)]) in order."""
    parts = []
    for rank, (name, confidence, target, on) in enumerate(candidates):
        t = target.select("id", *(F.col(b).alias(f"_t{k}") for k, (_, b) in enumerate(on)))
        cond = None
        for k, (a, _) in enumerate(on):
            c = F.col(a) == F.col(f"_t{k}")
            cond = c if cond is None else cond & c
        parts.append(calls.join(t, cond).select(key, F.struct(F.lit(rank).alias("rank"), F.col("id").alias("callee"), F.lit(name).alias("resolution"), F.lit(confidence).alias("confidence")).alias("m")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(key).agg(F.min("m").alias("m"))
    return calls.select(key).distinct().join(best, key, "left").select(key, "m.callee", F.coalesce("m.resolution", F.lit("unresolved")).alias("resolution"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))


def contained_in(points: DataFrame, spans: DataFrame, block: int, keys: tuple[str, str], line: str, first: str, last: str) -> DataFrame:
    """Line containment as an equi-join: spans are listed under every block of lines that they touch."""
    p = points.withColumn("_block", F.floor(F.col(line) / block))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(first) / block), F.floor(F.col(last) / block))))
    cond = (p[keys[0]] == s[keys[1]]) & (p["_block"] == s["_b"]) & (F.col(line) >= F.col(first)) & (F.col(line) <= F.col(last))
    return p.join(s, cond).drop("_block", "_b")


def risk_columns(blast: Column, nodes: Column) -> Column:
    return F.when(nodes > 1, blast / (nodes - 1)).otherwise(F.lit(0.0))
