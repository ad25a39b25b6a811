"""Graph operators over edges (src, dst): iterative frontier joins, with a table of visited nodes checkpointed by round."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import lots

#: levels of a closure that are kept apart before what was seen is written as one table again
LEVELS = 16


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names; in local mode a private one where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def build_graph(*parts: DataFrame) -> DataFrame:
    """(src, dst, type_only, kinds) of edges(src, dst, kind, type_only) from any number of tables, one row a pair.

    An edge is type-only if all its uses are; kinds are sorted. A null flag counts as a value use.
    """
    every = parts[0].select("src", "dst", "kind", "type_only")
    for part in parts[1:]:
        every = every.unionByName(part.select("src", "dst", "kind", "type_only"))
    flag = F.bool_and(F.coalesce("type_only", F.lit(False)))
    return every.groupBy("src", "dst").agg(flag.alias("type_only"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def fan(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, fan_in, fan_out): distinct neighbours, a node itself left out. Of nodes(node), those without any have zeros."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    zero = F.lit(0).cast("long")
    found = into.join(out, "node", "full_outer")
    found = found if nodes is None else nodes.select("node").distinct().join(found, "node", "left")
    return found.select("node", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def focus_facts(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, dynamic, re_exported) of changed(node), over edges(src, dst, kind)."""
    kinds = edges.groupBy(F.col("dst").alias("node")).agg(F.bool_or(F.col("kind") == "dynamic").alias("dynamic"), F.bool_or(F.col("kind") == "re-export").alias("re_exported"))
    no = F.lit(False)
    return fan(edges, changed).join(kinds, "node", "left").select("node", "fan_in", "fan_out", F.coalesce("dynamic", no).alias("dynamic"), F.coalesce("re_exported", no).alias("re_exported"))


class _Seen:
    """What a closure has found, as a union of checkpoints: each level is written once, and again with LEVELS others."""

    def __init__(self, first: DataFrame):
        self.parts = [cut(first)]
        self.frontier = self.parts[0]

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def grow(self, step: DataFrame) -> bool:
        """Adds step as the next level; False if it is empty."""
        self.frontier = cut(step)
        if self.frontier.isEmpty():
            return False
        self.parts.append(self.frontier)
        if len(self.parts) > LEVELS:
            self.parts = [cut(self.rows())]
        return True


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of all nodes reachable from roots(node), with the length of the shortest path, to the fixpoint."""
    e = cut(edges.select("src", F.col("dst").alias("next")).distinct())
    seen, depth = _Seen(roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long"))), 0
    while True:
        depth += 1
        step = seen.frontier.join(e, F.col("node") == F.col("src")).select(F.col("next").alias("node")).distinct()
        if not seen.grow(step.join(seen.rows(), "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))):
            return seen.rows()


def reach_bits(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, bits): several closures at once. Bit i of roots(node, bits) goes on over edges(src, dst, mask) with bit i."""
    e = cut(edges.groupBy("src", F.col("dst").alias("next")).agg(F.bit_or("mask").alias("mask")))
    seen = _Seen(roots.groupBy("node").agg(F.bit_or("bits").alias("bits")))
    while True:
        sent = seen.frontier.join(e, F.col("node") == F.col("src")).select(F.col("next").alias("node"), F.col("bits").bitwiseAND(F.col("mask")).alias("bits"))
        sent = sent.filter("bits <> 0").groupBy("node").agg(F.bit_or("bits").alias("bits"))
        had = seen.rows().groupBy("node").agg(F.bit_or("bits").alias("had"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0))))
        if not seen.grow(sent.join(had, "node", "left").select("node", new.alias("bits")).filter("bits <> 0")):
            return seen.rows().groupBy("node").agg(F.bit_or("bits").alias("bits"))


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """(node, path): for each node the lexicographically smallest of the shortest paths, as nodes joined by '>'."""
    spark = edges.sparkSession
    e = cut(edges.select("src", F.col("dst").alias("next")).distinct())
    seen = _Seen(spark.createDataFrame([(start, [start])], "node long, path array<long>"))
    while True:
        step = seen.frontier.join(e, F.col("node") == F.col("src")).select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        step = step.join(seen.rows().select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        if not seen.grow(step):
            return seen.rows().select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def eager_paths(edges: DataFrame, start: int) -> DataFrame:
    """Shortest paths over the edges(src, dst, kind, type_only) that load at once: static ones of values."""
    return shortest_paths(edges.filter("kind = 'static' AND NOT type_only"), start)


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of 2 or more nodes, named by their smallest node.

    Nodes without an edge in or out are trimmed. Then the smallest label is passed forward, and from a label's own label,
    until nothing changes; what reaches a label's own node backwards within the label is one component, and the rest
    goes round again. A round writes one table and looks at it once.
    """
    left, found = cut(edges.filter("src <> dst").select("src", "dst").distinct()), None
    n = left.count()
    while n:
        while True:  # trim
            heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = cut(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi"))
            n, before = left.count(), n
            if n in (0, before):
                break
        if n == 0:
            break
        label = cut(left.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("label")).select("node", F.least("node", "label").alias("label")))
        while True:
            sent = left.join(label, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label", F.lit(None).cast("long").alias("own"))
            new = label.select("node", "label", F.col("label").alias("own")).unionByName(sent).groupBy("node").agg(F.min("label").alias("label"), F.min("own").alias("own"))
            far = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
            label = cut(new.join(far, "label", "left").select("node", F.least("label", "far").alias("label"), "own"))
            done = label.filter("label <> own").isEmpty()
            label = label.select("node", "label")
            if done:
                break
        own = cut(left.join(label.toDF("src", "a"), "src").join(label.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("label")))
        seen = _Seen(label.filter("node = label"))
        while True:
            step = own.join(seen.frontier.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            if not seen.grow(step.join(seen.rows(), ["node", "label"], "left_anti")):
                break
        members = seen.rows()
        found = members if found is None else found.unionByName(members)
        gone = members.select("node")
        left = cut(left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, left["dst"] == gone["node"], "left_anti"))
        n = left.count()
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component")).filter("n > 1")
    return found.join(sizes, "label").select("node", "component")


def entry_weight(edges: DataFrame, entry: int, sizes: DataFrame) -> DataFrame:
    """One row: nodes loaded from the entry, itself included, and the sum of their sizes(node, size); none counts as 0."""
    root = edges.sparkSession.createDataFrame([(entry,)], "node long")
    found = reach(edges, root).join(sizes, "node", "left")
    return found.agg(F.countDistinct("node").alias("modules"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def impact_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, depth) of everything that depends on changed(node), these included."""
    return reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed)


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, slice) of nodes(node): what edges(src, dst) join in either direction, named by its smallest node.

    Each node takes the smallest name among its neighbours, then that of the node it is named by, until nothing changes:
    the rounds grow with the logarithm of the longest chain about. Edges to other nodes don't count.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    both = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("node").distinct().withColumn("slice", F.col("node")))
    while True:
        own = label.select("node", "slice", F.col("slice").alias("own"))
        sent = both.join(label, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "slice", F.lit(None).alias("own"))
        near = own.unionByName(sent.withColumn("own", F.col("own").cast(own.schema["own"].dataType))).groupBy("node").agg(F.min("slice").alias("slice"), F.min("own").alias("own"))
        near = cut(near.filter("own IS NOT NULL"))
        # the node that one was named by tells its own, smaller name, and one's new name is told to it as well
        far = near.select(F.col("node").alias("slice"), F.col("slice").alias("far"))
        back = near.groupBy(F.col("own").alias("node")).agg(F.min("slice").alias("back"))
        new = near.join(far, "slice", "left").join(back, "node", "left").select("node", F.least("slice", "far", "back").alias("slice"), "own")
        label = cut(new)
        if label.filter("slice <> own").isEmpty():
            return label.select("node", "slice")
        label = label.select("node", "slice")


def partition_order(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(slice, layer, node): in what order to look at what a change reaches, over edges(src, dst), src depending on dst.

    The nodes are those that depend on changed(node), these included. Independent slices, which no edge between such nodes
    joins, are named by their smallest node. Within a slice a node's layer is the length of the longest way down its
    dependencies there, nodes that depend on each other being one: layer 0 depends on nothing else that is affected.
    """
    hit = cut(impact_closure(edges, changed).select("node"))
    inside = edges.filter("src <> dst").select("src", "dst").distinct()
    inside = cut(inside.join(hit.toDF("src"), "src", "left_semi").join(hit.toDF("dst"), "dst", "left_semi"))
    whole = hit.join(strong_components(inside), "node", "left")
    whole = cut(whole.select("node", F.coalesce("component", "node").alias("component")))
    slices = connected(inside, hit)
    left = inside.join(whole.toDF("src", "a"), "src").join(whole.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    left, todo, layer, found = cut(left), cut(whole.select("component").distinct()), 0, None
    while not todo.isEmpty():
        ready = cut(todo.join(left.select(F.col("a").alias("component")).distinct(), "component", "left_anti"))
        level = ready.withColumn("layer", F.lit(layer).cast("long"))
        found = level if found is None else found.unionByName(level)
        todo = cut(todo.join(ready, "component", "left_anti"))
        left, layer = cut(left.join(ready.select(F.col("component").alias("b")), "b", "left_anti")), layer + 1
    if found is None:
        return slices.select("slice", F.lit(0).cast("long").alias("layer"), "node")
    return whole.join(found, "component").join(slices, "node").select("slice", "layer", "node")


def update_reach(edges: DataFrame, reached: DataFrame, roots: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(node): what roots(node) reach over edges(src, dst), from what they reached before edges changed.

    edges are those after the change; added(src, dst) and removed(src, dst) say what changed, reached(node) what was
    known. Only what hung on a removed edge is looked at again: it is suspect, with all it led to, until an edge from a node
    that isn't suspect, or a root, brings it back. Then what added edges and such nodes lead to is followed, as far as it
    is new. An edge in both lists counts by whether edges has it.
    """
    edges, gone = edges.select("src", "dst"), removed.select("src", "dst").distinct().join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    roots, known = roots.select("node").distinct(), reached.select("node").distinct()
    cut_off = gone.join(known.toDF("src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_semi")
    firm, start = known.unionByName(roots).distinct(), None
    if not cut_off.isEmpty():
        before = edges.unionByName(removed.select("src", "dst")).join(known.toDF("src"), "src", "left_semi")
        suspect = cut(reach(before, cut_off).select("node").join(roots, "node", "left_anti"))
        firm = cut(firm.join(suspect, "node", "left_anti"))
        start = edges.join(suspect.toDF("dst"), "dst", "left_semi").join(firm.toDF("src"), "src", "left_semi").select(F.col("dst").alias("node"))
    news = edges.join(added.select("src", "dst").distinct(), ["src", "dst"], "left_semi").join(firm.toDF("src"), "src", "left_semi").select(F.col("dst").alias("node"))
    news = news.unionByName(roots.join(known, "node", "left_anti"))
    news = (news if start is None else news.unionByName(start)).distinct()
    seen = _Seen(firm)
    seen.frontier = cut(news.join(firm.join(roots.join(known, "node", "left_anti"), "node", "left_anti"), "node", "left_anti"))
    if seen.frontier.isEmpty():
        return firm
    seen.parts.append(seen.frontier)
    e = cut(edges.distinct())
    while True:
        step = seen.frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if not seen.grow(step.join(seen.rows(), "node", "left_anti")):
            return seen.rows().distinct()


def lifted(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst): edges between the owners(node, owner) of edges between nodes, without those inside one owner."""
    e = edges.join(owners.toDF("src", "a"), "src").join(owners.toDF("dst", "b"), "dst").filter("a <> b")
    return e.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def cycle_text(files):
    """A cycle of nodes as text from its smallest node on, joined by '>': the same from whatever node it is told."""
    at = F.array_position(files, F.array_min(files)).cast("int")
    turned = F.concat(F.slice(files, at, F.size(files)), F.slice(files, F.lit(1), at - 1))
    return F.array_join(F.transform(turned, lambda x: x.cast("string")), ">")


class Cycles:
    """Elementary cycles of edges(src, dst), by components: listed(cycle, hops, component), accepted ones among them left out.

    Paths grow inside one strong component through nodes above their first one, the shortest first, and each level's
    cycles are set against accepted(key) or entries as they close, so that accepted ones don't count. With a cap, a
    component that has more than that many cycles stops there: its longer paths aren't made. `capped` has these components.
    """

    def __init__(self, edges: DataFrame, longest: int, accepted: DataFrame | None = None, cap: int | None = None, entries: DataFrame | None = None):
        edges = cut(edges.filter("src <> dst").select("src", "dst").distinct())
        self.components, self.longest, self.entries = cut(strong_components(edges)), longest, entries
        c = self.components
        e = cut(edges.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").filter("a = b").select("src", "dst", F.col("a").alias("component")))
        allowed = None if entries is None else entries.select(cycle_text(F.col("files")).alias("cycle")).distinct()
        back, last = e.select(F.col("src").alias("x"), F.col("dst").alias("y")), F.element_at("path", -1)
        paths, levels, self.capped, self.matched = e.filter("src < dst").select("component", F.array("src", "dst").alias("path")), [], None, None
        for hops in range(2, longest + 1):
            closed = paths.join(back, (last == F.col("x")) & (F.get("path", F.lit(0)) == F.col("y")))
            closed = closed.select("component", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"), F.array_sort("path").alias("key"), F.lit(hops).cast("long").alias("hops"))
            if accepted is not None:
                key = F.array_join(F.transform("key", lambda x: x.cast("string")), "|")
                closed = closed.withColumn("key", key).join(accepted.select("key"), "key", "left_anti")
            if allowed is not None:
                every = cut(closed)
                met = every.join(allowed, "cycle", "left_semi").select("cycle")
                self.matched, closed = met if self.matched is None else self.matched.unionByName(met), every.join(allowed, "cycle", "left_anti")
            if cap is not None:  # one more than the cap shows that there are more
                order = Window.partitionBy("component").orderBy("cycle")
                closed = cut(closed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap + 1).drop("r"))
            levels.append(closed.select("component", "cycle", "hops"))
            if hops == longest:
                break
            if cap is not None:
                full = self.listed(levels).groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)
                paths = paths.join(full.select("component"), "component", "left_anti")
            grown = paths.join(back, last == F.col("x")).filter((F.col("y") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("y")))
            paths = cut(grown.select("component", F.concat("path", F.array("y")).alias("path")))
        self.found = self.listed(levels)
        if cap is not None:
            self.capped = self.found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("component")
            order = Window.partitionBy("component").orderBy("hops", "cycle")
            self.found = self.found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= cap).drop("r")

    @staticmethod
    def listed(levels: list[DataFrame]) -> DataFrame:
        out = levels[0]
        for more in levels[1:]:
            out = out.unionByName(more)
        return out

    def entry_states(self) -> DataFrame:
        """(entry, state) of entries(entry, files): matched by a cycle; unprovable, as it is longer than what is listed or
        all its files are of one component that was capped; else unmatched, which deserves a message."""
        text = cycle_text(F.col("files"))
        e = self.entries.select("entry", "files", text.alias("cycle"))
        met = self.matched.distinct().withColumn("met", F.lit(True))
        capped = self.components.join(self.capped, "component", "left_semi") if self.capped is not None else self.components.limit(0)
        inside = e.select("entry", F.explode("files").alias("node"), F.size("files").alias("size")).join(capped, "node")
        inside = inside.groupBy("entry").agg((F.count(F.lit(1)) == F.max("size")).alias("whole"), (F.min("component") == F.max("component")).alias("one"))
        state = F.when(F.col("met"), "matched").when((F.size("files") > self.longest) | (F.col("whole") & F.col("one")), "unprovable").otherwise("unmatched")
        return e.join(met, "cycle", "left").join(inside, "entry", "left").select("entry", state.alias("state"))


def elementary_cycles(edges: DataFrame, longest: int = 5, accepted: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(cycle, hops): cycles of 2 to `longest` different nodes, from their smallest one on, as nodes joined by '>'.

    Cycles whose sorted nodes, joined by '|', are in accepted(key) are left out of what is listed. With a cap each
    component lists so many cycles, the shortest first and then by their text, after the accepted ones have gone, and
    `truncated` tells whether it has more.
    """
    cycles = Cycles(edges, longest, accepted, cap)
    if cap is None:
        return cycles.found.select("cycle", "hops")
    more = cycles.found.join(cycles.capped.withColumn("truncated", F.lit(True)), "component", "left")
    return more.select("cycle", "hops", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def eager_cycles(edges: DataFrame, longest: int = 5, accepted: DataFrame | None = None) -> DataFrame:
    """Elementary cycles of edges(src, dst, kind) without those loaded on demand."""
    return elementary_cycles(edges.filter("kind <> 'dynamic'"), longest, accepted)


def hop_anchors(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, src, dst, span): each hop of a cycle(cycle) with the first span of its edges(src, dst, span)."""
    nodes = F.transform(F.split("cycle", ">"), lambda x: x.cast("long"))
    hops = cycles.select("cycle", nodes.alias("n"))
    hop = F.transform("n", lambda x, i: F.struct(x.alias("src"), F.get("n", (i + 1) % F.size("n")).alias("dst")))
    hops = hops.select("cycle", F.explode(hop).alias("h")).select("cycle", "h.src", "h.dst")
    return hops.join(edges.groupBy("src", "dst").agg(F.min("span").alias("span")), ["src", "dst"]).select("cycle", "src", "dst", "span")


def re_export_cycles(edges: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(node, component): members of cycles of re-export edges(src, dst), a file that re-exports itself included.

    One member in suppressed(node) drops its whole cycle.
    """
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    found = strong_components(edges)
    found = found.unionByName(loops.join(found.select("node"), "node", "left_anti"))
    bad = found.join(suppressed.select("node").distinct(), "node", "left_semi").select("component").distinct()
    return found.join(bad, "component", "left_anti").select("node", "component")


def subclass_index(heritage: DataFrame) -> DataFrame:
    """(base, class, depth): every class that extends a base over any number of steps of heritage(class, base)."""
    e = cut(heritage.select("class", "base").distinct())
    seen, depth = _Seen(e.select("base", "class", F.lit(1).cast("long").alias("depth"))), 1
    up = e.toDF("sub", "over")
    while True:
        depth += 1
        step = seen.frontier.join(up, F.col("class") == F.col("over")).select("base", F.col("sub").alias("class")).distinct()
        if not seen.grow(step.join(seen.rows(), ["base", "class"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))):
            return seen.rows()


def symbol_chain(calls: DataFrame, start: int, most: int) -> DataFrame:
    """(direction, node, hops): callers and callees of a symbol over calls(src, dst), up to `most` hops."""
    spark, found = calls.sparkSession, None
    for name, e in (("callee", calls.select("src", "dst")), ("caller", calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        e = cut(e.distinct())
        seen = _Seen(spark.createDataFrame([(start, 0)], "node long, hops long"))
        for hops in range(1, most + 1):
            step = seen.frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            if not seen.grow(step.join(seen.rows(), "node", "left_anti").withColumn("hops", F.lit(hops).cast("long"))):
                break
        side = seen.rows().filter("hops > 0").select(F.lit(name).alias("direction"), "node", "hops")
        found = side if found is None else found.unionByName(side)
    return found


def usage_trace(uses: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(package, name, direct, wrapped): uses(package, name, file) of a package's names, and uses one hop on, in files
    that import a file of wrappers(file, importer) where the name is used."""
    direct = uses.groupBy("package", "name").agg(F.countDistinct("file").alias("direct"))
    hop = uses.join(wrappers, "file").groupBy("package", "name").agg(F.countDistinct("importer").alias("wrapped"))
    return direct.join(hop, ["package", "name"], "left").select("package", "name", "direct", F.coalesce("wrapped", F.lit(0)).cast("long").alias("wrapped"))


def stack_frames(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(trace, pos, path, line): frames(trace, pos, frame) as files(path), by the longest path that the frame's ends in.

    A frame without `path:line`, or of no known file, has null path and line.
    """
    frames = lots(frames.select("trace", "pos", "frame"), "trace", "pos")
    parsed = frames.select("trace", "pos", F.regexp_extract("frame", r"([^\s():]+):(\d+)(?::\d+)?\)?\s*$", 1).alias("raw"), F.regexp_extract("frame", r":(\d+)(?::\d+)?\)?\s*$", 1).alias("line"))
    parts = F.split("raw", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = parsed.filter("raw <> ''").select("trace", "pos", "line", F.explode(tails).alias("path"))
    hit = tails.join(files.select("path").distinct(), "path").groupBy("trace", "pos").agg(F.max_by("path", F.length("path")).alias("path"), F.first("line").cast("long").alias("line"))
    return frames.select("trace", "pos").join(hit, ["trace", "pos"], "left")


def shared_state(accesses: DataFrame, declared: DataFrame, most: int = 20_000) -> DataFrame:
    """(root, slot, reads, writes, files): state that imported bindings write, where just one file declares the root.

    accesses(root, slot, op, file), declared(root, file). At most `most` rows, by writes, root and slot.
    """
    single = declared.groupBy("root").agg(F.countDistinct("file").alias("n"), F.min("file").alias("owner")).filter("n = 1")
    found = accesses.join(single, "root").filter(F.col("file") != F.col("owner")).groupBy("root", "slot")
    count = lambda op: F.count(F.when(F.col("op") == op, 1))
    found = found.agg(count("read").alias("reads"), count("write").alias("writes"), F.countDistinct("file").alias("files")).filter("writes > 0")
    return found.orderBy(F.desc("writes"), "root", "slot").limit(most)


def load_closure(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, phase) of edges(src, dst, kind): eager by static edges only, deferred by dynamic ones too, else worker."""
    mask = F.when(F.col("kind") == "static", 7).when(F.col("kind") == "dynamic", 6).otherwise(4)
    found = reach_bits(edges.select("src", "dst", mask.alias("mask")), entries.select("node", F.lit(7).alias("bits")))
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) != 0
    return found.select("node", F.when(has(1), "eager").when(has(2), "deferred").otherwise("worker").alias("phase"))


def test_reach(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, reach) of edges(src, dst, mocked): direct, transitive, mocked_only or none, in this order; tests are left out."""
    mask = F.when(F.col("mocked"), 2).otherwise(3)
    bits = reach_bits(edges.select("src", "dst", mask.alias("mask")), tests.select("node", F.lit(3).alias("bits")))
    direct = edges.filter("NOT mocked").join(tests.select(F.col("node").alias("src")), "src", "left_semi")
    direct = direct.select(F.col("dst").alias("node")).distinct().withColumn("direct", F.lit(True))
    plain = F.col("bits").bitwiseAND(F.lit(1)) != 0
    name = F.when(F.col("direct"), "direct").when(plain, "transitive").when(F.col("bits").isNotNull(), "mocked_only").otherwise("none")
    found = nodes.select("node").join(tests.select("node"), "node", "left_anti").join(bits, "node", "left").join(direct, "node", "left")
    return found.select("node", name.alias("reach"))


def export_test_reach(exports: DataFrame, refs: DataFrame, reached: DataFrame) -> DataFrame:
    """(export, reach): the best class of the files that use an export's value: reached(node, reach); type uses don't
    count. NoneFile: no test reaches the export's own file either."""
    rank = F.when(F.col("reach") == "direct", 0).when(F.col("reach") == "transitive", 1).when(F.col("reach") == "mocked_only", 2)
    ranked = reached.select("node", rank.alias("r"))
    best = refs.filter("is_value").join(ranked.withColumnRenamed("node", "from_file"), "from_file").groupBy("export").agg(F.min("r").alias("r"))
    own = ranked.select(F.col("node").alias("file"), F.col("r").alias("own"))
    name = F.when(F.col("r") == 0, "direct").when(F.col("r") == 1, "transitive").when(F.col("r") == 2, "mocked_only").when(F.col("own").isNull(), "none_file").otherwise("none")
    return exports.join(best, "export", "left").join(own, "file", "left").select("export", name.alias("reach"))


def dominators(edges: DataFrame, entry: int) -> DataFrame:
    """(node, dom): the nodes on every path from the entry to a node, itself included.

    The nodes of one shortest path hold all of them; those that some predecessor lacks are dropped until none is left.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    path = F.transform(F.split("path", ">"), lambda x: x.cast("long"))
    dom = cut(shortest_paths(e, entry).select("node", F.explode(path).alias("dom")))
    live = cut(e.join(dom.select(F.col("node").alias("src")).distinct(), "src", "left_semi").filter(F.col("dst") != entry))
    needs = cut(live.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("preds")))
    while True:
        shared = live.join(dom.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "dom").agg(F.count(F.lit(1)).alias("n"))
        held = shared.join(needs, "node").filter("n = preds").select("node", "dom")
        new = cut(dom.join(held, ["node", "dom"], "left_semi").unionByName(dom.filter("node = dom")).distinct())
        if new.count() == dom.count():
            return new
        dom = new


def dominating_imports(edges: DataFrame, entry: int, sizes: DataFrame, top: int = 10) -> DataFrame:
    """(src, dst, bytes): single edges without which the most bytes of sizes(node, size) are not loaded from the entry."""
    dom = dominators(edges, entry)
    kept = dom.join(sizes, "node").groupBy(F.col("dom").alias("dst")).agg(F.sum("size").alias("bytes"))
    nodes = dom.select(F.col("node").alias("src")).distinct()
    into = edges.filter("src <> dst").select("src", "dst").distinct().join(nodes, "src", "left_semi").filter(F.col("dst") != entry)
    own = dom.select(F.col("node").alias("src"), F.col("dom").alias("dst"))
    single = into.join(own, ["src", "dst"], "left_anti").groupBy("dst").agg(F.min("src").alias("src"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return single.join(kept, "dst").select("src", "dst", "bytes").orderBy(F.desc("bytes"), "src", "dst").limit(top)


def peer_closure(required: DataFrame, optional: DataFrame, listed: DataFrame, roots: DataFrame) -> DataFrame:
    """(peer, hosts): peers of what the roots(node) credit. Required(src, dst) peers pass credit on, optional ones only
    if listed(node); each host is recorded either way."""
    passing = required.unionByName(optional.join(listed.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
    live = reach(passing.distinct(), roots).select(F.col("node").alias("src"))
    hosts = required.unionByName(optional).distinct().join(live, "src").groupBy(F.col("dst").alias("peer"))
    return hosts.agg(F.array_join(F.array_sort(F.collect_set(F.col("src").cast("string"))), ",").alias("hosts"))


def re_export_routes(own: DataFrame, re_exports: DataFrame, name: str, file: str) -> DataFrame:
    """(file, name) that expose what `file` declares as `name`, with aliases followed.

    re_exports(file, exported, source, imported); a name that a file in own(file, name) declares shadows its
    re-exports, and a name with two different sources is ambiguous: neither goes on.
    """
    r = re_exports.distinct().join(own.select("file", F.col("name").alias("exported")), ["file", "exported"], "left_anti")
    single = r.groupBy("file", "exported").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    r = r.join(single, ["file", "exported"], "left_semi")
    e = r.select(F.struct(F.col("source").alias("file"), F.col("imported").alias("name")).alias("src"), F.struct("file", F.col("exported").alias("name")).alias("dst"))
    root = own.filter((F.col("file") == file) & (F.col("name") == name)).select(F.struct("file", "name").alias("node"))
    return reach(e, root).select("node.*")
