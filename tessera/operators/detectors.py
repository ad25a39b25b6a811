"""Dead-code and consistency detectors: anti joins and grouped conditions over declarations and uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lots import lots


def unused(declared: DataFrame, used: DataFrame, *on: str) -> DataFrame:
    """Declarations without any use; add credits to `used` with unionByName."""
    return declared.join(used.select(*on), list(on), "left_anti")


def unlisted(used: DataFrame, declared: DataFrame, on: str, site: str) -> DataFrame:
    """Names used but not declared: number of uses and first site."""
    return used.join(declared.select(on), on, "left_anti").groupBy(on).agg(F.count(F.lit(1)).alias("uses"), F.min(site).alias("first_site"))


def shared_names(df: DataFrame, name: str, owner: str, least: int = 2) -> DataFrame:
    """Names that at least `least` owners have."""
    return df.groupBy(name).agg(F.countDistinct(owner).alias("owners")).filter(F.col("owners") >= least)


def export_aliases(exports: DataFrame, ignored: DataFrame) -> DataFrame:
    """(file, local, source, names): one binding that a file exports under two names or more, names by place.

    exports(file, name, local, source, type_only, place): local is what the name stands for, the name itself where it is
    null; a default without a local, a star and a row without a place name no binding. source is null for the file's own.
    A type and a value of one name are two bindings, but a name that the file exports plainly as a type alone makes every
    export of that local one of the type. ignored(file, name) drops the whole binding of such a name, or all of a file
    with '*'. A name that is there twice counts at its first place.
    """
    e = exports.filter("place IS NOT NULL AND name <> '*' AND (local IS NOT NULL OR name <> 'default')").withColumn("local", F.coalesce("local", "name"))
    plain = e.filter("source IS NULL AND name = local").groupBy("file", "local").agg(F.bool_and("type_only").alias("__type"))
    e = e.join(plain, ["file", "local"], "left")
    typed = F.col("type_only") | (F.col("source").isNull() & F.coalesce("__type", F.lit(False)))
    out = ignored.select("file", "name").distinct()
    e = e.join(out.filter("name = '*'").select("file"), "file", "left_anti").join(out.withColumn("__out", F.lit(True)), ["file", "name"], "left")
    each = e.groupBy("file", "local", "source", typed.alias("typed"), "name").agg(F.min("place").alias("place"), F.max("__out").alias("out"))
    found = each.groupBy("file", "local", "source", "typed").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("at"), F.max("out").alias("out"))
    return found.filter("size(at) > 1 AND out IS NULL").select("file", "local", "source", F.col("at.name").alias("names"))


def always(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Keys all of whose uses have the flag: type-only and test-only dependencies."""
    return df.groupBy(key).agg(F.bool_and(flag).alias("always"), F.count(F.lit(1)).alias("uses")).filter("always").drop("always")


def both(df: DataFrame, key: str, one: Column, other: Column) -> DataFrame:
    """Keys with a use of either kind: mixed barrels."""
    found = df.groupBy(key).agg(F.bool_or(one).alias("a"), F.bool_or(other).alias("b"))
    return found.filter("a AND b").select(key)


def constant_values(df: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys called at least `least` times, always with one known value."""
    found = df.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias("value"), F.count(F.lit(1)).alias("calls"), F.bool_and(F.col(value).isNotNull()).alias("known"))
    return found.filter((F.col("n") == 1) & F.col("known") & (F.col("calls") >= least)).select(key, "value", "calls")


def constant_parameters(params: DataFrame, calls: DataFrame, args: DataFrame, least: int = 2) -> DataFrame:
    """(fn, index, key, reason, value, calls): parameters, and options of an object parameter, that every call gives alike.

    params(fn, index, key, optional): key null is the parameter itself, optional says that it may be omitted; for a key it
    says that the whole object may be. calls(fn, call), at least `least` of them; args(call, index, key, kind, value): kind
    'same' hands the caller's own parameter on in a call of itself, which tells nothing and isn't counted; 'object' is an
    object whose keys have rows of their own; 'undefined' is as if omitted for keys; 'unknown' forbids a verdict; all
    other kinds are values, equal if kind and value are. Without a row an argument is omitted, and so is a key of an
    object; an omitted object leaves its keys omitted if it may be, else unknown. Reasons: never-passed, if omitting is
    allowed, and identical-argument. A parameter or argument that is there twice counts once, by the greatest row.
    """
    a = args.groupBy("call").agg(F.collect_list(F.struct("index", "key", "kind", "value")).alias("args"))
    made = calls.select("fn", "call").distinct().join(a, "call", "left").select("fn", "args")
    return constant_in_calls(params, lots(made, "fn"), least)


def constant_in_calls(params: DataFrame, calls: DataFrame, least: int = 2) -> DataFrame:
    """As constant_parameters, of calls(fn, args), a row a call with its arguments as an array of (index, key, kind, value).

    Calls that are dealt out by function in lots aren't dealt out again.
    """
    p = lots(params, "fn").groupBy("fn", "index", "key").agg(F.bool_or(F.coalesce("optional", F.lit(False))).alias("optional"))
    each = calls.join(p.hint("merge"), "fn")
    last = lambda key: F.array_max(F.transform(F.filter("args", lambda x: (x["index"] == F.col("index")) & key(x["key"])), lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))
    each = each.select("fn", "index", "key", "optional", last(lambda k: k.isNull()).alias("whole"), F.when(F.col("key").isNotNull(), last(lambda k: k == F.col("key"))).alias("arg"))
    none, of_key = F.col("whole").isNull() | (F.col("whole.kind") == "undefined"), F.col("key").isNotNull()
    seen = F.when(~of_key, F.col("whole")).when(F.col("whole.kind") == "object", F.col("arg"))
    unknown = F.when(of_key & none, ~F.col("optional")).when(of_key & (F.col("whole.kind") != "object"), True).otherwise(F.coalesce(F.col("seen.kind").isin("unknown", "object"), F.lit(False)))
    each = each.withColumn("seen", seen).filter("seen IS NULL OR seen.kind <> 'same'").withColumn("unknown", unknown)
    found = each.groupBy("fn", "index", "key").agg(
        F.count(F.lit(1)).alias("calls"), F.count("seen").alias("given"), F.min("seen").alias("least"), F.max("seen").alias("most"), F.bool_or("unknown").alias("unknown"), F.bool_or("optional").alias("optional")
    )
    reason = F.when((F.col("given") == 0) & (F.col("optional") | F.col("key").isNotNull()), "never-passed").when((F.col("given") == F.col("calls")) & F.col("least").eqNullSafe(F.col("most")), "identical-argument")
    found = found.filter(~F.col("unknown") & (F.col("calls") >= least)).withColumn("reason", reason).filter("reason IS NOT NULL")
    return found.select("fn", "index", "key", "reason", F.col("least.value").alias("value"), "calls")


def collisions(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Members that share a key with others, and how many others: route collisions."""
    w = Window.partitionBy(*keys)
    return df.withColumn("others", F.count(F.lit(1)).over(w) - 1).filter("others >= 1").select(*keys, member, "others")


def catalog_difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys on one side only: unused entries and unresolved references."""
    a, b = left.select(on).distinct().withColumn("a", F.lit(1)), right.select(on).distinct().withColumn("b", F.lit(1))
    both_sides = a.join(b, on, "full_outer").filter("a IS NULL OR b IS NULL")
    return both_sides.select(on, F.when(F.col("b").isNull(), "unreferenced").otherwise("unresolved").alias("side"))


def boundary_violations(edges: DataFrame, zones: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges (src, dst) between zones (node, zone) that are not allowed pairs (zone_a, zone_b); zones may be the same."""
    e = edges.join(zones.select(F.col("node").alias("src"), F.col("zone").alias("zone_a")), "src")
    e = e.join(zones.select(F.col("node").alias("dst"), F.col("zone").alias("zone_b")), "dst")
    e = e.filter("zone_a <> zone_b")
    return e.join(allowed, ["zone_a", "zone_b"], "left_anti").select("src", "dst", "zone_a", "zone_b")


def boundary_findings(edges: DataFrame, zones: DataFrame, allowed: DataFrame, public: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(src, dst, line, zone_a, zone_b): imports(src, dst, line, type_only) across zones(node, zone) that aren't allowed.

    allowed(zone_a, zone_b, type_only) lets every import pass, or only those of types; files of public(node) may be
    imported from any zone; suppressed(src, line) hides one line of a file, all where line is null. A file is in one zone
    at most; one in none is free, as is an import inside a zone. A null flag counts as a value.
    """
    imported = zones.select(F.col("node").alias("dst"), F.col("zone").alias("zone_b")).join(public.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti")
    hidden = suppressed.groupBy("src").agg(F.bool_or(F.col("line").isNull()).alias("__all"), F.collect_set("line").alias("__lines"))
    importing = zones.select(F.col("node").alias("src"), F.col("zone").alias("zone_a")).join(hidden, "src", "left").filter("__all IS NULL OR NOT __all").drop("__all")
    # what is told of a file is told before the imports are joined to it, so these are dealt out once by each of their ends
    e = edges.select("src", "dst", "line", F.coalesce("type_only", F.lit(False)).alias("type_only")).join(imported, "dst").join(importing, "src")
    e = e.filter("zone_a <> zone_b").filter(~F.coalesce(F.array_contains("__lines", F.col("line")), F.lit(False))).drop("__lines")
    rules = allowed.groupBy("zone_a", "zone_b").agg(F.bool_and("type_only").alias("__types"))
    e = e.join(rules, ["zone_a", "zone_b"], "left").filter("__types IS NULL OR (__types AND NOT type_only)")
    return e.select("src", "dst", "line", "zone_a", "zone_b").distinct()


def shared_shapes(df: DataFrame, owner: str, prop: str, least_props: int = 4, least_owners: int = 3) -> DataFrame:
    """Sets of at least `least_props` properties that at least `least_owners` owners have in common as a whole."""
    shape = df.groupBy(owner).agg(F.array_sort(F.collect_set(F.col(prop))).alias("s")).filter(F.size("s") >= least_props)
    shape = shape.groupBy(F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("shape"))
    return shape.agg(F.count(F.lit(1)).alias("owners")).filter(F.col("owners") >= least_owners)


def fan_in_summary(nodes: DataFrame, uses: DataFrame, node: str, user: str, floor: int = 10) -> DataFrame:
    """One row: p95 of distinct users (nearest rank), the threshold, the share above it, the maximum; zeros count."""
    fan = nodes.select(node).join(uses.groupBy(node).agg(F.countDistinct(user).alias("n")), node, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    counts = fan.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # few distinct values, so the window is small
    every = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(every), "total": F.sum("c").over(Window.partitionBy())})
    p95 = F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * 0.95), F.col("n"))).over(Window.partitionBy())
    both_rows = ranked.withColumn("p95", p95)
    high = both_rows.agg(
        F.first("p95").alias("p95"), F.greatest(F.first("p95"), F.lit(floor)).cast("long").alias("threshold"),
        F.round(100 * F.sum(F.when(F.col("n") > F.greatest("p95", F.lit(floor)), F.col("c")).otherwise(0)) / F.sum("c"), 1).alias("high_percent"),
        F.max("n").alias("most"),
    )
    return high


def shortened(name: Column, most: int) -> Column:
    """A name and all that is left of it after up to `most` deletions: names within `most` edits share one of these."""
    once = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    found, level = F.array(name), F.array(name)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.when(F.length(x) > 0, once(x)).otherwise(F.array().cast("array<string>")))))
        found = F.concat(found, level)
    return F.array_distinct(found)


def closest_names(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """For each name the known one with 0 < distance <= most and half its length above the distance, first of ties.

    Candidates meet in a name shortened by up to `most` signs, so that the names are not compared pair by pair.
    """
    key = lambda c: F.explode(shortened(F.lower(c), most)).alias("key")
    n = names.select("name").distinct().select("name", key("name"))
    k = known.select(F.col("name").alias("other")).distinct().select("other", key("other"))
    found = n.join(k, "key").select("name", "other").distinct()
    found = found.withColumn("distance", F.levenshtein(F.lower("name"), F.lower("other"), most).cast("long"))
    found = found.filter((F.col("distance") > 0) & (F.floor(F.length("name") / 2) > F.col("distance")))
    w = Window.partitionBy("name").orderBy("distance", "other")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def first_of_both(df: DataFrame, key: str, origin: str, pos: Column, one: Column, other: Column, a: str, b: str) -> DataFrame:
    """Keys with origins of either kind, and the first of each by position."""
    out = df.groupBy(key).agg(F.min_by(origin, F.when(one, pos)).alias(a), F.min_by(origin, F.when(other, pos)).alias(b), F.bool_or(one).alias("__a"), F.bool_or(other).alias("__b"))
    return out.filter("__a AND __b").select(key, a, b)


def spelling_conflicts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys with more than one spelling, the spellings joined by commas: dynamic segment names."""
    out = df.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("s")).filter(F.size("s") > 1)
    return out.select(*keys, F.size("s").cast("long").alias("spellings"), F.array_join("s", ",").alias("names"))


def misplaced(statements: DataFrame, file: str, pos: str, directive: Column) -> DataFrame:
    """Directives after the first other statement of their file, one row each."""
    body = statements.filter(~directive).groupBy(file).agg(F.min(pos).alias("__body"))
    return statements.filter(directive).join(body, file).filter(F.col(pos) > F.col("__body")).drop("__body")


def split(findings: DataFrame, moved: Column) -> tuple[DataFrame, DataFrame]:
    """Findings that another rule takes over, and the rest: no row is in both, a null condition keeps a row."""
    flag = F.coalesce(moved, F.lit(False))
    return findings.filter(flag), findings.filter(~flag)


def drilled(forwards: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """(root, prop, leaf, depth) of props that forwards(src, prop, dst) hand on unchanged from roots(node, prop) over at
    least `least` components; a leaf hands nothing on, and depth is the shortest way."""
    from .graphs import _Seen, cut

    e = cut(forwards.select(F.col("src").alias("node"), "prop", F.col("dst").alias("next")).distinct())
    seen, depth = _Seen(roots.select(F.col("node").alias("root"), "prop", "node", F.lit(0).cast("long").alias("depth")).distinct()), 0
    while True:
        depth += 1
        step = seen.frontier.join(e, ["node", "prop"]).select("root", "prop", F.col("next").alias("node")).distinct()
        if not seen.grow(step.join(seen.rows(), ["root", "prop", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))):
            break
    inner = e.select("node", "prop").distinct()
    return seen.rows().filter(F.col("depth") >= least).join(inner, ["node", "prop"], "left_anti").select("root", "prop", F.col("node").alias("leaf"), "depth")
