"""Rules over components, routes, effects, zones and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def never_matched(declared: DataFrame, used: DataFrame, keys: list[str], abstain: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Distinct declared keys without a use: props unread, emits never emitted, events never listened to, injected keys
    never provided, components never rendered. Those whose column `by` is in abstain(by) are left out."""
    left = declared.select(*keys).distinct().join(used.select(*keys).distinct(), keys, "left_anti")
    return left if abstain is None else left.join(abstain.select(by).distinct(), by, "left_anti")


def unless_any(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """findings, or none of them if flags has a row: the whole project abstains."""
    return findings if flags.isEmpty() else findings.limit(0)


def unused_inputs(declared: DataFrame, used: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(owner, name) of inputs or outputs declared(owner, name) that neither the owner nor a subclass,
    subclasses(base, class), uses."""
    own = used.select("owner", "name")
    below = used.withColumnRenamed("owner", "class").join(subclasses.select("base", "class"), "class").select(F.col("base").alias("owner"), "name")
    return never_matched(declared, own.unionByName(below), ["owner", "name"])


def absent_props(props: DataFrame, sites: DataFrame, passed: DataFrame) -> DataFrame:
    """(component, prop, sites): optional props(component, prop) that no call site, of one or more sites(component, site),
    passes; passed(component, prop). A component that is called nowhere has no evidence and isn't reported."""
    seen = sites.groupBy("component").agg(F.countDistinct("site").alias("sites"))
    left = props.select("component", "prop").distinct().join(passed.select("component", "prop").distinct(), ["component", "prop"], "left_anti")
    return left.join(seen, "component").select("component", "prop", "sites")


def effect_findings(layers: DataFrame, provided: DataFrame, errors: DataFrame, raised: DataFrame, caught: DataFrame) -> DataFrame:
    """(rule, name): layers never provided, tagged errors never raised, tags caught but never raised; each has (name)."""
    names = lambda df: df.select("name").distinct()
    rule = lambda df, text: df.select(F.lit(text).alias("rule"), "name")
    out = rule(names(layers).join(names(provided), "name", "left_anti"), "unused-effect-layer")
    out = out.unionByName(rule(names(errors).join(names(raised), "name", "left_anti"), "unused-tagged-error"))
    return out.unionByName(rule(names(caught).join(names(raised), "name", "left_anti"), "unproduced-catch-tag"))


def thin_wrappers(components: DataFrame, renders: DataFrame, abstain: DataFrame) -> DataFrame:
    """(component, child): components(component, spread, complexity, hooks) whose body is one child, rendered once, that
    gets all props by spread; not those with hooks or branches, nor those in abstain(component), nor that render themselves."""
    one = renders.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("child")).filter("n = 1")
    found = components.filter("spread AND complexity <= 1 AND hooks = 0").join(one, "component").join(abstain.select("component").distinct(), "component", "left_anti")
    return found.filter("child <> component").select("component", "child")


def duplicate_shapes(props: DataFrame, denied: list[str], abstain: DataFrame, least_props: int = 4, least_members: int = 3, least_files: int = 2) -> DataFrame:
    """(shape, members, files): equal sets of significant props(component, file, prop) of several components and files.

    Props in `denied` are no part of a shape; components in abstain(component), of which not all props are known, have none.
    """
    known = props.join(abstain.select("component").distinct(), "component", "left_anti").filter(~F.col("prop").isin(denied))
    shape = known.groupBy("component", "file").agg(F.array_sort(F.collect_set("prop")).alias("s")).filter(F.size("s") >= least_props)
    shape = shape.groupBy(F.array_join("s", ",").alias("shape")).agg(F.countDistinct("component", "file").alias("members"), F.countDistinct("file").alias("files"))
    return shape.filter((F.col("members") >= least_members) & (F.col("files") >= least_files))


def colliding_routes(routes: DataFrame, keys: list[str], member: str, suppressed: str) -> DataFrame:
    """(keys, member, siblings): members of a key that others have too, and the others joined by commas.

    A suppressed member has no row of its own but stands among the siblings of the others.
    """
    key = Window.partitionBy(*keys)
    found = routes.select(*keys, member, suppressed).distinct().withColumn("__all", F.collect_list(member).over(key)).filter((F.size("__all") >= 2) & ~F.col(suppressed))
    others = F.array_sort(F.array_remove("__all", F.col(member)))
    return found.select(*keys, member, F.array_join(F.transform(others, lambda x: x.cast("string")), ",").alias("siblings"))


def component_facts(components: DataFrame, sites: DataFrame, props: DataFrame, hooks: DataFrame) -> DataFrame:
    """(component, sites, parents, props, hooks): counts of each component, zeros included."""
    s = sites.groupBy("component").agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("parent").alias("parents"))
    p = props.groupBy("component").agg(F.countDistinct("prop").alias("props"))
    h = hooks.groupBy("component").agg(F.count(F.lit(1)).alias("hooks"))
    out = components.select("component").distinct().join(s, "component", "left").join(p, "component", "left").join(h, "component", "left")
    return out.select("component", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sites", "parents", "props", "hooks")])


def gated_population(roster: DataFrame, severity: DataFrame) -> DataFrame:
    """(rule, roster, reported): members of roster(rule, member, suppressed) where severity(rule, level) isn't off; a
    suppressed member counts in the roster but isn't reported."""
    on = severity.filter("level <> 'off'").select("rule")
    found = roster.join(on, "rule").groupBy("rule")
    return found.agg(F.countDistinct("member").alias("roster"), F.countDistinct(F.when(~F.col("suppressed"), F.col("member"))).alias("reported"))


def invalid_client_exports(exports: DataFrame, client: DataFrame, server_names: list[str]) -> DataFrame:
    """(file, name): exports(file, name) with a name that only servers may export, in client files."""
    return exports.filter(F.col("name").isin(server_names)).join(client.select("file").distinct(), "file", "left_semi").select("file", "name").distinct()


def server_only(files: DataFrame, directives: DataFrame, imports: DataFrame, packages: DataFrame, with_directive: bool = True) -> DataFrame:
    """files(file) that have a server directive or import a server-only package themselves; the second form of the rule
    ignores directives."""
    found = imports.join(packages.select("package").distinct(), "package", "left_semi").select("file")
    if with_directive:
        found = found.unionByName(directives.select("file"))
    return files.select("file").distinct().join(found.distinct(), "file", "left_semi")


def uncovered_files(files: DataFrame, zoned: DataFrame, allowed: DataFrame) -> DataFrame:
    """files(file) in no zone and not allowed to be; whether they are reachable doesn't matter."""
    return files.select("file").join(zoned.select("file").unionByName(allowed.select("file")).distinct(), "file", "left_anti")


def forbidden_calls(calls: DataFrame, zones: DataFrame, imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """(file, callee, zone, pattern): calls(file, callee) from a zoned file, zones(file, zone), that a pattern of
    patterns(zone, pattern, ordinal) forbids, as written or by its canonical path; the first pattern counts.

    Canonical: the first segment of the callee stands for what imports(file, local, package, imported, type_only) say;
    a bare package only, without `node:`, and no type-only import. A pattern is a path, or a path and `.*` for all below.
    """
    local, rest = F.substring_index("callee", ".", 1), F.expr("substring(callee, length(substring_index(callee, '.', 1)) + 1)")
    bare = imports.filter(~F.col("package").rlike(r"^[./#]") & ~F.col("type_only"))
    bare = bare.select("file", "local", F.regexp_replace("package", "^node:", "").alias("package"), "imported")
    named = F.when(F.col("imported").isNull(), F.col("package")).otherwise(F.concat_ws(".", "package", "imported"))
    found = calls.select("file", "callee").distinct().join(zones, "file").withColumn("local", local)
    found = found.join(bare, ["file", "local"], "left").withColumn("canonical", F.concat(named, rest))
    hit = lambda c: (F.col(c) == F.col("pattern")) | (F.col("pattern").endswith(".*") & F.startswith(F.col(c), F.expr("left(pattern, length(pattern) - 1)")))
    found = found.join(F.broadcast(patterns), "zone").filter(hit("callee") | F.coalesce(hit("canonical"), F.lit(False)))
    return found.groupBy("file", "callee", "zone").agg(F.min_by("pattern", "ordinal").alias("pattern"))


def policy_violations(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, name, rule): facts(file, kind, name) that a rule pack bans by rules(rule, kind, prefix): the same name, or
    a name below it after a dot or slash."""
    below = F.filter(
        F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.when((i == F.length("name")) | F.substring(F.col("name"), i + 1, F.lit(1)).isin(".", "/"), F.substring(F.col("name"), F.lit(1), i))),
        lambda x: x.isNotNull(),
    )
    found = facts.select("file", "kind", "name").distinct().filter("name <> ''").select("*", F.explode(below).alias("prefix"))
    return found.join(F.broadcast(rules), ["kind", "prefix"]).select("file", "name", "rule").distinct()


def nearest_name(names: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """(name, rank, nearest): up to `most` of a short list of known names for each name: one that it begins with or that
    begins with it first, then by distance and name."""
    near = F.array(*[F.struct(
        F.when(F.startswith(F.lower("name"), F.lit(k.lower())) | F.startswith(F.lit(k.lower()), F.lower("name")), 0).otherwise(1).alias("part"),
        F.levenshtein(F.lower("name"), F.lit(k.lower())).alias("distance"), F.lit(k).alias("nearest"),
    ) for k in known])
    found = names.select("name").distinct().select("name", F.posexplode(F.slice(F.array_sort(near), 1, most)).alias("rank", "x"))
    return found.select("name", (F.col("rank") + 1).cast("long").alias("rank"), "x.nearest")
