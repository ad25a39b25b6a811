"""Rules over declared and used dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused_dependencies(deps: DataFrame, uses: DataFrame, credits: DataFrame) -> DataFrame:
    """(workspace, name, rule) of deps(workspace, name, kind) that nothing uses(name) or credits(name).

    One computation, three rules: of production, development and optional dependencies; peers aren't reported.
    """
    rule = F.when(F.col("kind") == "prod", "unused-dependency").when(F.col("kind") == "dev", "unused-dev-dependency").when(F.col("kind") == "optional", "unused-optional-dependency")
    left = deps.join(uses.select("name").unionByName(credits.select("name")).distinct(), "name", "left_anti")
    return left.select("workspace", "name", rule.alias("rule")).filter("rule IS NOT NULL").distinct()


def unlisted_dependencies(uses: DataFrame, deps: DataFrame, ignored: DataFrame) -> DataFrame:
    """(workspace, name, uses, sites): uses(workspace, name, site) that the workspace neither declares nor ignores.

    sites: the sorted files, joined by commas; ignored(workspace, name) counts for its own workspace only.
    """
    known = deps.select("workspace", "name").unionByName(ignored.select("workspace", "name")).distinct()
    left = uses.join(known, ["workspace", "name"], "left_anti").groupBy("workspace", "name")
    sites = F.array_join(F.transform(F.array_sort(F.collect_set("site")), lambda x: x.cast("string")), ",")
    return left.agg(F.count(F.lit(1)).alias("uses"), sites.alias("sites"))


def unlisted_binaries(scripts: DataFrame, provided: DataFrame, deps: DataFrame, builtin: list[str]) -> DataFrame:
    """(workspace, binary) of scripts(workspace, binary) that no dependency of the workspace provides(name, binary)."""
    known = deps.join(provided, "name").select("workspace", "binary").distinct()
    return scripts.select("workspace", "binary").distinct().filter(~F.col("binary").isin(builtin)).join(known, ["workspace", "binary"], "left_anti")


def narrow_dependencies(deps: DataFrame, uses: DataFrame, production: bool) -> DataFrame:
    """(name, rule): production dependencies all of whose uses(name, type_only, is_test) are narrow.

    Type-only ones are reported in production runs, test-only ones in the others, as each run sees but its own files.
    """
    flag, rule = ("type_only", "type-only-dependency") if production else ("is_test", "test-only-dependency")
    always = uses.groupBy("name").agg(F.bool_and(flag).alias("a")).filter("a").select("name")
    return deps.filter("kind = 'prod'").select("name").distinct().join(always, "name", "left_semi").select("name", F.lit(rule).alias("rule"))


def dev_in_production(deps: DataFrame, uses: DataFrame) -> DataFrame:
    """(workspace, name, files): development dependencies, declared nowhere else in their workspace, that production
    code uses for a value: uses(name, file, type_only, is_test)."""
    only = deps.groupBy("workspace", "name").agg(F.bool_and(F.col("kind") == "dev").alias("dev")).filter("dev")
    live = uses.filter("NOT type_only AND NOT is_test").groupBy("name").agg(F.countDistinct("file").alias("files"))
    return only.join(live, "name").select("workspace", "name", "files")


def override_findings(overrides: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, rule) of overrides(name, spec): a spec that is no version, range, tag or alias, or a name that nothing
    resolves to by resolved(name)."""
    valid = F.coalesce(F.col("spec"), F.lit("")).rlike(r"^([~^]|[<>]=?)?\d+(\.(\d+|x|\*)){0,2}([-+][\w.-]+)?$|^(latest|next|\*)$|^npm:.+$|^\$.+$")
    unused = overrides.filter(valid).join(resolved.select("name").distinct(), "name", "left_anti")
    bad = overrides.filter(~valid).select("name", F.lit("misconfigured-dependency-override").alias("rule"))
    return bad.unionByName(unused.select("name", F.lit("unused-dependency-override").alias("rule"))).distinct()


def convention_uses(names: DataFrame, conventions: DataFrame) -> DataFrame:
    """(package, names): packages that names(name) use by convention; conventions(prefix, package) with the longest
    prefix of the name counts."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    found = names.select("name").distinct().filter("name <> ''").select("name", F.explode(prefixes).alias("prefix")).join(F.broadcast(conventions), "prefix")
    best = found.groupBy("name").agg(F.max_by("package", F.length("prefix")).alias("package"))
    return best.groupBy("package").agg(F.count(F.lit(1)).alias("names"))


def catalog_findings(groups: DataFrame, entries: DataFrame, references: DataFrame) -> DataFrame:
    """(group, name, rule): entries(group, name) that nothing references(group, name), references without an entry,
    and groups(group) without entries."""
    e, r = entries.select("group", "name").distinct(), references.select("group", "name").distinct()
    rule = lambda df, name: df.select("group", "name", F.lit(name).alias("rule"))
    empty = groups.select("group").distinct().join(e.select("group").distinct(), "group", "left_anti").withColumn("name", F.lit(None).cast("string"))
    found = rule(e.join(r, ["group", "name"], "left_anti"), "unused-catalog-entry")
    found = found.unionByName(rule(r.join(e, ["group", "name"], "left_anti"), "unresolved-catalog-reference"))
    return found.unionByName(rule(empty, "empty-catalog-group"))
