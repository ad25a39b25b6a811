"""Security candidates: sinks by catalogue, provenance, bounded flows, secrets, severity, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut


def sinks(calls: DataFrame, catalogue: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(file, line, callee, literal) that catalogue(callee, rule, module, dynamic_only) names.

    A row with a module counts only in files that import it (file, module); one with dynamic_only skips literals.
    """
    hit = calls.join(catalogue, "callee").filter(~(F.col("dynamic_only") & F.col("literal")))
    free, bound = hit.filter("module IS NULL"), hit.filter("module IS NOT NULL")
    bound = bound.join(imports.select("file", "module").distinct(), ["file", "module"], "left_semi").select(*free.columns)
    return free.unionByName(bound).select("file", "line", "callee", "rule")


def tainted(flows: DataFrame, sources: DataFrame, sinks_: DataFrame, most: int = 3) -> DataFrame:
    """(source, sink, hops, confidence): sinks(node) reached from sources(node) in at most `most` flows(src, dst)."""
    seen = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("hops")).distinct())
    frontier, e = seen, flows.select("src", "dst").distinct()
    for hop in range(1, most + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long")))
        seen = cut(seen.unionByName(frontier))
    level = F.when(F.col("hops") <= 1, "high").when(F.col("hops") == 2, "medium").otherwise("low")
    out = seen.join(sinks_.select("node").distinct(), "node", "left_semi")
    return out.select("source", F.col("node").alias("sink"), "hops", level.alias("confidence"))


def severity(hot: Column, crosses: Column, entry: Column, sourced: Column, untrusted: Column) -> Column:
    """high if hot, across a boundary, or sourced and reachable from an entry; medium if sourced or untrusted; else low."""
    return F.when(hot | crosses | (entry & sourced), "high").when(sourced | untrusted, "medium").otherwise("low")


# fixed values: what makes the name of a variable public by convention, and the parts that tell of a secret all the same
PUBLIC_PREFIXES = "NEXT_PUBLIC_ VITE_ NUXT_PUBLIC_ REACT_APP_ PUBLIC_ GATSBY_ EXPO_PUBLIC_ STORYBOOK_".split()
PUBLIC_NAMES = ["NODE_ENV"]
METADATA_PARTS = "BRANCH ENVIRONMENT MODE REF SHA TAG".split()
SECRET_PARTS = "AUTH CREDENTIAL CREDENTIALS KEY PASS PASSWORD PRIVATE SECRET TOKEN".split()


def public_variable(name: Column) -> Column:
    """Whether a variable of the environment is public: by its whole name or its prefix, or as it has a part, between
    signs that are neither letters nor digits, that describes a build and none that tells of a secret."""
    has = lambda parts: F.arrays_overlap(F.split(name, "[^A-Za-z0-9]+"), F.array(*map(F.lit, parts)))
    named = name.isin(PUBLIC_NAMES) | name.rlike("^(" + "|".join(PUBLIC_PREFIXES) + ")")
    return named | (has(METADATA_PARTS) & ~has(SECRET_PARTS))


def secret_source(path: Column) -> Column:
    """Whether a member path reads a variable of the environment that isn't public."""
    name = F.regexp_extract(path, r"^(?:process\.env|import\.meta\.env)\.(.+)$", 1)
    return (name != "") & ~public_variable(name)


def stable_ids(findings: DataFrame, keys: list[str], position: list[str], suppressed: str) -> DataFrame:
    """findings with finding_id: a hash of the keys and of the place among equal ones; suppressed ones keep a place but get no id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*position))
    return findings.withColumn("finding_id", F.when(~F.col(suppressed), F.sha2(F.concat_ws("|", *keys, place.cast("string")), 256)))


def client_leaks(reachable: DataFrame, server: DataFrame) -> DataFrame:
    """reachable(root, node) of client roots whose node is a server(node) sink."""
    return reachable.join(server.select("node").distinct(), "node", "left_semi").select("root", "node")


def leak_roots(files: DataFrame, imports: DataFrame, edges: DataFrame, server_modules: list[str]) -> DataFrame:
    """(root, node, module): client roots of files(file, client_root) from which edges(src, dst) lead to a file that imports
    a server module by imports(file, module)."""
    from .graphs import _Seen

    e = cut(edges.select("src", F.col("dst").alias("next")).distinct())
    seen = _Seen(files.filter("client_root").select(F.col("file").alias("root"), F.col("file").alias("node")).distinct())
    while True:
        step = seen.frontier.join(e, F.col("node") == F.col("src")).select("root", F.col("next").alias("node")).distinct()
        if not seen.grow(step.join(seen.rows(), ["root", "node"], "left_anti")):
            break
    bad = imports.filter(F.col("module").isin(server_modules)).select(F.col("file").alias("node"), "module").distinct()
    return seen.rows().join(bad, "node").select("root", "node", "module")
