"""Resolution of import specifiers to files: candidates by strategy, equi-joined, the best strategy first.

Prefix rules (aliases, workspaces, globs) explode the leading folders of a path and join on equality, so that no rule
table has to be broadcast and nothing is compared with every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lots import lots

EXTENSIONS = ("ts", "tsx", "js", "jsx")
#: written extension -> extensions of the sources that it may stand for
ALIASES = {"js": ("ts", "tsx"), "jsx": ("tsx",), "mjs": ("mts",), "cjs": ("cts",)}


def strip_query(specifier: Column) -> Column:
    """A specifier without query and fragment; a leading '#' (a private import) stays."""
    return F.regexp_replace(specifier, r"(?<=.)[?#].*$", "")


def folder(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalise(path: Column) -> Column:
    """A slash-separated path without '.', '..' and empty segments; '..' above the root is dropped."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    empty = F.array().cast("array<string>")
    step = lambda a, p: (
        F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, empty, step), "/")


def specifier_kind(specifier: Column) -> Column:
    """relative, absolute, private, url, builtin, scoped or package."""
    s = specifier
    return (
        F.when(s.rlike(r"^\.\.?(/|$)"), "relative").when(s.startswith("/"), "absolute").when(s.startswith("#"), "private")
        .when(s.startswith("node:"), "builtin").when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "url").when(s.rlike("^@[^/]+/[^/]+"), "scoped").otherwise("package")
    )


def package_name(specifier: Column) -> Column:
    """First segment, or two after an '@'; null unless the specifier names a package."""
    name = F.regexp_extract(specifier, "^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(specifier_kind(specifier).isin("scoped", "package"), name)


def leading(path: Column) -> Column:
    """All leading folders of a path, the root as '' and the path itself too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root): the deepest root(root) that holds each path(path); paths under no root are left out."""
    up = paths.select("path").distinct().withColumn("root", F.explode(leading(F.col("path"))))
    return up.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))


def apply_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports(source, ...) with `aliased`: the longest matching prefix of aliases(prefix, target) replaced, else null.

    A prefix matches whole segments. Of equal prefixes the smallest target counts.
    """
    each = aliases.groupBy("prefix").agg(F.min("target").alias("target"))
    known = imports.select("source").distinct().withColumn("prefix", F.explode(leading(F.col("source"))))
    best = known.join(each, "prefix").groupBy("source").agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("a"))
    rest = F.expr("substring(source, length(a.prefix) + 1)")
    return imports.join(best.select("source", F.concat("a.target", rest).alias("aliased")), "source", "left")


def candidates(path: Column, extensions=EXTENSIONS) -> Column:
    """Array of (prio, strategy, path): as written, source of an output extension, added extension, index file."""
    out = [("exact", path)]
    for written, sources in ALIASES.items():
        hit = path.endswith(f".{written}")
        out += [("alias", F.when(hit, F.concat(F.regexp_replace(path, rf"\.{written}$", ""), F.lit(f".{s}")))) for s in sources]
    out += [("extension", F.concat(path, F.lit(f".{e}"))) for e in extensions]
    out += [("index", F.concat(path, F.lit(f"/index.{e}"))) for e in extensions]
    return F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(s).alias("strategy"), p.alias("path")) for i, (s, p) in enumerate(out)])


def _candidates_of(asked: DataFrame, files: DataFrame, aliases: DataFrame | None, how: str) -> DataFrame:
    """asked(dir, source, ...), different ones, with c, each candidate of theirs that is a file; how 'left': null if none."""
    columns, source = asked.columns, strip_query(F.col("source"))
    asked = apply_aliases(asked, aliases) if aliases is not None else asked.withColumn("aliased", F.lit(None).cast("string"))
    kind = specifier_kind(source)
    base = F.when(kind == "relative", normalise(F.concat_ws("/", "dir", source))).when(kind == "absolute", normalise(source))
    base = F.coalesce(base, normalise(strip_query(F.col("aliased"))))
    asked = asked.withColumn("base", base)  # a column of its own, so that each candidate does not work it out again
    # both sides meet in a path without its script extension, or without its index file: two keys a specifier, not one for
    # each candidate; which candidate it is, and the first of them, is told after the join
    bare = lambda c: F.regexp_replace(c, r"\.(ts|tsx|js|jsx|mts|cts|mjs|cjs)$", "")
    known = files.select("path").distinct().withColumn("key", F.explode(F.array_distinct(F.array("path", bare(F.col("path")), F.regexp_replace(bare(F.col("path")), "/index$", "")))))
    if how == "inner":
        tried = asked.filter("base IS NOT NULL").select(*columns, "base", F.explode(F.array_distinct(F.array("base", bare(F.col("base"))))).alias("key"))
    else:  # what can't be looked up has keys of its own, so that it doesn't meet in one lot
        place = F.coalesce("base", F.concat(F.lit("\n"), "source"))
        tried = asked.withColumn("place", place).select(*columns, "base", F.explode(F.array_distinct(F.array("place", bare(F.col("place"))))).alias("key"))
    hit = F.get(F.filter(candidates(F.col("base")), lambda c: c["path"] == F.col("path")), F.lit(0))
    return lots(tried, "key").join(known, "key", how).select(*columns, F.when(F.col("path").isNotNull(), hit).alias("c"))


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """imports(file, source) with (target, strategy): relative, root-relative and aliased specifiers; null where none.

    Each distinct pair of folder and specifier is looked up once.
    """
    asked = lots(imports.select(folder(F.col("file")).alias("dir"), "source"), "dir", "source").distinct()
    found = lots(_candidates_of(asked, files, aliases, "inner").filter("c IS NOT NULL"), "dir", "source")
    found = found.groupBy("dir", "source").agg(F.min_by(F.struct(F.col("c.path").alias("target"), F.col("c.strategy").alias("strategy")), "c.prio").alias("r"))
    asking = lots(imports.withColumn("dir", folder(F.col("file"))), "dir", "source")
    return asking.join(found.select("dir", "source", "r.*"), ["dir", "source"], "left").drop("dir").select(*imports.columns, "target", "strategy")


def _loud_paths(imports: DataFrame, silent: list[str]) -> DataFrame:
    """Imports whose specifier is a path, but for the prefixes in `silent`."""
    out = imports.filter(specifier_kind(F.col("source")).isin("relative", "absolute", "private"))
    for prefix in silent:
        out = out.filter(~F.col("source").startswith(prefix))
    return out


def unresolved(resolved: DataFrame, silent: list[str] = ()) -> DataFrame:
    """Rows of resolve() without a target whose specifier is a path, but for the prefixes in `silent`."""
    return _loud_paths(resolved.filter(F.col("target").isNull()), silent).drop("target", "strategy")


def unresolved_sites(imports: DataFrame, files: DataFrame, silent: list[str] = (), aliases: DataFrame | None = None) -> DataFrame:
    """(source, sites): specifiers of unresolved() and their number of imports.

    Imports are counted by folder and specifier before these are looked up, so that none is joined again.
    """
    each = lots(_loud_paths(imports, silent).select(folder(F.col("file")).alias("dir"), "source"), "dir", "source")
    each = each.groupBy("dir", "source").agg(F.count(F.lit(1)).alias("sites"))
    tried = lots(_candidates_of(each, files, aliases, "left"), "dir", "source").groupBy("dir", "source").agg(F.max("sites").alias("sites"), F.bool_or(F.col("dir").isNotNull() & F.col("c").isNotNull()).alias("found"))
    return tried.filter("NOT found").groupBy("source").agg(F.sum("sites").alias("sites"))


def pattern_imports(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(file, path) of dynamic patterns(file, prefix, suffix) and the files that start and end so, by the prefix's folder."""
    f = files.select("path").distinct().withColumn("dir", F.explode(leading(folder(F.col("path")))))
    p = patterns.withColumn("dir", folder(F.col("prefix")))
    hit = F.col("path").startswith(F.col("prefix")) & F.col("path").endswith(F.col("suffix")) & (F.length("path") >= F.length("prefix") + F.length("suffix"))
    return p.join(f, "dir").filter(hit).select("file", "path").distinct()


def export_targets(asked: DataFrame, exports: DataFrame, conditions: list[str]) -> DataFrame:
    """(package, subpath, target) by the exports map (package, key, ordinal, condition, target) of packages.

    An exact key is taken before one with '*', a longer one before a shorter one; of its conditions the first by
    ordinal that is in `conditions`. A null target shuts the subpath off: the row stays, with a null target.
    """
    e = exports.filter(F.col("condition").isin(*conditions))
    star = F.instr("key", "*")
    e = e.withColumns({"head": F.when(star > 0, F.expr("substring(key, 1, instr(key, '*') - 1)")), "tail": F.when(star > 0, F.expr("substring(key, instr(key, '*') + 1)"))})
    j = asked.select("package", "subpath").distinct().join(e, "package")
    fits = F.col("subpath").startswith(F.col("head")) & F.col("subpath").endswith(F.col("tail")) & (F.length("subpath") >= F.length("head") + F.length("tail"))
    j = j.filter((F.col("key") == F.col("subpath")) | fits)
    middle = F.expr("substring(subpath, length(head) + 1, length(subpath) - length(head) - length(tail))")
    target = F.when(F.col("head").isNull(), F.col("target")).otherwise(F.replace("target", F.lit("*"), middle))
    order = F.struct(F.col("head").isNotNull(), -F.length(F.coalesce("head", "key")), F.col("ordinal"))
    return j.groupBy("package", "subpath").agg(F.min_by(F.struct(target.alias("target")), order).alias("t")).select("package", "subpath", "t.target")


def output_to_source(path: Column, out_dir: str, root_dir: str) -> Column:
    """The source of a built file: the output folder replaced, .js as .ts, .d.ts as .ts; null elsewhere."""
    rest = F.concat(F.lit(f"{root_dir}/"), F.substring(path, F.lit(len(out_dir) + 2), F.length(path)))
    return F.when(path.startswith(f"{out_dir}/"), F.regexp_replace(rest, r"(\.d\.ts|\.js)$", ".ts"))


def package_usage(imports: DataFrame) -> DataFrame:
    """(package, file) for each package that a file imports."""
    return imports.select(package_name(F.col("source")).alias("package"), "file").filter("package IS NOT NULL").distinct()


def condition_edges(asked: DataFrame, imports_map: DataFrame, files: DataFrame) -> DataFrame:
    """(file, condition, target): private specifiers asked(file, source) by all conditions of a map (key, condition,
    target), not just the first: each target that is a file is an edge."""
    j = asked.join(imports_map.select(F.col("key").alias("source"), "condition", "target"), "source").select("file", "condition", normalise(F.col("target")).alias("target"))
    return j.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("file", "condition", "target").distinct()


def in_package_root(asked: DataFrame, roots: DataFrame, files: DataFrame, source_dir: str = "src") -> DataFrame:
    """(file, source, target): a specifier below a package's own root, looked up under the source folder of that root."""
    own = owners(asked.select(F.col("file").alias("path")), roots).withColumnRenamed("path", "file")
    base = normalise(F.concat_ws("/", "root", F.lit(source_dir), "source"))
    tried = asked.join(own, "file").withColumn("base", base).select("file", "source", F.explode(candidates(F.col("base"))).alias("c")).filter("c.path IS NOT NULL").select("file", "source", "c.*")
    found = tried.join(files.select("path").distinct(), "path").groupBy("file", "source")
    return found.agg(F.min_by("path", "prio").alias("target"))


def stylesheet_targets(asked: DataFrame, load_paths: list[str], files: DataFrame) -> DataFrame:
    """(file, source, target): a stylesheet's import by the load paths in order; in each, as written, with an underscore
    before its name, with .scss or .sass, and as a folder's index."""
    name = F.regexp_extract("source", "[^/]+$", 0)
    head = F.regexp_replace("source", "[^/]+$", "")
    forms = [F.col("source"), *[F.concat(head, F.lit(u), name, F.lit(e)) for e in (".scss", ".sass") for u in ("", "_")]]
    forms += [F.concat(F.col("source"), F.lit(f"/{u}index.scss")) for u in ("", "_")]
    tried = [F.struct(F.lit(i * len(forms) + k).alias("prio"), normalise(F.concat_ws("/", F.lit(p), f)).alias("path")) for i, p in enumerate(load_paths) for k, f in enumerate(forms)]
    each = asked.select("file", "source", F.explode(F.array(*tried)).alias("c")).select("file", "source", "c.*")
    return each.join(files.select("path").distinct(), "path").groupBy("file", "source").agg(F.min_by("path", "prio").alias("target"))


def workspace_targets(asked: DataFrame, workspaces: DataFrame, files: DataFrame, assets: bool = False) -> DataFrame:
    """(file, source, target): a specifier that names a package of workspaces(package, root): the rest of it below the
    root, or the root's index. assets: only files that aren't scripts, as written."""
    name = package_name(F.col("source"))
    rest = F.expr("substring(source, length(package) + 2)")
    j = asked.withColumn("package", name).join(workspaces, "package").withColumn("base", normalise(F.concat_ws("/", "root", rest)))
    if assets:
        j = j.filter(~F.col("base").rlike(r"\.[cm]?[jt]sx?$")).select("file", "source", F.lit(0).alias("prio"), F.col("base").alias("path"))
    else:
        j = j.select("file", "source", F.explode(candidates(F.col("base"))).alias("c")).filter("c.path IS NOT NULL").select("file", "source", "c.prio", "c.path")
    return j.join(files.select("path").distinct(), "path").groupBy("file", "source").agg(F.min_by("path", "prio").alias("target"))


def base_url_folders(asked: DataFrame, base: str, files: DataFrame) -> DataFrame:
    """asked(file, source) whose first segment is a folder or file right below the base url: no packages."""
    prefix = f"{base}/" if base else ""
    rest = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    top = files.filter(F.col("path").startswith(prefix)).select(F.regexp_replace(F.substring_index(rest, "/", 1), r"\.[^.]+$", "").alias("top")).distinct()
    return asked.join(top, F.substring_index("source", "/", 1) == F.col("top"), "left_semi")


def config_scopes(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config): the deepest of configs(config, root, include, exclude) that a file is in: under the root, its rest
    like the include pattern and not like the exclude pattern, both regular expressions and null for all and none."""
    up = files.select("path").distinct().withColumn("root", F.explode(leading(folder(F.col("path")))))
    j = up.join(configs, "root").withColumn("rest", F.expr("substring(path, length(root) + CASE WHEN root = '' THEN 1 ELSE 2 END)"))
    fits = F.coalesce(F.expr("rlike(rest, include)"), F.lit(True)) & ~F.coalesce(F.expr("rlike(rest, exclude)"), F.lit(False))
    return j.filter(fits).groupBy("path").agg(F.max_by("config", F.struct(F.length("root"), "config")).alias("config"))


def auto_imports(names: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """(file, name, target): names(file, name) used without an import, by convention of the file of that name in some
    folders, the earlier folder first; a file doesn't import itself."""
    place = F.coalesce(*[F.when(folder(F.col("path")).isin(d), F.lit(i)) for i, d in enumerate(folders)])
    known = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), place.alias("prio")).filter("prio IS NOT NULL AND name <> ''")
    j = names.select("file", "name").distinct().join(known, "name").filter("file <> path")
    return j.groupBy("file", "name").agg(F.min_by("path", F.struct("prio", "path")).alias("target"))


def runtime_edges(files: DataFrame, runtime: DataFrame) -> DataFrame:
    """(file, package): files(path, uses_markup) that markup makes import the runtime of their root, runtime(root, package)."""
    used = files.filter("uses_markup").select("path")
    own = owners(used, runtime.select("root"))
    return own.join(runtime, "root").select(F.col("path").alias("file"), F.concat("package", F.lit("/jsx-runtime")).alias("package")).distinct()


def package_entries(packages: DataFrame, files: DataFrame) -> DataFrame:
    """(package, target): the file of a package's first declared entry that is there: packages(package, root, entries)."""
    each = packages.select("package", "root", F.posexplode("entries").alias("i", "entry"))
    each = each.select("package", "i", F.explode(candidates(normalise(F.concat_ws("/", "root", "entry")))).alias("c")).filter("c.path IS NOT NULL")
    j = each.select("package", "i", "c.prio", "c.path").join(files.select("path").distinct(), "path")
    return j.groupBy("package").agg(F.min_by("path", F.struct("i", "prio")).alias("target"))


def outside_project(targets: DataFrame, roots: DataFrame) -> DataFrame:
    """targets(path) that lie under no root(root) of the project."""
    inside = owners(targets.select("path"), roots).select("path")
    return targets.join(inside, "path", "left_anti")


def rendered_components(renders: DataFrame, declared: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, child, target_file): renders(file, child) by a component of the same file, declared(file, name), else by
    what imports(file, local, target) brings in under the name; null where neither is known."""
    own = declared.select("file", F.col("name").alias("child"), F.col("file").alias("own")).distinct()
    other = imports.groupBy("file", F.col("local").alias("child")).agg(F.min("target").alias("other"))
    j = renders.select("file", "child").distinct().join(own, ["file", "child"], "left").join(other, ["file", "child"], "left")
    return j.select("file", "child", F.coalesce("own", "other").alias("target_file"))
