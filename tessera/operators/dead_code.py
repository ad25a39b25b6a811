"""Unused files, exports, types and members, with the credits that keep them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import reach, subclass_index

# fixed values: names that frameworks call themselves
LIFECYCLE = {
    "angular": (
        "ngOnInit ngOnDestroy ngOnChanges ngDoCheck ngAfterContentInit ngAfterContentChecked ngAfterViewInit ngAfterViewChecked ngAcceptInputType "
        "canActivate canDeactivate canActivateChild canMatch resolve intercept transform validate registerOnChange registerOnTouched writeValue setDisabledState"
    ).split(),
    "react": (
        "render componentDidMount componentDidUpdate componentWillUnmount shouldComponentUpdate getSnapshotBeforeUpdate getDerivedStateFromProps "
        "getDerivedStateFromError componentDidCatch componentWillMount componentWillReceiveProps componentWillUpdate UNSAFE_componentWillMount "
        "UNSAFE_componentWillReceiveProps UNSAFE_componentWillUpdate getChildContext contextType"
    ).split(),
}


def unused_files(files: DataFrame, edges: DataFrame, refs: DataFrame, re_exports: DataFrame) -> DataFrame:
    """(file, suppressed) of files(file, is_entry, is_config, is_page, exists, suppressed) that nothing live needs.

    A file is reported if no entry reaches it over edges(src, dst) and it is none itself, it is neither a config file
    nor a page, it exists, no reachable file imports it or refers to an export of it by refs(from_file, file), and it
    re-exports, by re_exports(file, source), no reachable source. Suppressed ones are marked, so that they can be told.
    """
    live = reach(edges, files.filter("is_entry").select(F.col("file").alias("node"))).select("node")
    by = lambda df, on, of: df.join(live.withColumnRenamed("node", on), on, "left_semi").select(F.col(of).alias("file"))
    kept = live.select(F.col("node").alias("file")).unionByName(by(edges, "src", "dst")).unionByName(by(refs, "from_file", "file"))
    kept = kept.unionByName(by(re_exports, "source", "file"))
    left = files.filter("NOT is_entry AND NOT is_config AND NOT is_page AND exists")
    return left.join(kept.distinct(), "file", "left_anti").select("file", "suppressed")


def unused_exports(exports: DataFrame, refs: DataFrame, credits: DataFrame, type_credits: DataFrame) -> DataFrame:
    """(export, rule) of exports(export, is_type, suppressed) without refs(export) or credits(export).

    Types are a rule of their own, and type_credits(export), of types that pair with a schema or back a signature,
    count for them alone. Suppressed exports are left out.
    """
    left = exports.filter("NOT suppressed").join(refs.select("export").unionByName(credits.select("export")).distinct(), "export", "left_anti")
    types = left.filter("is_type").join(type_credits.select("export").distinct(), "export", "left_anti")
    rule = lambda df, name: df.select("export", F.lit(name).alias("rule"))
    return rule(left.filter("NOT is_type"), "unused-export").unionByName(rule(types, "unused-type"))


def export_credits(exports: DataFrame, refs: DataFrame, stars: DataFrame, targets: DataFrame, mocks: DataFrame) -> DataFrame:
    """(export, reason): what keeps exports(export, file, name) without a reference of their own, one row a reason.

    stars(file, source): entry files that re-export all of a source; targets(file): files that a package's conditions
    name; mocks(file, of): files that stand in for another, and keep the names that are used of it; and exports of one
    file and name keep each other, as a declaration and its value do.
    """
    used = refs.select("export").distinct()
    keep = lambda df, reason: df.select("export", F.lit(reason).alias("reason"))
    star = exports.join(stars.select(F.col("source").alias("file")).distinct(), "file", "left_semi")
    target = exports.join(targets.select("file").distinct(), "file", "left_semi")
    names = exports.join(used, "export", "left_semi").select("file", "name", F.col("export").alias("other"))
    sibling = exports.join(names.groupBy("file", "name").agg(F.countDistinct("other").alias("n"), F.min("other").alias("other")), ["file", "name"])
    sibling = sibling.filter((F.col("n") > 1) | (F.col("other") != F.col("export")))
    mocked = mocks.join(names.select(F.col("file").alias("of"), "name").distinct(), "of").select("file", "name").distinct()
    mock = exports.join(mocked, ["file", "name"], "left_semi")
    found = keep(star, "star-entry").unionByName(keep(target, "condition-target")).unionByName(keep(sibling, "declaration-sibling"))
    return found.unionByName(keep(mock, "manual-mock")).distinct()


def deprecated_in_use(exports: DataFrame, refs: DataFrame, live: DataFrame) -> DataFrame:
    """(export, uses, files, first_line): deprecated exports with a reference from a live(file), and where from."""
    found = refs.join(live.select(F.col("file").alias("from_file")).distinct(), "from_file", "left_semi")
    found = found.join(exports.filter("deprecated").select("export"), "export").groupBy("export")
    return found.agg(F.count(F.lit(1)).alias("uses"), F.array_join(F.array_sort(F.collect_set("from_file")), ",").alias("files"), F.min("line").alias("first_line"))


def private_type_leaks(signatures: DataFrame, types: DataFrame) -> DataFrame:
    """(file, export, type) of signatures(file, export, type) that name a type(file, type, exported) private to the file."""
    private = types.groupBy("file", "type").agg(F.bool_or("exported").alias("e")).filter("NOT e").select("file", "type")
    return signatures.select("file", "export", "type").distinct().join(private, ["file", "type"], "left_semi")


def fluent_accesses(chains: DataFrame) -> DataFrame:
    """(owner, member): each step of a chain of calls chains(owner, path) is an access to its owner."""
    return chains.select("owner", F.explode("path").alias("member")).distinct()


def typed_accesses(props: DataFrame, accesses: DataFrame) -> DataFrame:
    """(owner, member): accesses(holder, prop, member) through props(holder, prop, owner) that hold another class."""
    return accesses.join(props, ["holder", "prop"]).select("owner", "member").distinct()


def probed_members(members: DataFrame, probes: DataFrame) -> DataFrame:
    """(owner, member): a probe by name, of probes(member), credits the members of all owners that have the name."""
    return members.join(probes.select("member").distinct(), "member", "left_semi").select("owner", "member").distinct()


def inherited_accesses(accesses: DataFrame, heritage: DataFrame) -> DataFrame:
    """accesses(owner, member) and what they credit up and down heritage(class, base): base and subclasses share names."""
    pairs = subclass_index(heritage)
    down = accesses.join(pairs.select(F.col("base").alias("owner"), F.col("class").alias("to")), "owner").select(F.col("to").alias("owner"), "member")
    up = accesses.join(pairs.select(F.col("class").alias("owner"), F.col("base").alias("to")), "owner").select(F.col("to").alias("owner"), "member")
    return accesses.select("owner", "member").unionByName(down).unionByName(up).distinct()


def unused_members(members: DataFrame, accesses: DataFrame, framework: str | None = None) -> DataFrame:
    """members(owner, member, ...) without an access; names that the framework calls itself are used."""
    left = members.join(accesses.select("owner", "member").distinct(), ["owner", "member"], "left_anti")
    return left.filter(~F.col("member").isin(LIFECYCLE[framework])) if framework else left


def production_excluded(edges: DataFrame, excluded: DataFrame, production: DataFrame) -> DataFrame:
    """(src, dst): edges from a production(file) to a file that production leaves out, excluded(file)."""
    found = edges.select("src", "dst").distinct().join(production.select(F.col("file").alias("src")).distinct(), "src", "left_semi")
    return found.join(excluded.select(F.col("file").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def off_public_surface(findings: DataFrame, public: DataFrame) -> DataFrame:
    """findings(file, ...) that aren't on a file of public(file)."""
    return findings.join(public.select("file").distinct(), "file", "left_anti")


def check_status(checks: DataFrame, measured: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule, findings, status): a rule without findings is clean if something was measured, else unconfigured."""
    m, n = measured.groupBy("rule").agg(F.count(F.lit(1)).alias("m")), findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    found = checks.select("rule").distinct().join(m, "rule", "left").join(n, "rule", "left")
    count = F.coalesce("n", F.lit(0)).cast("long")
    return found.select("rule", count.alias("findings"), F.when(count > 0, "findings").when(F.col("m") > 0, "clean").otherwise("unconfigured").alias("status"))


def export_actions(findings: DataFrame, hints: DataFrame) -> DataFrame:
    """(export, action): a file with hints(file, action) is mended in the config, by its first action, else by an edit."""
    first = hints.groupBy("file").agg(F.min("action").alias("action"))
    return findings.join(first, "file", "left").select("export", F.coalesce("action", F.lit("edit")).alias("action"))
