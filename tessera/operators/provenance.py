"""Where the values that a call names come from: origins through imports, re-exports and stars, and who may make proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import cut

#: an origin that can't be told, and one that is declared nowhere
UNKNOWN, MISSING = "?", "-"
#: keys of a level, at most, that go to the bindings instead of the bindings being dealt out for them
FEW_KEYS = 50_000


KEY = ["file", "scope", "symbol"]


def _text(key: str) -> Column:
    return F.col(key).cast("string")


def _path(head: str, rest: str) -> Column:
    """The dotted path of a name and the members after it."""
    return F.concat_ws(".", F.nullif(head, F.lit("")), F.nullif(rest, F.lit("")))


def _steps(keys: DataFrame, bindings: DataFrame) -> DataFrame:
    """(file, scope, symbol, next_file, next_scope, next_symbol, origin) of keys(file, scope, symbol): one step towards
    where each is made; origin is null where another key follows.

    Names that a file exports hide what its stars bring, and a star never brings `default`.
    """
    head, rest = F.substring_index("symbol", ".", 1), F.expr("substring(symbol, length(substring_index(symbol, '.', 1)) + 2)")
    named = keys.withColumns({"name": head, "rest": rest}).join(bindings.filter("name <> '*'"), ["file", "scope", "name"])
    here = named.select(*KEY).distinct()
    stars = keys.filter(F.col("scope") == "export").filter(head != "default").join(here, KEY, "left_anti")
    stars = stars.join(bindings.filter("name = '*'").select("file", "scope", "source", "target"), ["file", "scope"])
    inside = F.col("source").isNull() & F.col("target").isNull()
    on = F.when(F.col("imported") == "*", F.nullif("rest", F.lit(""))).when(F.col("imported").isNotNull(), _path("imported", "rest")).otherwise(F.col("symbol"))
    columns = [*KEY, "source", "target", "imported", "on"]
    step = named.withColumn("on", on).select(*columns)
    step = step.unionByName(stars.withColumns({"imported": F.lit("*"), "on": F.col("symbol")}).select(*columns))
    far = F.when(F.col("on").isNull() | (F.col("target").isNull() & F.col("source").rlike(r"^[./#]")), UNKNOWN).when(F.col("target").isNull(), F.concat_ws("#", "source", "on"))
    origin = F.when(~inside, far).when(F.col("imported").isNull(), F.concat_ws("#", "file", "symbol"))
    place = F.when(inside, F.col("file")).otherwise(F.col("target")).alias("next_file")
    scope = F.when(inside, "local").otherwise("export").alias("next_scope")
    out = step.select(*KEY, place, scope, F.col("on").alias("next_symbol"), origin.alias("origin")).distinct()
    nothing = {f"next_{c}": F.lit(None).cast("string") for c in KEY}
    ends = F.when(F.col("scope") == "local", F.concat_ws("#", "file", "symbol")).otherwise(MISSING)
    lost = keys.join(out.select(*KEY).distinct(), KEY, "left_anti").withColumns({**nothing, "origin": ends})
    return out.unionByName(lost)


def value_origins(wanted: DataFrame, bindings: DataFrame, depth: int = 128) -> DataFrame:
    """(file, symbol, origin) of wanted(file, symbol), dotted paths as the files write them.

    bindings(file, scope, name, imported, source, target): scope 'local' is an import, 'export' an export or a re-export
    of a name. It stands for `imported` of the file `target`, or of the package `source` where target is null, or, where
    both are null, for the file's own local `imported` (null: a value without a name). The exported name '*' is a star,
    imported '*' a whole module. A local that isn't imported is made where it stands.

    An origin is `package#path` or `file#path`; MISSING if no file on the way exports it; UNKNOWN if ways lead to
    different origins, a way goes round or has more than `depth` steps, a whole module is meant, or a relative path has
    no file. MISSING beside another origin counts for nothing.

    Keys are followed level by level, each looked up once however many ask for it; then origins are handed back from
    the ends, so keys that wait for themselves are never told. Rows without a file or a symbol have no result, repeated
    rows count once; uses as types alone belong to neither table.
    """
    b = bindings.filter("file IS NOT NULL AND name IS NOT NULL")
    b = cut(b.select(_text("file").alias("file"), "scope", "name", "imported", "source", _text("target").alias("target")).distinct())
    # what is read again is written once: the wanted names, and each level's new keys, which take all edges to be told
    asked = cut(wanted.select(_text("file").alias("file"), "symbol").filter("file IS NOT NULL AND symbol <> ''").distinct())
    new, edges = asked.select("file", F.lit("local").alias("scope"), "symbol"), None
    for _ in range(depth):
        step = cut(_steps(new, b))
        edges = step if edges is None else edges.unionByName(step)
        reached = step.filter("origin IS NULL").select(*[F.col(f"next_{c}").alias(c) for c in KEY]).distinct()
        new = cut(reached.join(edges.select(*KEY), KEY, "left_anti"))
        n = new.count()
        if not n:
            break
        new = F.broadcast(new) if n <= FEW_KEYS else new
    told, waiting = None, edges
    for _ in range(depth):
        known = F.nullif("origin", F.lit(MISSING))
        merged = waiting.groupBy(*KEY).agg(
            F.bool_or(F.col("origin").isNull()).alias("waits"), F.coalesce(F.bool_or(F.col("origin") == UNKNOWN), F.lit(False)).alias("lost"), F.min(known).alias("least"), F.max(known).alias("most")
        )
        lost = F.col("lost") | F.coalesce(F.col("least") != F.col("most"), F.lit(False))
        done = cut(merged.filter(lost | ~F.col("waits")).select(*KEY, F.when(lost, UNKNOWN).otherwise(F.coalesce("least", F.lit(MISSING))).alias("origin")))
        if done.isEmpty():
            break
        told = done if told is None else told.unionByName(done)
        gained = done.select(*[F.col(c).alias(f"next_{c}") for c in KEY], F.col("origin").alias("gained"))
        waiting = waiting.join(done, KEY, "left_anti").join(gained, [f"next_{c}" for c in KEY], "left")
        waiting = cut(waiting.withColumn("origin", F.coalesce("origin", "gained")).drop("gained"))
    unknown = F.lit(UNKNOWN)
    if told is None:
        return asked.withColumn("origin", unknown)
    mine = told.filter("scope = 'local'").select("file", "symbol", "origin")
    return asked.join(mine, ["file", "symbol"], "left").withColumn("origin", F.coalesce("origin", unknown))


def unproven_producers(calls: DataFrame, bindings: DataFrame, rules: DataFrame, allowed: DataFrame, factory: str) -> DataFrame:
    """(id, file, rule, argument): calls(id, file, callee, argument) of the factory `package#path`, whatever they name it,
    in files that a rule doesn't allow.

    rules(rule, kinds) take the calls whose first argument is among kinds, all if kinds is null or empty; a call without
    a literal argument matches only such. allowed(rule, file) are the files that may make a proof, which cancels the
    finding of that rule alone. Rules without kinds give a row a call each, as is
    what they ask for.
    """
    wanted = calls.select("file", F.col("callee").alias("symbol"))
    made = value_origins(wanted, bindings).filter(F.col("origin") == factory)
    found = calls.withColumn("__f", _text("file")).join(made.select(F.col("file").alias("__f"), F.col("symbol").alias("callee")), ["__f", "callee"], "left_semi")
    of = rules.select("rule", F.explode_outer(F.when(F.size("kinds") > 0, F.array_distinct("kinds"))).alias("kind")).distinct()
    one = found.join(of.filter("kind IS NOT NULL").withColumnRenamed("kind", "argument"), "argument").select("id", "file", "rule", "argument")
    every = found.select("*", F.lit(1).alias("__k")).join(of.filter("kind IS NULL").select("rule", F.lit(1).alias("__k")), "__k").select("id", "file", "rule", "argument")
    hit = one.unionByName(every).distinct()
    return hit.join(allowed.select("rule", "file").distinct(), ["rule", "file"], "left_anti").select("id", "file", "rule", "argument")
