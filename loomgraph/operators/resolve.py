"""Inheritance and call resolution: names become edges, by ranked rules.

No call site meets all methods of its name. Each rule is a lookup with one row a key, so a join never makes more rows
than there are call keys; call sites that ask the same from the same file are resolved once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import owner_type
from ..shared import shuffled, stage, unstage

#: What each rule says of itself; the first that applies decides.
STATIC, HINT, HINT_ANY = ("static-import-owner-arity-exact", 0.9), ("qualifiedName-exact", 0.95), ("qualifiedName-exact-no-arity", 0.6)
SAME_CLASS, SAME_FILE, IN_SCOPE = ("name-arity-same-class", 0.85), ("name-arity-same-file", 0.8), ("name-arity-import-scope", 0.75)
CLASS_ANY, FALLBACK = ("name-same-class-no-arity", 0.6), ("fallback-first-candidate", 0.4)


def import_scope(imports: DataFrame) -> DataFrame:
    """(repo, file_path, kind, owner, member) of imports (repo, file_path, import): an explicit type, a wildcard package,
    a static member of an owner, or all static members of one."""
    text = F.col("import")
    static = text.startswith("static ")
    bare = F.regexp_replace(text, "^static ", "")
    wild = bare.endswith(".*")
    kind = F.when(static & wild, "static_wildcard").when(static, "static_member").when(wild, "wildcard").otherwise("type")
    owner = F.when(wild, F.regexp_replace(bare, r"\.\*$", "")).when(static, owner_type(bare)).otherwise(bare)
    return imports.select("repo", "file_path", kind.alias("kind"), owner.alias("owner"), F.when(static & ~wild, F.element_at(F.split(bare, r"\."), -1)).alias("member"))


def _lookup(methods: DataFrame, *key: str) -> DataFrame:
    """The first method of each key, as (ord, id)."""
    return methods.groupBy("repo", *key).agg(F.min(F.struct("ord", "id")).alias("m"))


def _find(calls: DataFrame, methods: DataFrame, as_: str, **key: str) -> DataFrame:
    """calls with the column `as_`: the first method whose columns (the names of key) equal the call's (its values)."""
    table = _lookup(methods, *key)
    table = table.select(F.col("repo").alias("__repo"), *[F.col(m).alias(f"__{m}") for m in key], F.col("m").alias(as_))
    same = reduce(lambda a, b: a & b, [F.col("repo") == F.col("__repo")] + [F.col(c) == F.col(f"__{m}") for m, c in key.items()])
    return shuffled(calls).join(table, same, "left").drop("__repo", *[f"__{m}" for m in key])


def _in_scope(asked: DataFrame, methods: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo, file, pkg, nm, ar, n_scope) for asked (repo, file, pkg, nm, ar): the first method of this name and arity in
    the caller's package, an imported package or an imported type.

    Each question meets the imports of its file, one table for both kinds, and then a row a (name, arity, owner)."""
    by = lambda kind, column: methods.select("repo", F.lit(kind).alias("kind"), F.col(column).alias("owner"), F.col("name").alias("nm"), F.col("arity").alias("ar"), "ord", "id")
    table = by("wildcard", "package_name").unionByName(by("type", "owner")).groupBy("repo", "kind", "owner", "nm", "ar").agg(F.min(F.struct("ord", "id")).alias("m"))
    places = shuffled(asked).join(imported, ["repo", "file"]).select("repo", "file", "pkg", "nm", "ar", "kind", "owner")
    own = asked.select("repo", "file", "pkg", "nm", "ar", F.lit("wildcard").alias("kind"), F.col("pkg").alias("owner"))
    return shuffled(places.unionByName(own)).join(table, ["repo", "kind", "owner", "nm", "ar"]).groupBy("repo", "file", "pkg", "nm", "ar").agg(F.min("m").alias("n_scope"))


def _by_hint(keys: DataFrame, methods: DataFrame, imported: DataFrame) -> list[DataFrame]:
    """What hints decide, keys with a method m: by qualified name with the right arity, and for hints that have none of it, any;
    in the class, the file, the scope, anywhere. Only keys with a hint come here, so no null is a key of these joins.

    A hint fixes its owner, so an imported type is one look at the imports, and an imported package one more for each of
    the few packages that a qualified name can lie in."""
    types = imported.filter("kind = 'type'").select("repo", "file", F.col("owner").alias("hint_owner"), F.lit(True).alias("typed"))
    packages = imported.filter("kind = 'wildcard'").select("repo", "file", F.col("owner").alias("package_name"))
    asked = _find(_find(keys.withColumn("hint_owner", owner_type(F.col("hint"))), methods, "g_any", qualified_name="hint").filter("g_any is not null"), methods, "h_any", qualified_name="hint", arity="ar")
    asked = stage(shuffled(asked).join(types, ["repo", "file", "hint_owner"], "left"), "hinted")
    out = []
    for any_, more, which in (("h_any", {"arity": "ar"}, "h_any is not null"), ("g_any", {}, "h_any is null")):
        own = asked.filter(which)
        table = _lookup(methods, "qualified_name", "package_name", *more).withColumnsRenamed({"qualified_name": "hint", "arity": "ar"})
        near = shuffled(own.select("key_id", "repo", "file", "pkg", "hint", "ar")).join(table, ["repo", "hint", *more.values()])
        inside = shuffled(near).join(packages, ["repo", "file", "package_name"], "left_semi").select("key_id", "m").unionByName(near.filter("package_name = pkg").select("key_id", "m"))
        found = _find(own, methods, "in_class", qualified_name="hint", class_name="cls", **more)
        found = _find(found, methods, "in_file", qualified_name="hint", file_path="file", **more)
        found = shuffled(found).join(inside.groupBy("key_id").agg(F.min("m").alias("in_package")), "key_id", "left")
        found = found.withColumn("m", F.coalesce("in_class", "in_file", F.least("in_package", F.when(F.col("typed"), F.col(any_))), any_))
        out.append(stage(found.select(*keys.columns, "m"), "by-hint"))
    unstage(asked)
    return out


def resolve_calls(call_sites: DataFrame, method_refs: DataFrame, scope: DataFrame) -> DataFrame:
    """One CALLS edge for each resolved call site: repo, source_id, target_id, type, strategy, confidence, line, source,
    simple_name.

    call_sites: repo, caller_method_id, caller_class, caller_file, caller_pkg, simple_name, hint, arg_count, line, source,
    unsupported_reason. method_refs: repo, id, name, class_name, file_path, package_name, qualified_name, parameter_count,
    ord; declarations of one id in two files count twice. scope: import_scope's rows.

    In order: an unsupported site has no edge. A static import of the name (or a static wildcard) in a file decides for
    a site without a hint: one method of the right arity among the imported owners is the target, two or more are no
    edge, none passes on. A hint decides by qualified name, of the right arity if there is any. Then name and arity, in
    the class, the file, the imports, anywhere; then the name alone. A site that resolves to its own method has no edge.

    Each kind of rule is a job of its own over what the kinds before it have left open, so no plan holds more than a few
    joins: one plan of all rules takes the driver more memory than its data.
    """
    sites = call_sites.filter("unsupported_reason is null")
    asked = {"repo": "repo", "caller_class": "cls", "caller_file": "file", "caller_pkg": "pkg", "simple_name": "nm", "hint": "hint", "arg_count": "ar"}
    keys = sites.select(*[F.col(c).cast("int" if c == "arg_count" else "string").alias(n) for c, n in asked.items()]).distinct()
    keys = stage(keys.withColumn("key_id", F.monotonically_increasing_id()), "keys")
    methods = method_refs.select("repo", "id", "name", "class_name", "file_path", "package_name", "qualified_name", F.col("parameter_count").cast("int").alias("arity"), "ord", owner_type(F.col("qualified_name")).alias("owner"))
    methods = stage(methods, "methods")
    imports = stage(scope.select("repo", F.col("file_path").alias("file"), "kind", "owner", "member").distinct(), "imports")
    imported = imports.filter("kind in ('wildcard', 'type')").select("repo", "file", "kind", "owner")

    # Static imports: how many methods the allowed owners have under this name and arity.
    free = keys.filter("hint is null").select("key_id", "repo", "file", "nm", "ar")
    static = imports.filter("kind in ('static_wildcard', 'static_member')").select("repo", "file", "owner", "member")
    allowed = shuffled(free).join(static, ["repo", "file"]).filter(F.col("member").isNull() | (F.col("member") == F.col("nm"))).select("key_id", "repo", "nm", "ar", "owner").distinct()
    counted = methods.groupBy("repo", F.col("name").alias("nm"), F.col("arity").alias("ar"), "owner").agg(F.count("*").alias("n"), F.min(F.struct("ord", "id")).alias("m"))
    owned = shuffled(allowed).join(counted, ["repo", "nm", "ar", "owner"]).groupBy("key_id").agg(F.sum("n").alias("static_n"), F.min("m").alias("static_m"))
    c = _find(keys, methods, "b_any", name="nm").filter("b_any is not null")  # a name that no method has is no edge
    named = stage(shuffled(c).join(owned, "key_id", "left"), "named")

    left = named.filter("static_n is null").drop("static_n", "static_m")
    exact, near = _by_hint(left.filter("hint is not null").drop("b_any"), methods, imported)
    place = ["repo", "file", "pkg", "nm", "ar"]
    left = shuffled(left).join(exact.unionByName(near).select("key_id"), "key_id", "left_anti")
    c = _find(left, methods, "n_class", name="nm", arity="ar", class_name="cls")
    c = stage(_find(c, methods, "n_file", name="nm", arity="ar", file_path="file"), "by-name")
    far = c.filter("n_class is null and n_file is null")
    far = shuffled(far).join(_in_scope(far.select(*place).distinct(), methods, imported), place, "left")
    far = _find(far, methods, "n_any", name="nm", arity="ar")
    far = stage(_find(far, methods, "b_class", name="nm", class_name="cls"), "by-scope")

    col = F.col
    rule = lambda m, s: F.struct(col(m)["id"].alias("target_id"), F.lit(s[0]).alias("strategy"), F.lit(s[1]).alias("confidence"))
    first = lambda *rules: F.coalesce(*[F.when(col(m).isNotNull(), rule(m, s)) for m, s in rules])
    decided = [
        named.filter("static_n = 1").withColumn("d", rule("static_m", STATIC)),
        exact.withColumn("d", rule("m", HINT)),
        near.withColumn("d", rule("m", HINT_ANY)),
        c.filter("n_class is not null or n_file is not null").withColumn("d", first(("n_class", SAME_CLASS), ("n_file", SAME_FILE))),
        far.withColumn("d", first(("n_scope", IN_SCOPE), ("n_any", FALLBACK), ("b_class", CLASS_ANY), ("b_any", FALLBACK))),
    ]
    answers = reduce(DataFrame.unionByName, [d.select(*[F.col(n).alias(f"__{n}") for n in asked.values()], "d.*") for d in decided])
    unstage(keys, methods, imports)
    same = reduce(lambda a, b: a & b, [sites[x].eqNullSafe(F.col(f"__{n}")) for x, n in asked.items()])
    out = shuffled(sites).join(answers, same).filter(F.col("caller_method_id") != F.col("target_id"))
    return out.select("repo", F.col("caller_method_id").alias("source_id"), "target_id", F.lit("CALLS").alias("type"), "strategy", "confidence", F.col("line").cast("long").alias("line"), "source", "simple_name")


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges of resolved calls: equal calls on one line are one edge."""
    edge_id = F.concat("source_id", F.lit("->"), "target_id", F.lit(":CALLS:"), "simple_name", F.lit(":"), F.col("line").cast("string"))
    reason = F.concat(F.lit("strategy="), "strategy", F.lit(";source="), "source")
    return resolved.groupBy("repo", edge_id.alias("id")).agg(F.first("source_id").alias("source_id"), F.first("target_id").alias("target_id"), F.lit("CALLS").alias("type"), F.min("confidence").alias("confidence"), F.min(reason).alias("reason"), F.first("line").alias("line"))


def resolve_inheritance(pending: DataFrame, types: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, external nodes) of pending (repo, source_type_id, super_class, interfaces), types (repo, id, name, ord) and
    known nodes (repo, id).

    A name is the first type of that name, of any kind and package; an unknown one becomes an external node. An
    interface that is named twice by a type is one edge."""
    first = types.groupBy("repo", F.col("name").alias("wanted")).agg(F.min_by("id", "ord").alias("found"))
    up = pending.filter("super_class is not null and super_class <> ''").select("repo", "source_type_id", F.col("super_class").alias("wanted"), F.lit("EXTENDS").alias("type"))
    across = pending.select("repo", "source_type_id", F.explode("interfaces").alias("wanted"), F.lit("IMPLEMENTS").alias("type")).filter("wanted <> ''")
    asked = shuffled(up.unionByName(across).distinct()).join(first, ["repo", "wanted"], "left")
    external = F.concat(F.when(F.col("type") == "EXTENDS", "class:external.").otherwise("interface:external."), "wanted")
    target = F.coalesce("found", external)
    edge_id = F.concat("source_type_id", F.lit("->"), target, F.lit(":"), "type", F.when(F.col("type") == "IMPLEMENTS", F.concat(F.lit(":"), "wanted")).otherwise(""))
    edges = asked.select("repo", edge_id.alias("id"), F.col("source_type_id").alias("source_id"), target.alias("target_id"), "type", F.lit(1.0).alias("confidence"), F.concat(F.lit("class-"), F.lower("type")).alias("reason"))
    made = asked.filter("found is null").select("repo", external.alias("id"), F.when(F.col("type") == "EXTENDS", "Class").otherwise("Interface").alias("label"), F.col("wanted").alias("name"), F.concat(F.lit("external."), "wanted").alias("qualified_name"), F.lit("").alias("file_path")).distinct()
    return edges, shuffled(made).join(known.select("repo", "id"), ["repo", "id"], "left_anti")
