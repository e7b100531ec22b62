"""Name resolution as joins: imports, bases, attribute and local types, and calls become edges between entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from codeweft.functions.ids import entity_id, module_info
from codeweft.operators.facts import table_of
from codeweft.sources.tables import cut_lineage


def _modules(facts: DataFrame) -> DataFrame:
    short, dotted = module_info(F.col("file_path"))
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    return facts.select("repo_id", "file_path", short.alias("m_name"), dotted.alias("m_qname"), folder.alias("folder"))


def resolve_modules(refs: DataFrame, mods: DataFrame) -> DataFrame:
    """(repo_id, file_path, module_name, m_qname): the module a name means in a file.

    1 the exact dotted name; 2 the short name if unique in the repository, else
    the first of that name in the file's own folder, else nothing; 3 leading dots
    count from the file's folder, for single names.
    """
    refs = refs.select("repo_id", "file_path", "module_name").distinct().withColumn("folder", F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1))
    exact = mods.groupBy("repo_id", F.col("m_qname").alias("module_name")).agg(F.max("m_qname").alias("q1"))
    by_name = mods.groupBy("repo_id", F.col("m_name").alias("module_name")).agg(F.count(F.lit(1)).alias("k"), F.min("m_qname").alias("only"))
    by_folder = mods.groupBy("repo_id", F.col("m_name").alias("module_name"), "folder").agg(F.min("m_qname").alias("near"))
    bare = F.regexp_replace("module_name", r"^\.+", "")
    rel = refs.where(F.col("module_name").startswith(".") & ~bare.contains(".")).withColumn("bare", bare)
    rel = rel.join(mods.select("repo_id", "folder", F.col("m_name").alias("bare"), F.col("m_qname").alias("q3")), ["repo_id", "folder", "bare"]).groupBy("repo_id", "file_path", "module_name").agg(F.min("q3").alias("q3"))
    j = refs.join(exact, ["repo_id", "module_name"], "left").join(by_name, ["repo_id", "module_name"], "left").join(by_folder, ["repo_id", "module_name", "folder"], "left").join(rel, ["repo_id", "file_path", "module_name"], "left")
    two = F.when(F.col("k") == 1, F.col("only")).otherwise(F.col("near"))
    hit = F.coalesce("q1", F.when(F.col("k").isNotNull(), two).otherwise(F.col("q3")))
    return j.select("repo_id", "file_path", "module_name", hit.alias("m_qname")).where("m_qname IS NOT NULL")


def resolve_symbols(refs: DataFrame, defs: DataFrame, imports: DataFrame, imported: DataFrame) -> DataFrame:
    """(repo_id, file_path, symbol, kind, qname): what a bare name means in a file.

    1 the only class of that name in the file; 2 the only function; 3 the imports
    in order: a class, a function of the imported module, or the module itself.
    """
    refs = refs.select("repo_id", "file_path", "symbol").distinct()

    def only(kind: str, rank: int) -> DataFrame:
        d = defs.where(F.col("kind") == kind).groupBy("repo_id", "file_path", F.col("name").alias("symbol")).agg(F.count(F.lit(1)).alias("k"), F.max("qname").alias("qname"))
        return refs.join(d.where("k = 1").drop("k"), ["repo_id", "file_path", "symbol"]).select("repo_id", "file_path", "symbol", F.struct(F.lit(rank).alias("rank"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("step"), F.lit(kind).alias("kind"), "qname").alias("c"))

    im = imports.withColumn("symbol", F.coalesce("alias", "imported_name")).join(refs, ["repo_id", "file_path", "symbol"], "left_semi").join(imported, ["repo_id", "file_path", "module_name"])
    im = im.withColumn("member", F.concat("m_qname", F.lit("."), "imported_name"))
    parts = [only("class", 1), only("function", 2)]
    for step, kind in enumerate(("class", "function")):
        d = defs.where(F.col("kind") == kind).select("repo_id", F.col("qname").alias("member")).distinct()
        parts.append(im.join(d, ["repo_id", "member"]).select("repo_id", "file_path", "symbol", F.struct(F.lit(3).alias("rank"), "ord", F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.col("member").alias("qname")).alias("c")))
    whole = im.where(F.col("module_name") == F.col("imported_name"))
    parts.append(whole.select("repo_id", "file_path", "symbol", F.struct(F.lit(3).alias("rank"), "ord", F.lit(2).alias("step"), F.lit("module").alias("kind"), F.col("m_qname").alias("qname")).alias("c")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("repo_id", "file_path", "symbol").agg(F.min("c").alias("c")).select("repo_id", "file_path", "symbol", "c.kind", "c.qname")


def method_table(defs: DataFrame, inherits: DataFrame) -> DataFrame:
    """(repo_id, cls, method, m_qname): every method a class has or inherits, the nearest base winning, in order of declaration; cycles end."""
    own = defs.where("kind = 'method'").select("repo_id", F.regexp_extract("qname", r"^(.*)\.[^.]+$", 1).alias("cls"), F.col("name").alias("method"), F.col("qname").alias("m_qname")).distinct()
    classes = defs.where("kind = 'class'").select("repo_id", F.col("qname").alias("cls")).distinct()
    front = cut_lineage(classes.select("repo_id", "cls", F.col("cls").alias("base"), F.array().cast("array<bigint>").alias("way")))
    seen = front
    up = inherits.select("repo_id", F.col("cls").alias("base"), F.col("base_qname").alias("next"), "ord")
    while True:
        nxt = (
            front.join(up, ["repo_id", "base"]).select("repo_id", "cls", F.col("next").alias("base"), F.concat("way", F.array("ord")).alias("way"))
            .join(seen.select("repo_id", "cls", "base"), ["repo_id", "cls", "base"], "left_anti").groupBy("repo_id", "cls", "base").agg(F.min("way").alias("way"))
        )
        front = cut_lineage(nxt)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    m = seen.join(own.withColumnRenamed("cls", "base"), ["repo_id", "base"])
    return m.groupBy("repo_id", "cls", "method").agg(F.min(F.struct(F.size("way").alias("level"), "way", "m_qname")).alias("c")).select("repo_id", "cls", "method", "c.m_qname")


def resolve_edges(facts: DataFrame) -> DataFrame:
    """(repo_id, rel_type, source_id, target_id): CONTAINS, IMPORTS, INHERITS and CALLS of the given facts, without repeats.

    Names that resolve to nothing give no edge; nothing crosses repositories.
    """
    facts = cut_lineage(facts)
    defs, imports, bases, attrs, calls = (table_of(facts, x) for x in ("defs", "imports", "bases", "attrs", "calls"))
    repo = F.col("repo_id")

    def id_of(kind, qname):
        return F.concat("repo_id", F.lit("::"), kind, F.lit("::"), qname)

    mods = cut_lineage(_modules(facts))
    var_mods = calls.where("form = 'var'").select("repo_id", "file_path", F.col("receiver").alias("module_name"))
    imported = cut_lineage(resolve_modules(imports.select("repo_id", "file_path", "module_name").unionByName(var_mods), mods))
    symbol_refs = [bases.select("repo_id", "file_path", F.element_at(F.split("base", r"\."), -1).alias("symbol")), attrs.select("repo_id", "file_path", F.col("ctor").alias("symbol")),
                   calls.where("form = 'name'").select("repo_id", "file_path", F.col("name").alias("symbol")), calls.select("repo_id", "file_path", F.explode("ctors").alias("symbol"))]
    symbols = cut_lineage(resolve_symbols(reduce(DataFrame.unionByName, symbol_refs), defs, imports, imported))
    classes = symbols.where("kind = 'class'").select("repo_id", "file_path", "symbol", F.col("qname").alias("found"))

    file_id = entity_id(repo, "file", F.col("file_path"))
    contains = [
        facts.select("repo_id", F.lit("CONTAINS").alias("rel_type"), repo.alias("source_id"), file_id.alias("target_id")),
        defs.select("repo_id", F.lit("CONTAINS").alias("rel_type"), F.coalesce(id_of(F.col("parent_kind"), F.col("parent")), file_id).alias("source_id"), id_of(F.col("kind"), F.col("qname")).alias("target_id")),
    ]
    imp = imports.join(imported, ["repo_id", "file_path", "module_name"]).select("repo_id", F.lit("IMPORTS").alias("rel_type"), file_id.alias("source_id"), entity_id(repo, "module", F.col("m_qname")).alias("target_id"))
    inherits = cut_lineage(
        bases.withColumn("symbol", F.element_at(F.split("base", r"\."), -1)).join(classes, ["repo_id", "file_path", "symbol"])
        .where("found <> cls").select("repo_id", "cls", F.col("found").alias("base_qname"), "ord")
    )
    inh = inherits.select("repo_id", F.lit("INHERITS").alias("rel_type"), id_of(F.lit("class"), F.col("cls")).alias("source_id"), id_of(F.lit("class"), F.col("base_qname")).alias("target_id"))
    methods = cut_lineage(method_table(defs, inherits))
    find = methods.select("repo_id", F.col("cls").alias("on"), F.col("method").alias("name"), "m_qname")

    def edge(df: DataFrame, kind, qname) -> DataFrame:
        return df.select("repo_id", F.lit("CALLS").alias("rel_type"), id_of(F.col("caller_kind"), F.col("caller")).alias("source_id"), id_of(kind, qname).alias("target_id"))

    def on_class(df: DataFrame) -> DataFrame:
        return edge(df.join(find, ["repo_id", "on", "name"]), F.lit("method"), F.col("m_qname"))

    # f(): a function defined inside the caller, else what the name means; a class stands for its __init__
    functions = defs.where("kind = 'function'").select("repo_id", F.col("qname").alias("inner_q")).distinct()
    direct = calls.where("form = 'name'").withColumn("inner_q", F.concat("caller", F.lit("."), "name"))
    direct = direct.join(functions.withColumn("is_inner", F.lit(True)), ["repo_id", "inner_q"], "left")
    outer = direct.where("is_inner IS NULL").withColumnRenamed("name", "symbol").join(symbols, ["repo_id", "file_path", "symbol"])
    out = [
        edge(direct.where("is_inner"), F.lit("function"), F.col("inner_q")),
        edge(outer.where("kind = 'function'"), F.lit("function"), F.col("qname")),
        on_class(outer.where("kind = 'class'").select("repo_id", "caller", "caller_kind", F.col("qname").alias("on"), F.lit("__init__").alias("name"))),
        on_class(calls.where("form = 'self' AND cls IS NOT NULL").select("repo_id", "caller", "caller_kind", F.col("cls").alias("on"), "name")),
    ]
    sup = calls.where("form = 'super' AND cls IS NOT NULL").select("repo_id", "file_path", "caller", "caller_kind", "cls", "name", F.col("ord").alias("call_ord"))
    sup = sup.join(inherits, ["repo_id", "cls"]).withColumnRenamed("base_qname", "on").join(find, ["repo_id", "on", "name"])
    sup = sup.groupBy("repo_id", "file_path", "caller", "caller_kind", "call_ord").agg(F.min_by("m_qname", "ord").alias("m_qname"))
    out.append(edge(sup, F.lit("method"), F.col("m_qname")))
    typed = attrs.withColumnRenamed("ctor", "symbol").join(classes, ["repo_id", "file_path", "symbol"]).groupBy("repo_id", "cls", F.col("attr").alias("receiver")).agg(F.max_by("found", "ord").alias("on"))
    out.append(on_class(calls.where("form = 'attr' AND cls IS NOT NULL").join(typed, ["repo_id", "cls", "receiver"])))
    # v.m(): the latest of the calls assigned to v whose name is a class; else a module named v
    var = calls.where("form = 'var'")
    bound = var.select("repo_id", "file_path", "caller", "caller_kind", "name", F.col("ord").alias("call_ord"), F.posexplode("ctors").alias("pos", "symbol")).join(classes, ["repo_id", "file_path", "symbol"])
    bound = cut_lineage(bound.groupBy("repo_id", "file_path", "caller", "caller_kind", "name", "call_ord").agg(F.min_by("found", "pos").alias("on")))
    out.append(on_class(bound))
    free = var.withColumnRenamed("ord", "call_ord").join(bound.select("repo_id", "file_path", "call_ord"), ["repo_id", "file_path", "call_ord"], "left_anti")
    free = free.join(imported.withColumnRenamed("module_name", "receiver"), ["repo_id", "file_path", "receiver"]).withColumn("inner_q", F.concat("m_qname", F.lit("."), "name"))
    out.append(edge(free.join(functions, ["repo_id", "inner_q"], "left_semi"), F.lit("function"), F.col("inner_q")))
    return reduce(DataFrame.unionByName, [*contains, imp, inh, *out]).distinct()
