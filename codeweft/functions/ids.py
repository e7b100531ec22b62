"""Identifier and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Discriminators of entity ids, tested in this order.
KINDS = (("file", "File"), ("module", "Module"), ("class", "Class"), ("function", "Function"), ("method", "Method"), ("import", "Import"))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading ./ or /, no empty or . segments; .. stays."""
    p = F.regexp_replace(F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/"), r"^(?:\./+|/+)", "")
    return F.array_join(F.filter(F.split(p, "/"), lambda x: (x != "") & (x != ".")), "/")


def entity_id(repo_id: Column, kind: str, tail: Column) -> Column:
    return F.concat(repo_id, F.lit(f"::{kind}::"), tail)


def label_of(id_: Column) -> Column:
    """The label an id's text shows: the first discriminator found, else Repository for a bare repo id, else null."""
    out = None
    for kind, label in KINDS:
        hit = id_.contains(f"::{kind}::")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(id_.startswith("repo::"), "Repository")


def repo_of(id_: Column) -> Column:
    """The text before the first discriminator that the label order finds; a bare repo id is its own repository."""
    out = None
    for kind, _ in KINDS:
        d = f"::{kind}::"
        part = F.split_part(id_, F.lit(d), F.lit(1))
        out = F.when(id_.contains(d), part) if out is None else out.when(id_.contains(d), part)
    return out.when(id_.startswith("repo::"), id_)


def module_info(path: Column) -> tuple[Column, Column]:
    """(short name, dotted name) of a module path; __init__ names its package, at the top 'root'."""
    stem = F.regexp_replace(normalize_path(path), r"\.py$", "")
    parts = F.split(stem, "/")
    parts = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    empty = F.size(parts) == 0
    short = F.when(empty, "root").otherwise(F.element_at(F.when(empty, F.array(F.lit("root"))).otherwise(parts), -1))
    return short, F.when(empty, "root").otherwise(F.array_join(parts, "."))


def match_score(text: Column, q: str) -> Column:
    """100 equal, 80 prefix, 65 after one of . _ / : or a blank, 50 anywhere, 0 not at all; letter case aside."""
    t, q = F.lower(text), q.lower()
    quoted = "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.when(text.isNull(), 0).when(t == q, 100).when(t.startswith(q), 80).when(t.rlike("[._/:\\s]" + quoted), 65).when(t.contains(q), 50).otherwise(0)


def short_name(id_: Column) -> Column:
    """What follows the last :: of an id, or else the last / of a path."""
    clean = F.trim(F.coalesce(id_, F.lit("")))
    return F.when(clean.contains("::"), F.element_at(F.split(clean, "::"), -1)).otherwise(F.element_at(F.split(clean, "/"), -1))


def is_leaf(label: Column) -> Column:
    """Is it an entity that contains none?"""
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).isin("method", "import")


def encode_path(path: Column) -> Column:
    """Every segment of a path encoded for a URL; the slashes stay."""
    out = F.url_encode(path)
    # the function encodes forms: blanks as +, and some marks that stand as they are in a path
    for code, sign in (("+", "%20"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


# Colours of the text on a badge by label, and of the line of an edge by type; the last is for all others.
BADGES = {"repository": "#c084fc", "file": "#60a5fa", "module": "#22d3ee", "class": "#a5b4fc", "function": "#34d399", "method": "#2dd4bf", "import": "#fbbf24", "": "#cbd5e1"}
STROKES = {"CONTAINS": "#64748b", "IMPORTS": "#60a5fa", "CALLS": "#34d399", "INHERITS": "#fbbf24", "": "#94a3b8"}


def style(key: Column, table: dict[str, str]) -> Column:
    """The value of a key in a table of styles, the one of '' for keys it does not have."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(table[""]))


def scalar_metadata(metadata: Column) -> Column:
    """The entries of a map that have a value: nulls are no properties of a stored edge."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull())
