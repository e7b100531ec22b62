"""Definitions, imports and reference facts of Python files: one table function, everything after it is joins.

Files that do not parse are read block by block: of a block that does not parse
its inner blocks are tried, down to single statements; what does not parse is
blanked so that lines and bytes stay where they are, and told as an error.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_SPAN = "start_line:bigint,end_line:bigint,start_byte:bigint,end_byte:bigint"
SCHEMA = (
    "repo_id string, file_path string, has_syntax_errors boolean, end_line bigint, end_byte bigint, "
    f"defs array<struct<kind:string,name:string,qname:string,parent:string,parent_kind:string,docstring:string,ord:bigint,{_SPAN}>>, "
    f"imports array<struct<module_name:string,imported_name:string,alias:string,ord:bigint,{_SPAN}>>, "
    "errors array<struct<message:string,node_type:string,is_missing:boolean,start_line:bigint,start_column:bigint>>, "
    "bases array<struct<cls:string,base:string,ord:bigint>>, "
    "attrs array<struct<cls:string,attr:string,ctor:string,ord:bigint>>, "
    "calls array<struct<caller:string,caller_kind:string,cls:string,form:string,receiver:string,name:string,ctors:array<string>,ord:bigint>>"
)


def module_qname(path: str) -> str:
    parts = [p for p in path.removesuffix(".py").split("/") if p and p != "."]
    if parts and parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) or "root"


def _docstring(node: ast.AST, text: str) -> str | None:
    """The literal that opens the body, cleaned; a prefixed literal stays as it is written."""
    body = getattr(node, "body", None)
    if not body or not isinstance(body[0], ast.Expr) or not isinstance(body[0].value, ast.Constant) or not isinstance(body[0].value.value, str):
        return None
    raw = ast.get_source_segment(text, body[0].value) or ""
    for q in ('"""', "'''", '"', "'"):
        if raw.startswith(q) and raw.endswith(q) and len(raw) >= 2 * len(q):
            raw = raw[len(q) : -len(q)]
            break
    return inspect.cleandoc(raw).strip() or None


_GOES_ON = re.compile(r"\s*(?:[)\]}]|(?:else|elif|except|finally)\b)")
_EXPECTED = re.compile(r"expected '(.+?)'|'(.)' was never closed")
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def _parse(text: str) -> SyntaxError | ValueError | RecursionError | None:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return e
    return None


def _error(e: Exception, first_line: int) -> dict:
    """A row of what is wrong: a missing token by its text, anything else as ERROR; lines from 1, columns from 0."""
    message = getattr(e, "msg", None) or str(e)
    m = _EXPECTED.search(message)
    token = (m.group(1) or _CLOSING.get(m.group(2))) if m else None
    line, column = getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1
    return {"message": message, "node_type": token or "ERROR", "is_missing": bool(token), "start_line": first_line + line - 1, "start_column": max(0, column - 1)}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _mend(lines: list[str], a: int, b: int, indent: int, errors: list[dict]) -> None:
    """Blanks what does not parse among the statements of lines[a:b] that begin at ``indent``."""
    starts = [i for i in range(a, b) if lines[i].strip() and _indent(lines[i]) <= indent and not _GOES_ON.match(lines[i])]
    starts = [s for k, s in enumerate(starts) if not (k and lines[starts[k - 1]].lstrip().startswith("@"))]

    def fails(s: int, e: int, more: str = "") -> Exception | None:
        """Does the block fail? A block inside others is read under a header of its own, which takes a line."""
        wrong = _parse(("if 1:\n" if indent else "") + "".join(lines[s:e]) + more)
        if wrong is not None and indent and getattr(wrong, "lineno", None):
            wrong.lineno -= 1
        return wrong

    for s, e in zip(starts, [*starts[1:], b]):
        wrong = fails(s, e)
        if wrong is None:
            continue
        inner = next((i for i in range(s + 1, e) if lines[i].strip() and _indent(lines[i]) > indent and lines[i - 1].rstrip().endswith(":")), None)
        if inner is not None and fails(s, inner, " " * (indent + 1) + "pass\n") is None:
            depth, found = _indent(lines[inner]), len(errors)
            _mend(lines, inner, e, depth, errors)
            if fails(s, e) is not None:
                kept = lines[inner]
                lines[inner] = lines[inner] if lines[inner].strip() else " " * depth + "pass\n"
                if fails(s, e) is not None:
                    lines[inner] = kept
            if fails(s, e) is None:
                continue
            del errors[found:]
        errors.append(_error(wrong, s + 1))
        lines[s:e] = ["\n" if x.endswith("\n") else "" for x in lines[s:e]]


def parse_tolerant(text: str) -> tuple[ast.Module, str, list[dict]]:
    """(tree, text the tree was read from, what was blanked)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        whole = _parse(text)
        if whole is None:
            return ast.parse(text), text, []
        lines, errors = text.splitlines(keepends=True), []
        try:
            _mend(lines, 0, len(lines), 0, errors)
            kept = "".join(lines)
            return ast.parse(kept), kept, errors or [_error(whole, 1)]
        except (SyntaxError, ValueError, RecursionError):
            return ast.Module([], []), "", [_error(whole, 1)]


class _Visitor:
    """Walks statements in source order; scope is a list of (kind, name)."""

    def __init__(self, path: str, text: str, lines: list[int]):
        self.module, self.text, self.lines, self.n = module_qname(path), text, lines, 0
        self.defs, self.imports, self.bases, self.attrs, self.calls = [], [], [], [], []

    def span(self, node: ast.AST, first: ast.AST | None = None) -> dict:
        a = first or node
        return {
            "start_line": a.lineno, "end_line": node.end_lineno,
            "start_byte": self.lines[a.lineno - 1] + a.col_offset - (1 if first is not None else 0), "end_byte": self.lines[node.end_lineno - 1] + node.end_col_offset,
        }

    def walk(self, node: ast.AST, scope: list[tuple[str, str]], types: dict[str, list[str]]) -> None:
        for child in ast.iter_child_nodes(node):
            self.visit(child, scope, types)

    def qname(self, scope) -> str:
        return ".".join([self.module, *(n for _, n in scope)])

    def visit(self, node: ast.AST, scope: list[tuple[str, str]], types: dict[str, list[str]]) -> None:
        self.n += 1
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            self.define(node, scope, types)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                self.n += 1
                self.imports.append({"module_name": a.name, "imported_name": a.name, "alias": a.asname, "ord": self.n, **self.span(node), **self._bytes(a)})
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                self.n += 1
                self.imports.append({"module_name": "." * node.level + (node.module or ""), "imported_name": a.name, "alias": a.asname, "ord": self.n, **self.span(node), **self._bytes(a)})
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    types[t.id] = [node.value.func.id, *types.get(t.id, [])]
        elif isinstance(node, ast.Call):
            self.call(node, scope, types)
        self.walk(node, scope, types)

    def _bytes(self, a: ast.alias) -> dict:
        return {"start_byte": self.lines[a.lineno - 1] + a.col_offset, "end_byte": self.lines[a.end_lineno - 1] + a.end_col_offset}

    def define(self, node, scope, types) -> None:
        is_class = isinstance(node, ast.ClassDef)
        kind = "class" if is_class else "method" if scope and scope[-1][0] == "class" else "function"
        first = min(node.decorator_list, key=lambda x: (x.lineno, x.col_offset)) if node.decorator_list else None
        inner = [*scope, ("class" if is_class else "function", node.name)]
        q = self.qname(inner)
        self.defs.append({
            "kind": kind, "name": node.name, "qname": q, "parent": self.qname(scope) if scope else None,
            "parent_kind": None if not scope else ("class" if scope[-1][0] == "class" else "method" if len(scope) > 1 and scope[-2][0] == "class" else "function"),
            "docstring": _docstring(node, self.text), "ord": self.n, **self.span(node, first),
        })
        for d in node.decorator_list:
            self.visit(d, scope, types)
        if is_class:
            if not any(k == "function" for k, _ in scope):
                for b in node.bases:
                    if isinstance(b, (ast.Name, ast.Attribute)):
                        self.n += 1
                        self.bases.append({"cls": q, "base": ast.unparse(b), "ord": self.n})
            for s in node.body:
                self.visit(s, inner, dict(types))
            return
        if kind == "method" and len(scope) == 1 and not node.decorator_list:
            self.attributes(node, self.qname(scope))
        local = dict(types)
        for s in node.body:
            self.visit(s, inner, local)

    def attributes(self, node, cls: str) -> None:
        for s in node.body:
            if isinstance(s, ast.Assign) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name):
                for t in s.targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        self.n += 1
                        self.attrs.append({"cls": cls, "attr": t.attr, "ctor": s.value.func.id, "ord": self.n})

    def call(self, node: ast.Call, scope, types) -> None:
        fns = [i for i, (k, _) in enumerate(scope) if k == "function"]
        if not fns or scope[-1][0] == "class":
            return
        classes = [i for i, (k, _) in enumerate(scope) if k == "class"]
        # a class inside a function, or a function inside a method, is nobody's caller
        if classes and (fns[0] < classes[-1] or len(fns) > 1):
            return
        cls = self.qname(scope[: classes[-1] + 1]) if classes else None
        f, form, receiver, name = node.func, None, None, None
        if isinstance(f, ast.Name):
            form, name = "name", f.id
        elif isinstance(f, ast.Attribute):
            v, name = f.value, f.attr
            if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
                form = "super"
            elif isinstance(v, ast.Name):
                form, receiver = ("self", None) if v.id == "self" else ("var", v.id)
            elif isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "self":
                form, receiver = "attr", v.attr
        if form:
            self.n += 1
            self.calls.append({
                "caller": self.qname(scope), "caller_kind": "method" if cls else "function", "cls": cls, "form": form, "receiver": receiver, "name": name,
                "ctors": types.get(receiver, []) if form == "var" else [], "ord": self.n,
            })


def file_facts(repo: str, path: str, content: str) -> dict:
    text = content.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    tree, read, errors = parse_tolerant(text)
    data = text.encode("utf-8", "replace")
    lines = [0] + [m.end() for m in re.finditer(b"\n", data)]
    v = _Visitor(path, read, lines)
    try:
        v.walk(tree, [], {})
    except RecursionError as e:
        errors = [_error(e, 1)]
    return {
        "repo_id": repo, "file_path": path, "has_syntax_errors": bool(errors), "end_line": max(1, len(lines)), "end_byte": len(data),
        "defs": v.defs, "imports": v.imports, "errors": errors, "bases": v.bases, "attrs": v.attrs, "calls": v.calls,
    }


def extract_facts(files: DataFrame) -> DataFrame:
    """One row per file of ``files`` (repo_id, file_path, content; one row a file), its facts in arrays. Null content counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([file_facts(r, p, c or "") for r, p, c in zip(b["repo_id"], b["file_path"], b["content"])], columns=[c.split()[0] for c in _columns()])

    src = files.where(F.col("repo_id").isNotNull() & F.col("file_path").endswith(".py")).select("repo_id", "file_path", "content")
    return src.mapInPandas(run, SCHEMA)


def syntax_nodes(files: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(repo_id, file_path, ord, depth, node_type, start_line, start_column, end_line): the nodes of the trees of Python files, parents first, from left to right.

    types keeps nodes of these types only.  Files that do not parse give the nodes
    of what does.
    """
    columns = ["repo_id", "file_path", "ord", "depth", "node_type", "start_line", "start_column", "end_line"]
    wanted = None if types is None else set(types)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, content in zip(b["repo_id"], b["file_path"], b["content"]):
                tree, _, _ = parse_tolerant((content or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"))
                todo, n = [(tree, 0)], 0
                while todo:
                    node, depth = todo.pop()
                    kind = type(node).__name__
                    if wanted is None or kind in wanted:
                        rows.append((repo, path, n, depth, kind, getattr(node, "lineno", None), getattr(node, "col_offset", None), getattr(node, "end_lineno", None)))
                    n += 1
                    todo += [(c, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns if c not in ("repo_id", "file_path", "node_type")})

    src = files.where(F.col("repo_id").isNotNull() & F.col("file_path").endswith(".py")).select("repo_id", "file_path", "content")
    return src.mapInPandas(run, "repo_id string, file_path string, ord bigint, depth bigint, node_type string, start_line bigint, start_column bigint, end_line bigint")


def _columns() -> list[str]:
    out, depth, at = [], 0, 0
    for i, ch in enumerate(SCHEMA):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(SCHEMA[at:i].strip())
            at = i + 1
    return [*out, SCHEMA[at:].strip()]


def table_of(facts: DataFrame, field: str) -> DataFrame:
    return facts.select("repo_id", "file_path", F.explode(field).alias("x")).select("repo_id", "file_path", "x.*")
