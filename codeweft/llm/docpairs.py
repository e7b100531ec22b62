"""Functions paired with their documentation (problem 5).

A string- and comment-aware state machine blanks strings and comments of a file,
braces (JavaScript) or indentation (Python) then delimit its functions, and the
documentation comment right before a function, or the string that opens its
body, is attached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeweft.llm.sources import keep_current, revisions

_PY_LEX = re.compile(r"(?P<s>(?:\b[rRbBuUfFtT]{1,2})?(?:'''(?:\\.|[^\\])*?(?:'''|\Z)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?))|#[^\n]*", re.S)
_JS_LEX = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|(?:(?<=[=(,:\[!&|?{};\n])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/", re.S)
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", re.M)
_PY_SIGN = re.compile(r"[()\[\]{}:\n]")
_PY_LINE = re.compile(r"\n([ \t]*)[^\s\x01]")
_PY_DOC = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\n\s*(?:#[^\n]*\n\s*)*)?[rRuU]?('''|\"\"\"|'|\")((?:\\.|[^\\])*?)\1", re.S)
_JS_DEF = re.compile(r"(?:(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\(|(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>\s*\{|^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*(\w+)\s*\([^()]*\)\s*\{|\bclass\s+(\w+)[^{;]*\{)", re.M)
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with"}
_KEEP_LINES = re.compile(r"[^\n]")


def _blank(lex: re.Pattern, text: str, filler: str) -> str:
    return lex.sub(lambda m: _KEEP_LINES.sub(filler, m.group()), text)


def _lines_above(text: str, at: int, skip: str, take: str) -> str:
    """The lines right above ``at`` that begin with ``take``, past lines that begin with ``skip``."""
    kept, end = [], text.rfind("\n", 0, at) + 1
    while end:
        start = text.rfind("\n", 0, end - 1) + 1
        line = text[start:end].lstrip(" \t")
        if line.startswith(take):
            kept.append(line)
        elif kept or not line.startswith(skip):
            break
        end = start
    return "".join(reversed(kept))


def module_name(path: str) -> str:
    stem = path[:-3] if path.endswith(".py") else path
    parts = [p for p in stem.replace("\\", "/").split("/") if p and p != "."]
    if parts and parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) or "root"


def python_functions(path: str, text: str) -> list[tuple[str, str, str, str | None]]:
    """(qualified name, source, parameters, documentation) of every def, nested ones too."""
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    # a blanked string is no blank line, a comment is one
    masked = _PY_LEX.sub(lambda m: _KEEP_LINES.sub(" " if m.group()[0] == "#" else "\x01", m.group()), text)
    out, scope, base = [], [], module_name(path)
    for m in _PY_DEF.finditer(masked):
        indent, kind, name = len(m.group(1).expandtabs()), m.group(2), m.group(3)
        while scope and scope[-1][0] >= indent:
            scope.pop()
        qual = ".".join([base, *(n for _, n in scope), name])
        scope.append((indent, name))
        if kind == "class":
            continue
        # signature: from the name to the colon at bracket depth 0
        i, depth = m.end(), 0
        for x in _PY_SIGN.finditer(masked, i):
            i, c = x.start(), x.group()
            depth += (c in "([{") - (c in ")]}")
            if depth <= 0 and c in ":\n":
                break
        else:
            i = len(masked)
        params = masked[m.end() : i]
        # body: up to the next line that is indented no deeper
        end = len(masked)
        for x in _PY_LINE.finditer(masked, i) if masked[i : i + 1] == ":" else ():
            if len(x.group(1).expandtabs()) <= indent:
                end = x.start() + 1
                break
        doc = None
        d = _PY_DOC.match(text, i + 1, end)
        if d:
            doc = d.group(2)
        else:
            above = _lines_above(text, m.start(), "@", "#")
            if above:
                doc = re.sub(r"(?m)^[ \t]*#:?[ \t]?", "", above).strip() or None
        end = m.start() + len(masked[m.start() : end].rstrip())  # without the comments of what follows
        out.append((qual, text[m.start() : end], params, doc))
    return out


def javascript_functions(path: str, text: str) -> list[tuple[str, str, str, str | None]]:
    text = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    masked = _blank(_JS_LEX, text, " ")
    close, stack = {}, []
    for m in re.finditer(r"[{}]", masked):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    out, scope, base = [], [], re.sub(r"\.js$", "", path).replace("/", ".")
    for m in _JS_DEF.finditer(masked):
        fn, arrow, method, cls = m.groups()
        name = fn or arrow or method or cls
        if method in _NOT_METHODS:
            continue
        opening = masked.find("{", m.end() - 1)
        end = close.get(opening, len(masked) - 1) + 1
        while scope and scope[-1][0] <= m.start():
            scope.pop()
        qual = ".".join([base, *(n for _, n in scope), name])
        scope.append((end, name))
        if cls:
            continue
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        above = re.search(r"(/\*(?:(?!\*/).)*\*/|(?:[ \t]*//[^\n]*\n)+)\s*\Z", text[:start], re.S)
        doc = None
        if above:
            doc = re.sub(r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+)[ \t]?|\*/[ \t]*$", "", above.group(1)).strip() or None
        out.append((qual, text[start:end], masked[m.end() - 1 : opening], doc))
    return out


def extract_functions(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, qualified_name, source, params, doc, at) of the functions in the current content of each file; at counts them in a file.

    files: repo_id, file_path, content, parsed_at.  Files that do not parse are
    lexed as far as they go; empty files have no functions; a name defined twice
    in a file gives two rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for repo, path, at, h, lang, text in b[["repo_id", "file_path", "parsed_at", "h", "lang", "content"]].itertuples(index=False):
                found = python_functions(path, text) if lang == "python" else javascript_functions(path, text)
                rows.append((repo, path, at, h, [{"qualified_name": q, "source": s, "params": p, "doc": d, "at": i} for i, (q, s, p, d) in enumerate(found)]))
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "parsed_at", "h", "fns"])

    src = revisions(files).where(F.col("lang").isin("python", "javascript"))
    schema = "repo_id string, file_path string, parsed_at timestamp_ntz, h bigint, fns array<struct<qualified_name:string,source:string,params:string,doc:string,at:bigint>>"
    all_rev = src.withColumn("parsed_at", F.col("parsed_at").cast("timestamp_ntz")).mapInPandas(run, schema)
    return keep_current(all_rev).select("repo_id", "file_path", F.explode("fns").alias("f")).select("repo_id", "file_path", "f.*")


# Words that say nothing by themselves about what a function does.
_EMPTY_WORDS = set(
    """a an the this that these it its is are be of for to in on by with and or from
    function functions method methods class object instance constructor helper utility accessor getter setter property
    init initialise initialize initialises initializes initializer initialiser ctor self cls
    will which used use uses order takes take parameter parameters param params argument arguments arg args given value values
    returns return result results type rtype
    auto automatically generated autogenerated stub placeholder docstring doc docs documentation documented description describe short long summary
    todo fixme xxx tbd tba wip hack n no none na nil null available here write add missing fill later noqa pylint disable all type ignore mypy flake8
    see base super parent same as inherited inherit inherits overrides override overridden implementation implements interface
    _summary_ _description_ _type_
    el la los las le les un une une una der die das den dem ein eine di il lo o os du de des del
    beschreibung fehlt folgt noch à a compléter completer faire por documentar da fare pendiente documentacion documentación documentar documentare documenter dokumentieren dokumentiert documentato documentado zu descrizione descripción description manque manquante falta fehlend descrição completar rediger
    """.split()
)
# Legal wording.
_LEGAL = re.compile(r"copyright|©|all rights reserved|licen[cs]e|permission is granted|warrant|spdx|confidential|proprietary", re.I)
# A text that only points elsewhere or is a place holder as a whole.
_POINTER = re.compile(r"(?:see|cf\.?|refer to|as in|like|same as|siehe|voir|ver|vedi|inherited from|overrides?|implements|delegates to|wrapper (?:for|of|around)|alias (?:for|of))\b[^.!?\n]{0,60}[.!?]?", re.I)
_TODO = re.compile(r"(?:todo|fixme|xxx|tbd|t\.b\.d\.?|hack)\b[^\n]*", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+(?:[^\W_]|-)*")
_FIELD = re.compile(r"^\s*(?:[:@](?P<tag>param|parameter|arg|argument|type|return|returns|rtype|raises|raise|throws|var|ivar)\b\s*(?P<rest>[^:]*):?(?P<text>.*)|(?P<name>\*{0,2}\w+)\s*(?:\([^)]*\))?\s*:\s*(?P<text2>.*))$", re.I)
_HEADS = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|notes?|examples?|attributes|see also)\s*:?\s*$", re.I)
_SIGNATURE = re.compile(r"^\s*\w*\s*\([^()]*\)\s*(?:->\s*[\w\[\], .|]+)?\s*:?\s*$")


def _stem(w: str) -> str:
    w, before = w.lower(), ""
    while w != before:
        before = w
        for suffix in ("ization", "isation", "ising", "izing", "ations", "ation", "ing", "ies", "ied", "es", "ed", "s", "e", "y"):
            if w.endswith(suffix) and len(w) - len(suffix) >= 3:
                w = w[: -len(suffix)]
                break
    return w


def _content(text: str, known: set[str]) -> bool:
    for w in _WORD.findall(text):
        if w.lower() in _EMPTY_WORDS:
            continue
        s = _stem(w)
        if s in known or (len(s) > 3 and s[-1] == s[-2] and s[:-1] in known):
            continue
        return True
    return False


def informative(docstring: str | None, qualified_name: str | None, params: str | None) -> bool:
    """Does the text say more than the name and the signature?

    Empty and blank texts, place holders, skeletons, restated names, bare
    signatures, pointers elsewhere and legal notices do not.
    """
    if not docstring or not docstring.strip():
        return False
    known = {_stem(w) for part in re.split(r"[._]", (qualified_name or "").rsplit("::", 1)[-1]) for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", part)}
    known |= {_stem(w) for w in re.findall(r"[^\W\d_]+", params or "")}
    keep = []
    for line in _TODO.sub(" ", docstring).splitlines():
        if _LEGAL.search(line) or _HEADS.match(line) or _SIGNATURE.match(line):
            continue
        f = _FIELD.match(line)
        if f:
            tag = (f.group("tag") or "").lower()
            own = {_stem(w) for w in re.findall(r"[^\W\d_]+", (f.group("rest") or f.group("name") or "").replace("_", " "))}
            if tag in ("type", "rtype"):
                continue
            text = f.group("text") if tag else f.group("text2")
            if tag in ("raises", "raise", "throws") and text.strip() and _content(text, known):
                return True
            if f.group("name") and not tag and own - known and f.group("name").lower() not in _EMPTY_WORDS and not text.strip().startswith("_"):
                # "Note: ..." and the like: the label is no parameter, its words count
                if _content(line, known | own) or (text.strip() and not re.fullmatch(r"_\w+_", text.strip()) and _content(text, known)):
                    return True
                continue
            if _content(text, known | own):
                return True
            continue
        keep.append(line)
    sentences = re.split(r"(?<=[.!?])\s+|\n\s*\n", "\n".join(keep))
    return any(not _POINTER.fullmatch(s.strip()) and _content(s, known) for s in sentences if s.strip())


def informative_batch(docs: pd.Series, names: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([informative(*x) for x in zip(docs, names, params)], dtype="bool")


def latest_rows(nodes: DataFrame) -> DataFrame:
    """The row with the greatest observed_at of each id; equal times: the greatest row, so a rerun agrees; null ids are left out."""
    cols = [c for c in ("repo_id", "qualified_name", "file_path", "docstring") if c in nodes.columns]
    return (
        nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("observed_at", *cols)).alias("_r"))
        .select(F.col("id").alias("entity_id"), *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def documented_pairs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(entity_id, repo_id, file_path, qualified_name, source, docstring, attached) of the functions whose documentation says something.

    nodes: id, repo_id, qualified_name, file_path, docstring, observed_at;
    files: repo_id, file_path, content, parsed_at.  Functions come from the
    current files with the documentation attached there, and are matched with the
    latest row of their entity, whose docstring counts; attached tells whether it
    is the text that stands at the function.  Entities with no function in the
    current content (renamed, or file unknown) come by their stored row alone:
    source and attached are null.  The first of several definitions of a name
    counts.  Empty tables: no rows.
    """
    key = ["repo_id", "file_path", "qualified_name"]
    last = latest_rows(nodes).where(F.length(F.trim("docstring")) > 0)
    read = extract_functions(files).groupBy(*key).agg(F.min_by(F.struct("source", "params", "doc"), "at").alias("c")).select(*key, "c.*")

    def plain(text: str):
        return F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))

    says = F.pandas_udf(informative_batch, "boolean")
    pairs = read.join(last, key, "right").withColumn("attached", F.when(F.col("source").isNotNull(), F.coalesce(plain("doc") == plain("docstring"), F.lit(False))))
    return pairs.where(says("docstring", "qualified_name", "params")).select("entity_id", *key, "source", "docstring", "attached")
