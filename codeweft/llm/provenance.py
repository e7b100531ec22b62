"""Generated, minified or vendored source files and data saved as code (problem 6).

Repository attribute files (.gitattributes) declare paths as generated or
vendored; their globs are resolved per directory, the deepest file and the last
line winning.  For repositories that declare nothing, equivalent path patterns
are mined from all repositories: a pattern is kept if most of the files that
match it show by their content (a tool's header, minified lines, bulk data,
published upstream text) that nobody wrote them by hand there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from codeweft.llm.leakage import WordHashes, shingle_hashes, word_hashes, words
from codeweft.llm.sources import keep_current, revisions
from codeweft.sources.tables import cut_lineage

#: A mined pattern needs this share of files with evidence, this many of them, in this many repositories.
PATTERN_SHARE, PATTERN_FILES, PATTERN_REPOS = 0.6, 5, 2
#: Word shingles and similarity of a slightly changed copy of an upstream file.
SHINGLE_WORDS, COPY_SIMILARITY = 5, 0.8
#: A file that is upstream text to COPY_SIMILARITY is a shortened copy from this share of the upstream file on.
COPY_PART = 0.6
#: Hashes of upstream shingles (8 bytes each) are broadcast up to this many; beyond it they are joined by shuffle.
MAX_BROADCAST_SHINGLES = 2_000_000
#: Rules of attribute files are broadcast up to this many; beyond it repositories are split over SALTS.
MAX_BROADCAST_RULES, SALTS = 100_000, 16
#: Evidence of data or of a tool takes this many literals or lines: fewer may be anybody's.
MANY_LITERALS, MANY_LINES = 60, 12
# Attribute lines that hold by convention where a repository declares nothing else.
CONVENTIONS = """
vendor/** linguist-vendored
vendors/** linguist-vendored
_vendor/** linguist-vendored
third_party/** linguist-vendored
third-party/** linguist-vendored
thirdparty/** linguist-vendored
node_modules/** linguist-vendored
bower_components/** linguist-vendored
extern/** linguist-vendored
externals/** linguist-vendored
libs/external/** linguist-vendored
*.min.js linguist-generated
*.min.py linguist-generated
*.bundle.js linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*.gen.js linguist-generated
*.gen.py linguist-generated
"""

# What tools write above their output.
_MARK = re.compile(
    r"@generated\b|auto-?\s?generated\b|\bmachine[- ](?:output|generated|written)|\bdo not (?:edit|modify|change)\b|\bdon't edit\b"
    r"|\b(?:generated|produced|created|written|emitted|built) (?:automatically |auto |file )?(?:by|with|from|using) (?!hand\b|the authors?\b)\S+"
    r"|\bchanges (?:will|would) be (?:lost|overwritten)|\bregenerate (?:with|by|using)\b"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|editieren|ändern)"
    r"|générée? automatiquement|ne pas (?:modifier|éditer)|generad[oa] automáticamente|no (?:editar|modificar)"
    r"|gerad[oa] automaticamente|não (?:editar|modificar)|generat[oa] automaticamente|non modificare",
    re.I,
)
# A person speaking about generated files, or vouching for this one.
_BY_HAND = re.compile(r"\b(?:kept|written|maintained|checked|edited|tuned) by hand\b(?<!not modify by hand)|edit freely|\bhand-?(?:written|kept|maintained)\b|\b(?:checks?|reads?|parses?|finds?|lists?|handles?|tests?) (?:the )?(?:files? )?(?:that (?:are|were) )?generated\b", re.I)
_RELEASE = re.compile(r"^[#/*\s!]*[\w.-]+ v?\d+(?:\.\d+)+(?:\s*[-–|(].*)?$")
_STRING = re.compile(r"(?:\b[rRbBuUfF]{1,2})?(?:'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|`[^`]*`", re.S)
#: Strings that are statements of their own: documentation.
_DOCUMENTATION = re.compile(r"^[ \t]*[rRuU]?(?:'''.*?'''|\"\"\".*?\"\"\")[ \t]*$", re.M | re.S)
_COMMENT = re.compile(r"(?m)(?:#|//)[^\n]*$|/\*.*?\*/", re.S)
_KEYWORDS = frozenset("def class return if elif else for while function import from const let var try except raise throw with yield assert lambda async await exports".split())
_NAME, _NUMBER = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\b\d[\w.]*")
_NO_BLANKS = dict.fromkeys(map(ord, " \t\r\f"))
_STUB = re.compile(r"(?:\"\"\"|''')(?:auto-?generated \w+|generated \w+)\.?(?:\"\"\"|''')", re.I)
_MIGRATION = re.compile(r"^class Migration\((?:\w+\.)?Migration\):\s+(?:initial = \w+\s+)?dependencies = \[", re.M)
_ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2}){8,}")


def header(text: str) -> list[str]:
    """The comment lines, and the lines of a docstring or block comment, before the first code."""
    out, closing = [], None
    for line in text.splitlines():
        s = line.strip()
        if closing:
            out.append(s)
            if closing in s:
                closing = None
            continue
        if not s:
            continue
        if s.startswith(("#", "//")):
            out.append(s)
        elif s.startswith(('"""', "'''", "/*")):
            end = "*/" if s.startswith("/*") else s[:3]
            out.append(s)
            if end not in s[len(end) :]:
                closing = end
        else:
            break
    return out


def evidence(text: str) -> str | None:
    """What the content shows: generated, minified, data, vendored, or nothing (null).

    Comments and documentation strings tell only by what a tool wrote into the
    header; everything else is measured without them, at any length.
    """
    text = text.lstrip("\ufeff").replace("\r\n", "\n")
    if not text.strip():
        return None
    head = header(text)
    for line in head:
        if _MARK.search(line) and not _BY_HAND.search(line):
            return "generated"
    for line in head:
        if _RELEASE.match(line):
            return "vendored"
    if text.count("\\x") >= 8 and sum(map(len, _ESCAPED.findall(text))) > 0.4 * len(text):
        return "generated"
    if _MIGRATION.search(text):
        return "generated"
    bare = _DOCUMENTATION.sub("", text) if '"""' in text or "'''" in text else text
    noted, strings = _STRING.subn("\x01", bare)
    comments = _COMMENT.findall(noted)
    code = _COMMENT.sub("", noted) if comments else noted
    said = len(noted) - len(code)
    n = len(bare) - said
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return None
    blank = n - sum(map(len, bare.split())) + sum(len("".join(c.split())) for c in comments)
    keywords = sum(map(_KEYWORDS.__contains__, _NAME.findall(code))) + code.count("=>")
    code, numbers = _NUMBER.subn("0", code)
    shaped, names = _NAME.subn("N", code)
    letters = len(code) - len(shaped) + names + strings
    data = n - len(code)  # characters in strings and numbers
    if keywords * 1000 < 0.5 * n and letters < 0.3 * n and (numbers + strings >= MANY_LITERALS or data >= 10 * MANY_LITERALS):
        return "data"
    if n / len(lines) >= 150 and blank < 0.13 * n and names + numbers + strings >= MANY_LITERALS:
        return "minified" if keywords * 1000 >= 1.0 * n or letters > 0.1 * n else "data"
    shapes = Counter(x for x in shaped.translate(_NO_BLANKS).split("\n") if "N" in x)  # rows of a table are data, if enough of them
    total = sum(shapes.values())
    often = sum(k for x, k in shapes.most_common(3) if "(" in x or "{" in x)  # constants may be anybody's
    if total >= MANY_LINES and len(shapes) <= 0.25 * total and often >= 0.6 * total:  # the same few lines over and over
        return "generated"
    if len(_STUB.findall(text)) >= 3:
        return "generated"
    return None


class _Upstream:
    """Sorted hashes of the shingles of upstream files, looked up inside tasks; None: all shingles are kept."""

    def __init__(self, hashes: np.ndarray | None):
        self.hashes = hashes

    def of(self, text: str, seen: WordHashes) -> tuple[int, list[int]]:
        """(number of different shingles, those that stand in upstream files)."""
        h = np.unique(shingle_hashes(word_hashes(words(text), seen), SHINGLE_WORDS))
        if self.hashes is None:
            return len(h), h.tolist()
        if not len(h) or not len(self.hashes):
            return len(h), []
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return len(h), h[self.hashes[at] == h].tolist()


def _features(known: _Upstream):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for b in batches:
            found = [known.of(t, seen) for t in b["content"]]
            yield pd.DataFrame({
                "repo_id": b["repo_id"], "file_path": b["file_path"], "parsed_at": b["parsed_at"], "h": b["h"],
                "evidence": [evidence(t) for t in b["content"]], "rev": b["h"], "n_shingles": [n for n, _ in found], "shared": [s for _, s in found],
                "filled": [not t.isspace() and bool(t) for t in b["content"]],
            })

    return run


def _glob(pattern: str) -> str:
    """An attribute glob as a regular expression over paths below its directory."""
    anchored = "/" in pattern.rstrip("/")[:-1] or pattern.startswith("/")
    p = pattern.strip("/") if not pattern.endswith("/") else pattern.strip("/") + "/**"
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            out, i = out + "[" + p[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


_MACRO = re.compile(r"\[attr\](\S+)\s*(.*)")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"\s+(.*)')


def attribute_rules(base: str, text: str | None) -> list[dict]:
    """Rules of one attribute file; base is its directory ('' for the root).

    value is true (set), false (unset, or the value false) or null (!, made
    unspecified again: nothing is declared).  Macros hold where they are defined,
    in the file of the root; patterns in quotes are C strings; patterns that begin
    with ! are void.
    """
    macros: dict[str, list[str]] = {"binary": []}
    out = []
    for n, line in enumerate((text or "").splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = _MACRO.match(line)
        if m:
            if not base:
                macros[m.group(1)] = m.group(2).split()
            continue
        m = _QUOTED.match(line)
        if m:
            pattern, words_ = re.sub(r"\\(.)", r"\1", m.group(1)), m.group(2).split()
        else:
            pattern, *words_ = line.split()
        if pattern.startswith("!"):
            continue
        said: dict[str, bool | None] = {}
        for w in words_:
            name = w.lstrip("-!")
            for x in [w, *(y for y in macros.get(name, ()) if w == name)]:  # only a macro that is set is written out
                a = re.fullmatch(r"([-!]?)(?:linguist-)?(generated|vendored)(?:=(\w+))?", x)
                if a:
                    said[a.group(2)] = None if a.group(1) == "!" or a.group(3) == "unspecified" else a.group(1) != "-" and a.group(3) not in ("false", "unset", "0", "no", "off")
        out += [{"base": base, "depth": base.count("/") + bool(base), "line": n, "pattern": _glob(pattern), "attr": k, "value": v} for k, v in said.items()]
    return out


def _rules_of(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([attribute_rules(p.rpartition("/")[0], t) for p, t in zip(paths, texts)])


_RULE = "array<struct<base:string,depth:int,line:int,pattern:string,attr:string,value:boolean>>"


def _resolve(paths: pd.Series, rules: pd.Series) -> pd.Series:
    """What the rules of its repository say of each path: per attribute the deepest file and the last line count."""
    compiled: dict[str, re.Pattern] = {}
    out = []
    for path, rs in zip(paths, rules):
        said: dict[str, tuple] = {}
        for r in rs:
            base = r["base"]
            if base and not path.startswith(base + "/"):
                continue
            if r["pattern"] not in compiled:
                compiled[r["pattern"]] = re.compile(r["pattern"])
            if compiled[r["pattern"]].search(path[len(base) + 1 :] if base else path):
                said[r["attr"]] = max(said.get(r["attr"], (-1, -1, None)), (r["depth"], r["line"], r["value"]), key=lambda x: x[:2])
        values = [v for *_, v in said.values() if v is not None]
        out.append(any(values) if values else None)
    return pd.Series(out, dtype="boolean")


def declared(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, file_path, declared): what the repository's own attribute files say; files nothing is said of are left out."""
    own = files.where(F.col("file_path").rlike(r"(?:^|/)\.gitattributes$") & F.col("repo_id").isNotNull())
    latest = own.groupBy("repo_id", "file_path").agg(F.max(F.struct("parsed_at", "content")).alias("r"))
    parse = F.pandas_udf(_rules_of, _RULE)
    # All rules of a repository in one row: the attribute files of one repository only.
    rules = cut_lineage(latest.select("repo_id", parse("file_path", "r.content").alias("rs")).groupBy("repo_id").agg(F.flatten(F.collect_list("rs")).alias("rules")))
    if (rules.agg(F.sum(F.size("rules"))).first()[0] or 0) <= MAX_BROADCAST_RULES:
        both = paths.join(F.broadcast(rules), "repo_id")
    else:
        salted = paths.withColumn("_salt", F.pmod(F.xxhash64("file_path"), F.lit(SALTS)).cast("int"))
        both = salted.join(rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["repo_id", "_salt"])
    resolve = F.pandas_udf(_resolve, "boolean").asNondeterministic()
    return both.select("repo_id", "file_path", resolve("file_path", "rules").alias("declared")).where("declared IS NOT NULL")


def path_patterns(path_col: str = "file_path"):
    """Array of globs a path matches: each of its directories, its first two directories, the tail of its name."""
    dirs = F.split(path_col, "/")
    inner = F.slice(dirs, F.lit(1), F.size(dirs) - 1)
    name = F.element_at(dirs, -1)
    top2 = F.when(F.size(dirs) > 2, F.concat(dirs[0], F.lit("/"), dirs[1], F.lit("/**")))
    dotted = F.regexp_extract(name, r"^[^.]+(\.[^.]+\.[^.]+)$", 1)
    tail = F.regexp_extract(name, r"^.+(_[A-Za-z0-9]+\.[A-Za-z]+)$", 1)
    some = F.array(top2, F.when(dotted != "", F.concat(F.lit("*"), dotted)), F.when(tail != "", F.concat(F.lit("*"), tail)))
    return F.array_distinct(F.array_compact(F.concat(F.transform(inner, lambda x: F.concat(F.lit("**/"), x, F.lit("/**"))), some)))


def upstream_shingles(upstream: DataFrame) -> DataFrame:
    """(up_id, n_up, h): the different shingles of every upstream file, and how many it has; repeated files count once."""
    up = upstream.where(F.length("content") > 0).select(F.xxhash64("package", "version", "file_path", "content").alias("up_id"), "content").dropDuplicates(["up_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, every = WordHashes(), _Upstream(None)
        for b in batches:
            found = [every.of(t, seen) for t in b["content"]]
            yield pd.DataFrame({"up_id": b["up_id"], "n_up": [n for n, _ in found], "hs": [s for _, s in found]})

    return cut_lineage(up.mapInPandas(run, "up_id bigint, n_up bigint, hs array<bigint>").select("up_id", "n_up", F.explode("hs").alias("h")))


def upstream_copies(feats: DataFrame, ups: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo_id, file_path): current files that are an upstream file, unchanged, slightly changed or shortened.

    A file is a copy if the Jaccard similarity of the different 5-word shingles is
    0.8 or more, or if 0.8 of its shingles are COPY_PART of an upstream file.  In
    both cases it holds COPY_PART of that file, so it holds one of its rarest
    shingles, as many of them as that share leaves out and one: these are joined,
    and pairs that meet the bounds are counted out exactly.  Files of fewer than
    five words are compared as a whole.
    """
    hits = feats.select("repo_id", "file_path", "n_shingles", F.explode("shared").alias("h"))
    df = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("up_id").orderBy("df", "h"))
    prefix = ups.join(df, "h").withColumn("_r", rank).join(ups.groupBy("up_id").agg(F.count(F.lit(1)).alias("_all")), "up_id")
    prefix = prefix.withColumn("_absent", F.col("_all") - F.count(F.lit(1)).over(Window.partitionBy("up_id")))  # shingles found nowhere are the rarest
    prefix = prefix.where(F.col("_r") + F.col("_absent") <= F.col("n_up") - F.ceil(F.lit(COPY_PART) * F.col("n_up")) + 1).select("up_id", "n_up", "h")
    cand = hits.join(prefix, "h").where((F.col("n_shingles") >= F.lit(COPY_PART) * F.col("n_up")) & (F.lit(COPY_SIMILARITY) * F.col("n_shingles") <= F.col("n_up"))).select("repo_id", "file_path", "up_id").distinct()
    whole = ups.groupBy("up_id", "n_up").agg(F.collect_set("h").alias("hs"))
    both = cand.join(feats.select("repo_id", "file_path", "n_shingles", "shared"), ["repo_id", "file_path"]).join(whole, "up_id")
    n = F.size(F.array_intersect("shared", "hs"))
    copy = (n >= F.lit(COPY_SIMILARITY) * (F.col("n_shingles") + F.col("n_up") - n)) | ((n >= F.lit(COPY_SIMILARITY) * F.col("n_shingles")) & (n >= F.lit(COPY_PART) * F.col("n_up")))
    same = upstream.where(F.length(F.trim("content")) > 0).select(F.xxhash64("content").alias("rev")).distinct()
    tiny = feats.where("n_shingles = 0 AND filled").join(same, "rev", "left_semi").select("repo_id", "file_path")
    return both.where(copy).select("repo_id", "file_path").union(tiny).distinct()


def not_by_hand(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo_id, file_path, reason): the .py and .js files whose current content nobody wrote by hand in that repository.

    files: repo_id, file_path, content, parsed_at; upstream: package, version,
    file_path, content.  reason is declared, upstream, the evidence of the
    content, or pattern.  A declaration of the repository that a path is neither
    generated nor vendored holds against patterns and content.  Empty files are
    no cases by content, but can match a pattern only if they have some content.
    Empty tables: no rows; an empty upstream table only leaves out its copies.
    """
    src = revisions(files).where(F.col("lang").isin("python", "javascript")).withColumn("parsed_at", F.col("parsed_at").cast("timestamp_ntz"))
    schema = "repo_id string, file_path string, parsed_at timestamp_ntz, h bigint, evidence string, rev bigint, n_shingles bigint, shared array<bigint>, filled boolean"
    ups = upstream_shingles(upstream)
    some = ups.select("h").distinct().limit(MAX_BROADCAST_SHINGLES + 1).toPandas()["h"].to_numpy(np.int64)
    known = _Upstream(np.sort(some) if len(some) <= MAX_BROADCAST_SHINGLES else None)
    feats = cut_lineage(keep_current(src.mapInPandas(_features(known), schema)))
    copies = cut_lineage(upstream_copies(feats, ups, upstream))
    said = declared(feats.select("repo_id", "file_path"), files)
    seen = (
        feats.select("repo_id", "file_path", "evidence", "filled")
        .join(copies.withColumn("copy", F.lit(True)), ["repo_id", "file_path"], "left")
        .withColumn("shown", F.coalesce(F.when(F.col("copy"), "upstream"), "evidence"))
    )
    tagged = seen.select("repo_id", "file_path", "filled", "shown", F.explode(path_patterns()).alias("glob"))
    mined = (
        tagged.groupBy("glob", "repo_id").agg(F.count(F.lit(1)).alias("n"), F.count("shown").alias("k"))
        .groupBy("glob").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum((F.col("k") > 0).cast("long")).alias("repos"))
        .where((F.col("k") >= PATTERN_FILES) & (F.col("repos") >= PATTERN_REPOS) & (F.col("k") >= PATTERN_SHARE * F.col("n"))).select("glob")
    )
    by_rule = tagged.where("filled").join(mined, "glob", "left_semi").select("repo_id", "file_path").distinct().withColumn("rule", F.lit(True))
    usual = None
    for r in attribute_rules("", CONVENTIONS):
        hit = F.col("file_path").rlike(r["pattern"])
        usual = hit if usual is None else usual | hit
    out = (
        seen.join(by_rule, ["repo_id", "file_path"], "left").join(said, ["repo_id", "file_path"], "left")
        .withColumn("reason", F.when(F.col("declared"), "declared").when(F.col("declared") == F.lit(False), F.lit(None)).otherwise(
            F.coalesce("shown", F.when(F.col("rule") | (usual & F.col("filled")), "pattern"))))
    )
    return out.where("reason IS NOT NULL").select("repo_id", "file_path", "reason")


def provenance_report(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo_id, reason, n_files)."""
    return not_by_hand(files, upstream).groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("n_files"))
