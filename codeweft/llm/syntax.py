"""Source files that do not parse (problem 1).

Every file is lexed into segments (see ``shapes``).  The distinct segments of all
files go through the grammars once each, wherever they occur; a segment that does
not derive flags its files.  Flagged files are read again: the error-correcting
chart (see ``chart``) gives each of their segments a least-cost repair with the
place of every edit, and the places tell truncation, merge conflict and wrong
language apart.  Where the language has an exact reader here, it has the last
word on the flagged files, and on no others.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeweft.llm.chart import adopt, compiled, derives, split_segment
from codeweft.llm.shapes import SEGMENTERS, distinct_segments, line_and_column
from codeweft.llm.sources import keep_current, revisions
from codeweft.sources.tables import cut_lineage

_CONFLICT = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?: [^\n]*)?$", re.M)
_TOP = re.compile(r"^[^\s#)\]}/*]", re.M)
#: Flagged files are broadcast up to so many bytes of keys; beyond it their content comes by a shuffle join.
MAX_BROADCAST_BYTES = 32 << 20


#: What the segmenters themselves ask of the grammars.
_ASKED = {"py": ["one_target", "some_targets", "some_star_targets", "list_targets", "list_star_targets", "paren"], "js": ["array", "array_pattern", "object", "object_pattern", "paren_place"]}


def _lexer(tables: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adopt(tables)
        return _lex(batches)

    return run


def _lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        segs = [distinct_segments(lang, text) for lang, text in zip(b["lang"], b["content"])]
        yield pd.DataFrame({"repo_id": b["repo_id"], "file_path": b["file_path"], "parsed_at": b["parsed_at"], "h": b["h"], "lang": b["lang"], "rev": b["h"], "segments": segs})


def _judge(tables: dict):
    def judge(segments: pd.Series) -> pd.Series:
        adopt(tables)
        return pd.Series([derives(s) for s in segments], dtype="bool")

    return judge


def refuses(lang: str, text: str) -> bool | None:
    """Does the exact reader of the language refuse the text? None: it has none, or the text is too deep for it.

    A leading byte order mark is no part of the text, and a coding line says nothing: all is UTF-8.
    """
    text = text.removeprefix("\ufeff")
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "json":
            def wrong(constant: str):
                raise ValueError(constant)

            json.loads(text, parse_constant=wrong, parse_int=len)  # int() refuses long numbers
        elif lang == "toml":
            tomllib.loads(text.replace("\r\n", "\n"))
        else:
            return None
        return False
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return True


def parses(lang: str, text: str) -> bool:
    """Does the exact reader take the text?"""
    return refuses(lang, text) is False


def file_repairs(lang: str, text: str, known: dict[str, list] | None = None) -> dict:
    """The least-cost repair of a file: edits (line, column, op, part), n_segments, n_bad and kind.

    op: + a token put in, - taken out, ~ replaced; part: the kind of part that
    does not derive.  kind: conflict (an edit on a marker line), mismatch (most
    segments need edits), truncation (the edits lie in the last top-level part and
    one of them at the end of the file or at a bracket left open), else local.
    """
    known = {} if known is None else known
    short, cut = SEGMENTERS[lang]
    text = text.replace("\r\n", "\n").replace("\r", "\n") if lang in ("python", "javascript") else text.replace("\r\n", "\n") if lang == "toml" else text
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    segments = cut(text)
    end = max((o[-1] for *_, o in segments if o), default=0)
    edits, bad, opened = [], 0, False
    for goal, shape, places in segments:
        key = f"{short}.{goal} {shape}"
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            known[key] = [] if derives(key) else split_segment(key)[0].repair(goal, shape)
        bad += bool(known[key])
        for at, op in known[key]:
            place = places[min(at, len(places) - 1)] if places else 0
            opened = opened or (op != "+" and shape[at] in "([{") or (line_and_column(starts, place)[0] == line_and_column(starts, end)[0])
            edits.append((*line_and_column(starts, place), op, goal, place))
    edits.sort(key=lambda e: (e[4], e[2]))
    marked = {line_and_column(starts, m.start())[0] for m in _CONFLICT.finditer(text)}
    tops = [m.start() for m in _TOP.finditer(text)] if lang != "json" else [0]
    if any(e[0] in marked for e in edits):
        kind = "conflict"
    elif bad * 2 > len(segments):
        kind = "mismatch"
    elif edits and opened and edits[0][4] >= (tops[-1] if tops else 0):
        kind = "truncation"
    else:
        kind = "local"
    return {"edits": [{"line": a, "column": b, "op": op, "part": part} for a, b, op, part, _ in edits], "n_segments": len(segments), "n_bad": bad, "kind": kind}


_REPAIR = "repo_id string, file_path string, lang string, edits bigint, n_segments bigint, n_bad bigint, kind string, places array<struct<line:bigint,column:bigint,op:string,part:string>>"


def _refused(langs: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([refuses(*x) is not False for x in zip(langs, texts)], dtype="bool")


def _repairer(tables: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adopt(tables)
        known: dict[str, list] = {}
        for b in batches:
            rows = []
            for repo, path, lang, text in zip(b["repo_id"], b["file_path"], b["lang"], b["content"]):
                r = file_repairs(lang, text, known)
                rows.append((repo, path, lang, len(r["edits"]), r["n_segments"], r["n_bad"], r["kind"], r["edits"]))
            yield pd.DataFrame(rows, columns=["repo_id", "file_path", "lang", "edits", "n_segments", "n_bad", "kind", "places"])

    return run


def flagged_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, lang, rev) of the files of whose current content a segment does not derive; rev is the content's hash."""
    src = revisions(files).where(F.col("lang").isNotNull()).withColumn("parsed_at", F.col("parsed_at").cast("timestamp_ntz"))
    schema = "repo_id string, file_path string, parsed_at timestamp_ntz, h bigint, lang string, rev bigint, segments array<string>"
    lexed = cut_lineage(keep_current(src.mapInPandas(_lexer(compiled(_ASKED)), schema)))
    # A shape recurs all over a corpus: each is parsed once.  Not by segment alone: that would be the partitioning of the distinct, and be merged with it into few tasks.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = lexed.select(F.explode("segments").alias("segment")).distinct().repartition(parts, F.xxhash64("segment", F.lit(7)))
    fine = F.pandas_udf(_judge(compiled()), "boolean").asNondeterministic()  # else it is pushed below the distinct
    bad = shapes.select("segment", fine("segment").alias("fine")).where("not fine").select("segment")
    hit = lexed.select("repo_id", "file_path", "lang", "rev", F.explode("segments").alias("segment")).join(bad, "segment", "left_semi")
    return hit.select("repo_id", "file_path", "lang", "rev").distinct()


def syntax_repairs(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, lang, edits, n_segments, n_bad, kind, places) of every file whose current content does not parse.

    files: repo_id, file_path, content, parsed_at; only .py, .js, .json and .toml
    files take part.  edits is the least number of tokens to put in, take out or
    replace, summed over the file's segments; places has the line, column, edit
    and part of each (see ``file_repairs`` for these and kind).  Empty Python,
    JavaScript and TOML files parse, empty JSON does not; null content counts as
    empty.  Exact duplicates and older revisions give no further rows.  Empty
    table: no rows.
    """
    # several rows may hold the same revision
    return _invalid_texts(files).mapInPandas(_repairer(compiled()), _REPAIR).dropDuplicates(["repo_id", "file_path"])


def _invalid_texts(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, lang, content): the flagged files that no exact reader takes."""
    flagged = cut_lineage(flagged_files(files))
    size = flagged.agg(F.coalesce(F.sum(F.length("repo_id") + F.length("file_path") + 64), F.lit(0))).first()[0]
    keys = flagged.select("repo_id", "file_path", F.col("rev").alias("h"))
    if size <= MAX_BROADCAST_BYTES:
        keys = F.broadcast(keys)
    texts = revisions(files).select("repo_id", "file_path", "h", "lang", "content").join(keys, ["repo_id", "file_path", "h"], "left_semi")
    refused = F.pandas_udf(_refused, "boolean").asNondeterministic()  # else it is pushed below the join and every file is read
    return texts.where(refused("lang", "content")).select("repo_id", "file_path", "lang", "content")


def invalid_files(files: DataFrame) -> DataFrame:
    """(repo_id, file_path) of ``syntax_repairs``, whose repairs are not counted out: a segment that does not derive costs an edit at least."""
    return _invalid_texts(files).select("repo_id", "file_path").distinct()


def _current_recorded(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, lang, said, node_types): what the row of the current content was recorded with."""
    rows = revisions(files, "has_syntax_errors", "errors").where(F.col("lang").isNotNull())
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce("errors", F.array()), lambda e: e["node_type"])))
    said = F.struct("parsed_at", "h", F.coalesce("has_syntax_errors", F.lit(False)).alias("said"), types.alias("node_types"), "lang")
    return rows.groupBy("repo_id", "file_path").agg(F.max(said).alias("r")).select("repo_id", "file_path", "r.lang", "r.said", "r.node_types")


def syntax_report(files: DataFrame) -> DataFrame:
    """(repo_id, lang, n_files, n_invalid, rate, n_recorded): counts per repository and language.

    n_recorded: invalid files whose current row was recorded with has_syntax_errors.
    """
    current = _current_recorded(files)
    found = invalid_files(files).withColumn("bad", F.lit(1))
    j = current.join(found, ["repo_id", "file_path"], "left")
    return j.groupBy("repo_id", "lang").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"), (F.count("bad") / F.count(F.lit(1))).alias("rate"),
        F.sum((F.col("bad").isNotNull() & F.col("said")).cast("long")).alias("n_recorded"),
    )


def recorded_types(files: DataFrame) -> DataFrame:
    """(lang, kind, node_type, n_files): the recorded node types of current rows against what is found; kind is 'valid' for files that parse.

    A file counts once for each of its distinct node types, under a null type if none was recorded.
    """
    found = syntax_repairs(files).select("repo_id", "file_path", "kind")
    j = _current_recorded(files).join(found, ["repo_id", "file_path"], "left")
    return j.select("lang", F.coalesce("kind", F.lit("valid")).alias("kind"), F.explode_outer("node_types").alias("node_type")).groupBy("lang", "kind", "node_type").agg(F.count(F.lit(1)).alias("n_files"))
