"""Evaluation texts leaking into training text (problem 8).

A prefix-filtered set join.  A document that shares 20 consecutive words with an
item holds all sixteen 5-word shingles of such a window, so one shingle of the
window is a necessary prefix, and the rarest one in the corpus is chosen.  The
positional bound fixes where the window must lie in the document, and the words
of item-sized windows are compared exactly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

SHINGLE_WORDS = 5
RUN_WORDS = 20
#: Shingles of the items are broadcast up to this many rows (24 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_SHINGLES = 500_000
#: Ids of documents with candidates are broadcast up to this many (8 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_DOCS = 2_000_000

_WORD, _ASCII_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, without case and without invisible format characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    text = unicodedata.normalize("NFKC", text.casefold())
    return _WORD.findall(text.lower())


class WordHashes(dict):
    """Word to hash, remembered; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(ws: list[str], seen: WordHashes) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every run of n words."""
    if len(h) < n:
        return np.empty(0, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingle_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, shingles ARRAY<BIGINT>) in word order; texts of fewer than five words have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for b in batches:
            h = [word_hashes(words(t), seen) for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "n_words": [len(x) for x in h], "shingles": [shingle_hashes(x, SHINGLE_WORDS) for x in h]})

    src = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = src.mapInPandas(run, "_id bigint, n_words bigint, shingles array<bigint>")
    return out.withColumnRenamed("_id", id_col)


def _longest(a: list[str], b: list[str], diagonals: list[int]) -> int:
    """Longest common run of words on any of the diagonals (position in a less position in b)."""
    best = 0
    for o in diagonals:
        run = 0
        for j in range(max(0, -o), min(len(b), len(a) - o)):
            run = run + 1 if a[j + o] == b[j] else 0
            best = max(best, run)
    return best


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every document is split into words once, whatever the number of its candidate items."""
    memo: dict[str, list[str]] = {}
    for batch in batches:
        rows = []
        for doc_id, text, cands in zip(batch["doc_id"], batch["_doc"], batch["cands"]):
            a = words(text)
            for c in cands:
                if c["item"] not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[c["item"]] = words(c["item"])
                run = _longest(a, memo[c["item"]], c["diagonals"])
                if run >= RUN_WORDS:
                    rows.append((doc_id, c["item_id"], run))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run_words"])


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run_words): documents sharing at least 20 consecutive words with an item.

    docs: doc_id, text; items: item_id, text; further columns are ignored.  Null
    and short texts leak nothing; an item of fewer than 20 words cannot leak.
    Copies of a document, and items with the same text, are cases each for
    itself.  Every document and every position takes part.
    """
    need = RUN_WORDS - SHINGLE_WORDS + 1
    item_sh = shingle_rows(items.where(F.col("text").isNotNull()), "item_id", "text").where(F.col("n_words") >= RUN_WORDS)
    item_pos = item_sh.select("item_id", F.posexplode("shingles").alias("ipos", "h"))
    wanted = item_pos.select("h").distinct()
    few = item_pos.limit(MAX_BROADCAST_SHINGLES + 1).count() <= MAX_BROADCAST_SHINGLES
    if few:
        wanted = F.broadcast(wanted)
    hits = (
        shingle_rows(docs.where(F.col("text").isNotNull()), "doc_id", "text").where(F.col("n_words") >= RUN_WORDS)
        .select("doc_id", "n_words", F.posexplode("shingles").alias("dpos", "h"))
        .join(wanted, "h", "left_semi")
    )
    hits = _kept(hits)
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = item_pos.join(rarity, "h")
    # For each window start: the rarest of its sixteen shingles; a window with a shingle absent from the corpus cannot leak.
    win = ranked.select("item_id", "ipos", "h", "df", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - (need - 1)), F.col("ipos"))).alias("start"))
    prefix = (
        win.groupBy("item_id", "start").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "ipos", "h")).alias("r"))
        .where(F.col("n") == need).select("item_id", F.col("r.ipos").alias("ipos"), F.col("r.h").alias("h")).distinct()
    )
    if few:  # no more rows than shingles of the items: phrases found all over the corpus need no shuffle
        prefix = F.broadcast(prefix)
    pairs = hits.join(prefix, "h").groupBy("doc_id", "item_id").agg(F.collect_set((F.col("dpos") - F.col("ipos")).cast("long")).alias("diagonals"))
    pairs = pairs.join(items.select("item_id", F.col("text").alias("item")), "item_id")
    cand = _kept(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item", "diagonals")).alias("cands")))
    ids = cand.select("doc_id")
    if cand.count() <= MAX_BROADCAST_DOCS:
        ids = F.broadcast(ids)
    # only documents with candidates are read again, and shuffled
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_doc")).join(ids, "doc_id", "left_semi")
    return texts.join(cand, "doc_id").mapInPandas(_verify, "doc_id bigint, item_id bigint, run_words bigint")


def _kept(df: DataFrame) -> DataFrame:
    """The matches are used three times: kept on disk in the shared folder, so that the texts are read once."""
    from codeweft.sources.tables import cut_lineage

    return cut_lineage(df)


def leak_report(leaks: DataFrame) -> DataFrame:
    """(item_id, n_docs, longest_run) per leaked item."""
    return leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("run_words").alias("longest_run"))
