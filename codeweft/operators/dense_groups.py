"""Per-key results when a few keys hold most records (problem 4).

One dictionary numbers the frequent keys.  Every input split encodes its rows with
it and adds into dense numpy arrays (bincount for sums, a scatter-maximum for the
newest row); the arrays are sent on as blocks, one a split, and the blocks are
summed by a distributed reduction.  Keys that are in no dictionary are
accumulated in a dictionary of the split and added up as single entries.  So a
split sends at most one number per key, however many rows that key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codeweft.sources.tables import cut_lineage

#: Slots of one accumulator block; a block that is full is sent on and begun anew, which bounds a task's memory.
BLOCK_SLOTS = 1 << 16
#: Keys in the dictionary of all splits, at most, and the share of a split's rows from which on a key is proposed for it.
DICTIONARY_KEYS, PROPOSED_SHARE = 4096, 0.001
#: Numbers in one block of an array.
BLOCK_NUMBERS = 512


class _Block:
    """Dense accumulators over the dictionary codes of one split."""

    def __init__(self, n_sums: int, with_max: bool):
        self.codes: dict[str, int] = {}
        self.sums = np.zeros((n_sums, 1024), np.int64)
        self.top = np.full(1024, np.iinfo(np.int64).min, np.int64) if with_max else None

    def add(self, keys: pa.Array, weights: list[np.ndarray | None], newest: np.ndarray | None) -> None:
        enc = keys.dictionary_encode()
        codes = self.codes
        to_dense = np.fromiter((codes.setdefault(k, len(codes)) for k in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
        idx = to_dense[enc.indices.to_numpy(zero_copy_only=False)]
        size = self.sums.shape[1]
        if len(codes) > size:
            size = 1 << (len(codes) - 1).bit_length()
            self.sums = np.pad(self.sums, ((0, 0), (0, size - self.sums.shape[1])))
            if self.top is not None:
                self.top = np.pad(self.top, (0, size - len(self.top)), constant_values=np.iinfo(np.int64).min)
        for i, w in enumerate(weights):
            if w is None:
                self.sums[i] += np.bincount(idx, minlength=size)
            else:
                np.add.at(self.sums[i], idx, w)  # exact in int64, unlike bincount's float weights
        if self.top is not None and newest is not None:
            np.maximum.at(self.top, idx, newest)

    def flush(self, names: list[str], key: str) -> pa.RecordBatch:
        n = len(self.codes)
        cols = [pa.array(list(self.codes), pa.string())] + [pa.array(s[:n]) for s in self.sums]
        if self.top is not None:
            none = self.top[:n] == np.iinfo(np.int64).min
            cols.append(pa.array(self.top[:n], mask=none))
        return pa.RecordBatch.from_arrays(cols, names=[key, *names])


def frequent_keys(df: DataFrame, key: str) -> list[str]:
    """The keys that weigh most in the splits where they are frequent, at most DICTIONARY_KEYS.

    A key with PROPOSED_SHARE of all rows has that share in some split, so it is
    proposed there; a split proposes at most 1/PROPOSED_SHARE keys (twice as many
    where its counters had to be thinned).  Which keys get in matters for speed only.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        total = lost = 0
        for b in batches:
            for k, n in zip(*(x.to_pylist() for x in pc.value_counts(b.column(0)).flatten())):
                counts[k] = counts.get(k, 0) + n
                total += n
            if len(counts) > BLOCK_SLOTS:  # the least counters give way, all by as much
                cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) // 2)[len(counts) // 2])
                counts = {k: n - cut for k, n in counts.items() if n > cut}
                lost += cut
        kept = [(k, n) for k, n in counts.items() if n + lost >= PROPOSED_SHARE * total]
        kept = sorted(kept, key=lambda x: (-x[1], x[0]))[: int(2 / PROPOSED_SHARE)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["k", "n"])

    proposed = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).mapInArrow(propose, "k string, n bigint")
    top = proposed.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(DICTIONARY_KEYS)
    return [r[0] for r in top.collect()]


def dense_group_stats(df: DataFrame, key: str, sums: dict[str, str | None], newest: str | None = None) -> DataFrame:
    """(key, one column per entry of ``sums``[, newest]) per non-null key.

    sums maps an output name to a BIGINT column to add, or to None to count rows
    (null values add nothing).  newest: a BIGINT column of which the greatest
    value is kept (null if a key has no value).  Rows with a null key are left
    out; empty input gives no rows.  Ties and repeated rows need no care: sums
    and maxima do not depend on order.
    """
    names = list(sums)
    cols = [F.col(key).cast("string").alias("_k")] + [F.col(c).cast("long").alias(f"_w{i}") for i, c in enumerate(sums.values()) if c]
    if newest:
        cols.append(F.col(newest).cast("long").alias("_new"))
    values = list(sums.values())
    src = df.select(*cols).where(F.col("_k").isNotNull())
    known = frequent_keys(src, "_k")
    codes = {k: i for i, k in enumerate(known)}
    least = int(np.iinfo(np.int64).min)
    tops = ["_new"] if newest else []
    # counts come last: keys without rows in a split are told by it
    fields = [("_k", pa.string())] + [(n, pa.int64()) for n in [*names, *tops]] + [("_block", pa.int64()), ("_parts", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(names) + len(tops) + 1
        dense = np.zeros((width, len(known)), np.int64)
        if newest:
            dense[len(names)] = least
        rare = None

        def entries(block: _Block) -> pa.RecordBatch:
            out = block.flush([*names, *tops], "_k")
            return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.int64()), pa.nulls(out.num_rows, pa.list_(pa.int64()))], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            at = lambda c, default: pc.fill_null(b.column(b.schema.get_field_index(c)), default).to_numpy(zero_copy_only=False)
            weights = [at(f"_w{i}", 0) if c else None for i, c in enumerate(values)]
            new = at("_new", least) if newest else None
            enc = b.column(0).dictionary_encode()
            to_code = np.fromiter((codes.get(k, -1) for k in enc.dictionary.to_pylist()), np.int64, len(enc.dictionary))
            idx = to_code[enc.indices.to_numpy(zero_copy_only=False)]
            hit = idx >= 0
            if hit.any():
                i = idx[hit]
                for j, w in enumerate(weights):
                    if w is None:
                        dense[j] += np.bincount(i, minlength=len(known))
                    else:
                        np.add.at(dense[j], i, w[hit])  # exact in int64, unlike bincount's float weights
                if newest:
                    np.maximum.at(dense[len(names)], i, new[hit])
                dense[-1] += np.bincount(i, minlength=len(known))
            if not hit.all():
                m = ~hit
                rare = rare or _Block(len(names), bool(newest))
                rare.add(b.column(0).filter(pa.array(m)), [None if w is None else w[m] for w in weights], new[m] if newest else None)
                if len(rare.codes) >= BLOCK_SLOTS:
                    yield entries(rare)
                    rare = None
        if rare:
            yield entries(rare)
        starts = [s for s in range(0, len(known), BLOCK_NUMBERS) if dense[-1, s : s + BLOCK_NUMBERS].any()]
        if starts:
            parts = [dense[:, s : s + BLOCK_NUMBERS].ravel().tolist() for s in starts]
            none = [pa.nulls(len(starts), f.type) for f in list(schema)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(starts, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], schema=schema)

    ddl = ", ".join(["_k string"] + [f"`{n}` bigint" for n in [*names, *tops]] + ["_block bigint", "_parts array<bigint>"])
    partial = cut_lineage(src.mapInArrow(accumulate, ddl))
    single = partial.where("_block IS NULL").groupBy("_k").agg(*[F.sum(n).alias(n) for n in names], *[F.max(n).alias(n) for n in tops])
    # Blocks meet number by number: every task adds up those it holds before they are sent on.
    size = F.least(F.lit(BLOCK_NUMBERS), F.lit(len(known)) - F.col("_block"))
    flat = partial.where("_block IS NOT NULL").select("_block", size.alias("_size"), F.posexplode("_parts").alias("_at", "_v"))
    flat = flat.select((F.col("_block") + F.col("_at") % F.col("_size")).alias("code"), F.floor(F.col("_at") / F.col("_size")).cast("int").alias("row"), "_v")
    row = lambda i: F.when(F.col("row") == i, F.col("_v"))
    whole = flat.groupBy("code").agg(
        *[F.sum(row(i)).alias(n) for i, n in enumerate(names)], *[F.nullif(F.max(row(len(names))), F.lit(least)).alias(n) for n in tops], F.sum(row(len(names) + len(tops))).alias("_rows")
    ).where("_rows > 0")
    spark = df.sparkSession
    dictionary = F.broadcast(spark.createDataFrame(list(enumerate(known)), "code bigint, _k string"))  # at most DICTIONARY_KEYS rows
    every = single.unionByName(whole.join(dictionary, "code").select("_k", *names, *tops))
    return every.select(F.col("_k").alias(key), *names, *[F.col("_new").alias("newest") for _ in tops])


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n_rows) of the non-null keys in at least ``share`` of all rows (rows with a null key count in the total)."""
    total = df.count()
    return dense_group_stats(df, key, {"n_rows": None}).where(F.col("n_rows") >= share * total)


def key_stats(df: DataFrame, key: str, other: str, time: str) -> DataFrame:
    """(key, n_rows, n_others, newest_us) per non-null key: rows, distinct non-null ``other`` values, greatest ``time`` in epoch microseconds.

    Rows are first combined per (key, other), which spreads a hot key over its
    partners; the dense accumulators then run over those pairs.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    pairs = (
        df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(other).alias("_other"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max(us).alias("_t"))
        .select("_key", F.col("_n"), F.col("_other").isNotNull().cast("long").alias("_one"), "_t")
    )
    out = dense_group_stats(pairs, "_key", {"n_rows": "_n", "n_others": "_one"}, "_t")
    return out.select(F.col("_key").alias(key), "n_rows", "n_others", F.col("newest").alias("newest_us"))
