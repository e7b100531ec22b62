"""Filling fixed-capacity containers with items (problem 7).

Exact-complement hashing over the histogram of lengths: single, pair and triple
sums are indexed, combinations that fill a container exactly are consumed under
their availability counts, then the rest is placed by best fit.  The histogram
has at most ``capacity`` entries whatever the number of items, so the plan is
made once; counting tokens, ranking items within a length and assigning them to
containers run on Spark.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from codeweft.sources.tables import cut_lineage

CAPACITY = 2048
TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 32 << 20
#: Pieces of one length that are ranked in one task, about.
BLOCK_PIECES = 500_000
TOKENIZER_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER_FILE) -> DataFrame:
    """(id, n_tokens) with the byte-level BPE in ``path``, a file of the driver; null and empty texts have 0 tokens.

    The vocabulary is broadcast: a file of some 50,000 tokens is under 1 MB, and
    one of over MAX_VOCABULARY_BYTES is refused.
    """
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary has at most {MAX_VOCABULARY_BYTES} bytes")
    vocabulary = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]]})

    src = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return src.mapInPandas(run, "_id bigint, n_tokens bigint").withColumnRenamed("_id", id_col)


def pieces(lengths: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, piece_tokens): only items longer than the capacity are cut, into full pieces and a rest; empty items get no piece."""
    n = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")
    return (
        lengths.where("n_tokens > 0").select(id_col, "n_tokens", piece)
        .select(id_col, F.col("piece").cast("long"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("long").alias("piece_tokens"))
    )


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one container) with their number of containers.

    Each step uses up at least one length, so there are at most a few patterns
    per entry of the histogram.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(*ls: int) -> None:
        times = min(left.get(x, 0) // ls.count(x) for x in set(ls))
        if times <= 0:
            return
        plan.append((ls, times))
        for x in ls:
            left[x] -= times
            if not left[x]:
                del left[x]

    if capacity in left:
        use(capacity)
    for a in sorted(left, reverse=True):  # pairs: the exact complement is a lookup
        if a in left and capacity - a in left:
            use(a, capacity - a)
    for a in sorted(left, reverse=True):  # triples: complement of a against pairs b + c
        gap = capacity - a
        for b in sorted((x for x in left if gap / 2 <= x < gap), reverse=True):
            if a not in left:
                break
            if b in left and gap - b in left:
                use(a, b, gap - b)
    # Best fit decreasing on what is left, a whole run of equal containers at a time.
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        from bisect import insort

        if gap not in open_at:
            open_at[gap] = []
            insort(gaps, gap)
        open_at[gap].append((pattern, times))

    for x in sorted(left, reverse=True):
        todo, fresh = left[x], []
        while todo:
            # tightest gap that takes x
            i = bisect_right(gaps, x - 1)
            if i == len(gaps):
                per = capacity // x
                if todo >= per:
                    fresh.append(((x,) * per, todo // per))
                    todo -= todo // per * per
                if todo:
                    fresh.append(((x,) * todo, 1))
                    todo = 0
                break
            gap = gaps[i]
            pattern, times = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap]
                gaps.pop(i)
            n = min(times, todo)
            if times > n:
                put(gap, pattern, times - n)
            todo -= n
            if gap - x:
                put(gap - x, (*pattern, x), n)
            else:
                plan.append(((*pattern, x), n))
        for pattern, times in fresh:
            gap = capacity - sum(pattern)
            if gap:
                put(gap, pattern, times)
            else:
                plan.append((pattern, times))
    for rest in open_at.values():
        plan += rest
    return plan


def _ranked(parts: DataFrame, id_col: str, histogram: dict[int, int]) -> DataFrame:
    """rank 0.. of every piece within its length, without gathering a length in one task.

    Pieces are hashed over blocks by id, as many for a length as its count needs;
    ranks run within (length, block), and the blocks of a length are put one after
    the other by the sums of their counts.
    """
    spark = parts.sparkSession
    blocks = F.broadcast(spark.createDataFrame([(k, -(-v // BLOCK_PIECES)) for k, v in histogram.items()], "piece_tokens bigint, _k bigint"))  # at most ``capacity`` rows
    p = parts.join(blocks, "piece_tokens").withColumn("_b", F.pmod(F.xxhash64(id_col, "piece"), F.col("_k"))).drop("_k")
    n = p.groupBy("piece_tokens", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = n.withColumn("_off", F.sum("_n").over(Window.partitionBy("piece_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    r = p.withColumn("_r", F.row_number().over(Window.partitionBy("piece_tokens", "_b").orderBy(id_col, "piece")) - 1)
    return r.join(before.select("piece_tokens", "_b", F.coalesce("_off", F.lit(0)).alias("_off")), ["piece_tokens", "_b"]).withColumn("rank", F.col("_off") + F.col("_r")).drop("_b", "_r", "_off")


def pack(lengths: DataFrame, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, piece_tokens, container_id): every piece in one container, no container above the capacity.

    lengths: id, n_tokens.  Items with no or zero tokens need no room and are left
    out; equal lengths are interchangeable and taken in the order of a hash of
    their ids, so a rerun packs alike.  Rows with the same id are items each for
    itself only if the ids differ: ids must be unique.  Empty input: no rows.
    """
    parts = cut_lineage(pieces(lengths, id_col, capacity))  # read three times: the texts are measured once
    hist = {int(k): int(v) for k, v in parts.groupBy("piece_tokens").count().collect()}  # at most ``capacity`` rows
    rows, base, used = [], 0, {}
    for pattern, times in packing_plan(hist, capacity):
        for x in dict.fromkeys(pattern):
            k = pattern.count(x)
            rows.append((x, used.get(x, 0), used.get(x, 0) + k * times, k, base))
            used[x] = used.get(x, 0) + k * times
        base += times
    spark = lengths.sparkSession
    # ranks [lo, hi) of a length go to containers base + (rank - lo) // k
    by_len: dict[int, list] = {}
    for x, lo, hi, k, b in rows:
        by_len.setdefault(x, []).append((lo, hi, k, b))
    plan = spark.createDataFrame(list(by_len.items()), "piece_tokens bigint, slots array<struct<lo:bigint,hi:bigint,k:bigint,base:bigint>>") if by_len else spark.createDataFrame([], "piece_tokens bigint, slots array<struct<lo:bigint,hi:bigint,k:bigint,base:bigint>>")
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    placed = _ranked(parts, id_col, hist).join(F.broadcast(plan), "piece_tokens").withColumn("_s", slot)  # at most ``capacity`` rows of a few slots
    return placed.select(id_col, "piece", "piece_tokens", (F.col("_s.base") + F.floor((F.col("rank") - F.col("_s.lo")) / F.col("_s.k"))).cast("long").alias("container_id"))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room filled, and the fewest containers any packing could need."""
    c = packed.groupBy("container_id").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return c.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / F.lit(capacity)).alias("least_containers"), (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
