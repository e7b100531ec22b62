"""References to records that do not exist (problem 2).

A register-blocked Bloom filter of all parent keys, kept as a table of 64-bit
words and probed by one equi-join, a broadcast one up to some four million keys,
proves most dangling references.  Filter-positive references are verified by an exact
anti-join on key and lifetime.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The filter is broadcast up to this many 64-bit words, about 40 MB (10 MB measured for a quarter); beyond it references and words meet by a shuffle.
MAX_BROADCAST_WORDS = 1 << 20
BITS_PER_KEY = 16
#: Keys with at least this share of all references are salted in the exact join; there can be at most 1/share of them.
HOT_SHARE = 0.005
SALTS = 16


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of one 64-bit word, taken from a second hash of the key."""
    h = F.xxhash64(key, F.lit(17))
    out = None
    for shift in (0, 11, 23, 37):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom_words(n_keys: int) -> int:
    """Words for n_keys at BITS_PER_KEY, a power of two: the filter grows with the keys, so it proves as much at any size."""
    want = max(1, n_keys * BITS_PER_KEY // 64)
    return 1 << max(6, math.ceil(math.log2(want)))


def bloom_filter(keys: DataFrame, key: str, words: int) -> DataFrame:
    """(word, bits): at most ``words`` rows. Partial ORs are combined before the shuffle."""
    k = keys.where(F.col(key).isNotNull())
    return k.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def hot_keys(refs: DataFrame, key: str, share: float = HOT_SHARE) -> list[str]:
    """Keys with at least ``share`` of all rows, by an exact, map-side combined count: at most 1/share keys."""
    total = refs.count()
    if not total:
        return []
    rows = refs.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= share * total).select(key).collect()
    return [r[0] for r in rows]


def edge_references(edges: DataFrame) -> DataFrame:
    """Both endpoints of every edge as rows (edge_id, rel_type, side, ref_id, observed_at); null endpoints are left out."""
    sides = F.explode(F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_id").alias("ref_id")),
        F.struct(F.lit("target").alias("side"), F.col("target_id").alias("ref_id")),
    ))
    return (
        edges.select("edge_id", F.upper("rel_type").alias("rel_type"), "observed_at", sides.alias("r"))
        .select("edge_id", "rel_type", "observed_at", "r.side", "r.ref_id")
        .where(F.col("ref_id").isNotNull())
    )


def dangling_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose ref_id names no node alive at the row's observed_at.

    refs: ref_id, observed_at and any further columns; nodes: id, observed_at,
    deleted_at.  A node row is alive from observed_at (inclusive) to deleted_at
    (exclusive, null: for ever).  Null ref_id: never a case.  Null observed_at of
    a reference: no row proves the node, so it is dangling; null observed_at of a
    node row proves nothing.  Repeated reference rows are all kept, each for
    itself; an empty node table makes every reference dangling.
    """
    refs = refs.where(F.col("ref_id").isNotNull())
    spans = (
        nodes.where(F.col("id").isNotNull() & F.col("observed_at").isNotNull())
        .groupBy(F.col("id").alias("n_id"), F.col("deleted_at").alias("n_to"))
        .agg(F.min("observed_at").alias("n_from"))
    )
    words = bloom_words(nodes.count())
    bloom = bloom_filter(nodes, "id", words).withColumnRenamed("word", "_word")
    cols = refs.columns
    hot = hot_keys(refs, "ref_id")
    asked = refs.withColumn("_word", _word(F.col("ref_id"), words))
    if words <= MAX_BROADCAST_WORDS:
        met = asked.join(F.broadcast(bloom), "_word", "left")
    else:  # hot keys would all meet the same word: they are verified without being asked
        cold = asked.where(~F.col("ref_id").isin(hot)) if hot else asked
        met = cold.join(bloom, "_word", "left")
        if hot:
            met = met.unionByName(asked.where(F.col("ref_id").isin(hot)).withColumn("bits", F.lit(-1).cast("bigint")))
    probed = met.withColumn("_maybe", F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("ref_id"))) == _mask(F.col("ref_id")), F.lit(False)))
    absent = probed.where(~F.col("_maybe")).select(*cols)

    salt = F.pmod(F.xxhash64("observed_at", *(["edge_id"] if "edge_id" in cols else [])), F.lit(SALTS)).cast("int")
    maybe = probed.where("_maybe").select(*cols)
    if hot:
        maybe = maybe.withColumn("_salt", F.when(F.col("ref_id").isin(hot), salt).otherwise(F.lit(0)))
        spans = spans.withColumn(
            "_nsalt",
            F.explode(F.when(F.col("n_id").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
        )
        same = (F.col("ref_id") == F.col("n_id")) & (F.col("_salt") == F.col("_nsalt"))
    else:
        same = F.col("ref_id") == F.col("n_id")
    alive = (F.col("n_from") <= F.col("observed_at")) & (F.col("n_to").isNull() | (F.col("n_to") > F.col("observed_at")))
    verified = maybe.join(spans, same & alive, "left_anti").select(*cols)
    return absent.unionByName(verified)


def endpoint_table(ref_id: Column) -> Column:
    """The node table an id's text points at, by the first discriminator in fixed order; 'repository' for a bare repo id."""
    out = None
    for t in ("file", "module", "class", "function", "method", "import"):
        hit = ref_id.contains(f"::{t}::")
        out = F.when(hit, t) if out is None else out.when(hit, t)
    return out.when(ref_id.startswith("repo::"), "repository").otherwise("unknown")


def dangling_report(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dangling references per rel_type, table of the endpoint, side and month of the reference."""
    key = [F.col("rel_type"), endpoint_table(F.col("ref_id")).alias("endpoint_table"), F.col("side"), F.date_format("observed_at", "yyyy-MM").alias("month")]
    return dangling_references(refs, nodes).groupBy(*key).agg(F.count(F.lit(1)).alias("n_dangling"), F.count_distinct("ref_id").alias("n_missing_ids"))
