"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one counts how many rows fall in each slot of a two-hash Bloom filter and keeps, as a bitmap, the slots that
two or more rows share. Pass two tests each row against that bitmap. A row with an unshared slot has no twin: it
passes straight through and is never shuffled. Only the others are grouped by SHA-256 of the text.

Defined results: a null text counts as empty; all empty texts are one group. Null ids lose to any other id; a group
with null ids only keeps one of them. Rows that repeat both text and id are one document (`decide` marks
all of them kept when they hold the group's largest id, `dedup` returns one). An empty table gives an empty table.
Other columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import body, fresh
from palimpsest.session import materialize, table

#: Slots of each of the two hashes for a row, and the most slots of each hash. The most bounds the broadcast bitmap at
#: 2 * 2**27 bits = 32 MB; with more rows than slots / 8 the filter lets more rows through to the shuffle, never fewer.
SLOTS_PER_ROW, MOST_SLOTS = 8, 1 << 27
#: Groups above total / HOT_SHARE rows (and above HOT_LEAST) are joined by broadcast: there can be HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST = 1000, 1000
PAGE_BITS = 8 * 4096


def _slots(text: Column, slots: int) -> list[Column]:
    """Bit numbers of a text under the two hashes, from 1: the hashes use separate halves of the filter."""
    return [F.pmod(F.xxhash64(F.lit(salt), text), F.lit(slots)) + F.lit(salt * slots + 1) for salt in (0, 1)]


def shared_slots(df: DataFrame, text: Column, slots: int) -> DataFrame:
    """Pages (page, bits) of 4 KB that mark the slots which at least two rows fall in."""
    counted = df.select(F.explode(F.array(*_slots(text, slots))).alias("slot")).groupBy("slot").count()
    marked = counted.filter("count > 1").select(F.bitmap_bucket_number("slot").alias("page"), F.bitmap_bit_position("slot").alias("bit"))
    return marked.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _is_set(bits: str, slot: str) -> Column:
    """Whether the page `bits` (null: all clear) has the bit of `slot`."""
    byte = F.conv(F.hex(F.expr(f"substring({bits}, int(bitmap_bit_position({slot}) div 8) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, int(bitmap_bit_position({slot}) % 8))")) != 0, F.lit(False))


def decide(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with keep_id, group_size, kept and text_sha256: of equal texts the row with the largest id stays."""
    names = {n: fresh(df, n) for n in ("keep_id", "group_size", "kept", "text_sha256", "s0", "s1", "p0", "p1", "b0", "b1", "maybe", "hk", "hn", "rk", "rn", "hkg", "rkg")}
    n = names.__getitem__
    total = df.count()
    slots = 1 << max(10, min(MOST_SLOTS.bit_length() - 1, (max(1, total) * SLOTS_PER_ROW - 1).bit_length()))
    text = body(text_col)
    pages = shared_slots(df, text, slots)
    s0, s1 = _slots(text, slots)
    rows = df.withColumns({n("s0"): s0, n("s1"): s1, n("text_sha256"): F.sha2(text.cast("binary"), 256)})
    for i in "01":
        rows = rows.join(F.broadcast(pages.select(F.col("page").alias(n("p" + i)), F.col("bits").alias(n("b" + i)))), F.bitmap_bucket_number(n("s" + i)) == F.col(n("p" + i)), "left")
    rows = rows.withColumn(n("maybe"), _is_set(n("b0"), n("s0")) & _is_set(n("b1"), n("s1"))).drop(*(n(x) for x in ("s0", "s1", "p0", "p1", "b0", "b1")))

    sha, maybe = n("text_sha256"), F.col(n("maybe"))
    groups = materialize(rows.filter(maybe).groupBy(F.col(sha).alias("g")).agg(F.max(id_col).alias("k"), F.count("*").alias("c")).filter("c > 1"), "exact-groups")
    hot = max(HOT_LEAST, total // HOT_SHARE)
    named = lambda part, k, c: part.select(F.col("g").alias(n(k + "g")), F.struct(F.col("k").alias("k")).alias(n(k)), F.col("c").alias(n(c)))
    rows = rows.join(F.broadcast(named(groups.filter(F.col("c") > hot), "hk", "hn")), F.col(sha) == F.col(n("hkg")), "left")
    through = rows.filter(~maybe | F.col(n("hn")).isNotNull()).withColumns({n("rk"): F.col(n("hk")), n("rn"): F.col(n("hn"))})
    moved = rows.filter(maybe & F.col(n("hn")).isNull()).join(named(groups.filter(F.col("c") <= hot), "rk", "rn"), F.col(sha) == F.col(n("rkg")), "left")
    both = through.unionByName(moved.drop(n("rkg")))
    keep = F.when(F.col(n("rn")).isNull(), F.col(id_col)).otherwise(F.col(n("rk"))["k"])
    return both.select(
        *df.columns, keep.alias(n("keep_id")), F.coalesce(n("rn"), F.lit(1)).cast("long").alias(n("group_size")),
        keep.eqNullSafe(F.col(id_col)).alias(n("kept")), F.col(sha),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, one for each text."""
    marked = decide(df, id_col, text_col)
    kept, size, sha = (next(c for c in marked.columns[::-1] if c.rstrip("_") == x) for x in ("kept", "group_size", "text_sha256"))
    stay = marked.filter(kept)
    alone = stay.filter(F.col(size) == 1)
    return alone.unionByName(stay.filter(F.col(size) > 1).dropDuplicates([sha])).select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
