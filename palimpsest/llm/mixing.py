"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a hash-random key. Within a source, key ranges are the buckets of a range sort; a window sums sizes
within a bucket and a second, over one row for each bucket, gives the sum before it. Whole epochs are taken of a
source while its budget lasts, and the last epoch is cut at the exact budget.

Defined results: a null text has size 0; null sources are one source and come last; a source without words gets
nothing; equal ids are ordered by size, so reruns agree. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, body, fresh
from palimpsest.session import materialize, table

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Rows of a bucket, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16
#: Sources up to which their table is broadcast; it is counted first.
BROADCAST_SOURCES = 100_000


def words(text: Column | str) -> Column:
    return F.regexp_count(body(text), F.lit(WORD)).cast("long")


def shuffle_key(id_col: Column | str, seed: str = SEED) -> Column:
    """60 random bits that depend on the id and the seed alone."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("null")), F.lit(":" + seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """From (source, source_size, source_rows): target by water filling, a row for each source.

    In order of size / weight, sources fill up one after another. `level` is the words a unit of weight gets when all
    sources before are full; the first source that this level leaves unfilled sets the level of all that follow.
    """
    ranked = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    x = ranked.withColumns({"w": w, "full": F.col("source_size") * float(repeats)})
    order = W.orderBy(F.col("full") / F.col("w"), "source_no")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    x = x.withColumns({"filled": F.coalesce(F.sum("full").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all_w": F.sum("w").over(every), "all_size": F.sum("source_size").over(every)})
    x = x.withColumn("level", (F.col("all_size") * share - F.col("filled")) / (F.col("all_w") - F.col("gone")))
    open_ = F.col("level") * F.col("w") <= F.col("full")
    x = x.withColumn("level", F.min_by(F.when(open_, F.col("level")), F.when(open_, F.struct(F.col("full") / F.col("w"), "source_no"))).over(every))
    x = x.withColumn("target", F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full"))))
    nb = F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(1), F.ceil(F.col("source_rows") / BUCKET_ROWS)))
    return x.select("source", "source_no", "source_size", "target", F.round("target").cast("long").alias("budget"), nb.cast("int").alias("buckets"))


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: str = SEED) -> DataFrame:
    """`df` with size, source_size, target and taken (words that the mix takes, repeats counted).

    Sizes are counted once for the totals of sources and buckets, in a table of (id, source, size), and once with the rows.
    """
    n = {x: fresh(df, x) for x in ("size", "source_size", "target", "taken", "key", "bucket", "prior", "source_no", "budget", "buckets", "source_is", "no_", "b_")}
    slim = materialize(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = materialize(targets(stats, weights, share, repeats), "mix-targets")
    side = plan.select(F.struct("source").alias(n["source_is"]), *(F.col(c).alias(n[c]) for c in ("source_no", "source_size", "target", "budget", "buckets")))
    if plan.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    bucket = lambda key: F.floor(key / float(1 << 60) * F.col(n["buckets"])).cast("int")
    rows = df.withColumn(n["size"], size).join(side, F.col(source_col).eqNullSafe(F.col(n["source_is"])["source"])).drop(n["source_is"])
    rows = rows.withColumn(n["key"], shuffle_key(id_col, seed)).withColumn(n["bucket"], bucket(F.col(n["key"])))
    sums = slim.join(side, F.col("source").eqNullSafe(F.col(n["source_is"])["source"]))
    sums = sums.groupBy(F.col(n["source_no"]).alias(n["no_"]), bucket(shuffle_key("id", seed)).alias(n["b_"])).agg(F.sum("size").alias("in_bucket"))
    ahead = W.partitionBy(n["no_"]).orderBy(n["b_"]).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(n["no_"], n["b_"], F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias(n["prior"]))
    inside = W.partitionBy(n["source_no"], n["bucket"]).orderBy(n["key"], F.col(id_col), n["size"]).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn(n["taken"], F.sum(n["size"]).over(inside) - F.col(n["size"]))
    rows = rows.join(sums, (F.col(n["source_no"]) == F.col(n["no_"])) & (F.col(n["bucket"]) == F.col(n["b_"])))
    budget, total, own = F.col(n["budget"]), F.col(n["source_size"]), F.col(n["size"])
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(0)
    rest = budget - epochs * total - F.col(n["taken"]) - F.col(n["prior"])
    taken = epochs * own + F.greatest(F.lit(0), F.least(own, rest))
    return rows.select(*df.columns, own.alias(n["size"]), total.alias(n["source_size"]), F.col(n["target"]), taken.cast("long").alias(n["taken"]))


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed rows themselves: each row of `df` as many times as the nearest whole number of its taken share. A row
    without words takes nothing of a budget of words: it isn't repeated, and so isn't in the result."""
    mixed = mix(df, words(text_col), id_col, source_col, **how)
    size, _, _, taken = mixed.columns[len(df.columns):]
    copies = F.when(F.col(size) > 0, F.round(F.col(taken) / F.col(size))).otherwise(0).cast("int")
    return mixed.select(*df.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias(fresh(df, "copy"))).select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", words("text").alias("words")), "words")
    return mix(docs, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS full_ FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl
      FROM w WINDOW o AS (ORDER BY full_ / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT f.*, least(full_, coalesce((SELECT arg_min(lvl, full_ / w) FROM f WHERE lvl * w <= full_) * w, full_)) AS target FROM f),
b AS (SELECT t.*, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT doc_id, size, source_size, target, budget, epochs,
             coalesce(sum(size) OVER (PARTITION BY no ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
