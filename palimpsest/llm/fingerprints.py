"""Document fingerprints, in DataFrame operations only: the SIZE lowest of the 64-bit hashes of a text's shingles.

Fingerprints of parts merge into that of the whole: the SIZE lowest of both. Of two fingerprints, the lowest SIZE
of their union are a random sample of all shingles of either text; the share of it that is in both estimates
resemblance. The place of the highest hash among all 64-bit numbers estimates how many distinct shingles there are.

Shingles are SHINGLE words; a text of fewer words is one shingle, an empty or null text has none, and its fingerprint is
empty. Two empty fingerprints are alike (1), an empty and another are not (0). Equal texts have equal fingerprints.
Equal ids are ordered by text; an only row is followed by itself. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, body, following
from palimpsest.session import table

SIZE, SHINGLE = 128, 5


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a text."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - shingle + 1), lambda i: F.xxhash64(*(F.get(w, i + (k - 1)) for k in range(shingle))))
    own = lambda w: F.when(F.size(w) >= shingle, grams(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.transform(F.array(words), own)[0])


def lowest(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(hashes), 1, size)


def fingerprint(text: Column, size: int = SIZE, shingle: int = SHINGLE) -> Column:
    return lowest(shingle_hashes(text, shingle), size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    return lowest(F.array_union(a, b), size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of shingles in both / in either."""
    sample = merged(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(a, b), sample))
    return F.when(F.size(sample) == 0, 1.0).otherwise(both / F.size(sample))


def distinct(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below `size`."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of shingles in both / in a."""
    r, na, nb = resemblance(a, b, size), distinct(a, size), distinct(b, size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / (1 + r) / na))


def merge_groups(df: DataFrame, group: list[str], column: str, size: int = SIZE) -> DataFrame:
    """One fingerprint for each group: the lowest distinct hashes; each task cuts its own to `size` before the shuffle."""
    rank = F.dense_rank().over(W.partitionBy(*group).orderBy("hash"))
    rows = df.select(*group, F.explode(column).alias("hash")).withColumn("rank", rank).filter(F.col("rank") <= size)
    return rows.groupBy(*group).agg(F.sort_array(F.collect_set("hash")).alias(column))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", body("text").alias("text"))
    docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "print": fingerprint(F.col("text"))})
    rows = following(docs, "doc_id", ["text", "print"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "print", "next_print", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"), resemblance(F.col("print"), F.col("next_print")).alias("near_next"),
    )
