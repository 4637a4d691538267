"""Comparisons of an attribution with an expected one: tallies by field, histograms, first differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REV = ["lang", "page_id", "rev_id"]


def _paired(got: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of both sides by position, as structs g and e."""
    side = lambda df, name: df.select(*REV, "pos", F.struct(*fields).alias(name))
    return side(got, "g").join(side(expected, "e"), [*REV, "pos"], "full")


def _same(field: str):
    return F.col(f"g.{field}").eqNullSafe(F.col(f"e.{field}"))


def tally(got: DataFrame, expected: DataFrame) -> DataFrame:
    """For each revision: tokens expected, and how many agree in str, origin, in, out and all of them. A null expected origin agrees
    with any. `passes`: as many tokens on either side, and all of them agree."""
    rows = _paired(got, expected, ["str", "o_rev_id", "inbound", "outbound"])
    both = F.col("g").isNotNull() & F.col("e").isNotNull()
    hits = {"str": _same("str"), "o_rev_id": F.col("e.o_rev_id").isNull() | _same("o_rev_id"), "in": _same("inbound"), "out": _same("outbound")}
    hits["all"] = hits["str"] & hits["o_rev_id"] & hits["in"] & hits["out"]
    rows = rows.groupBy(*REV).agg(F.count("e").alias("n_expected"), F.count("g").alias("n_got"), *(F.count_if(both & h).alias(f"{k}_match") for k, h in hits.items()))
    return rows.withColumn("passes", (F.col("n_got") == F.col("n_expected")) & (F.col("all_match") == F.col("n_expected")))


def rates(tallies: DataFrame) -> DataFrame:
    """One row: revisions, revisions that pass, tokens, and the share of tokens that agree in each field."""
    share = lambda k: F.when(F.sum("n_expected") > 0, F.sum(f"{k}_match") / F.sum("n_expected")).otherwise(1.0).alias(f"{k}_rate")
    return tallies.agg(F.count("*").alias("revisions"), F.count_if("passes").alias("revisions_passing"), F.sum("n_expected").alias("tokens"), *map(share, ("str", "o_rev_id", "in", "out", "all")))


def mentions(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.concat("inbound", "outbound")).alias("rev")).groupBy("rev").count()


def mention_histogram(got: DataFrame, expected: DataFrame, n: int) -> DataFrame:
    """The n revisions whose number of mentions in in and out differs most: (rev, got, expected, diff)."""
    rows = mentions(got).withColumnRenamed("count", "got").join(mentions(expected).withColumnRenamed("count", "expected"), "rev", "full")
    rows = rows.select("rev", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("got", "expected"))).withColumn("diff", F.abs(F.col("got") - F.col("expected")))
    return rows.filter("diff > 0").orderBy(F.desc("diff"), "rev").limit(n)


def field_differences(got: DataFrame, expected: DataFrame, n: int) -> DataFrame:
    """The first n positions whose in or out differ, with what only either side has."""
    rows = _paired(got, expected, ["str", "inbound", "outbound"]).filter("g is not null and e is not null").filter(~_same("inbound") | ~_same("outbound"))
    only = lambda a, b, f: F.array_except(f"{a}.{f}", f"{b}.{f}")
    return rows.select(
        *REV, "pos", F.col("g.str").alias("str"), only("g", "e", "inbound").alias("in_only_got"), only("e", "g", "inbound").alias("in_only_expected"),
        only("g", "e", "outbound").alias("out_only_got"), only("e", "g", "outbound").alias("out_only_expected"),
    ).orderBy(*REV, "pos").limit(n)


def colour_tally(got: DataFrame, expected: DataFrame, check_age: bool = True) -> DataFrame:
    """Coloured tokens that agree by position, by field; an age agrees within 1.5 seconds."""
    fields = ["str", "o_rev_id", "inbound", "outbound", "conflict_score", "class_name", "age"]
    rows = _paired(got, expected, fields)
    both = F.col("g").isNotNull() & F.col("e").isNotNull()
    hits = {f: _same(f) for f in fields[:-1]} | {"age": (F.abs(F.col("g.age") - F.col("e.age")) < 1.5) if check_age else F.lit(False)}
    return rows.groupBy(*REV).agg(F.count("e").alias("n_expected"), *(F.count_if(both & h).alias(f"{k}_match") for k, h in hits.items()))


def revision_tally(got: DataFrame, expected: DataFrame) -> DataFrame:
    """Revisions expected, and those with the same timestamp, parent and class: (lang, page_id, n_expected, n_match)."""
    side = lambda df, name: df.select(*REV, F.struct("timestamp", "parent_rev_id", "class_name").alias(name))
    rows = side(expected, "e").join(side(got, "g"), REV, "left")
    return rows.groupBy("lang", "page_id").agg(F.count("*").alias("n_expected"), F.count_if(F.coalesce(F.col("g") == F.col("e"), F.lit(False))).alias("n_match"))


def capture_time(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(lang, page_id, rev_id, capture): the time that the expected ages of the first ten tokens tell, rounded."""
    rows = got.filter("pos < 10").select(*REV, "pos", "origin_seconds").join(expected.select(*REV, "pos", F.col("age").alias("e_age")), [*REV, "pos"])
    return rows.groupBy(*REV).agg(F.round(F.avg(F.col("origin_seconds") + F.col("e_age"))).cast("long").alias("capture"))


def structure_totals(tables) -> DataFrame:
    """For each page: blocks and distinct hashes by kind, tokens and blocks in the index."""
    index = tables.hash_index.groupBy("lang", "page_id").agg(
        *(F.sum(F.when(F.col("kind") == k, F.size("ids")).otherwise(0)).alias(f"{name}_total") for k, name in (("p", "paragraphs"), ("s", "sentences"))),
        *(F.count_if(F.col("kind") == k).alias(f"{name}_hashes") for k, name in (("p", "paragraph"), ("s", "sentence"))),
    )
    return tables.article_meta.select("lang", "page_id", "n_lifetime_tokens").join(index, ["lang", "page_id"], "left")


def multiset_overlap(a: DataFrame, b: DataFrame, key: list[str], value: str = "token") -> DataFrame:
    """For each key the letters or tokens two sides have in common, with repeats, and the bound 2 * common / all on their likeness."""
    count = lambda df, name: df.groupBy(*key, value).agg(F.count("*").alias(name))
    rows = count(a, "na").join(count(b, "nb"), [*key, value], "full")
    common, every = F.sum(F.coalesce(F.least("na", "nb") * F.when(F.col("na").isNotNull() & F.col("nb").isNotNull(), 1).otherwise(0), F.lit(0))), F.sum(F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)))
    return rows.groupBy(*key).agg(common.cast("long").alias("common"), (2.0 * common / every).alias("bound"))
