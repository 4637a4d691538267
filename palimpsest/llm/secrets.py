"""Secret scans, in DataFrame operations only: fixed patterns, and a character Markov model for what they miss.

Two first-order models over the letters of ALPHABET, one of random strings and one of ordinary identifiers, are
counted from labelled samples. A run of LEAST_RUN of those letters or more is a secret if it is far likelier under the
first: its log-likelihood ratio reaches LEAST_RATIO nats and LEAST_MEAN for each letter. Elsewhere, each part of LEAST_PART
letters or more without / _ = - is judged alone. What a pattern matches is cut out first; its spans always stay.

Samples: random strings are written by hashing numbers, in several alphabets; ordinary ones are numbers and the distinct
words of all documents, each counted once however often it occurs, alone and joined to any other, so copies of a text don't
weigh in. Words inside a pattern's match are left out, and so are the long ones that a first model, of all, finds odd.
Many secrets that no pattern knows, against few words, can still hide each other.

Defined results: a null text is an empty one, without spans. Only mapped rows, so repeats, ties, empty tables and
clashing names need no care. Matches are placed in blocks, so that a text of very many costs about as many steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import body, fresh
from palimpsest.session import materialize, table

#: (kind, pattern, what the match must pass) in the order in which spans with one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(password|passwd|secret|token|key)["']?\x20*[:=]"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"  # a shorter run has no part of 32, so this is all runs with the rest dropped
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN, LEAST_PART = 20, 12
RUN, PART = f"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}", f"[A-Za-z0-9+]{{{LEAST_PART},}}"
LEAST_RATIO, LEAST_MEAN = 20.0, 1.0
SAMPLE_RANDOM = 20_000
JOINS = ("_", "-", "", "/", "")

SPANS = "array<struct<start:int,kind:int,end:int>>"


def outside(text: Column, spans: Column) -> Column:
    """The text with spaces, as many, for what the spans cover."""
    def joined(held: Column) -> Column:
        pieces = held["pieces"]
        gap = lambda a, b: F.substring(F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(b / PIECE) - F.floor(a / PIECE)).cast("int") + 1), ""), a % PIECE + 1, b - a)

        def cut(at: Column, x: Column) -> tuple[Column, Column]:
            a, b = F.greatest(at, x["start"]), F.greatest(at, x["end"])
            return b, F.concat(gap(at, a), F.repeat(F.lit(" "), b - a))

        kept = lambda s: F.concat(F.array_join(F.flatten(s["found"]), ""), gap(s["at"], F.greatest(s["at"], held["n"])))
        return F.transform(F.array(in_blocks(held["spans"], cut, "string")), kept)[0]

    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.sort_array(spans).alias("spans"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, F.transform(F.array(held), joined)[0]).otherwise(text)


#: Items that are appended one by one before what they gave is put with that of others.
BLOCK = 256
#: Letters of a piece that a text is cut into, since a substring is looked for from the start.
PIECE = 4096


def in_blocks(items: Column, step, kind: str) -> Column:
    """A struct of `at`, where `step` (at, item) -> (next at, value or null) has got to from 0, and `found`, its values in blocks.

    Appending to an array copies it: in blocks of BLOCK, n items cost n * BLOCK and (n / BLOCK) ** 2 copied places, not n ** 2.
    """
    empty = F.array().cast(f"array<{kind}>")

    def one(so_far: Column, x: Column) -> Column:
        at, value = step(so_far["at"], x)
        return F.struct(at.alias("at"), F.concat(so_far["part"], F.array(value)).alias("part"))

    def block(so_far: Column, b: Column) -> Column:
        some = F.aggregate(F.slice(items, b * BLOCK + 1, BLOCK), F.struct(so_far["at"].alias("at"), empty.alias("part")), one)
        return F.transform(F.array(some), lambda s: F.struct(s["at"].alias("at"), F.concat(so_far["found"], F.array(s["part"])).alias("found")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")), start, block)


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(random: boolean, sample) of SAMPLE_RANDOM numbers and the distinct words of all documents, these between two spaces."""
    spark, text = docs.sparkSession, body(text_col)
    texts = docs.select(text.alias("text"), F.concat(*patterns(text)).alias("spans")).select(outside(F.col("text"), F.col("spans")).alias("text"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("w")).distinct()
    words = materialize(words, "secret-words")
    plain = words.filter(~F.col("w").rlike("^(?=[0-9a-fA-F]*+$)(?=[a-fA-F]*+[0-9])(?=[0-9]*+[a-fA-F]).{16,}")).select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("sample"))
    digits = spark.range(SAMPLE_RANDOM).select(F.concat(F.substring(F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 14), 16, 10), 1, 12), F.element_at(F.array(*map(F.lit, ("", "-555-0100", "-01-31", "_1"))), (F.col("id") % 4 + 1).cast("int"))).alias("sample"))
    raw = F.unhex(F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")).cast("binary"), 256))
    random = spark.range(SAMPLE_RANDOM).select(
        F.when(F.col("id") % 4 == 0, F.lower(F.hex(raw))).when(F.col("id") % 4 == 1, F.hex(raw)).when(F.col("id") % 4 == 2, F.base64(raw)).otherwise(F.translate(F.base64(raw), "+/=", "-_")).alias("sample")
    )
    return random.select(F.lit(True).alias("random"), "sample").unionByName(plain.unionByName(digits).select(F.lit(False).alias("random"), "sample"))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of each step from letter a to letter b, at a * len(ALPHABET) + b; the table's size is fixed.

    A sample between spaces counts alone, before and after a word drawn from all such samples, joined by one of JOINS. If
    they are fewer than SAMPLE_RANDOM, all weigh more alike, as so many; else the flat start of the counts would drown them.
    Those of LEAST_PART letters or more that are odd by a first model, of all samples, are left out of the second.
    """
    long = F.col("sample").startswith(" ") & (F.length("sample") >= LEAST_PART + 2)
    return fit(samples.filter(~long | ~odd(F.trim("sample"), fit(samples))))


def fit(samples: DataFrame) -> list[float]:
    chars = samples.select("random", F.col("sample").startswith(" ").alias("joins"), F.filter(F.split("sample", ""), lambda c: c != "").alias("c")).filter(F.size("c") > 1)
    steps = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))
    counted = chars.select("random", "joins", F.explode(steps).alias("step")).groupBy("random", "joins", "step").count().collect()
    n = len(ALPHABET)
    counts = {True: [0.5] * (n * n), False: [0.5] * (n * n)}
    starts, ends = [0.0] * n, [0.0] * n
    weight = max(1.0, SAMPLE_RANDOM / max(1, sum(row["count"] for row in counted if row["step"][0] == " ")))
    for row in counted:
        a, b = ALPHABET.find(row["step"][0]), ALPHABET.find(row["step"][1])
        if a >= 0 and b >= 0:
            counts[row["random"]][a * n + b] += row["count"] * (3 * weight if row["joins"] else 1)
        elif b >= 0:
            starts[b] += row["count"] * weight
        elif a >= 0:
            ends[a] += row["count"] * weight
    for join in JOINS:
        at = ALPHABET.find(join) if join else None
        for a in range(n):
            if join:
                counts[False][a * n + at] += ends[a] / len(JOINS)
                counts[False][at * n + a] += starts[a] / len(JOINS)
            else:
                for b in range(n):
                    counts[False][a * n + b] += ends[a] * starts[b] / max(sum(starts), 1) / len(JOINS)
    chance = {k: [math.log(v / sum(c[i // n * n : i // n * n + n])) for i, v in enumerate(c)] for k, c in counts.items()}
    return [a - b for a, b in zip(chance[True], chance[False])]


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of ALPHABET's letters."""
    n, known = len(ALPHABET), F.array(*map(F.lit, model))
    places = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    steps = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.element_at(known, a * n + b + 1))
    return F.aggregate(F.flatten(F.transform(F.array(places), steps)), F.lit(0.0), lambda s, x: s + x)


def odd(run: Column, model: list[float]) -> Column:
    return F.exists(F.array(ratio(run, model)), lambda r: (r >= LEAST_RATIO) & (r >= LEAST_MEAN * F.length(run)))


def found(text: Column, pattern: str, kind: int, hint: str | None = None, group: int = 0, passes=None) -> Column:
    """Spans of a pattern's leftmost matches that don't overlap, from the texts between and the matches' lengths."""
    none = F.array().cast(SPANS)
    span_type = SPANS[len("array<") : -1]
    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("all"), values.alias("value"))

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["all"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return end, F.when(passes(x["value"]), span) if passes else span

    spans = F.transform(F.array(pairs), lambda p: F.filter(F.flatten(in_blocks(p, place, span_type)["found"]), lambda s: s.isNotNull()))[0]
    return F.when(text.rlike(hint or pattern), spans).otherwise(none)


def patterns(text: Column) -> list[Column]:
    return [found(text, ASSIGN, 0, ASSIGN_HINT, 2, lambda v: F.length(v) >= 8), found(text, ACCESS, 1, passes=lambda v: F.length(v) >= 16), found(text, HEX, 2)]


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """`df` with base_spans and added_spans: arrays of (start, kind, end) in code points; kind is a place in KINDS."""
    base, added = fresh(df, "base_spans"), fresh(df, "added_spans")
    text = body(text_col)
    rows = df.withColumn(base, F.concat(*patterns(text)))
    left, runs = fresh(rows, "left"), fresh(rows, "runs")
    rows = rows.withColumn(left, outside(text, F.col(base)))
    whole, parts = (found(F.col(left), p, 3, passes=lambda v: odd(v, model)) for p in (RUN, PART))
    rows = rows.withColumn(runs, whole)
    new = F.filter(parts, lambda r: ~F.exists(F.col(runs), lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.withColumn(added, F.sort_array(F.concat(runs, new))).drop(left, runs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, train(labelled(docs)))
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base_spans", "added_spans")).alias("spans"),
    )
