"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The longest common prefix of turns is rendered once, as the prompt. What follows is rendered on either side, with the
spans of characters that count in training: texts of assistant turns and the marks that end them. A mark inside a
text is written with a backslash, so that no text can pose as a turn.

Defined results: a null role is `unknown`, a null text is empty, null turns compare equal to null turns. Conversations that
are equal have empty completions; without a common turn the prompt is empty. Turns with equal numbers are
ordered by role and text, repeated rows are turns of their own, turns without a conversation id belong to none and are
left out. All turns of one conversation meet in one row, as its rendered text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import following, fresh
from palimpsest.session import table

START, AFTER, END = "<|", "|>\n", "<|end|>\n"
MASK = "array<struct<start:int,end:int>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("unknown")), F.lit(AFTER))


def _tail(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit(START), F.lit("<\\|")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _tail(t))), "")


def mask(turns: Column) -> Column:
    """Spans (start, end exclusive, in code points of the rendered turns) of what assistant turns say."""
    none = F.array().cast(MASK)

    def place(so_far: Column, t: Column) -> Column:
        start = so_far["at"] + F.length(_head(t))
        end = start + F.length(_tail(t))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.when(t["role"].eqNullSafe(F.lit("assistant")), span).otherwise(none)).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), place)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns before the first that differs."""
    n = F.least(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda so_far, i: F.when((so_far == i - 1) & F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)), i).otherwise(so_far))


def format_pairs(df: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """`df` with n_prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask from two arrays of (role, text)."""
    n = {x: fresh(df, x) for x in ("n_prefix_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")}
    rows = df.withColumn(n["n_prefix_turns"], common_turns(F.col(chosen), F.col(rejected)).cast("long"))
    first = F.col(n["n_prefix_turns"]).cast("int")
    rest = lambda c: F.slice(c, first + 1, F.greatest(F.size(c) - first, F.lit(0)))
    return rows.withColumns({
        n["prompt"]: rendered(F.slice(chosen, F.lit(1), first)), n["chosen"]: rendered(rest(chosen)), n["rejected"]: rendered(rest(rejected)),
        n["chosen_mask"]: mask(rest(chosen)), n["rejected_mask"]: mask(rest(rejected)),
    })


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (role, text) of each conversation in order."""
    in_order = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.filter("conv_id is not null").groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last assistant turn is chosen; rejected is the same with that turn's text from the next
    conversation that has one (by ascending id, after the last the first) in place of its own. A conversation without an
    assistant turn has nothing to complete: all of it is prompt, and both completions are empty."""
    talks = conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"].eqNullSafe(F.lit("assistant")), i + 1).otherwise(0)))
    talks = talks.withColumn("last", at)
    answered = talks.filter("last > 0").withColumn("reply", F.get("turns", F.col("last") - 1)["text"])
    pairs = following(answered, "conv_id", ["reply"])
    other = F.array(F.struct(F.lit("assistant").alias("role"), F.col("next_reply").alias("text")))
    pairs = pairs.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen_turns"), F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), other).alias("rejected_turns"))
    pairs = pairs.unionByName(talks.filter("last = 0").select("conv_id", F.col("turns").alias("chosen_turns"), F.col("turns").alias("rejected_turns")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return format_pairs(pairs).select("conv_id", "n_prefix_turns", "prompt", "chosen", "rejected", written("chosen_mask"), written("rejected_mask"))


SQL = r"""
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS a
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT *, list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i].r = 'assistant' THEN i ELSE 0 END)) AS k FROM c),
n AS (SELECT *, a[k].t AS reply, coalesce(lead(a[k].t) OVER (ORDER BY conv_id), first_value(a[k].t) OVER (ORDER BY conv_id)) AS other FROM l WHERE k > 0),
p AS (SELECT conv_id, reply IS NOT DISTINCT FROM other AS same, a, k,
             replace(coalesce(reply, ''), '<|', '<\|') || '<|end|>' || chr(10) AS mine, replace(coalesce(other, ''), '<|', '<\|') || '<|end|>' || chr(10) AS theirs FROM n
      UNION ALL SELECT conv_id, true, a, len(a), '', '' FROM l WHERE k = 0)
SELECT conv_id, (CASE WHEN same THEN k ELSE k - 1 END)::BIGINT AS n_prefix_turns,
       coalesce(array_to_string(list_transform(a[1:(CASE WHEN same THEN k ELSE k - 1 END)],
           lambda t: '<|' || coalesce(t.r, 'unknown') || '|>' || chr(10) || replace(coalesce(t.t, ''), '<|', '<\|') || '<|end|>' || chr(10)), ''), '') AS prompt,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || mine END AS chosen,
       CASE WHEN same THEN '' ELSE '<|assistant|>' || chr(10) || theirs END AS rejected,
       CASE WHEN same THEN '' ELSE '14:' || (14 + length(mine)) END AS chosen_mask,
       CASE WHEN same THEN '' ELSE '14:' || (14 + length(theirs)) END AS rejected_mask
FROM p
"""
