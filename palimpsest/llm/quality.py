"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and fits, on the gradients of the log loss, a shallow tree over that
feature's bins; all trees of a feature add up to one lookup table. Then the pairs of features whose two-way tables
would lower the loss most are boosted the same way. A score is an intercept plus one table entry for each feature
and each pair, added up for a whole batch at once.

Features are shape statistics of the whole text. Ids, labels, language and source are no inputs. The model is fitted
on at most MOST_ROWS labelled rows outside the held-out fold (all of them up to there, beyond it those with the
lowest hash of their id); every document is scored.

Defined results: a null text is an empty one, whose features are all 0; labels that are null are not used, an id that is
labelled twice counts twice; without usable labels, or with labels of one class, the score is the same for all
(the share of label 1, 0.5 without any). Rows are only mapped, so repeats, ties and clashing column names need no care.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import body, fresh, frugal, held_out
from palimpsest.session import table

#: Bound of the training sample, rounds, and the shapes of trees and tables.
MOST_ROWS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 20_000, 300, 150, 8, 0.08
BINS, PAIR_BINS, LEAVES, LEAST_ROWS, RIDGE = 32, 8, 3, 15, 2.0
THRESHOLD = 0.7
#: Rows that are worked on, and handed out, together.
ROWS = 1000

FEATURES = (
    "log_words", "word_chars", "distinct_words", "top_word", "next_same", "symbols", "word_end_symbols", "lone_symbols", "digits", "capitals",
    "all_capitals", "lines", "line_words", "distinct_lines", "ended_lines", "ended_words", "short_words", "long_words", "letter_entropy", "spaces",
)
_KIND = np.zeros(256, np.int8)
_KIND[[*b"0123456789"]] = 1
_KIND[65:91] = 2
_KIND[[*b" \t\n\r\v\f"]] = 3
_KIND[[*b"!\"#$%&*+/<=>?@[\\]^_`{|}~"]] = 4
_SYMBOL = r"[!#$%&*+<=>@^_|~]"
_END = re.compile(rf"{_SYMBOL}(?<!{_SYMBOL}{_SYMBOL}){_SYMBOL}++(?=\s|$)")  # a run is tried once, from its start
_LONE = re.compile(r"(?:^|\s)[^\w\s]++(?=\s|$)")


def features(text: str) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=5) / len(raw)
    often = Counter(words)
    lines = text.split("\n")
    lengths = [len(w) for w in words]
    p = counts[counts > 0] / len(raw)
    return [
        math.log1p(n), sum(lengths) / n, len(often) / n ** 0.9, max(often.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, kinds[4],
        len(_END.findall(text)) / n, len(_LONE.findall(text)) / n, kinds[1], kinds[2], sum(map(str.isupper, words)) / n, math.log1p(len(lines)),
        n / len(lines), len(set(lines)) / len(lines), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines),
        sum(w[-1] in ".,;:" for w in words) / n, sum(x <= 3 for x in lengths) / n, sum(x >= 12 for x in lengths) / n, float(-(p * np.log(p)).sum()), kinds[3],
    ]


@dataclass
class Gam:
    """base + sum of tables[f][bin of f] + sum of pairs[f, g][coarse bin of f, coarse bin of g], as log odds."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.coarse)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x) if self.tables else ([], [])
        out = np.full(len(x), self.base)
        for t, b in zip(self.tables, fine):
            out += t[b]
        for (f, g), t in self.pairs.items():
            out += t[coarse[f], coarse[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A value for each bin: the best tree of at most `leaves` leaves over sums of gradients, second derivatives and rows."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
                gs, hs, ns = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
                won = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
                won[(nl < LEAST_ROWS) | (ns - nl < LEAST_ROWS)] = -1
                k = int(np.argmax(won))
                if won[k] > best[0]:
                    best = (won[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values over two features' bins: one cut of the first, then one cut of the second on either side."""
    best, out = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for flip in (False, True):
        gs, hs, ns = (x.T if flip else x for x in (g, h, n))
        for k in range(1, len(gs)):
            won, value = -whole, np.zeros_like(gs)
            for side in (slice(0, k), slice(k, None)):
                a, b, c = (x[side].sum(0) for x in (gs, hs, ns))
                value[side] = _tree(a, b, c, 2)
                won += sum(_gain(a[m].sum(), b[m].sum()) for m in (value[side][0] == v for v in np.unique(value[side][0])))
            if won > best:
                best, out = won, (value.T if flip else value)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting; a tenth of the rows (every tenth) decides how many rounds are kept."""
    if not len(y) or y.min() == y.max():
        return Gam(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0)
    quantiles = lambda k: [np.unique(np.quantile(x[:, f], np.arange(1, k) / k)) for f in range(x.shape[1])]
    model = Gam(math.log(y.mean() / (1 - y.mean())), quantiles(BINS), quantiles(PAIR_BINS))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    fine, coarse = model.bins(x)
    odds, check = np.full(len(y), model.base), np.arange(len(y)) % 10 == 9
    use = ~check if check.sum() >= 50 else np.ones(len(y), bool)

    def loss() -> float:
        z = odds[check] if check.sum() >= 50 else odds
        t = y[check] if check.sum() >= 50 else y
        return float(np.mean(np.logaddexp(0, z) - t * z))

    def sums(index: np.ndarray, size: int) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-odds[use]))
        return [np.bincount(index[use], w, size) for w in (y[use] - p, p * (1 - p), np.ones(use.sum()))]

    def boost(rounds: int, step, keep) -> None:
        nonlocal odds
        best, kept, since = loss(), keep(), 0
        for _ in range(rounds):
            step()
            if (now := loss()) < best - 1e-6:
                best, kept, since = now, keep(), 0
            elif (since := since + 1) >= 40:
                break
        restore(kept)

    def restore(kept) -> None:
        nonlocal odds
        model.tables, model.pairs = kept
        odds = model.log_odds(x)

    def main() -> None:
        nonlocal odds
        for f, t in enumerate(model.tables):
            more = RATE * _tree(*sums(fine[f], len(t)))
            t += more
            odds = odds + more[fine[f]]

    def both() -> None:
        nonlocal odds
        for (f, g), t in model.pairs.items():
            flat = coarse[f] * t.shape[1] + coarse[g]
            more = RATE * _tree2(*(s.reshape(t.shape) for s in sums(flat, t.size)))[1]
            t += more
            odds = odds + more[coarse[f], coarse[g]]

    keep = lambda: ([t.copy() for t in model.tables], {k: t.copy() for k, t in model.pairs.items()})
    boost(ROUNDS, main, keep)
    shapes = {(f, g): (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1) for f in range(x.shape[1]) for g in range(f)}
    gains = {k: _tree2(*(s.reshape(shape) for s in sums(coarse[k[0]] * shape[1] + coarse[k[1]], shape[0] * shape[1])))[0] for k, shape in shapes.items()}
    model.pairs = {k: np.zeros(shapes[k]) for k in sorted(gains, key=gains.get, reverse=True)[:PAIRS]}
    boost(PAIR_ROUNDS, both, keep)
    return model


@frugal
def _measure(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Label and features of labelled rows."""
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        rows = [features(t or "") for t in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_ROWS) -> Gam:
    """Fit on at most `most` labelled rows of `docs`; only their ids, then their features, come together."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    rows = docs.select(F.col(id_col).alias("own"), body(text_col).alias("text")).join(F.broadcast(chosen), F.col("own") == F.col("id"))
    found = rows.select("label", "id", "text").mapInArrow(partial(_measure, at=2), "label int, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(found.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    order = order[np.random.default_rng(7).permutation(len(order))]
    return fit(x[order], y[order])


@frugal
def _score(batches: Iterator[pa.RecordBatch], model: Gam, at: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        x = np.array([features(t or "") for t in batch.column(at).to_pylist()], float)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, name])


def score(df: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """`df` with score, from 0 to 1."""
    name = fresh(df, "score")
    return df.mapInArrow(partial(_score, model=model, at=df.columns.index(text_col), name=name), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the model, fitted on them, doesn't reject."""
    scored = score(docs, train(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
