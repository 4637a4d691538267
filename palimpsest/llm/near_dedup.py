"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A SuperMinHash signature lets each element rank the slots by a random permutation of its own (one fixed shuffle of the slots, then
a random start and factor modulo a prime): at rank j the element offers j + a random fraction to its j-th slot, and each slot keeps the lowest. Ranks are tried from 0 up for all
elements together; once every slot holds less than the next rank, no later offer can win and the rest is skipped.

Texts with equal shingle sets are one node. Signatures are cut into bands; nodes that share a band's hash meet in a
bucket. Buckets with the same members count once. Within a bucket full shingle sets decide, by an inverted
index over shingles that two members share: from a member on, all links to members not yet reached are found, so a
bucket yields its exact components without listing pairs. A bucket of over BLOCK nodes is dealt out as pairs of
blocks. Components over all buckets come from star contraction.

Bands are sized so that a pair at the threshold is missed by all of them with a probability under 1e-6.

Defined results: null and empty texts, and texts without words, have an empty set, link to nothing and stay. A text of
fewer words than a shingle is one shingle. Groups are named by their smallest id; null ids are larger than all, and a
group of null ids only is named null. `keep` decides by rows: of different texts under one id each goes by its own group,
rows that repeat both id and text stay or go together. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import body, frugal
from palimpsest.llm.components import HOT_LEAST, HOT_SHARE, components, with_value
from palimpsest.session import materialize, table

#: Bands; the most nodes of a bucket that one task takes; bytes hashed and elements ranked together, single texts apart.
BANDS, BLOCK, CHUNK, TOGETHER = 48, 4096, 1 << 18, 20_000
#: Rows of a batch that are worked on, and handed out, together.
ROWS = 1024
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number sent to another, one to one and as if at random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of ODD[0] and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(x))))) for x in (ODD[0], pow(ODD[0], -1, 1 << 64))]
    return _powers


_LETTER = mixed(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(ODD[1]))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts after another: 64-bit hashes of all their words, A-Z lower-cased, and where each text's begin (one more
    for the end); null is empty.

    Word hashes come from prefix sums over the bytes of many texts at once: no byte of a longer character is a space.
    """
    texts = pa.array(texts.to_pylist(), pa.large_binary()) if texts.null_count else texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        raw = data[ends[at] : ends[to]]
        n, edge = len(raw), ends[at : to + 1] - ends[at]
        power, inverse = _power(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * power[:n], dtype=np.uint64)))
        inside = np.concatenate(([False], ~_SPACE[raw], [False]))
        cut = np.zeros(n + 1, bool)
        cut[edge] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        words = mixed((sums[end] - sums[start]) * inverse[start] ^ ((end - start).astype(np.uint64) * np.uint64(ODD[2])))
        yield words, np.searchsorted(start, edge)
        at = to


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; null is empty."""
    for words, of in word_hashes(texts):
        shingle = np.full(max(0, len(words) - size + 1), np.uint64(size * 0x9E3779B1), np.uint64)
        for k in range(size):
            shingle = mixed(shingle * np.uint64(ODD[0]) + words[k : len(words) - size + 1 + k])
        for lo, hi in zip(of[:-1].tolist(), of[1:].tolist()):
            if hi - lo >= size:
                yield np.unique(shingle[lo : hi - size + 1])
            else:
                short = np.full(min(1, hi - lo), np.uint64((hi - lo) * 0x9E3779B1), np.uint64)
                for k in range(lo, hi):
                    short = mixed(short * np.uint64(ODD[0]) + words[k])
                yield short


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """A SuperMinHash for each non-empty set; `slots` is prime. An element's permutation sends rank j to start + factor * shuffled[j]:
    without the shuffle the first slots of an element would lie evenly, and so in more bands than they should, or fewer."""
    out = np.empty((len(sets), slots))
    shuffled = np.argsort(mixed(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(ODD[0]))).tolist()
    order = np.argsort([len(s) for s in sets], kind="stable")
    at = 0
    while at < len(order):
        to, many = at, 0
        while to < len(order) and (to == at or many + len(sets[order[to]]) <= TOGETHER and to - at < 256):
            many += len(sets[order[to]])
            to += 1
        mine = order[at:to]
        best = np.full((len(mine), slots), np.inf)
        flat = best.reshape(-1)
        element = np.concatenate([sets[i] for i in mine])
        base = np.repeat(np.arange(len(mine)) * slots, [len(sets[i]) for i in mine])
        draw = mixed(element ^ np.uint64(ODD[1]))
        start = (draw >> np.uint64(32)).astype(np.int64) % slots
        factor = 1 + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % (slots - 1)
        for j in range(slots):
            offer = (mixed(element + np.uint64((j + 1) * ODD[2] & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12)) * 2.0**-52 + j
            np.minimum.at(flat, base + (start + factor * shuffled[j]) % slots, offer)
            done = best.max(1) <= j + 1
            if done.all():
                break
            if j % 4 == 3 and done.any():
                use = ~done[base // slots]
                element, base, start, factor = element[use], base[use], start[use], factor[use]
        out[mine] = best
        at = to
    return out


def rows_of_band(threshold: float) -> int:
    """Rows at which a pair at the threshold shares a band with a probability of about 0.27."""
    return max(1, round(math.log(0.27) / math.log(threshold)))


def slots_for(rows: int) -> int:
    """The least prime that fills all bands."""
    n = rows * BANDS
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bands(best: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of each signature, its number included."""
    cells = best[:, : rows * BANDS].copy().view(np.uint64).reshape(len(best), BANDS, rows)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(ODD[1]), (len(best), 1))
    for k in range(rows):
        out = mixed(out * np.uint64(ODD[0]) + cells[:, :, k])
    return out


def _node(hashes: np.ndarray) -> bytes | None:
    return hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None


@frugal
def _signed(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(id, print, n_shingles, node, bands): the bands only with the first row of a node among ROWS."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        sizes, nodes, new = [], [], {}
        for i, h in enumerate(shingle_sets(batch.column(2), size)):
            sizes.append(len(h))
            nodes.append(_node(h))
            if len(h) and nodes[-1] not in new:
                new[nodes[-1]] = (i, h)
        signed = bands(signatures([h for _, h in new.values()], slots_for(rows)), rows).view(np.int64) if new else []
        cells = [None] * len(nodes)
        for (i, _), b in zip(new.values(), signed):
            cells[i] = b
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], ["id", "print", "n_shingles", "node", "bands"])


@frugal
def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(node, hashes) of texts."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        found = [(_node(h), h.tobytes()) for h in shingle_sets(batch.column(0), size)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["node", "hashes"])


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The component of each set, as a place in the list: den * intersection >= num * union links two sets."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    root = np.arange(n)
    if n < 2:
        return root
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(root, sizes)
    shared = df[column] > 1
    column, owner = column[shared], owner[shared]
    useful = np.bincount(owner, minlength=n) * den >= num * sizes  # what no one else has can't be in an intersection
    mine = np.searchsorted(owner, np.arange(n + 1))

    def index(alive: np.ndarray):
        use = alive[owner]
        order = np.argsort(column[use], kind="stable")
        c, o = column[use][order], owner[use][order]
        return np.searchsorted(c, np.arange(len(df) + 1)), o

    alive = useful.copy()
    starts, posts = index(alive)
    built = left = int(alive.sum())
    for seed in np.flatnonzero(useful):
        if not alive[seed]:
            continue
        alive[seed], todo, left = False, [seed], left - 1
        while todo and left:
            at = todo.pop()
            if left * 2 < built:
                (starts, posts), built = index(alive), left
            c = column[mine[at] : mine[at + 1]]
            lo, many = starts[c], starts[c + 1] - starts[c]
            if not (total := int(many.sum())):
                continue
            spots = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(total)
            both = np.bincount(posts[spots], minlength=n)
            hit = np.flatnonzero(alive & (both * (den + num) >= num * (sizes + sizes[at])))
            if len(hit):
                alive[hit], root[hit], left = False, seed, left - len(hit)
                todo.extend(hit)
        if not left:
            break
    return root


@frugal
def _links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from each member of a bucket to its component's first; rows come sorted by bucket."""
    key, nodes, sets = None, [], []

    def flush() -> pa.RecordBatch:
        root = linked(sets, num, den)
        edges = [(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
        for k, node, h in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if k != key:
                if len(nodes) > 1:
                    yield flush()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(np.frombuffer(h, np.uint64))
    if len(nodes) > 1:
        yield flush()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) for each row of `df`: component_id is the smallest id of the row's group."""
    return _grouped(df, id_col, text_col, shingle, num, den).drop("print")


def _print(own: Column, text_col: str) -> Column:
    return F.xxhash64(own.isNull(), own, body(text_col))


def _grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    own = F.col(id_col).cast("long")
    docs = df.select(own.alias("id"), _print(own, text_col).alias("print"), body(text_col).alias("text"))
    rows = rows_of_band(num / den)
    signed = materialize(docs.mapInArrow(partial(_signed, size=shingle, rows=rows), "id long, print long, n_shingles long, node binary, bands array<long>"), "near-signed")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.min(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "print")).alias("row"), F.first("bands", ignorenulls=True).alias("bands"))
    nodes = materialize(nodes, "near-nodes")

    cells = nodes.select("node", F.explode("bands").alias("bucket"))
    met_in = cells.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")  # counted before the shuffle, so that no bucket meets in one task
    cells = materialize(cells.join(met_in, "bucket"), "near-cells")
    met = cells.groupBy("bucket", "n").agg(F.bit_xor(F.xxhash64(F.lit(5), "node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x"))
    met = met.groupBy("n", "h", "x").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    cand = cells.drop("n").join(met.select("bucket", F.when(F.col("n") > BLOCK, blocks).otherwise(1).alias("blocks")), "bucket")
    block = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    cand = cand.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cand = materialize(cand.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node"), "near-candidates")

    wanted = nodes.join(cand.select("node").distinct(), "node", "left_semi").select(F.col("row.id").alias("of"), F.col("row.print").alias("mark"))
    texts = docs.join(wanted, (F.coalesce("id", F.lit(0)) == F.col("of")) & (F.col("print") == F.col("mark"))).select("text")
    sets = texts.mapInArrow(partial(_sets, size=shingle), "node binary, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes"))
    full = cand.join(sets, "node").select("bucket", "a", "b", "node", "hashes").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node")
    edges = full.mapInArrow(partial(_links, num=num, den=den), "u binary, v binary")

    total = signed.count()
    names = materialize(components(edges).join(nodes.select("node", "low"), "node").select("root", "node", "low"), "near-names")
    lows = names.groupBy(F.col("root").alias("key")).agg(F.min("low").alias("value"), F.count("*").alias("n"))
    named = with_value(names, "root", lows, total).select("node", F.col("value").alias("component_id"))
    hot = max(HOT_LEAST, total // HOT_SHARE)
    of = materialize(nodes.select("node", "low", "n").join(named.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", "n", F.coalesce("component_id", "low").alias("component_id")).filter(F.col("n").isNotNull()), "near-components")
    plain = signed.select("id", "print", "n_shingles", "node")
    common = F.broadcast(of.filter(F.col("n") > hot).select(F.col("node").alias("hot_node"), F.struct("component_id").alias("hot")))
    first = plain.join(common, F.col("node") == F.col("hot_node"), "left")
    done = first.filter(F.col("hot").isNotNull() | F.col("node").isNull()).select("id", "print", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("hot")["component_id"]).alias("component_id"))
    rest = first.filter(F.col("hot").isNull() & F.col("node").isNotNull()).join(of.filter(F.col("n") <= hot).select("node", "component_id"), "node").select("id", "print", "n_shingles", "component_id")
    return done.unionByName(rest)


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `df` whose id is the smallest of their group; of different texts under one id, each by its own group."""
    own = F.col(id_col).cast("long")
    found = _grouped(df, id_col, text_col, **how).filter(~F.col("id").eqNullSafe(F.col("component_id")))
    drop = materialize(found.select(F.coalesce("id", F.lit(0)).alias("dropped id"), F.col("print").alias("dropped print")).distinct(), "near-dropped")
    return df.join(drop, (F.coalesce(own, F.lit(0)) == F.col("dropped id")) & (_print(own, text_col) == F.col("dropped print")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, num=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
