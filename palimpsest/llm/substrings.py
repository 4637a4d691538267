"""Suffix-array dedup: bytes that a string of 400 bytes covers which also starts anywhere else are removed; and where passages
of over 50 words are that do, whatever their bytes.

Both are one search over sequences of symbols (a `Unit`: bytes, or word hashes). Sorting every suffix of a corpus costs far more
than its size, so only suffixes that can take part in a repeat are sorted.

1. A text's window of `length` symbols has length - gram + 1 grams; the one with the lowest hash (the leftmost
   of equals) is the window's anchor. Equal windows have their anchors at the same place, so every repeat shows as two
   equal anchors. Neighbouring windows mostly share one: about 1 byte in 100, or 1 word in 14, starts an anchor.
2. Anchors are grouped by gram hash. One that no other has ends here. Anchors that agree in all that any of their
   windows can hold (length - gram symbols on either side; compared by two 64-bit hashes, with the lengths) make all these
   windows repeats at once: no text moves for them. What is left are anchors at the ends of repeats.
3. The suffixes at those are fetched, with what is to their left, and range-partitioned by sampled splitters on their
   leading symbols. Equal leads never part, so no comparison crosses a splitter. Each group is sorted by
   multikey quicksort, forward by suffix and backward by left context; common prefixes of neighbours in the two orders tell,
   for each of the windows of an anchor, which others are equal, symbol for symbol.
4. A group of equal leads with over `most` members is not held in memory: the digests of its members' windows are
   dealt out and counted instead, with the same result.

Defined results: a null text is an empty one. Texts shorter than a window keep all. Equal rows repeat each other. Removal looks
at the input only, so all copies of a passage go. Rows are told apart by id and text; null ids are fine. Very long texts are
cut into overlapping segments for step 1 and have the same anchors as uncut. Other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import body, fresh
from palimpsest.llm.near_dedup import mixed, word_hashes
from palimpsest.session import materialize, table


@dataclass(frozen=True)
class Unit:
    """What texts are sequences of: the symbols of a window and of a gram, the bytes of a symbol, the fewest bytes of a text with a window."""

    length: int
    gram: int
    wide: int
    least: int

    @property
    def side(self) -> int:
        return self.length - self.gram

    def symbols(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's bytes, or the 64-bit hashes of its words (A-Z lower-cased)."""
        if self.wide == 1:
            for t in texts.to_pylist():
                yield np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        else:
            for words, of in word_hashes(texts):
                yield from np.split(words, of[1:-1])

    def written(self, part: np.ndarray) -> bytes:
        return part.tobytes() if self.wide == 1 else part.astype(">u8").tobytes()

    def turned(self, part: bytes) -> bytes:
        """The symbols in the opposite order."""
        return np.frombuffer(part, f"V{self.wide}")[::-1].tobytes()


#: Strings of 400 bytes, and passages of over 50 words.
BYTES, WORDS = Unit(400, 200, 1, 400), Unit(51, 26, 8, 101)
#: Leading bytes that splitters look at; members of a group held in memory; bytes of a segment.
LEAD, MOST, SEGMENT = 24, 50_000, 1 << 20
#: Members of a group up to which all its pairs are compared at once instead of sorting it.
FEW = 24
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_LETTERS = [mixed(np.arange(1, 257, dtype=_U) * _U(b)) for b in _BASES]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2**64, up to n."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 16)
        chain = lambda b: np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, _U(b)))))
        _powers[:] = [(chain(b), chain(pow(b, -1, 1 << 64))) for b in _BASES]
    return _powers


def _sums(raw: np.ndarray, which: int) -> np.ndarray:
    values = _LETTERS[which][raw] if raw.dtype == np.uint8 else mixed(raw * _U(_BASES[which]))
    return np.concatenate((np.zeros(1, _U), np.cumsum(values * _power(len(raw) + 1)[which][0][: len(raw)], dtype=_U)))


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _power(len(sums))[which][1][start])


def _lowest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        v, have = np.minimum(v[: len(v) - have], v[have:]), have * 2
    return v if have == width else np.minimum(v[: len(v) - (width - have)], v[width - have :])


def anchors(raw: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, hash of all around, left and right symbols as 256 * left + right) of a text's anchors."""
    n, out, length, side = len(raw), [], unit.length, unit.side
    for at in range(0, max(0, n - length + 1), SEGMENT):
        low, high = max(0, at - side), min(n, at + SEGMENT + length + 2 * side)
        part, skip = raw[low:high], at - low
        sums, more = _sums(part, 0), _sums(part, 1)
        windows = min(n - length + 1, at + SEGMENT) - at
        place = np.arange(skip, skip + windows + side)
        gram = _hash(sums, place, place + unit.gram, 0)
        first = np.unique(_lowest((gram >> _U(24) << _U(24)) | place.astype(_U), side + 1) & _U((1 << 24) - 1)).astype(np.int64)
        left, right = np.minimum(first + low, side), np.minimum(n - low - first - unit.gram, side)
        out.append((first + low, gram[first - skip], _hash(more, first - left, first + unit.gram + right, 1), left * 256 + right))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, _U, _U, np.int64))
    place, *rest = (np.concatenate(x) for x in zip(*out))
    place, once = np.unique(place, return_index=True)
    return place, *(x[once] for x in rest)


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


ANCHORS = "gram long, around long, sides int, copies int, id long, print long, place long"


def _anchored(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Anchors of (id, print, text). Those that repeat within the batch stand for their like once, with copies 2; what they
    repeat is told, for each text, in rows with copies 0: window starts from `place` to `around`."""
    for batch in batches:
        ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found = [anchors(x, unit) for x in unit.symbols(batch.column(2))]
        own = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        if not len(own):
            continue
        place, gram, around, sides = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((sides, around, gram))
        same = (gram[order][1:] == gram[order][:-1]) & (around[order][1:] == around[order][:-1]) & (sides[order][1:] == sides[order][:-1])
        head = np.concatenate(([True], ~same))
        many = np.zeros(len(own), bool)
        many[order] = ~head | np.concatenate((same, [False]))
        use = np.zeros(len(own), bool)
        use[order] = head
        told = {}
        for i, p, s in zip(own[many].tolist(), place[many].tolist(), sides[many].tolist()):
            told.setdefault(i, []).append((p - s // 256, p - unit.side + s % 256))
        extra = [(i, a, b) for i, spans in told.items() for a, b in _merge(spans)]
        e = np.array(extra, np.int64).reshape(-1, 3)
        cat = lambda a, b, t: pa.array(np.concatenate((a, b)).astype(t))
        yield pa.RecordBatch.from_arrays([
            cat(gram[use].view(np.int64), prints[e[:, 0]], np.int64), cat(around[use].view(np.int64), e[:, 2], np.int64), cat(sides[use], 0 * e[:, 0], np.int32), cat(1 + many[use], 0 * e[:, 0], np.int32),
            cat(ids[own[use]], ids[e[:, 0]], np.int64), cat(prints[own[use]], prints[e[:, 0]], np.int64), cat(place[use], e[:, 1], np.int64),
        ], ["gram", "around", "sides", "copies", "id", "print", "place"])


SPAN_TYPE, SPANS = "array<struct<start:bigint,end:bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "id long, print long, first long, last long, end boolean, known boolean"


def _matched(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by gram, around, sides: repeated window starts (end false), and anchors at ends of repeats
    (end true, `first` their place; known: all their windows are repeats anyway). Only the open gram's first is held."""
    run = lone = None  # the anchors alike so far (first row, whether more, whether the first is untold); the gram's only kind so far

    for batch in batches:
        gram, copies = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        next_to = gram[1:] == gram[:-1]
        keep = copies != 1
        keep[1:] |= next_to
        keep[:-1] |= next_to
        keep[[0, -1]] = True
        out: list[tuple] = []

        def close() -> None:
            nonlocal run, lone
            if run is None:
                return
            row, many, _ = run
            kind = (row[4], row[5], row[6], row[6], True, many)
            if lone is not None and lone[0] == row[0]:
                out.extend([kind] if lone[1] is None else [lone[1], kind])
                lone = (row[0], None)
            else:
                lone = (row[0], kind)
            run = None

        told = lambda r: (r[4], r[5], r[6] - r[2] // 256, r[6] - unit.side + r[2] % 256, False, False)
        for row in zip(*(c.to_pylist() for c in batch.filter(pa.array(keep)).columns)):
            if not row[3]:
                out.append((row[4], row[5], row[6], row[1], False, False))
            elif run is not None and run[0][:3] == row[:3]:
                out.extend(map(told, [run[0], row] if run[2] else [row]))
                run = (run[0], True, False)
            else:
                close()
                run = (row, row[3] > 1, True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.bool_()] * 2)], ["id", "print", "first", "last", "end", "known"])
    if run is not None and lone is not None and lone[0] == run[0][0]:
        row, many, _ = run
        out = [(row[4], row[5], row[6], row[6], True, many)] + ([] if lone[1] is None else [lone[1]])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.bool_()] * 2)], ["id", "print", "first", "last", "end", "known"])


def _cut(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Suffixes (a window at most) and left contexts (backwards) at the listed places of (id, print, text, places)."""
    names = ["lead", "suffix", "left", "id", "print", "place", "known"]
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        out: list[tuple] = []
        for i, f, raw, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unit.symbols(batch.column(2)), batch.column(3).to_pylist()):
            for x in places:
                p = x["first"]
                suffix = unit.written(raw[p : p + unit.length])
                out.append((suffix[:LEAD], suffix, unit.written(raw[max(0, p - unit.side) : p][::-1]), i, f, p, x["known"]))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def multikey_order(strings: list[bytes]) -> np.ndarray:
    """Order of byte strings by multikey quicksort on 8-byte characters: ties of one character are sorted by the next."""
    width = max(map(len, strings), default=0) // 8 * 8 + 8
    cells = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), ">u8").reshape(len(strings), -1)
    order, todo = np.arange(len(strings)), [(0, len(strings), 0)]
    while todo:
        a, b, d = todo.pop()
        if b - a < 2 or d == cells.shape[1]:
            continue
        column = cells[order[a:b], d]
        by = np.argsort(column, kind="quicksort")
        order[a:b], column = order[a:b][by], column[by]
        edges = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1], [True])))
        todo += [(a + int(x), a + int(y), d + 1) for x, y in zip(edges[:-1], edges[1:]) if y - x > 1]
    return order


def common_prefixes(strings: list[bytes], order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string and the one before it in the order; 0 for the first."""
    width = max(map(len, strings), default=0) + 1
    raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), -1)[order]
    size = np.array([len(s) for s in strings])[order]
    differs = raw[1:] != raw[:-1]
    return np.concatenate(([0], np.minimum(np.where(differs.any(1), differs.argmax(1), width), np.minimum(size[1:], size[:-1]))))


def _shared(strings: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each two of a few strings, `width` at most."""
    raw = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    differs = raw[:, None, :] != raw[None, :, :]
    size = np.array([len(s) for s in strings])
    return np.minimum(np.where(differs.any(2), differs.argmax(2), width), np.minimum(size[:, None], size[None, :]))


def repeats(suffixes: list[bytes], lefts: list[bytes], unit: Unit = BYTES) -> np.ndarray:
    """For anchors of one group of leading bytes: a row for each, whether its window that starts k symbols to the left repeats."""
    n, length, side, wide = len(suffixes), unit.length, unit.side, unit.wide
    out = np.zeros((n, side + 1), bool)
    if n <= FEW:  # two anchors share the windows from length - (symbols alike ahead) to (symbols alike behind)
        low, high = length - _shared(suffixes, length * wide) // wide, _shared(lefts, side * wide) // wide
        np.fill_diagonal(low, length)
        for i, j in zip(*np.nonzero(low <= high)):
            out[i, low[i, j] : high[i, j] + 1] = True
        return out
    forward, backward = multikey_order(suffixes), multikey_order(lefts)
    ahead, behind = common_prefixes(suffixes, forward) // wide, common_prefixes(lefts, backward) // wide
    right_size, left_size = np.array([len(s) // wide for s in suffixes]), np.array([len(s) // wide for s in lefts])
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(side + 1):
        fits = (left_size >= k) & (right_size >= length - k)
        right[forward], left[backward] = np.cumsum(ahead < length - k), np.cumsum(behind < k)
        kind = right * (n + 1) + left
        _, which, many = np.unique(kind[fits], return_inverse=True, return_counts=True)
        out[fits, k] = many[which] > 1
    return out


def _compared(batches: Iterator[pa.RecordBatch], most: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    """Repeated window starts among suffixes that come sorted by leading bytes; digests of windows for a group over `most`."""
    lead, rows, over = None, [], False
    out: list[tuple] = []

    def digests() -> None:
        """The windows of the rows at hand; a few rows at a time, so that they don't pile up."""
        for _, suffix, left, i, f, p, known in rows:
            near, held = unit.turned(left) + suffix, len(left) // unit.wide
            for k in range(max(0, unit.length - len(suffix) // unit.wide), held + 1):
                start = held - k
                out.append((i, f, p - k, p - k, hashlib.md5(near[start * unit.wide : (start + unit.length) * unit.wide]).digest()))

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal over
        if over:
            held = rows[:]
            for at in range(0, len(held), 64):
                rows[:] = held[at : at + 64]
                digests()
                yield packed()
        elif len(rows) > 1:
            for row, hit in zip(rows, repeats([r[1] for r in rows], [r[2] for r in rows], unit)):
                if not row[6] and hit.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    out.extend((row[3], row[4], row[5] - int(b) + 1, row[5] - int(a), None) for a, b in zip(edges[::2], edges[1::2]))
        rows.clear()

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.binary()])], ["id", "print", "first", "last", "window"])
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != lead:
                yield from flush()
                lead, over = row[0], False
            rows.append(row)
            if len(rows) > most or over and len(rows) >= 64:
                over = True
                yield from flush()
            if len(out) >= 10_000:
                yield packed()
    yield from flush()
    if out:
        yield packed()


def _removed(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, starts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            cut = [(a, b) for a, b in _merge([(s["first"], s["last"] + BYTES.length - 1) for s in starts or ()])]
            edges = [0, *(x for a, b in cut for x in (a, b + 1)), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            spans.append([{"start": a, "end": b + 1} for a, b in cut])
            sizes.append(len(raw))
        more = [pa.array(sizes, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names)


def repeated_starts(docs: DataFrame, most: int = MOST, unit: Unit = BYTES) -> DataFrame:
    """(id, print, first, last): starts of repeated windows, for rows (id, print, text)."""
    docs = docs.filter(F.octet_length("text") >= unit.least)
    rows = docs.select("id", "print", "text").mapInArrow(partial(_anchored, unit=unit), ANCHORS)
    found = materialize(rows.repartition("gram").sortWithinPartitions("gram", "around", "sides").mapInArrow(partial(_matched, unit=unit), FOUND), "substring-anchors")
    ends = found.filter("end").groupBy("id", "print").agg(F.collect_list(F.struct("first", "known")).alias("places"))
    cut = docs.join(ends, ["id", "print"]).select("id", "print", "text", "places").mapInArrow(partial(_cut, unit=unit), "lead binary, suffix binary, left binary, id long, print long, place long, known boolean")
    cut = materialize(cut, "substring-suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = cut.repartitionByRange(parts, "lead").sortWithinPartitions("lead").mapInArrow(partial(_compared, most=most, unit=unit), "id long, print long, first long, last long, window binary")
    compared = materialize(compared, "substring-repeats")
    dealt = compared.filter("window is not null").dropDuplicates(["window", "id", "print", "first"])  # two anchors may tell of one window
    often = dealt.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    starts = ["id", "print", "first", "last"]
    return found.filter("not end").select(*starts).unionByName(compared.filter("window is null").select(*starts)).unionByName(dealt.join(often, "window", "left_semi").select(*starts))


def marked(df: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """An id (0 for null) and a hash of id and text, by which rows are told apart."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    return own, F.xxhash64(F.col(id_col).isNull(), own, body(text_col))


def _joined(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b + 1} for a, b in _merge([(s["first"], s["last"] + unit.length - 1) for s in starts])] for starts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS)], ["id", "print", "passages"])


def passage_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(id, print, passages): for rows that have any, spans (start, end), in words, of what lies in passages of over 50 words that
    also start anywhere else. Words are compared without regard to the case of A-Z, white space between them isn't."""
    own, mark = marked(df, id_col, text_col)
    docs = df.select(own.alias("id"), mark.alias("print"), body(text_col).alias("text"))
    starts = repeated_starts(docs, most, WORDS).groupBy("id", "print").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    return starts.mapInArrow(partial(_joined, unit=WORDS), f"id long, print long, passages {SPAN_TYPE}")


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """`df` with passages, an array of (start, end) as `passage_spans` tells them; empty where there are none."""
    n = {x: fresh(df, x) for x in ("id", "print", "idr", "printr", "passages")}
    own, mark = marked(df, id_col, text_col)
    spans = passage_spans(df, id_col, text_col, most).select(F.col("id").alias(n["idr"]), F.col("print").alias(n["printr"]), F.col("passages").alias(n["passages"]))
    rows = df.withColumns({n["id"]: own, n["print"]: mark}).join(spans, (F.col(n["id"]) == F.col(n["idr"])) & (F.col(n["print"]) == F.col(n["printr"])), "left")
    return rows.select(*df.columns, F.coalesce(n["passages"], F.array().cast(SPAN_TYPE)).alias(n["passages"]))


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """`df` with n_bytes, removed (array of start, end in bytes) and kept (binary)."""
    n = {x: fresh(df, x) for x in ("id", "print", "idr", "printr", "starts", "n_bytes", "removed", "kept")}
    own, mark = marked(df, id_col, text_col)
    docs = df.select(own.alias("id"), mark.alias("print"), body(text_col).alias("text"))
    starts = repeated_starts(docs, most).groupBy(F.col("id").alias(n["idr"]), F.col("print").alias(n["printr"])).agg(F.collect_list(F.struct("first", "last")).alias(n["starts"]))
    rows = df.withColumns({n["id"]: own, n["print"]: mark}).join(starts, (F.col(n["id"]) == F.col(n["idr"])) & (F.col(n["print"]) == F.col(n["printr"])), "left").select(*df.columns, n["starts"])
    out = [n["n_bytes"], n["removed"], n["kept"]]
    fields = T.StructType([*df.schema.fields, T.StructField(out[0], T.LongType()), T.StructField(out[1], T._parse_datatype_string(SPAN_TYPE)), T.StructField(out[2], T.BinaryType())])
    return rows.mapInArrow(partial(_removed, at=df.columns.index(text_col), names=[*df.columns, *out]), fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, which 400-byte strings decide, and n_passage_words: words in passages of over 50 words that also
    start anywhere else. Many such passages are shorter than 400 bytes, so that no byte of them is removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = remove(docs)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    own, mark = marked(rows, "doc_id", "text")
    rows = rows.select("doc_id", own.alias("own"), mark.alias("mark"), "n_bytes", total("removed").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    words = passage_spans(docs).select(F.col("id").alias("own"), F.col("print").alias("mark"), total("passages").alias("n"))
    return rows.join(words, ["own", "mark"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n", F.lit(0)).alias("n_passage_words"))
