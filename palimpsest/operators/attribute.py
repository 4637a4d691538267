"""Attribution of whole histories: one shuffle by page, the fold in Python, and one wide result that all tables are views of.

A page's rows of the wide result are its complete state, so the same function resumes: state and new revisions of a page
meet in a cogroup, and what comes out equals a single pass over all revisions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.fold import STORED, Block, Page, Revision, Token
from palimpsest.session import small_batches

#: What a history holds; ord is the order of processing (never the order of rev_id).
HISTORY = {
    "lang": "string", "page_id": "long", "title": "string", "ord": "int", "rev_id": "long", "parent_id": "long", "timestamp": "string", "sha1": "string",
    "comment": "string", "minor": "boolean", "user_id": "long", "user_name": "string", "text": "string", "text_hidden": "boolean",
}
# Fixed value: rows and list entries of the wide result that a task holds before it gives them out.
MOST_HELD = 100_000
_LONGS = pa.list_(pa.int64())
_KINDS = {
    "input": [("ord", pa.int32()), ("rev_id", pa.int64()), ("status", pa.string())],
    "revision": [("ord", pa.int32()), ("rev_id", pa.int64()), ("editor", pa.string()), ("timestamp", pa.string()), ("length", pa.int32()), ("original_adds", pa.int32()), ("paragraph_ids", pa.list_(pa.int32())), ("token_ids", pa.list_(pa.int32()))],
    "token": [("token_id", pa.int32()), ("value", pa.string()), ("origin_rev_id", pa.int64()), ("last_rev_id", pa.int64()), ("inbound", _LONGS), ("outbound", _LONGS)],
    "paragraph": [("paragraph_id", pa.int32()), ("hash", pa.string()), ("sentence_ids", pa.list_(pa.int32()))],
    "sentence": [("sentence_id", pa.int32()), ("hash", pa.string()), ("token_ids", pa.list_(pa.int32()))],
    "meta": [("title", pa.string()), ("n_paragraphs", pa.int32()), ("n_sentences", pa.int32()), ("spam_revisions", _LONGS), ("spam_hashes", pa.list_(pa.string()))],
}
_SCHEMA = pa.schema([("lang", pa.string()), ("page_id", pa.int64()), *((k, pa.struct(v)) for k, v in _KINDS.items())])
_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", _LONGS: "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}
STATE = "lang string, page_id long, " + ", ".join(f"{k} struct<{', '.join(f'{n}: {_NAMES[t]}' for n, t in v)}>" for k, v in _KINDS.items())


class _Rows:
    """Rows of the wide result of many pages, by kind and column, so that Arrow arrays are made once for all of them."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.weight = 0
        self.keys = {kind: ([], []) for kind in _KINDS}
        self.columns = {kind: [([], []) if pa.types.is_list(t) else [] for _, t in fields] for kind, fields in _KINDS.items()}

    def put(self, kind: str, lang: str | None, page_id: int | None, *columns: list) -> Iterator[pa.RecordBatch]:
        """Take in rows of a page; what is held is given out when it is much."""
        n = len(columns[0])
        for key, held in zip((lang, page_id), self.keys[kind]):
            held.extend([key] * n)
        self.weight += n
        for values, held in zip(columns, self.columns[kind]):
            if isinstance(held, tuple):
                held[0].extend(map(len, values))
                before = len(held[1])
                held[1].extend(chain.from_iterable(values))
                self.weight += len(held[1]) - before
            else:
                held.extend(values)
        if self.weight > MOST_HELD:
            yield from self.flush()

    def put_page(self, page: Page, lang: str | None, page_id: int | None, title: str | None, inputs: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A page's state. The parts of a large one are given out one after another."""
        blocks: dict[str, dict[int, Block]] = {"p": {}, "s": {}}
        for level in ("p", "s"):
            for found in page.known[level].values():
                blocks[level].update((b.id, b) for b in found)
        for r in page.revisions.values():
            blocks["p"].update((b.id, b) for b in r.paragraphs)
        for p in list(blocks["p"].values()):
            blocks["s"].update((b.id, b) for b in p.parts)
        put = lambda kind, *columns: self.put(kind, lang, page_id, *columns)
        if inputs:
            yield from put("input", *zip(*inputs))
        for r in (page.revisions[i] for i in page.order):
            yield from put("revision", [r.ord], [r.id], [r.editor], [r.timestamp], [r.length], [r.original_adds], [[b.id for b in r.paragraphs]], [r.token_ids()])
        for at in range(0, len(page.tokens), MOST_HELD):
            part = page.tokens[at : at + MOST_HELD]
            yield from put("token", range(at, at + len(part)), [t.value for t in part], [t.origin for t in part], page.seen_last[at : at + len(part)].tolist(), [t.restored for t in part], [t.removed for t in part])
        if blocks["p"]:
            ids, found = zip(*sorted(blocks["p"].items()))
            yield from put("paragraph", ids, [b.hash for b in found], [[s.id for s in b.parts] for b in found])
        if blocks["s"]:
            ids, found = zip(*sorted(blocks["s"].items()))
            yield from put("sentence", ids, [b.hash for b in found], [b.parts for b in found])
        yield from put("meta", [title], [page.paragraph_count], [page.sentence_count], [page.vandal_ids], [sorted(page.vandal_hashes)])

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, fields in _KINDS.items():
            langs, pages = self.keys[kind]
            if langs:
                arrays = []
                for (_, t), held in zip(fields, self.columns[kind]):
                    if isinstance(held, tuple):
                        arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(held[0]))), pa.int32()), pa.array(held[1], t.value_type)))
                    else:
                        arrays.append(pa.array(held, t))
                filled = pa.StructArray.from_arrays(arrays, fields=[pa.field(*f) for f in fields])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pages, pa.int64()), *(filled if name == kind else pa.nulls(len(langs), pa.struct(f)) for name, f in _KINDS.items())], schema=_SCHEMA)
        self._clear()


def _load(state: pa.Table) -> tuple[Page, str | None, list[tuple]]:
    """The page that `put_page` wrote, its title, and the statuses so far."""
    page, rows = Page(), {}
    for kind in _KINDS:
        column = state.column(kind)
        rows[kind] = column.filter(column.is_valid()).to_pylist()
    found = sorted(rows["token"], key=lambda t: t["token_id"])
    page.tokens = [Token(t["value"], t["origin_rev_id"], t["inbound"] or (), t["outbound"] or ()) for t in found]
    page.seen_last = np.array([t["last_rev_id"] for t in found] + [0] * max(1, 1024 - len(found)), np.int64)
    sentences = {s["sentence_id"]: Block(s["sentence_id"], s["hash"], s["token_ids"]) for s in rows["sentence"]}
    paragraphs = {}
    for p in sorted(rows["paragraph"], key=lambda p: p["paragraph_id"]):
        block = paragraphs[p["paragraph_id"]] = Block(p["paragraph_id"], p["hash"], by_hash={})
        for s in p["sentence_ids"]:
            block.add(sentences[s])
    for level, blocks in (("p", paragraphs), ("s", sentences)):
        for _, b in sorted(blocks.items()):  # ids were given in the order in which blocks became known
            page.known[level].setdefault(b.hash, []).append(b)
    for r in sorted(rows["revision"], key=lambda r: r["ord"]):
        page.order.append(r["rev_id"])
        page.revisions[r["rev_id"]] = Revision(r["rev_id"], r["ord"], r["editor"], r["timestamp"], r["length"], r["original_adds"], [paragraphs[i] for i in r["paragraph_ids"]])
    title = None
    for m in rows["meta"]:
        title, page.paragraph_count, page.sentence_count = m["title"], m["n_paragraphs"], m["n_sentences"]
        page.vandal_ids, page.vandal_hashes = m["spam_revisions"], set(m["spam_hashes"])
    return page, title, [(i["ord"], i["rev_id"], i["status"]) for i in sorted(rows["input"], key=lambda i: i["ord"])]


def advance(page: Page, rows: Iterable[dict], start: int = 0) -> list[tuple]:
    """Apply revisions in order; (ord, rev_id, status) of each that isn't hidden."""
    out = []
    for at, r in enumerate(rows, start):
        status = page.apply(r["rev_id"], r["text"] or "", r["timestamp"] or "", r["sha1"], r["comment"], bool(r["minor"]), r["user_id"], r["user_name"], at)
        out.append((at, r["rev_id"], status))
    return out


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages from rows sorted by page: first the rows of its state, if there is one (`_of` is null), then revisions in order."""
    out = _Rows()
    key, state, page, title, inputs = None, [], None, None, []

    def done() -> Iterator[pa.RecordBatch]:
        if page is not None:
            yield from out.put_page(page, *key, title, inputs)
        else:  # nothing new
            yield from state

    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("page_id").to_pylist()))
        new = batch.column("_of").to_pylist()
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a] and (new[b] is None) == (new[a] is None):
                b += 1
            if keys[a] != key:
                if key is not None:
                    yield from done()
                key, state, page, title, inputs = keys[a], [], None, None, []
            if new[a] is None:
                state.append(batch.slice(a, b - a).select(_SCHEMA.names).cast(_SCHEMA))
            else:
                if page is None:
                    page, title, inputs = _load(pa.Table.from_batches(state)) if state else (Page(), None, [])
                    state = []
                inputs += advance(page, new[a:b], len(inputs))
                title = next((r["title"] for r in reversed(new[a:b]) if r["title"] is not None), title)
            a = b
    if key is not None:
        yield from done()
    yield from out.flush()


def normalized(history: DataFrame) -> DataFrame:
    """The columns of HISTORY with their types (null where missing), without hidden texts."""
    have = set(history.columns)
    rows = history.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in HISTORY.items()))
    if "ord" not in have:
        rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("lang", "page_id").orderBy("timestamp", "rev_id")) - 1)
    return rows.filter(~F.coalesce("text_hidden", F.lit(False)))


def _folded(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    rows = rows.repartition("lang", "page_id").sortWithinPartitions("lang", "page_id", F.col("_of").isNotNull(), *(F.col(f"_of.{c}").asc_nulls_last() for c in ("ord", "timestamp", "rev_id")))
    return rows.mapInArrow(_fold, STATE)


def _revisions(history: DataFrame) -> DataFrame:
    needed = normalized(history).drop("parent_id", "text_hidden")
    return needed.select("lang", "page_id", F.struct(*(c for c in needed.columns if c not in ("lang", "page_id"))).alias("_of"))


def attribute(history: DataFrame) -> DataFrame:
    """The wide result of a history (STATE). One page is one task's work; pages spread over the shuffle's partitions, and a task
    reads its pages one after another in order, so that it never holds more than one page's state and one batch of rows."""
    return _folded(_revisions(history))


def resume(state: DataFrame, history: DataFrame) -> DataFrame:
    """The wide result after more revisions; pages without any stay as they are."""
    return _folded(state.select(*_SCHEMA.names).unionByName(_revisions(history), allowMissingColumns=True))


class Tables:
    """The relational tables of a wide result; each is a filter and a projection of it."""

    def __init__(self, state: DataFrame):
        self.state = state

    def _of(self, kind: str) -> DataFrame:
        return self.state.filter(F.col(kind).isNotNull()).select("lang", "page_id", f"{kind}.*")

    @property
    def inputs(self) -> DataFrame:
        """Status of every revision that came in."""
        return self._of("input")

    @property
    def revisions(self) -> DataFrame:
        """Stored revisions, with the stored one before (0 for the first)."""
        order = W.partitionBy("lang", "page_id").orderBy("ord")
        return self._of("revision").drop("paragraph_ids", "token_ids").withColumn("parent_rev_id", F.coalesce(F.lag("rev_id").over(order), F.lit(0).cast("long")))

    @property
    def revision_tokens(self) -> DataFrame:
        return self._of("revision").select("lang", "page_id", "rev_id", "ord", "token_ids")

    @property
    def revision_paragraphs(self) -> DataFrame:
        return self._of("revision").select("lang", "page_id", "rev_id", F.posexplode("paragraph_ids").alias("pos", "paragraph_id"))

    @property
    def tokens(self) -> DataFrame:
        return self._of("token")

    @property
    def paragraphs(self) -> DataFrame:
        return self._of("paragraph")

    @property
    def sentences(self) -> DataFrame:
        return self._of("sentence")

    @property
    def hash_index(self) -> DataFrame:
        rows = self.paragraphs.select("lang", "page_id", F.lit("p").alias("kind"), "hash", F.col("paragraph_id").alias("id"))
        rows = rows.unionByName(self.sentences.select("lang", "page_id", F.lit("s").alias("kind"), "hash", F.col("sentence_id").alias("id")))
        return rows.groupBy("lang", "page_id", "kind", "hash").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    @property
    def article_meta(self) -> DataFrame:
        """Totals of each page."""
        page = ["lang", "page_id"]
        token = F.sum(F.when(F.col("token").isNotNull(), 1).otherwise(0))
        stored = F.col("revision").isNotNull()
        last = lambda c: F.max_by(f"revision.{c}", F.when(stored, F.col("revision.ord")))
        return self.state.groupBy(*page).agg(
            F.max("meta.title").alias("title"), last("rev_id").alias("last_processed_revid"), last("timestamp").alias("last_processed_timestamp"),
            F.sum(stored.cast("int")).alias("n_revisions"), token.alias("n_lifetime_tokens"), F.max(F.size("meta.spam_revisions")).cast("long").alias("n_spam_revisions"),
            F.coalesce(F.max("token.token_id") + 1, F.lit(0)).alias("next_token_id"), F.max("meta.spam_revisions").alias("spam_revisions"), F.max("meta.spam_hashes").alias("spam_hashes"), F.lit(1).alias("schema_version"),
        )


def vandalised(tables: Tables) -> DataFrame:
    return tables.inputs.filter(F.col("status") != STORED)
