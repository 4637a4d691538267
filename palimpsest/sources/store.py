"""Snapshots on Parquet: the state of pages, what is known of each page at a glance, and the index from revision to page.

A write appends one generation (a folder for each of the three parts) that holds the pages written, whole, and then publishes a
manifest that lists the generations in force. Nothing that a manifest lists is ever changed, so a writer that is lost before it
publishes leaves the store as it was, and readers see one manifest's generations throughout. Of a page, the latest
generation counts; index entries of an earlier one are stale with it. `compact` merges the newest generations.

State lies by language and shard, so a page is read by partition pruning and a pushed-down filter; the index by language and span of
revision ids; the table of pages by language, sorted by title.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from palimpsest.functions.text import shard_path, title_key
from palimpsest.operators.attribute import STATE, Tables

VERSION = 1
#: Pages of a shard, and revision ids of a span, have the same quotient.
PAGES_OF_SHARD, REVISIONS_OF_SPAN = 1000, 1 << 20
#: Superseded pages up to which their list is broadcast; it is counted first.
BROADCAST_PAGES = 200_000
#: An older generation is merged with the newer ones if it has at most so many times their pages.
MERGE_FACTOR = 4
PARTS = {
    "state": f"{STATE}, gen int, lang string, shard long".replace("lang string, page_id", "page_id", 1),
    "meta": "page_id long, title string, title_key string, last_processed_revid long, last_processed_timestamp string, n_revisions long, n_lifetime_tokens long, n_spam_revisions long, version int, gen int, lang string",
    "index": "rev_id long, page_id long, gen int, lang string, span long",
}
_WIDE = ["lang", "page_id", "input", "revision", "token", "paragraph", "sentence", "meta"]


class IndexCollision(ValueError):
    """One revision id in two pages."""


class Conflict(RuntimeError):
    """Another writer published first."""


def colliding(entries: DataFrame) -> DataFrame:
    """(lang, rev_id, n_pages) of revision ids that several pages claim."""
    return entries.groupBy("lang", "rev_id").agg(F.count_distinct("page_id").alias("n_pages")).filter("n_pages > 1")


def index_entries(tables: Tables) -> DataFrame:
    return tables.revision_tokens.select("lang", "rev_id", "page_id")


def _refuse_collisions(entries: DataFrame) -> None:
    if bad := colliding(entries).head(1):
        raise IndexCollision(f"revision {bad[0]['rev_id']} of {bad[0]['lang']} is in {bad[0]['n_pages']} pages")


def replace_entries(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with all entries of the pages in `fresh` replaced, each once, in order; a collision is an error."""
    pages = fresh.select("lang", "page_id").distinct()
    merged = index.join(pages, ["lang", "page_id"], "left_anti").select("lang", "rev_id", "page_id").unionByName(fresh.select("lang", "rev_id", "page_id")).dropDuplicates(["lang", "rev_id", "page_id"])
    _refuse_collisions(merged)
    return merged.orderBy("lang", "rev_id")


def out_of_order(index: DataFrame) -> DataFrame:
    """Entries whose id doesn't ascend strictly in their language; a sound index has none."""
    before = F.lag("rev_id").over(W.partitionBy("lang").orderBy("rev_id"))
    return index.withColumn("before", before).filter("before >= rev_id").drop("before")


def lookup(index: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(index.select("lang", "rev_id", "page_id"), ["lang", "rev_id"], "left")


def spanned(entries: DataFrame, *more: str) -> DataFrame:
    return entries.select("lang", "rev_id", "page_id", *more, F.floor(F.col("rev_id") / REVISIONS_OF_SPAN).alias("span"))


@dataclass(frozen=True)
class Manifest:
    """The generations in force, oldest first, with the pages that each was written with; the next free number; the index's folder."""

    number: int = 0
    gens: tuple[tuple[int, int], ...] = ()
    next_gen: int = 0
    index: str = "index"

    @property
    def numbers(self) -> list[int]:
        return [g for g, _ in self.gens]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- manifests -----------------------------------------------------------------------------------------------------------

    def _files(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at, hadoop

    def manifest(self) -> Manifest:
        files, at, hadoop = self._files("manifest")
        if not files.exists(at):
            return Manifest()
        numbers = sorted(int(s.getPath().getName()) for s in files.listStatus(at) if s.getPath().getName().isdigit())
        if not numbers:
            return Manifest()
        stream = files.open(hadoop.Path(at, f"{numbers[-1]:012d}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(numbers[-1], tuple(map(tuple, held["gens"])), held["next_gen"], held["index"])

    def _publish(self, before: Manifest, gens: list[tuple[int, int]], next_gen: int, index: str | None = None) -> None:
        """Write the manifest beside and rename it: it is there whole or not at all, and only once for a number."""
        files, at, hadoop = self._files("manifest")
        files.mkdirs(at)
        beside = hadoop.Path(at, f".{next_gen}-{self.spark.sparkContext.applicationId}.tmp")
        stream = files.create(beside, True)
        try:
            stream.write(bytearray(json.dumps({"gens": gens, "next_gen": next_gen, "index": index or before.index}).encode()))
        finally:
            stream.close()
        final = hadoop.Path(at, f"{before.number + 1:012d}")
        if files.exists(final) or not files.rename(beside, final):
            files.delete(beside, False)
            raise Conflict(f"manifest {before.number + 1} is there already")

    # ---- reading -------------------------------------------------------------------------------------------------------------

    def _part(self, part: str, held: Manifest, gens: list[int] | None = None) -> DataFrame:
        gens, folder = held.numbers if gens is None else gens, held.index if part == "index" else part
        if not gens:
            return self.spark.createDataFrame([], PARTS[part])
        return self.spark.read.schema(PARTS[part]).option("basePath", f"{self.root}/{folder}").parquet(*(f"{self.root}/{folder}/gen={g}" for g in gens))

    def _in_force(self, part: str, held: Manifest | None = None, meta: DataFrame | None = None) -> DataFrame:
        """Rows of a part without those of superseded pages. A single generation has none; of several, the superseded
        pages are told by the small table of pages."""
        held = held or self.manifest()
        rows = self._part(part, held)
        if len(held.gens) < 2:
            return rows
        known = (self._part("meta", held) if meta is None else meta).select("lang", "page_id", "gen")
        last = known.groupBy("lang", "page_id").agg(F.max("gen").alias("last"), F.count("*").alias("n")).filter("n > 1")
        stale = known.join(last, ["lang", "page_id"]).filter("gen < last").select("lang", "page_id", "gen")
        written = sum(n for _, n in held.gens[1:])  # no more pages than these can supersede another
        return rows.join(F.broadcast(stale) if written <= BROADCAST_PAGES else stale, ["lang", "page_id", "gen"], "left_anti")

    @property
    def meta(self) -> DataFrame:
        """A row for each page: title, last revision, totals."""
        return self._in_force("meta")

    def pages(self, wanted: DataFrame | list[tuple[str, int]] | None = None) -> DataFrame:
        """The wide result of some pages, or of all. Few pages are a filter that prunes generations, shards and row groups; a table
        is a semi join."""
        held = self.manifest()
        meta = self._part("meta", held)
        if isinstance(wanted, list):
            hit = F.lit(False)
            for lang, page in wanted:
                hit = hit | ((F.col("lang") == lang) & (F.col("page_id") == page))
            found = meta.filter(hit).select("lang", "page_id", "gen", "version").collect()  # a row for each asked page and generation
            last: dict = {}
            for r in found:
                last[r["lang"], r["page_id"]] = max(r["gen"], last.get((r["lang"], r["page_id"]), -1))
            newer = [r["version"] for r in found if r["version"] > VERSION]
            rows, hit = self._part("state", held, sorted({*last.values()})), F.lit(False)
            for (lang, page), gen in last.items():
                hit = hit | ((F.col("gen") == gen) & (F.col("lang") == lang) & (F.col("shard") == page // PAGES_OF_SHARD) & (F.col("page_id") == page))
            rows = rows.filter(hit)
        else:
            newer = [r["version"] for r in meta.filter(F.col("version") > VERSION).select("version").head(1)]
            rows = self._in_force("state", held, meta)
            if wanted is not None:
                shards = wanted.select("lang", F.floor(F.col("page_id") / PAGES_OF_SHARD).alias("shard")).distinct()
                rows = rows.join(F.broadcast(shards), ["lang", "shard"], "left_semi") if shards.count() <= BROADCAST_PAGES else rows
                rows = rows.join(wanted.select("lang", "page_id").distinct(), ["lang", "page_id"], "left_semi")
        if newer:
            raise ValueError(f"written by a newer version: {newer[0]}")
        return rows.select(*_WIDE)

    def tables(self, wanted=None) -> Tables:
        return Tables(self.pages(wanted))

    @property
    def index(self) -> DataFrame:
        return self._in_force("index").select("lang", "rev_id", "page_id")

    def page_of_revision(self, lang: str, rev_id: int) -> int | None:
        """A span is pruned to, and its row groups, sorted by revision; then the page's generation is asked for."""
        held = self.manifest()
        rows = self._part("index", held).filter((F.col("lang") == lang) & (F.col("span") == rev_id // REVISIONS_OF_SPAN) & (F.col("rev_id") == rev_id))
        return next((r["page_id"] for r in rows.select("page_id", "gen").collect() if self._generation(held, lang, r["page_id"]) == r["gen"]), None)

    def page_of_title(self, lang: str, title: str) -> int | None:
        held = self.manifest()
        rows = self._part("meta", held).filter((F.col("lang") == lang) & (F.col("title_key") == title.replace(" ", "_")))
        found = sorted((r["page_id"], r["gen"]) for r in rows.select("page_id", "gen").collect())
        return next((page for page, gen in found if self._generation(held, lang, page) == gen), None)

    def _generation(self, held: Manifest, lang: str, page_id: int) -> int | None:
        return self._part("meta", held).filter((F.col("lang") == lang) & (F.col("page_id") == page_id)).agg(F.max("gen")).first()[0]

    def revision(self, lang: str, rev_id: int) -> DataFrame:
        """One stored revision by its id."""
        page = self.page_of_revision(lang, rev_id)
        return self.tables([(lang, page)] if page is not None else []).revision_tokens.filter(F.col("rev_id") == rev_id)

    def revisions_in_order(self, lang: str) -> DataFrame:
        """(rev_id, page_id) of a language by ascending id; no snapshot is read."""
        return self.index.filter(F.col("lang") == lang).select("rev_id", "page_id").orderBy("rev_id")

    # ---- writing -------------------------------------------------------------------------------------------------------------

    def _put(self, rows: DataFrame, path: str, *by: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{path}")

    def _append(self, before: Manifest, fresh: DataFrame, entries: DataFrame) -> None:
        gen = before.next_gen
        shard = F.floor(F.col("page_id") / PAGES_OF_SHARD)
        self._put(fresh.select(*_WIDE).withColumn("shard", shard).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "page_id"), f"state/gen={gen}", "lang", "shard")
        self._put(spanned(entries).repartition("lang", "span").sortWithinPartitions("lang", "span", "rev_id"), f"{before.index}/gen={gen}", "lang", "span")
        names = [c.split(" ")[0] for c in PARTS["meta"].split(", ") if c.split(" ")[0] not in ("gen", "title_key", "version")]
        rows = Tables(fresh).article_meta.select(*names, title_key("title").alias("title_key"), F.lit(VERSION).alias("version"))
        self._put(rows.repartitionByRange("lang", "title_key").sortWithinPartitions("lang", "title_key"), f"meta/gen={gen}", "lang")

    def write(self, state: DataFrame) -> None:
        """Replace the pages of a wide result: one more generation. Revision ids new to a page must be new to its language."""
        before = self.manifest()
        fresh = state.select(*_WIDE).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            pages = fresh.filter("meta is not null").select("lang", "page_id").distinct()
            n_pages = pages.count()
            if not n_pages:
                return
            entries = index_entries(Tables(fresh)).dropDuplicates()
            if before.gens:
                known = index_entries(self.tables(pages))  # of these pages alone
                new = spanned(entries.join(known, ["lang", "rev_id", "page_id"], "left_anti")).persist(StorageLevel.MEMORY_AND_DISK)
                spans = new.select("lang", "span").distinct()
                others = self._in_force("index", before).join(F.broadcast(spans), ["lang", "span"], "left_semi").join(pages, ["lang", "page_id"], "left_anti")
                _refuse_collisions(entries.unionByName(others.join(new.select("lang", "rev_id"), ["lang", "rev_id"], "left_semi").select("lang", "rev_id", "page_id")))
                new.unpersist()
            else:
                _refuse_collisions(entries)
            self._append(before, fresh, entries)
            self._publish(before, [*before.gens, (before.next_gen, n_pages)], before.next_gen + 1)
        finally:
            fresh.unpersist()

    def compact(self, factor: float = MERGE_FACTOR) -> int:
        """Merge the newest generations, as long as the next older one has at most `factor` times their pages; how many were
        merged. A page is so rewritten about as often as the logarithm of the number of pages."""
        before = self.manifest()
        chosen, pages = [], 0
        for gen, n in before.gens[::-1]:
            if chosen and n > factor * pages:
                break
            chosen.append(gen)
            pages += n
        if len(chosen) < 2:
            return 0
        rows = self._in_force("state", before).filter(F.col("gen").isin(chosen))
        self._append(before, rows, self._in_force("index", before).filter(F.col("gen").isin(chosen)))
        n = self._part("meta", before, [before.next_gen]).count()
        self._publish(before, [*(g for g in before.gens if g[0] not in chosen), (before.next_gen, n)], before.next_gen + 1)
        return len(chosen)

    def vacuum(self) -> int:
        """Delete the generations that no manifest in force lists, such as those that were merged or never published; how many
        folders. Not while others read or write."""
        held, gone = self.manifest(), 0
        files, at, hadoop = self._files("")
        for part in [s.getPath() for s in files.listStatus(at)] if files.exists(at) else ():
            if part.getName() == "manifest":
                continue
            live = held.numbers if part.getName() in ("state", "meta", held.index) else []
            for s in files.listStatus(part):
                if s.getPath().getName() not in {f"gen={g}" for g in live}:
                    gone += files.delete(s.getPath(), True)
        return gone

    def rebuild_index(self) -> DataFrame:
        """The index made anew, in a folder of its own, from the snapshots; (lang, articles, entries). A collision is an error and
        leaves the old one. Of the snapshots only pages and revision ids are read."""
        before = self.manifest()
        entries = self._in_force("state", before).filter("revision is not null").select("lang", "page_id", "gen", F.col("revision.rev_id").alias("rev_id")).dropDuplicates()
        _refuse_collisions(entries)
        folder = f"index-{before.number + 1}"
        rows = spanned(entries, "gen")
        self._put(rows.repartition("gen", "lang", "span").sortWithinPartitions("gen", "lang", "span", "rev_id"), folder, "gen", "lang", "span")
        self._publish(before, list(before.gens), before.next_gen, folder)
        return self.index.groupBy("lang").agg(F.count_distinct("page_id").alias("articles"), F.count("*").alias("entries"))

    # ---- what is there -------------------------------------------------------------------------------------------------------

    def languages(self) -> DataFrame:
        return self.meta.select("lang").distinct().orderBy("lang")

    def titles(self) -> DataFrame:
        return self.meta.select("lang", "page_id", "title")

    def paths(self) -> DataFrame:
        return self.meta.select("lang", "page_id").withColumn("path", shard_path("lang", "page_id"))

    def file_sizes(self) -> DataFrame:
        """(part, files, bytes, bytes of the rows as JSON texts, ratio) of what is stored, by part."""
        held, plain = self.manifest(), None
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load([f"{self.root}/{p}" for p in ("state", "meta", held.index)]).select("path", "length")
        part = F.regexp_extract("path", r"/(state|index|meta)[-0-9]*/gen=", 1)
        stored = files.groupBy(part.alias("part")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
        for p in PARTS:
            rows = self._part(p, held).agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("plain_bytes")).withColumn("part", F.lit(p))
            plain = rows if plain is None else plain.unionByName(rows)
        return stored.join(plain, "part").withColumn("ratio", F.col("plain_bytes") / F.col("bytes"))
