"""Live changes: server-sent event frames, and the filter that leaves page edits."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from palimpsest.functions.text import wiki_name

CHANGE = "type string, namespace long, wiki string, server_name string, title string, page_id long, id long, revision struct<new: long, old: long>"


class Frames:
    """Frames from text that arrives in pieces: data lines are joined by line feeds, an empty line ends a frame."""

    def __init__(self) -> None:
        self.rest, self.data, self.id = "", [], None

    def feed(self, piece: str) -> list[tuple[str, str | None]]:
        """(data, id) of each frame that the piece completes; a frame without data gives nothing and its id is forgotten."""
        *lines, self.rest = (self.rest + piece).split("\n")
        out = []
        for line in (x.removesuffix("\r") for x in lines):
            if not line:
                if self.data:
                    out.append(("\n".join(self.data), self.id))
                self.data, self.id = [], None
            elif line.startswith("data:"):
                self.data.append(line[5:].removeprefix(" "))
            elif line.startswith("id:"):
                self.id = line[3:].strip()
        return out


def page_edits(raw: DataFrame, column: str = "value", languages: list[str] | None = None) -> DataFrame:
    """(language, wiki, page_id, rev_id, parent_rev_id, title, event_id) of the edits and creations of main-namespace pages.

    `raw` holds JSON texts in `column` and may hold event_id; it may be a stream. What doesn't parse is left out.
    """
    c: Column = F.from_json(column, CHANGE)
    rows = raw.withColumn("c", c)
    page = F.coalesce("c.page_id", "c.id", F.lit(0))
    language = F.coalesce(F.split("c.server_name", r"\.")[0], F.lit(""))
    keep = F.col("c.type").isin("edit", "new") & (F.col("c.namespace") == 0) & F.col("c.wiki").isNotNull() & F.col("c.title").isNotNull() & F.col("c.revision.new").isNotNull() & (page != 0) & (language != "")
    if languages is not None:
        keep = keep & F.col("c.wiki").isin([f"{x}wiki" for x in languages])
    event = F.col("event_id") if "event_id" in raw.columns else F.lit(None).cast("string")
    return rows.filter(keep).select(
        language.alias("language"), F.col("c.wiki").alias("wiki"), page.alias("page_id"), F.col("c.revision.new").alias("rev_id"),
        F.coalesce("c.revision.old", F.lit(0).cast("long")).alias("parent_rev_id"), F.col("c.title").alias("title"), event.alias("event_id"),
    )


VISIBILITY = "meta struct<domain: string>, page_namespace long, page_id long, rev_id long, visibility struct<text: boolean, user: boolean, comment: boolean>"


def visibility_changes(raw: DataFrame, column: str = "value") -> DataFrame:
    """(language, page_id, rev_id, text_visible, user_visible, comment_visible) of main-namespace revisions that were hidden or
    shown; `raw` may be a stream. What isn't said to be hidden is visible; what doesn't parse is left out."""
    rows = raw.withColumn("c", F.from_json(column, VISIBILITY))
    language = F.coalesce(F.split("c.meta.domain", r"\.")[0], F.lit(""))
    keep = (F.col("c.page_namespace") == 0) & F.col("c.rev_id").isNotNull() & (F.coalesce("c.page_id", F.lit(0)) != 0) & (language != "")
    seen = lambda what: F.coalesce(f"c.visibility.{what}", F.lit(True)).alias(f"{what}_visible")
    return rows.filter(keep).select(language.alias("language"), F.col("c.page_id").alias("page_id"), F.col("c.rev_id").alias("rev_id"), seen("text"), seen("user"), seen("comment"))


def wikis(languages: DataFrame) -> DataFrame:
    return languages.select("lang", wiki_name("lang").alias("wiki"))


class ChangeStream(DataSource):
    """spark.readStream.format("change_stream").option("url", ...): rows (value, event_id). The offset is the last event's id, and
    goes on for frames that a later filter drops; it is where a restarted query asks the server to go on."""

    @classmethod
    def name(cls) -> str:
        return "change_stream"

    def schema(self) -> str:
        return "value string, event_id string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _ChangeReader(dict(self.options))


class _ChangeReader(SimpleDataSourceStreamReader):
    # Seconds before a new attempt after a refused and after a lost connection.
    REFUSED, LOST = 3.0, 1.0

    def __init__(self, options: dict):
        self.url, self.most, self.seconds = options["url"], int(options.get("maxEvents", "500")), float(options.get("maxSeconds", "5"))

    def initialOffset(self) -> dict:
        return {"id": ""}

    def _frames(self, last: str) -> Iterator[tuple[str, str | None]]:
        headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": last} if last else {})
        try:
            answer = urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=self.seconds + 5)
        except OSError:
            time.sleep(self.REFUSED)
            return
        frames, until = Frames(), time.time() + self.seconds
        with answer:
            try:
                for line in answer:
                    yield from frames.feed(line.decode("utf-8", "replace"))
                    if time.time() > until:
                        return
            except OSError:
                time.sleep(self.LOST)

    def read(self, start: dict):
        rows, last = [], start["id"]
        for data, own in self._frames(last):
            rows.append((data, own))
            last = own or last
            if len(rows) >= self.most:
                break
        return iter(rows), {"id": last}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        for data, own in self._frames(start["id"]):
            rows.append((data, own))
            if own == end["id"]:
                break
        return iter(rows)
