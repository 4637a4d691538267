"""What readers ask of a store: contents and colours of revisions, as a status and a body of the fixed shapes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import annotate
from palimpsest.operators.attribute import Tables, attribute, normalized
from palimpsest.plans import views
from palimpsest.sources.store import VERSION, Store

# Revisions of a replayed window, if not told, and at most.
WINDOW, LONGEST_WINDOW = 500, 2000


@dataclass(frozen=True)
class Answer:
    status: int
    body: dict


def parameters(asked: dict[str, str]) -> tuple[str, ...]:
    """Token fields that a request turns on: only the very word "true" does."""
    return tuple(f for f in views.FIELDS if asked.get(f) == "true")


def not_ready() -> Answer:
    return Answer(408, {"Info": "Process took more than 240 seconds. Requested data will be available soon (Max 300 seconds). Please try again later."})


def not_coloured(title: str, rev_id: int | None, vandalism: bool) -> Answer:
    info = f"Requested revision ({rev_id}) is detected as vandalism." if vandalism else "Requested data is not currently available. It will be available soon."
    return Answer(200, {"info": info, "success": False, "rev_id": rev_id, "page_title": title})


def failure(error: str, status: int, title: str | None = None, rev_id: int | None = None) -> Answer:
    return Answer(status, {"error": error, "success": False, "rev_id": rev_id, "page_title": title})


class Service:
    """Point reads: each is a filter that prunes shards, then one page's worth of rows."""

    def __init__(self, store: Store, users: DataFrame | None = None, history: DataFrame | None = None):
        self.store, self.history = store, history
        self.users = store.spark.createDataFrame([], "user_id long, user_name string") if users is None else users

    def health(self) -> Answer:
        """That the service is up, which of its layouts it reads and where; nothing is read."""
        return Answer(200, {"status": "ok", "version": VERSION, "storage_root": self.store.root})

    def page_of_title(self, lang: str, title: str) -> int | None:
        return self.store.page_of_title(lang, title)

    def page_of_revision(self, lang: str, rev_id: int) -> int | None:
        return self.store.page_of_revision(lang, rev_id)

    def _latest(self, tables: Tables) -> int | None:
        row = views.latest(tables).head(1)
        return row[0]["rev_id"] if row else None

    def rev_content(self, lang: str, rev_id: int | None = None, title: str | None = None, page_id: int | None = None, end_rev_id: int | None = None, fields: tuple[str, ...] = ()) -> Answer:
        """By revision, by title or page (the latest), by title and revision, or a half-open range of two revisions."""
        page = page_id if page_id is not None else self.page_of_title(lang, title) if title is not None else self.page_of_revision(lang, rev_id)
        if page is None:
            return not_ready() if title is not None or page_id is not None else Answer(400, views.missing(rev_id))
        tables = self.store.tables([(lang, page)])
        rev_id = self._latest(tables) if rev_id is None else rev_id
        if rev_id is None:
            return not_ready()
        for wanted in (rev_id, end_rev_id):
            if wanted is not None and not tables.revision_tokens.filter(F.col("rev_id") == wanted).head(1):
                return Answer(400, views.missing(wanted))
        chosen = views.revision_slice(tables, {"lang": lang, "page_id": page}, rev_id, end_rev_id)
        rows = views.rev_content(tables, chosen, fields).head(1)
        if rows:
            return Answer(200, json.loads(rows[0]["content"]))
        head = tables.article_meta.head(1)[0]  # a range without revisions
        return Answer(200, {"article_title": head["title"] or "", "page_id": page, "success": True, "message": None, "revisions": []})

    def colours(self, lang: str, title: str, now: int, rev_id: int | None = None, render=None) -> Answer:
        """Colours of a revision (none or 0: the latest); `render` turns the annotated markup into HTML."""
        page = self.page_of_title(lang, title)
        if page is None:
            return not_coloured(title, rev_id or None, False)
        tables = self.store.tables([(lang, page)])
        rev_id = rev_id or self._latest(tables)
        wanted = views.revision_slice(tables, {"lang": lang, "page_id": page}, rev_id or 0)
        if not wanted.head(1):
            asked = self.store.spark.createDataFrame([(lang, page, rev_id)], "lang string, page_id long, rev_id long")
            spam = views.is_vandalism(tables, asked).head(1)
            return not_coloured(title, rev_id, bool(spam and spam[0]["is_vandalism"]))
        if self.history is None:
            return failure("no source of texts", 503, title, rev_id)
        coloured = views.colours(tables, now, wanted)
        texts = normalized(self.history).filter((F.col("lang") == lang) & (F.col("page_id") == page) & (F.col("rev_id") == rev_id))
        marked = annotate.annotated_texts(coloured, texts)
        rows = views.colour_envelope(tables, coloured, marked, self.users).head(1)
        if not rows:
            return failure("the revision's text is missing", 500, title, rev_id)
        body = json.loads(rows[0]["content"])
        if render:
            body["extended_html"] = render(title, body["extended_html"])
        return Answer(200, body)


def replay(history: DataFrame, window: int = WINDOW) -> Tables:
    """An attribution of the last revisions of each page alone; nothing is stored. At most LONGEST_WINDOW of them."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("lang", "page_id").orderBy(F.desc("ord")))
    rows = normalized(history).withColumn("place", place).filter(F.col("place") <= min(max(1, window), LONGEST_WINDOW)).drop("place")
    return Tables(attribute(rows))
