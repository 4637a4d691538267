"""Histories as DataFrames: JSON lines, source API records, XML dumps, and a paged remote source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palimpsest.operators.attribute import HISTORY
from palimpsest.session import materialize

#: One line of a history file.
LINE = "rev_id long, parent_id long, timestamp string, sha1 string, comment string, minor boolean, user_id long, user_name string, text string, text_hidden boolean"
META = "lang string, title string, page_id long, rev_id long"


def read_histories(spark: SparkSession, root: str, filters: list[str] | None = None) -> DataFrame:
    """History rows under `root`/{lang}/{page_id}/{rev_id}/history.jsonl, lines in file order; `filters` are "lang" or "lang/page"
    prefixes and prune folders before anything is read."""
    globs = [f"{root}/{f.rstrip('/') + ('/*/*' if '/' not in f.rstrip('/') else '*/*')}" for f in filters or ["*"]]
    lines = spark.read.schema(LINE).json([f"{g}/history.jsonl" for g in globs]).withColumn("path", F.input_file_name())
    meta = spark.read.schema(META).json([f"{g}/meta.json" for g in globs], multiLine=True).withColumn("path", F.input_file_name())
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    rows = lines.withColumn("ord", F.monotonically_increasing_id()).withColumn("folder", folder("path")).drop("path")
    heads = meta.select("lang", "title", "page_id", folder("path").alias("folder"))
    rows = rows.join(heads, "folder").withColumn("ord", (F.row_number().over(W.partitionBy("folder").orderBy("ord")) - 1).cast("int"))
    return rows.select(*HISTORY)


def parse_revision(record: Column | str) -> Column:
    """A struct of LINE's fields from one source API revision (JSON text).

    Text counts as hidden if its slot says so, if it is missing, or if the revision is suppressed; then it is empty. Hidden users
    and comments are null. `minor` is a value, false where absent. Flags count by being there.
    """
    c = F.col(record) if isinstance(record, str) else record
    v = F.try_parse_json(c)
    there = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).isNotNull(), F.lit(False))
    get = lambda path, kind="string": F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == ("STRING" if kind == "string" else "BOOLEAN" if kind == "boolean" else "BIGINT"), F.try_variant_get(v, path, kind))
    slot = F.schema_of_variant(F.try_variant_get(v, "$.slots.main.texthidden", "variant"))
    in_slot = F.coalesce((slot.isin("STRING", "VOID")) | F.coalesce(get("$.slots.main.texthidden", "boolean"), F.lit(False)), F.lit(False))
    hidden = in_slot | there("$.textmissing") | there("$.suppressed")
    body = F.coalesce(get("$.slots.main.content"), get("$.slots.main['*']"), get("$['*']"), F.lit(""))
    user, comment = ~there("$.userhidden"), ~(there("$.commenthidden") | there("$.suppressed"))
    return F.struct(
        get("$.revid", "long").alias("rev_id"), F.coalesce(get("$.parentid", "long"), F.lit(0).cast("long")).alias("parent_id"), get("$.timestamp").alias("timestamp"),
        get("$.sha1").alias("sha1"), F.when(comment, get("$.comment")).alias("comment"), F.coalesce(get("$.minor", "boolean"), F.lit(False)).alias("minor"),
        F.when(user, get("$.userid", "long")).alias("user_id"), F.when(user, get("$.user")).alias("user_name"),
        F.when(hidden, "").otherwise(body).alias("text"), hidden.alias("text_hidden"),
    )


def read_dump(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """History rows of an XML page dump; revisions in the dump's order."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(
        "id long, title string, ns int, revision array<struct<id: long, parentid: long, timestamp: string, sha1: string, comment: string, minor: string, "
        "contributor: struct<id: long, username: string, ip: string>, text: struct<_VALUE: string, _deleted: string>>>"
    ).load(path)
    rows = rows.filter(F.coalesce("ns", F.lit(0)) == 0).select(F.col("id").alias("page_id"), "title", F.posexplode("revision").alias("ord", "r"))
    user = F.col("r.contributor")
    return rows.select(
        F.lit(lang).alias("lang"), "page_id", "title", "ord", F.col("r.id").alias("rev_id"), F.coalesce("r.parentid", F.lit(0).cast("long")).alias("parent_id"), F.col("r.timestamp").alias("timestamp"),
        F.col("r.sha1").alias("sha1"), F.col("r.comment").alias("comment"), F.col("r.minor").isNotNull().alias("minor"),
        F.when(user["ip"].isNotNull(), F.lit(0).cast("long")).otherwise(user["id"]).alias("user_id"), F.coalesce(user["username"], user["ip"]).alias("user_name"),
        F.coalesce("r.text._VALUE", F.lit("")).alias("text"), F.col("r.text._deleted").isNotNull().alias("text_hidden"),
    )


# Attempts of a request, seconds before the second, seconds that waits told by the server may take altogether.
ATTEMPTS, FIRST_WAIT, WAIT_BUDGET = 5, 1.0, 300.0


def backoff(attempt: int, base: float = FIRST_WAIT) -> float:
    """Seconds to wait after the given attempt, from 1: doubled each time."""
    return base * 2 ** min(attempt - 1, 60)


def request(send: Callable[[dict], tuple[int, dict, str]], params: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer to `params`. `send` gives (status, headers, body). Too many requests: wait as told, within a budget;
    server errors: wait longer and longer; other errors end it."""
    waited, attempt = 0.0, 0
    while True:
        status, headers, text = send(params)
        if status == 200:
            return json.loads(text)
        if status == 429:
            pause = float(headers.get("Retry-After", FIRST_WAIT))
            if (waited := waited + pause) > WAIT_BUDGET:
                raise OSError(f"asked to wait for more than {WAIT_BUDGET:g} s")
            sleep(pause)
            continue
        attempt += 1
        if status < 500 or attempt >= ATTEMPTS:
            raise OSError(f"status {status}: {text[:300]}")
        sleep(backoff(attempt))


def http_sender(endpoint: str, agent: str) -> Callable[[dict], tuple[int, dict, str]]:
    def send(params: dict) -> tuple[int, dict, str]:
        asked, long = urllib.parse.urlencode(params), "text" in params  # a whole text is too long for an address
        ask = urllib.request.Request(endpoint if long else f"{endpoint}?{asked}", asked.encode() if long else None, {"User-Agent": agent})
        try:
            with urllib.request.urlopen(ask, timeout=60) as answer:
                return answer.status, dict(answer.headers), answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read().decode(errors="replace")

    return send


# Error codes of what the source doesn't have.
NOT_THERE = ("missingtitle", "nosuchrevid", "invalidpageid", "nosuchpageid")


def _rendered(send, params: dict, sleep) -> str:
    answer = request(send, {"action": "parse", "prop": "text", "format": "json", "formatversion": 2} | params, sleep)
    if error := answer.get("error"):
        raise (LookupError if error.get("code") in NOT_THERE else OSError)(f"{error.get('code')}: {error.get('info', '')}")
    text = answer.get("parse", {}).get("text")
    if not isinstance(text, str):
        raise OSError("the answer holds no text")
    return text


def render_text(send, title: str, text: str, sleep=time.sleep) -> str:
    """HTML of markup under a title, by the remote source; with `send` bound it is what `Service.colours` takes as `render`."""
    return _rendered(send, {"title": title, "text": text, "contentmodel": "wikitext"}, sleep)


def render_revision(send, rev_id: int, sleep=time.sleep) -> str:
    """HTML of a stored revision, by the remote source."""
    return _rendered(send, {"oldid": rev_id}, sleep)


def fetch_revisions(send, page_id: int, end_rev_id: int | None = None, start: str | None = None, sleep=time.sleep) -> Iterator[list[dict]]:
    """Batches of a page's revisions, oldest first, up to and with `end_rev_id`; `start` is a continuation to go on from.
    Without the end in it, a finished history is an error."""
    params = {"action": "query", "format": "json", "formatversion": 2, "prop": "revisions", "pageids": page_id, "rvdir": "newer", "rvlimit": 50, "rvslots": "main", "rvprop": "ids|timestamp|sha1|comment|flags|user|userid|content"}
    if end_rev_id:
        params["rvendid"] = end_rev_id
    go_on, seen = {"rvcontinue": start} if start else {}, end_rev_id is None
    while True:
        answer = request(send, params | go_on, sleep)
        batch = [r for p in answer.get("query", {}).get("pages", []) for r in p.get("revisions", [])]
        ends = [k for k, r in enumerate(batch) if r.get("revid") == end_rev_id]
        if ends:
            batch, seen = batch[: ends[0] + 1], True
        if batch:
            yield batch
        go_on = answer.get("continue") or {}
        if ends or not go_on:
            if not seen:
                raise LookupError(f"page {page_id}: revision {end_rev_id} isn't in its history")
            return


CAPTURED, SKIPPED, ABORTED, FAILED = "captured", "skipped", "aborted", "failed"
_FETCHED = pa.schema([("lang", pa.string()), ("page_id", pa.int64()), ("title", pa.string()), ("up_to", pa.int64()), ("ord", pa.int32()), ("record", pa.string()), ("outcome", pa.string()), ("detail", pa.string())])
_CAPTURE = "lang string, page_id long, title string, up_to long, outcome string, n_revisions long, detail string"


def captures(spark: SparkSession, root: str) -> DataFrame:
    """(lang, page_id, title, up_to, n_revisions, run) of the last capture of each page under `root`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/captures")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "lang string, page_id long, title string, up_to long, n_revisions long, run string")
    rows = spark.read.schema(f"{_CAPTURE}, run string").json(f"{root}/captures").filter(F.col("outcome") == CAPTURED)
    last = F.row_number().over(W.partitionBy("lang", "page_id").orderBy(F.desc("run")))
    return rows.withColumn("last", last).filter("last = 1").select("lang", "page_id", "title", "up_to", "n_revisions", "run")


def capture(targets: DataFrame, root: str, sender: Callable[[str], Callable], most: int | None = None, refresh: bool = False, tasks: int = 8, sleep=time.sleep) -> DataFrame:
    """Fetch the histories of (lang, page_id, title, rev_id), each up to its revision, and add them under `root` as JSON lines;
    (lang, page_id, title, up_to, outcome, n_revisions, detail) for each page. `sender` gives a language's source.

    Pages whose last capture ends at the revision are skipped, unless told to refresh. A page of over `most` revisions is
    aborted, and of it, or of one that fails, nothing is kept. The list of captures is written last: a run that is lost before leaves
    lines that no reader takes, and running again does what is missing. `tasks` bounds how many ask at once.
    """
    spark = targets.sparkSession
    asked = targets.select("lang", "page_id", "title", F.col("rev_id").alias("up_to")).groupBy("lang", "page_id").agg(F.max_by("title", "up_to").alias("title"), F.max("up_to").alias("up_to"))
    done = captures(spark, root).select("lang", "page_id", "up_to")
    todo = asked if refresh else asked.join(done, ["lang", "page_id", "up_to"], "left_anti")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_FETCHED.names, r)) for r in rows], _FETCHED)
        for page in (p for b in batches for p in b.to_pylist()):
            head = (page["lang"], page["page_id"], page["title"], page["up_to"])
            n, outcome, detail = 0, CAPTURED, None
            try:
                for part in fetch_revisions(sender(page["lang"]), page["page_id"], page["up_to"], sleep=sleep):
                    yield rows_of([(*head, n + k, json.dumps(r), None, None) for k, r in enumerate(part)])
                    n += len(part)
                    if most and n >= most and part[-1].get("revid") != page["up_to"]:
                        outcome, detail = ABORTED, f"{n} revisions and not at {page['up_to']}"
                        break
            except (OSError, LookupError, ValueError) as e:
                outcome, detail = FAILED, str(e)
            yield rows_of([(*head, n, None, outcome, detail)])

    schema = "lang string, page_id long, title string, up_to long, ord int, record string, outcome string, detail string"
    got = materialize(todo.repartition(tasks, "lang", "page_id").mapInArrow(fetch, schema), "capture")  # the source is asked once
    status = got.filter("outcome is not null").select("lang", "page_id", "title", "up_to", "outcome", F.col("ord").cast("long").alias("n_revisions"), "detail")
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    whole = status.filter(F.col("outcome") == CAPTURED).select("lang", "page_id")
    lines = got.filter("outcome is null").join(whole, ["lang", "page_id"], "left_semi").select("lang", "page_id", "ord", parse_revision("record").alias("r"))
    lines.select("lang", "page_id", "ord", "r.*").write.partitionBy("lang").json(f"{root}/revisions/run={run}")
    status.write.json(f"{root}/captures/run={run}")
    skipped = asked.join(done, ["lang", "page_id", "up_to"], "left_semi").join(todo, ["lang", "page_id"], "left_anti")
    skipped = skipped.select("lang", "page_id", "title", "up_to", F.lit(SKIPPED).alias("outcome"), F.lit(0).cast("long").alias("n_revisions"), F.lit(None).cast("string").alias("detail"))
    return materialize(status.unionByName(skipped), "capture-status")


def read_captured(spark: SparkSession, root: str) -> DataFrame:
    """History rows of the last capture of each page under `root`."""
    heads = captures(spark, root).select("lang", "page_id", "title", "run")
    if not heads.head(1):
        return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in HISTORY.items()))
    lines = spark.read.schema(f"page_id long, ord int, {LINE}, run string, lang string").json(f"{root}/revisions")
    return lines.join(heads, ["lang", "page_id", "run"]).select(*HISTORY)


class PageHistory(DataSource):
    """spark.read.format("page_history").option("endpoint", ...).option("pages", "1,2,3"): a partition for each page, raw records."""

    @classmethod
    def name(cls) -> str:
        return "page_history"

    def schema(self) -> str:
        return "page_id long, ord int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(int(p)) for p in self.options["pages"].split(",") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        send = http_sender(self.options["endpoint"], self.options.get("agent", "palimpsest"))
        end = self.options.get("end_rev_id")
        place = 0
        for batch in fetch_revisions(send, partition.value, int(end) if end else None, self.options.get("continue")):
            for r in batch:
                yield partition.value, place, json.dumps(r)
                place += 1


def lookup_pages(meta: DataFrame, asked: DataFrame, by: str, index: DataFrame | None = None) -> DataFrame:
    """(asked.*, page_id, title as the page has it, last_processed_revid) for asked titles ("title"), page ids ("page_id") or revisions ("rev_id")."""
    info = meta.select("lang", "page_id", "title", "last_processed_revid")
    if by == "rev_id":
        return asked.join(index.select("lang", "rev_id", "page_id"), ["lang", "rev_id"]).join(info, ["lang", "page_id"])
    if by == "title":
        from palimpsest.functions.text import title_key

        keyed = info.withColumn("key", title_key("title"))
        return asked.withColumn("key", title_key("title")).drop("title").join(keyed, ["lang", "key"]).drop("key")
    return asked.join(info, ["lang", "page_id"])


def lookup_users(users: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, user_name) of the asked accounts, each once; the unknown are left out."""
    return asked.select("user_id").distinct().join(users.filter("user_name is not null").select("user_id", "user_name"), "user_id")


def revision_text(history: DataFrame, lang: str, rev_id: int) -> DataFrame:
    return history.filter((F.col("lang") == lang) & (F.col("rev_id") == rev_id)).select("lang", "page_id", "rev_id", "text")
