"""Remote sources against a small server, dumps, captures, visibility changes, and codes of bytes."""

import http.server
import json
import threading
import urllib.parse
import zlib

import pytest

from palimpsest.functions import text as X
from palimpsest.operators.attribute import Tables, attribute
from palimpsest.operators.differ import interned
from palimpsest.plans import serving, views
from palimpsest.sources import changes, history, store
from palimpsest.streaming import apply


def revision(n, text=None, **more):
    return {"revid": n, "parentid": n - 1, "timestamp": f"2020-01-{n:02d}T00:00:00Z", "user": "ann", "userid": 2, "slots": {"main": {"content": text or f"Word {n}.\n\nEnd."}}} | more


@pytest.fixture
def endpoint():
    """Pages 1 and 2 of five revisions each, two a batch, at /api; three change frames at /stream, after the id that is told."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body, kind="application/json"):
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def api(self, params):
            asked.append(params)
            if params["action"] == "parse":
                if params.get("oldid") == "404":
                    return self.answer(json.dumps({"error": {"code": "nosuchrevid", "info": "none"}}))
                return self.answer(json.dumps({"parse": {"text": f"<p>{params.get('text') or params['oldid']}</p>"}}))
            first = int(params.get("rvcontinue", 1))
            page = [] if params["pageids"] == "3" else [{"revisions": [revision(n) for n in range(first, min(first + 2, 6))]}]
            go_on = {"continue": {"rvcontinue": str(first + 2)}} if page and first + 2 <= 5 else {}
            self.answer(json.dumps({"query": {"pages": page}} | go_on))

        def do_GET(self):
            if self.path.startswith("/stream"):
                last = int(self.headers.get("Last-Event-ID") or 0)
                return self.answer("".join(f"id: {n}\ndata: {{\"n\": {n}}}\n\n" for n in range(last + 1, 4)), "text/event-stream")
            self.api(dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query)))

        def do_POST(self):
            self.api(dict(urllib.parse.parse_qsl(self.rfile.read(int(self.headers["Content-Length"])).decode())))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_change_stream_goes_on_after_its_offset(endpoint):
    reader = changes._ChangeReader({"url": f"{endpoint[0]}/stream", "maxEvents": "2"})
    rows, offset = reader.read(reader.initialOffset())
    assert list(rows) == [('{"n": 1}', "1"), ('{"n": 2}', "2")] and offset == {"id": "2"}
    rows, offset = reader.read(offset)
    assert list(rows) == [('{"n": 3}', "3")] and offset == {"id": "3"}
    assert list(reader.readBetweenOffsets({"id": "1"}, {"id": "2"})) == [('{"n": 2}', "2")]
    rows, offset = reader.read({"id": "3"})
    assert list(rows) == [] and offset == {"id": "3"}


def test_page_history_source(spark, endpoint):
    spark.dataSource.register(history.PageHistory)
    rows = spark.read.format("page_history").option("endpoint", f"{endpoint[0]}/api").option("pages", "1,2").option("end_rev_id", "4").load()
    got = rows.select("page_id", "ord", history.parse_revision("record").alias("r")).select("page_id", "ord", "r.rev_id", "r.text").collect()
    assert sorted((r["page_id"], r["ord"], r["rev_id"]) for r in got) == [(p, n, n + 1) for p in (1, 2) for n in range(4)]
    assert {r["text"] for r in got if r["ord"] == 0} == {"Word 1.\n\nEnd."}


def test_remote_rendering(endpoint):
    send = history.http_sender(f"{endpoint[0]}/api", "test")
    assert history.render_text(send, "T", "a b & ü" * 2000) == f"<p>{'a b & ü' * 2000}</p>" and history.render_revision(send, 7) == "<p>7</p>"
    with pytest.raises(LookupError):
        history.render_revision(send, 404)
    with pytest.raises(OSError):
        history.render_revision(lambda p: (200, {}, "{}"), 1)
    assert endpoint[1][0]["contentmodel"] == "wikitext" and endpoint[1][1]["oldid"] == "7"


def test_capture(spark, endpoint, tmp_path):
    url, root = endpoint[0], f"{tmp_path}/captured"
    sender = lambda lang: history.http_sender(f"{url}/api", lang)
    targets = spark.createDataFrame([("en", 1, "One", 4), ("en", 2, "Two", 5), ("de", 3, "None", 1)], "lang string, page_id long, title string, rev_id long")
    told = lambda rows: sorted((r["page_id"], r["outcome"], r["n_revisions"]) for r in rows.collect())
    assert history.read_captured(spark, root).count() == 0
    assert told(history.capture(targets, root, sender, most=4)) == [(1, "captured", 4), (2, "aborted", 4), (3, "failed", 0)]
    rows = history.read_captured(spark, root)
    assert [(r["lang"], r["page_id"], r["title"], r["ord"], r["rev_id"]) for r in rows.orderBy("ord").collect()] == [("en", 1, "One", n, n + 1) for n in range(4)]
    before = len(endpoint[1])
    assert told(history.capture(targets.filter("lang = 'en'"), root, sender)) == [(1, "skipped", 0), (2, "captured", 5)]
    assert {a["pageids"] for a in endpoint[1][before:]} == {"2"}
    assert told(history.capture(targets.filter("page_id = 1"), root, sender, refresh=True)) == [(1, "captured", 4)]
    rows = history.read_captured(spark, root)
    assert rows.count() == 9 and rows.schema.names == list(history.HISTORY)
    spark.createDataFrame([(1, 9, 9)], "page_id long, ord int, rev_id long").write.json(f"{root}/revisions/run=lost/lang=en")  # a run that was lost before its list
    assert history.read_captured(spark, root).count() == 9
    assert Tables(attribute(history.read_captured(spark, root))).inputs.filter("status = 'stored'").count() == 9


def test_dump(spark, tmp_path):
    rev = lambda n, who, text: f"<revision><id>{n}</id><parentid>{n - 1}</parentid><timestamp>2020-01-0{n}T00:00:00Z</timestamp><contributor>{who}</contributor>{'<minor/>' if n == 2 else ''}<comment>c{n}</comment>{text}<sha1>s{n}</sha1></revision>"
    named, host = "<username>ann</username><id>5</id>", "<ip>1.2.3.4</ip>"
    page = lambda i, ns, *revs: f"<page><title>P {i}</title><ns>{ns}</ns><id>{i}</id>{''.join(revs)}</page>"
    (tmp_path / "d.xml").write_text("<dump>" + page(1, 0, rev(1, named, "<text bytes='1'>Hello &amp; you</text>"), rev(2, host, "<text bytes='2'>Bye</text>"), rev(3, named, '<text deleted="deleted" />')) + page(2, 1, rev(1, named, "<text bytes='1'>x</text>")) + "</dump>")
    got = history.read_dump(spark, f"{tmp_path}/d.xml", "en").orderBy("ord").collect()
    assert [(r["page_id"], r["title"], r["ord"], r["rev_id"], r["user_id"], r["user_name"], r["minor"], r["text"], r["text_hidden"]) for r in got] == [
        (1, "P 1", 0, 1, 5, "ann", False, "Hello & you", False), (1, "P 1", 1, 2, 0, "1.2.3.4", True, "Bye", False), (1, "P 1", 2, 3, 5, "ann", False, "", True),
    ]


def test_lookups(spark):
    meta = spark.createDataFrame([("en", 1, "A b", 9), ("en", 2, "C", 8), ("de", 1, "A b", 7)], "lang string, page_id long, title string, last_processed_revid long")
    ask = lambda rows, schema, by, index=None: sorted((r["lang"], r["page_id"], r["title"]) for r in history.lookup_pages(meta, spark.createDataFrame(rows, schema), by, index).collect())
    assert ask([("en", "A_b"), ("en", "none")], "lang string, title string", "title") == [("en", 1, "A b")]
    assert ask([("de", 1), ("de", 2)], "lang string, page_id long", "page_id") == [("de", 1, "A b")]
    index = spark.createDataFrame([("en", 8, 2)], "lang string, rev_id long, page_id long")
    assert ask([("en", 8), ("en", 7)], "lang string, rev_id long", "rev_id", index) == [("en", 2, "C")]
    users = spark.createDataFrame([(1, "a"), (2, None)], "user_id long, user_name string")
    assert [tuple(r) for r in history.lookup_users(users, spark.createDataFrame([(1,), (1,), (2,), (3,)], "user_id long")).collect()] == [(1, "a")]


def lines(spark, *rows):
    more = [("en", 1, "T", k, n, 0, f"2020-01-0{k + 1}T00:00:00Z", None, None, False, n, f"u{n}", text, hidden) for k, (n, text, hidden) in enumerate(rows)]
    return spark.createDataFrame(more, ", ".join(f"{k} {v}" for k, v in history.HISTORY.items()))


def test_visibility_changes_fold_a_page_anew(spark, tmp_path):
    frame = {"meta": {"domain": "en.x.org"}, "page_namespace": 0, "page_id": 1, "rev_id": 2, "visibility": {"text": False, "user": True}}
    frames = [frame, frame | {"page_namespace": 1}, frame | {"rev_id": None}, frame | {"page_id": 0}, frame | {"meta": None}, frame | {"page_id": 77, "visibility": None}]
    found = changes.visibility_changes(spark.createDataFrame([(json.dumps(f),) for f in frames] + [("{",), (None,)], "value string"))
    assert sorted(tuple(r) for r in found.collect()) == [("en", 1, 2, False, True, True), ("en", 77, 2, True, True, True)]

    kept = store.Store(spark, f"{tmp_path}/store")
    kept.write(attribute(lines(spark, (1, "One.", False), (2, "One. Two.", False), (3, "One. Two. Three.", False))))
    now = lines(spark, (1, "One.", False), (2, "", True), (3, "One. Two. Three.", False), (4, "One. Two. Three. Four.", False))
    assert [tuple(r) for r in apply.refold(kept, found, now).collect()] == [("en", 1)]
    origins = {r["value"]: r["origin_rev_id"] for r in kept.tables().tokens.collect()}
    assert origins["one"] == 1 and origins["two"] == 3 and origins["three"] == 3 and "four" not in origins
    want = attribute(now.filter("ord < 3"))
    assert sorted(map(str, kept.pages().collect())) == sorted(map(str, want.collect()))

    strings = views.strings(kept.tables()).orderBy("string_id").collect()
    tokens = kept.tables().tokens.orderBy("token_id").collect()
    assert [s["value"] for s in strings] == list(dict.fromkeys(t["value"] for t in tokens)) and sum(s["n_tokens"] for s in strings) == len(tokens)
    assert serving.Service(kept).health() == serving.Answer(200, {"status": "ok", "version": store.VERSION, "storage_root": f"{tmp_path}/store"})
    assert [r["rev_id"] for r in kept.revisions_in_order("en").collect()] == [1, 3] and kept.revision("en", 3).count() == 1 and kept.revision("en", 2).count() == 0


def test_variable_length_numbers_and_sealed_bytes(spark):
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**56 - 1, 2**56, 2**63 - 1, -1, -(2**63), None]

    def code(v):
        out, v = bytearray(), v % 2**64
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v])

    df = spark.createDataFrame([(v,) for v in numbers], "v long")
    for r in df.select("v", X.varint("v").alias("c"), X.unvarint(X.varint("v")).alias("back"), X.sealed(X.varint("v"), b"MARK").alias("s")).collect():
        assert r["back"] == r["v"] and (r["c"] and bytes(r["c"])) == (None if r["v"] is None else code(r["v"]))
        if r["v"] is not None:
            head = b"MARK" + code(r["v"])
            assert bytes(r["s"]) == head + zlib.crc32(head).to_bytes(4, "big") + b"MARK"
    bad = [b"", b"\x80", b"\x01\x01", b"\xff" * 9 + b"\x02", b"\xff" * 11]
    assert all(r[0] is None for r in spark.createDataFrame([(b,) for b in bad], "b binary").select(X.unvarint("b")).collect())
    body = b"some bytes"
    whole = b"MK" + body + zlib.crc32(b"MK" + body).to_bytes(4, "big") + b"MK"
    cases = [(whole, body), (whole[:-1] + b"X", None), (b"X" + whole[1:], None), (whole.replace(b"some", b"sAme"), None), (b"", None), (whole[:7], None)]
    assert [r[0] and bytes(r[0]) for r in spark.createDataFrame([(c,) for c, _ in cases], "b binary").select(X.opened("b", b"MK")).collect()] == [w for _, w in cases]
    spark.createDataFrame([(b"",)], "b binary").select(X.opened(X.sealed("b"))).first()[0] == b""


def test_interning():
    assert interned(["a", "b", "a"], ["c", "b"]) == [[0, 1, 0], [2, 1]] and interned([], []) == [[], []]
