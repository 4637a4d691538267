"""Sources, store, live changes, comparisons, annotation and serving, end to end on small histories."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import annotate
from palimpsest.operators.attribute import Tables, attribute
from palimpsest.plans import compare, histories, serving, views
from palimpsest.sources import changes, history, store
from palimpsest.streaming import apply

LINES = [
    {"rev_id": 11, "parent_id": 0, "timestamp": "2020-01-01T00:00:00Z", "sha1": None, "comment": "new", "minor": False, "user_id": 0, "user_name": "host", "text": "Hello world.\n\nSecond one.", "text_hidden": False},
    {"rev_id": 13, "parent_id": 11, "timestamp": "2020-01-02T00:00:00Z", "sha1": None, "comment": None, "minor": False, "user_id": 2, "user_name": "ann", "text": "Hello world.", "text_hidden": False},
    {"rev_id": 12, "parent_id": 13, "timestamp": "2020-01-03T00:00:00Z", "sha1": None, "comment": None, "minor": False, "user_id": None, "user_name": None, "text": "", "text_hidden": True},
    {"rev_id": 15, "parent_id": 12, "timestamp": "2020-01-04T00:00:00Z", "sha1": "x", "comment": None, "minor": True, "user_id": 3, "user_name": "bob", "text": "Hello big world.\n\nSecond one.", "text_hidden": False},
]


@pytest.fixture
def lines(spark, tmp_path):
    for lang, page in (("en", 7), ("de", 8)):
        d = tmp_path / lang / str(page) / "15"
        d.mkdir(parents=True)
        shift = 0 if page == 7 else 100
        (d / "history.jsonl").write_text("".join(json.dumps(x | {"rev_id": x["rev_id"] + shift}) + "\n" for x in LINES))
        (d / "meta.json").write_text(json.dumps({"lang": lang, "title": f"Page {page}", "page_id": page, "rev_id": 15}))
    return str(tmp_path)


def test_histories_from_files(spark, lines):
    rows = history.read_histories(spark, lines).orderBy("page_id", "ord").collect()
    assert [(r["lang"], r["rev_id"], r["ord"]) for r in rows[:4]] == [("en", 11, 0), ("en", 13, 1), ("en", 12, 2), ("en", 15, 3)] and len(rows) == 8
    assert history.read_histories(spark, lines, ["en/7"]).count() == 4 and history.read_histories(spark, lines, ["de"]).count() == 4


def test_store_resume_and_serving(spark, lines, tmp_path):
    rows = history.read_histories(spark, lines)
    kept = store.Store(spark, f"{tmp_path}/store")
    assert kept.index.count() == 0 and kept.pages().count() == 0
    kept.write(attribute(rows.filter("ord < 2")))
    assert {(r["rev_id"], r["page_id"]) for r in kept.index.collect()} == {(11, 7), (13, 7), (111, 8), (113, 8)}
    first = sorted(map(str, kept.pages([("de", 8)]).collect()))
    events = spark.createDataFrame([("en", 7, 15), ("en", 7, 14), ("en", 99, 1), ("de", 8, 113)], "language string, page_id long, rev_id long")
    done = {(r["lang"], r["page_id"]): (r["outcome"], r["applied"]) for r in apply.apply_batch(kept, events, rows).collect()}
    assert done == {("en", 7): (apply.APPLIED, 1), ("en", 99): (apply.MISSING, 0), ("de", 8): (apply.BEHIND, 0)}
    whole = attribute(rows.filter("lang = 'en'"))
    assert sorted(map(str, kept.pages([("en", 7)]).collect())) == sorted(map(str, whole.collect()))
    assert sorted(map(str, kept.pages([("de", 8)]).collect())) == first
    assert [(r["lang"], r["articles"], r["entries"]) for r in kept.rebuild_index().orderBy("lang").collect()] == [("de", 1, 2), ("en", 1, 3)]
    assert [r["lang"] for r in kept.languages().collect()] == ["de", "en"] and store.out_of_order(kept.index).count() == 0
    sizes = {r["part"]: (r["files"], r["bytes"]) for r in kept.file_sizes().collect()}
    assert set(sizes) == {"index", "state", "meta"} and all(n > 0 and b > 0 for n, b in sizes.values())
    assert [r["path"] for r in kept.paths().filter("lang = 'en'").collect()] == ["en/0/0/7"]

    service = serving.Service(kept, spark.createDataFrame([(2, "ann"), (3, "bob")], "user_id long, user_name string"), rows)
    body = service.rev_content("en", rev_id=15, fields=serving.parameters({"o_rev_id": "true", "in": "true", "out": "1"})).body
    assert list(body) == ["article_title", "page_id", "success", "message", "revisions"] and body["page_id"] == 7
    tokens = body["revisions"][0]["15"]["tokens"]
    assert [t["str"] for t in tokens] == ["hello", "big", "world", ".", "second", "one", "."] and tokens[1] == {"str": "big", "o_rev_id": 15, "in": []} and tokens[4]["in"] == [15]
    assert service.rev_content("en", title="Page 7").body["revisions"][0].keys() == {"15"} and service.rev_content("en", page_id=7, rev_id=11, end_rev_id=15).body["revisions"][1].keys() == {"13"}
    assert service.rev_content("en", rev_id=12).body == {"Error": "Revision ID (12) does not exist or is spam or deleted!"} and service.rev_content("en", title="None").status == 408
    colours = service.colours("en", "Page_7", now=1_600_000_000).body
    assert list(colours) == ["extended_html", "present_editors", "tokens", "revisions", "biggest_conflict_score", "success", "rev_id", "page_title"]
    assert colours["revisions"]["13"] == ["2020-01-02T00:00:00Z", 11, "2", "ann"] and colours["tokens"][1][:3] == [0, "big", 15] and colours["biggest_conflict_score"] == 1
    assert colours["present_editors"][0][0] == "0|host" and abs(sum(e[2] for e in colours["present_editors"]) - 100) < 1e-9 and "token-editor-3" in colours["extended_html"]
    assert service.colours("en", "Page 7", 0, rev_id=12).body["success"] is False
    assert serving.replay(rows, 2).inputs.count() == 4


def test_collisions_are_errors(spark):
    index = spark.createDataFrame([("en", 1, 1), ("en", 2, 1)], "lang string, rev_id long, page_id long")
    with pytest.raises(store.IndexCollision):
        store.replace_entries(index, spark.createDataFrame([("en", 2, 5)], "lang string, rev_id long, page_id long"))
    moved = store.replace_entries(index, spark.createDataFrame([("en", 9, 1)], "lang string, rev_id long, page_id long"))
    assert [r["rev_id"] for r in moved.collect()] == [9]


RECORDS = [
    ({"revid": 1, "timestamp": "t", "user": "a", "userid": 5, "comment": "c", "minor": True, "slots": {"main": {"content": "x"}}}, (1, 0, "x", False, 5, "a", "c", True)),
    ({"revid": 2, "parentid": 1, "timestamp": "t", "userhidden": "", "user": "a", "userid": 5, "commenthidden": True, "comment": "c", "slots": {"main": {"*": "y"}}}, (2, 1, "y", False, None, None, None, False)),
    ({"revid": 3, "timestamp": "t", "slots": {"main": {"texthidden": True, "content": "z"}}}, (3, 0, "", True, None, None, None, False)),
    ({"revid": 4, "timestamp": "t", "slots": {"main": {"texthidden": False}}, "*": "w"}, (4, 0, "w", False, None, None, None, False)),
    ({"revid": 5, "timestamp": "t", "suppressed": "", "comment": "c", "slots": {"main": {"content": "z"}}}, (5, 0, "", True, None, None, None, False)),
    ({"revid": 6, "timestamp": "t", "textmissing": True, "minor": False, "slots": {"main": {"texthidden": "", "content": "z"}}}, (6, 0, "", True, None, None, None, False)),
]


def test_source_records(spark):
    df = spark.createDataFrame([(json.dumps(r),) for r, _ in RECORDS], "r string").select(history.parse_revision("r").alias("r")).select("r.*")
    got = {r["rev_id"]: (r["rev_id"], r["parent_id"], r["text"], r["text_hidden"], r["user_id"], r["user_name"], r["comment"], r["minor"]) for r in df.collect()}
    for _, want in RECORDS:
        assert got[want[0]] == want


def test_paged_fetch_and_retries():
    pages = {None: ([1, 2], "p2"), "p2": ([3, 4], "p3"), "p3": ([5], None)}

    def send(params):
        ids, go_on = pages[params.get("rvcontinue")]
        return 200, {}, json.dumps({"query": {"pages": [{"revisions": [{"revid": i} for i in ids]}]}} | ({"continue": {"rvcontinue": go_on}} if go_on else {}))

    ids = lambda *a: [r["revid"] for b in history.fetch_revisions(send, 1, *a) for r in b]
    assert ids() == [1, 2, 3, 4, 5] and ids(3) == [1, 2, 3] and ids(5, "p2") == [3, 4, 5]
    with pytest.raises(LookupError):
        ids(99)
    waits, answers = [], [(429, {"Retry-After": "7"}, ""), (500, {}, ""), (503, {}, ""), (200, {}, "{}")]
    assert history.request(lambda p: answers.pop(0), {}, waits.append) == {} and waits == [7.0, 1.0, 2.0]
    with pytest.raises(OSError):
        history.request(lambda p: (404, {}, "no"), {}, waits.append)
    with pytest.raises(OSError):
        history.request(lambda p: (429, {"Retry-After": "200"}, ""), {}, waits.append)


def test_frames():
    f = changes.Frames()
    assert f.feed("id: 1\nda") == [] and f.feed("ta: a\ndata:b\n\nid: 2\n\ndata: c\r\n\r\n") == [("a\nb", "1"), ("c", None)]


def test_change_filter(spark):
    ok = {"type": "edit", "namespace": 0, "wiki": "enwiki", "server_name": "en.x.org", "title": "T", "page_id": 5, "revision": {"new": 9, "old": 8}}
    frames = [ok, ok | {"type": "log"}, ok | {"namespace": 1}, ok | {"wiki": "frwiki"}, ok | {"page_id": 0}, ok | {"page_id": None, "id": 6}, ok | {"server_name": ""}, ok | {"revision": {"old": 1}}, ok | {"title": None}, ok | {"revision": {"new": 7}, "type": "new"}]
    raw = spark.createDataFrame([(json.dumps(x),) for x in frames] + [("{broken",), (None,)], "value string")
    got = sorted((r["page_id"], r["rev_id"], r["parent_rev_id"], r["language"]) for r in changes.page_edits(raw, languages=["en"]).collect())
    assert got == [(5, 7, 0, "en"), (5, 9, 8, "en"), (6, 9, 8, "en")]


SPAN = '<span class="editor-token token-editor-{}" id="token-{}">{}</span>'


def test_annotation():
    text, editors = annotate.annotate("hello world", [("hello", "42", "42"), ("world", "42", "42")])
    assert text == SPAN.format(42, 0, "hello") + SPAN.format(42, 1, " world") and editors == [("42", "42", 2)]
    text, _ = annotate.annotate("hello {{cite|args}} world", [("hello", "42", "42"), ("cite", "9", "9"), ("args", "9", "9"), ("world", "42", "42")])
    assert "editor" not in text[text.index("{{") : text.index("}}")] and text.endswith("> world</span>")
    text, _ = annotate.annotate("see [[foo]] end", [("see", "1", "1"), ("foo", "9", "9"), ("end", "1", "1")])
    assert ">see</span>" in text and "> end</span>" in text and "token-editor-9" not in text[text.index("[[") : text.index("]]")]
    assert annotate.annotate("", []) == ("", []) and "\n" in annotate.annotate("a\nb", [("a", "1", "1"), ("b", "1", "1")])[0]
    nested = annotate.annotate("{{Infobox |a = {{nest |[[L1]] |[[L2]]}}|b = end}}", [(t, "1", "1") for t in ("infobox", "a", "nest", "l1", "l2", "b", "end")])[0]
    assert "<span" not in nested
    _, editors = annotate.annotate("alpha beta gamma delta epsilon", [("alpha", "1", "1"), ("beta", "2", "2"), ("gamma", "1", "1"), ("delta", "3", "3"), ("epsilon", "2", "2")])
    assert [(e, n) for e, _, n in editors] == [("1", 2), ("2", 2), ("3", 1)]
    assert annotate.annotate("Foo İ bar", [("foo", "1", "1"), ("baz", "1", "1"), ("bar", "1", '"x')])[0].endswith('token-editor-&quot;x" id="token-2"> İ bar</span>')
    assert annotate.Folded("aİb").end("b", 0) == 3 and annotate.Folded("ΑΣ x").end("ας", 0) == 2


def test_growing_history_meets_what_its_closed_form_needs(spark):
    rows = histories.growing(spark, "/root/testdata/sf0.001")
    tables = Tables(attribute(rows))
    assert tables.inputs.filter("status <> 'stored'").count() == 0
    from palimpsest.functions import text as X

    assert tables.revisions.count() == rows.count() and views.orphans(tables).count() == 0
    turns = histories.turns(spark, "/root/testdata/sf0.001").select("page_id", F.explode(X.paragraph_texts(F.lower("text"))).alias("p"))
    assert turns.groupBy("page_id", "p").count().filter("count > 1").count() == 0


def test_comparisons(spark):
    schema = "lang string, page_id long, rev_id long, pos int, str string, o_rev_id long, inbound array<long>, outbound array<long>"
    got = spark.createDataFrame([("en", 1, 1, 0, "a", 1, [2], []), ("en", 1, 1, 1, "b", 1, [], [3])], schema)
    want = spark.createDataFrame([("en", 1, 1, 0, "a", None, [2], []), ("en", 1, 1, 1, "c", 2, [], [4]), ("en", 1, 1, 2, "d", 2, [], [])], schema)
    r = compare.tally(got, want).first()
    assert (r["n_expected"], r["n_got"], r["str_match"], r["o_rev_id_match"], r["in_match"], r["out_match"], r["all_match"], r["passes"]) == (3, 2, 1, 1, 2, 1, 1, False)
    assert compare.tally(got, got).first()["passes"] and compare.rates(compare.tally(got, got)).first()["all_rate"] == 1.0
    d = compare.field_differences(got, want, 5).first()
    assert (d["pos"], d["out_only_got"], d["out_only_expected"]) == (1, [3], [4])
    assert [tuple(r) for r in compare.mention_histogram(got, want, 5).collect()] == [(3, 1, 0, 1), (4, 0, 1, 1)]


def test_html_annotation():
    from palimpsest.operators.annotate_html import annotate_html

    span = lambda k, e, t: SPAN.format(e, k, t)
    assert annotate_html("<p>Hello <b>world</b></p>", [("hello", "1", "1"), ("world", "2", "2")]) == (f"<p>{span(0, 1, 'Hello')} <b>{span(1, 2, 'world')}</b></p>", [("1", "1", 1), ("2", "2", 1)])
    html, editors = annotate_html("<!DOCTYPE html><script>var x = 'hello';</script><p class=\"a&quot;\">Hello<br/>wor<i>ld</i> &lt;b&gt; 中国&nbsp;x</p><!--c-->", [("[[", "1", "1"), ("hello", "1", "1"), ("world", "1", "1"), ("<b>", "2", "2"), ("中国", "2", "2"), ("zz", "3", "3")])
    assert html == "<!DOCTYPE html><script>var x = 'hello';</script><p class=\"a&quot;\">" + span(0, 1, "Hello") + "<br>" + span(1, 1, "wor") + "<i>ld</i> " + span(2, 2, "&lt;b&gt;") + " " + span(3, 2, "中国") + "&nbsp;x</p><!--c-->"
    assert editors == [("1", "1", 2), ("2", "2", 2)]
    assert [n for _, _, n in annotate_html("<p>a b c d a a b</p>", [(x, e, e) for x, e in zip("abcdaab", "1234112")])[1]] == [3, 2, 1, 1]


def test_whole_index_is_asked_and_claimed(spark):
    duckdb = pytest.importorskip("duckdb")
    from palimpsest.plans.registry import ORACLES, QUERIES

    d = "/root/testdata/sf0.01"
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(*c).collect()]
    index = {c * 100 + t + 1: c for c, t in read("conversations", "conv_id", "turn")}
    claims = {}
    for order, supplier in read("lineitem", "l_orderkey", "l_suppkey"):
        claims.setdefault(order, set()).add(supplier)
    want = {
        "index_lookup": sorted((k, 1, index.get(k, -1)) for (k,) in read("orders", "o_orderkey")),
        "index_collisions": sorted((k, len(v)) for k, v in claims.items() if len(v) > 1),
    }
    assert len({p for _, _, p in want["index_lookup"]}) > 6
    con = duckdb.connect()
    for t in ("orders", "lineitem", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, rows in want.items():
        assert sorted(map(tuple, QUERIES[name](spark, d).collect())) == rows == sorted(con.execute(ORACLES[name]).fetchall())


def test_store_generations(spark, tmp_path, monkeypatch):
    line = lambda page, k, text: ("en", page, f"Page {page}", k, page * 10 + k, f"2020-01-0{k + 1}T00:00:00Z", 1, "u", text)
    schema = "lang string, page_id long, title string, ord int, rev_id long, timestamp string, user_id long, user_name string, text string"
    of = lambda *rows: attribute(spark.createDataFrame(rows, schema))
    kept = store.Store(spark, f"file://{tmp_path}/store")
    assert kept.manifest().gens == () and kept.meta.count() == 0 and kept.page_of_title("en", "Page 1") is None and kept.vacuum() == 0
    kept.write(of(line(1, 0, "one two."), line(1, 1, "one two three."), line(2, 0, "x y."), line(1500, 0, "far away.")))
    values = lambda: {r["page_id"]: r["n"] for r in kept.tables().tokens.groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert values() == {1: 4, 2: 3, 1500: 3}
    later = [line(1, 0, "one two."), line(1, 1, "one two three."), line(1, 2, "one two three four.")]

    def lost(*a):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(kept, "_publish", lost)
        kept.write(of(*later))
    assert values() == {1: 4, 2: 3, 1500: 3} and kept.index.count() == 4 and store.Store(spark, kept.root).page_of_revision("en", 12) is None
    before = kept.manifest()
    kept.write(of(*later))
    with pytest.raises(store.Conflict):
        kept._publish(before, [], 9)
    assert values() == {1: 5, 2: 3, 1500: 3} and sorted(r["rev_id"] for r in kept.index.collect()) == [10, 11, 12, 20, 15000]
    assert [kept.page_of_revision("en", r) for r in (10, 12, 15000, 13)] == [1, 1, 1500, None] and kept.page_of_title("en", "Page_1500") == 1500
    kept.write(of(line(2, 5, "moved text.")))  # a page that lost its revision 20
    assert kept.page_of_revision("en", 20) is None and kept.page_of_revision("en", 25) == 2 and kept.revision("en", 25).count() == 1
    with pytest.raises(store.IndexCollision):
        kept.write(of(("en", 3, "Three", 0, 12, "2020-01-01T00:00:00Z", 1, "u", "taken id.")))
    assert [r["rev_id"] for r in kept.revisions_in_order("en").collect()] == [10, 11, 12, 25, 15000] and kept.pages([("en", 3)]).count() == 0
    state = {tuple(map(str, r)) for r in kept.pages().collect()}
    assert [tuple(r) for r in kept.rebuild_index().collect()] == [("en", 3, 5)] and kept.manifest().index != "index" and kept.page_of_revision("en", 12) == 1
    assert kept.compact() == 3 and len(kept.manifest().gens) == 1 and {tuple(map(str, r)) for r in kept.pages().collect()} == state and kept.compact() == 0
    assert kept.index.count() == 5 and kept.vacuum() > 3 and {tuple(map(str, r)) for r in kept.pages().collect()} == state and kept.page_of_revision("en", 25) == 2
    kept.write(of(line(7, 0, "small page.")))
    assert len(kept.manifest().gens) == 2 and kept.compact(factor=1) == 0 and kept.compact(factor=4) == 2
    assert {r["part"] for r in kept.file_sizes().filter("ratio > 0 and files > 0").collect()} == {"state", "index", "meta"}
    monkeypatch.setattr(store, "VERSION", 0)
    with pytest.raises(ValueError):
        kept.pages([("en", 7)])


def test_a_page_is_read_from_its_partitions_alone(spark, tmp_path):
    rows = [("en", p, f"Page {p}", 0, p, "2020-01-01T00:00:00Z", 1, "u", "a b.") for p in range(0, 5000, 500)]
    kept = store.Store(spark, f"{tmp_path}/store")
    kept.write(attribute(spark.createDataFrame(rows, "lang string, page_id long, title string, ord int, rev_id long, timestamp string, user_id long, user_name string, text string")))
    one = kept.pages([("en", 2500)])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(page_id,2500)" in plan
    assert len(one.inputFiles()) > 1 and one.select(F.input_file_name().alias("f")).distinct().count() == 1
