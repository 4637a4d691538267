"""Work and memory that don't grow faster than the input: many small pages, batches, transcripts and markup of many rows."""

import pyarrow as pa

from palimpsest.operators import attribute as A
from palimpsest.operators import differ


def revisions(pages: int, at: range = range(3)) -> pa.RecordBatch:
    rows = [
        {"lang": "en", "page_id": p, "_of": {"title": f"T{p}", "ord": k, "rev_id": p * 10 + k, "timestamp": "", "sha1": None, "comment": None, "minor": False, "user_id": 1, "user_name": "a", "text": f"One two {p}. Three {'four' if k % 2 else 'five'} six."}}
        for p in range(pages) for k in at
    ]
    return pa.RecordBatch.from_pylist(rows)


def listed(batches) -> list:
    return sorted(pa.Table.from_batches(batches, A._SCHEMA).to_pylist(), key=repr)


def test_many_small_pages_leave_in_few_batches(monkeypatch):
    whole = revisions(300)
    out = list(A._fold([whole]))
    assert len(out) == 6 and sum(b.num_rows for b in out) == sum(len(listed(A._fold([whole.slice(3 * p, 3)]))) for p in range(300))
    cut = list(A._fold(whole.slice(i, 7) for i in range(0, whole.num_rows, 7)))
    assert listed(cut) == listed(out)
    monkeypatch.setattr(A, "MOST_HELD", 50)
    small = list(A._fold([whole]))
    assert len(small) > 100 and listed(small) == listed(out)


def test_a_stream_of_states_and_revisions_equals_one_pass():
    first = pa.Table.from_batches(A._fold([revisions(4, range(1))]), A._SCHEMA).to_pylist()
    later = revisions(3, range(1, 3)).to_pylist()
    rows = sorted((x | {"_of": None} for x in first), key=lambda x: x["page_id"])
    schema = A._SCHEMA.append(revisions(1).schema.field("_of"))
    mixed = [x for p in range(4) for x in [*(r for r in rows if r["page_id"] == p), *({k: None for k in A._SCHEMA.names} | r for r in later if r["page_id"] == p)]]
    batch = pa.RecordBatch.from_pylist(mixed, schema=schema)
    want = [x for x in listed(A._fold([revisions(4)])) if x["page_id"] < 3] + [x for x in first if x["page_id"] == 3]
    assert listed(A._fold(batch.slice(i, 5) for i in range(0, batch.num_rows, 5))) == sorted(want, key=repr)


def test_alike_values_are_found_a_block_at_a_time(monkeypatch):
    words = [f"word{i}s" for i in range(40)]
    monkeypatch.setattr(differ, "BLOCK", 7)
    found = differ.alike(words, [w.upper().lower() + "x" for w in words])
    assert all(differ.likeness(x, y + "") <= b + 1e-12 for y, xs in found.items() for x, b in xs)
    assert {(x, y) for y, xs in found.items() for x, _ in xs} >= {(x, w + "x") for w in words for x in words if differ.likeness(x, w + "x") > differ.LOOK}


def test_transcripts_and_markup_leave_in_parts(monkeypatch):
    from palimpsest.operators import annotate, transcripts

    monkeypatch.setattr(transcripts, "MOST_ENTRIES", 10)
    a = pa.array([["a", "b", "c", "d"], None, [], ["x", "y"]] * 5)
    b = pa.array([["a", "c", "d", "e"], ["n"], [], ["x", "z"]] * 5)
    out = list(transcripts.transcripts(iter([(a, b)])))
    got = [[(e["op"], e["value"]) for e in r] for x in out for r in x.to_pylist()]
    assert len(out) > 3 and max(len(x.flatten()) for x in out) < 20 and got == [differ.compare(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist())]
    monkeypatch.setattr(annotate, "MOST_LETTERS", 200)
    texts = pa.array(["alpha [[beta]] gamma", None, "", "delta"] * 5)
    tokens = [[{"str": w, "editor": str(len(w)), "class_name": "k"} for w in (t or "").replace("[", "").replace("]", "").split()] for t in texts.to_pylist()]
    tokens[1] = None
    kind = pa.list_(pa.struct([("str", pa.string()), ("editor", pa.string()), ("class_name", pa.string())]))
    parts = list(annotate.annotations(iter([(texts, pa.array(tokens, kind))])))
    want = [annotate.annotate(t or "", [tuple(x.values()) for x in ts or []]) for t, ts in zip(texts.to_pylist(), tokens)]
    assert len(parts) > 3 and [(r["text"], [tuple(e.values()) for e in r["editors"]]) for p in parts for r in p.to_pylist()] == want


def test_what_a_row_tells_alone_is_not_dealt_out(spark):
    from palimpsest.plans import queries

    for name in ("edit_diffs", "token_density"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan, name


def test_contents_of_pages_join_nothing(spark):
    """One row a page by one shuffle of its state: a join's side that looked small was broadcast through the driver."""
    from palimpsest.plans import queries

    df = queries.page_contents(spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() > 0
