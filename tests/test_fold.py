"""Diff and fold: fixed expectations, differential tests, invariants, resuming."""

import difflib
import random
import sys

import pytest

from palimpsest.functions import plain
from palimpsest.operators import differ
from palimpsest.operators.attribute import Tables, attribute, resume
from palimpsest.operators.fold import DENSE, KNOWN_HASH, SHRUNK, STORED, Page
from palimpsest.plans import views


def words(page, rev):
    return [page.tokens[t].value for t in page.revisions[rev].token_ids()]


def find(page, value):
    return [t for t in page.tokens if t.value == value]


VOCAB = ["alpha", "alphb", "beta", "betas", "gamma", "x", "y", "xy", "yx", "hello", "hallo", "word", "words", "the", "thee", "a" * 210, "a" * 209 + "b"]


@pytest.mark.skipif(sys.version_info[:2] != (3, 13), reason="compared with this version's library")
def test_diff_is_that_of_the_library():
    random.seed(11)
    for k in range(800):
        n = random.choice([0, 1, 5, 20, 60, 260])
        a = [random.choice(VOCAB) for _ in range(random.randrange(n + 1))]
        b = list(a) if k % 2 else [random.choice(VOCAB) for _ in range(random.randrange(n + 1))]
        for _ in range(random.randrange(6)):
            if b:
                b[random.randrange(len(b))] = random.choice(VOCAB) + random.choice(["", "s", "q"])
        want = [({" ": "keep", "-": "delete", "+": "insert"}[x[0]], x[2:]) for x in difflib.Differ().compare(a, b) if x[0] != "?"]
        assert differ.compare(a, b) == want


def test_transcripts_rebuild_both_sides():
    random.seed(2)
    for _ in range(300):
        a, b = ([random.choice("abcde") for _ in range(random.randrange(15))] for _ in range(2))
        t = differ.compare(a, b)
        assert [v for w, v in t if w != "insert"] == a and [v for w, v in t if w != "delete"] == b
        s = differ.shortest_script(a, b)
        assert [a[i] if i >= 0 else b[j] for w, i, j in s if w != "delete"] == b and [a[i] for w, i, j in s if w != "insert"] == a
        common = len(a) + len(b) - sum(w != "keep" for w, *_ in s)
        assert common >= 2 * sum(m[2] for m in differ.matching_blocks(a, b))


def test_long_replaced_stretches_do_not_recurse():
    a, b = [f"tok{i}a" for i in range(0, 1500, 5)], [f"tok{i}b" for i in range(0, 1500, 5)]
    assert len(differ.compare(a, b)) == 600


def test_replaced_word():
    p = Page()
    p.apply(100, "The quick brown fox jumps")
    p.apply(101, "The slow brown fox jumps")
    assert len(p.tokens) == 6 and find(p, "quick")[0].removed == [101] and find(p, "slow")[0].origin == 101


def test_removed_word():
    p = Page()
    p.apply(100, "alpha beta gamma delta")
    p.apply(101, "alpha gamma delta")
    assert len(p.tokens) == 4 and find(p, "beta")[0].removed == [101] and p.seen_last[p.tokens.index(find(p, "alpha")[0])] == 101


def test_paragraph_out_and_back():
    p = Page()
    p.apply(100, "first one here\n\nsecond one there")
    p.apply(101, "first one here")
    p.apply(102, "first one here\n\nsecond one there")
    t = find(p, "second")
    assert len(t) == 1 and t[0].removed == [101] and t[0].restored == [102] and p.seen_last[p.tokens.index(t[0])] == 102


def test_repeated_paragraphs_keep_their_tokens():
    p = Page()
    p.apply(1, "same text\n\nsame text")
    p.apply(2, "same text\n\nsame text\n\nsame text")
    assert words(p, 2) == ["same", "text"] * 3 and [p.tokens[t].origin for t in p.revisions[2].token_ids()] == [1, 1, 1, 1, 2, 2]


def test_vandalism_rules():
    p = Page()
    assert p.apply(1, "lorem ipsum dolor sit amet. " * 60) == DENSE
    assert p.apply(2, "lorem ipsum dolor sit amet. " * 60) == KNOWN_HASH and p.vandal_ids == [1, 2] and not p.order
    text = " ".join(f"w{i}" for i in range(400))
    assert p.apply(3, text) == STORED and p.apply(4, "gone") == SHRUNK and p.last.id == 3
    assert p.apply(5, "gone", comment="cut", minor=True) == KNOWN_HASH and p.apply(6, "gone now", comment="cut", minor=True) == STORED
    assert p.apply(7, "x", sha1="s") == STORED and p.revisions[7].length == 1


def test_page_invariants():
    random.seed(4)
    vocab = ["foo", "bar", "baz.", "one", "two;", "\n\n", "\n", "[[x]]", "three", "four. "]
    for _ in range(40):
        p, text, texts = Page(), [random.choice(vocab) for _ in range(25)], {}
        for rev in range(1, 14):
            for _ in range(3):
                at = random.randrange(len(text) + 1)
                text[at : at + random.randrange(3)] = [random.choice(vocab) for _ in range(random.randrange(3))]
            texts[rev] = " ".join(text)
            p.apply(rev, texts[rev])
        for rev in p.order:
            assert words(p, rev) == plain.all_tokens(texts[rev].lower())
            assert p.revisions[rev].original_adds == sum(t.origin == rev for t in p.tokens)
        for t in p.revisions[p.order[-1]].token_ids():
            assert p.seen_last[t] == p.order[-1]


HISTORY = "lang string, page_id long, title string, ord int, rev_id long, timestamp string, comment string, minor boolean, user_id long, user_name string, text string, text_hidden boolean"


def history():
    random.seed(9)
    rows = []
    for page in range(6):
        text = [random.choice("abcdefgh") * 3 for _ in range(40)]
        for k in range(9):
            for _ in range(4):
                text[random.randrange(len(text))] = random.choice(["\n\n", "new", "old", "end. ", "x"])
            rows.append(("en", page, f"P {page}", k, page * 100 + 50 - k, f"2020-01-0{k + 1}T00:00:00Z", None, False, k % 3, "h", " ".join(text), k == 4))
    return rows


def test_batch_resume_and_views(spark):
    df = spark.createDataFrame(history(), HISTORY)
    state = attribute(df).cache()
    for cut in (0, 1, 5, 9):
        again = resume(attribute(df.filter(f"ord < {cut}")), df.filter(f"ord >= {cut}"))
        assert sorted(map(str, again.collect())) == sorted(map(str, state.collect())), cut
    t = Tables(state)
    assert t.inputs.count() == 6 * 8 and views.orphans(t).count() == 0
    meta = {r["page_id"]: r for r in t.article_meta.collect()}
    assert all(meta[p]["last_processed_revid"] == p * 100 + 42 and meta[p]["n_revisions"] == 8 for p in range(6))  # ids fall while order rises
    chain = [r["parent_rev_id"] for r in t.revisions.filter("page_id = 1").orderBy("ord").collect()]
    assert chain == [0, 150, 149, 148, 147, 145, 144, 143]
    page = {"lang": "en", "page_id": 1}
    assert [r["rev_id"] for r in views.revision_slice(t, page, 149, 147).collect()] == [149, 148]
    listed = views.listing(t, views.latest(t)).filter("page_id = 1").orderBy("pos").collect()
    assert [r["value"] for r in listed] == plain.all_tokens(history()[17][10].lower())
    assert views.is_vandalism(t, spark.createDataFrame([("en", 1, 149), ("en", 1, 1)], "lang string, page_id long, rev_id long")).filter("is_vandalism").count() == 0


def test_conflict_chain(spark):
    from pyspark.sql import functions as F

    cases = [((), (), 0), (("a",), (), 0), (("a",), ("b",), 1), (("a",), ("a",), 0), (("a", "b"), ("a",), 1), (("a", "a"), ("b", "b"), 3), (("a", "b"), ("b", "c"), 2), (("a", "b", "c"), ("b",), 2 + 0 + 1)]
    df = spark.createDataFrame([(i, list(o), list(n)) for i, (o, n, _) in enumerate(cases)], "i int, o array<string>, n array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", views.conflict(F.col("o"), F.col("n")).alias("c")).collect()}

    def brute(out, back):
        score, before = 0, None
        for i, who in enumerate(out):
            score += before is not None and before != who
            if i < len(back):
                score += who != back[i]
                before = back[i]
        return score

    assert got == {i: brute(o, n) for i, (o, n, _) in enumerate(cases)}
