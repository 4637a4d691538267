"""Text rules: fixed expectations, and Python and Column forms against each other."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import plain, rules
from palimpsest.functions import text as X

PIECES = ["a", "foo", "Bar", ". ", "; ", "? ", "! ", ": ", "\t", "\n", "\n\n", "\r\n", "\r", "|", "||", "[[", "]]", "{{", "}}", "{|", "|}", "|-\n", "<!--", "-->", "<ref x>", "</ref>", "<table>", "</tr>",
          "http://x.y/z ", "@@@@", "@", "æææææ", "ææææ", " ", "  ", "\xa0", " ", "é", "中国", "€", "“q”", "İ", "ß", "😀", "=", "abc. ", "'", '"', "\x1c", "\x85"]


@pytest.mark.parametrize("text, want", [("a\n\n\nb", ["a", "\nb"]), ("before{|x|}after", ["before", "{|x|}", "after"]), ("<tr>a</tr>b", ["", "<tr>a</tr>", "b"]), ("a\r\n\r\nb", ["a", "b"]), ("", [""])])
def test_paragraphs(text, want):
    assert plain.paragraphs(text) == want


@pytest.mark.parametrize("text, want", [("foo. bar. baz.", ["foo.", "bar.", "baz."]), ("hi. ok", ["hi. ok"]), ("foo<!--c-->bar", ["foo", "<!--c-->", "bar"]), ("a; b? c! d: e", ["a;", "b?", "c!", "d:", "e"]), ("see http://a.b/c now", ["see ", "http://a.b/c ", "now"])])
def test_sentences(text, want):
    assert plain.sentences(text) == want


@pytest.mark.parametrize("text, want", [
    ("foo bar", ["foo", "bar"]), ("[[a|b]]", ["[[", "a", "|", "b", "]]"]), ("[[[", ["[[", "["]), ("<!--x-->", ["<!--", "x", "-->"]), ("<!-->", ["<!--", ">"]), ("--->", ["-", "-->"]),
    ("中国a", ["中", "国", "a"]), ("don't", ["don", "'", "t"]), ("ææææ", ["|"]), ("aææææb", ["aææææb"]), ("{{x}}", ["{{", "x", "}}"]), ("", []),
])
def test_tokens(text, want):
    assert plain.tokens(text) == want


def test_symbols_are_single():
    assert len(rules.SYMBOLS) == len(set(rules.SYMBOLS)) == 94 and all(len(s) == 1 for s in rules.SYMBOLS)


def test_density():
    assert plain.density([]) == 0.0 and plain.density(["a", "a", "b", "|", "|"]) == 1.5 and plain.density(["|"]) == 0.0


@pytest.mark.parametrize("before, now, comment, minor, want", [(1500, 900, None, False, True), (1500, 950, None, False, False), (10000, 1000, None, False, False), (1500, 900, "c", True, False), (1500, 900, "", True, True), (1000, 1, None, False, False), (0, 0, None, False, False), (1500, 900, "c", False, True)])
def test_shrinks(spark, before, now, comment, minor, want):
    assert plain.shrinks(before, now, comment, minor) is want
    row = spark.createDataFrame([(before, now, comment, minor)], "b long, n long, c string, m boolean")
    assert row.select(X.shrinks(F.col("b"), F.col("n"), F.col("c"), F.col("m")).alias("s")).first()["s"] is want


def test_python_and_columns_agree(spark):
    random.seed(5)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randrange(25))) for _ in range(1500)] + ["", " ", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: r for r in df.select("i", X.paragraphs("t").alias("p"), X.sentences("t").alias("s"), X.tokens("t").alias("k"), X.all_tokens("t").alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["p"] == plain.paragraphs(t) and got[i]["s"] == plain.sentences(t) and got[i]["k"] == plain.tokens(t) and got[i]["a"] == plain.all_tokens(t), repr(t)


def test_editors_and_times(spark):
    df = spark.createDataFrame([(0, "h"), (0, None), (7, "x"), (None, "y")], "u long, n string")
    assert [r[0] for r in df.select(X.editor("u", "n")).collect()] == ["0|h", "0|", "7", ""]
    stamps = [("2020-01-01T00:00:00Z", 1577836800), ("1970-01-01T00:00:01Z", 1), ("2024-02-29T12:00:00+", 1709208000), ("2020-01-01", None), ("2020-01-01T00:00:00", None), ("x", None), (None, None)]
    df = spark.createDataFrame([(s,) for s, _ in stamps], "s string")
    assert [r[0] for r in df.select(X.epoch_seconds("s")).collect()] == [w for _, w in stamps]
    assert [r[0] for r in df.select(X.age_seconds("s", 1577836810)).collect()][:1] == [10.0]


def test_codes(spark):
    df = spark.createDataFrame([(v,) for v in (0, -1, 1, -(2**62), 2**62)], "v long")
    assert all(r[0] == r[1] for r in df.select("v", X.unzigzag(X.zigzag("v"))).collect())
    assert [r[0] for r in spark.createDataFrame([("simple", 1234567)], "l string, p long").select(X.shard_path("l", "p")).collect()] == ["simple/1/1234/1234567"]
