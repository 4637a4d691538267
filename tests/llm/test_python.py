"""The operators with Python on the executors: classifier, BPE, suffix-array dedup, token files, near duplicates, preferences."""

import random
import re
import struct
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, near_dedup, preferences, quality, substrings, token_files
from palimpsest.llm.common import held_out

ODD = [
    None, "", " ", "  a\tb \n\n c<|endoftext|>X<|startoftext|> x　 y  ", "don't I'LL  xx !!\x1c ok \x85É\xa0¼½", "🙂🙂 é é ́x İstanbul ΣΑΣ", "ﬁ Ⅷ 中国 ٣", "a" * 5000, "keit" * 3000, "!!!" * 400, "x " * 20_000, "it's 'tis we'll 12345 6",
]


def numbered(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def sample(n=60, seed=1):
    random.seed(seed)
    parts = ["keit", "lich", "ver", "tion", "the", "ing", "ß", "é", "un", "qu", "o", "Zz"]
    return [" ".join("".join(random.choices(parts, k=random.randrange(1, 5))) + random.choice(["", ".", ",", "!"]) for _ in range(random.randrange(80))) for _ in range(n)]


def test_bpe_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    path, texts = bpe.vocabulary("byte_bpe_50k.json"), ODD + sample()
    lib = Tokenizer.from_file(path)
    df = numbered(spark, texts).withColumn("ids", F.lit("clash"))
    out = bpe.encode(df, path)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "ids_", "decoded"]
    for r in out.collect():
        want = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_"] == want and r["n_tokens"] == len(want) and r["decoded"] == lib.decode(want, skip_special_tokens=False), r["text"]
    assert bpe.encode(df.limit(0), path).count() == 0


def test_bpe_words_by_trie_and_by_merging():
    b = bpe.TrieBpe(bpe.vocabulary("byte_bpe_50k.json"))
    random.seed(7)
    words = {bytes(random.choice(b"abcdetionghlr \xc3\xa9\xff0") for _ in range(random.randrange(1, 14))) for _ in range(2000)}
    for w, ids in b.encode_words(words).items():
        assert [b.bytes_of[i] for i in ids] == b.merged(w)
    assert b.decode([b.ids[b"\xff"]]) == "�"


def test_bpe_of_long_words():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    random.seed(9)
    own, lib = bpe.TrieBpe(path), Tokenizer.from_file(path)
    start = "".join(random.choice("abcdeéfghijk🙂") for _ in range(3000))
    words = [start + "x" * 900, start[:1200] + "zz" * 300, start, start + "x", "keitlich" * 30_000]
    for text in [" ".join(words), *words]:
        assert list(next(own.encode([text]))) == lib.encode(text, add_special_tokens=False).ids
    assert all(len(w) <= bpe.LONG for w in own.words)


def test_bpe_pairs_and_walk_by_definition():
    """Pairs as the ranks tell them, words of shared prefixes, null bytes and every width."""
    b = bpe.TrieBpe(bpe.vocabulary("byte_bpe_50k.json"))
    random.seed(17)
    tokens = random.sample(sorted(b.ids.values()), 400)
    before, after = ([random.choice([-1, *tokens]) for _ in range(4000)], random.choices(tokens, k=4000))
    pairs = np.array(before, np.int32), np.array(after, np.int32)
    assert b.fitting(*pairs).tolist() == b.fitting(*pairs).tolist() == [b.follows(x, y) for x, y in zip(before, after)]
    words = {w[:n] for w in (bytes(random.choices(b"aetionr s\x00\xc3\xa9", k=60)) for _ in range(60)) for n in (1, 2, 3, 9, 40, 41, 60)}
    assert {w: list(ids) for w, ids in b.encode_words(words).items()} == {w: [b.ids[t] for t in b.merged(w)] for w in words}


def test_bpe_takes_no_python_step_a_byte():
    """New words are walked as arrays: some calls a level, whatever the number of words."""
    b = bpe.TrieBpe(bpe.vocabulary("byte_bpe_50k.json"))
    random.seed(18)
    text = " ".join("".join(random.choices("etaoinshrdlu", k=9)) for _ in range(20_000))
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        ids = list(next(b.encode([text])))
    finally:
        sys.setprofile(None)
    assert b.decode(ids) == text and calls < 2 * len(text)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path, texts = bpe.vocabulary("word_bpe_49k.json"), ODD + sample()
    lib = Tokenizer.from_file(path)
    rows = [(None if i == 3 else i - 20, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    done = token_files.write(df, f"file://{tmp_path}/f", path, shards=3)
    got = token_files.read(spark, f"file://{tmp_path}/f", done).orderBy("start").collect()
    start, order = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    for r, (_, t) in zip(got, order):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (start, len(ids), struct.pack(f"<{len(ids)}I", *ids)), t
        start += len(ids)
    assert token_files.read(spark, f"file://{tmp_path}/g", token_files.write(df.limit(0), f"file://{tmp_path}/g", path)).count() == 0
    files, (shard, n, _, _, _) = token_files.opened(f"file://{tmp_path}/f")[0], done[0]
    one = list(token_files.read_slice(files, f"{tmp_path}/f/{shard:05d}", n - 1, n))
    assert one == list(token_files.read_slice(files, f"{tmp_path}/f/{shard:05d}", 0, n))[-1:]


def test_token_file_words_are_those_of_the_library():
    """Contractions, marks, Latin-1, words of texts beyond it and added tokens, in one batch and again in batches of one."""
    own = token_files.WordEncoder(bpe.vocabulary("word_bpe_49k.json"))
    random.seed(19)
    parts = ["'s", "'T", "'re", "'LL", "'x", "''", "don't", "it's'd", "Éa", "µ", "12", "½", "!'m?", " ", "\xa0", "\x85", "a_b", "ß", "keit"]
    texts = ["".join(random.choices(parts, k=30)) for _ in range(40)] + ["".join(random.choices([*parts, "中", "é", "<|endoftext|>"], k=30)) for _ in range(40)] + [""]
    want = [own.packed(own.ids(t)) for t in texts]
    assert list(own.encode(texts)) == want == [next(own.encode([t])) for t in texts]
    fresh = token_files.WordEncoder(bpe.vocabulary("word_bpe_49k.json"))
    assert [next(fresh.encode([t])) for t in reversed(texts)] == want[::-1] and list(fresh.encode([])) == []


def test_token_file_words_take_no_python_step_each():
    """New words are learned by a few calls for all of them."""
    own = token_files.WordEncoder(bpe.vocabulary("word_bpe_49k.json"))
    random.seed(20)
    words = {"".join(random.choices("etaoinshrdlu", k=9)) for _ in range(20_000)}
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        ids = next(own.encode([" ".join(words)]))
    finally:
        sys.setprofile(None)
    assert ids == own.packed(own.ids(" ".join(words))) and calls < len(words)


def test_token_file_words_are_no_python_objects():
    """While a batch is given out, its words aren't held one by one."""
    own = token_files.WordEncoder(bpe.vocabulary("word_bpe_49k.json"))
    random.seed(21)
    text = " ".join(random.choices(["keit", "don't", "Été", "12", "ver-tion"], k=100_000))
    want = next(own.encode([text]))
    before, batch = sys.getallocatedblocks(), own.encode([text, text])
    assert next(batch) == want == own.packed(own.ids(text))
    assert sys.getallocatedblocks() - before < 10_000


def test_token_file_words_are_forgotten_and_learned_again(monkeypatch):
    """Every Latin-1 letter beside others, with few known words, and words too long to be kept."""
    for name, n in (("MOST_WORDS", 50), ("LONG", 12), ("LEARN_WORDS", 7)):
        monkeypatch.setattr(token_files, name, n)
    own = token_files.WordEncoder(bpe.vocabulary("word_bpe_49k.json"))
    random.seed(22)
    letters = [*map(chr, range(256)), *"'' smtdlrve", "'s", "'ll", " "]
    for _ in range(60):
        texts = ["".join(random.choices(letters, k=random.randrange(60))) for _ in range(5)] + ["the " * 3, "xyz" * random.randrange(9), "'", "a'", "it'l", "\n", "中 'tis 12a"]
        random.shuffle(texts)
        assert list(own.encode(texts)) == [own.packed(own.ids(t)) for t in texts]
        assert len(own.words) == len(own.coded) == len(own.met) <= 50 and max(map(len, own.words.to_pylist()), default=0) <= 12


def test_broken_records_are_found():
    framed = token_files.record(b"payload")
    assert token_files.parse(framed) == (b"payload", len(framed))
    for at in (0, 9, 14, len(framed) - 1):
        with pytest.raises(ValueError):
            token_files.parse(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :])


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(texts, n=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                cover[i : i + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8)))))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


def test_repeated_substrings(spark):
    random.seed(3)
    w = lambda n: " ".join(random.choice(["alpha", "beta", "délta", "x"]) + str(random.randrange(50)) for _ in range(n))
    p, q, r = w(80), w(60), w(300)
    texts = [w(50) + p + w(60), w(20) + p + w(5), p, p[3:] + w(9), q[:405] + w(40), w(40) + q[1:402], None, "", "a" * 1500, "ab" * 900 + w(4), "ab" * 300, r + w(3) + r, r[100:900] + "!" + r[901:1500], r[50:950], q[:399], w(10) + q[:399] + w(10), q[:400], w(9)]
    texts += [w(10) + p[:420] + w(10) for _ in range(30)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(12, texts[12])]
    want = defaultdict(list)
    for (i, t), spans in zip(rows, brute_repeats([t for _, t in rows])):
        want[i, t].append(spans)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(4)
    for most in (50_000, 5):
        for x in substrings.remove(df, most=most).collect():
            raw = (x["text"] or "").encode()
            spans = [(s["start"], s["end"]) for s in x["removed"]]
            assert spans in want[x["doc_id"], x["text"]] and x["n_bytes"] == len(raw), (x["doc_id"], spans)
            edges = [0, *(e for s in spans for e in s), len(raw)]
            assert bytes(x["kept_"]) == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
    assert substrings.remove(df.limit(0)).count() == 0


def brute_passages(texts, n=51):
    words = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    return [sum(any(seen[tuple(w[k : k + n])] > 1 for k in range(max(0, i - n + 1), min(i, len(w) - n) + 1)) for i in range(len(w))) for w in words]


def test_passages_of_over_50_words(spark):
    random.seed(4)
    w = lambda n: " ".join(random.choice(["Ab", "b", "dé", "x"]) + str(random.randrange(90)) for _ in range(n))
    p, q = w(51), w(90)
    texts = [w(70) + " " + p + " " + w(70), re.sub("[a-z]", lambda m: m[0].upper(), p) + "\n" + w(3), p[3:] + " " + w(60), q, w(5) + "  " + q.replace(" ", "\t") + " " + w(4), None, "", "a " * 130, w(30), w(51), q[: len(q) // 2], w(9) + " " + p + w(4)]
    texts += [w(8) + " " + q + " " + w(8) for _ in range(30)] + [texts[0]]
    df = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("Passages", F.lit(1)).repartition(4)
    want = {(i if i % 5 else None, t): n for (i, t), n in zip(enumerate(texts), brute_passages(texts))}
    assert set(want.values()) >= {0, 51, 90, 130}
    for most in (50_000, 5):
        got = substrings.passages(df, most=most).collect()
        assert len(got) == len(texts) and all(sum(s["end"] - s["start"] for s in r["passages_"]) == want[r["doc_id"], r["text"]] for r in got)
    assert substrings.passages(df.limit(0)).count() == 0


def test_anchors_do_not_depend_on_segments():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 110, 9000).astype(np.uint8)
    whole = substrings.anchors(raw)
    substrings.SEGMENT, old = 1000, substrings.SEGMENT
    cut = substrings.anchors(raw)
    substrings.SEGMENT = old
    assert all((a == b).all() for a, b in zip(whole, cut))
    gaps = np.diff(whole[0])
    assert gaps.max() <= substrings.BYTES.side + 1


def test_multikey_order():
    random.seed(1)
    s = [bytes(random.choice(b"ab") for _ in range(random.randrange(30))) for _ in range(300)]
    assert [s[i] for i in substrings.multikey_order(s)] == sorted(s) or [s[i].ljust(40, b"\0") for i in substrings.multikey_order(s)] == sorted(x.ljust(40, b"\0") for x in s)


def test_repeats_by_pairs_and_by_order():
    random.seed(6)
    base = bytes(random.choice(b"abc") for _ in range(700))
    cases = [(base[150 + i : 550 + i - 3 * i], base[: 150 + i][::-1][: 200 - i]) for i in range(12)] + [(base[200:600], base[:200][::-1]), (base[200:600], base[1:200][::-1] + b"z")]
    few = substrings.repeats(*map(list, zip(*cases)))
    substrings.FEW, old = 1, substrings.FEW
    many = substrings.repeats(*map(list, zip(*cases)))
    substrings.FEW = old
    assert (few == many).all() and few.any()


def shingles(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k, num, den):
    sets, root = [(i, shingles(t, k)) for i, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    low = defaultdict(lambda: None)
    for n, (i, _) in enumerate(sets):
        t = top(n)
        low[t] = i if low[t] is None else low[t] if i is None else min(low[t], i)
    return [(i, len(s), low[top(n)]) for n, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    random.seed(k)
    rows = [(1, None), (2, ""), (3, "  "), (4, "Ab"), (5, "aB"), (6, "ab cd"), (None, "ab cd"), (7, "a b c"), (None, None)]
    for g in range(12):
        base = [f"t{random.randrange(500)}" for _ in range(random.choice([8, 30, 150]))]
        for _ in range(9):
            w = list(base)
            for _ in range(random.randrange(6)):
                w[random.randrange(len(w))] = f"n{random.randrange(10**6)}"
            rows.append((100 + len(rows), " ".join(w) + random.choice(["", " ", "\n"])))
    rows += rows[20:26]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("c")).repartition(4)
    want = Counter(brute_groups(rows, k, num, 100))
    for block in (4096, 6):
        near_dedup.BLOCK, old = block, near_dedup.BLOCK
        got = near_dedup.groups(df, shingle=k, num=num)
        near_dedup.BLOCK = old
        assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    kept = near_dedup.keep(df, shingle=k, num=num)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in want}
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_near_duplicates_kept_row_by_row(spark):
    same, near, other = "a b c d e f g", "A b c d e f g ", "p q r s t u v"
    rows = [(1, same), (2, other), (None, same), (5, same), (5, "k l m n o p q"), (7, near), (7, near), (None, "v w x y z"), (None, "v w x y z"), (2, other), (9, None), (None, None), (0, other + " x" * 40)]
    kept = near_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), num=80)
    want = Counter(r for r, (i, _, c) in zip(rows, brute_groups(rows, 5, 80, 100)) if i == c)
    assert Counter(map(tuple, kept.collect())) == want and want[(5, "k l m n o p q")] == 1 and not want[(None, same)] and not want[(5, same)]


def test_superminhash_estimates_with_less_variance():
    rng, errors = np.random.default_rng(2), []
    for _ in range(60):
        u = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = np.unique(u[:225]), np.unique(u[75:])
        x, y = near_dedup.signatures([a, b], 389)
        errors.append((x == y).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < (0.25 / 389) ** 0.5


def test_linked_is_exact():
    random.seed(4)
    for _ in range(40):
        base = random.sample(range(10**6), 40)
        sets = [np.unique(np.array(random.sample(base, random.randrange(28, 41)) + random.sample(range(10**6), random.randrange(4)), np.uint64)) for _ in range(random.randrange(1, 25))]
        root = near_dedup.linked(sets, 85, 100)
        pairs = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        group = list(range(len(sets)))
        for _ in sets:
            for i, j in pairs:
                group[i] = group[j] = min(group[i], group[j])
        assert all((root[i] == root[j]) == (group[i] == group[j]) for i in range(len(sets)) for j in range(len(sets)))


def test_quality(spark):
    random.seed(1)
    good = [" ".join(random.choice(["the", "of", "reading", "house", "was"]) for _ in range(30)) + "." for _ in range(300)]
    bad = [" | ".join(random.choice(["THE!!", "of%%", "zz$$$"]) for _ in range(30)) for _ in range(100)]
    rows = [(i, t, int(i < 300)) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(5, None, 0), (None, 1, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    out = {r["doc_id"]: r["score_"] for r in quality.score(df, model).withColumn("held", held_out("doc_id")).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([(out[i] >= 0.7) == rows[i][2] for i in held]) > 0.97 and all(0 <= s <= 1 for s in out.values())
    again = quality.train(df.repartition(2), labels.repartition(2))
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))
    kept = {r["doc_id"] for r in quality.keep(df, labels).collect()}
    assert len(kept & set(range(300))) > 290
    none = quality.train(df, labels.limit(0))
    assert quality.score(df, none).filter("score_ = 0.5").count() == df.count() and quality.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize("text", ["!" * 1_000_000 + "x", ("!" * 500_000 + "x ") * 2, "x!" * 500_000, " !" * 300_000])
def test_features_take_time_by_length(text):
    began = time.process_time()
    assert len(quality.features(text)) == len(quality.FEATURES)
    assert time.process_time() - began < 2


def test_symbols_at_the_end_of_words_are_counted():
    at = quality.FEATURES.index("word_end_symbols")
    for text in ("a!! b!!! c! d", "!!! a", "a!!b !!", "<<>> x==", "!!!x !!"):
        slow = len(re.findall(r"[!#$%&*+<=>@^_|~]{2,}(?=\s|$)", text))
        assert quality.features(text)[at] == slow / len(text.split())


def test_pairs_are_learned_that_no_single_feature_tells():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (2, 0) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def turn(role, text):
    return {"role": role, "text": text}


def test_preferences(spark):
    a, b = [turn("user", "hi"), turn("assistant", "yes <|end|>")], [turn("user", "hi"), turn("assistant", None), turn("user", "more")]
    cases = [(a, b), (a, a), ([], b), (a, [turn(None, "x")]), ([turn(None, None)], [turn(None, None), turn("assistant", "é😀")])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, chosen_turns array<struct<role: string, text: string>>, rejected_turns array<struct<role: string, text: string>>").withColumn("prompt", F.lit("clash"))
    rows = {r["i"]: r for r in preferences.format_pairs(df).collect()}
    for i, sides in enumerate(cases):
        r, n = rows[i], 0
        while n < min(map(len, sides)) and sides[0][n] == sides[1][n]:
            n += 1
        say = lambda t: (f"<|{t['role'] or 'unknown'}|>\n", (t["text"] or "").replace("<|", "<\\|") + "<|end|>\n")
        assert r["n_prefix_turns"] == n and r["prompt_"] == "".join("".join(say(t)) for t in sides[0][:n])
        for name, side in zip(("chosen", "rejected"), sides):
            text, spans = "", []
            for t in side[n:]:
                head, tail = say(t)
                if t["role"] == "assistant":
                    spans.append((len(text + head), len(text + head + tail)))
                text += head + tail
            assert r[name] == text and [tuple(s) for s in r[f"{name}_mask"]] == spans


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in preferences.conversations(turns).collect()}
    assert got == {1: ["a", "b", "b"], 2: [None]} and preferences.conversations(turns.limit(0)).count() == 0
