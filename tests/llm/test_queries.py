"""Every registered query of the operators, and each stage of the pipeline, over one small folder against brute force or SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_native import base_spans, plan
from test_native import shingles as shingles_of_5
from test_python import WORD, brute_groups, brute_passages, brute_repeats

import corpus_pipeline
from palimpsest.llm import mixing, quality, registry

#: Conversations without an assistant turn.
SILENT = [(-5, 1, "user", "any <|one|> there?"), (-5, 2, "user", None), (900_001, 1, None, "x")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with odd rows: null and empty texts, copies, near copies, shared passages, secrets, no source."""
    random.seed(12)
    root, small = str(tmp_path_factory.mktemp("tables")), "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = lambda n: " ".join("".join(random.choices("etaoinshrdlu", k=random.randint(2, 8))) for _ in range(n))
    passage, base = words(58)[:390], words(120).split()
    odd = [None, "", " \n\t", "🙂 é password = \"hunter2hunter2\" q7Zk2Vx9Lw4TbN8yRj3D end", "two words", "Two words", passage, *(words(40) + " " + passage + " " + words(40) for _ in range(3)), words(9) * 900, words(500), "a" * 2000]
    odd += [" ".join(w if k % 60 != c else f"new{c}" for k, w in enumerate(base)) for c in range(8)] + [docs[0][1]] * 4 + [docs[3][1]]
    docs += [(10_000 + 7 * k, t, "en", [None, "source-1", "tiny"][k % 3], None) for k, t in enumerate(odd)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{root}/labels.parquet")
    talks = spark.read.parquet(f"{small}/conversations.parquet")
    silent = spark.createDataFrame(SILENT, "conv_id long, turn int, role string, text string")
    talks.unionByName(silent, allowMissingColumns=True).write.parquet(f"{root}/conversations.parquet")
    return root, {d[0]: d for d in docs}


def rows_of(spark, name, folder):
    return {r["doc_id"]: r for r in registry.QUERIES[name](spark, folder[0]).collect()}


def by_hand(model, text):
    """A score added up entry by entry."""
    x = quality.features(text or "")
    odds = model.base + sum(t[sum(c <= v for c in cuts)] for t, cuts, v in zip(model.tables, model.cuts, x))
    place = lambda f: sum(c <= x[f] for c in model.coarse[f])
    odds += sum(t[place(f), place(g)] for (f, g), t in model.pairs.items())
    return 1 / (1 + math.exp(-max(-30, min(30, odds))))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_with_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder[0]}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, folder[0])
    rounded = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert rounded(got.collect()) == rounded(con.sql(registry.ORACLES[name]).select(*got.columns).fetchall())


def test_op9_without_an_assistant(spark, folder):
    got = {r["conv_id"]: r for r in registry.QUERIES["op9_preferences"](spark, folder[0]).collect()}
    assert set(got) == {r["conv_id"] for r in spark.read.parquet(f"{folder[0]}/conversations.parquet").select("conv_id").distinct().collect()} - {None}
    assert got[-5]["prompt"] == "<|user|>\nany <\\|one|> there?<|end|>\n<|user|>\n<|end|>\n" and got[-5]["n_prefix_turns"] == 2
    assert got[900_001]["prompt"] == "<|unknown|>\nx<|end|>\n"
    assert all(got[i][c] == "" for i in (-5, 900_001) for c in ("chosen", "rejected", "chosen_mask", "rejected_mask"))


def test_op1(spark, folder):
    got = rows_of(spark, "op1_quality", folder)
    docs, labels = (spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert set(got) == set(folder[1])
    for i, r in got.items():
        want = by_hand(model, folder[1][i][1])
        assert abs(r["score"] - want) < 1e-9 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)


def test_op3_and_op7(spark, folder):
    from tokenizers import Tokenizer

    import public_tokenizers

    byte, word = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for t in (byte, word):
        t.no_truncation()
        t.no_padding()
    bpe, files, start = rows_of(spark, "op3_bpe", folder), rows_of(spark, "op7_token_files", folder), 0
    assert set(bpe) == set(files) == set(folder[1])
    for i in sorted(folder[1]):
        text = folder[1][i][1] or ""
        ids = byte.encode(text, add_special_tokens=False).ids
        assert tuple(bpe[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(byte.decode(ids, skip_special_tokens=False)))
        ids = word.encode(text, add_special_tokens=False).ids + [1]
        assert tuple(files[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, folder):
    got, ids = rows_of(spark, "op4_suffix_dedup", folder), sorted(folder[1])
    texts = [folder[1][i][1] for i in ids]
    short = 0
    for i, t, spans, words in zip(ids, texts, brute_repeats(texts), brute_passages(texts)):
        raw = (t or "").encode()
        edges = [0, *(e for s in spans for e in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert tuple(got[i]) == (i, len(raw), len(raw) - len(kept), len(spans), sha(kept), words)
        short += words > 0 and not spans
    assert len(got) == len(ids) and short >= 3  # passages of over 50 words in fewer than 400 bytes


def test_op5(spark, folder):
    got, ids = rows_of(spark, "op5_fingerprints", folder), sorted(folder[1])
    prints, errors = defaultdict(set), []
    signed = lambda s: {int(x, 16) - (1 << 64 if int(x, 16) >> 63 else 0) for x in s.split()}
    for k, i in enumerate(ids):
        r, text, after = got[i], folder[1][i][1] or "", folder[1][ids[(k + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        prints[text].add(r["fingerprint"])
        for like, other, words in ((r["near_edited"], r["edited_fingerprint"], edited), (r["near_next"], got[ids[(k + 1) % len(ids)]]["fingerprint"], after)):
            a, b = signed(r["fingerprint"]), signed(other)
            sample = set(sorted(a | b)[:128])
            assert abs(like - (len(a & b & sample) / len(sample) if sample else 1.0)) < 1e-12
            x, y = shingles_of_5(text), shingles_of_5(words)
            errors.append(abs(like - (len(x & y) / len(x | y) if x | y else 1.0)))
    assert len(got) == len(ids) and all(len(p) == 1 for p in prints.values()) and np.mean(errors) < 0.03 and max(errors) < 0.25


def test_op6(spark, folder):
    got, names = rows_of(spark, "op6_secrets", folder), ("assign", "access", "hex", "markov")
    for i, r in got.items():
        base = base_spans(folder[1][i][1])
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3)) and r["base_sha256"] == sha(",".join(listed))
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert [":".join(s) for s in spans if s[0] != "markov"] == listed and spans == sorted(spans, key=lambda s: (int(s[1]), names.index(s[0])))
    planted = next(i for i, d in folder[1].items() if d[1] and "hunter2" in d[1])
    at = folder[1][planted][1].index("q7Zk2")
    assert len(got) == len(folder[1]) and f"markov:{at}:{at + 20}" in got[planted]["spans"]


def test_secrets_that_are_held_out():
    """Precision and recall of the model on random strings of several lengths and alphabets that it never saw, and on words."""
    from palimpsest.llm import secrets
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = secrets.train(secrets.labelled(docs.filter(~held)))
    random.seed(21)
    letters = {"any": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"}
    planted = [(kind, n, f"see {''.join(random.choices(pool, k=n))} end") for kind, pool in letters.items() for n in (16, 20, 24, 32, 40) for _ in range(40) if kind != "url" or n >= 20]
    rows = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(planted)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(rows, model).filter(F.exists("added_spans", lambda s: s["start"] == 4)).select("doc_id").collect()}
    share = lambda rows: sum(i in found for i in rows) / len(rows)
    by_length = {n: share([i for i, p in enumerate(planted) if p[1] == n]) for n in (16, 20, 24, 32, 40)}
    assert min(by_length[n] for n in (24, 32, 40)) > 0.97 and by_length[20] > 0.9 and by_length[16] > 0.6, by_length
    clean = secrets.scan(docs.filter(held), model).filter(F.size("added_spans") > 0).count()
    assert clean <= 0.01 * docs.filter(held).count()


def test_op8(spark, folder):
    got = rows_of(spark, "op8_near_dedup", folder)
    want = brute_groups([(i, folder[1][i][1]) for i in sorted(folder[1])], 3, 85, 100)
    assert Counter(map(tuple, got.values())) == Counter((i, n, c, i == c) for i, n, c in want) and len({c for _, _, c in want}) < len(want) - 8


@pytest.mark.parametrize("num", [80, 85])
def test_band_recall(num):
    """Pairs just over the threshold that share no band, of very small and of large sets; at the rate that is stated for them there is none."""
    from palimpsest.llm import near_dedup

    rng, rows = np.random.default_rng(5), near_dedup.rows_of_band(num / 100)
    for size, trials in ((5 if num == 80 else 7, 12_000), (20, 3_000), (100, 600), (400, 200)):
        common, sets = -(-num * size // 100), []
        for _ in range(trials):
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            sets += [x, np.sort(rng.permutation(x)[:common])]
        b = near_dedup.bands(near_dedup.signatures(sets, near_dedup.slots_for(rows)), rows)
        assert (b[::2] == b[1::2]).any(1).all()


def mix_by_hand(rows):
    """Copies of each row (doc_id, text, source) in the mix."""
    size = lambda t: len(WORD.findall(t or ""))
    totals, copies = Counter(), {}
    for _, t, s in rows:
        totals[s] += size(t)
    for s, target in plan(totals).items():
        budget, before = math.floor(target + 0.5), 0
        epochs = budget // totals[s] if totals[s] else 0
        key = lambda r: (int(hashlib.md5(f"{r[0]}:{mixing.SEED}".encode()).hexdigest()[:15], 16), r[0])
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=key):
            taken = epochs * size(t) + max(0, min(size(t), budget - epochs * totals[s] - before))
            before += size(t)
            copies[i] = math.floor(taken / size(t) + 0.5) if size(t) else 0
    return copies


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    now, stages = docs, dict(corpus_pipeline.STAGES)
    held = lambda: [(r["doc_id"], r["text"], r["source"]) for r in now.collect()]

    def step(name):
        nonlocal now
        out = stages[name](spark, now, folder[0])
        assert name == "encode" or out.columns == docs.columns
        path = f"{folder[0]}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        return [r.asDict() for r in now.collect()]

    before = held()
    assert Counter(r["doc_id"] for r in step("quality classifier")) == Counter(i for i, t, _ in before if by_hand(model, t) >= 0.7)
    before, last = held(), {}
    for i, t, _ in before:
        last[t or ""] = max(i, last.get(t or "", i))
    assert len(last) < len(before) and Counter(r["doc_id"] for r in step("exact dedup")) == Counter(last.values())
    before = held()
    stay = [i for i, _, c in brute_groups([(i, t) for i, t, _ in before], 5, 80, 100) if i == c]
    assert len(stay) < len(before) and Counter(r["doc_id"] for r in step("near dedup")) == Counter(stay)
    before = held()
    assert Counter(r["doc_id"] for r in step("mix sources")) == Counter({i: n for i, n in mix_by_hand(before).items() if n})
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, before = step("encode"), held_texts(folder)
    assert all(r["ids"] == lib.encode(before[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["round_trip"] for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, folder[0]).collect()) == Counter((r["doc_id"], r["n_tokens"]) for r in rows)


def held_texts(folder):
    return {i: d[1] or "" for i, d in folder[1].items()}
