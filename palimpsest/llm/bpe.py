"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a byte trie. A walk down its levels gives every node the last token of the
encoding of the bytes on its path. That token is a suffix of the path; it is the one suffix token that follows its
predecessor (the last token of the ancestor where it starts) the way byte-pair merging would leave the two side by
side. So each prefix that words share is encoded once, and a word's ids are read back along the ancestors. All nodes
of a level are taken at once, as arrays.

Whether two tokens stay side by side is told by the ranks of what stands at their seam while they are merged; a worker
remembers the pairs it met, as many as its table has places.

Words are what the byte-level pre-tokenizer cuts a text into. For texts of Latin-1 characters, whose classes never
change, one expression here cuts them; other texts are cut into pieces (white space and what follows it) at which
the pre-tokenizer always cuts, too, and the library's own then splits each distinct piece. Added tokens are matched first.

Defined results: a null text is an empty one, with no ids; the decoded text of ids is what the library's decode gives,
with U+FFFD for invalid UTF-8. Texts of any length are encoded whole. Rows are only mapped: repeats, ties, clashing
column names and empty tables need no care.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import body, fresh, frugal
from palimpsest.session import table

#: What Unicode calls white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters, digits and white space of Latin-1, and the byte-level pre-tokenizer's rule over them.
LETTER, DIGIT, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r \x85\xa0"
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{LETTER}{DIGIT}{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
BEYOND = re.compile("[^\x00-\xff]")


def latin1(text: str) -> bool:
    return text.isascii() or BEYOND.search(text) is None


#: Words that a worker learns before it forgets those it hasn't met since as many ago; token pairs of long words before it starts anew.
MOST_WORDS, MOST_PAIRS = 150_000, 300_000
#: Places of the table of token pairs, as a power of 2: a pair takes that of the one that was there.
PAIR_BITS = 19
#: No merge: above every rank.
NEVER = 1 << 30
#: Rows and text characters of a batch that goes back to Spark.
BATCH_ROWS, BATCH_CHARS = 1_000, 1_500_000
#: Bytes of the words of one trie, each as wide as the longest, and those of a word beyond which it gets none: its prefixes are those of the word before it in order.
TRIE_BYTES, LONG = 800_000, 400
#: Bytes of a word beyond which it isn't put beside shorter ones.
WIDE = 40


class Recent(dict):
    """A mapping that is bounded: when it has grown to `most`, it becomes the older half; what is met again comes back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def unknown(self, keys: set) -> set:
        """The keys that it doesn't hold, after those of the older half have come back."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = keys.difference(self)
        if self.older:
            back = new.intersection(self.older)
            self.update((k, self.older[k]) for k in back)
            new -= back
        return new


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """A byte-level BPE vocabulary file of the tokenizers library, without normalizer or dropout."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, kind = spec["model"], spec["pre_tokenizer"]["type"]
        if model["type"] != "BPE" or kind != "ByteLevel" or spec["normalizer"] or model["dropout"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.letters = byte_letters()
        raw = lambda token: bytes(map(self.letters.__getitem__, token))
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.parts = {self.ids[a + b]: (self.ids[a], self.ids[b], r) for (a, b), r in self.ranks.items()}
        self.joins = {self.ids[a] << 24 | self.ids[b]: r for (a, b), r in self.ranks.items()}
        if len(self.parts) < len(merges) or any(r <= max(self.parts.get(x, (0, 0, -1))[2] for x in (a, b)) for a, b, r in self.parts.values()):
            raise ValueError("merges that make a token twice, or before its parts")
        self.edges: tuple[dict, dict] = ({}, {})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings")
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.stop = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.path, self.words_of = path, None
        self.endings: dict[int, int] = {}  # the tokens as a trie of their bytes read backwards: node << 8 | byte, the node below
        ends = {}
        for token, i in self.ids.items():
            node = 0
            for byte in reversed(token):
                node = self.endings.setdefault(node << 8 | byte, len(self.endings) + 1)
            ends[node] = i
        self.ends = np.full(len(self.endings) + 1, -1, np.int32)  # the token of a node
        self.ends[list(ends)] = list(ends.values())
        self.end_of = ends
        self.tables()
        self.pairs: dict[int, bool] = {}
        self.words: Recent = Recent(MOST_WORDS)

    def tables(self) -> None:
        """The backward trie, the merges and the pairs met so far as arrays."""
        keys, below = (np.fromiter(x, np.int64, len(self.endings)) for x in (self.endings, self.endings.values()))
        nodes, letters = keys >> 8, keys & 255
        many = np.bincount(nodes, minlength=len(self.ends)) > 1
        self.row = np.where(many, np.cumsum(many) - 1, many.sum()).astype(np.int32)  # nodes of several children; the last row: all others
        self.rows = np.full((int(many.sum()) + 1) << 8, -1, np.int32)
        several = many[nodes]
        self.rows[self.row[nodes[several]].astype(np.int64) << 8 | letters[several]] = below[several]
        self.only, self.only_below = np.full(len(self.ends), -1, np.int16), np.full(len(self.ends), -1, np.int32)  # of one child
        self.only[nodes[~several]], self.only_below[nodes[~several]] = letters[~several], below[~several]
        top = max(self.bytes_of) + 1
        self.sides, self.rank_of = (np.zeros(top, np.int64), np.zeros(top, np.int64)), np.full(top, -1, np.int64)
        for i, (a, b, r) in self.parts.items():
            self.sides[0][i], self.sides[1][i], self.rank_of[i] = a, b, r
        self.join_keys = np.array(sorted(self.joins), np.int64)
        self.join_ranks = np.array([self.joins[k] for k in self.join_keys.tolist()], np.int64)
        self.met = np.full(1 << PAIR_BITS, -1, np.int64)  # pair << 1 | whether it stays
        self.pieces = pa.array([self.bytes_of.get(i) for i in range(top)], pa.binary())

    def merged(self, text: bytes) -> list[bytes]:
        """Byte-pair merging as it is defined: the lowest rank first, the leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """What stands at a token's left (0) or right (1) end while its bytes merge: (token, rank of the merge that takes it in)."""
        if (known := self.edges[side].get(token)) is None:
            at, end, out = token, 1 << 30, []
            while True:
                out.append((at, end))
                if at not in self.parts:
                    break
                at, end = self.parts[at][side], self.parts[at][2]
            known = self.edges[side][token] = tuple(out)
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether merging leaves the two tokens as they are; before: -1 at a word's start.

        A merge across the seam happens if its rank is below that of the merge that takes in what is to the left of the seam,
        and not above that on the right (of equal ranks the left goes first). A token's rank is above that of its parts.
        """
        key = (before + 1) << 24 | token
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            if before < 0:
                known = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
            else:
                rank = self.joins.get
                known = not any((r := rank(x << 24 | y)) is not None and r < ex and r <= ey for x, ex in self.edge(before, 1) for y, ey in self.edge(token, 0))
            self.pairs[key] = known
        return known

    def stay(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`follows` of many pairs: the two tokens are taken apart at their seam, what was merged last first."""
        out = np.ones(len(before), bool)
        for i in np.flatnonzero(before < 0).tolist():
            out[i] = self.follows(-1, int(token[i]))
        at = np.flatnonzero(before >= 0)
        x, y, limit = before[at], token[at], np.full(len(at), NEVER)
        while len(at):
            pair = x << 24 | y
            place = np.minimum(np.searchsorted(self.join_keys, pair), len(self.join_keys) - 1)
            joined = (self.join_keys[place] == pair) & (self.join_ranks[place] < limit)
            out[at[joined]] = False
            more = np.flatnonzero(~joined & (np.maximum(self.rank_of[x], self.rank_of[y]) >= 0))
            at, x, y = at[more], x[more], y[more]
            left, right = self.rank_of[x], self.rank_of[y]
            first = left > right
            limit = np.where(first, left, right + 1)
            x, y = np.where(first, self.sides[1][x], x), np.where(first, y, self.sides[0][y])
        return out

    def fitting(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The same, as far as possible from the table of pairs."""
        pair = (before.astype(np.int64) + 1) << 24 | token
        place = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        met = self.met[place]
        fits, new = (met & 1).astype(bool), np.flatnonzero(met >> 1 != pair)
        if len(new):
            once, of = np.unique(pair[new], return_inverse=True)
            fits[new] = self.stay((once >> 24) - 1, once & 0xFFFFFF)[of]
            self.met[place[new]] = pair[new] << 1 | fits[new]
        return fits

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has), by one walk over the trie of distinct sorted words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        wide = max(1, int(sizes.max()))
        letters = np.array(words, f"S{wide}").view(np.uint8).reshape(len(words), wide)
        differ = letters[1:] != letters[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        shared = np.concatenate(([-1], np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))))  # with the word before
        most = int(np.maximum(sizes - np.maximum(shared, 0), 0).sum()) + 1
        above, byte = np.zeros(most, np.int32), np.zeros(most, np.uint8)  # by node: the one above, its byte
        last, start, count = np.full(most, -1, np.int32), np.zeros(most, np.int32), np.zeros(most, np.int32)  # last token, where it starts, tokens
        ends, active, own, top = np.zeros(len(words), np.int32), np.arange(len(words)), np.zeros(len(words), np.int32), 1
        for depth in range(1, wide + 1):
            longer = sizes[active] >= depth
            active, own = active[longer], own[longer]
            begun = shared[active] < depth
            first = active[begun]
            to = top + len(first)
            above[top:to], byte[top:to] = own[begun], letters[first, depth - 1]
            own = (top - 1 + np.cumsum(begun)).astype(np.int32)
            todo, at, ending = np.arange(top, to, dtype=np.int32), np.arange(top, to, dtype=np.int32), np.zeros(len(first), np.int32)
            while len(todo):
                b = byte[at]
                below = self.rows[self.row[ending] << 8 | b]
                single = np.flatnonzero(self.only[ending] == b)
                below[single] = self.only_below[ending[single]]
                known = np.flatnonzero(below >= 0)
                todo, at, ending = todo[known], above[at[known]], below[known]
                token = self.ends[ending]
                some = np.flatnonzero(token >= 0)
                fits = np.zeros(len(todo), bool)
                fits[some] = self.fitting(last[at[some]], token[some])
                done = np.flatnonzero(fits)
                last[todo[done]], start[todo[done]] = token[done], at[done]
                count[todo[done]] = count[at[done]] + 1
                left = np.flatnonzero(~fits & (at > 0))
                todo, at, ending = todo[left], at[left], ending[left]
            if not (count[top:to] > 0).all():
                raise ValueError(f"no token ends {words[int(first[np.argmin(count[top:to])])][:depth]!r}")
            ended = sizes[active] == depth
            ends[active[ended]] = own[ended]
            top = to
        counts = count[ends].astype(np.int64)
        ids, place, at = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts), ends
        while len(more := np.flatnonzero(at)):
            place, at = place[more] - 1, at[more]
            ids[place] = last[at]
            at = start[at]
        return ids, counts

    def packed(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each of the distinct sorted words as 4 bytes each."""
        step = max(1, TRIE_BYTES // max(map(len, words), default=1))
        for at in range(0, len(words), step):
            ids, counts = self.walk(words[at : at + step])
            raw, to = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
            yield from map(raw.__getitem__, map(slice, [0, *to], to))

    def encode_words(self, words: set[bytes]) -> dict[bytes, array]:
        """Ids of each word."""
        ordered = sorted(words)
        return {w: array("i", ids) for w, ids in zip(ordered, self.packed(ordered))}

    def encode_long(self, words: list[bytes]) -> Iterator[tuple[bytes, array]]:
        """Ids of sorted long words: the same walk over the same trie, of which only the path to the word at hand is held."""
        last, sizes, held, fits = array("i", [-1]), array("H", [0]), b"", self.follows
        for word in words:
            shared = len(os.path.commonprefix((held, word)))
            del last[shared + 1 :], sizes[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                start, ending = depth, 0
                while start and (ending := self.endings.get(ending << 8 | word[start - 1])) is not None:
                    start -= 1
                    if (token := self.end_of.get(ending)) is not None and fits(last[start], token):
                        last.append(token)
                        sizes.append(depth - start)
                        break
                else:
                    raise ValueError(f"no token ends {word[max(0, depth - 50) : depth]!r}")
            at, back = len(word), array("i")
            while at:
                back.append(last[at])
                at -= sizes[at]
            held = word
            yield word, back[::-1]

    def cut(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if latin1(text):
            return LATIN_WORD.findall(text)
        if self.words_of is None:
            from tokenizers import Tokenizer

            self.words_of = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        letters = self.letters.__getitem__
        return [bytes(map(letters, w)).decode() for p in PIECE.findall(text) for w, _ in self.words_of(p)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has)."""
        cut: list[list] = [self.cut(t) if self.stop is None or self.stop.search(t) is None else self.parted(t) for t in texts]
        every = set().union(*cut)
        alone = {x: array("i", [x]).tobytes() for x in every.intersection(self.added.values())}
        if new := self.words.unknown(every.difference(alone)):
            long = {w for w in new if len(w) > LONG // 4 and len(w.encode()) > LONG}
            alone |= {w.decode(): ids.tobytes() for w, ids in self.encode_long(sorted(w.encode() for w in long))}
            ordered = sorted(new - long)
            wide = [w for w in ordered if len(w) > WIDE]
            for some in ([w for w in ordered if len(w) <= WIDE] if wide else ordered, wide):
                self.words.update(zip(some, self.packed([w.encode() for w in some])))
        ids_of = (lambda w: alone[w] if w in alone else self.words[w]) if alone else self.words.__getitem__  # long words aren't remembered
        raw = [b"".join(map(ids_of, ws)) for ws in cut]
        return np.frombuffer(b"".join(raw), np.int32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def parted(self, text: str) -> list:
        """The words of a text, and the ids of the added tokens in it."""
        out: list = []
        for s in self.stop.split(text):
            if s in self.added:
                out.append(self.added[s])
            else:
                out += self.cut(s)
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        ids, sizes = self.encode_all(texts)
        yield from np.split(ids, np.cumsum(sizes)[:-1])

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """`decode` of all texts: their tokens' bytes one after another, which are looked at singly only if some aren't UTF-8."""
        if not len(ids):
            return pa.array([""] * len(sizes), pa.string())
        _, ends, data = self.pieces.take(pa.array(ids)).buffers()
        at = np.frombuffer(ends, np.int32, len(ids) + 1)[np.concatenate(([0], np.cumsum(sizes)))]
        texts = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.tobytes()), data)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())
        return texts


_loaded: dict[str, TrieBpe] = {}


def loaded(path: str) -> TrieBpe:
    """A worker's own copy, read once."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
    return _loaded[path]


def slices(texts: pa.Array, rows: int = BATCH_ROWS, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(place, texts with null as empty) in parts within so many rows and, but for a single longer text, so many bytes."""
    at = size = 0
    lengths = pc.binary_length(texts).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if i > at and (size + n > chars or i - at >= rows):
            yield at, [t or "" for t in texts.slice(at, i - at).to_pylist()]
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield at, [t or "" for t in texts.slice(at).to_pylist()]


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`df` with n_tokens, ids (array of int) and decoded, the text that the ids decode to. `path` is a file or a vocabulary's name."""
    names = [fresh(df, c) for c in ("n_tokens", "ids", "decoded")]
    at = df.columns.index(text_col)
    fields = T.StructType([*df.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.StringType())])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary(path))
        for batch in batches:
            for a, texts in slices(batch.column(at)):
                ids, sizes = bpe.encode_all(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids))
                more = [pa.array(sizes), lists, bpe.decode_all(ids, sizes)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns, *more], [*batch.schema.names, *names])

    return df.mapInArrow(run, fields)


def vocabulary(name: str) -> str:
    """The file of a public vocabulary on this machine; a path stays as it is. Workers ask for themselves, by name."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", body("text").alias("text"))
    return digest(encode(docs, "byte_bpe_50k.json"))
