"""Token ids as length-delimited binary records, in shards with a separate offset index.

Record: length of data (8 bytes), masked CRC-32 of those 8 bytes, data, masked CRC-32 of data; all little-endian.
Data: 1 byte (bit 0: the id is not null; the rest: bytes of a token id), the document's id (8 bytes, signed), its token
ids (unsigned, 2 bytes each if the vocabulary's largest fits, else 4).
Index: for each record 16 bytes, the offset of its record and the number of ids before it in the shard.
The mask turns a CRC right by 15 bits and adds 0xA282EAD8, so that a checksum of data that hold checksums stays sound.

Documents are range-partitioned and sorted by id, each task writes one shard under a temporary name and renames
it when it is complete: a task that runs again, or twice at once, puts the same bytes under the same name.

Defined results: a null text is an empty one (the end id alone); null ids sort first; equal ids are ordered by text, and
keep a record each. Other columns are not read. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import BLANK, DIGIT, LETTER, Recent, latin1, slices, vocabulary
from palimpsest.llm.common import body
from palimpsest.session import scratch, table

END_ID = 1
HEAD, CHECK, OWN, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQ")
#: The vocabulary's word rule over lower-case Latin-1, whose letters, digits and white space never change, and by the byte: its lower case, and what it is.
LATIN_WORD = re.compile(f"[{LETTER}]+|[{DIGIT}]|'(?:[stmd]|re|ve|ll)|[^{LETTER}{DIGIT}{BLANK}]+")
LATIN = "".join(map(chr, range(256)))
LOWER, BLANKS, IS_BLANK, IS_LETTER, IS_DIGIT = LATIN.lower().encode("latin-1"), BLANK.encode("latin-1"), 0, 1, 2
KIND = bytes(next((k for k, of in ((IS_BLANK, BLANK), (IS_LETTER, LETTER), (IS_DIGIT, DIGIT)) if re.match(f"[{of}]", c)), 3) for c in LATIN)
CHUNK = re.compile("[^ \n]+")
#: Words and chunks that a worker learns before it forgets what it hasn't met for the longest, down to half. Bytes beyond which a word isn't kept.
MOST_WORDS, LONG = 400_000, 100
MOST_CHUNKS = 250_000
#: New words that the library encodes at once: it holds some hundred bytes for each of their tokens.
LEARN_WORDS = 20_000
#: Rows and, but for a single longer text, text bytes that are encoded at once: the words known by then are listed anew each time.
ENCODE_ROWS, ENCODE_CHARS = 5_000, 4_000_000
#: Records and bytes that a reader holds at once, a single longer record apart.
READ_RECORDS, READ_BYTES = 4096, 16 << 20


def binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """Values that stand one after another in `data`, from the places where each begins and the last ends."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def latin_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the words of Latin-1 texts one after another, how many there are up to the end of each text)."""
    raw = "\n".join([*texts, "\n\n"]).encode("latin-1")  # a contraction is looked for in the three bytes from a mark on
    low, kind = (np.frombuffer(raw.translate(to), np.uint8) for to in (LOWER, KIND))
    starts, within = kind == IS_DIGIT, kind != IS_BLANK
    starts[1:] |= kind[1:] != kind[:-1]
    starts[0] = True
    starts &= within
    marks = np.flatnonzero(low == ord("'"))
    marks = marks[starts[marks]]
    after = low[marks + 1].astype(np.int64)
    pair = after << 8 | low[marks + 2]
    for at, size in ((marks[np.isin(after, list(b"stmd"))], 2), (marks[np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])], 3)):
        starts[at + 1] = False
        starts[at + size] |= kind[at + size] == IS_LETTER
    upto = np.searchsorted(np.flatnonzero(starts), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
    data = raw.translate(LOWER, BLANKS)
    return binary(np.append(np.flatnonzero(starts[within]), len(data)), data), upto


class WordEncoder:
    """The tokenizers library over distinct words: words encode alone as they do in a text, white space gives nothing.

    Words of Latin-1 texts stay in Arrow arrays: one call lists those of a batch after the known ones, so that new words are the
    end of the list, and another takes the ids of each word by its place in it. Other texts are cut into chunks.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.path = path
        self.of_words = self.loaded()  # for lower-case words with a space between them
        self.ends = np.zeros(max(self.of_words.get_vocab(True).values()) + 1, bool)  # by id: whether the token ends a word
        self.ends[[i for token, i in self.of_words.get_vocab(False).items() if token.endswith("</w>")]] = True
        self.added = [t.content for t in self.of_words.get_added_tokens_decoder().values()]
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.coded, self.met = pa.array([], pa.large_binary()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)  # known words, their ids, the batch that last had each
        self.batches, self.chunks = 0, Recent(MOST_CHUNKS)

    def loaded(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    @cached_property
    def whole(self):
        """The library as it is, for what isn't cut into words."""
        return self.loaded()

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def learned(self, words: pa.Array) -> pa.Array:
        """Ids of new words."""
        return pa.concat_arrays([self.learned_at_once(words.slice(a, LEARN_WORDS)) for a in range(0, len(words), LEARN_WORDS)])

    def learned_at_once(self, words: pa.Array) -> pa.Array:
        """Encode words in one go: each ends with the only one of its tokens that carries the end-of-word mark."""
        line = b" ".join(words.to_pylist()).decode("latin-1")
        out = np.array(self.of_words.encode_batch_fast([line], add_special_tokens=False)[0].ids, f"<u{self.width}")
        ends = (np.flatnonzero(self.ends[out]) + 1) * self.width
        if len(ends) != len(words):
            return pa.array([self.packed(self.ids(w.decode("latin-1"))) for w in words.to_pylist()], pa.large_binary())
        return binary(np.append(0, ends), out.tobytes())

    def encode_latin(self, texts: list[str]) -> Iterator[bytes]:
        """`encode` of Latin-1 texts."""
        words, upto = latin_words(texts)
        if not len(words):
            yield from [b""] * len(texts)
            return
        listed = pa.chunked_array([self.words, words]).dictionary_encode().chunks[-1]
        every, at = listed.dictionary, listed.indices
        coded = self.coded
        if len(every) > len(self.words):
            coded = pa.concat_arrays([coded, self.learned(every.slice(len(self.words)))])
        taken = coded.take(at)
        self.remember(every, coded, at.to_numpy())
        _, ends, data = taken.buffers()
        ends = np.frombuffer(ends, np.int64, len(taken) + 1)[np.append(0, upto)].tolist()
        for a, b in zip(ends, ends[1:]):
            yield data[a:b].to_pybytes()

    def remember(self, words: pa.Array, coded: pa.Array, at: np.ndarray) -> None:
        """Keep the words, of which the batch has those at the places, within the limits."""
        self.batches += 1
        self.met = np.append(self.met, np.full(len(words) - len(self.met), self.batches))
        self.met[at] = self.batches
        keep = np.flatnonzero(pc.binary_length(words).to_numpy() <= LONG)
        if len(keep) > MOST_WORDS:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: MOST_WORDS // 2]])
        if len(keep) < len(words):
            words, coded, self.met = words.take(pa.array(keep)), coded.take(pa.array(keep)), self.met[keep]
        self.words, self.coded = words, coded

    def encode_chunks(self, cut: list[list[str]]) -> Iterator[bytes]:
        """Ids of texts cut into chunks."""
        new = self.chunks.unknown(set().union(*cut))
        plain = sorted(w for w in new if latin1(w) and LATIN_WORD.fullmatch(w) and w == w.lower())
        if plain:
            self.chunks.update(zip(plain, self.learned(pa.array([w.encode("latin-1") for w in plain], pa.large_binary())).to_pylist()))
        for w in new.difference(plain):
            self.chunks[w] = self.packed(self.ids(w))
        for ws in cut:
            yield b"".join(map(self.chunks.__getitem__, ws))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned integers of `width` bytes."""
        whole = [any(a in t for a in self.added) for t in texts]
        plain = [not w and latin1(t) for w, t in zip(whole, texts)]
        latin = self.encode_latin([t for t, p in zip(texts, plain) if p]) if any(plain) else iter(())
        cut = self.encode_chunks([CHUNK.findall(t) for t, w, p in zip(texts, whole, plain) if not w and not p])
        for t, w, p in zip(texts, whole, plain):
            yield self.packed(self.ids(t)) if w else next(latin if p else cut)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return b"".join((size, CHECK.pack(masked(size)), data, CHECK.pack(masked(data))))


def parse(buffer: bytes, at: int = 0) -> tuple[bytes, int]:
    """The data of the record at an offset, and the offset of the next; ValueError if a checksum differs."""
    size, check = HEAD.unpack_from(buffer, at)
    to = at + HEAD.size + size
    if masked(buffer[at : at + 8]) != check or len(buffer) < to + CHECK.size:
        raise ValueError(f"broken record head at {at}")
    data = buffer[at + HEAD.size : to]
    if CHECK.unpack_from(buffer, to)[0] != masked(data):
        raise ValueError(f"broken record at {at}")
    return data, to + CHECK.size


def opened(folder: str):
    """(file system, path) of a folder in any store that pyarrow knows."""
    from pyarrow import fs

    if folder.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


_encoders: dict[str, WordEncoder] = {}


def write_part(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Write the shard of this task from (id, text) in order; its row of the manifest."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, WordEncoder(vocabulary(path)))
    end = encoder.packed([end_id])
    filesystem, base = opened(folder)
    task = TaskContext.get()
    name, mark = f"{base}/{task.partitionId():05d}", f".{task.taskAttemptId()}.{uuid.uuid4().hex[:8]}.tmp"
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    at = records = ids = 0
    low, high = first.column(0)[0].as_py(), None
    with filesystem.open_output_stream(f"{name}.rec{mark}") as out, filesystem.open_output_stream(f"{name}.idx{mark}") as index:
        for batch in chain([first], batches):
            own = batch.column(0).to_pylist()
            for a, texts in slices(batch.column(1), ENCODE_ROWS, ENCODE_CHARS):
                for doc, body_ in zip(own[a:], encoder.encode(texts)):
                    framed = record(OWN.pack(encoder.width << 1 | (doc is not None), doc or 0) + body_ + end)
                    index.write(ENTRY.pack(at, ids))
                    out.write(framed)
                    at, records, ids, high = at + len(framed), records + 1, ids + len(body_) // encoder.width + 1, doc
    for kind in ("rec", "idx"):
        filesystem.move(f"{name}.{kind}{mark}", f"{name}.{kind}")
    yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "records": pa.array([records], pa.int64()), "ids": pa.array([ids], pa.int64()), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64())})


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, end_id: int = END_ID) -> list[tuple]:
    """Write the shards; a list of (shard, records, ids, lowest id, highest id), one small row for each shard."""
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    filesystem, base = opened(folder)
    filesystem.create_dir(base, recursive=True)
    rows = df.select(F.col(id_col).cast("long").alias("id"), body(text_col).alias("text")).repartitionByRange(shards, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    done = sorted(map(tuple, rows.mapInArrow(partial(write_part, folder=folder, path=path, end_id=end_id), "shard int, records long, ids long, low long, high long").collect()))
    lowest = float("-inf")
    for _, _, _, low, high in done:
        if (lowest if low is None else low) < lowest:
            raise ValueError("shards out of order")
        lowest = lowest if high is None else high
    return done


def read_slice(filesystem, name: str, first: int, to: int) -> Iterator[tuple[int | None, bytes, int]]:
    """(document id, ids as bytes of 4 each, ids before it in the shard) of a range of records, found by the index."""
    with filesystem.open_input_file(f"{name}.idx") as index, filesystem.open_input_file(f"{name}.rec") as records:
        entries, end = index.size() // ENTRY.size, records.size()
        while first < to:
            n = min(READ_RECORDS, to - first)
            spots = list(ENTRY.iter_unpack(index.read_at((n + (first + n < entries)) * ENTRY.size, first * ENTRY.size)))
            if len(spots) == n:
                spots.append((end, 0))
            while n > 1 and spots[n][0] - spots[0][0] > READ_BYTES:
                n = (n + 1) // 2
            buffer, at = records.read_at(spots[n][0] - spots[0][0], spots[0][0]), 0
            for k in range(n):
                data, at = parse(buffer, at)
                has, doc = OWN.unpack_from(data)
                ids = np.frombuffer(data, "<u2" if has >> 1 == 2 else "<u4", offset=OWN.size)
                yield doc if has & 1 else None, ids.astype("<u4").tobytes(), spots[k][1]
            first += n


def read_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows of the listed ranges of records."""
    filesystem, base = opened(folder)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))

    for batch in batches:
        for part in batch.to_pylist():
            rows, held = [], 0
            for doc, ids, start in read_slice(filesystem, f"{base}/{part['shard']:05d}", part["first"], part["to"]):
                rows.append((doc, part["before"] + start, len(ids) // 4, ids))
                held += len(ids)
                if held > READ_BYTES // 2 or len(rows) >= READ_RECORDS:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def read(spark: SparkSession, folder: str, done: list[tuple]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary) from the files."""
    before, parts = 0, []
    for shard, records, ids, _, _ in done:
        parts += [(shard, at, min(records, at + (1 << 16)), before) for at in range(0, records, 1 << 16)]
        before += ids

    listed = spark.createDataFrame(parts, "shard int, first long, to long, before long")
    return listed.repartition(max(1, len(parts))).mapInArrow(partial(read_parts, folder=folder), "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/token-files-{uuid.uuid4().hex}"
    done = write(table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json")
    return read(spark, folder, done).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
