"""The ordered fold over one page's revisions: which revision wrote, removed and restored each token.

State is content-addressed: a `Block` is a paragraph (its children sentences) or a sentence (its children token ids), and
`Page` keeps for every hash the blocks that ever had it. One step matches the new text level by level: whole paragraphs
first, then the sentences of what is left, then the tokens of what is left of those. Nothing here knows of Spark.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from palimpsest.functions import plain
from palimpsest.functions.rules import DENSITY_LIMIT
from palimpsest.operators import differ

STORED, KNOWN_HASH, SHRUNK, DENSE = "stored", "hash_match", "length_shrink", "token_density"
# Fixed value: letters of the sentences that a page keeps as read.
READ_LETTERS = 1 << 20


@dataclass(slots=True)
class Token:
    value: str
    origin: int
    restored: list[int] | tuple = ()  # revisions that brought it back; a list from the first one on, for most tokens have none
    removed: list[int] | tuple = ()  # revisions that took it out

    def restore(self, revision: int) -> None:
        if self.restored:
            self.restored.append(revision)
        else:
            self.restored = [revision]

    def remove(self, revision: int) -> None:
        if self.removed:
            self.removed.append(revision)
        else:
            self.removed = [revision]


@dataclass(slots=True, eq=False)
class Block:
    id: int
    hash: str
    parts: list = field(default_factory=list)  # of a paragraph: sentences in order; of a sentence: token ids
    by_hash: dict | None = None  # of a paragraph: its sentences by hash
    flat: tuple | None = None

    def token_ids(self) -> Iterator[int]:
        if self.by_hash is None:
            yield from self.parts
        else:
            for s in self.parts:
                yield from s.parts

    @property
    def settled(self) -> tuple[int, ...]:
        """The token ids of a block of an earlier revision, which doesn't change any more."""
        if self.flat is None:
            self.flat = tuple(self.parts if self.by_hash is None else self.token_ids())
        return self.flat

    def add(self, sentence: Block) -> None:
        self.parts.append(sentence)
        self.by_hash.setdefault(sentence.hash, []).append(sentence)


@dataclass(slots=True)
class Revision:
    id: int = 0
    ord: int = 0
    editor: str = ""
    timestamp: str = ""
    length: int = 0
    original_adds: int = 0
    paragraphs: list[Block] = field(default_factory=list)

    def token_ids(self) -> list[int]:
        return [t for p in self.paragraphs for t in p.token_ids()]


class _Step:
    """What one revision has matched so far, and which old blocks it left over."""

    def __init__(self) -> None:
        self.tokens: set[int] = set()
        self.gone: set[int] = set()  # tokens that this revision took out
        self.blocks: set[Block] = set()
        self.new: dict[str, list] = {"p": [], "s": []}
        self.left: dict[str, list[Block]] = {"p": [], "s": []}

    def take(self, level: str, candidates: Iterable[Block]) -> Block | None:
        """The first candidate of which nothing is matched yet. One that is matched through and through is used up on
        the way; one that is partly matched stays as it is."""
        for block in candidates:
            if block in self.blocks:
                continue
            fresh = self.tokens.isdisjoint(block.settled)
            if fresh or self.tokens.issuperset(block.settled):
                self.blocks.add(block)
            if fresh:
                if block.by_hash is not None:
                    self.blocks.update(block.parts)
                self.tokens.update(block.settled)
                return block
        return None


class Page:
    """One page's history so far."""

    def __init__(self) -> None:
        self.tokens: list[Token] = []
        self.seen_last = np.zeros(1024, np.int64)  # of each token, the latest revision it was seen in
        self.paragraph_count = self.sentence_count = 0
        self.known: dict[str, dict[str, list[Block]]] = {"p": {}, "s": {}}
        self.revisions: dict[int, Revision] = {}
        self.order: list[int] = []
        self.vandal_ids: list[int] = []
        self.vandal_hashes: set[str] = set()
        self.read: dict[str, tuple[str, list[str]]] = {}  # sentences read lately: hash and tokens
        self.read_size = 0

    @property
    def last(self) -> Revision:
        return self.revisions[self.order[-1]] if self.order else Revision()

    def _paragraph(self, value_hash: str) -> Block:
        self.paragraph_count += 1
        return Block(self.paragraph_count - 1, value_hash, by_hash={})

    def _sentence(self, value_hash: str) -> Block:
        self.sentence_count += 1
        return Block(self.sentence_count - 1, value_hash)

    def _written(self, values: list[str], revision: Revision) -> range:
        """New tokens of these values; their ids."""
        at = len(self.tokens)
        self.tokens.extend([Token(value, revision.id) for value in values])
        revision.original_adds += len(values)
        return range(at, len(self.tokens))

    def _read(self, sentence: str) -> tuple[str, list[str]]:
        """Hash and tokens of a sentence. Revisions repeat most of their sentences, so those of late are kept."""
        found = self.read.get(sentence)
        if found is None:
            tokens = plain.tokens(sentence)
            found = plain.digest(" ".join(tokens)), tokens
            self.read_size += len(sentence)
            if self.read_size > READ_LETTERS:
                self.read, self.read_size = {}, len(sentence)
            self.read[sentence] = found
        return found

    def apply(self, rev_id: int, text: str, timestamp: str = "", sha1: str | None = None, comment: str | None = None, minor: bool = False, user_id: int | None = None, user_name: str | None = None, ord: int | None = None) -> str:
        """Take in one revision; whether it was stored, or by which rule it was vandalism and left no trace but its mark."""
        content = sha1 if sha1 is not None else plain.digest(text)
        before = self.last
        now = Revision(rev_id, len(self.order) if ord is None else ord, plain.editor(user_id, user_name), timestamp, len(text))
        if content in self.vandal_hashes:
            self.vandal_ids.append(rev_id)
            return KNOWN_HASH
        status = SHRUNK if plain.shrinks(before.length, now.length, comment, minor) else self._match(text.lower(), before, now)
        if status != STORED:
            self.vandal_ids.append(rev_id)
            self.vandal_hashes.add(content)
            return status
        self.order.append(rev_id)
        self.revisions[rev_id] = now
        return STORED

    def _match(self, text: str, before: Revision, now: Revision) -> str:
        step = _Step()
        texts = self._match_paragraphs(step, text, before, now)
        if step.new["p"]:
            words = self._match_sentences(step, texts)
            if words:
                if plain.density([w for ws in words for w in ws]) > DENSITY_LIMIT:
                    return DENSE
                at = len(self.tokens)
                self._match_tokens(step, words, now)
                while len(self.tokens) > len(self.seen_last):
                    self.seen_last = np.concatenate((self.seen_last, np.zeros_like(self.seen_last)))
                self.seen_last[at : len(self.tokens)] = now.id
        self._record(step, before.id, now.id)
        for level in ("p", "s"):
            for block in step.new[level]:
                self.known[level].setdefault(block.hash, []).append(block)
        return STORED

    def _match_paragraphs(self, step: _Step, text: str, before: Revision, now: Revision) -> list[str]:
        """Fill now.paragraphs; the texts of new paragraphs."""
        last: dict[str, list[Block]] = defaultdict(list)
        for block in before.paragraphs:
            last[block.hash].append(block)
        texts = []
        for part in plain.trimmed(plain.paragraphs(text)):
            h = plain.digest(part)
            block = step.take("p", last.get(h, ())) or step.take("p", self.known["p"].get(h, ()))
            if block is None:
                block = self._paragraph(h)
                step.new["p"].append(block)
                texts.append(part)
            now.paragraphs.append(block)
        step.left["p"] = [b for b in before.paragraphs if b not in step.blocks]
        return texts

    def _match_sentences(self, step: _Step, texts: list[str]) -> list[list[str]]:
        """Fill the new paragraphs; the tokens of each new sentence."""
        words = []
        for paragraph, text in zip(step.new["p"], texts):
            for part in plain.trimmed(plain.sentences(text)):
                h, tokens = self._read(part)
                block = step.take("s", (s for p in step.left["p"] for s in p.by_hash.get(h, ()))) or step.take("s", self.known["s"].get(h, ()))
                if block is None:
                    block = self._sentence(h)
                    step.new["s"].append(block)
                    words.append(tokens or [""])
                paragraph.add(block)
        for paragraph in step.left["p"]:
            for block in paragraph.parts:
                if block not in step.blocks:  # what is left over is looked at again by its tokens
                    step.blocks.add(block)
                    step.left["s"].append(block)
        return words

    def _match_tokens(self, step: _Step, words: list[list[str]], now: Revision) -> None:
        """Fill the new sentences along the transcript from what is left to what is new.

        The transcript's entries and the old tokens wait in a queue for each value. An entry that finds no old token
        of its value left will never find one, so each is looked at once.
        """
        old = [t for s in step.left["s"] for t in s.parts if t not in step.tokens]
        if not old:
            for block, tokens in zip(step.new["s"], words):
                block.parts.extend(self._written(tokens, now))
            return
        waiting: dict[str, deque[int]] = defaultdict(deque)
        for t in old:
            waiting[self.tokens[t].value].append(t)
        script: dict[str, deque[str]] = defaultdict(deque)
        for what, value in differ.compare([self.tokens[t].value for t in old], [w for ws in words for w in ws]):
            script[value].append(what)
        for block, tokens in zip(step.new["s"], words):
            for w in tokens:
                entries, olds, placed = script.get(w), waiting.get(w), None
                while entries and placed is None:
                    what = entries.popleft()
                    if what == differ.INSERT:
                        break
                    while olds and olds[0] in step.tokens:
                        olds.popleft()
                    if olds:
                        t = olds.popleft()
                        step.tokens.add(t)
                        if what == differ.KEEP:
                            placed = t
                        else:
                            self.tokens[t].remove(now.id)
                            step.gone.add(t)
                block.parts.append(self._written([w], now)[0] if placed is None else placed)

    def _record(self, step: _Step, before: int, now: int) -> None:
        """Removals of what nothing matched; restorations of what was matched, but not part of the revision before."""
        for block in step.left["s"] or step.left["p"]:
            for t in block.settled:
                if t not in step.tokens:
                    self.tokens[t].remove(now)
        found = step.tokens - step.gone  # whatever was matched is part of an old block that was touched
        if now in self.revisions:  # an id that comes again
            found = {t for t in found if list(self.tokens[t].removed[-1:]) != [now]}
        places = np.fromiter(found, np.int64, len(found))
        for t in places[self.seen_last[places] != before].tolist():
            self.tokens[t].restore(now)
        self.seen_last[places] = now
