"""The text rules in plain Python, for code that runs inside a fold."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from palimpsest.functions import rules as R

SPACES = "".join(map(chr, R.WHITE_SPACE))
_TOKEN = re.compile(R.token_pattern(java=False))
_SENTENCE = [(re.compile(a) if regex else a, b) for a, b, regex in R.sentence_rules(java=False)]
_BREAKS = re.compile(f"(?:{R.SENTENCE_BREAK})+")


def digest(text: str) -> str:
    """Lowercase hex MD5 of the UTF-8 bytes."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def paragraphs(text: str) -> list[str]:
    for a, b in R.PARAGRAPH_RULES:
        text = text.replace(a, b)
    return text.split(R.PARAGRAPH_BREAK)


def sentences(text: str) -> list[str]:
    for a, b in _SENTENCE:
        text = text.replace(a, b) if isinstance(a, str) else a.sub(b, text)
    return _BREAKS.split(text)


def tokens(text: str) -> list[str]:
    return ["|" if t == R.PIPE_WORD else t for t in _TOKEN.findall(text)]


def trimmed(parts: list[str]) -> list[str]:
    """The parts without white space around them; those of nothing else are left out."""
    return [t for t in (p.strip(SPACES) for p in parts) if t]


def all_tokens(text: str) -> list[str]:
    """The tokens of a lower-cased text, in order."""
    return [t for p in trimmed(paragraphs(text)) for s in trimmed(sentences(p)) for t in tokens(s)]


def density(words: list[str]) -> float:
    """Mean count of the distinct tokens that are not structural; 0 without any."""
    counts = Counter(words)
    for s in R.STRUCTURAL:
        counts.pop(s, None)
    return sum(counts.values()) / len(counts) if counts else 0.0


def shrinks(before: int, now: int, comment: str | None, minor: bool) -> bool:
    """Whether a large text became small, other than in a minor edit with a comment."""
    if comment and minor or before <= R.SHRINK_FROM or now >= R.SHRINK_BELOW:
        return False
    return (now - before) / before <= R.SHRINK_SHARE


def editor(user_id: int | None, user_name: str | None) -> str:
    return "" if user_id is None else str(user_id) if user_id else f"0|{user_name or ''}"
