"""The text rules as SQL expressions, from the same declarations; for the counterparts that another engine runs."""

from __future__ import annotations

from palimpsest.functions import rules as R

_SPACE = R.space_class(java=True)


def quoted(text: str) -> str:
    """A string literal that spells control characters out."""
    if text.isprintable():
        return "'" + text.replace("'", "''") + "'"
    return "(" + " || ".join(f"chr({ord(c)})" if not c.isprintable() else quoted(c) for c in text) + ")"


def trim_space(e: str) -> str:
    return f"regexp_replace({e}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _parts(e: str) -> str:
    return f"list_filter(list_transform({e}, lambda p_: {trim_space('p_')}), lambda q_: q_ <> '')"


def paragraph_texts(e: str) -> str:
    for a, b in R.PARAGRAPH_RULES:
        e = f"replace({e}, {quoted(a)}, {quoted(b)})"
    return _parts(f"string_split({e}, {quoted(R.PARAGRAPH_BREAK)})")


def sentence_texts(e: str) -> str:
    for a, b, regex in R.sentence_rules(java=True):
        e = f"regexp_replace({e}, {quoted(a)}, {quoted(b)}, 'g')" if regex else f"replace({e}, {quoted(a)}, {quoted(b)})"
    return _parts(f"string_split_regex({e}, '(?:{R.SENTENCE_BREAK})+')")


def tokens(e: str) -> str:
    return f"list_transform(regexp_extract_all({e}, {quoted(R.token_pattern(java=True))}), lambda t_: CASE WHEN t_ = {quoted(R.PIPE_WORD)} THEN '|' ELSE t_ END)"


def all_sentences(e: str) -> str:
    return f"flatten(list_transform({paragraph_texts(e)}, lambda a_: {sentence_texts('a_')}))"


def all_tokens(e: str) -> str:
    return f"flatten(list_transform({all_sentences(e)}, lambda s_: {tokens('s_')}))"


STRUCTURAL = ", ".join(quoted(t) for t in R.STRUCTURAL)
