"""Markup annotation: wrap every located token of a marked-up text in a span that names its editor.

The text is walked once along merged streams: tokens that are found, starts of markups, the end of the markup that is open. Inside
a markup text passes through unwrapped; tokens are still counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import small_batches

# Fixed value: what stands for a line break while a text is walked.
LINE = "WIKICOLORLB"
# Markups as (start, end or none for a single one, whether its inside is left unwrapped, whether no markup opens
# inside it). At one place the first of the list wins. The list-prefix classes hold a backslash, as the original ones do.
MARKUPS = [
    (r"\[\[", r"\]\]", False, False),
    (r"\[", r"\]", False, False),
    (r"\{\{", r"\}\}", True, False),
    (r"(<nowiki */>)", None, True, True),
    (r"<(math|timeline|nowiki)[^>]*>", r"</(math|timeline|nowiki)>", True, False),
    (
        r"</?(ref|h1|h2|h3|h4|h5|h6|p|br|hr|!--|abbr|b|bdi|bdo|blockquote|cite|code|data|del|dfn|em|i|ins|kbd|mark|pre|q|ruby|rt|rp|s|samp|small"
        r"|strong|sub|sup|time|u|var|wbr|dl|dt|dd|ol|ul|li|div|span|table|tr|td|th|caption)",
        r">", True, False,
    ),
    (r"(=+|;)", None, True, True),
    (r"[\\*#\\:]*;", r"\\:", True, False),
    (r"[\\*#:]+", None, True, True),
    (r"-----*", None, True, True),
    (r"\{\|", r"\|\}", True, False),
    (rf"({LINE})+", None, True, True),
    (r"(&nbsp;|&euro;|&quot;|&amp;|&lt;|&gt;|&nbsp;|&(?:[a-z\d]+|#\d+|#x[a-f\d]+);)", None, True, True),
    (
        r"__(NOTOC|FORCETOC|TOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|NOCONTENTCONVERT|NOCC|NOTITLECONVERT|NOTC"
        r"|START|END|INDEX|NOINDEX|STATICREDIRECT|DISAMBIG)__",
        None, True, True,
    ),
    (r"''+", None, True, True),
]
_MARKUPS = [(re.compile(a), re.compile(b) if b else None, hides, closed) for a, b, hides, closed in MARKUPS]


class Folded:
    """A text to search without regard to case: lower-cased letter by letter, with the way back to its own places."""

    def __init__(self, text: str):
        parts = [c.lower().replace("ς", "σ") for c in text]
        self.low = "".join(parts)
        if len(self.low) == len(text):
            self.at = self.back = None
        else:
            self.at, self.back, n = [], {}, 0
            for i, p in enumerate(parts):
                self.at.append(n)
                self.back[n] = i
                n += len(p)
            self.at.append(n)
            self.back[n] = len(text)

    def end(self, needle: str, start: int) -> int | None:
        """Where the first occurrence at or after `start` ends."""
        needle = needle.lower().replace("ς", "σ")
        if not needle:
            return None
        i = self.low.find(needle, self.at[start] if self.at else start)
        while self.back is not None and i >= 0 and (i not in self.back or i + len(needle) not in self.back):
            i = self.low.find(needle, i + 1)
        return None if i < 0 else self.back[i + len(needle)] if self.back is not None else i + len(needle)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


class Matches:
    """The matches of an expression as a stream that is asked from ever later places. The match that it stands at is the first from
    any place up to its start, so that a text is searched once, however often it is asked."""

    def __init__(self, pattern: re.Pattern, text: str):
        self.pattern, self.text, self.now = pattern, text, pattern.search(text)

    def since(self, place: int) -> re.Match | None:
        if self.now is not None and self.now.start() < place:
            self.now = self.pattern.search(self.text, place)
        return self.now


class Located:
    """The stream of tokens that are found, each from where the walk stands: (number, end)."""

    def __init__(self, text: str, tokens: list[tuple[str, str, str]]):
        self.text, self.tokens, self.number, self.gone = Folded(text), tokens, -1, set()
        self.size, self.editors = len(text), {}

    def after(self, place: int) -> tuple[int, int] | None:
        for self.number in range(self.number + 1, len(self.tokens)):
            value, editor, kind = self.tokens[self.number]
            if place >= self.size or value in self.gone:
                continue
            end = self.text.end(value, place)
            if end is not None:
                self.editors.setdefault(editor, [kind, 0])[1] += 1
                return self.number, end
            self.gone.add(value)  # not from here on, so not from later on either
        return None


def annotate(text: str, tokens: list[tuple[str, str, str]]) -> tuple[str, list[tuple[str, str, int]]]:
    """The text with spans around the tokens (str, editor, class), and the editors of the tokens found: (editor, class, tokens),
    by count, then by who comes first. Tokens that aren't found from where the walk stands are passed over.

    Three streams are merged by place: tokens, starts of markups (one stream for each expression), and the end of the markup
    that is open. What comes first is taken; at one place a token's end goes before a markup, and a markup's end before both.
    """
    wiki = text.replace("\r\n", LINE).replace("\n", LINE).replace("\r", LINE)
    size, located, out = len(wiki), Located(wiki, tokens), []
    starts = [Matches(a, wiki) for a, *_ in _MARKUPS]
    ends = {b: Matches(b, wiki) for _, b, *_ in _MARKUPS if b}
    entered: set[int] = set()
    place, wrapped = 0, ""  # wrapped: what closes the span that is open
    token = located.after(0)
    # open markups, innermost last: (end expression or none, its span where it is a single one, tokens are wrapped, markups may open)
    opened: list[tuple] = [(None, None, True, True)]

    def wrap(yes: bool) -> None:
        nonlocal wrapped
        out.append(wrapped)
        wrapped = "</span>" if yes else ""
        if yes:
            number = located.number
            out.append(f'<span class="editor-token token-editor-{escaped(tokens[number][2])}" id="token-{number}">')

    def closing() -> tuple[int, int] | None:
        end, single, _, _ = opened[-1]
        if end is None:
            return single
        found = ends[end].since(place)
        return found.span() if found else (size, size)

    def opening() -> tuple[int, int, int] | None:
        """(start, end, number) of the markup that starts first; an expression whose next match was entered before is out."""
        found = ((m.start(), k, m.end()) for k, s in enumerate(starts) if (m := s.since(place)) and m.start() not in entered)
        first = min(found, default=None)
        return first and (first[0], first[2], first[1])

    limit, ahead = None, opening()
    while opened:
        _, _, wraps, may_open = opened[-1]
        if place < size and token is None:
            out.append(wiki[place:])
            place = size
        if place >= size:
            wrap(False)
        elif may_open and ahead and ahead[0] < token[1] and (limit is None or max(place, ahead[0]) < limit[0]):
            start, stop, k = ahead
            _, end, hides, closed = _MARKUPS[k]
            entered.add(start)
            if wraps:
                wrap(not hides)
            opened.append((ends[end].pattern if end else None, None if end else (start, stop), False, not closed))
            limit, ahead = closing(), opening() if not closed else None
            continue
        elif limit is not None and limit[1] < token[1]:
            out.append(wiki[place : limit[1]])
            place = limit[1]
        else:
            if wraps:
                wrap(True)
            out.append(wiki[place : token[1]])
            place = token[1]
            token = located.after(place)
            continue
        opened.pop()
        if opened:
            limit, ahead = closing(), opening()
    listed = sorted(((e, kind, n) for e, (kind, n) in located.editors.items()), key=lambda x: -x[2])
    return "".join(out).replace(LINE, "\n"), listed


_EDITOR = T.StructType().add("editor", T.StringType()).add("class_name", T.StringType()).add("n_tokens", T.LongType())
ANNOTATED = T.StructType().add("text", T.StringType()).add("editors", T.ArrayType(_EDITOR))


# Fixed value: letters of markup that a worker holds before it gives them out.
MOST_LETTERS = 4_000_000


def _marked(rows: list[tuple[str, list[tuple[str, str, int]]]]) -> pa.Array:
    found = [x for _, editors in rows for x in editors]
    names = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
    ends = [0, *accumulate(len(editors) for _, editors in rows)]
    editors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(names, _EDITOR.names))
    return pa.StructArray.from_arrays([pa.array([text for text, _ in rows], pa.string()), editors], ["text", "editors"])


def annotations(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """`annotate` of texts and their arrays of (str, editor, class_name), row by row; what a worker holds doesn't grow with the rows of a batch."""
    for texts, lists in batches:
        rows, size = [], 0
        for at in range(len(texts)):
            ts = lists[at].values
            columns = zip(*(ts.field(k).to_pylist() for k in range(3))) if ts is not None else ()
            rows.append(annotate(texts[at].as_py() or "", [*columns]))
            size += len(rows[-1][0])
            if size > MOST_LETTERS:
                yield _marked(rows)
                rows, size = [], 0
        if rows or not len(texts):
            yield _marked(rows)


@F.arrow_udf(ANNOTATED)
def annotated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Column function over a text and its array of (str, editor, class_name) structs."""
    yield from annotations(batches)


def annotated_texts(coloured: DataFrame, texts: DataFrame) -> DataFrame:
    """(lang, page_id, rev_id, text, editors) from coloured tokens and the texts (lang, page_id, rev_id, text) of their revisions."""
    key = ["lang", "page_id", "rev_id"]
    token = F.struct("str", "editor", "class_name")
    lists = coloured.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", token.alias("t")))), lambda x: x["t"]).alias("tokens"))
    return annotated_lists(lists, texts)


def annotated_lists(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """The same from (lang, page_id, rev_id, tokens), where the tokens (str, editor, class_name) of a revision are one list. No side is
    broadcast, for a stored text or list is far smaller than one that is read."""
    small_batches(texts.sparkSession)
    key = ["lang", "page_id", "rev_id"]
    return texts.select(*key, "text").join(lists.hint("merge"), key).select(*key, annotated("text", "tokens").alias("a")).select(*key, "a.*")


def editor_shares(editors: Column) -> Column:
    """Editors with their share of all tokens found, in percent."""
    total = F.aggregate(editors, F.lit(0).cast("long"), lambda n, e: n + e["n_tokens"])
    return F.transform(editors, lambda e: F.struct(e["editor"].alias("editor"), e["class_name"].alias("class_name"), F.when(total == 0, 0.0).otherwise(e["n_tokens"] * 100.0 / total).alias("percent")))
