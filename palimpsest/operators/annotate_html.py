"""HTML annotation: wrap tokens where they appear in the text of an HTML document, in order and without regard to case.

The document is read as a stream of events and written back from it; unlike a browser's tree builder it adds no missing
elements. Text of all elements but the hidden ones is one string for the search, so a token may start in one text and end in
the next; only its part in the first is wrapped. Numbers count the tokens found.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.operators.annotate import ANNOTATED, Folded

# Elements without content, and elements whose text isn't searched.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head noscript template".split())


def escaped_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def escaped_value(text: str) -> str:
    return escaped_text(text).replace('"', "&quot;")


class _Events(HTMLParser):
    """The document as pieces: markup to copy, texts to copy, and texts to search."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, str]] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.pieces.append(("markup", f"<{tag}{''.join(f' {n}="{escaped_value(v or '')}"' for n, v in attrs)}>"))
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.pieces.append(("markup", f"</{tag}>"))
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]

    def handle_data(self, data):
        self.pieces.append(("hidden" if self.hidden else "text", data))

    def handle_comment(self, data):
        self.pieces.append(("markup", f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.pieces.append(("markup", f"<!DOCTYPE {decl.split(None, 1)[-1].split()[0] if decl.split()[1:] else decl}>"))


def annotate_html(html: str, tokens: list[tuple[str, str, str]]) -> tuple[str, list[tuple[str, str, int]]]:
    """The document with spans around the tokens (str, editor, class), and the editors of those found, by count, then by first token."""
    events = _Events()
    events.feed(html)
    events.close()
    folded = Folded("".join(text for kind, text in events.pieces if kind == "text"))
    spans, editors, at = [], {}, 0
    for value, editor, kind in tokens:
        end = folded.end(value, at) if value else None
        if end is None:
            continue
        low = folded.low.rfind(value.lower().replace("ς", "σ"), 0, folded.at[end] if folded.at else end)
        spans.append((folded.back[low] if folded.back else low, end, kind))
        editors.setdefault(editor, [kind, 0])[1] += 1
        at = end
    first = {}
    for k, (_, editor, _) in enumerate(tokens):
        first.setdefault(editor, k)
    out, place, k = [], 0, 0
    for kind, text in events.pieces:
        if kind != "text":
            out.append(text if kind == "markup" else escaped_text(text))
            continue
        done, to = 0, place + len(text)
        while k < len(spans) and spans[k][0] < to:
            start, end, name = spans[k]
            a, b = max(0, start - place), min(len(text), end - place)
            out.append(f'{escaped_text(text[done:a])}<span class="editor-token token-editor-{escaped_value(name)}" id="token-{k}">{escaped_text(text[a:b])}</span>')
            done, k = b, k + 1
        out.append(escaped_text(text[done:]))
        place = to
    return "".join(out), sorted(((e, kind, n) for e, (kind, n) in editors.items()), key=lambda x: (-x[2], first[x[0]]))


@F.pandas_udf(ANNOTATED)
def annotated_html(html: pd.Series, tokens: pd.Series) -> pd.DataFrame:
    """Column function over a document and its array of (str, editor, class_name) structs."""
    rows = []
    for h, ts in zip(html, tokens):
        marked, editors = annotate_html(h or "", [(x["str"], x["editor"], x["class_name"]) for x in ([] if ts is None else ts)])
        rows.append((marked, [{"editor": e, "class_name": c, "n_tokens": n} for e, c, n in editors]))
    return pd.DataFrame(rows, columns=["text", "editors"])
