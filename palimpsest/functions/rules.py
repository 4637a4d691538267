"""Text rules, declared once and used by the Python fold, the Column functions and the SQL counterparts.

A text falls into paragraphs, a paragraph into sentences, a sentence into tokens. Paragraph and sentence rules insert
breaks by replacements that are applied in order; tokens are what one expression finds.
"""

from __future__ import annotations

# What Unicode calls white space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Replacements before a text is cut at "\n\n" into paragraphs.
PARAGRAPH_BREAK = "\n\n"
PARAGRAPH_RULES = [
    ("\r\n", "\n"),
    ("\r", "\n"),
    ("<table>", "\n\n<table>"),
    ("</table>", "</table>\n\n"),
    ("<tr>", "\n\n<tr>"),
    ("</tr>", "</tr>\n\n"),
    ("{|", "\n\n{|"),
    ("|}", "|}\n\n"),
    ("|-\n", "\n\n|-\n"),
]

# Replacements before a paragraph is cut at runs of "@@@@" into sentences. Entries of three hold a regular
# expression and its replacement by engine ("\1" is the first group); \W stands for white space in them.
SENTENCE_BREAK = "@@@@"
SENTENCE_RULES = [
    ("\n", "\n@@@@"),
    ("regex", r"([^\W.=][^\W.=][^\W.=]\.) ", r"\1@@@@"),
    ("; ", ";@@@@"),
    ("? ", "?@@@@"),
    ("! ", "!@@@@"),
    (": ", ":@@@@"),
    ("\t", "\t@@@@"),
    ("<!--", "@@@@<!--"),
    ("-->", "-->@@@@"),
    ("<ref", "@@@@<ref"),
    ("/ref>", "/ref>@@@@"),
    ("regex", r"(http[^\n]*?://[^\n]*?[ |<>\n\r])", r"@@@@\1@@@@"),
]

# Symbols that are tokens of their own, and symbols that are one token together.
SYMBOLS = (
    ". , ; : ? ! - _ / \\ ( ) [ ] { } * # @ & = + % ~ $ ^ < > \" ' ´ ` ¸ ˛ ’ ¤ ₳ ฿ ₵ ¢ ₡ ₢ ₫ ₯ ֏ ₠ € ƒ ₣ ₲ ₴ ₭ ₺ ₾ ℳ "
    "₥ ₦ ₧ ₱ ₰ £ ៛ ₽ ₹ ₨ ₪ ৳ ₸ ₮ ₩ ¥ § ‖ ¦ ⟨ ⟩ – — ¯ » « ” ÷ × ′ ″ ‴ ¡ ¿ © ℗ ® ℠ ™"
).split(" ")
PAIRS = ["[[", "]]", "{{", "}}", "<!--", "-->"]

# Ranges of characters that are tokens of their own, too.
SINGLE_RANGES = [
    (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0xFE00, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFFEF),
    (0x16FE0, 0x1B2FF), (0x1F000, 0x1F2FF), (0x20000, 0x3347F), (0xE0100, 0xE01EF),
]

# The word that stands for "|" on the way, and tokens that the density of a text leaves out.
PIPE_WORD = "ææææ"
STRUCTURAL = ["<", ">", "tr", "td", "[", "]", '"', "*", "==", "{", "}", "|", "-"]

# Limits of the vandalism rules.
DENSITY_LIMIT, SHRINK_FROM, SHRINK_BELOW, SHRINK_SHARE = 20.0, 1000, 1000, -0.40


def _escape(code: int, java: bool) -> str:
    return f"\\x{{{code:X}}}" if java else f"\\u{code:04x}" if code < 0x10000 else f"\\U{code:08x}"


def space_class(java: bool) -> str:
    """The inside of a character class of white space, for Java and RE2 (`java`) or Python."""
    return "".join(_escape(c, java) for c in WHITE_SPACE)


def sentence_rules(java: bool, nest: bool = False) -> list[tuple[str, str, bool]]:
    """(what, by what, whether an expression) for Java (`nest`), RE2 (`java`) or Python."""
    out = []
    for r in SENTENCE_RULES:
        if len(r) == 2:
            out.append((*r, False))
            continue
        what, put = r[1].replace(r"\W", space_class(java)), r[2]
        if nest and what.endswith(") "):  # the space first, then a look at what is before it: no match can reach into another
            plain = f"[^{space_class(java)}.=]"
            # three characters are three to six units of UTF-16, in which Java counts what it looks back at
            what, put = rf" (?<=\. )(?<={what[1:-2].replace(3 * plain, nested(plain[2:-1]) + '{3,6}')} )", put.removeprefix(r"\1")
        out.append((what, put, True))
    return out


#: ASCII letters and digits, which are in none of the classes below. Java tests the parts of a nested class in order, so
#: that these make most tests short; the set is the same without them.
_COMMON = "a-zA-Z0-9"


def nested(excluded: str) -> str:
    """A Java class of all characters but the excluded."""
    return f"[{_COMMON}[^{excluded}]]"


def token_pattern(java: bool, nest: bool = False) -> str:
    """Finds the tokens of a sentence: runs up to a symbol, a space or a line feed, joined symbols, single characters."""
    alone = "".join(_escape(ord(s), java) for s in SYMBOLS) + "".join(f"{_escape(a, java)}-{_escape(b, java)}" for a, b in SINGLE_RANGES)
    together = "|".join("".join(_escape(ord(c), java) for c in p) for p in PAIRS)
    pipe, end = _escape(ord("|"), java), _escape(0x20, java) + _escape(0x0A, java)
    run = nested(end + pipe + alone) if nest else f"[^{end}{pipe}{alone}]"
    return f"{run}+|{together}|[{pipe}{alone}]"
