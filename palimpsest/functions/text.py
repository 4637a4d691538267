"""The text rules as Column functions: JVM-side, inside whole-stage plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import rules as R



def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(_col(c), F.lit("".join(map(chr, R.WHITE_SPACE))))


def _parts(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, trim_space), lambda p: p != "")


def paragraphs(c: Column | str) -> Column:
    """All parts between paragraph breaks."""
    text = _col(c)
    for a, b in R.PARAGRAPH_RULES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.split(text, R.PARAGRAPH_BREAK, -1)


def sentences(c: Column | str) -> Column:
    """All parts between sentence breaks."""
    text = _col(c)
    for a, b, regex in R.sentence_rules(java=True, nest=True):
        text = F.regexp_replace(text, a, b.replace(r"\1", "$1")) if regex else F.replace(text, F.lit(a), F.lit(b))
    return F.split(text, f"(?:{R.SENTENCE_BREAK})+", -1)


def tokens(c: Column | str) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(R.token_pattern(java=True, nest=True)), F.lit(0))
    return F.transform(found, lambda t: F.when(t == R.PIPE_WORD, "|").otherwise(t))


def paragraph_texts(c: Column | str) -> Column:
    return _parts(paragraphs(c))


def sentence_texts(c: Column | str) -> Column:
    return _parts(sentences(c))


def all_sentences(c: Column | str) -> Column:
    """The sentences of a lower-cased text, in order."""
    return F.flatten(F.transform(paragraph_texts(c), sentence_texts))


def all_tokens(c: Column | str) -> Column:
    """The tokens of a lower-cased text, in order."""
    return F.flatten(F.transform(all_sentences(c), tokens))


def content_hash(text: Column | str, sha1: Column | str | None = None) -> Column:
    own = F.md5(_col(text).cast("binary"))
    return own if sha1 is None else F.coalesce(_col(sha1), own)


def editor(user_id: Column | str, user_name: Column | str) -> Column:
    """"0|name" without an account, the id with one, empty where it is hidden."""
    uid = _col(user_id)
    return F.when(uid.isNull(), "").when(uid == 0, F.concat(F.lit("0|"), F.coalesce(_col(user_name), F.lit("")))).otherwise(uid.cast("string"))


def editor_class(name: Column | str) -> Column:
    """A name safe in markup: the MD5 of editors without an account, others as they are."""
    c = _col(name)
    return F.when(c.startswith("0|"), F.md5(c.cast("binary"))).otherwise(c)


def shrinks(before: Column, now: Column, comment: Column, minor: Column) -> Column:
    """The length-shrink rule; a null `before` is no text before."""
    good_faith = (F.coalesce(comment, F.lit("")) != "") & F.coalesce(minor, F.lit(False))
    drop = (now - before) / before <= R.SHRINK_SHARE
    return F.coalesce(~good_faith & (before > R.SHRINK_FROM) & (now < R.SHRINK_BELOW) & drop, F.lit(False))


def epoch_seconds(stamp: Column | str) -> Column:
    """Seconds since 1970 of "YYYY-MM-DDTHH:MM:SSZ"; null for other shapes. Days and times out of range run on."""
    c = _col(stamp)
    part = lambda i, n: F.substring(c, i, n).cast("bigint")
    # days of a civil date whose year starts in March: 365 a year, a leap day each 4th but not each 100th but each 400th
    early = part(6, 2) <= 2
    year, month = part(1, 4) - F.when(early, 1).otherwise(0), part(6, 2) + F.when(early, 9).otherwise(-3)
    days = year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((month * 153 + 2) / 5) + part(9, 2) - 1 - 719468
    seconds = days * 86400 + part(12, 2) * 3600 + part(15, 2) * 60 + part(18, 2)
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[\x00-\x{10FFFF}]"), seconds)


def age_seconds(stamp: Column | str, now: Column | int) -> Column:
    """Seconds from a time to `now` (always given), 0 for a time of another shape."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.coalesce(now - epoch_seconds(stamp), F.lit(0)).cast("double")


def html_text(c: Column | str) -> Column:
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in ((" ", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_attribute(c: Column | str) -> Column:
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    for a, b in ((" ", "&nbsp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def zigzag(c: Column | str) -> Column:
    return F.shiftleft(_col(c), 1).bitwiseXOR(F.shiftright(_col(c), 63))


def unzigzag(c: Column | str) -> Column:
    return F.shiftrightunsigned(_col(c), 1).bitwiseXOR(-_col(c).bitwiseAND(F.lit(1)))


#: Bytes of the longest variable-length number: 64 bits, seven in each.
VARINT_BYTES = 10


def varint(c: Column | str) -> Column:
    """The bytes of a number's 64 bits, seven in each from the lowest on; the top bit says that more follow."""
    v = _col(c).cast("long")
    rest = lambda i: F.shiftrightunsigned(v, 7 * i)
    low = lambda i: rest(i).bitwiseAND(F.lit(127))
    more = lambda i: rest(i + 1) != 0 if i + 1 < VARINT_BYTES else F.lit(False)
    byte = lambda i: F.lpad(F.hex(F.when(more(i), low(i) + 128).otherwise(low(i))), 2, "0")
    return F.when(v.isNotNull(), F.unhex(F.concat(byte(0), *(F.when(rest(i) != 0, byte(i)).otherwise("") for i in range(1, VARINT_BYTES)))))


def unvarint(c: Column | str) -> Column:
    """The number of such bytes; null if they end too early, go on after the number, or hold more than 64 bits."""
    text = F.hex(_col(c))
    byte = lambda i: F.coalesce(F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("long"), F.lit(0)).bitwiseAND(F.lit(127))
    out = byte(0)
    for i in range(1, VARINT_BYTES):
        out = out.bitwiseOR(F.shiftleft(byte(i), 7 * i))
    return F.when(text.rlike("^(?:(?:[89A-F].){0,8}[0-7].|(?:[89A-F].){9}0[01])$"), out)


def sealed(c: Column | str, magic: bytes = b"") -> Column:
    """Bytes between two marks, with the CRC-32 of all before it (big-endian) in front of the second."""
    head = F.concat(F.lit(magic), _col(c))
    return F.concat(head, F.unhex(F.lpad(F.hex(F.crc32(head)), 8, "0")), F.lit(magic))


def opened(c: Column | str, magic: bytes = b"") -> Column:
    """The bytes that were sealed; null if a mark or the checksum is another."""
    whole, n = _col(c), len(magic)
    size = F.octet_length(whole)
    part = lambda start, length: F.substring(whole, start, length)
    marked = (part(F.lit(1), F.lit(n)) == F.lit(magic)) & (part(size - n + 1, F.lit(n)) == F.lit(magic))
    sound = F.hex(F.crc32(part(F.lit(1), size - n - 4))) == F.regexp_replace(F.hex(part(size - n - 3, F.lit(4))), "^0{1,7}", "")
    return F.when((size >= 2 * n + 4) & marked & sound, part(F.lit(n + 1), size - 2 * n - 4))


def wiki_name(lang: Column | str) -> Column:
    return F.concat(_col(lang), F.lit("wiki"))


def title_key(title: Column | str) -> Column:
    return F.translate(_col(title), " ", "_")


def shard_path(lang: Column | str, page_id: Column | str) -> Column:
    page = _col(page_id)
    whole = lambda n: F.floor(page / n).cast("string")
    return F.concat_ws("/", _col(lang), whole(1_000_000), whole(1_000), page.cast("string"))


def title_url(title: Column | str) -> Column:
    """A title as a part of an address: underscores for spaces, the rest percent-encoded."""
    return F.url_encode(title_key(title))
