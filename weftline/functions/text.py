"""Text cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation and spaces with their plain forms.
PLAIN_PUNCTUATION = {
    "«": "'", "»": "'", "‹": "'", "›": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "〝": '"', "〞": '"',
    "’": "'", "‘": "'", "‚": "'", "′": "'", "‵": "'", "＇": "'", "—": "-", "–": "-", "−": "-", "‒": "-", "―": "-",
    "·": "*", "•": "*", "∙": "*",
}
WIDE_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
NO_WIDTH = "\u200b\u200c\u200d\ufeff"
ELLIPSIS = "…"

_TAG = r"\[[^\]\[]*\]"


def translate_plain(c: Column) -> Column:
    """Typographic punctuation and spaces to plain ones; characters without width go. The ellipsis stays."""
    source = "".join(PLAIN_PUNCTUATION) + WIDE_SPACES + NO_WIDTH
    return F.translate(c, source, "".join(PLAIN_PUNCTUATION.values()) + " " * len(WIDE_SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space, that of Unicode too, to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def sanitize(c: Column) -> Column:
    """Plain punctuation, an ellipsis as three dots and never more, white space squeezed."""
    return squeeze(F.regexp_replace(F.replace(translate_plain(c), F.lit(ELLIPSIS), F.lit("...")), r"\.{4,}", "..."))


def sanitize_for_split(c: Column) -> Column:
    """As :func:`sanitize`, but the ellipsis and line breaks stay and written-out line breaks become real."""
    t = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.btrim(F.regexp_replace(translate_plain(t), r"[ \t\f\x0B]+", " "), F.lit(" \t\n\r\f\x0b"))


def sanitize_line(c: Column) -> Column:
    """One line that fits in JSON: no backslash, control characters or double quotes; spaces squeezed."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit(""))
    return squeeze(F.translate(F.regexp_replace(t, "[\\x00-\\x1F\\x7F]", " "), '\u00a0"', " '"))


def sanitize_multiline(c: Column) -> Column:
    """Each line sanitized, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n", -1), sanitize_line), lambda x: x != ""), "\n")


def safe_name(c: Column, fallback: str = "video", longest: int = 120) -> Column:
    """A folder name: reserved characters and spaces as underscores, no dots at the end, cut to a length."""
    s = F.regexp_replace(sanitize_line(c), r'[<>:"/\\|?*\x00-\x1F]', "_")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "_"), r"\.+$", ""), "_+", "_")
    s = F.btrim(s, F.lit("_"))
    return F.coalesce(F.nullif(F.btrim(F.left(s, F.lit(longest)), F.lit("_")), F.lit("")), F.lit(fallback))


def strip_tags(c: Column) -> Column:
    """Without [tags]; the space left is squeezed."""
    return squeeze(F.regexp_replace(c, _TAG, ""))


def norm_text(c: Column) -> Column:
    """Lower case, white space squeezed. Transliteration is :func:`weftline.functions.sequences.transliterate`."""
    return squeeze(F.lower(c))


def tokenize(c: Column) -> Column:
    """Words of ASCII letters, digits, underscores, hyphens and apostrophes, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_'\-]+)"), F.lit(1))


def compact(c: Column) -> Column:
    """Only ASCII letters and digits, in lower case."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def clean_prompt(c: Column, longest: int) -> Column:
    """Tags out, spaces squeezed, cut to a length without a space at the end."""
    return F.rtrim(F.left(strip_tags(c), F.lit(longest)))


def clip_stem(c: Column) -> Column:
    """A clip's file stem as that of its picture: the word 'clip' and its joints removed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "_clip_", "_"), "-clip-", "-")
    s = F.regexp_replace(s, "[_-]clip|clip_", "")
    s = F.replace(F.replace(s, F.lit(" clip "), F.lit(" ")), F.lit("clip"), F.lit(""))
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "_{2,}", "_"), "-{2,}", "-"), F.lit("_- "))


#: Fixed value: a break after a sentence's end before a capital, a digit or an opening mark.
HARD_BREAK = r"(?<=[.!?…])\s+(?=[«\"“”„(]*[A-ZА-ЯЁ0-9])"


def hard_split(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, HARD_BREAK, -1), lambda x: F.trim(x)), lambda x: x != "")


#: Fixed value: the upper half of Windows-1251 in the order of its bytes, without 0x98, which it does not have.
_CP1251 = bytes([*range(0x80, 0x98), *range(0x99, 0x100)]).decode("cp1251")


def decode_fallback(raw: Column) -> Column:
    """UTF-8 if the bytes are that, else Windows-1251 with undecodable bytes dropped; Spark's own ``decode`` lacks that charset."""
    upper = "".join(map(chr, [*range(0x80, 0x98), *range(0x99, 0x100)])) + "\x98"
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.translate(F.decode(raw, "iso-8859-1"), upper, _CP1251))
