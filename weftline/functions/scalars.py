"""Predicates, coercions, clamps, codes and clock formats as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_falsy(c: Column, kind: str) -> Column:
    """Missing, false, zero, NaN and the empty string are falsy, by the column's kind (string, number or boolean)."""
    empty = {"string": c == "", "number": (c == 0) | F.isnan(c.cast("double")), "boolean": ~c}[kind]
    return F.coalesce(empty, F.lit(True))


def first_non_null(*cols: Column) -> Column:
    return F.coalesce(*cols)


def first_truthy(*cols: Column) -> Column:
    """First string that is neither null nor empty; the last one as it is if none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def finite(c: Column) -> Column:
    """A number if the text or number is finite, else null; never an error."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def round_int(c: Column, default: int = 0) -> Column:
    """Rounded half to even, as a long; the default where it is not finite."""
    return F.coalesce(F.bround(finite(c)).cast("bigint"), F.lit(default).cast("bigint"))


def clamp_int(c: Column, low: int, high: int, default: int) -> Column:
    """Floor within bounds; the default where it is no finite number."""
    x = F.floor(finite(c)).cast("bigint")
    return F.when(x.isNull(), F.lit(default).cast("bigint")).otherwise(F.least(F.greatest(x, F.lit(low).cast("bigint")), F.lit(high).cast("bigint")))


# Words that read as no. Everything else that is present reads as yes.
NO_WORDS = ("0", "false", "no", "n", "off")


def parse_bool(c: Column, default: bool = False) -> Column:
    """Null gives the default; a no-word gives false; all other text, blank too, true."""
    return F.when(c.isNull(), F.lit(default)).otherwise(~F.lower(F.trim(c)).isin(*NO_WORDS))


# Parts of messages by the class of the error.
RECOVERABLE = ("target closed", "session closed", "execution context was destroyed", "cannot find context with specified id", "protocol error", "navigation timeout", "network.enable timed out")
FINAL = ("transcript_button_not_found",)


def _holds(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def classify_error(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m == "", "none").when(_holds(m, FINAL), "final").when(_holds(m, RECOVERABLE), "recoverable").otherwise("other")


def retry_delay_ms(attempt: Column, base: int = 2200, step: int = 1600) -> Column:
    """Linear backoff; the jitter is left to the caller."""
    return F.lit(base) + F.greatest(attempt - 1, F.lit(0)) * F.lit(step)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from one instant to another, rounded toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def progress_ratio(current: Column, target: Column, width: int) -> Column:
    """Length of a bar of ``width``; null where the target is zero."""
    return F.try_divide(F.lit(width) * current, target)


def frames_from_ms(ms: Column, fps: int, how: str = "ceil") -> Column:
    """Frames of a duration, at least one: ``ceil`` for speech, ``round`` (half to even) for pictures."""
    x = ms * F.lit(fps) / F.lit(1000)
    return F.greatest((F.ceil(x) if how == "ceil" else F.bround(x)).cast("bigint"), F.lit(1).cast("bigint"))


def _two(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c < 10, F.concat(F.lit("0"), s)).otherwise(s)


def timecode(frames: Column, fps: int) -> Column:
    """HH:MM:SS:FF of a count of frames; longer than 99 hours keeps its digits."""
    seconds = F.floor(frames / F.lit(fps)).cast("bigint")
    h, m, s = F.floor(seconds / 3600).cast("bigint"), F.floor(seconds / 60).cast("bigint") % 60, seconds % 60
    return F.concat_ws(":", _two(h), _two(m), _two(s), _two(frames % fps))


def frames_from_timecode(tc: Column, fps: int) -> Column:
    """The count of frames; null unless the text has four numbers."""
    p = F.split(tc, "[:;]", -1)
    n = [F.get(p, i).try_cast("bigint") for i in range(4)]
    return F.when(F.size(p) == 4, ((n[0] * 60 + n[1]) * 60 + n[2]) * fps + n[3])


def clock(ms: Column) -> Column:
    """[HH:]MM:SS of milliseconds; hours only where there are any."""
    t = F.floor(F.greatest(ms, F.lit(0).cast("bigint")) / 1000).cast("bigint")
    h, m, s = F.floor(t / 3600).cast("bigint"), F.floor(t / 60).cast("bigint") % 60, t % 60
    return F.when(h > 0, F.concat_ws(":", _two(h), _two(m), _two(s))).otherwise(F.concat_ws(":", _two(m), _two(s)))


def frame_rate(text: Column) -> Column:
    """A rate written as a number or a fraction ('30000/1001'); null if it is neither or the divisor is 0."""
    p = F.split(text, "/", -1)
    a, b = F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double")
    return F.when(F.size(p) == 1, a).when(F.size(p) == 2, F.try_divide(a, b))


def normalize_interval(start_ms: Column, end_ms: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in whole milliseconds.

    Millisecond fields win if both are finite. Other fields are seconds if
    they differ by more than 0 and at most 120 and the end is at most 20,000;
    else milliseconds. Starts below 0 become 0, ends before the start become
    the start, and without numbers both are 0.
    """
    ms, e_ms, s, e = finite(start_ms), finite(end_ms), finite(start), finite(end)
    seconds = (e - s > 0) & (e - s <= 120) & (e <= 20_000)
    k = F.when(ms.isNotNull() & e_ms.isNotNull(), F.lit(1)).otherwise(F.when(seconds, F.lit(1000)).otherwise(F.lit(1)))
    a = F.when(ms.isNotNull() & e_ms.isNotNull(), ms).otherwise(F.when(s.isNotNull() & e.isNotNull(), s))
    b = F.when(ms.isNotNull() & e_ms.isNotNull(), e_ms).otherwise(F.when(s.isNotNull() & e.isNotNull(), e))
    lo = F.greatest(F.coalesce(F.bround(a * k).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    hi = F.greatest(lo, F.coalesce(F.bround(b * k).cast("bigint"), F.lit(0).cast("bigint")))
    return F.struct(lo.alias("start"), hi.alias("end"))


def alpha_token(n: Column) -> Column:
    """A number in base 26 with the digits a to z, at least four of them; negative ones count as 0."""
    left = [F.floor(F.greatest(n, F.lit(0)) / F.lit(26**k)).cast("bigint") for k in range(14)]
    letters = [F.chr(d % 26 + 97) for d in left]
    return F.concat(*[x if k < 4 else F.when(left[k] > 0, x).otherwise("") for k, x in reversed(list(enumerate(letters)))])


def stable_name(*parts: Column) -> Column:
    """Eight hex digits of the md5 of the parts, joined by a bar."""
    return F.left(F.md5(F.concat_ws("|", *parts)), F.lit(8))


_FNV_PRIME, _FNV_BASIS, _FNV_SALT = 16777619, 2166136261, 0x9E3779B9
_LOW32 = 0xFFFFFFFF


def _fnv(text: Column, basis: int) -> Column:
    """FNV-1a of 32 bits over UTF-16 units (characters beyond the basic plane are two units)."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw) - 3, F.lit(1)), F.lit(4)), lambda i: F.conv(F.substring(raw, i, F.lit(4)), 16, 10).cast("bigint"))
    h = F.aggregate(units, F.lit(basis).cast("bigint"), lambda a, c: (a.bitwiseXOR(c) * F.lit(_FNV_PRIME)).bitwiseAND(F.lit(_LOW32)))
    return F.when(F.length(text) == 0, F.lit(basis).cast("bigint")).otherwise(h)


def fnv_id(*parts: Column) -> Column:
    """Deterministic id xxxx-xxxx-xxxx-xxxx of the parts, joined by a bar: two 32-bit hashes, the second with a salted start."""
    text = F.concat_ws("|", *parts)
    both = F.concat(*[F.lower(F.lpad(F.hex(_fnv(text, b)), 8, "0")) for b in (_FNV_BASIS, _FNV_BASIS ^ _FNV_SALT)])
    return F.concat_ws("-", *[F.substring(both, 1 + 4 * k, 4) for k in range(4)])


def pad_index(n: Column, width: int) -> Column:
    """Zeros to the left up to a width; longer numbers keep all their digits."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def first_int(text: Column) -> Column:
    """The first run of digits as a number; null without one, or beyond 64 bits."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def natural_key(name: Column) -> Column:
    """An array to sort names by: digit runs by value, however long, other text case-folded."""
    tokens = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    lead = F.when(name.rlike("^[0-9]"), F.concat(F.array(F.lit("")), tokens)).otherwise(tokens)
    # of two numbers the one with more digits is larger, whatever they are
    by_value = lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d)
    return F.transform(lead, lambda t: F.when(t.rlike("^[0-9]"), by_value(F.regexp_replace(t, "^0+", ""))).otherwise(F.lower(t)))


def url_id(url: Column, short_host: str = "youtu.be") -> Column:
    """The id of a video page: path of a short host, else query field v, else a v= by pattern, else 'video'."""
    host = F.try_parse_url(url, F.lit("HOST"))
    short = F.trim(F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", ""))
    v = F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))
    by_pattern = F.regexp_extract(url, r"[?&]v=([a-zA-Z0-9_-]+)", 1)
    found = F.when(host.contains(short_host), short).otherwise(F.coalesce(F.nullif(v, F.lit("")), F.nullif(by_pattern, F.lit(""))))
    return F.coalesce(F.when(host.isNotNull(), found), F.lit("video"))


def infer_ext(url: Column, content_type: Column) -> Column:
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    out = F
    for ext in ("webp", "png"):
        out = out.when(t.contains(ext) | u.contains(f".{ext}"), ext)
    return out.otherwise("jpg")


def job_verdict(status: Column, exit_code: Column, has_output: Column) -> Column:
    """True where the status says success or done, or the exit code is 0 and there is output."""
    return F.coalesce(F.lower(status).isin("success", "done"), F.lit(False)) | F.coalesce((exit_code == 0) & has_output, F.lit(False))
