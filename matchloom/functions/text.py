"""Text functions: tokens, chunks, clipping, masking, lenient conversions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(fixed.WHITE_SPACE))


def python_pattern(pattern: str) -> str:
    """A pattern of `fixed`, which are in Java syntax, for Python's `re`."""
    return re.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", pattern)


def raw_tokens(text: Column) -> Column:
    """The tokens of `tokenize` before lower-casing; exploded rows are cheaper to lower-case one by one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Words of letters, digits and `_+#./-`, or single CJK characters, in lower case."""
    return F.transform(raw_tokens(text), F.lower)


def chunk(text: Column, size: int, overlap: int) -> Column:
    """Sliding windows of `size` characters, step `size - overlap`, blank pieces dropped.

    One piece when the text fits; no window starts after one that reached the end.
    """
    step = max(size - overlap, 1)

    def windows(body: Column) -> Column:
        extra = F.ceil(F.greatest(F.length(body) - size, F.lit(0)) / F.lit(step)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), extra),
            lambda i: strip(F.substring(body, i * step + 1, F.lit(size))),
        )

    # As a lambda variable the stripped text is computed once, not per window.
    pieces = F.flatten(F.transform(F.array(strip(F.coalesce(text, F.lit("")))), windows))
    return F.filter(pieces, lambda p: p != "")


def clip_head_tail(text: Column, head: int = 2200, tail: int = 1200) -> Column:
    """Keep the first and the last characters of a long text, with a marker between."""
    body = F.coalesce(text, F.lit(""))
    clipped = F.concat(F.substring(body, 1, head), F.lit(fixed.CLIP_MARKER), F.right(body, F.lit(tail)))
    return F.when(F.length(body) <= head + tail, body).otherwise(clipped)


def mask_id_numbers(text: Column) -> Column:
    return F.regexp_replace(text, fixed.ID_NUMBER_PATTERN, "$1********$2")


def mask_personal(text: Column) -> Column:
    """Mask id numbers, then phone numbers, then e-mail addresses (first two characters stay)."""
    local, domain = fixed.EMAIL_LOCAL, fixed.EMAIL_DOMAIN
    email = f"({local}{{2}}){local}*@({domain})|({local}@)({domain})"
    masked = F.regexp_replace(mask_id_numbers(text), fixed.PHONE_PATTERN, "$1****$2")
    return F.regexp_replace(masked, email, "$1$3***$2$4")


def year_in(text: Column) -> Column:
    """First year 19xx or 20xx in the text, 0 without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), fixed.YEAR_PATTERN, 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def to_float(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def clean_strings(values: Column) -> Column:
    """Trimmed, without blanks; NULL becomes the empty array."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), strip)
    return F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))


def truncate(text: Column, chars: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def json_brief(record: Column, chars: int) -> Column:
    return F.substring(F.to_json(record), 1, chars)


def split_times(text: Column, limit: int = 10) -> Column:
    """Proposed times typed on separate lines: trimmed, blanks dropped, at most `limit`."""
    return F.slice(clean_strings(F.split(text, r"\n")), 1, limit)


def longer_extraction(direct: Column, ocr: Column, min_chars: int = 50) -> Column:
    """The directly extracted text unless it is short and the OCR text is longer."""
    a, b = F.coalesce(direct, F.lit("")), F.coalesce(ocr, F.lit(""))
    return F.when((F.length(a) < min_chars) & (F.length(b) > F.length(a)), b).otherwise(a)


_TERM_CHARS = r"[a-z0-9+#./]+"


def term_runs(text: Column) -> Column:
    """Runs of characters that skill tags are made of, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(low, F.lit(_TERM_CHARS), F.lit(0))


def is_plain_run(run: Column) -> Column:
    """A run without `.` and `/` holds at most one term: itself."""
    return ~run.contains(".") & ~run.contains("/")


def is_term(value: Column) -> Column:
    """Tags named in requirements: a letter, then up to 30 characters."""
    return value.rlike("^[a-z]") & F.length(value).between(2, 31)


def run_terms(run: Column) -> Column:
    """Every term in a run.

    A tag hits where it is not preceded by `[a-z0-9+#.]` and not followed by `[a-z0-9+#]`: inside a run it
    starts at the beginning or after a `/` and ends before a `.` or `/` or at the end.
    """
    starts = F.filter(
        F.sequence(F.lit(1), F.length(run)),
        lambda i: (i == 1) | (F.substring(run, i - 1, F.lit(1)) == "/"),
    )

    def from_start(i: Column) -> Column:
        rest = F.substring(run, i, F.length(run))
        # An end of 1 gives no term, but keeps the sequence valid for the last character.
        ends = F.filter(
            F.sequence(F.lit(1), F.least(F.length(rest), F.lit(31))),
            lambda n: (n == F.length(rest)) | F.substring(rest, n + 1, F.lit(1)).isin(".", "/"),
        )
        return F.transform(ends, lambda n: F.substring(rest, F.lit(1), n))

    terms = F.flatten(F.transform(starts, from_start))
    return F.filter(F.array_distinct(terms), is_term)
