"""Text expressions: whitespace, integers, hashes and small pattern reads.

Functions map Columns to a Column and stay on the JVM. Those ending in ``_sql`` map
SQL text to SQL text, for use inside array lambdas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s, \d, \w and \b Unicode-aware; \x1c-\x1f also count as blanks here.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
# From the first to the last character that is no blank: anchored, so only the ends are searched.
_BETWEEN_EDGES = r"(?sU)^[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])"

# Texts that stand for "no value" in embedded page state.
NO_VALUE_WORDS = ("null", "none", "na")

# Number of leading characters of a review text that enter its key.
IN_PAGE_KEY_CHARS = 160
CROSS_PAGE_KEY_CHARS = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column) -> Column:
    """Drop blanks at both ends."""
    return find(value, _BETWEEN_EDGES, 1)


def normalize_space(value: Column) -> Column:
    """Null becomes '', blank runs become one space, ends are trimmed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, F.lit(_BLANKS), F.lit(" ")))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_nonblank(*values: Column) -> Column:
    """First value that is neither null nor ''; '' when there is none."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """Text of ``group`` in the first match, or '' without a match."""
    return F.regexp_extract(text, pattern, group)


def to_int(value: Column) -> Column:
    """First run of digits once commas are gone; sign and fraction are ignored."""
    digits = find(F.replace(value.cast("string"), F.lit(","), F.lit("")), r"(?U)\d+")
    return blank_to_null(digits).try_cast("int")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any of ``words`` occurs in ``text`` as a substring."""
    words = list(words)
    if not words:
        return F.lit(False)
    return text.rlike("|".join(r"\Q" + word + r"\E" for word in words))


def stable_hash(*parts: Column) -> Column:
    """SHA-256 hex of the space-normalised parts joined by '||'."""
    return F.sha2(F.concat_ws("||", *[normalize_space(p) for p in parts]), 256)


def prefix(text: Column, n: int | None) -> Column:
    """First ``n`` characters, counted as code points; all of them for None."""
    return text if n is None else F.substring(text, 1, n)


def in_page_review_key(
    reviewer: Column, date: Column, title: Column, text: Column, chars: int | None = IN_PAGE_KEY_CHARS
) -> Column:
    """Key of a review within its page. ``chars`` of the text enter it, None: the whole text."""
    return stable_hash(reviewer, date, title, prefix(text, chars))


def review_key(
    product_id: Column,
    reviewer: Column,
    date: Column,
    title: Column,
    text: Column,
    chars: int | None = CROSS_PAGE_KEY_CHARS,
) -> Column:
    """Key of a review over all pages. Keys of one store need one ``chars``."""
    return stable_hash(product_id, reviewer, date, title, prefix(text, chars))


def extract_urls(text: Column) -> Column:
    """All http(s) URLs in free text; closing '.', ',' or ')' stay."""
    return F.regexp_extract_all(
        text, F.lit(r"(?U)https?://[^\s\x1c-\x1f\]\[\"'<>]+"), F.lit(0)
    )


def first_match(html: Column, key: str) -> Column:
    """First real value of ``"key": "value"`` in raw page text, else ''."""
    pattern = r'(?iU)"\Q' + key + r'\E"[\s\x1c-\x1f]*:[\s\x1c-\x1f]*"([^"]+)"'
    values = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), normalize_space)
    real = F.filter(values, lambda v: (v != "") & ~F.lower(v).isin(*NO_VALUE_WORDS))
    return F.coalesce(F.get(real, F.lit(0)), F.lit(""))


def count_in_text(text: Column) -> Column:
    """First number of a text as digits without commas, else ''."""
    return F.replace(find(text, r"(?U)\d[\d,]*"), F.lit(","), F.lit(""))


def safe_product_id(product_id: Column) -> Column:
    """Product id fit for a folder name."""
    return F.regexp_replace(product_id, F.lit("[^A-Za-z0-9_-]+"), F.lit("_"))


def iso_utc(as_of: Column | None = None) -> Column:
    """ISO-8601 UTC text of ``as_of`` (default: now)."""
    moment = F.current_timestamp() if as_of is None else as_of
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# --- SQL text ---------------------------------------------------------------------


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(texts: Iterable[str]) -> str:
    return ", ".join(literal(t) for t in texts)


def strip_sql(value: str) -> str:
    return find_sql(value, _BETWEEN_EDGES, 1)


def normalize_space_sql(value: str) -> str:
    return f"trim(regexp_replace(coalesce({value}, ''), {literal(_BLANKS)}, ' '))"


def first_nonblank_sql(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"


def find_sql(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {literal(pattern)}, {group})"


def to_int_sql(value: str) -> str:
    digits = find_sql(f"replace({value}, ',', '')", r"(?U)\d+")
    return f"try_cast(nullif({digits}, '') AS INT)"


def in_page_review_key_sql(reviewer: str, date: str, title: str, text: str) -> str:
    parts = (reviewer, date, title, f"substring({text}, 1, {IN_PAGE_KEY_CHARS})")
    joined = ", ".join(normalize_space_sql(p) for p in parts)
    return f"sha2(concat_ws('||', {joined}), 256)"


# Reads from the visible text of one review block.


def rating_in_text_sql(text: str) -> str:
    """First free-standing 1-5, with or without a fraction or the word 'stars'."""
    return to_int_sql(find_sql(text, r"(?iU)\b([1-5])(\.[0-9])?\s*(stars?)?\b", 1))


def date_in_text_sql(text: str) -> str:
    pattern = r"(?U)\b\d{1,2}\s+[A-Za-z]+\s*,?\s*\d{4}\b"
    return normalize_space_sql(find_sql(text, pattern))


# A name starts where its run of characters starts and takes the run whole: linear in the text.
_NAME_AND_DATE = r"(?U)(?<![A-Za-z0-9_.\- ])([A-Za-z0-9_.\- ]++)\s*,\s*(\d{1,2}\s+[A-Za-z]+\s*\d{4})"


def name_before_date_sql(text: str) -> str:
    return normalize_space_sql(find_sql(text, _NAME_AND_DATE, 1))


def date_after_name_sql(text: str) -> str:
    return normalize_space_sql(find_sql(text, _NAME_AND_DATE, 2))


def variant_in_text_sql(text: str) -> str:
    pattern = r"(?iU)(?:Color|Storage|RAM|Variant)\s*:\s*([^|,]+)"
    return normalize_space_sql(find_sql(text, pattern, 1))


def helpful_in_text_sql(text: str) -> str:
    pattern = r"(?iU)(\d[\d,]*)\s+people\s+found\s+this\s+helpful"
    return to_int_sql(find_sql(text, pattern, 1))
