"""Scalar text functions as native Spark column expressions (no UDFs).

All regexes run in the JVM inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# Python's str.isspace() set, written out: ASCII controls, the information
# separators U+001C..U+001F, NEL and every Unicode separator (Z*).
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]"
#: The same set, character by character, for ``btrim``, which looks at the ends of a text only.
WHITESPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# string.punctuation: the 32 ASCII punctuation characters.
ASCII_PUNCT_CLASS = r"\p{Punct}"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unicode_trim(col) -> Column:
    """Strip leading/trailing Unicode white space (``str.strip()``)."""
    return F.btrim(_c(col).cast("string"), F.lit(WHITESPACE))


def unicode_rtrim(col) -> Column:
    """``str.rstrip()``: strip trailing Unicode white space."""
    return F.regexp_replace(_c(col).cast("string"), rf"{WHITESPACE_CLASS}+$", "")


def cut(col, n: int = config.MAX_TEXT_LENGTH) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


def trim_cut(col, n: int = config.MAX_TEXT_LENGTH) -> Column:
    return cut(unicode_trim(col), n)


def model_clean(col) -> Column:
    """Lower; delete ASCII punctuation; other non [a-z0-9 space] -> space;
    collapse white space; trim.  ``can't`` -> ``cant``."""
    x = F.regexp_replace(F.lower(_c(col)), ASCII_PUNCT_CLASS + "+", "")
    return F.trim(_words_only(x))


def _words_only(x: Column) -> Column:
    """Every run of other characters than [a-z0-9] as one space, in one pass."""
    return F.regexp_replace(x, "[^a-z0-9]+", " ")


def rule_clean(col) -> Column:
    """Lower; every non [a-z0-9 space] -> space; collapse; trim.
    ``can't`` -> ``can t``.  Missing text reads as the word ``nan``."""
    return F.trim(_words_only(F.lower(F.coalesce(_c(col).cast("string"), F.lit("nan")))))


def token_set(norm_col) -> Column:
    """Distinct words of a rule-cleaned text (single spaces only)."""
    c = _c(norm_col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, " ")))


def map_literal(mapping: dict) -> Column:
    if not mapping:
        return F.create_map().cast("map<string,string>")
    parts = []
    for k, v in mapping.items():
        parts += [F.lit(k), F.lit(v)]
    return F.create_map(*parts)


def normalize_label(col, synonyms: dict | None = None) -> Column:
    """Trim, lower, synonym lookup; unknown or blank -> null."""
    syn = config.LABEL_SYNONYMS if synonyms is None else synonyms
    key = F.lower(unicode_trim(col))
    return F.when(key == "", F.lit(None).cast("string")).otherwise(F.try_element_at(map_literal(syn), key))


def display_name(col, display: dict | None = None) -> Column:
    """Display name from the lookup, else underscores -> spaces, title case."""
    disp = config.LABEL_DISPLAY_NAMES if display is None else display
    c = _c(col)
    return F.coalesce(F.try_element_at(map_literal(disp), c), F.initcap(F.regexp_replace(c, "_", " ")))


def label_reason(col, reasons: dict | None = None, default: str = config.DEFAULT_REASON) -> Column:
    """Reason text of a predicted label, with a default."""
    rs = config.LABEL_REASONS if reasons is None else reasons
    return F.coalesce(F.try_element_at(map_literal(rs), _c(col)), F.lit(default))


def percent(col, digits: int = 2) -> Column:
    """``12.34%``; null -> ''."""
    c = _c(col)
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f%%", c * 100))


def row_caption(row_col, label_col, text_col, preview_chars: int = config.CAPTION_PREVIEW_CHARS) -> Column:
    """P10: ``Row n | label | preview`` with newlines as spaces and a cut preview."""
    flat = F.regexp_replace(unicode_trim(text_col), r"\n", " ")
    preview = F.when(
        F.char_length(flat) > preview_chars, F.concat(unicode_rtrim(F.substring(flat, 1, preview_chars)), F.lit("..."))
    ).otherwise(flat)
    return F.concat_ws(" | ", F.concat(F.lit("Row "), _c(row_col).cast("string")), _c(label_col), preview)


def app_id_from_reference(col, host_marker: str = "play.google.com", key: str = "id") -> Column:
    """X11: app id from a store URL (first ``key`` query value, percent-decoded)
    or a bare id.  Returns the id; use :func:`app_id_is_valid` for the check."""
    ref = unicode_trim(col)
    query_value = F.try_url_decode(
        F.regexp_extract(F.try_parse_url(ref, F.lit("QUERY")), rf"(?:^|&){key}=([^&]+)", 1)
    )
    return F.when(F.contains(ref, F.lit(host_marker)), F.coalesce(unicode_trim(query_value), F.lit(""))).otherwise(ref)


def app_id_is_valid(app_id_col) -> Column:
    c = _c(app_id_col)
    return (c != "") & ~F.contains(c, F.lit(" ")) & F.contains(c, F.lit("."))


def na_to_null(col, tokens=config.NA_TOKENS) -> Column:
    """Cells holding a pandas missing-value token become null."""
    c = _c(col)
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def format_timestamp(col) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss")


def balance_mode(balanced: bool) -> str:
    """The name of a training mode."""
    return "balanced" if balanced else "unbalanced"


def is_balanced(mode: str) -> bool:
    """X13, the other way; an error for other names."""
    names = {balance_mode(b): b for b in (True, False)}
    if mode not in names:
        raise ValueError(f"{mode!r} is no training mode; there are {sorted(names)}")
    return names[mode]
