"""Masking, tokenising, ids and display helpers (F9-F18) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# A mask is first written as this control character so that the delimiter
# pass cannot eat the '<', '*' and '>' of the mask token; it becomes
# MASK_TOKEN after tokenising.
MASK_SENTINEL = "\u0001"


def _mask_guards(text: Column) -> tuple:
    """Per masking rule, a cheap test that holds whenever the rule can match
    (uuid: '-', long hex: 32+ characters, ISO time: 'T' and ':', e-mail: '@')."""
    return (text.contains("-"), F.length(text) >= 32,
            text.contains("T") & text.contains(":"), None, text.contains("@"))


def mask(text: Column) -> Column:
    """the five masking rules, applied in order."""
    out = text
    for pattern, guard in zip(K.MASK_RES, _mask_guards(text)):
        replaced = F.regexp_replace(out, pattern, MASK_SENTINEL)
        out = replaced if guard is None else F.when(guard, replaced).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """delimiters become blanks, split on whitespace, empty text -> []."""
    delims = "".join(K.EXTRA_DELIMITERS)
    spaced = F.regexp_replace(F.translate(text, delims, " " * len(delims)), r"^\s+|\s+$", "")
    toks = F.split(spaced, r"\s+")
    toks = F.when(spaced == "", F.array().cast("array<string>")).otherwise(toks)
    return F.transform(toks, lambda t: F.replace(t, F.lit(MASK_SENTINEL), F.lit(K.MASK_TOKEN)))


def masked_message(text: Column) -> Column:
    """Masked, tokenised message joined by single blanks (the exact-match
    template text)."""
    return F.array_join(tokens(mask(text)), " ")


def short_md5_id(prefix: str, text: Column, digits: int = K.TEMPLATE_ID_HEX) -> Column:
    """prefix + the first hex digits of md5(text)."""
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, digits))


def hour_bucket_text(ts: Column) -> Column:
    """'YYYY-MM-DD HH:00' in the session time zone (UTC)."""
    return F.date_format(ts, "yyyy-MM-dd HH:'00'")


def hour_label(ts: Column) -> Column:
    """'HH:00'."""
    return F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))


def day_of_week(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def is_error(level: Column, levels=K.ML_ERROR_LEVELS) -> Column:
    """1 when the level is in the given error set, else 0."""
    return F.when(level.isin(*levels), F.lit(1)).otherwise(F.lit(0))


def json_object(text: Column) -> Column:
    """A text that is one JSON object, whole, as map<string,string>; else NULL.

    Spark's reader ignores what follows the first value, so the text is read as
    the first of two elements of an array: anything after the object breaks the
    array or changes its length.
    """
    end = '{"\\u0001":null}'
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(f",{end}]")), "array<map<string,string>>",
                         {"allowSingleQuotes": "false"})
    only = F.get(F.transform(F.array(parsed), lambda p: F.when(
        (F.size(p) == 2) & F.map_contains_key(F.get(p, F.lit(1)), F.lit("\u0001")), F.get(p, F.lit(0)))), F.lit(0))
    return F.when(F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit("{")), only)


def iso_time(text: Column) -> Column:
    """Text that begins with a whole date -> timestamp, else NULL (a bare time or
    year would otherwise be completed from the clock)."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(t))


def readable_size(nbytes: Column) -> Column:
    """F16: base 1024, two decimals, units Bytes KB MB GB TB PB EB; 0 -> '0 Bytes'."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB")])
    i = F.floor(F.log(nbytes.cast("double")) / F.log(F.lit(1024.0))).cast("int")
    value = F.round(nbytes / F.pow(F.lit(1024.0), i), 2)
    # JavaScript prints 2.5 as '2.5' and 3.0 as '3'
    shown = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(nbytes == 0, F.lit("0 Bytes")).otherwise(
        F.concat(shown, F.lit(" "), F.get(units, i)))


def truncate_text(text: Column, n: int = 50) -> Column:
    """cut at n characters and append '...'."""
    return F.when(text.isNull(), F.lit("N/A")).when(
        F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def status_class(status: Column) -> Column:
    """display class of an HTTP status code."""
    code = status.try_cast("int")
    return (F.when(code >= 400, F.lit("destructive"))
            .when(code >= 300, F.lit("secondary"))
            .otherwise(F.lit("default")))
