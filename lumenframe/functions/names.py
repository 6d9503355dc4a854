"""File names, formats of numbers, locales, messages and checks of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Causes that count as running out of memory, errors that may be tried again, and reserved names.
OUT_OF_MEMORY = r"(?i)out of memory|\boom\b|allocation failed|array buffer allocation|invalid typed array length|invalid array length|memory access out of bounds|cannot enlarge memory|failed to grow memory|maximum call stack"
RETRYABLE = ("out-of-memory", "model-download-failed", "model-integrity", "offline", "inference-failed", "unknown")
RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])$"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which has no built-in function."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def base_name(name: Column) -> Column:
    """A safe file name without folder and extension; the name has to be composed already."""
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)^.*[\\/]", "")
    for pattern, by in ((r"\.[A-Za-z0-9]{1,5}\z", ""), (r"[\x00-\x1f\x7f]", "-"), (r'[<>:"/\\|?*]+', "-"), (r"\s+", "-"), (r"-{2,}", "-"), (r"^[-.\s]+|[-.\s]+\z", "")):
        out = F.regexp_replace(out, pattern, by)
    out = F.when(F.length(out) > 80, F.regexp_replace(F.substring(out, 1, 80), r"[-.\s]+\z", "")).otherwise(out)
    out = F.when(out == "", "image").otherwise(out)
    return F.when(out.rlike(RESERVED), F.concat(F.lit("image-"), out)).otherwise(out)


def output_name(base: Column, background: Column) -> Column:
    """background: null, white, black or a colour in hex."""
    digits = F.substring(F.lower(F.regexp_replace(background, "(?i)[^0-9a-f]", "")), 1, 6)
    end = F.when(background.isNull(), "background-removed").when(background.isin("white", "black"), F.concat(background, F.lit("-background"))).otherwise(F.concat(F.lit("background-"), F.when(digits == "", "color").otherwise(digits)))
    return F.concat(base, F.lit("-"), end, F.lit(".png"))


def hex_colour(value: Column) -> Column:
    """struct<r, g, b>; what is no six-digit colour is black."""
    digits = F.regexp_extract(F.trim(value), "(?i)^#?([0-9a-f]{6})$", 1)
    n = F.when(digits == "", 0).otherwise(F.conv(digits, 16, 10).cast("long"))
    byte = lambda k: F.shiftright(n, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return F.struct(byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def megabytes(n: Column, locale: str = "en") -> Column:
    """One digit below 10 MB, none above; trailing zeros go; halves go away from zero, so they are rounded before format_number, which takes them to even."""
    mb = n / 1000000.0
    text = F.when(mb < 10, F.regexp_replace(F.format_number(F.round(mb, 1), 1), r"\.0$", "")).otherwise(F.format_number(F.round(mb, 0), 0))
    return F.concat(F.translate(text, ",.", ".,") if locale == "de" else text, F.lit(" MB"))


def locale_of(languages: Column, override: Column) -> Column:
    bases = F.filter(F.transform(languages, lambda x: F.split(F.lower(x), "-")[0]), lambda b: b.isin("de", "en"))
    return F.coalesce(F.when(override.isin("de", "en"), override), F.get(bases, F.lit(0)), F.lit("en"))


def filled(message: Column, values: dict[str, Column]) -> Column:
    """{name} in a message replaced by values."""
    for name, value in values.items():
        message = F.replace(message, F.lit("{" + name + "}"), value.cast("string"))
    return message


def error_code(detail: Column, fallback: str = "unknown") -> Column:
    return F.when(detail.rlike(OUT_OF_MEMORY), "out-of-memory").otherwise(fallback)


def route(method: Column, url: Column, scope: str) -> Column:
    """pass, navigate-or-static or asset for a request to the cache."""
    path = F.substring(url, len(scope) + 1, 1_000_000)
    return F.when((method != "GET") | ~url.startswith(scope) | path.startswith("models/"), "pass").when(path.startswith("assets/"), "asset").otherwise("static")


def percent(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.floor(done / total * 100)).cast("int")
