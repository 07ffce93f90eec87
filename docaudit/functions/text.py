"""Text and scalar normalisation as Column expressions (all stay in the JVM).

Unicode parity: case folding is lower() plus the sharp s; compatibility composition (NFKC) is not built in, so text with
compatibility characters keeps them. `docaudit.functions.exact` has the full-Unicode Arrow versions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letters they stand for when accents are dropped.
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōřśšťùúûüūůýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooorsstuuuuuuyyzzz"

NUMERIC = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
SPACES = r"(?U)\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Case folding."""
    return F.replace(F.lower(_c(x)), F.lit("ß"), F.lit("ss"))


def text_key(x: Column | str) -> Column:
    """Letters and digits only, folded, without accents: the key under which spellings of one value meet."""
    return F.regexp_replace(F.translate(fold(x), ACCENTED, PLAIN), r"[^\p{L}\p{N}]", "")


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def squeeze(x: Column | str) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(_c(x), SPACES, " "))


def normal_string(x: Column | str, *, case: bool = True, spaces: bool = True) -> Column:
    out = squeeze(x) if spaces else strip(x)
    return fold(out) if case else out


def plain_decimal(x: Column | str) -> Column:
    """Decimal text without trailing zeros; minus zero is zero."""
    out = F.regexp_replace(_c(x).cast("string"), r"\.0+$|(\.[0-9]*?)0+$", "$1")
    return F.when(out == "-0", F.lit("0")).otherwise(out)


def canonical(jtype: Column, value: Column, *, case: bool = True) -> Column:
    """struct<kind, text>: null, boolean, number or string. Strings that are plain decimals count as numbers."""
    norm = normal_string(value, case=case)
    return (
        F.when(jtype.isNull() | (jtype == "null"), F.struct(F.lit("null").alias("kind"), F.lit("").alias("text")))
        .when(jtype == "boolean", F.struct(F.lit("boolean").alias("kind"), value.alias("text")))
        .when(jtype.isin("integer", "number"), F.struct(F.lit("number").alias("kind"), plain_decimal(value).alias("text")))
        .when(norm.rlike(NUMERIC), F.struct(F.lit("number").alias("kind"), plain_decimal(norm).alias("text")))
        .otherwise(F.struct(F.lit("string").alias("kind"), norm.alias("text")))
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on canonical texts; equal texts (even if both are empty): 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))))


def character_class(x: Column | str) -> Column:
    x = _c(x)
    letters, digits = x.rlike(r"\p{L}"), x.rlike(r"\p{Nd}")
    return (
        F.when(strip(x) == "", "blank").when(letters & digits, "alphanumeric").when(letters, "alphabetic").when(digits, "numeric").otherwise("symbols")
    )


def date_state(x: Column | str) -> Column:
    """true: a possible date; false: the shape of one but impossible; null: no date. A first part of four digits is the year,
    else the last part is (below 100: of this century)."""
    x, shape = strip(x), r"^(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})$"
    first, month, last = (F.nullif(F.regexp_extract(x, shape, i), F.lit("")).cast("int") for i in (1, 2, 3))
    year_first = F.length(F.regexp_extract(x, shape, 1)) == 4
    year = F.when(year_first, first).when(last < 100, last + 2000).otherwise(last)
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, F.when(year_first, last).otherwise(first)), "yyyy-MM-dd")
    return F.when(x.rlike(shape), (year >= 1) & made.isNotNull())


def rarity(count: Column, share: Column) -> Column:
    return F.when(count == 1, "singleton").when(share <= 0.01, "rare").when(share <= 0.05, "uncommon").otherwise("common")


def digit_runs(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"\d+"), F.lit(0))


def strip_thinking(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), r"(?s)<think>.*?</think>\s*", ""))


def strip_dpi(stem: Column | str) -> Column:
    return F.regexp_replace(_c(stem), r"(?i)_\d+dpi$", "")


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "-"), r"^[-.]+|[-.]+$", "")


def location_parts(x: Column | str) -> Column:
    """struct<city, suffix> of `CITY` or `CITY, suffix`; a blank side: null."""
    x = _c(x)
    both = F.split(x, ",", 2)
    city, suffix = strip(F.get(both, F.lit(0))), strip(F.get(both, F.lit(1)))
    return F.when((city != "") & (F.coalesce(suffix, F.lit("x")) != ""), F.struct(city.alias("city"), suffix.alias("suffix")))


def ratio_or(x: Column, y: Column, empty: float) -> Column:
    return F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(empty))


def index_free(path: Column | str) -> Column:
    """items[3].qty -> items[].qty"""
    return F.regexp_replace(_c(path), r"\[\d+\]", "[]")


def outlier_severity(confidence: Column, n: Column) -> Column:
    """Severity of an exception to a learnt rule; rounds half to even."""
    return F.least(F.lit(72), F.bround(38 + 22 * confidence + 4 * F.log2(n)).cast("int"))


# Named character references that a page cleaner resolves, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def clean_text(x: Column | str) -> Column:
    """Named references resolved, white space collapsed, trimmed."""
    out = _c(x)
    for name, value in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return squeeze(out)
