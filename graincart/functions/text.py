"""Text expressions: rendered rows, tokens, slugs, value keys, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def rendered_row(columns: list[str]) -> Column:
    """A line ``name: value`` for each column, white space collapsed; a null gives ``name:``."""
    line = lambda c: F.rtrim(F.concat(F.lit(f"{c}: "), F.coalesce(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")), F.lit(""))))
    return F.concat_ws("\n", *[line(c) for c in columns])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` words, joined by a space; an array of words gives an array of strings."""

    def of(found: Column, n: int) -> Column:
        if n == 1:
            return found
        # the runs of one word less, each with the word behind it
        several = F.greatest(F.size(found) - n + 1, F.lit(0))
        return F.zip_with(F.slice(of(found, n - 1), F.lit(1), several), F.slice(found, F.lit(n), several), lambda run, word: F.concat(run, F.lit(" "), word))

    # as a lambda's variable the words are made once, and not again for each run
    return F.get(F.transform(F.array(words), lambda found: F.concat(*[of(found, n) for n in range(low, high + 1)])), F.lit(0))


def option_slug(option: Column) -> Column:
    """The column suffix of an answer option."""
    return F.concat(F.lit("p_"), F.lower(F.trim(F.regexp_replace(option, "[^A-Za-z0-9]+", "_"), F.lit("_"))))


def snake_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def family_of(column: Column) -> Column:
    return F.substring_index(column, "__", 1)


def short_number(number: Column) -> Column:
    """A double in six significant digits without trailing zeros, in powers of ten below 1e-4 and from 1e6 on.

    What lies halfway in the shortest decimal form is rounded up.
    """
    size = F.when(number == 0, 0.0).otherwise(F.abs(number))
    # the exponent after rounding to six digits
    digits = F.format_string("%.5e", size)
    exponent = F.substring_index(digits, "e", -1).try_cast("int")
    trimmed = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0*$", "")).otherwise(s)
    # of the digits as they are rounded, the point moved to its place
    plain = F.regexp_replace(F.substring_index(digits, "e", 1), r"\.", "")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), plain)
    large = F.concat(F.substring(plain, F.lit(1), exponent + 1), F.lit("."), F.substring(plain, exponent + 2, F.lit(6)))
    power_form = F.concat(trimmed(F.substring_index(digits, "e", 1)), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    text = F.when((exponent < -4) | (exponent >= 6), power_form).otherwise(trimmed(F.when(exponent < 0, small).otherwise(large)))
    return F.concat(F.when(number < 0, "-").otherwise(""), text)


def value_key(column: Column, kind: str) -> Column:
    """A string that names a value of one of the kinds bool, integer, number and text; nulls and NaN are ``missing``."""
    if kind == "bool":
        key = F.concat(F.lit("bool:"), F.when(column, "True").otherwise("False"))
    elif kind == "integer":
        key = F.concat(F.lit("int:"), column.cast("long").cast("string"))
    elif kind == "number":
        number = column.cast("double")
        key = F.when(~F.isnan(number), F.concat(F.lit("num:"), short_number(number)))
    else:
        key = F.concat(F.lit("str:"), column.cast("string"))
    return F.coalesce(key, F.lit("missing"))


def readable_key(key: Column) -> Column:
    return F.regexp_replace(key, "^(bool|int|num|str):", "")


def masked(value: Column) -> Column:
    """The first character and stars; an address keeps the last part of its domain, if that has a dot."""
    stars = F.concat(F.substring(value, 1, 1), F.lit("***"))
    domain = F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    named = F.contains(value, F.lit("@")) & F.contains(domain, F.lit(".")) & (last != "")
    return F.when(named, F.concat(stars, F.lit("."), last)).otherwise(stars)


def hash_draw(text: Column) -> Column:
    """A number in [0, 1] that depends on nothing but ``text``."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64
