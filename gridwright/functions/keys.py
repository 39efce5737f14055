"""Column expressions that bring names, paths and stand-ins for missing values to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and signs that stand for a missing value, in lower case.
NO_VALUE = (
    "", "nan", "none", "null", "n/a", "na", "n.a.", "<na>", "nat", "nil", "-", "--", "---", "–", "—", "?", "??", ".", "/",
    "unbekannt", "unbek.", "unknown", "k.a.", "k. a.", "keine angabe", "ohne angabe", "missing", "undefined", "not available",
    "inconnu", "inconnue", "brak", "brak danych", "nieznany", "nieznane", "tbd", "xxx",
)

#: A sheet number with variant letters at the start of a name. The letters I, L and O are never variants, so they are misread digits.
TILE_PATTERN = r"^(?:KDR[\s_\-]*([0-9OIL]{1,3})|([0-9][0-9OIL]{0,2}))([A-HJKMNP-Z]{0,4})(?:$|[._\s\-])"
#: The same with what may stand around the name, for a whole path.
PATH_PREFIX = r"^.*[\\/]"


def clean(value: Column) -> Column:
    """Trimmed text; null for blanks and for words or signs that mean "no value"."""
    text = F.trim(F.regexp_replace(value.cast("string"), "[ \t\r\n]", " "))
    return F.when(~F.lower(text).isin(*NO_VALUE), text)


def number(value: Column) -> Column:
    """The double; null for NaN."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def tile_key(name: Column) -> Column:
    """``KDR_`` and three digits and variant letters, whatever way the sheet's name or file is written; null if it names no sheet."""
    base = F.upper(F.trim(F.regexp_replace(F.regexp_replace(name, PATH_PREFIX, ""), "[ \t]", " ")))
    digits = F.translate(F.concat(F.regexp_extract(base, TILE_PATTERN, 1), F.regexp_extract(base, TILE_PATTERN, 2)), "OIL", "011")
    return F.when(digits != "", F.concat(F.lit("KDR_"), F.lpad(digits, 3, "0"), F.regexp_extract(base, TILE_PATTERN, 3)))


def tile_key_sql(name: str) -> str:
    """:func:`tile_key` for DuckDB."""
    base = f"upper(trim(regexp_replace(regexp_replace({name}, '{PATH_PREFIX}', ''), '[ \t]', ' ', 'g')))"
    part = lambda k: f"regexp_extract({base}, '{TILE_PATTERN}', {k})"
    return f"(CASE WHEN {part(1)} || {part(2)} <> '' THEN 'KDR_' || lpad(translate({part(1)} || {part(2)}, 'OIL', '011'), 3, '0') || {part(3)} END)"


def clean_sql(value: str) -> str:
    """:func:`clean` for DuckDB."""
    text = f"trim(regexp_replace({value}, '[ \t\r\n]', ' ', 'g'))"
    words = ", ".join("'" + w + "'" for w in NO_VALUE)
    return f"(CASE WHEN lower({text}) NOT IN ({words}) THEN {text} END)"


def fold(text: Column) -> Column:
    """Lower case, umlauts written out, separators as single blanks, and the short forms of river names in full."""
    out = F.lower(F.regexp_replace(text, r"[_\-\s ]+", " "))
    for short, long in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        out = F.replace(out, F.lit(short), F.lit(long))
    out = F.regexp_replace(out, r"[\p{M}​-‍﻿­]", "")
    out = F.regexp_replace(out, r"\ba\. ?d\. ", "an der ")
    out = F.regexp_replace(out, r"\ba\. ", "am ")
    return F.trim(out)


def boolish(value: Column) -> Column:
    """True for 1, true, yes and on in any case; false for anything else, null included."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def decimal(value: Column) -> Column:
    """A number typed with a decimal point or comma; null if it isn't one."""
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")
