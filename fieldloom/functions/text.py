"""String, map and JSON column helpers."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



# --- Fixed values: the characters that count as blank at the ends of a text ---
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Trim every Unicode blank at both ends (Spark's plain ``trim`` knows only the space)."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def filled(c) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(c, F.lit("")) != ""


def plain_spaces(c) -> Column:
    return F.replace(c, F.lit("\xa0"), F.lit(" "))


def contains_any(text, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def fixed(number, digits) -> Column:
    """Number with a set count of decimals, ties to even as in C and Python formatting."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def head(array, n) -> Column:
    return F.slice(array, 1, n)


def preview(c, n) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(c, 1, n)


def ellipsis(c, limit) -> Column:
    """Cut to ``limit`` characters, the last three of them dots."""
    return F.when(F.length(c) > limit, F.concat(preview(c, limit - 3), F.lit("..."))).otherwise(c)


def _pattern(pattern, flags="") -> str:
    """Blanks of any script count as blanks, as in the patterns' origin; costs time, so only where asked for."""
    flags += "U" if r"\s" in pattern else ""
    return f"(?{flags}){pattern}" if flags else pattern


def first_match(text, patterns, flags="") -> Column:
    """First capture group of the first pattern that matches, else the empty string."""
    tries = [F.nullif(F.regexp_extract(text, _pattern(p, flags), 1), F.lit("")) for p in patterns]
    return F.coalesce(*tries, F.lit(""))


def all_matches(text, pattern, group=0, flags="") -> Column:
    return F.regexp_extract_all(text, F.lit(_pattern(pattern, flags)), F.lit(group))


def basename(path) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def last_at(keys, k) -> Column:
    """0-based position of the last ``k`` in an array, NULL when absent."""
    from_end = F.array_position(F.reverse(keys), k)
    return F.when(from_end > 0, F.size(keys) - from_end).cast("int")


def json_span(text) -> Column:
    """Greedy first ``{`` to last ``}`` of a reply, or NULL."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def is_json(text) -> Column:
    return F.try_parse_json(text).isNotNull()


def entity_list(text) -> Column:
    """Comma list to trimmed non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda e: e != "")
