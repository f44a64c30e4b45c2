"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score. Built-in functions only.

A pattern is applied twice, by ``regexp_extract_all`` for the matches and by ``split`` for the text between them; the running sum
of both lengths gives the code point offsets. Patterns are written so that a regular expression engine with backtracking needs linear
time: runs are possessive, and a run is tried at its first character only, where a later start could not match either.

The base kinds are reported whenever their own rule holds, whatever the score. The added kinds (``iban``, ``national_id``)
are reported from ``LEAST_SCORE`` up: an account number needs its mod-97 remainder, and a national number, which has no checksum,
needs a context word close by.

Defined cases: a null text counts as empty and has no spans; equal rows give equal results; spans of one kind never overlap, spans
of several kinds may; every other column passes through, and a clash with the result column raises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import unused

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id")
KINDS = BASE_KINDS + ADDED_KINDS
LEAST_SCORE = 0.5
NEAR = 40

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# What every match must hold: spares most texts the pattern.
HINTS = {"email": "@", "phone": "+", "ip": ".", "national_id": "-"}
# Score of a match that passes its checks, before context.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto", "national_id": "ssn|social|security|identity|national",
}
CONTEXT_BONUS = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def starts_of(lengths: Column) -> Column:
    """Exclusive running sums, by blocks of about the root of the size, so that texts with very many matches stay affordable."""
    def blocked(pair):
        values, width = pair["values"], pair["width"]
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")), lambda b: total(F.slice(values, b * width + 1, width)))
        return let(sums, lambda s: F.transform(values, lambda _, i: total(F.slice(s, F.lit(1), F.floor(i / width).cast("int")))
                                               + total(F.slice(values, F.floor(i / width).cast("int") * width + 1, i % width))))

    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    return let(F.struct(lengths.alias("values"), width.alias("width")), blocked)


def matches_of(text: Column, kind: str) -> Column:
    """array<struct<value, start, end, before, after>> of all matches of the kind's pattern, leftmost first and not overlapping."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<value:string,start:bigint,end:bigint,before:string,after:string>>")

    def placed(p):
        whole = F.zip_with(p["between"], p["values"], lambda b, v: F.length(b).cast("long") + F.length(F.coalesce(v, F.lit(""))))
        return let(starts_of(F.slice(whole, F.lit(1), F.size(p["values"]))), lambda starts: F.transform(p["values"], lambda v, i: F.struct(
            v.alias("value"), (starts[i] + F.length(p["between"][i])).alias("start"),
            (starts[i] + F.length(p["between"][i]) + F.length(v)).alias("end"),
            F.right(p["between"][i], F.lit(NEAR)).alias("before"), F.left(p["between"][i + 1], F.lit(NEAR)).alias("after"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) == 0, none).otherwise(
        let(F.struct(values.alias("values"), F.split(text, pattern, -1).alias("between")), placed)))
    if kind in HINTS:
        found = F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(none)
    return found


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Remainder 1 of an account number read as digits, its first four characters moved to the end, letters as 10 to 35?"""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def is_valid(kind: str, m: Column) -> Column:
    """The kind's own rule for one match."""
    value = m["value"]
    alone = ~F.regexp_like(F.right(m["before"], F.lit(1)), F.lit("[A-Za-z0-9]")) & ~F.regexp_like(F.left(m["after"], F.lit(1)), F.lit("[A-Za-z0-9]"))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    if kind == "iban":
        return alone & F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & mod97(value)
    if kind == "national_id":
        return alone & ~F.regexp_like(value, F.lit("^(000|666|9)")) & ~F.regexp_like(value, F.lit("-00-|-0000$"))
    return F.lit(True)


def score_of(kind: str, m: Column) -> Column:
    near = F.lower(F.concat(m["before"], F.lit(" "), m["after"]))
    return F.lit(SCORES[kind]) + F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))


def spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>> in the order of KINDS, then by start."""
    def of(kind):
        valid = F.filter(matches_of(text, kind), lambda m: is_valid(kind, m))
        scored = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.least(F.lit(1.0), score_of(kind, m)).alias("score")))
        return scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)

    return F.concat(*[of(kind) for kind in KINDS])


def find_pii(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with the spans of each text."""
    if into in docs.columns:
        raise ValueError(f"docs has a column {into} already")
    return docs.withColumn(into, let(F.coalesce(F.col(text_col), F.lit("")), spans))


def mask(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind; where spans overlap, the first one's kind stands for all."""
    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                   F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"))

    in_order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("reach"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(
        F.aggregate(in_order, first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with masked texts; the spans are not kept. A null text stays null."""
    into = unused("pii", docs.columns)
    marked = find_pii(docs, text_col, into)
    return marked.withColumn(text_col, F.when(F.size(into) == 0, F.col(text_col)).otherwise(mask(F.col(text_col), F.col(into)))).drop(into)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans, and all spans."""
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: reduce(lambda a, b: a | b, [s["kind"] == k for k in BASE_KINDS]))
    return find_pii(docs.select("doc_id", "text")).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def _sql() -> str:
    """The same spans in DuckDB, from the plain patterns; its engine has no lookaround and needs none, as it never backtracks."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([ -]?[0-9])+", "phone": PATTERNS["phone"], "iban": PATTERNS["iban"], "national_id": PATTERNS["national_id"],
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    alone = "NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')"
    compact = "replace(value, ' ', '')"
    valid = {
        "email": "true", "ip": "list_max(list_transform(string_split(value, '.'), lambda p: p::DECIMAL(38, 0))) <= 255",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 "
                f"THEN {digits}[-i]::INT WHEN {digits}[-i]::INT > 4 THEN 2 * {digits}[-i]::INT - 9 ELSE 2 * {digits}[-i]::INT END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{alone} AND length({compact}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split({compact}[5:] || {compact}[:4], ''), "
                "lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)), "
                "lambda a, d: (a * CASE WHEN d < 10 THEN 10 ELSE 100 END + d) % 97) = 1",
        "national_id": f"{alone} AND NOT regexp_matches(value, '^(000|666|9)') AND NOT regexp_matches(value, '-00-|-0000$') "
                       f"AND regexp_matches(lower(before || ' ' || after), '{CONTEXT['national_id']}')",
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        parts.append(f"""SELECT row_id, {rank} AS rank, '{kind}' AS kind, start, start + length(value) AS stop FROM (
            SELECT row_id, m[i] AS value, right(b[i], {NEAR}) AS before, left(b[i + 1], {NEAR}) AS after,
                   coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                SELECT row_id, regexp_extract_all(text, '{plain[kind]}') AS m, string_split_regex(text, '{plain[kind]}') AS b FROM docs) WHERE len(m) > 0)
            ) WHERE {valid[kind]}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"count(s.kind) FILTER (s.kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    label = "s.kind || ':' || s.start::BIGINT || ':' || s.stop::BIGINT"
    return f"""WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
        spans AS ({' UNION ALL '.join(parts)})
        SELECT any_value(d.doc_id) AS doc_id, {counts},
               sha256(coalesce(string_agg({label}, ',' ORDER BY s.rank, s.start) FILTER (s.kind IN ({base})), '')) AS base_sha256,
               coalesce(string_agg({label}, ',' ORDER BY s.rank, s.start), '') AS spans
        FROM docs d LEFT JOIN spans s USING (row_id) GROUP BY row_id"""


SQL = _sql()
