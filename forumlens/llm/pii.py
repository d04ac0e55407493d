"""Personal data, with built-in functions only.

Each kind has a regular expression that proposes spans, a check that confirms them (Luhn for card
numbers, mod-97 for IBANs, octet and digit-count limits), a score, and words that raise the score
when they stand near. Spans of the base kinds stay once confirmed; spans of the other kinds stay if
their score reaches ``threshold``.

Positions: splitting a text at the same expression gives the gaps between its matches, so a match
starts where the gaps and matches before it end. Sums run over blocks of matches, so a text with very
many matches stays affordable.

The expressions are written for one pass without backtracking over long runs: a run is entered at its
start only (or where the last match ended), and loops are possessive. They find what the plain
leftmost, non-overlapping expressions find; the card expression further tells the length of a whole
digit chain, so chains of other lengths are passed over as a failed match would be. An IBAN's loop is
bound by the length of its country.

Edge cases: a null text counts as empty; texts without a match have no spans; repeated ids give a row
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str  # a cheap SQL condition on ``text`` without which there's no match
    confirm: str  # SQL condition on the match ``m``
    score: float
    context: str  # words that raise the score
    bonus: float
    base: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IBAN = "regexp_replace(m, ' ', '')"
_MOD97 = (
    f"aggregate(transform(sequence(1, length({_IBAN})), p -> ascii(substr(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), p, 1))),"
    " 0, (r, c) -> if(c <= 57, (r * 10 + c - 48) % 97, (r * 100 + c - 55) % 97)) = 1"
)

# Length -> the countries with IBANs of so many characters. The length tells where an
# IBAN ends, so what follows it (a capitalised word, capitals, a number) isn't taken for a part of it.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_IBAN_FORMS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())

KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "contains(text, '@')",
        "true",
        0.8,
        "mail|contact|write|kontakt|correo|courriel",
        0.2,
        True,
    ),
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        "text rlike '[0-9][.][0-9]'",
        rf"m rlike '^(?:{_OCTET}[.]){{3}}{_OCTET}$'",
        0.6,
        "ip|address|host|server|adresse",
        0.3,
        True,
    ),
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
        "text rlike '[0-9][0-9 -]{12}'",
        f"luhn_check({_DIGITS})",
        0.8,
        "card|visa|mastercard|amex|karte|tarjeta|carte",
        0.2,
        True,
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "contains(text, '+')",
        f"length({_DIGITS}) between 10 and 15",
        0.7,
        "phone|tel|call|mobile|fax|telefon",
        0.3,
        True,
    ),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?:{_IBAN_FORMS})(?![A-Za-z0-9])",
        "text rlike '[A-Z]{2}[0-9]{2}'",
        _MOD97,
        0.8,
        "iban|bank|account|konto|cuenta|compte",
        0.2,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "text rlike '[0-9]-[0-9]{2}-[0-9]'",
        "not m rlike '^(?:000|666|9)|-00-|-0000$'",
        0.2,
        "ssn|social security",
        0.7,
    ),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "struct<start: bigint, rank: int, kind: string, end: bigint, score: double>"


def _spans(kind: Kind, rank: int, threshold: float) -> str:
    """SQL: the confirmed spans of a kind, from its matches and the gaps between them."""
    n = kind.name
    block = f"cast(i div {BLOCK} as int)"
    start = (
        f"element_at({n}_base, {block} + 1) + element_at({n}_gap, i + 1)"
        f" + aggregate(slice({n}_step, {block} * {BLOCK} + 1, cast(i % {BLOCK} as int)), 0L, (a, x) -> a + x)"
    )
    near = (
        f"lower(concat(right(element_at({n}_gaps, i + 1), {CONTEXT_CHARS}), ' ',"
        f" left(element_at({n}_gaps, i + 2), {CONTEXT_CHARS}))) rlike '\\\\b(?:{kind.context})'"
    )
    built = (
        f"transform(sequence(0, size({n}_all) - 1), i -> named_struct('m', element_at({n}_all, i + 1), 'start', {start},"
        f" 'score', least(1.0D, {kind.score}D + if({near}, {kind.bonus}D, 0.0D))))"
    )
    confirm = kind.confirm.replace("(m,", "(s.m,").replace("m rlike", "s.m rlike")
    keep = confirm if kind.base else f"({confirm}) and s.score >= {threshold}D"
    return (
        f"case when size({n}_all) > 0 then transform(filter({built}, s -> {keep}), s -> named_struct('start', s.start,"
        f" 'rank', {rank}, 'kind', '{n}', 'end', s.start + length(s.m), 'score', s.score))"
        f" else cast(array() as array<{_SPAN}>) end"
    )


def _staged(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *(f"{sql} as {name}" for name, sql in columns.items()))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, spans): spans are (start, rank, kind, end, score), by start and kind, in code points."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = "cast(array() as array<string>)"
    rows = _staged(
        rows,
        {f"{k.name}_all": f"case when {k.maybe} then regexp_extract_all(text, {_quoted(k.pattern)}, 0) else {none} end" for k in KINDS},
    )
    rows = _staged(
        rows, {f"{k.name}_gaps": f"case when size({k.name}_all) > 0 then split(text, {_quoted(k.pattern)}, -1) else {none} end" for k in KINDS}
    ).drop("text")
    rows = _staged(rows, {f"{k.name}_gap": f"transform({k.name}_gaps, g -> cast(length(g) as bigint))" for k in KINDS})
    rows = _staged(
        rows, {f"{k.name}_step": f"zip_with({k.name}_all, slice({k.name}_gap, 1, size({k.name}_all)), (m, g) -> length(m) + g)" for k in KINDS}
    )
    blocks = "transform(sequence(0, size({n}_step) div {b}), b -> aggregate(slice({n}_step, cast(b * {b} + 1 as int), {b}), 0L, (a, x) -> a + x))"
    rows = _staged(rows, {f"{k.name}_sum": blocks.format(n=k.name, b=BLOCK) for k in KINDS})
    base = "transform(sequence(0, size({n}_sum) - 1), b -> aggregate(slice({n}_sum, 1, b), 0L, (a, x) -> a + x))"
    rows = _staged(rows, {f"{k.name}_base": base.format(n=k.name) for k in KINDS})
    found = ", ".join(_spans(k, i, threshold) for i, k in enumerate(KINDS))
    return rows.selectExpr("id", f"array_sort(flatten(array({found}))) as spans")
