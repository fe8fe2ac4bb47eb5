"""Small SQL-text helpers for the DuckDB oracle (exact decimal rounding,
statement slice)."""

from __future__ import annotations


def ratio(num: str, den: str, scale: int = 2, factor: int = 1, precision: int = 28) -> str:
    """Exact ``CAST(num * factor / den AS DECIMAL(p, s))`` with half-away-from-zero rounding."""
    n = f"(CAST({num} AS HUGEINT) * {factor * 10 ** scale})"
    d = f"CAST({den} AS HUGEINT)"
    unit = "0." + "0" * (scale - 1) + "1" if scale > 0 else "1"
    return (f"(CASE WHEN {d} <> 0 THEN CAST(CAST(sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
            f" AS DECIMAL(38,0)) * {unit} AS DECIMAL({precision},{scale})) END)")


def stmt_slice(text: str, start: str, end: str) -> str:
    """Statement slice counted in UTF-16 units: a character beyond the BMP is a list of two units, told apart
    by two private-use marks; what a cut leaves of only one of them shows as U+FFFD."""
    astral = f"regexp_matches({text}, '[\\x{{10000}}-\\x{{10FFFF}}]')"
    wide = "regexp_replace({}, '[\\x{{10000}}-\\x{{10FFFF}}]', '..', 'g')"
    size = f"(CASE WHEN {astral} THEN length({wide.format(f'rtrim({text})')}) ELSE length(rtrim({text})) END)"
    stop = f"(CASE WHEN {end} IS NULL OR {end} = -1 THEN {size} * 2 ELSE {end} END)"
    begin, count = f"CAST({start} // 2 + 1 AS BIGINT)", f"CAST(greatest(({stop} - {start}) // 2 + 1, 0) AS BIGINT)"
    units = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [c || chr(57345), chr(57344)] ELSE [c] END))"
    cut = f"replace(array_to_string(list_slice({units}, {begin}, {begin} + {count} - 1), ''), chr(57345) || chr(57344), '')"
    cut = f"regexp_replace(regexp_replace({cut}, '.' || chr(57345), '\ufffd', 'g'), chr(57344), '\ufffd', 'g')"
    return (f"(CASE WHEN {start} IS NULL THEN NULL WHEN {astral} THEN {cut}"
            f" ELSE substring({text}, {begin}, {count}) END)")


def idiv(a: str, b: str) -> str:
    """Integer division truncating toward zero, NULL for a zero divisor."""
    return f"(CASE WHEN ({b}) <> 0 THEN CAST(({a}) AS BIGINT) // CAST(({b}) AS BIGINT) END)"
