"""Text helpers: statement slice (G05), case-insensitive search (G19),
literal rewrites (G23) and bracket quoting for rendered statements (G24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col_of


def statement_slice(text, start, end) -> Column:
    """Cut one statement out of its batch text by byte offsets.

    ``SUBSTRING(text, start/2 + 1, ((CASE WHEN end = -1 THEN LEN(text)*2 ELSE end
    END - start)/2) + 1)``; a NULL end (deadlock frames) also means "to the end".
    ``LEN`` ignores trailing blanks.  Offsets are bytes of UTF-16 text, two per
    unit, so the text is cut as UTF-16: a character outside the BMP takes two
    units, and half of one that a cut leaves behind shows as U+FFFD.  A negative length
    gives ''; a NULL start gives NULL, as in the source.
    """
    t, s, e = col_of(text), col_of(start).cast("long"), col_of(end).cast("long")
    to_end = e.isNull() | (e == -1)
    # a statement that ends inside its batch needs the batch's first characters only (each has one unit or two)
    first = F.least(F.floor(e / 2) + 3, F.lit(2**31 - 1).cast("long")).cast("int")
    part = F.when(to_end | (e < 0) | s.isNull() | (s < 0), t).otherwise(F.substr(t, F.lit(1), first))
    blanks = F.char_length(t) - F.char_length(F.rtrim(t))

    def cut(units: Column) -> Column:
        stop = F.when(to_end, (F.octet_length(units) - 2 * blanks).cast("long")).otherwise(e)
        return _with(stop - s, lambda diff: F.substr(units, (F.floor(s / 2) * 2 + 1).cast("int"), (_units(diff) * 2).cast("int")))

    # (diff / 2) truncated toward zero, as T-SQL integer division does
    def _units(diff: Column) -> Column:
        return F.greatest(F.when(diff >= 0, F.floor(diff / 2)).otherwise(-F.floor(-diff / 2)).cast("long") + 1, F.lit(0).cast("long"))

    # the high byte of a unit tells the halves of a pair: D8-DB first, DC-DF second
    def shown(units: Column) -> Column:
        low = F.coalesce(F.hex(F.substr(units, F.lit(2), F.lit(1))).between("DC", "DF").cast("int"), F.lit(0))
        high = F.coalesce(F.hex(F.substr(units, F.octet_length(units), F.lit(1))).between("D8", "DB").cast("int"), F.lit(0))
        whole = F.substr(units, 2 * low + 1, F.greatest(F.octet_length(units) - 2 * low - 2 * high, F.lit(0)))
        return F.concat(F.when(low == 1, "\ufffd").otherwise(""), F.decode(whole, "UTF-16LE"), F.when(high == 1, "\ufffd").otherwise(""))

    return _with(_with(F.encode(part, "UTF-16LE"), cut), shown)


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contains_ci(col, needle: str) -> Column:
    """``col LIKE '%needle%'`` under a case-insensitive collation.

    The needle is matched literally (``%`` and ``_`` are not wildcards)."""
    return F.lower(col_of(col)).contains(needle.lower())


def rewrite_text(col, replacements) -> Column:
    """Ordered literal replacements over a column."""
    out = col_of(col)
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def quote_name(col) -> Column:
    """``QUOTENAME(x)``: wrap in brackets, doubling any closing bracket."""
    return F.concat(F.lit("["), F.replace(col_of(col), F.lit("]"), F.lit("]]")), F.lit("]"))


def render_statement(*parts, skip_null: bool = False) -> Column:
    """Build a statement text from literal strings and columns.

    Strings are literals, Columns are values.  Like T-SQL ``+`` a NULL part
    makes the whole text NULL, unless ``skip_null`` (then missing parts are
    left out, as ``CONCAT_WS('')`` would)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    if skip_null:
        return F.concat_ws("", *cols)
    return F.concat(*cols)
