"""Document fingerprints: a Merkle tree over paragraphs and sections, with DataFrame functions only.

Paragraphs are a text's lines; a line of more than LONG code points is cut after its sentences, and a sentence of more than
ENDLESS into pieces of PIECE.  A section starts at a heading (a line that begins with ``#``) and at a paragraph whose digest
starts with a zero digit (about every sixteenth), so that an edit moves the borders next to it only.  A section's digest is
that of its paragraphs' digests, and the root that of the sections': equal roots mean equal texts.

A fingerprint is one string, ``root;section[paragraph,...];...``: the whole root, 16 hex digits of each branch, and every
paragraph's length after its digits.  Two fingerprints are compared from the root downwards: equal roots end it, sections that
both have are not opened, and only the others' paragraphs are compared.  Likeness is twice the code points both have over those of both,
each paragraph counted once; :func:`differences` gives the places of the paragraphs that the other text lacks.

Scale.  All work is per row; texts are read and hashed in the scan.  :func:`with_following` moves each text once: bounds of equally many
rows come from the ids and hashes alone, and only the last text of a block travels to the next one.  Repeated rows spread over
several blocks.

Defined results: a null text counts as empty; an empty text has a root and no sections, and is as like as 1 to an empty one and 0
to any other; rows of equal id ascend by the hash of their text, null ids come before all others; a single row follows
itself; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, written

LONG = 256
ENDLESS = 1024
PIECE = 512
#: Hex digits of a branch in a fingerprint.
DIGITS = 16
#: Rows of a block of :func:`with_following`, and most blocks (their bounds are one literal).
BLOCK_ROWS = 256
MOST_BLOCKS = 1 << 16


def paragraphs(text: Column) -> Column:
    """The pieces of a text, which joined give it back."""
    lines = F.split(text, r"(?<=\n)")
    sentences = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) <= LONG, F.array(x)).otherwise(F.split(x, r"(?<=[.!?]\s)"))))
    pieces = F.flatten(F.transform(sentences, lambda x: F.when(F.length(x) <= ENDLESS, F.array(x)).otherwise(
        F.regexp_extract_all(x, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)))))
    return F.filter(pieces, lambda x: x != "")


def fingerprinted(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``rows`` with a fingerprint (a new column, the dict's value) of each text column (its key)."""
    out = rows
    for text, name in texts.items():
        own = {k: free_name(out, f"_{k}") for k in ("leaves", "starts", "sections")}
        out = out.withColumn(own["leaves"], F.transform(paragraphs(F.coalesce(F.col(text), F.lit(""))), lambda x: F.struct(
            F.sha2(x, 256).alias("digest"), F.length(x).alias("n"), x.startswith("#").alias("heading"))))
        leaves, starts = F.col(own["leaves"]), F.col(own["starts"])
        first = lambda x, i: F.when((i == 0) | x["heading"] | x["digest"].startswith("0"), i)
        out = out.withColumn(own["starts"], F.filter(F.transform(leaves, first), lambda i: i.isNotNull()))
        cut = F.transform(starts, lambda s, j: F.slice(leaves, s + 1, F.coalesce(F.get(starts, j + 1), F.size(leaves)) - s))
        out = out.withColumn(own["sections"], F.transform(cut, lambda sec: F.struct(
            F.sha2(F.array_join(F.transform(sec, lambda x: x["digest"]), ""), 256).alias("digest"),
            F.array_join(F.transform(sec, lambda x: F.concat(F.left(x["digest"], F.lit(DIGITS)), x["n"].cast("string"))), ",").alias("leaves"))))
        sections = F.col(own["sections"])
        shown = F.transform(sections, lambda s: F.concat(F.left(s["digest"], F.lit(DIGITS)), F.lit("["), s["leaves"], F.lit("]")))
        root = F.sha2(F.array_join(sections["digest"], ""), 256)
        out = out.withColumn(name, F.array_join(F.concat(F.array(root), shown), ";")).drop(*own.values())
    return out


def root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, ";", 1)


def _sections(fingerprint: Column) -> Column:
    return F.filter(F.split(fingerprint, ";"), lambda s: s.contains("["))


def _leaves(sections: Column) -> Column:
    """The paragraphs of sections, each once."""
    inner = F.array_join(F.transform(sections, lambda s: F.substr(s, F.lit(DIGITS + 2), F.length(s) - DIGITS - 2)), ",")
    return F.array_distinct(F.filter(F.split(inner, ","), lambda p: p != ""))


def _chars(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, p: n + F.substr(p, F.lit(DIGITS + 1)).cast("long"))


def with_likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the likeness (0 to 1) of two fingerprint columns under each name of ``pairs``."""
    out = rows
    for name, (a, b) in pairs.items():
        own = {k: free_name(out, f"_{k}") for k in ("a", "b", "same", "left", "right")}
        c = {k: F.col(v) for k, v in own.items()}
        equal = root(F.col(a)) == root(F.col(b))
        out = out.withColumns({own["a"]: F.when(~equal, _sections(F.col(a))), own["b"]: F.when(~equal, _sections(F.col(b)))})
        out = out.withColumns({own["same"]: _leaves(F.array_intersect(c["a"], c["b"])), own["left"]: _leaves(F.array_except(c["a"], c["b"])),
                               own["right"]: _leaves(F.array_except(c["b"], c["a"]))})
        both, one, other = _chars(c["same"]), _chars(c["left"]), _chars(c["right"])
        shared = both + _chars(F.array_intersect(c["left"], c["right"]))
        out = out.withColumn(name, F.when(equal, 1.0).otherwise(2.0 * shared / (2 * both + one + other))).drop(*own.values())
    return out


def differences(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """The paragraphs of fingerprint ``a`` that ``b`` lacks in rows of different roots: ``key``, ``start`` and ``end`` (code points of ``a``'s text).
    ``key`` tells the rows apart."""
    unlike = rows.filter(root(F.col(a)) != root(F.col(b))).select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    each = lambda side: F.split(F.array_join(F.transform(_sections(F.col(side)), lambda s: F.substr(s, F.lit(DIGITS + 2), F.length(s) - DIGITS - 2)), ","), ",")
    mine = unlike.select("key", F.posexplode(each("a")).alias("at", "leaf")).filter("leaf <> ''")
    mine = mine.withColumn("n", F.substr("leaf", F.lit(DIGITS + 1)).cast("long"))
    mine = mine.withColumn("end", F.sum("n").over(W.partitionBy("key").orderBy("at")))
    theirs = unlike.select("key", F.explode(each("b")).alias("leaf")).distinct()
    return (mine.join(theirs, mine["key"].eqNullSafe(theirs["key"]) & (mine["leaf"] == theirs["leaf"]), "left_anti")
            .select(F.col("key").alias(key), (F.col("end") - F.col("n")).alias("start"), "end"))


def _block(bounds: list, kind: str, key: Column) -> Column:
    """How many of the ascending bounds are not above a key (binary search in one literal)."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([{"id": b[0], "h": b[1], "salt": b[2]} for b in bounds])), f"array<struct<id:{kind},h:bigint,salt:bigint>>")
    steps = [F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) <= key, low + step).otherwise(low))


def with_following(docs: DataFrame, id_col: str, text: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``id``, ``text``, ``following``): every text (null as empty) with that of the next row by descending id; the first row follows the last."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    keys = written(rows.select("id", "h", "salt"), "following-keys")
    n = keys.count()
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("salt")]
    step = max(block_rows, -(-n // MOST_BLOCKS))
    bounds: list = []
    if n > step:  # the keys at every step of each sorted partition; the smallest of all is no bound
        dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        found = dealt.filter(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % step == 0).orderBy("at").select("id", "h", "salt").collect()
        bounds = [tuple(r) for r in found[1:]]
    key = F.struct("id", "h", "salt")
    block = _block(bounds, kind, key)

    # the last row of each block is also what the first of the next block is followed by
    last = keys.groupBy(block.alias("block")).agg(F.max(key).alias("k")).select("block", F.col("k.id").alias("_id"), F.col("k.h").alias("_h"))
    last = written(last.withColumn("block", (F.col("block") + 1) % (len(bounds) + 1)), "following-last")
    wanted = F.broadcast(last.select("_id", "_h").distinct())  # one row for each block at most
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi").dropDuplicates(["id", "h"])
    heads = texts.join(last, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("block", "id", "h", "salt", "text", F.lit(True).alias("head"))

    dealt = rows.select(block.alias("block"), "id", "h", "salt", "text", F.lit(False).alias("head")).unionByName(heads)
    run = W.partitionBy("block").orderBy(F.col("head").desc(), *order)
    return dealt.withColumn("following", F.lag("text").over(run)).filter(~F.col("head")).select("id", "text", "following")


def edited(text: Column, following: Column) -> Column:
    """A text whose second half (rounded down) is replaced by as many first code points of another one, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))
