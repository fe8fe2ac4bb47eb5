"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns are counted in tokens (runs of letters, digits or other marks), and prefix sums of the counts choose turn-aligned
spans: a turn belongs to the span in whose stretch of STRIDE tokens it starts; a turn of more than
LONG tokens is a span of its own.  A window holds the conversation's system turn, limited history
(the last turns before the span, at most HISTORY_TURNS of them and HISTORY tokens) and the span's turns.
So a window keeps the budget (STRIDE + LONG + HISTORY tokens beside the system turn) unless one turn alone
exceeds it; turns are never cut.  The loss mask covers assistant texts of the span only: repeated
targets are masked out, so that every assistant text counts exactly once.

Template: ``<s>role\\ntext</s>`` per turn, a user's text inside ``[INST] `` and `` [/INST]``.  Control strings in a text
get a backslash after their first character (one more where there are some), which reading back
removes; roles also have line breaks and percent signs percent-encoded.

Scale.  Turns are dealt by conversation and run of BLOCK turns, so a conversation with a third of all turns is
spread out; spans end at a run's end, and the last turns of a run travel to the next as its history.
Within a run, rows beyond BLOCK (repeated turn numbers) start another group.

Defined results: rows are ordered by turn (null first), role and text; null text and null role count as
empty; null ids are a conversation; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRIDE = 1024
LONG = 512
HISTORY = 256
HISTORY_TURNS = 4
BLOCK = 64

_TOKENS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
_CONTROL = r"(/?(?:s>|INST\]))"
_OPEN, _CLOSE = "[INST] ", " [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _is_user(role: Column) -> Column:
    return role == "user"


def format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return F.concat(F.lit("<s>"), _role_out(role), F.lit("\n"),
                    F.when(_is_user(role), F.concat(F.lit(_OPEN), body, F.lit(_CLOSE))).otherwise(body), F.lit("</s>"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = _role_in(F.substring_index(F.substr(p, F.lit(4)), "\n", 1))
        body = F.substr(p, F.lit(5) + F.length(F.substring_index(F.substr(p, F.lit(4)), "\n", 1)))
        inner = F.substr(body, F.lit(len(_OPEN) + 1), F.length(body) - len(_OPEN) - len(_CLOSE))
        return F.struct(role.alias("role"), unescape(F.when(_is_user(role), inner).otherwise(body)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per window: ``conv_id``, ``at`` (orders a conversation's windows), ``n_repeated`` (leading turns that
    are not the span's own), ``n_turns`` (the span's own), ``formatted`` and ``loss`` (ranges of code points)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.coalesce(F.regexp_count("text", F.lit(_TOKENS)), F.lit(0)).cast("long"))
    block = F.floor(F.col("turn") / BLOCK)
    late = F.col("turn") - block * BLOCK >= BLOCK - HISTORY_TURNS
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    rows = rows.withColumn("to", F.explode(F.when(late, F.array(own, F.struct((block + 1).alias("block"), F.lit(False).alias("own")))).otherwise(F.array(own))))
    rows = rows.select("conv_id", "turn", "role", "text", "tokens", "to.*")

    run = W.partitionBy("conv_id", "block").orderBy("own", "turn", "role", "text")
    rows = rows.withColumn("grp", F.floor(F.sum(F.col("own").cast("int")).over(run.rowsBetween(W.unboundedPreceding, -1)) / BLOCK))
    rows = rows.withColumn("grp", F.coalesce("grp", F.lit(0)))
    by = W.partitionBy("conv_id", "block", "grp").orderBy("own", "turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(by), F.lit(0))
    mine = lambda c: F.when(F.col("own"), c).otherwise(F.lit(0))
    rows = rows.withColumn("is_long", F.col("tokens") > LONG)
    rows = rows.withColumns({"start": before(F.col("tokens")), "mine": before(mine(F.col("tokens"))), "longs": before(mine(F.col("is_long").cast("int")))})
    # the span's number: long turns so far, then whether it is one, then the stretch in which it starts
    span = F.struct("longs", "is_long", F.when(F.col("is_long"), F.lit(0)).otherwise(F.floor(F.col("mine") / STRIDE)).alias("cell"))
    rows = rows.select("conv_id", "block", "grp", F.struct("own", "turn", "role", "text", "start", "tokens", span.alias("span")).alias("t"))
    groups = rows.groupBy("conv_id", "block", "grp").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    spans = F.array_distinct(F.transform(F.filter("ts", lambda t: t["own"]), lambda t: t["span"]))
    cut = groups.select("conv_id", "block", "grp", "ts", F.explode(spans).alias("span"))
    cut = cut.withColumn("new", F.filter("ts", lambda t: t["own"] & (t["span"] == F.col("span"))))
    begins = F.col("new")[0]["start"]
    first = F.filter("ts", lambda t: (~t["own"] | (t["span"] < F.col("span"))) & (t["start"] >= begins - HISTORY))
    cut = cut.withColumn("old", F.slice(first, F.greatest(F.size(first) - HISTORY_TURNS + 1, F.lit(1)), HISTORY_TURNS)).drop("ts")

    system = (turns.select(F.col(conv).alias("_c"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"))
              .filter("role = 'system'").groupBy("_c").agg(F.min(F.struct("turn", "role", "text")).alias("system")))
    cut = cut.join(system, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    shown = F.exists(F.concat("old", "new"), lambda t: (t["role"] == "system") & t["turn"].eqNullSafe(F.col("system.turn")) & (t["text"] == F.col("system.text")))
    pick = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    lead = F.when(F.col("system").isNotNull() & ~shown, F.array(F.struct(F.col("system.role").alias("role"), F.col("system.text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    cut = cut.withColumn("again", F.concat(lead, pick(F.col("old")))).withColumn("own", pick(F.col("new")))
    cut = cut.withColumn("pieces", F.transform(F.concat("again", "own"), lambda t: format_turn(t["role"], t["text"])))
    n = F.size("again")
    place = lambda i: F.aggregate(F.slice("pieces", F.lit(1), n + i), F.lit(0), lambda s, p: s + F.length(p))
    head = F.lit(len("<s>assistant\n"))
    loss = F.filter(F.transform("own", lambda t, i: F.when(t["role"] == "assistant", F.struct(
        (place(i) + head).alias("start"), (place(i) + head + F.length(escape(t["text"]))).alias("end")))), lambda s: s.isNotNull())
    return cut.select("conv_id", F.struct("block", "grp", "span").alias("at"), n.alias("n_repeated"), F.size("own").alias("n_turns"),
                      F.array_join("pieces", "").alias("formatted"), loss.alias("loss"))


def conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: ``conv_id``, ``n_turns``, ``turns`` (role, line
    break, text, line break for each), ``loss_text`` and ``formatted_chars``.

    A conversation's text is one value here, so this step, unlike :func:`windows`, needs it in one task.
    """
    back = F.slice(read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns"))
    text = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.select("conv_id", F.size(back).cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
                            F.struct("at", text.alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("loss")).alias("w"))
    all_ = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    return all_.select("conv_id", "n_turns", F.array_join("ws.turns", "").alias("turns"), F.array_join("ws.loss", "").alias("loss_text"), "formatted_chars")
