"""Quality rules as a learned decision list.

Statistics of each whole text are computed in one pass; rules are threshold
conjunctions over ratios of those statistics, learned by sequential covering from
a bounded sample of labelled rows and emitted as one ordered Spark conditional
expression (``CASE WHEN rule 1 ... WHEN rule 2 ... ELSE keep``).

Defined results: a null text counts as empty (all statistics 0, base_failed); rows
that repeat are judged each on their own; an empty table gives an empty result;
without labels of both classes there are no rules and only the base rules hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import add_columns, bounded_labels, free_name

SYMBOLS = b"#*$%&|<>"
STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
         "n_repeat_words": "long", "n_lines": "long", "n_upper": "long", "n_marks": "long"}
_UPPER = bytes(range(65, 91))
_SPACE = b" \t\n\x0b\x0c\r"

#: Bound on the labelled rows a decision list is learned from.
SAMPLE_ROWS = 12_000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule is kept when at least this share of the held-back rows it covers is bad.
MIN_PRECISION = 0.9


def repeated_window_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = seq[:n]
    for k in range(1, size):
        if k > 1:  # keep the running key small enough for the next product
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + seq[k:n + k]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[back] > 1)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    lines = dups = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    return (len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), dups,
            repeated_window_words(words), lines, len(raw) - len(raw.translate(None, _UPPER)),
            len(raw) - len(raw.translate(None, b"!?")))


def add_stats(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one column per statistic; the second value maps the statistic to
    its column (lengthened where ``df`` already has such a name)."""
    names = {k: free_name(df, k) for k in STATS}
    out = add_columns(df, text, {names[k]: v for k, v in STATS.items()},
                      lambda: lambda texts: list(zip(*map(text_stats, texts))) or [[] for _ in STATS])
    return out, names


def features(col: dict[str, Column]) -> dict[str, Column]:
    """The ratios that rules test, from the statistics; 0 where a text has no word."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "n_words": col["n_words"].cast("double"),
        "chars_per_word": ratio(col["word_chars"], col["n_words"]),
        "symbols_per_word": ratio(col["n_symbols"], col["n_words"]),
        "dup_line_share": ratio(col["n_dup_lines"], col["n_lines"]),
        "repeat_share": ratio(col["n_repeat_words"], col["n_words"]),
        "upper_share": ratio(col["n_upper"], col["word_chars"]),
        "marks_per_word": ratio(col["n_marks"], col["n_words"]),
    }


def base_failed(col: dict[str, Column]) -> Column:
    return (col["n_words"] < 50) | (100 * col["n_repeat_words"] > 50 * col["n_words"])


Condition = tuple[str, str, float]  # feature, ">=" or "<", threshold


def _covers(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, op, at in rule:
        out &= x[name] >= at if op == ">=" else x[name] < at
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, only: str | None = None) -> tuple[float, Condition] | None:
    """The threshold (of feature ``only``, if given) with the largest information gain (FOIL) over the rows ``inside``."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return None
    before = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition] | None = None
    for name in [only] if only else sorted(x):
        v, y = x[name][inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(y)[cuts - 1]
        for op, p, total in (("<", below, cuts), (">=", p0 - below, len(v) - cuts)):
            gain = p * (np.log2(np.maximum(p, 1e-9) / total) - before)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = float(gain[k]), (name, op, float((v[cuts[k] - 1] + v[cuts[k]]) / 2))
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[list[Condition]]:
    """Sequential covering, an ordered list of reject rules.

    In each round one conjunction per first feature is grown on the rows not in ``prune``, and its last
    conditions are cut while that does not lower its value on the rows in ``prune``; of those
    precise on both, the one that covers most bad rows (a good one counts against ten) is kept, the rows
    it covers are removed, and the next round begins.
    """
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), bool)

    def counts(rule: list[Condition], among: np.ndarray) -> tuple[int, int]:
        c = among & _covers(x, rule)
        return int((c & bad).sum()), int((c & ~bad).sum())

    def value(rule: list[Condition]) -> float:
        p, n = counts(rule, left & prune)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rules) < MAX_RULES:
        grow, best, best_score = left & ~prune, None, 0
        for first in sorted(x):
            rule, only, inside = [], first, grow
            while len(rule) < MAX_CONDITIONS and (found := _best_condition(x, bad, inside, only)):
                rule, only = rule + [found[1]], None
                inside = grow & _covers(x, rule)
            while len(rule) > 1 and value(rule[:-1]) >= value(rule):
                rule = rule[:-1]
            if not rule:
                continue
            p, n = counts(rule, left)
            precise = value(rule) >= 2 * MIN_PRECISION - 1 and p >= MIN_PRECISION * (p + n)
            if precise and p - 10 * n > best_score:
                best, best_score = rule, p - 10 * n
        if best is None:
            break
        rules.append(best)
        left &= ~_covers(x, best)
    return rules


def rule_expression(rules: list[list[Condition]], feature: dict[str, Column]) -> Column:
    """One ordered conditional expression: the number of the first rule that fires, else null."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, at in rule:
            test &= feature[name] >= F.lit(at) if op == ">=" else feature[name] < F.lit(at)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
        label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Learn a decision list from at most ``sample_rows`` labelled rows of ``docs``.

    Only the sample's statistics come to the driver; a third of it (by hash of the
    id) is held back for pruning.
    """
    sample = bounded_labels(labels, sample_rows, id_col, label_col)
    own = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
           .join(F.broadcast(sample), "_id").dropDuplicates(["_id"]))
    stats, names = add_stats(own, "_text")
    feature = features({k: F.col(v) for k, v in names.items()})
    rows = (stats.select("_id", "_label", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)).alias("_fold"),
                         *[v.alias(k) for k, v in feature.items()])
            .orderBy("_id").toPandas())
    if rows.empty or rows["_label"].nunique() < 2:
        return []
    return learn_rules({k: rows[k].to_numpy(float) for k in feature}, (rows["_label"] == 0).to_numpy(),
                       (rows["_fold"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its statistics, ``base_failed``, ``rule`` (number of the first rule
    that rejects, null if none) and ``kept``; the second value names those columns."""
    stats, names = add_stats(docs, text)
    col = {k: F.col(f"`{v}`") for k, v in names.items()}
    names |= {k: free_name(stats, k) for k in ("base_failed", "rule", "kept")}
    out = (stats.withColumn(names["base_failed"], base_failed(col))
           .withColumn(names["rule"], rule_expression(rules, features(col))))
    return out.withColumn(names["kept"], ~F.col(names["base_failed"]) & F.col(names["rule"]).isNull()), names


def describe(rules: list[list[Condition]]) -> list[str]:
    """The rules in words, in order."""
    return [" and ".join(f"{n} {op} {at:.6g}" for n, op, at in r) + " -> reject" for r in rules]
