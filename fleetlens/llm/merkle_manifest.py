"""Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf; the leaves of a group (a language) ascend by id and every two consecutive nodes become
one, the last alone if their number is odd, until one is left, the group's subroot.  The subroots, ordered by group,
become the root in the same way.  H is the lowercase hex SHA-256 of its concatenated inputs, digests as hex text.

Proofs.  Every node holds a pointer to its parent and, as a segment, the record of its sibling (side and digest).
A self-join on the pointer doubles the distance to the ancestor and concatenates the two segments; it is repeated until
every leaf's pointer is past the root, so the number of rounds is the logarithm of the height.  In round j leaves
point 2**j levels up, so of the inner nodes only those on levels that 2**j divides (and those
above the subroots, whose distance to the leaves differs by group) are still jumped to; the others are left out.

Scale.  Leaves are hashed where their text is read; only ids and digests move.  Positions come from a range sort
(the first number of every sorted partition, carried forward per group), so a group with a third of all rows is dealt over
many tasks.  Levels are built 2**BITS consecutive nodes at a time, a bounded group.  In the late rounds many
leaves point to few nodes; these are written tables, which the planner broadcasts when their files are small enough,
and a shuffle join's keys hold 2**(2**j) leaves at most.  To the driver come the root and the largest height.

Defined results: a null value counts as ``-``; leaves of equal ids ascend by digest, null ids and the null group come
first; repeated rows are leaves of their own; a group of one row is its own subroot, a single
subroot is the root; an empty table gives an empty result; further columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, written

#: Levels built by one grouping: 2**BITS nodes are a group.
BITS = 8
#: The tree above the subroots.
TOP = -1
#: Bytes of a proof's record: 0 (no sibling), 1 (sibling on the left) or 2 (on the right), and its digest.
RECORD = 33

_LONE = bytes(RECORD)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(text: Column) -> Column:
    """H of a text, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf(*values: Column) -> Column:
    """H of values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    texts = [v.cast("string") for v in values]
    return joined(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def records(path: Column) -> Column:
    """The records of a proof, from the leaf upwards."""
    n = F.length(path) / RECORD
    return F.when(n < 1, F.array().cast("array<binary>")).otherwise(
        F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(path, i * RECORD + 1, F.lit(RECORD))))


def _side(record: Column) -> Column:
    return F.hex(F.substring(record, 1, 1))


def _sibling(record: Column) -> Column:
    return hexed(F.substring(record, 2, RECORD - 1))


def siblings(path: Column) -> Column:
    """The digests of a proof's siblings, joined in order."""
    there = F.filter(records(path), lambda r: _side(r) != "00")
    return F.array_join(F.transform(there, _sibling), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its proof, as hex."""
    def up(now: Column, r: Column) -> Column:
        return F.sha2(F.when(_side(r) == "01", F.concat(_sibling(r), now)).when(_side(r) == "02", F.concat(now, _sibling(r))).otherwise(now), 256)

    return F.aggregate(records(path), hexed(digest), up)


def _height(size: Column) -> Column:
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _placed(rows: DataFrame, group: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``rows`` with their positions ``pos`` inside their group in ascending order (null first); (``group``, ``n_rows``); and
    the tables behind both."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = written(dealt.withColumn("_row", F.monotonically_increasing_id()), label)
    dealt = table.withColumn("_part", F.shiftright("_row", 33))
    runs = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    all_ = W.partitionBy(group)  # a row for each sorted partition at most
    before = F.coalesce(F.sum("_n").over(all_.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = written(runs.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"),
                               F.sum("_n").over(all_).alias("_size")), f"{label}-runs")
    found = dealt.join(runs, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    out = found.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("pos"))
    return out, runs.groupBy(F.col("_group").alias(group)).agg(F.max("_size").alias("n_rows")), [table, runs]


def _pairs(level: Column) -> Column:
    """The next level of a run of nodes."""
    half = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(half, lambda i: joined(F.concat(hexed(F.get(level, i * 2)), F.coalesce(hexed(F.get(level, i * 2 + 1)), F.lit("")))))


def _record(level: Column, i: Column) -> Column:
    right = F.get(level, i + 1)
    return (F.when(i % 2 == 1, F.concat(F.lit(b"\1"), F.get(level, i - 1)))
            .when(right.isNotNull(), F.concat(F.lit(b"\2"), right)).otherwise(F.lit(_LONE)))


def _blocks(rows: DataFrame, base: int, label: str) -> DataFrame:
    """Runs of 2**BITS consecutive nodes of level ``base`` (``tree``, ``height``, ``pos``, ``digest``, ``item``) with their levels above."""
    runs = rows.groupBy("tree", "height", F.shiftright("pos", BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("members"))
    runs = runs.withColumn("l0", F.transform("members", lambda m: m["digest"]))
    for k in range(BITS):
        runs = runs.withColumn(f"l{k + 1}", _pairs(F.col(f"l{k}")))
    levels = F.array(*[F.col(f"l{k}") for k in range(BITS + 1)])
    return written(runs.select("tree", "height", "block", F.col("members.item").alias("items"), levels.alias("levels"), F.lit(base).alias("base")), label)


def _up(tree: Column, height: Column, level: Column, pos: Column) -> Column:
    """A node's parent; a group's subroot is a leaf of the tree above."""
    return F.when((level + 1 >= height) & (tree != TOP), _node(F.lit(TOP), F.lit(0), tree)).otherwise(_node(tree, level + 1, F.shiftright(pos, 1)))


def _nodes(blocks: DataFrame, first: int) -> DataFrame:
    """(``node``, ``up``, ``path``) of the blocks' nodes from their level ``first`` on, without subroots and root."""
    def of(k: int) -> Column:
        level = F.col("levels")[k]
        return F.transform(F.filter(F.transform(level, lambda x, i: i), lambda i: F.col("base") + k < F.col("height")),
                           lambda i: F.struct((F.col("base") + k).alias("level"), (F.shiftleft("block", BITS - k) + i).alias("pos"), _record(level, i).alias("path")))

    each = blocks.select("tree", "height", F.inline(F.flatten(F.array(*[of(k) for k in range(first, BITS)]))))
    return each.select(_node(F.col("tree"), F.col("level"), F.col("pos")).alias("node"), _up(F.col("tree"), F.col("height"), F.col("level"), F.col("pos")).alias("up"), "path")


def _build(rows: DataFrame, most: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All blocks of trees of a height of ``most`` or less, and their tops (``tree``, ``digest``)."""
    blocks, tops, base = [], None, 0
    while True:
        blocks.append(_blocks(rows, base, f"{label}-{base}"))
        left = F.col("height") - base
        ready = blocks[-1].filter(left <= BITS).select("tree", F.get(F.get("levels", left), F.lit(0)).alias("digest"))
        tops = ready if tops is None else tops.unionByName(ready)
        if base + BITS >= most:
            return blocks, tops
        rows = blocks[-1].filter(left > BITS).select("tree", "height", F.col("block").alias("pos"), F.get(F.col("levels")[BITS], F.lit(0)).alias("digest"),
                                                     F.lit(None).cast("int").alias("item"))
        base += BITS


def _jump(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """``rows`` (``up``, ``path``) with the distance to their ancestors doubled."""
    there = pointers.select(F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("path").alias("_path"))
    kept = [c for c in rows.columns if c not in ("up", "path")]
    return (rows.join(there, F.col("up") == F.col("_node"), "left")
            .select(*kept, F.col("_up").alias("up"), F.concat("path", F.coalesce("_path", F.lit(b""))).alias("path")))


def _node(tree: Column, level: Column, pos: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), pos.cast("long").alias("pos"))


def _leaves(blocks: DataFrame) -> DataFrame:
    """(``tree``, ``item``, ``up``, ``path``) of the leaves of all groups; a subroot's path is empty yet."""
    each = blocks.select("tree", "height", "block", F.inline(F.transform("items", lambda x, i: F.struct(
        x.alias("item"), i.alias("i"), _record(F.col("levels")[0], i).alias("path")))))
    alone = F.col("height") == 0
    pos = F.shiftleft("block", BITS) + F.col("i")
    up = F.when(alone, _node(F.lit(TOP), F.lit(0), F.col("tree"))).otherwise(_up(F.col("tree"), F.col("height"), F.lit(0), pos))
    return each.select("tree", "item", up.alias("up"), F.when(alone, F.lit(b"")).otherwise(F.col("path")).alias("path"))


def manifest(docs: DataFrame, fields: list[str], id_col: str, group_col: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id`` and the columns of ``carry``, its ``leaf`` (32 bytes, of ``fields``), the ``subroot`` of its
    group and the ``root`` (hex), and its proof ``path`` (see :func:`records`, :func:`siblings`, :func:`folded`)."""
    carry = carry or {}
    extra = [f"c{i}" for i in range(len(carry))]
    plain = written(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf(*[F.col(f) for f in fields]).alias("leaf"),
                                *[c.alias(n) for n, c in zip(extra, carry.values())]), "merkle-leaves")
    rows, groups, behind = _placed(plain, "grp", ["id", "leaf"], "merkle-sorted")
    dropped(plain)
    trees, all_groups, more = _placed(groups.withColumn("one", F.lit(0)), "one", ["grp"], "merkle-groups")
    trees = written(trees.select(F.col("grp").alias("_grp"), F.col("pos").alias("tree"), _height(F.col("n_rows")).alias("height")), "merkle-trees")
    most, top = trees.agg(F.max("height")).first()[0] or 0, all_groups.select(_height(F.col("n_rows"))).first()
    top = top[0] if top else 0

    item = F.struct("id", "leaf", *extra)
    rows = rows.join(trees, F.col("grp").eqNullSafe(F.col("_grp"))).select("tree", "height", "pos", F.col("leaf").alias("digest"), item.alias("item"))
    blocks, subroots = _build(rows, most, "merkle-blocks")
    subroots = written(subroots, "merkle-subroots")
    dropped(*behind, *more, trees)
    above, roots = _build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top).alias("height"), F.col("tree").alias("pos"), "digest",
                                          F.lit(None).cast("int").alias("item")), top, "merkle-top")
    root = roots.first()
    nodes = [_nodes(b, 0 if i else 1) for i, b in enumerate(blocks)] + [_nodes(b, 0) for b in above]
    pointers = written(reduce(DataFrame.unionByName, nodes), "merkle-pointers-0")
    dropped(*blocks[1:], *above)

    found = _leaves(blocks[0])
    rounds = (most + top).bit_length()
    for j in range(rounds):
        found = _jump(found, pointers)
        if j + 1 < rounds:
            still = pointers.filter((F.col("node.tree") == TOP) | (F.col("node.level") % (2 << j) == 0))
            pointers = written(_jump(still, pointers), f"merkle-pointers-{j + 1}")
    found = found.join(subroots.select(F.col("tree").alias("_tree"), hexed(F.col("digest")).alias("subroot")), F.col("tree") == F.col("_tree"))
    return found.select("item.id", *[F.col(f"item.{n}").alias(c) for n, c in zip(extra, carry)], "item.leaf", "subroot",
                        F.lit(root["digest"].hex() if root else None).alias("root"), "path")
