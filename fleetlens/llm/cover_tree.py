"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are linked when their cosine is at least COSINE; on unit vectors that is a chord of
at most r.  Vectors of a label with equal unit vectors are one class before anything is compared.  The classes of a large
label are dealt to cells, each around a node of a cover tree over a bounded sample; a
cell's covering radius is the largest distance of any of its members, over all rows.  A vector x of one cell can only link with a
member of another if it is within r of that cell's ball (its own distance to the other centre, less the
other's covering radius) and of the half-space of what is nearer to the other centre than to its own.  Vectors that can are
dealt to that pair of cells in blocks of about BLOCK classes, and each pair of blocks is one task; a pair of cells with no such vector
on either side has none.

A task builds one cover tree per block: nested levels whose radii halve, every node with its exact covering radius.
The dual traversal drops a pair of nodes whose centres are further apart than r plus both
radii, links all members of one with all of the other when the centres are nearer than r less both radii,
and otherwise descends; pairs of single vectors are decided by their cosine in double precision.  A task
returns per class the number of vectors linked and a spanning forest of its links,
never the pairs.

Defined results: null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different length don't link; repeated rows are vectors of their own; an empty table gives an
empty result.  In data without any clusters no bound can separate cells, and the work is that of comparing all blocks; there are
SAMPLE_ROWS cells at most, so that beyond about SAMPLE_ROWS x BLOCK classes the work of a cell grows with the square of its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written
from fleetlens.llm.components import components

COSINE = 0.93
BLOCK = 2048
#: Bound on the vectors that cells are chosen from, and on the labels that get more than one cell.
SAMPLE_ROWS = 2048
SAMPLE_LABELS = 512
_EPS = 1e-6


class Tree:
    """A cover tree over unit vectors (one block: their products are taken at once); members of
    every node are a run of ``order``."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.products = x @ x.T
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        self.order: list[int] = []
        if len(x):
            self._grow(np.arange(len(x)))
        del self.products

    def _far(self, members: np.ndarray) -> np.ndarray:
        """Distances of the members from the first."""
        far = np.sqrt(np.maximum(2 - 2 * self.products[members[0], members], 0))
        tiny = np.flatnonzero(far < _EPS)  # too near for products to tell
        far[tiny] = np.sqrt(((self.x[members[tiny]] - self.x[members[0]]) ** 2).sum(axis=1))
        return far

    def _grow(self, members: np.ndarray) -> int:
        node, first = len(self.center), len(self.order)
        far = self._far(members)
        radius = float(far.max())
        self.center.append(int(members[0]))
        self.radius.append(radius)
        self.span.append((first, first))
        self.kids.append([])
        if radius == 0.0:
            self.order += members.tolist()
        else:
            reach = 2.0 ** (math.ceil(math.log2(radius)) - 1)  # the next of the halving radii under this one
            kids = []
            while len(members):
                near = far <= reach
                kids.append(self._grow(members[near]))
                members = members[~near]
                if len(members):
                    far = self._far(members)
            self.kids[node] = kids
        self.span[node] = (first, len(self.order))
        return node


class _Sets:
    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)


def _groups(mask: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Connected groups (rows, columns) of a bipartite relation, isolated ones left out."""
    rows, out = mask.any(axis=1), []
    cols = mask.any(axis=0)
    while rows.any():
        queue, mine, theirs = [int(np.argmax(rows))], [], []
        rows[queue[0]] = False
        while queue:
            i = queue.pop()
            mine.append(i)
            new = np.flatnonzero(mask[i] & cols)
            cols[new] = False
            theirs += new.tolist()
            for j in new:
                more = np.flatnonzero(mask[:, j] & rows)
                rows[more] = False
                queue += more.tolist()
        out.append((mine, theirs))
    return out


def link_blocks(a: np.ndarray, size_a: np.ndarray, b: np.ndarray | None = None, size_b: np.ndarray | None = None,
                cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Links between unit vectors ``a`` and ``b`` (or within ``a``), by dual traversal.

    Returns, over the rows of ``a`` then ``b``, the sizes of all rows linked (within ``a``, itself included) and
    the number of the first row it is joined with over links of this pair of blocks.
    """
    own = b is None
    ta = Tree(a)
    tb = ta if own else Tree(b)
    sb = size_a if own else size_b
    base = 0 if own else len(a)
    sets = _Sets(len(a) if own else len(a) + len(b))
    total = [np.zeros(len(a) + 1, np.int64), np.zeros(len(tb.x) + 1, np.int64)]
    solid = [set(), set()]
    r = math.sqrt(2 - 2 * cosine)
    weight = []
    for t, s in ((ta, size_a), (tb, sb)):
        sums = np.append(0, np.cumsum(s[t.order])) if len(t.order) else np.zeros(1, np.int64)
        weight.append(np.array([sums[hi] - sums[lo] for lo, hi in t.span], np.int64))
    todo = [([0], [0])] if len(a) and len(tb.x) else []
    while todo:
        ka, kb = todo.pop()  # all pairs of the two lists of nodes
        ca, cb = ta.x[[ta.center[k] for k in ka]], tb.x[[tb.center[k] for k in kb]]
        ra, rb = np.array([ta.radius[k] for k in ka]), np.array([tb.radius[k] for k in kb])
        cos = ca @ cb.T
        # pairs beyond r and the largest radii of their kind (single vectors or nodes) need no closer look
        found = []
        for rows in (np.flatnonzero(ra == 0), np.flatnonzero(ra)):
            for cols in (np.flatnonzero(rb == 0), np.flatnonzero(rb)):
                if len(rows) and len(cols):
                    reach = r + ra[rows].max() + rb[cols].max() + _EPS
                    x, y = np.nonzero(cos[np.ix_(rows, cols)] >= 1 - reach * reach / 2 - _EPS)
                    found.append((rows[x], cols[y]))
        i, j = (np.concatenate(x) for x in zip(*found))
        c, slack = cos[i, j], ra[i] + rb[j]
        chord = np.sqrt(np.maximum(2 - 2 * c, 0))
        single = slack == 0
        linked = np.where(single, c >= cosine, chord + slack < r - _EPS)
        unsure = ~linked & ~single & (chord <= r + slack + _EPS)
        # of an open pair the larger node descends; the partners of one node go on together
        for mine, other, kids, names, down in ((i, j, ta.kids, kb, ra[i] >= rb[j]), (j, i, tb.kids, ka, ra[i] < rb[j])):
            at = np.flatnonzero(unsure & down)
            at = at[np.argsort(mine[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(mine[at])) + 1) if len(at) else []:
                node = (ka if mine is i else kb)[mine[part[0]]]
                pair = (kids[node], [names[y] for y in other[part]])
                todo.append(pair if mine is i else pair[::-1])
        i, j = i[linked], j[linked]
        if not len(i):
            continue
        for side, tree, kids, gain in ((0, ta, ka, np.bincount(i, weight[1][kb][j], len(ka))), (1, tb, kb, np.bincount(j, weight[0][ka][i], len(kb)))):
            if side and own:
                continue  # the traversal meets both orders of a pair within one block
            for k in np.flatnonzero(gain):
                lo, hi = tree.span[kids[k]]
                total[side][lo] += int(gain[k])
                total[side][hi] -= int(gain[k])
        if own:  # a node whose members are all linked with each other, or a single vector
            same = np.array(ka)[i] == np.array(kb)[j]
            solid[0].update(ka[x] for x in i[same])
            i, j = i[~same], j[~same]
        rows, cols = np.unique(i), np.unique(j)
        mask = np.zeros((len(rows), len(cols)), bool)
        mask[np.searchsorted(rows, i), np.searchsorted(cols, j)] = True
        for mine, theirs in _groups(mask):
            first = ta.center[ka[rows[mine[0]]]]
            for x in rows[mine]:
                sets.join(first, ta.center[ka[x]])
                solid[0].add(ka[x])
            for y in cols[theirs]:
                sets.join(first, base + tb.center[kb[y]])
                solid[1].add(kb[y])
    for t, nodes, shift in ((ta, solid[0], 0), (tb, solid[1], base)):
        for k in nodes:
            lo, hi = t.span[k]
            for m in t.order[lo:hi]:
                sets.join(shift + t.center[k], shift + m)
    out = [np.zeros(len(a), np.int64), np.zeros(0 if own else len(b), np.int64)]
    out[0][ta.order] = np.cumsum(total[0])[:-1]
    if not own:
        out[1][tb.order] = np.cumsum(total[1])[:-1]
    return np.concatenate(out), np.array([sets.find(i) for i in range(len(sets.root))], np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, _label, _v) with the unit vector, null where the vector can't be compared."""
    for batch in batches:
        v = batch.column("_v")
        size = pc.list_value_length(v).fill_null(0).to_numpy()
        out: list[np.ndarray | None] = [None] * len(size)
        for n in np.unique(size[size > 0]):
            at = np.flatnonzero(size == n)
            x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)
            ok = np.isfinite(x).all(axis=1) & x.any(axis=1)  # null components read as NaN
            x = x[ok] / np.abs(x[ok]).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            for i, u in zip(at[ok], x):
                out[i] = u
        label = batch.column("_label")
        for i in np.flatnonzero(label.is_null().to_numpy(zero_copy_only=False)):
            out[i] = None
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), label, pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "_label", "unit"])


def choose_cells(classes: DataFrame) -> list[tuple]:
    """(group, cell, centre) for groups of more than BLOCK classes, from cover trees over a bounded sample."""
    large = (classes.groupBy("grp").count().filter(F.col("count") > BLOCK)
             .orderBy(F.desc("count"), "grp").limit(SAMPLE_LABELS))
    sample = (classes.join(F.broadcast(large), "grp").orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS)
              .select("grp", "count", "unit").toPandas())
    out = []
    for grp, rows in sample.groupby("grp", sort=True):
        want = math.ceil(rows["count"].iloc[0] / BLOCK)
        tree = Tree(np.stack(rows["unit"].to_numpy()))
        level = [0]
        while len(level) < want and any(tree.kids[k] for k in level):
            level = [c for k in level for c in (tree.kids[k] or [k])]
        level.sort(key=lambda k: tree.span[k][0] - tree.span[k][1])
        out += [(grp, i, tree.x[tree.center[k]].tolist()) for i, k in enumerate(level[:want])]
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id``, ``n_links`` (other vectors linked directly) and
    ``component_id`` (smallest id reachable, its own included)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.mapInArrow(_units, f"vec_id {kinds['vec_id']}, _label {kinds['_label']}, unit array<double>")
    ok = F.col("unit").isNotNull()
    rows = rows.select("vec_id", F.when(ok, F.xxhash64(F.lit(1), "_label", F.size("unit"))).alias("grp"),
                       F.when(ok, F.concat_ws("-", F.hex(F.xxhash64("_label", "unit")), F.hex(F.xxhash64(F.lit(7), "_label", "unit")))).alias("key"), "unit")
    rows = written(rows, "cover-rows")
    classes = (rows.filter("key IS NOT NULL").groupBy("key")
               .agg(F.first("grp").alias("grp"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("first")))
    classes = written(classes, "cover-classes")

    cells = choose_cells(classes)
    centres: dict[int, np.ndarray] = {}
    for grp, _, centre in cells:
        centres.setdefault(grp, []).append(centre)
    shared = spark.sparkContext.broadcast({g: np.array(c) for g, c in centres.items()})  # SAMPLE_ROWS vectors at most

    r = math.sqrt(2 - 2 * cosine)

    def deal(batches):
        gaps = {g: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) for g, c in shared.value.items()}
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cell, far = np.zeros(len(grp), np.int32), np.full(len(grp), 2.0)
            reach: list[list[dict]] = [[] for _ in grp]
            x = batch.column("unit")
            for g in np.unique(grp):
                if g in shared.value:
                    at = np.flatnonzero(grp == g)
                    m = x.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                    square = np.maximum(2 - 2 * (m @ shared.value[g].T), 0)
                    own = square.argmin(axis=1)
                    cell[at], least = own, square.min(axis=1)
                    far[at] = np.sqrt(least)
                    # distance to the half-space nearer to another centre: (square - least) / (2 gap)
                    near = square - least[:, None] <= 2 * (r + _EPS) * gaps[g][own] + _EPS
                    near[np.arange(len(at)), own] = False
                    for i, row, d in zip(at, near, np.sqrt(square)):
                        reach[i] = [{"other": int(c), "away": float(d[c])} for c in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("key"), batch.column("n"), batch.column("unit"), pa.array(cell), pa.array(far),
                 pa.array(reach, pa.list_(pa.struct([("other", pa.int32()), ("away", pa.float64())])))],
                names=["grp", "key", "n", "unit", "cell", "far", "reach"])

    dealt = classes.select("grp", "key", "n", "unit").mapInArrow(
        deal, "grp long, key string, n long, unit array<double>, cell int, far double, reach array<struct<other: int, away: double>>")
    dealt = written(dealt, "cover-dealt")
    balls = written(dealt.groupBy("grp", F.col("cell").alias("other")).agg(F.max("far").alias("radius")), "cover-cells")

    def sides(*columns: str) -> DataFrame:
        """Vectors by the pairs of cells in which they can link, their own cell first."""
        own = F.array(F.struct(F.col("cell").alias("other"), F.lit(0.0).alias("away")))
        rows = dealt.select("grp", "cell", "key", *columns, F.inline(F.concat(own, "reach")))
        return rows.join(balls, ["grp", "other"]).filter(F.col("away") <= F.col("radius") + r + _EPS).drop("away", "radius")

    counts = written(sides().groupBy("grp", "cell", "other").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cover-counts")
    theirs = counts.select("grp", F.col("other").alias("cell"), F.col("cell").alias("other"), F.col("blocks").alias("partners"))
    pairs = written(counts.join(theirs, ["grp", "cell", "other"]), "cover-pairs")  # a table's size is known, a join's is not
    spread = (sides("n", "unit").join(pairs, ["grp", "cell", "other"])
              .withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks").cast("long")).cast("int"))
              .withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("partners") - 1))))
    first = F.expr("cell < other OR (cell = other AND block <= partner)")
    work = spread.select("grp", F.when(first, F.concat_ws(":", "cell", "block", "other", "partner")).otherwise(
        F.concat_ws(":", "other", "partner", "cell", "block")).alias("pair"), F.when(first, 0).otherwise(1).alias("side"), "key", "n", "unit")

    def link(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.lexsort((table.column("key").to_numpy().astype(str), side))
        table, side = table.take(pa.array(order)), side[order]
        x = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        n, key = table.column("n").to_numpy(), table.column("key").to_numpy()
        cut = int((side == 0).sum())
        if cut == 0:
            total, root = np.zeros(len(side), np.int64), np.arange(len(side))
        elif table.column("pair")[0].as_py().split(":")[:2] == table.column("pair")[0].as_py().split(":")[2:]:
            total, root = link_blocks(x, n, cosine=cosine)
        else:
            total, root = link_blocks(x[:cut], n[:cut], x[cut:], n[cut:], cosine=cosine)
        return pa.table({"key": key, "total": total, "root": key[root]})

    found = written(work.groupBy("grp", "pair").applyInArrow(link, "key string, total long, root string"), "cover-links")
    links = found.groupBy("key").agg((F.sum("total") - 1).alias("n_links"))
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")), "cover-components")
    rooted = written(classes.join(roots, F.col("key") == F.col("node"), "left")
                     .select("key", "first", F.coalesce("root", "key").alias("root")), "cover-roots")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    result = rooted.join(lowest, "root").join(links, "key").select("key", "n_links", "component_id")
    return (rows.join(result, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id")))
