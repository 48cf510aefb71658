"""Near-duplicate vectors by counting collisions in sorted one-dimensional projections."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.common import checkpointed, hinted
from vecpack.llm.components import connected_components
from vecpack.llm.memory import give_back

#: Hyperplanes whose sides make the cells, of which each list takes some.
PLANES = 512
#: Rows of a cell, at most on average; rows of a cell that are compared in one place: a larger cell is compared piece by piece.
CELL, PIECE = 512, 1024
#: Sorted projections, and the half-width of their windows in standard deviations of a pair that is just at the threshold.
PROJECTIONS, WIDTH = 16, 2.25
#: Query rows whose collisions are counted at a time; components of rows that are placed at a time.
AT_A_TIME, ROWS_AT_A_TIME = 64, 2_000_000


@dataclass(frozen=True)
class Plan:
    """How many projections must have a pair in one window, and how the sorted lists are cut so that pairs meet.

    A pair collides in a projection if one lies in the window of half-width ``window`` around the other, and is
    verified if it collides in ``count`` of PROJECTIONS or more: the most that a pair just at the threshold
    reaches with the wanted recall. Rows further apart than ``frame`` in the first sorted list aren't looked at:
    hardly any such pair is. A window that holds such pairs holds half of all other rows too, so that counting
    over a whole sorted list would be quadratic: the lists are cut into cells, the sign patterns of
    ``bits`` hyperplanes, and counted within them. ``lists`` cuts are as many as make such a pair share a cell
    with the wanted recall, averaged over how many of all planes have the pair on one side. Cells stay of one
    size, so the comparisons of a row grow as the number of lists: by a power of 0.22 of the rows at 0.9.
    """

    bits: int
    lists: int
    count: int
    window: float
    frame: float

    @staticmethod
    def of(rows: int, threshold: float, recall: float) -> Plan:
        lost = (1 - recall) / 3  # by the count, the cells and the frame
        inside = math.erf(WIDTH / math.sqrt(2))
        reached = [sum(math.comb(PROJECTIONS, k) * inside**k * (1 - inside) ** (PROJECTIONS - k) for k in range(least, PROJECTIONS + 1)) for least in range(PROJECTIONS + 1)]
        count = max(k for k in range(PROJECTIONS + 1) if reached[k] >= 1 - lost)
        bits = min(50, max(0, math.ceil(math.log2(max(rows, 1) / CELL))))
        side = 1 - math.acos(threshold) / math.pi
        weights = [math.comb(PLANES, a) * side**a * (1 - side) ** (PLANES - a) for a in range(bits, PLANES + 1)]
        shared = [math.prod((a - k) / (PLANES - k) for k in range(bits)) for a in range(bits, PLANES + 1)]

        def missed(lists: int) -> float:
            return 1 - sum(weights) + sum(w * (1 - p) ** lists for w, p in zip(weights, shared, strict=True))

        least, most = 0, 1
        while missed(most) > lost:
            least, most = most, 2 * most
        while most - least > 1:
            half = (least + most) // 2
            least, most = (half, most) if missed(half) > lost else (least, half)
        deviation = math.sqrt(2 - 2 * threshold)
        return Plan(bits, most, count, WIDTH * deviation, -NormalDist().inv_cdf(lost / 2) * deviation)


@lru_cache(8)
def _directions(plan: Plan, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (dim x PLANES), powers of two by list for their sides, and the sorted projections (dim x PROJECTIONS)."""
    rng = np.random.default_rng([dim, plan.bits, plan.lists])
    weights = np.zeros((PLANES, plan.lists))
    for t in range(plan.lists):
        weights[rng.choice(PLANES, plan.bits, replace=False), t] = 2.0 ** np.arange(plan.bits)
    return rng.standard_normal((dim, PLANES)), weights, rng.standard_normal((dim, PROJECTIONS))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _places(x: np.ndarray, plan: Plan) -> np.ndarray:
    """Cell of each unit vector in each list."""
    planes, weights, _ = _directions(plan, x.shape[1])
    return ((x @ planes > 0) @ weights).astype(np.int64)


def _by_dim(vectors: pa.Array):
    """(row numbers, matrix) of the vectors of each length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[begin[rows][:, None] + np.arange(dim)]


def _cells(plan: Plan, whole: bool):
    """(node, copies, vector) -> (dim, list, cell) and, if ``whole``, the row itself, once for each list."""

    def run(batches):
        for batch in batches:
            for rows, matrix in _by_dim(batch.column(2)):
                step = max(1, ROWS_AT_A_TIME // (plan.lists * max(matrix.shape[1], PLANES // plan.lists)))
                for i in range(0, len(rows), step):
                    cells = _places(_unit(matrix[i : i + step]), plan)
                    n, lists = cells.shape
                    columns = [pa.array(np.full(n * lists, matrix.shape[1], np.int32)), pa.array(np.tile(np.arange(lists, dtype=np.int32), n)), pa.array(cells.ravel())]
                    if whole:
                        columns += [batch.column(k).take(pa.array(np.repeat(rows[i : i + step], lists))) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "list", "cell", "node", "copies", "vector"][: len(columns)])

    return run


def _linked(x: np.ndarray, values: np.ndarray, piece: np.ndarray | None, plan: Plan, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of one cell, sorted by the first projection, that collide often enough and are near.

    Of the rows that lie within the frame around some rows in the first list, it's counted in how many lists they
    lie in those rows' windows. ``piece`` tells two pieces apart, whose rows are compared across only.
    """
    ends = np.searchsorted(values[:, 0], values[:, 0] + plan.frame, side="right")
    found = []
    for k in range(0, len(x), AT_A_TIME):
        rows = np.arange(k, min(k + AT_A_TIME, len(x)))
        others = np.arange(k + 1, ends[rows[-1]])
        if not len(others):
            continue
        met = (others > rows[:, None]) & (others < ends[rows][:, None])
        if piece is not None:
            met &= piece[others] != piece[rows][:, None]
        count = np.zeros(met.shape, np.int8)
        for column in values.T:
            count += np.abs(column[others] - column[rows][:, None]) <= plan.window
        a, b = np.nonzero(met & (count >= plan.count))
        a, b = rows[a], others[b]
        for i in range(0, len(a), 8192):
            p, q = a[i : i + 8192], b[i : i + 8192]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            found.append((p[near], q[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def _compare(plan: Plan, threshold: float):
    """Sorted rows of whole cells (or pairs of pieces of large ones) -> (node, root, links).

    For each vector that a piece links: the copies that it is linked with there, and one edge of a forest. A
    pair counts in the first list where it shares a cell: each row's cells in the others follow from its vector.
    """

    def groups(batches):
        """(key, node, copies, piece, vectors) of whole groups; a group is at most two pieces."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while (cut := _first_group(held)) < held.num_rows:
                yield held.slice(0, cut)
                held = held.slice(cut)
            held = held.combine_chunks()
        if held is not None:
            yield held

    def run(batches):
        for group in groups(batches):
            vectors = group["vector"].combine_chunks()
            ((_, matrix),) = _by_dim(vectors if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks))
            at, two = group["list"][0].as_py(), group["lo"][0].as_py() != group["hi"][0].as_py()
            node, copies, piece = (group[k].to_numpy() for k in ("node", "copies", "piece"))
            x = _unit(matrix)
            cells = _places(x, plan)[:, :at]
            if len(x) < 2 or (cells == cells[0]).all(axis=0).any():  # all pairs have met before
                continue
            values = x @ _directions(plan, x.shape[1])[2]
            order = np.argsort(values[:, 0], kind="stable")
            x, values, cells, node, copies, piece = x[order], values[order], cells[order], node[order], copies[order], piece[order]
            i, j = _linked(x, values, piece if two else None, plan, threshold)
            new = np.concatenate([~(cells[i[k : k + 8192]] == cells[j[k : k + 8192]]).any(axis=1) for k in range(0, len(i), 8192)]) if len(i) else np.zeros(0, bool)
            i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            root = _roots(len(x), i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]]), pa.array(links[some].astype(np.int64))], names=["node", "root", "links"])
        give_back()

    return run


def _first_group(rows: pa.Table) -> int:
    """How many rows the first group has."""
    change = np.zeros(rows.num_rows - 1, bool)
    for k in ("dim", "list", "cell", "lo", "hi"):
        column = rows[k].to_numpy()
        change |= column[1:] != column[:-1]
    return int(change.argmax()) + 1 if change.any() else rows.num_rows


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.999) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of ``df``.

    Vectors of equal length are linked if their cosine, in double precision, is at least ``threshold``.
    Each linked pair is found with a probability of at least about ``recall``; none is found that isn't
    linked. component_id is the smallest key that links reach, the row's own included. Vectors that are
    null, empty or zero, or have null or non-finite components, are linked with nothing. Repeated rows and
    equal vectors are linked with each other; copies collapse to one before anything is compared, and come
    back each with its own row. Null keys never name a component (null if it has no other row).

    Links aren't listed: a cell gives each of its vectors a count and one edge of a forest, so that a large
    group costs comparisons but no rows. A cell of many rows is compared by pairs of pieces, and the cells that
    are large are counted before they are broadcast. Very long vectors are fine; an empty table gives an empty
    one; other columns aren't used.
    """
    source = df.select(F.col(f"`{key}`").alias("vec_key"), F.col(f"`{vector}`").alias("vector"))
    rows = source.where(_valid(F.col("vector")))
    grouped = rows.groupBy("vector").agg(F.min("vec_key").alias("least"), F.count("*").alias("copies"))
    nodes = checkpointed(grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "least", "copies"))
    plan = Plan.of(nodes.count(), threshold, recall)

    cell = ["dim", "list", "cell"]
    rows_of = nodes.select("node", "copies", "vector")
    large = rows_of.mapInArrow(_cells(plan, False), "dim int, list int, cell long").groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > PIECE)
    large = checkpointed(large.select(*cell, F.ceil(F.col("size") / PIECE).alias("pieces")))
    placed = rows_of.mapInArrow(_cells(plan, True), T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("list", T.IntegerType()), T.StructField("cell", T.LongType()), *rows_of.schema.fields]))
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    split = placed.join(hinted(large, large.count(), 64), cell, "left").withColumn("piece", F.pmod(F.xxhash64("node"), pieces)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    group = [*cell, "lo", "hi"]
    paired = split.select(*cell, F.least("piece", "other").alias("lo"), F.greatest("piece", "other").alias("hi"), "piece", "node", "copies", "vector")
    dealt = paired.repartition(*group).sortWithinPartitions(*group)
    found = checkpointed(dealt.mapInArrow(_compare(plan, threshold), "node long, root long, links long").groupBy("node", "root").agg(F.sum("links").alias("links")))

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    known = nodes.join(counts, "node", "left").join(roots, "node", "left").select("vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component")), "root").select("vector", "n_links", "component")
    good = rows.join(named, "vector").select("vec_key", "n_links", "component")
    alone = source.where(~_valid(F.col("vector"))).select("vec_key", F.lit(0).cast("long").alias("n_links"), F.col("vec_key").alias("component"))
    return good.unionByName(alone).select(F.col("vec_key").alias(key), "n_links", F.col("component").alias("component_id"), F.col("vec_key").eqNullSafe(F.col("component")).alias("kept"))
