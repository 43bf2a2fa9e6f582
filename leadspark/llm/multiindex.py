r"""Embedding near-dedup by an inverted multi-index.

Vectors are scaled to length one. Two codebooks, trained on the two halves of a
bounded sample, span a grid of cells (nearest first-half centroid, nearest
second-half centroid); every vector lies in one cell. A query visits cells in
the order of their summed half distances (the multi-sequence order) up to a
reach of its own: the distance of its own cell plus a margin. The margin is
measured, not guessed: a bounded sample of queries is compared with all rows in
blocks, and the margin is the least that visits RECALL of their true links, and
RECALL of made-up neighbours at just the threshold. Visited cells are verified
in double precision.

A pair may be met from both sides: it counts for its second vector only where
that one does not visit the first one's cell. Equal vectors are searched once
and count with their number; a cell's members and its visitors are both split
into blocks, and one task compares a block with a block; it returns counts and a
spanning star, never all pairs. The grid grows with the distinct vectors.

A vector that is null, empty, zero, or holds a null or non-finite component
links with nothing. Vectors of different lengths don't link. A null vec_id
counts as a link of others but is never a component's smallest id, nor kept. Repeated
rows are copies: they link with each other, and each gets its row. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
#: Share of the sampled true links that the visits must reach.
RECALL = 0.999
#: Vectors the codebooks are trained on; queries the margin is measured on.
SAMPLE, QUERIES = 8192, 256
#: Distinct vectors that a cell holds on average.
CELL = 512
#: Distinct vectors that a block of a cell's members, or of its visitors, holds.
BLOCK = 2048


def _usable(vector: str):
    """The vector where it can link, else null."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine & F.exists(v, lambda x: x != 0), v)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so that no square overflows)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


class Grid:
    """Codebooks of one vector length."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        rng = np.random.default_rng(3)
        self.books = [self._train(sample[:, :self.half], k, rng), self._train(sample[:, self.half:], k, rng)]
        self.margin = 0.0

    @staticmethod
    def _train(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
        centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            near = distances(x, centers).argmin(axis=1)
            size = np.bincount(near, minlength=len(centers))
            total = np.zeros_like(centers)
            np.add.at(total, near, x)
            centers = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centers)
        return centers

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to both codebooks."""
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def excess(self, a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How much farther than its own cell each of ``cell`` is."""
        i, j = np.divmod(cell, len(self.books[1]))
        at = np.arange(len(a))
        return a[at, i] + b[at, j] - a.min(axis=1) - b.min(axis=1)

    def visits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cells of one vector in the order of summed distance, up to the margin."""
        a, b = a - a.min(), b - b.min()
        order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b = a[order_a], b[order_b]
        reach = np.searchsorted(b, self.margin - a, side="right")
        i = np.repeat(np.arange(len(a)), reach)
        j = np.arange(len(i)) - np.repeat(np.concatenate([[0], np.cumsum(reach)[:-1]]), reach)
        return (order_a[i] * len(b) + order_b[j])[np.argsort(a[i] + b[j], kind="stable")]


def _probed(grid: Grid, sample: np.ndarray, threshold: float) -> float:
    """The margin that visits RECALL of made-up neighbours: vectors at just the
    threshold from sampled ones, in random directions."""
    rng = np.random.default_rng(9)
    x = np.repeat(sample[:QUERIES * 8], 4, axis=0)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    y = np.where(length > 1e-9, threshold * x + math.sqrt(1 - threshold ** 2) * y / np.maximum(length, 1e-9), x)
    one, other = grid.halves(x), grid.halves(y)
    need = np.minimum(grid.excess(*one, grid.cell(*other)), grid.excess(*other, grid.cell(*one)))
    return float(np.quantile(need, RECALL))


def _measured(some: DataFrame, grid: Grid, threshold: float) -> float:
    """The margin that visits RECALL of the true links of sampled queries."""
    spark = some.sparkSession
    queries = unit(np.array(some.orderBy(F.xxhash64("vid", F.lit(1)), "vid").limit(QUERIES).toPandas()["v"].tolist(),
                            dtype=np.float64))
    sent = spark.sparkContext.broadcast((queries, grid))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, g = sent.value
        a, b = g.halves(q)
        for batch in batches:
            x = unit(_matrix(batch.column(0)))
            i, j = np.nonzero(q @ x.T >= threshold)
            one, other = (a[i], b[i]), g.halves(x[j])
            need = np.minimum(g.excess(*one, g.cell(*other)), g.excess(*other, g.cell(*one))) if len(i) else np.zeros(0)
            # the margins needed, as a histogram: bounded, whatever the links' number
            step, n = np.unique(np.ceil(need * 1000).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], names=["step", "n"])

    rows = (some.select("v").mapInArrow(compare, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
            .orderBy("step").collect())
    total, held = sum(n for _, n in rows), 0
    for step, n in rows:
        held += n
        if held >= RECALL * total:
            return step / 1000
    return 0.0


def centroids(n: int) -> int:
    """Centroids of a half, for CELL of n distinct vectors in a cell."""
    return int(max(1, math.sqrt(n / CELL)))


def dealt(some: DataFrame, grid: Grid) -> DataFrame:
    """The vectors ``vid, v, copies`` dealt into groups ``cell, part, turn``: a
    block of a cell's members (``home``) with a block of its visitors, so that
    each member meets each visitor once. Members visit their own cell as well."""
    spark = some.sparkSession
    kind = dict(some.dtypes)["v"]
    sent = spark.sparkContext.broadcast(grid)
    cells = len(grid.books[0]) * len(grid.books[1])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            a, b = g.halves(unit(_matrix(batch.column(0))))
            cell, members = np.unique(g.cell(a, b), return_counts=True)
            visited, visitors = np.unique(np.concatenate([g.visits(*x) for x in zip(a, b)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cell, visited]).astype(np.int64)),
                 pa.array(np.concatenate([members, np.zeros(len(visited), np.int64)]).astype(np.int64)),
                 pa.array(np.concatenate([np.zeros(len(cell), np.int64), visitors]).astype(np.int64))],
                names=["cell", "members", "visitors"])

    sizes = (some.select("v").mapInArrow(counted, "cell long, members long, visitors long").groupBy("cell")
             .agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors"))
             .filter("members > 0").toPandas())  # a row per cell: one for CELL vectors on average
    blocks = np.zeros((2, cells), dtype=np.int32)
    blocks[:, sizes["cell"].to_numpy(np.int64)] = -(-sizes[["members", "visitors"]].to_numpy(np.int64).T // BLOCK)
    split = spark.sparkContext.broadcast(blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        parts, turns = split.value
        for batch in batches:
            vid = batch.column(0).to_numpy(zero_copy_only=False)
            a, b = g.halves(unit(_matrix(batch.column(1))))
            own = g.cell(a, b)
            held: list[tuple[int, int, int, bool, int]] = []
            for k in range(len(vid)):
                v, home = int(vid[k]), int(own[k])
                held += [(home, v % int(parts[home]), t, True, k) for t in range(turns[home])]
                for c in g.visits(a[k], b[k]).tolist():
                    if parts[c]:
                        turn = v % int(turns[c])
                        held += [(c, p, turn, False, k) for p in range(parts[c])]
                if len(held) > 5000 or k + 1 == len(vid):
                    cell, part, turn, at_home, row = zip(*held)
                    taken = batch.take(pa.array(row, pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int64()), pa.array(part, pa.int32()), pa.array(turn, pa.int32()),
                         pa.array(at_home, pa.bool_()), *taken.columns],
                        names=["cell", "part", "turn", "home", "vid", "v", "copies"])
                    held = []

    return some.select("vid", "v", "copies").mapInArrow(
        deal, f"cell long, part int, turn int, home boolean, vid long, v {kind}, copies long")


def linked(vectors: DataFrame, grid: Grid, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors ``vid, v, copies``: counts ``vid, n`` of linked rows
    and links ``a, b`` that span the same components as all links found."""
    sent = vectors.sparkSession.sparkContext.broadcast(grid)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        g = sent.value
        # a member that visits its own cell may be here in both roles
        vid, first, place = np.unique(rows["vid"].to_numpy(np.int64), return_index=True, return_inverse=True)
        home = rows["home"].to_numpy(bool)
        copies = rows["copies"].to_numpy(np.int64)[first]
        x = unit(np.array(rows["v"].iloc[first].tolist(), dtype=np.float64))
        members, visitors = np.sort(place[home]), np.sort(place[~home])
        counts = np.zeros(len(x), dtype=np.int64)
        root = np.arange(len(x))
        a, b = g.halves(x)
        own = g.cell(a, b)
        for at in range(0, len(visitors), BLOCK):
            some = visitors[at:at + BLOCK]
            i, j = np.nonzero(x[some] @ x[members].T >= threshold)
            i, j = some[i], members[j]
            i, j = i[i != j], j[i != j]
            # the member counts the pair here unless it visits the visitor's cell itself
            np.add.at(counts, i, copies[j])
            alone = g.excess(a[j], b[j], own[i]) > g.margin
            np.add.at(counts, j[alone], copies[i[alone]])
            root = _joined(root, i, j)
        keep = np.flatnonzero((counts > 0) | (root != np.arange(len(x))))
        return pd.DataFrame({"vid": vid[keep], "n": counts[keep], "root": vid[root[keep]]})

    found = common.stored(dealt(vectors.filter(F.size("v") == dim), grid).groupBy("cell", "part", "turn")
                          .applyInPandas(compare, "vid long, n long, root long"), "links")
    return found.groupBy("vid").agg(F.sum("n").alias("n")), found.filter("vid <> root").select(
        F.col("vid").alias("a"), F.col("root").alias("b"))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a and b (lowest place of each group)."""
    from .simhash import Groups

    groups = Groups(0)
    groups.root = root
    groups.link(a, b)
    return groups.root


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    spark = common.prepare(rows.sparkSession)
    base = common.stored(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("vec_id"),
                                     _usable(vector).alias("v"))
                         .select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("v"), "v").alias("h2")), "vectors")
    # equal vectors (128 bits) are one from here on; vid: the lowest row of each
    vectors = common.stored(base.filter("v is not null").groupBy("h1", "h2").agg(
        F.any_value("v").alias("v"), F.min("rid").alias("vid"), F.count("*").alias("copies"),
        F.min("vec_id").alias("low")), "distinct")
    counts, links = None, None
    for row in vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        dim, n = row
        some = vectors.filter(F.size("v") == dim)
        sample = np.array(some.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).toPandas()["v"].tolist(), dtype=np.float64)
        sample = unit(sample)
        grid = Grid(sample, centroids(n))
        grid.margin = max(_probed(grid, sample, threshold), _measured(some, grid, threshold))
        c, e = linked(common.spread(vectors), grid, dim, threshold)
        counts, links = (c, e) if counts is None else (counts.unionByName(c), links.unionByName(e))
    if counts is None:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    nodes = common.stored(common.components(links), "nodes")
    lows = nodes.join(vectors, nodes["node"] == vectors["vid"]).groupBy("root").agg(F.min("low").alias("root_low"))
    of = (vectors.join(nodes.join(lows, "root").select(F.col("node").alias("vid"), "root_low"), "vid", "left")
          .join(counts, "vid", "left")
          .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                  F.least(F.coalesce("root_low", "low"), "low").alias("component_id")))
    out = base.drop("v").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
