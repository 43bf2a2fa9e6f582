r"""SimHash near-duplicates over vantage-point trees.

Fingerprint: the text's words (A-Z lower-cased, ``[^\x20\x09-\x0D]+``) give
3-word shingles, repeats included; a bit is set when over half of the shingles'
XXH64 values (seed 42) have it. Fewer words than three are one shingle; no
word at all gives zero, linked like any other.

Pairs within MAX_BITS: a vantage-point tree, built from a bounded sample of the
distinct fingerprints, deals all of them into shards by their Hamming distance
to the tree's vantage points. A fingerprint lives in one shard and visits every
other whose ball its own search ball may reach (triangle inequality), so no
pair is lost. Within a shard a further vantage point sorts members into rings,
and only rings within MAX_BITS are compared. A shard returns a spanning star
per group of linked fingerprints, never all its pairs.

Only distinct fingerprints are searched, so copies cost nothing. Null text is
an empty text. A null doc_id is linked but never the smallest id (a component
of null ids only has a null component_id). Repeated rows get equal results.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
MAX_BITS = 2
#: Distinct fingerprints that the tree is built from, at most.
SAMPLE = 16384
#: Distinct fingerprints that a shard is meant to hold.
SHARD = 8192


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(g, 42) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each whole text, as a signed long."""
    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in t], dtype=np.uint64).view(np.int64))

    return run(text.cast("binary"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Inner nodes (vantage point, radius); children below zero are shards."""

    def __init__(self, sample: np.ndarray, in_shard: int):
        self.points: list[np.uint64] = []
        self.radius: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.shards = 0
        self.rng = np.random.default_rng(5)
        self.root = self._grow(np.unique(sample), max(2, in_shard))

    def _leaf(self) -> int:
        self.shards += 1
        return -self.shards

    def _grow(self, points: np.ndarray, in_shard: int) -> int:
        if len(points) <= in_shard:
            return self._leaf()
        # the widest spread of distances loses the fewest visits at the border
        tried = [points[i] for i in self.rng.choice(len(points), min(16, len(points)), replace=False)]
        apart = [distance(points, p) for p in tried]
        best = int(np.argmax([d.std() for d in apart]))
        d, cut = apart[best], int(np.median(apart[best]))
        if cut == int(d.max()):
            cut -= 1
        if not 0 < (d <= cut).sum() < len(d):
            return self._leaf()
        node = len(self.points)
        self.points.append(tried[best])
        self.radius.append(cut)
        self.inner.append(0)
        self.outer.append(0)
        self.inner[node] = self._grow(points[d <= cut], in_shard)
        self.outer[node] = self._grow(points[d > cut], in_shard)
        return node

    def route(self, prints: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per shard: the places of the fingerprints that live in it or visit
        it, and whether they live there."""
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), dtype=bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at, home
                continue
            d = distance(prints[at], self.points[node]).astype(np.int16)
            cut = self.radius[node]
            inside = d <= cut
            go = d - reach <= cut
            todo.append((self.inner[node], at[go], home[go] & inside[go]))
            go = d + reach > cut
            todo.append((self.outer[node], at[go], home[go] & ~inside[go]))


class Groups:
    """Union of linked places, lowest place first."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 1 << 15):  # most of a dense group's pairs are linked after the first few
            x, y = a[at:at + (1 << 15)], b[at:at + (1 << 15)]
            new = self.root[x] != self.root[y]
            for i, j in zip(x[new].tolist(), y[new].tolist()):
                i, j = self._find(i), self._find(j)
                if i != j:
                    self.root[max(i, j)] = min(i, j)
            if new.any():
                self.settle()

    def settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up


def linked(prints: np.ndarray, home: np.ndarray, reach: int) -> np.ndarray:
    """For each of a shard's fingerprints the place of its group's first one;
    pairs of two visitors are left to the shards in which they live."""
    groups = Groups(len(prints))
    members = np.flatnonzero(home)
    if not len(members):
        return groups.root
    d = distance(prints, prints[members[0]]).astype(np.int16)
    block = 1 << 21
    for ring in range(65):
        near = members[d[members] == ring]
        others = np.flatnonzero(np.abs(d - ring) <= reach)
        if not len(near) or len(others) < 2:
            continue
        step = max(1, block // len(others))
        for at in range(0, len(near), step):
            part = near[at:at + step]
            x, y = np.nonzero(distance(prints[part][:, None], prints[others][None, :]) <= reach)
            a, b = part[x], others[y]
            groups.link(a[a != b], b[a != b])
    return groups.root


def edges(distinct: DataFrame, reach: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct
    fingerprints (column ``fp``) at ``reach`` or fewer differing bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    tree = spark.sparkContext.broadcast(Tree(sample.view(np.uint64), int(shard * len(sample) / max(1, n))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for leaf, at, home in tree.value.route(prints.view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf, dtype=np.int32)), pa.array(prints[at]), pa.array(home)],
                    names=["leaf", "fp", "home"])

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp")
        prints = rows["fp"].to_numpy(np.int64)
        root = linked(prints.view(np.uint64), rows["home"].to_numpy(bool), reach)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": prints[moved], "b": prints[root[moved]]})

    dealt = distinct.select("fp").mapInArrow(route, "leaf int, fp long, home boolean")
    return dealt.groupBy("leaf").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = MAX_BITS) -> DataFrame:
    """One row per document row: ``doc_id, h`` (hash of the text), ``fp`` (the
    fingerprint as a signed long), ``root`` (the component's smallest fingerprint)
    and ``component_id``."""
    common.prepare(docs.sparkSession)
    text = common.text_of()
    rows = common.stored(docs.select("doc_id", F.xxhash64(text).alias("h"), fingerprints(text, shingle).alias("fp")),
                         "prints")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    nodes = common.stored(common.components(edges(distinct, reach)), "nodes")
    lows = (nodes.join(distinct, nodes["node"] == distinct["fp"]).groupBy("root")
            .agg(F.min("low").alias("root_low")))
    # stored: the join below then stands alone, and adaptive execution can split a
    # fingerprint that many copies share
    of = common.stored(distinct.join(nodes.join(lows, "root").select(F.col("node").alias("fp"), "root", "root_low"), "fp", "left")
                       .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("root_low", "low").alias("component_id")), "of")
    return rows.join(of, "fp").select("doc_id", "h", "fp", "root", "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the row of the smallest doc_id
    (of equal or only null ids the lowest text hash, of repeated rows one).
    Columns unchanged."""
    found = common.stored(near_duplicates(docs), "found")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    # stored: the join below then stands alone, and adaptive execution can split a large component
    best = common.stored(found.groupBy("root").agg(F.min(key).alias("best")), "best")
    dropped = common.stored(found.join(best, "root").filter(~key.eqNullSafe(F.col("best"))).select("doc_id", "h").distinct(), "dropped")
    many = common.stored(found.groupBy("doc_id", "h").count().filter("count > 1").select("doc_id", "h"), "many")

    def same(rows: DataFrame, keys: DataFrame) -> Column:
        """Bound to the two tables, so that no column of the documents can clash."""
        return rows["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(common.text_of(rows["text"])) == keys["h"])

    kept = docs.join(dropped, same(docs, dropped), "left_anti")
    if many.isEmpty():
        return kept
    return kept.join(many, same(kept, many), "left_anti").unionByName(
        kept.join(many, same(kept, many), "left_semi").dropDuplicates(["doc_id", "text"]))
