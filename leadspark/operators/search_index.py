"""A stored inverted index of a corpus and exact top-k search with upper bounds.

**The table.** Documents are cut into blocks of ``BLOCK`` in the order of falling length, so the documents
of a block are alike. Stored per segment:

* ``postings``: one row per block and term with the documents in order of falling frequency, the
  largest one (``max_tf``) and their number; a file holds whole blocks, sorted by block and term;
* ``terms``: document frequencies, bucketed by term (a bucket without a query term is not read);
* ``documents``: the ids and their blocks, and ``manifest``: one row per finished segment.

:func:`extend` adds a segment with the documents whose ids are new; nothing stored is read but ids.
A text is shuffled once, by its block, and tokenised there; its terms are counted and
a block's postings gathered from Arrow batches, without a further exchange. The manifest row is written last: a segment of a run
that died is never seen, and its folder is written anew. A document is known by its id: a
changed text needs a new one.

**The search.** ``score(q, d) = sum over distinct terms t of q in d: tf(t, d) * ln(1 + N / df(t))``.
The sum of ``max_tf * ln(...)`` over a query's terms bounds the score of every document of a
block (the frequency lists are not read for it). The best ``FIRST_BLOCKS`` blocks of each query are scored first;
their k-th best score is the query's threshold. Blocks whose bound stays below it are
skipped, what is left is scored. So the result is the exact top k, ties by lower
doc_id, and only a small part of all pairs is ever scored.

Joins are broadcast where the query terms are proven few; beyond that they are on
(block, term), or salted, never on a bare term.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import path_exists
from .sizing import is_small

BLOCK = 32
BUCKETS = 16
#: Blocks per query that are scored first, to find its threshold.
FIRST_BLOCKS = 2
# Rows of one broadcast: ids, (query, block), or (query, block, term) with its weight.
MAX_BROADCAST_ROWS = 2_000_000
SALTS = 16
#: Summed in another order, equal scores differ by less than this share.
SLACK = 1e-9


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: One stored row: ``n`` documents of a block have the term.
POSTINGS = "block bigint, term string, max_tf bigint, n bigint, docs array<struct<tf:bigint,doc_id:bigint>>"


@dataclass
class Index:
    spark: SparkSession
    path: str
    n_docs: int
    #: Finished segments (one per extension).
    segments: list[int]

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("segment").isin(self.segments))

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "segment int, block bigint, term string, max_tf bigint, docs array<struct<tf:bigint,doc_id:bigint>>")

    @property
    def terms(self) -> DataFrame:
        return self._read("terms", "segment int, bucket int, term string, df bigint")


def scratch_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/search-index-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, corpus: str) -> str:
    """The place of a corpus' index that all queries of this application share."""
    name = hashlib.md5(corpus.encode()).hexdigest()
    return f"{checkpoint_dir(spark).rstrip('/')}/search-index-{spark.sparkContext.applicationId}-{name}"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment int, n_docs bigint").parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Index:
    """The index at ``path``: what its manifest says is finished."""
    if not path_exists(spark, f"{path}/manifest"):
        return Index(spark, path, 0, [])
    done = _manifest(spark, path).collect()
    return Index(spark, path, sum(r.n_docs for r in done), sorted(r.segment for r in done))


def _gather():
    """The function that counts the terms of documents ``(block, doc_id, terms)``, sorted by block, and gathers the
    postings of each block. It holds one Arrow batch, and of a block that goes on its counts. (Made here
    so that workers get it whole and need not have this package.)"""
    def gather(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def counted(block, doc_id, row, term, tf):
            """``tf`` of each ``term`` of document row ``row`` added up by block, term and document, in the order of the
            postings, with their lists' starts."""
            terms = term.dictionary_encode().combine_chunks()
            words, code = terms.dictionary, terms.indices.to_numpy()
            order = pc.sort_indices(words).to_numpy()
            rank = np.empty(len(words), "int64")
            rank[order] = np.arange(len(words))
            blocks, at = np.unique(block, return_inverse=True)
            docs, doc = np.unique(doc_id, return_inverse=True)
            # three numbers below the terms of a batch: their product is far below 2^63
            key = ((at * len(words))[row] + rank[code]) * len(docs) + doc[row]
            by = np.argsort(key)
            key = key[by]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            tf = np.add.reduceat(tf[by], first)[::-1]
            place, doc = np.divmod(key[first][::-1], len(docs))
            by = np.lexsort((-tf, place))  # stable: the later document first
            place, doc, tf = place[by], doc[by], tf[by]
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            at, term = np.divmod(place[starts], len(words))
            return blocks[at], words.take(pa.array(order[term])), starts, docs[doc], tf

        def postings(block, term, starts, doc_id, tf):
            ends = np.r_[starts, len(tf)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(tf, pa.int64()), pa.array(doc_id, pa.int64())], ["tf", "doc_id"]))
            table = pa.table([pa.array(block), term, pa.array(tf[starts], pa.int64()), pa.array(np.diff(ends), pa.int64()), lists],
                             ["block", "term", "max_tf", "n", "docs"])
            yield from table.to_batches(max_chunksize=1 << 16)

        # counts of the last block, which may go on in the next batch: its number, documents, terms, frequencies
        held = np.empty(0, "int64"), np.empty(0, "int64"), pa.array([], pa.string()), np.empty(0, "int64")
        for batch in batches:
            lists, n = batch.column("terms"), len(held[0])
            row, term = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            if not n + len(term):
                continue
            block, term, starts, doc_id, tf = counted(
                np.r_[held[0], batch.column("block").to_numpy()], np.r_[held[1], batch.column("doc_id").to_numpy()],
                np.r_[np.arange(n), n + row], pa.chunked_array([held[2], term]), np.r_[held[3], np.ones(len(term), "int64")])
            done = int(np.searchsorted(block, block[-1]))
            stop = int(starts[done])
            if done:
                yield from postings(block[:done], term[:done], starts[:done], doc_id[:stop], tf[:stop])
            sizes = np.diff(np.r_[starts[done:], len(tf)])
            held = (np.repeat(block[done:], sizes), doc_id[stop:],
                    term[done:].take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), tf[stop:])
        if len(held[0]):
            yield from postings(*counted(held[0], held[1], np.arange(len(held[0])), pa.chunked_array([held[2]]), held[3]))

    return gather


def extend(docs: DataFrame, path: str) -> Index:
    """Index the documents ``(doc_id, text)`` whose ids the index at ``path`` does not
    hold yet; rows of one id are one document."""
    from .enrich import tokens
    spark = docs.sparkSession
    new, segment = docs.select("doc_id", "text"), 0
    index = load(spark, path)
    if index.segments:
        held = index._read("documents", "segment int, doc_id bigint").select("doc_id")
        # ids alone decide whether there is anything to do
        if docs.select("doc_id").join(held, "doc_id", "left_anti").isEmpty():
            return index
        new, segment = new.join(held, "doc_id", "left_anti"), index.segments[-1] + 1
    at = f"segment={segment}"
    # blocks: numbers in the order of the range exchange, each of its tasks with numbers of its own
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("size").desc(), F.col("doc_id").asc()]
    sizes = new.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"), F.count("*").alias("n_rows"))
    sizes.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "n_rows", F.floor(F.monotonically_increasing_id() / BLOCK).alias("block")).write.mode("overwrite").parquet(
        f"{path}/documents/{at}")
    ids = spark.read.schema("doc_id bigint, n_rows bigint, block bigint").parquet(f"{path}/documents/{at}")
    n_ids, n_docs = ids.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).head()
    blocks = ids.select("doc_id", "block")
    placed = new.join(F.broadcast(blocks) if n_ids <= MAX_BROADCAST_ROWS else blocks, "doc_id").repartition(parts, "block")
    rows = placed.sortWithinPartitions("block").select("block", "doc_id", tokens("text").alias("terms")).mapInArrow(_gather(), POSTINGS)
    rows.write.mode("overwrite").parquet(f"{path}/postings/{at}")
    rows = spark.read.schema("term string, n bigint").parquet(f"{path}/postings/{at}")
    rows.groupBy("term").agg(F.sum("n").alias("df")).withColumn("bucket", _bucket("term")).repartition("bucket") \
        .sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/{at}")
    spark.range(1).select(F.lit(segment).alias("segment"), F.lit(n_docs).cast("long").alias("n_docs")).coalesce(1).write.mode(
        "append").parquet(f"{path}/manifest")
    return load(spark, path)


def _weights(index: Index, qt: DataFrame, id_col: str, few: bool) -> DataFrame:
    """``(id, term, w)`` for the query terms that the corpus has."""
    terms = qt.select("term").distinct().withColumn("bucket", _bucket("term"))
    df = (index.terms.join(F.broadcast(terms) if few else terms, ["bucket", "term"], "left_semi")
          .groupBy("term").agg(F.sum("df").alias("df")))
    df = df.select("term", F.log(F.lit(1.0) + F.lit(float(index.n_docs)) / F.col("df")).alias("w"))
    if few:
        return qt.join(F.broadcast(df), "term").select(id_col, "term", "w")
    # a term may stand in a large share of the queries: they are dealt over salts
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    return qt.withColumn("salt", salt).join(_salts(df), ["term", "salt"]).select(id_col, "term", "w")


def _salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _top(df: DataFrame, id_col: str, order: list[Column], k: int) -> DataFrame:
    """The ``k`` first rows per query, ranked: each task sends at most ``k``
    rows of a query (a group limit is planned before the exchange)."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return df.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def scored(index: Index, qt: DataFrame, k: int, id_col: str) -> DataFrame:
    """``(id, doc_id, raw_score)`` of every pair that is scored: all pairs of the
    blocks that may hold a hit of the query, among them its exact top ``k``.
    ``qt``: distinct ``(id, term)``, materialised."""
    few = is_small(qt, MAX_BROADCAST_ROWS // FIRST_BLOCKS)
    qw = _weights(index, qt, id_col, few).checkpoint(eager=True)
    small = F.broadcast if few else (lambda df: df)

    at_block = index.postings.select("segment", "block", "term", "max_tf")
    if few:
        at_block = at_block.join(F.broadcast(qw), "term")
    else:
        at_block = at_block.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(_salts(qw), ["term", "salt"])
    bounds = at_block.groupBy(id_col, "segment", "block").agg(
        F.sum(F.col("max_tf") * F.col("w")).alias("bound")).checkpoint(eager=True)

    def exact(found: DataFrame, bounded: bool) -> DataFrame:
        """Scores of all documents of the blocks ``found`` (``bounded``: at most FIRST_BLOCKS per query)."""
        found = found.select(id_col, "segment", "block")
        wanted = found.join(small(qw), id_col)
        if (few and bounded) or is_small(wanted, MAX_BROADCAST_ROWS):
            rows = index.postings.join(F.broadcast(wanted), ["segment", "block", "term"])
        elif few and is_small(found, MAX_BROADCAST_ROWS):
            # the postings stay where they are: joined to the terms of all queries, then cut to the blocks of each
            rows = index.postings.join(F.broadcast(qw), "term").join(F.broadcast(found), [id_col, "segment", "block"], "left_semi")
        else:
            rows = index.postings.join(wanted, ["segment", "block", "term"])
        return rows.select(id_col, "w", F.explode("docs").alias("d")).groupBy(id_col, F.col("d.doc_id").alias("doc_id")).agg(
            F.sum(F.col("d.tf") * F.col("w")).alias("raw_score"))

    best = [F.col("bound").desc(), F.col("segment").asc(), F.col("block").asc()]
    first = _top(bounds, id_col, best, FIRST_BLOCKS).select(id_col, "segment", "block").checkpoint(eager=True)
    begun = exact(first, True).checkpoint(eager=True)
    kth = _top(begun, id_col, [F.col("raw_score").desc(), F.col("doc_id").asc()], k).filter(F.col("rank") == k)
    # queries with fewer than k documents so far have no threshold
    least = kth.select(id_col, (F.col("raw_score") * (1 - SLACK) - 1e-8).alias("least"))
    left = (bounds.join(small(least), id_col, "left").filter("least is null or bound >= least")
            .join(small(first), [id_col, "segment", "block"], "left_anti")).checkpoint(eager=True)
    return begun.unionByName(exact(left, False))


def search(index: Index, queries: DataFrame, k: int, id_col: str = "q_id", text_col: str = "query") -> DataFrame:
    """``(id, rank, doc_id, score)``: the top ``k`` documents per query."""
    from .enrich import token_set
    qt = queries.select(id_col, F.explode(token_set(text_col)).alias("term")).checkpoint(eager=True)
    scores = scored(index, qt, k, id_col).withColumn("score", F.round("raw_score", 9))
    top = _top(scores, id_col, [F.col("score").desc(), F.col("doc_id").asc()], k)
    return top.select(id_col, "rank", "doc_id", F.round("raw_score", 6).alias("score"))
