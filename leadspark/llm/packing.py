r"""Packing by lexical retrieval.

Every document becomes token ids (the given tokenizer, no special tokens, then
END) and all ids are packed into sequences of WIDTH. Documents are dealt into
shards of about SHARD_TOKENS tokens by a min-hash of their token set, so that
texts of like vocabulary, copies above all, meet; a min-hash with more tokens
than that is split over several shards. Each shard holds a BM25 inverted index
of its documents, weighted by the statistics of the whole corpus (documents,
their mean length, documents that hold each token). A seed document opens a window; the shard's best-scoring
unused neighbours of the seed follow until the window is full. The document
that crosses the end is cut, its rest opens the next window and is the seed of
it. Only a shard's last sequence is short.

Null or empty text: the END id alone, packed like any other document. Null
doc_ids and repeated rows are packed as documents of their own. Ties go by
doc_id, then by row. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 4096
END = 2
#: Tokens that a shard is meant to hold.
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75
#: Words and parts whose ids a Python worker remembers, in two generations of this size.
MEMORY = 400_000
#: Texts on which the tokenizer's normaliser changes the case and white space only.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: the tokenizer's split pattern, for plain lower-case texts (its branches start apart, letters come first).
_PARTS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff\u00df]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9\u00e0-\u00f6\u00f8-\u00ff\u00df]+")
#: Words looked up at once.
CHUNK_WORDS = 200_000
_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


class Memory(dict):
    """Ids of keys in two generations: what is asked for again moves to the young one.
    A key that is new has no ids yet and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}
        self.new: list = []

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            self.new.append(key)
            return b""
        self[key] = ids
        return ids

    def learn(self, fresh: Callable[[list], dict]) -> None:
        """Have the ids of the keys that were new."""
        if self.new:
            self.update(fresh(list(dict.fromkeys(self.new))))
            self.new = []

    def age(self) -> None:
        if len(self) > MEMORY:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids by the tokenizer, remembered by what it encodes apart. It drops white
    space and never joins what that separates, so a text's ids are those of its
    white-space-free words in turn (keys of type bytes). A plain text is cut further, into
    the parts of its lower-case form by the tokenizer's split pattern (keys of type
    str): there are far fewer of them, as neither case nor punctuation multiplies them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for parts: they are normal and cut already
        self.of_parts = Tokenizer.from_file(path)
        self.of_parts.normalizer = normalizers.Sequence([])
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.order = np.random.default_rng(11).permutation(self.size).astype(np.int32)
        self.last = np.zeros(self.size, dtype=bool)  # ids that end a word part
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        self.memory = Memory()

    @staticmethod
    def keys(text: bytes) -> list[bytes] | list[str]:
        decoded = text.decode("utf-8", "replace")
        if _PLAIN.fullmatch(decoded) and "<|" not in decoded:
            return _PARTS.findall(decoded.lower())
        return text.split()

    def _fresh(self, new: list[bytes | str]) -> dict[bytes | str, bytes]:
        """Ids of new words and parts. Parts go to the tokenizer as one text, cut
        again at the ids that end a part; words one by one."""
        parts = [k for k in new if isinstance(k, str)]
        out: dict[bytes | str, bytes] = {}
        if parts:
            ids = np.array(self.of_parts.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(parts):
                data, cuts = ids.tobytes(), (np.append(0, ends) * self.kind.itemsize).tolist()
                out = {k: data[a:b] for k, a, b in zip(parts, cuts, cuts[1:])}
        rest = [k for k in new if k not in out]
        texts = [k if isinstance(k, str) else k.decode("utf-8", "replace") for k in rest]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            out[k] = np.array(e.ids, dtype=self.kind).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text with END, little-endian."""
        end = np.array([END], dtype=self.kind).tobytes()
        of = self.memory.__getitem__
        held: list[tuple[list | None, list[bytes]]] = []
        n = 0
        for i, text in enumerate(texts, 1):
            keys, before = self.keys(text), len(self.memory.new)
            found = list(map(of, keys))
            held.append((keys if len(self.memory.new) > before else None, found))
            n += len(keys)
            if n >= CHUNK_WORDS or i == len(texts):
                self.memory.learn(self._fresh)
                for keys, found in held:
                    if keys is not None:  # some were new
                        for k, ids in enumerate(found):
                            if not ids:
                                found[k] = of(keys[k])
                    yield b"".join(found) + end
                self.memory.age()
                held, n = [], 0


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``rid, doc_id, ids, n, sig, df``: per document its ids (little-endian), their
    number and their min-hash; and per task one row with nothing but ``df``, the task's documents that
    hold each token (a 32-bit number per entry of the vocabulary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        df = np.zeros(e.size, dtype=np.int32)
        stamp = np.zeros(e.size, dtype=np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field(1).type
            ids = list(e.encode(batch.column(2).to_pylist()))
            n, sig = [], []
            for x in ids:
                v = np.frombuffer(x, dtype=e.kind)
                place = np.arange(len(v))
                stamp[v] = place  # the last place of each token
                distinct = v[stamp[v] == place]
                df[distinct] += 1
                n.append(len(v))
                sig.append(int(e.order[distinct].min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.int32()),
                 pa.nulls(len(ids), pa.binary())], names=["rid", "doc_id", "ids", "n", "sig", "df"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                 pa.array([df.tobytes()], pa.binary())], names=["rid", "doc_id", "ids", "n", "sig", "df"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", common.text_of().cast("binary").alias("text")).mapInArrow(
        run, f"rid long, doc_id {kind}, ids binary, n long, sig int, df binary")


class Statistics(NamedTuple):
    """Documents, their mean length, and per token the documents that hold it."""
    n: int
    mean: float
    df: np.ndarray


def statistics(rows: DataFrame, path: str) -> Statistics:
    """Of all documents, from the rows of :func:`encoded`; bounded by the vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(encoder(path).size, dtype=np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                df += np.frombuffer(held, dtype=np.int32)
        token = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(df[token])], names=["token", "df"])

    n, mean = rows.agg(F.count("n"), F.avg("n")).first()
    found = rows.select("df").filter("df is not null").mapInArrow(count, "token int, df long").groupBy("token").agg(
        F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(found["token"].max()) + 1 if len(found) else 0, dtype=np.int64)
    df[found["token"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return Statistics(n, mean or 0.0, df)


class Index:
    """BM25 inverted index over the token ids of a shard's documents; without
    statistics of the corpus, by those of the documents given."""

    def __init__(self, docs: list[np.ndarray], size: int, corpus: Statistics | None = None):
        n = len(docs)
        lengths = np.array([len(d) for d in docs])
        key = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(new, len(key)))
        token, self.doc = np.divmod(key[new], n)
        df = np.bincount(token, minlength=size)
        self.at = np.concatenate([[0], np.cumsum(df)])
        corpus = corpus or Statistics(n, lengths.mean(), df)
        idf = np.log1p((corpus.n - corpus.df + 0.5) / (corpus.df + 0.5))
        self.weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / corpus.mean))
        order = np.argsort(self.doc, kind="stable")
        self.terms = token[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's distinct tokens."""
        terms = self.terms[self.first[seed]:self.first[seed + 1]]
        low, size = self.at[terms], self.at[terms + 1] - self.at[terms]
        places = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.doc[places], self.weight[places], self.n)


def arranged(docs: list[np.ndarray], size: int, width: int = WIDTH,
             corpus: Statistics | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard."""
    index = Index(docs, size, corpus)
    unused = np.ones(len(docs), dtype=bool)
    following, sequence, at = 0, 0, 0
    ranking: list[int] = []
    seed = None
    while True:
        # the next document: the best unused neighbour of the window's seed
        doc = None
        while ranking:
            doc = ranking.pop()
            if unused[doc]:
                break
            doc = None
        if doc is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            doc = following
        unused[doc] = False
        start, total = 0, len(docs[doc])
        while start < total:
            length = min(total - start, width - at)
            yield doc, start, length, sequence, at
            start, at = start + length, at + length
            if at == width:
                sequence, at, seed, ranking = sequence + 1, 0, None, []
        if seed is None and at:
            seed = doc
            score = np.where(unused, index.scores(seed), 0.0)
            near = np.flatnonzero(score > 0)
            # neighbours beyond what can fit a window are not sorted
            sized = near[np.argsort(-score[near], kind="stable")]
            fit = int(np.searchsorted(np.cumsum([len(docs[d]) for d in sized[:width]]), width - at)) + 1
            ranking = sized[:fit].tolist()[::-1]


def packed(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``: one per piece; ``sequence_id`` is the shard's number times 2^32
    plus that of the sequence in it."""
    spark = common.prepare(docs.sparkSession)
    rows = common.stored(encoded(docs, path), "ids")
    corpus = spark.sparkContext.broadcast(statistics(rows, path))
    rows = rows.filter("df is null").drop("df")
    # one row per min-hash value: bounded by the vocabulary
    mass = rows.groupBy("sig").agg(F.sum("n").alias("n")).orderBy("sig").collect()
    plan, shard, held = [], -1, shard_tokens
    for sig, n in mass:
        parts = -(-n // shard_tokens)
        if parts > 1 or held + n > shard_tokens:
            shard, held = shard + 1, 0
        plan.append((sig, shard, parts))
        held += n
        if parts > 1:
            shard, held = shard + parts - 1, shard_tokens
    where = F.broadcast(spark.createDataFrame(plan, "sig int, first long, parts long"))
    dealt = rows.join(where, "sig").select(
        (F.col("first") + F.pmod(F.xxhash64("rid"), F.col("parts"))).alias("shard"), "rid", "doc_id", "ids")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("rid", "ascending")])
        e = encoder(path)
        ids = [np.frombuffer(x, dtype=e.kind) for x in group.column("ids").to_pylist()]
        pieces = list(arranged(ids, e.size, corpus=corpus.value))
        base = group.column("shard")[0].as_py() << 32
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array([p[0] for p in pieces], pa.int64())),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([p[2] for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes())
                                   for d, s, n, _, _ in pieces], pa.int64()),
            "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
            "sequence_id": pa.array([base + p[3] for p in pieces], pa.int64()),
            "offset": pa.array([p[4] for p in pieces], pa.int64())})

    return dealt.groupBy("shard").applyInArrow(pack, _PIECES)
