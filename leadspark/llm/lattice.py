r"""LM scoring: subword lattice likelihood.

Tokens are the words ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased and
one end per text. The model is an open-vocabulary unigram model:

    P(token) = (c + (V + 1) Q(token)) / (N + V + 1)

c, N and V are the training corpus' counts (of the token, of all tokens, of the
distinct ones): every training word is counted, with no cut-off. Q spells a
word: it sums the weights of all segmentations of "_word" into the pieces of an
existing vocabulary, by forward recursion in log space. A document's marginal
probability over all segmentations is the product over its tokens, as no piece
crosses a word border. Q's piece weights start from the vocabulary's existing
scores (merge ranks, read as Zipf weights) and are updated once with the pieces'
expected counts in the training vocabulary; pieces are never added or changed.

Texts are read twice: to count words, and to score with the commonest HOT_WORDS
at hand (a bounded broadcast); the other words of each document are joined to
the stored word table.

Null text: empty, one end token. Rows whose doc_id is null are training rows.
Repeated rows count as often as they stand there. With no training row, N = V =
0 and only Q scores. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose scores are broadcast; the rest are joined.
HOT_WORDS = 150_000
#: Distinct words that a counting task holds before it passes them on.
COUNTED = 300_000
#: Chance that a spelling stops after a piece.
STOP = 0.25
#: Share of Q that spells the end of a text.
END = 0.01
#: Weight of the existing scores against the expected counts, in words.
PRIOR = 1000.0
#: Characters of words worked on at once.
CHUNK_CHARACTERS = 100_000
_MARK = "▁"


class Lattice:
    """Log weights of the pieces, and sums over segmentations. Words of one
    length are worked on together, column by column; a substring is looked up
    among the pieces by a 64-bit rolling hash."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        scores = np.full(model.get_piece_size(), -np.inf)
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
            else:
                self.ids[model.id_to_piece(i)] = i
                scores[i] = model.get_score(i)
        low = scores[scores > -1e6].min()  # the least of the merge ranks
        for i in self.byte.values():
            scores[i] = low
        self.longest = max(map(len, self.ids))
        keys = np.empty(len(self.ids), dtype=np.uint64)
        values = np.empty(len(self.ids), dtype=np.int64)
        for at, (piece, i) in enumerate(self.ids.items()):
            keys[at], values[at] = _prefixes(_codes([piece], len(piece)))[0, -1], i
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        # scores are minus the merge rank: Zipf weights
        weights = np.where(np.isfinite(scores), 1.0 / (2.7 - scores), 0.0)
        self.prior = weights / weights.sum()
        self.use(self.prior)

    def use(self, weights: np.ndarray) -> None:
        """Set the pieces' probabilities."""
        with np.errstate(divide="ignore"):
            self.log = np.log(weights * (1 - STOP))

    def _characters(self, codes: np.ndarray) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Byte pieces of the distinct characters, which character stands where,
        and the log weight of spelling each by its bytes."""
        kinds, at = np.unique(codes, return_inverse=True)
        spelt = [[self.byte[b] for b in chr(c).encode("utf-8", "replace")] for c in kinds.tolist()]
        return spelt, at.reshape(codes.shape), np.array([self.log[x].sum() for x in spelt])[at.reshape(codes.shape)]

    def _forward(self, codes: np.ndarray, by_bytes: np.ndarray):
        """Log sums over the segmentations of each prefix, and the pieces found:
        per end (start, rows, pieces)."""
        n, size = codes.shape
        prefix = _prefixes(codes)
        alpha = np.zeros((size + 1, n))
        found: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(size + 1)]
        for end in range(1, size + 1):
            total = alpha[end - 1] + by_bytes[:, end - 1]
            for start in range(max(0, end - self.longest), end):
                h = prefix[:, end] - prefix[:, start] * _POWERS[end - start]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                rows = np.flatnonzero(self.keys[at] == h)
                if len(rows):
                    piece = self.values[at[rows]]
                    found[end].append((start, rows, piece))
                    total[rows] = np.logaddexp(total[rows], alpha[start][rows] + self.log[piece])
            alpha[end] = total
        return alpha, found

    def spelled(self, words: list[str]) -> np.ndarray:
        """log Q of each word over all segmentations, the stop included."""
        out = np.empty(len(words))
        for places, codes in _by_length(words):
            _, _, by_bytes = self._characters(codes)
            out[places] = self._forward(codes, by_bytes)[0][-1] + _LOG_STOP
        return out

    def expect(self, words: list[str], into: np.ndarray) -> None:
        """Add the expected uses of each piece in the words."""
        for _, codes in _by_length(words):
            spelt, at, by_bytes = self._characters(codes)
            alpha, found = self._forward(codes, by_bytes)
            n, size = codes.shape
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0.0
            uses = np.zeros(len(spelt))
            for end in range(size, 0, -1):
                t = by_bytes[:, end - 1] + beta[end]
                uses += np.bincount(at[:, end - 1], np.exp(alpha[end - 1] + t - alpha[size]), len(spelt))
                beta[end - 1] = np.logaddexp(beta[end - 1], t)
                for start, rows, piece in found[end]:
                    t = self.log[piece] + beta[end][rows]
                    into += np.bincount(piece, np.exp(alpha[start][rows] + t - alpha[size][rows]), len(into))
                    beta[start][rows] = np.logaddexp(beta[start][rows], t)
            for pieces, k in zip(spelt, uses.tolist()):
                for i in pieces:
                    into[i] += k


_STEP = 0x9E3779B97F4A7C15
#: Powers of the rolling hash's base, for substrings of up to 64 characters.
_POWERS = np.array([pow(_STEP, k, 1 << 64) for k in range(65)], dtype=np.uint64)


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Rolling hashes of each row's prefixes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _POWERS[1] + codes[:, k] + np.uint64(1)
    return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: their places, and the code points of the
    marked words. A block holds a bounded number of characters (or one word)."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 1
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        size = int(sizes[order[at]])
        end = min(int(np.searchsorted(sizes[order], size, side="right")), at + max(1, CHUNK_CHARACTERS // size))
        places = order[at:end]
        yield places, _codes([_MARK + words[i] for i in places.tolist()], size)
        at = end


_LOG_STOP = math.log(STOP / (1 - STOP))


@lru_cache(maxsize=1)
def _lattice(path: str) -> Lattice:
    return Lattice(path)


def _texts(words: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's texts: of the training texts, and presence."""
    def sent(learnt: Counter, seen: set[bytes]) -> pa.RecordBatch:
        words = list(learnt) + [w for w in seen if w not in learnt]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learnt.get(w, 0) for w in words], pa.int64())],
                                          names=["w", "c"])

    learnt: Counter = Counter()
    seen: set[bytes] = set()
    for batch in batches:
        for text, held in zip(batch.column(0), batch.column(1).to_pylist()):
            words = text.as_py().lower().split()
            if held:
                seen.update(words)
            else:
                learnt.update(words)
            if len(learnt) + len(seen) > COUNTED:
                yield sent(learnt, seen)
                learnt, seen = Counter(), set()
    yield sent(learnt, seen)


def word_table(docs: DataFrame, held: Column) -> DataFrame:
    """Every distinct word ``w`` (bytes) with its training count ``c``."""
    text = common.text_of().cast("binary")
    return (docs.select(text.alias("t"), held.alias("held")).mapInArrow(_counted, "w binary, c long")
            .groupBy("w").agg(F.sum("c").alias("c")))


def fitted(words: DataFrame, path: str) -> np.ndarray:
    """The pieces' weights, updated with their expected counts over the training
    vocabulary (summed by Spark; one number per piece comes back)."""
    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        lattice.use(lattice.prior)
        total = np.zeros(len(lattice.prior))
        for batch in batches:
            lattice.expect(_texts(batch.column(0)), total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["i", "n"])

    rows = (words.filter("c > 0").select("w").mapInArrow(expected, "i int, n double")
            .groupBy("i").agg(F.sum("n").alias("n")).collect())
    lattice = _lattice(path)
    weights = PRIOR * lattice.prior
    for i, n in rows:
        weights[i] += n
    return weights / weights.sum()


def scored_words(words: DataFrame, path: str, weights, n: int, v: int) -> DataFrame:
    """Words with log10 of the base and the model probability."""
    sent = words.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        lattice.use(sent.value)
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            spelt = np.log((1 - END) * (v + 1)) + lattice.spelled(_texts(batch.column(0)))
            with np.errstate(divide="ignore"):
                model = np.logaddexp(np.log(c), spelt) - math.log(n + v + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.log10((c + 1) / (n + v + 1))), pa.array(model / math.log(10))],
                names=["w", "c", "base", "model"])

    return words.mapInArrow(score, "w binary, c long, base double, model double")


def scored(docs: DataFrame, path: str, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per document row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``."""
    spark = common.prepare(docs.sparkSession)
    held = F.coalesce(common.fold("doc_id", folds) == held_fold, F.lit(False))
    counts = common.stored(word_table(docs, held), "counts")
    ends = docs.filter(~held).count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n, v = total[0] + ends, total[1] + (ends > 0)
    words = common.stored(scored_words(common.spread(counts), path, fitted(common.spread(counts), path), n, v), "words")
    end_base = math.log10((ends + 1) / (n + v + 1))
    end_model = math.log10((ends + END * (v + 1)) / (n + v + 1))
    # the commonest words: whole classes of counts (eighths of a power of two, so
    # a bounded number of them) from the top, as long as they fit
    kind = F.when(F.col("c") > 0, F.floor(F.log2("c") * 8)).otherwise(-1)
    least, held_words = math.inf, 0
    for row in words.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("kind")).collect():
        held_words += row["n"]
        if held_words > HOT_WORDS:
            break
        least = row["kind"]
    common_words = words.filter(kind >= F.lit(float(least))).toPandas()
    hot = spark.sparkContext.broadcast({w: (b, m, int(c > 0)) for w, c, b, m in zip(
        map(bytes, common_words["w"]), common_words["c"], common_words["base"], common_words["model"])})

    @F.arrow_udf("struct<n:bigint,known:bigint,base:double,model:double,w:array<binary>,k:array<int>>")
    def look_up(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = hot.value.get
        for column in columns:
            rows, rare_words, rare_counts, offsets = [], [], [], [0]
            for text in column:
                found = Counter(text.as_py().lower().split())
                size, known, base, model = 1, int(ends > 0), end_base, end_model
                for word, k in found.items():
                    size += k
                    hit = get(word)
                    if hit is None:
                        rare_words.append(word)
                        rare_counts.append(k)
                    else:
                        base += k * hit[0]
                        model += k * hit[1]
                        known += k * hit[2]
                rows.append((size, known, base, model))
                offsets.append(len(rare_words))
            at = pa.array(offsets, pa.int32())
            n_, known_, base_, model_ = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([
                pa.array(n_, pa.int64()), pa.array(known_, pa.int64()), pa.array(base_, pa.float64()),
                pa.array(model_, pa.float64()), pa.ListArray.from_arrays(at, pa.array(rare_words, pa.binary())),
                pa.ListArray.from_arrays(at, pa.array(rare_counts, pa.int32()))],
                names=["n", "known", "base", "model", "w", "k"])

    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held.alias("held_out"),
                                     look_up(common.text_of().cast("binary")).alias("x")).select(
        "rid", "doc_id", "held_out", "x.*"), "hot")
    flat = rows.select("rid", F.explode(F.arrays_zip("w", "k")).alias("x")).select("rid", "x.w", "x.k")
    rare = flat.join(words, "w").groupBy("rid").agg(
        F.sum(F.col("k") * F.col("base")).alias("rare_base"), F.sum(F.col("k") * F.col("model")).alias("rare_model"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    none = F.lit(0)
    return rows.drop("w", "k").join(rare, "rid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", none)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", none.cast("double"))).alias("base_score"),
        (F.col("model") + F.coalesce("rare_model", none.cast("double"))).alias("score"))
