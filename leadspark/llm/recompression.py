r"""Substring dedup by recompression.

Words are ``[^\x20\x09-\x0D]+``. Every word covered by a window of WINDOW
consecutive words whose word sequence also starts anywhere else (another
document, or another place of the same one, overlapping or not) is removed.
Windows are judged on the input.

Rounds of recompression shorten each word sequence: a run round gives every
maximal run of equal symbols one name, a pair round gives every neighbouring
pair (left-class symbol, right-class symbol) one name. Names and classes are
64-bit hashes of what they stand for, so they are the same all over the cluster
without an exchange, and equal substrings get equal symbols but for a margin of
at most one symbol or run at each end and round. What a window's margins leave
is its interior: it depends on the window's own words alone. The first symbol
of the highest non-empty interior is the window's anchor; equal windows have
equal anchors at the same place.

Spark counts anchors over the corpus; a bitmap of fixed size (bounded by
BITMAP_BITS whatever the input; a false hit only costs a check) marks those seen
twice or more. Windows with a shared anchor are then verified: their (anchor,
window hash) pairs, 96 bits, are counted, and those found twice or more go.

Null text: no words, hash of the empty string. Documents with fewer words than
WINDOW stay whole. Repeated rows are documents like any other, so all their
windows repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 35
#: r: name runs, p: name pairs.
ROUNDS = "rpppprpppp"
#: Size limits of the bitmap of shared anchors (32 MB at most).
BITMAP_BITS = (20, 28)
#: Words handled at once in a Python worker (one longer text: alone).
CHUNK_WORDS = 300_000

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _named(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return _mix(_mix(a + _U(kind)) * _U(3) + b)


def word_hashes(words: list[bytes]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w) for w in words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of each WINDOW consecutive word hashes, by prefix sums."""
    with np.errstate(over="ignore"):
        power = np.empty(len(h) + 1, dtype=np.uint64)
        power[0] = 1
        power[1:] = _U(_BASE)
        power = np.cumprod(power, dtype=np.uint64)
        back = np.full(len(h) + 1, _U(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h) * power[:-1], dtype=np.uint64)])
        n = len(h) - WINDOW + 1
        return _mix((total[WINDOW:] - total[:n]) * back[:n])


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes of several documents, laid end to end (``first``: places
    where one starts, and the end): the start of each window, its anchor, and a
    number that tells anchors at different places apart."""
    n = len(h)
    of = np.zeros(n, dtype=np.int64)
    of[first[1:-1][first[1:-1] < n]] = 1
    fence = np.concatenate([of.astype(bool), [True]])  # a document starts at this symbol
    lengths = np.diff(first)
    starts = np.concatenate([np.arange(a, a + k - WINDOW + 1) for a, k in zip(first[:-1], lengths) if k >= WINDOW]
                            or [np.zeros(0, np.int64)])
    found = _named(h[starts], np.zeros(len(starts), np.uint64), 0)
    place = starts.copy()
    live = np.arange(len(starts))
    left, right = starts.copy(), starts + WINDOW
    symbols = h
    for level, kind in enumerate(ROUNDS, 1):
        m = len(symbols)
        if not len(live):
            break
        if kind == "r":
            begins = np.ones(m, dtype=bool)
            begins[1:] = (symbols[1:] != symbols[:-1]) | fence[1:m]
            at = np.flatnonzero(begins)
            size = np.diff(np.append(at, m))
            run = np.cumsum(begins) - 1
            end = np.append(at[1:], m)
            # the first and the last run of an interior may go on outside it
            left = end[run[left]]
            right = at[run[right - 1]]
            named = symbols[at]
            many = size > 1
            named[many] = _named(named[many], size[many].astype(np.uint64), level)
        else:
            is_right = (_mix(symbols ^ _U(level * 0x5851F42D4C957F2D & (2 ** 64 - 1))) & _U(1)).astype(bool)
            joined = np.zeros(m, dtype=bool)  # to the symbol on its left
            joined[1:] = is_right[1:] & ~is_right[:-1] & ~fence[1:m]
            # a right-class start or a left-class end may pair with what is outside
            left = left + is_right[left]
            right = right - ~is_right[right - 1]
            at = np.flatnonzero(~joined)
            named = symbols[at]
            pair = np.append(joined[1:], False)[at]
            named[pair] = _named(named[pair], symbols[at[pair] + 1], level)
            begins = ~joined
        before = np.concatenate([[0], np.cumsum(begins)])
        fence = np.append(fence[at], True)
        symbols = named
        stay = left < right
        live, left, right = live[stay], before[left[stay]], before[right[stay]]
        found[live] = _named(symbols[left], np.zeros(len(left), np.uint64), level)
        place[live] = (level << 40) + left
    return starts, found, place


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts, as words, of about CHUNK_WORDS words."""
    at, held, n = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.split())
        n += len(held[-1])
        if n >= CHUNK_WORDS or i + 1 == len(texts):
            yield at, held
            at, held, n = i + 1, [], 0


def _laid(held: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(w) for w in held])]).astype(np.int64)
    return word_hashes([x for w in held for x in w]), first


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, held in _chunks(batch.column(0).to_pylist()):
            starts, found, place = anchors(*_laid(held))
            if len(starts):
                new = np.append(True, place[1:] != place[:-1])
                names, counts = np.unique(found[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts.astype(np.int32))],
                                                 names=["a", "c"])


def _shared_bits(spark: SparkSession, shared: DataFrame) -> tuple[int, np.ndarray]:
    """Bitmap over the low bits of the shared anchors, of bounded size."""
    n = shared.count()
    bits = min(max(BITMAP_BITS[0], int(n * 16).bit_length()), BITMAP_BITS[1])
    low = F.col("a").bitwiseAND((1 << bits) - 1)
    made = (shared.select(F.shiftright(low, 15).alias("block"), low.bitwiseAND((1 << 15) - 1).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for block, data in made.toLocalIterator():
        out[block << 12:(block + 1) << 12] = np.frombuffer(data, dtype=np.uint8)
    return bits, out


_CANDIDATES = "struct<n_words:bigint,kept_sha256:string,a:array<int>,p:array<int>,w:array<bigint>>"


def _candidates(text: Column, bitmap) -> Column:
    """Per text: words, hash of all of them, and its windows to verify."""
    @F.arrow_udf(_CANDIDATES)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, seen = bitmap.value
        for column in columns:
            n, sha, offsets, a, p, w = [], [], [0], [], [], []
            for _, held in _chunks(column.to_pylist()):
                h, first = _laid(held)
                starts, found, _ = anchors(h, first)
                low = found & _U((1 << bits) - 1)
                mark = (seen[low >> _U(3)] >> (low & _U(7)).astype(np.uint8)) & 1
                picked = np.flatnonzero(mark)
                if len(starts):
                    doc = np.searchsorted(first, starts[picked], side="right") - 1
                    a.append((found[picked] >> _U(32)).astype(np.uint32))
                    w.append(window_hashes(h)[starts[picked]])
                    p.append(starts[picked] - first[doc])
                    per = np.bincount(doc, minlength=len(held))
                else:
                    per = np.zeros(len(held), dtype=np.int64)
                offsets += (offsets[-1] + np.cumsum(per)).tolist()
                n += [len(x) for x in held]
                sha += [hashlib.sha256(b" ".join(x)).hexdigest() for x in held]
            join = lambda parts, kind: np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)
            at = pa.array(offsets, pa.int32())
            yield pa.StructArray.from_arrays([
                pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                pa.ListArray.from_arrays(at, pa.array(join(a, np.int32))),
                pa.ListArray.from_arrays(at, pa.array(join(p, np.int64).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(join(w, np.int64)))],
                names=["n_words", "kept_sha256", "a", "p", "w"])

    return run(text)


def uncovered(words: list[bytes], starts: list[int]) -> list[bytes]:
    """The words that no window at ``starts`` covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(np.asarray(starts) + WINDOW, len(words)), -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


def _cut(texts: Column, starts: Column) -> Column:
    """The texts without the words that the windows at ``starts`` cover."""
    @F.arrow_udf("struct<n_removed:bigint,kept_sha256:string,text:string>")
    def run(texts: pa.Array, starts: pa.Array) -> pa.Array:
        n, sha, kept = [], [], []
        for text, p in zip(texts.to_pylist(), starts.to_pylist()):
            words = text.split()
            left = uncovered(words, p)
            joined = b" ".join(left)
            n.append(len(words) - len(left))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept.append(joined.decode("utf-8", "replace"))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
            names=["n_removed", "kept_sha256", "text"])

    return run(texts, starts)


def _marked(docs: DataFrame, carried: list[str], all_texts: bool) -> tuple[DataFrame, DataFrame]:
    """A stored table of the documents (``rid``, ``c_<column>`` of the carried
    columns, ``t``: the text of all, or of those with windows to verify), and the
    starts of the repeated windows per ``rid``: null where all of them are."""
    spark = common.prepare(docs.sparkSession)
    text = common.text_of().cast("binary")
    counts = docs.select(text.alias("t")).mapInArrow(_count_anchors, "a long, c int")
    shared = common.stored(counts.groupBy("a").agg(F.sum("c").alias("c")).filter("c > 1").select("a"), "anchors")
    bitmap = spark.sparkContext.broadcast(_shared_bits(spark, shared))
    rows = common.stored(
        docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"c_{c}") for c in carried],
                    (F.col("text").cast("binary") if all_texts else text).alias("t"), _candidates(text, bitmap).alias("m"))
        .select("rid", *[F.col(f"`c_{c}`") for c in carried], "m",
                (F.col("t") if all_texts else F.when(F.size("m.a") > 0, F.col("t"))).alias("t")), "windows")
    # documents of equal words are copies of each other: all their windows repeat.
    # Their first one stands in for them below, counted twice.
    # (Stored, so that the join with a text of very many copies can be split.)
    copied = common.stored(
        rows.filter(F.col("m.n_words") >= WINDOW).groupBy(F.col("m.kept_sha256").alias("sha"))
        .agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1").select("sha", "first"), "copied")
    copies = common.stored(rows.select("rid", F.col("m.kept_sha256").alias("sha")).join(copied, "sha").select(
        "rid", (F.col("rid") == F.col("first")).alias("lead")), "copies")

    def flat(part: DataFrame, weight: int) -> DataFrame:
        x = F.explode(F.arrays_zip("m.a", "m.p", "m.w")).alias("x")
        return part.select("rid", x, F.lit(weight).alias("n")).select("rid", "n", "x.*")

    single = flat(rows.join(copies.select("rid"), "rid", "left_anti"), 1)
    lead = flat(rows.join(copies.filter("lead").select("rid"), "rid", "left_semi"), 2)
    twice = common.stored(single.unionByName(lead).groupBy("a", "w").agg(F.sum("n").alias("n"))
                          .filter("n > 1").select("a", "w"), "twice")
    hits = common.stored(single.join(twice, ["a", "w"]).groupBy("rid").agg(F.collect_list("p").alias("starts")), "hits")
    return rows, hits.unionByName(copies.select("rid", F.lit(None).cast("array<int>").alias("starts")))


def removals(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_removed, kept_sha256``
    and ``kept_text`` (null where nothing is removed)."""
    rows, hits = _marked(docs, ["doc_id"], False)
    none, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256(b"").hexdigest())
    texts = rows.select("rid", "t").join(hits.filter("starts is not null"), "rid")
    cut = texts.select("rid", _cut(F.col("t"), F.col("starts")).alias("x")).select("rid", "x.*").unionByName(
        hits.filter("starts is null").select("rid", F.lit(None).cast("long").alias("n_removed"),
                                             empty.alias("kept_sha256"), F.lit("").alias("text")))
    whole = rows.select("rid", F.col("c_doc_id").alias("doc_id"), "m.n_words", F.col("m.kept_sha256").alias("sha"))
    gone = F.when(F.col("text").isNull(), none).otherwise(F.coalesce("n_removed", "n_words"))
    return whole.join(cut, "rid", "left").select("doc_id", "n_words", gone.alias("n_removed"),
                                                 F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
                                                 F.col("text").alias("kept_text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, the repeated words taken out of their text (kept words
    joined by one space; ``n_chars``, where there is one, follows); a document
    without repeats, and every other column, stays as it is."""
    other = [c for c in docs.columns if c != "text"]
    rows, hits = _marked(docs, other, True)
    known = docs.schema["text"].dataType
    joined = rows.join(hits.withColumn("hit", F.lit(True)), "rid", "left")
    held = [f"c_{c}" for c in other]
    cut = joined.filter("starts is not null").select(
        *held, "t", _cut(F.col("t"), F.col("starts")).getField("text").alias("new"))
    whole = joined.filter("starts is null").select(*held, "t", F.when(F.col("hit"), F.lit("")).alias("new"))
    out = cut.unionByName(whole)
    value = {c: F.col(f"c_{c}") for c in other} | {"text": F.coalesce("new", F.col("t").cast(known))}
    if "n_chars" in value:
        value["n_chars"] = F.coalesce(F.length("new").cast("long"), value["n_chars"])
    return out.select(*[value[c].alias(c) for c in docs.columns])
