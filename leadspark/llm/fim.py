r"""Fill-in-middle transformation with cuts at unit boundaries.

The characters of a text fall into eight classes (line end, other white space,
sentence mark, other ASCII, first byte of a longer character, its further
bytes). A wavelet matrix over the classes of all texts of a block of rows
answers "how many of class c before place i" (rank) from three bit vectors.

* A unit ends behind a character of the unit's end classes (``line``: line
  ends; ``word``: white space; ``sentence``: line ends and sentence marks), or at the
  end of the text: ``[^E]*[E]|[^E]+``. The number of boundaries before a place
  is the sum of the ranks of the end classes.
* A cut after k units is the k-th occurrence (select) of the one end class, or
  found by bisection on the summed ranks where there are several.
* Code points of a part are its bytes less its further bytes, by rank again.

Everything runs on the UTF-8 bytes as they arrive, for all rows of a block at
once; only the places of the cuts come back, and the output is put together and
taken apart by DataFrame functions.

Prefix and middle end after the smaller and the larger of ``h1 % (n + 1)`` and
``h2 % (n + 1)`` units; h1 to h4 are the first four 8-digit groups of the sha256 of
``seed:doc_id``. A text that is empty, holds a marker, or fails the rate stays
plain; otherwise it is suffix-first (``spm``) or prefix-first (``psm``).

Null text: empty. Null doc_id: the hash of ``seed:``. Rows are independent, so
ties and repeated rows are transformed alike, each with a result row of its own.
A very long text forms a block of its own (about twice its bytes of memory).
Further columns of the input are left out, so their names can't clash. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE, SPACE, MARK, OTHER, FIRST, FURTHER = range(6)
#: Classes whose characters end a unit.
UNITS = {"line": (LINE,), "word": (LINE, SPACE), "sentence": (LINE, MARK)}
LEVELS = 3
#: Bytes of one wavelet matrix, unless a single text is longer.
BLOCK_BYTES = 1 << 22


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0], table[0xC0:] = FURTHER, FIRST
    table[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    table[[ord(c) for c in ".!?"]] = MARK
    table[ord("\n")] = LINE
    return table


CLASS_OF = _class_table()


class Bits:
    """A bit vector with rank and select; all arguments are arrays."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        padded[:len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])
        self.zeros = self.n - self.ones

    def rank1(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def rank0(self, i: np.ndarray) -> np.ndarray:
        return i - self.rank1(i)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) bit of the value, by bisection on ranks."""
        low, high = np.zeros_like(k), np.full_like(k, self.n)
        rank = self.rank1 if bit else self.rank0
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = rank(np.minimum(middle + 1, self.n)) > k
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


class WaveletMatrix:
    """Rank and select of small symbols, over ``LEVELS`` bit vectors."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels: list[Bits] = []
        for shift in range(LEVELS - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(bit))
            if shift:
                symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _down(self, symbol: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the symbol's range and the place of i, below the last level."""
        start = np.zeros_like(i)
        for level, bits in enumerate(self.levels):
            if symbol >> (LEVELS - 1 - level) & 1:
                start, i = bits.zeros + bits.rank1(start), bits.zeros + bits.rank1(i)
            else:
                start, i = bits.rank0(start), bits.rank0(i)
        return start, i

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before place i."""
        start, i = self._down(symbol, i)
        return i - start

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of the symbol's k-th occurrence (from 0)."""
        start, _ = self._down(symbol, np.zeros_like(k))
        place = start + k
        for level in range(LEVELS - 1, -1, -1):
            bits, one = self.levels[level], symbol >> (LEVELS - 1 - level) & 1
            place = bits.select(place - bits.zeros, 1) if one else bits.select(place, 0)
        return place


class Boundaries:
    """Unit ends of the texts that lie in ``data`` from ``start`` to ``end``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, unit: str):
        self.matrix, self.classes = WaveletMatrix(CLASS_OF[data]), UNITS[unit]
        self.start, self.end = start, end
        self.base = self.ends_before(start)
        self.whole = self.ends_before(end) - self.base
        # an unfinished unit at the end of the text counts as well
        last = data[np.maximum(end, 1) - 1] if len(data) else np.zeros(len(end), np.uint8)
        self.units = self.whole + ((end > start) & ~np.isin(CLASS_OF[last], self.classes))

    def ends_before(self, i: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, i) for c in self.classes)

    def chars(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        further = self.matrix.rank(FURTHER, high) - self.matrix.rank(FURTHER, low)
        return high - low - further

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Place behind the first k units of each text."""
        inside = (k > 0) & (k <= self.whole)
        at = np.where(k > 0, self.end, self.start)
        wanted = (self.base + k)[inside]
        if not len(wanted):
            return at
        if len(self.classes) == 1:
            at[inside] = self.matrix.select(self.classes[0], wanted - 1) + 1
            return at
        low, high = self.start[inside].copy(), self.end[inside].copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.ends_before(middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        at[inside] = low
        return at


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BLOCK_BYTES."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def cut_places(column: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its units, and the code points of prefix and middle."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    n, prefix, middle = (np.zeros(len(column), np.int64) for _ in range(3))
    for first, last in _blocks(offsets):
        rows, origin = slice(first, last), offsets[first]
        held = Boundaries(data[origin:offsets[last]], offsets[first:last] - origin, offsets[first + 1:last + 1] - origin, unit)
        n[rows] = held.units
        a, b = h1[rows] % (held.units + 1), h2[rows] % (held.units + 1)
        one, two = held.cut(np.minimum(a, b)), held.cut(np.maximum(a, b))
        prefix[rows], middle[rows] = held.chars(held.start, one), held.chars(one, two)
    return n, prefix, middle


def cuts(text: Column, h1: Column, h2: Column, unit: str = "line") -> Column:
    """Struct ``n, prefix_chars, middle_chars`` of a text and two hashes."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    @F.arrow_udf("struct<n:bigint,prefix_chars:bigint,middle_chars:bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, one, two in batches:
            found = cut_places(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False), unit)
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "prefix_chars", "middle_chars"])

    return run(text, h1, h2)


def _group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Rows ``doc_id, n, form, prefix_chars, middle_chars, output``, one per
    document row; ``rate`` and ``spm`` are per cent."""
    common.prepare(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = docs.select("doc_id", common.text_of().alias("t"), digest.alias("d")).select(
        "doc_id", "t", *[_group("d", i).alias(f"h{i + 1}") for i in range(4)])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("t", F.lit(marker))
    plain = (F.length("t") == 0) | marked | (F.col("h3") % 100 >= rate)
    h = h.select("doc_id", "t", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm").alias("form"),
                 cuts(F.col("t"), F.col("h1"), F.col("h2"), unit).alias("x")).select("doc_id", "t", "form", "x.*")
    t, a, m = F.col("t"), F.col("prefix_chars"), F.col("middle_chars")
    # as lengths fit an int, so do the places
    part = lambda start, size: F.substring(t, (start + 1).cast("int"), size.cast("int"))
    before, middle, after = part(F.lit(0), a), part(a, m), part(a + m, F.length(t))
    mark = F.lit
    output = (F.when(F.col("form") == "psm", F.concat(mark(PREFIX), before, mark(SUFFIX), after, mark(MIDDLE), middle))
              .when(F.col("form") == "spm", F.concat(mark(SUFFIX), after, mark(PREFIX), before, mark(MIDDLE), middle))
              .otherwise(t))
    given = F.col("form") != "plain"
    return h.select("doc_id", "n", "form", F.when(given, a).alias("prefix_chars"), F.when(given, m).alias("middle_chars"),
                    output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: the markers stand
    nowhere else in it, so it is cut at them."""
    held = F.split(output, "<[PSM]>", -1)
    piece = lambda i: F.try_element_at(held, F.lit(i))
    return (F.when(form == "psm", F.concat(piece(2), piece(4), piece(3)))
            .when(form == "spm", F.concat(piece(3), piece(4), piece(2)))
            .otherwise(output))


def digests(docs: DataFrame) -> DataFrame:
    """The transformed documents, output and restored text as SHA-256."""
    made = transformed(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
