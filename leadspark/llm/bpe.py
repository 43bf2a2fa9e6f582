r"""Byte-level BPE encoding and decoding in linear time.

A piece of text (one match of the split pattern) is read as bytes, mapped to
Latin-1 so that one Aho-Corasick automaton over the vocabulary finds the longest
token that starts at each place. Encoding takes longest matches from the left;
a token may follow another only if the merges would keep the two apart, a
relation between tokens that is remembered; where no token fits, it steps back
and tries the next shorter one. Every place is given up at most once, so the
work is linear, and the result is exactly that of the merges in rank order.

White-space-separated chunks are remembered with their ids (bounded, two
generations), since natural text repeats them.

Null text: empty, no ids. Rows are independent, so null ids and repeated rows
keep their own result rows. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: White space around a space: chunks can't be cut at it.
_ODD = re.compile(r"\s \s|^ \s|\s $|^ $")
#: Chunks that a Python worker remembers, in two generations of this size.
MEMORY = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file (a vocabulary of fixed size, installed on every node)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = [0] * (max(self.bytes_of, default=0) + 1)
        for rank, token in self.bytes_of.items():
            self.length[rank] = len(token)
        self.text_of = {rank: str(rank) for rank in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._add(token, rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _add(self, token: bytes, rank: int) -> None:
        """Record how the merges make the token from two earlier ones."""
        self.shorter[rank] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1)
                                   if token[:k] in self.ranks), None)
        self.split[rank] = (rank, rank)
        if len(token) > 1:
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.split[rank] = (parts[0], parts[1])
                self.pair[parts[0], parts[1]] = rank

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Plain merging with the ranks below a bound (tables only)."""
        parts = [self.ranks[token[i:i + 1]] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(self.bytes_of[a] + self.bytes_of[b], below), i)
                           for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at:at + 2] = [best]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b side by side as they are."""
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        known = self.apart[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens at their border, latest first; no
        merge across the border may come before one that has been undone."""
        bound = 1 << 62
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < bound:
                return False
            left, right = self.split[a][1], self.split[b][0]
            if a > b:
                if left != a:
                    bound, a = a, left
                elif right != b:
                    bound, b = b + 1, right
                else:
                    return True
            elif right != b:
                bound, b = b + 1, right
            elif left != a:
                bound, a = a, left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, apart = len(piece), self.length, self.apart
        longest = [0] * n
        for end, (rank, less) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - less] = rank  # of one start, later ends are longer
        out: list[int] = []
        given_up = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while at < n:
            while True:
                end = at + length[token]
                if not given_up[end]:
                    fits = last < 0 or apart.get((last, token))
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        out.append(token)
                        at, last = end, token
                        if at < n:
                            token = longest[at]
                        break
                shorter = self.shorter[token]
                if shorter is not None:
                    token = shorter
                    continue
                # nothing fits here: give the place up and shorten the last token
                given_up[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                break
        return out

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:
            return tuple(self.encode_piece(chunk.encode()))
        out: list[int] = []
        for piece in pieces:
            out += self.young.get(piece) or self.old.get(piece) or self.encode_piece(piece.encode())
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of the text. A space before a non-space, after a non-space, always
        starts a match of the pattern, so chunks cut there are encoded apart."""
        if "  " in text or _ODD.search(text):
            return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode())]
        out: list[int] = []
        young, old = self.young, self.old
        lead = ""
        for part in text.split(" "):
            chunk = lead + part
            lead = " "
            ids = young.get(chunk)
            if ids is None:
                ids = old.get(chunk)
                if ids is None:
                    ids = self.encode_chunk(chunk)
                if len(young) >= MEMORY:
                    self.old, self.young = young, {}
                    young, old = self.young, self.old
                young[chunk] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))




@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def coded(text: Column, path: str, pattern: str) -> Column:
    """Struct of the ids and the bytes decoded from them."""
    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        for column in columns:
            ids = [codec.encode(t) for t in column.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.binary())],
                names=["ids", "decoded"])

    return run(text)


def digest(text: Column, path: str, pattern: str) -> Column:
    """Struct of the ids' number and the hashes of the ids and decoded bytes;
    the ids themselves stay in the worker."""
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(path, pattern)
        name = codec.text_of.__getitem__
        for column in columns:
            n, ids_sha, decoded_sha = [], [], []
            for text in column:
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(decoded_sha, pa.string())],
                                             names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows ``doc_id, ids, decoded``, one per document row."""
    common.prepare(docs.sparkSession)
    return docs.select("doc_id", coded(common.text_of(), path, pattern).alias("x")).select("doc_id", "x.*")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    common.prepare(docs.sparkSession)
    return docs.select("doc_id", digest(common.text_of(), path, pattern).alias("x")).select("doc_id", "x.*")
