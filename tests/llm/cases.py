"""Rows for the edge cases that every operator must stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # further columns whose names operators use for their own
    T.StructField("h", T.StringType()), T.StructField("score", T.StringType()), T.StructField("rid", T.LongType())])

BASE = [" ".join(f"w{(i * 7 + k) % 101}x{k % (i + 3)}" for k in range(60 + 9 * i)) for i in range(6)]
LONG = " ".join(f"t{k * k % 9973}" for k in range(30_000))


def edge_rows():
    texts = [None, "", " \t\n\x0b ", "one", "two words", "a b c", "The MIT License and the GNU General Public License.",
             "mit  license\nMIT-License apache license general public general public license", *BASE,
             BASE[0] + " tail end", "head " + BASE[1], BASE[2] + "\n" + BASE[2], LONG, "na " * 400,
             "x" * 5000, "café Über naïve 你好 世界 \U0001f600  x y \x1c z", "<|endoftext|> don't I'LL 12 345 a|b",
             "\n".join(["same line of five words", "other line"] * 4)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t) if t is not None else None, "h", "s", -1)
            for i, t in enumerate(texts)]
    rows.append((None, "a text without an id", "en", "src1", 20, "h", "s", -1))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def repeated_rows():
    rows = edge_rows()
    return rows + rows[5:9] + rows[-2:]
