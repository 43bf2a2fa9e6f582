"""a plug for the token counter.

The default counts white-space tokens in the JVM (``functions.text.token_count``).
A tokenizer file puts a real one in its place: an Arrow function that loads the
file once a worker process and counts each whole text. Which one is a setting
(:data:`CONF`); the file must be readable at the same path on every node.

* ``.json``: the ``tokenizers`` library, without special tokens.
* ``.model``: the ``sentencepiece`` library.

Null texts stay null, an empty text has 0 tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX

#: Session setting: the path of a tokenizer file; unset or empty: the default counter.
CONF = "leadspark.tokenizer"


@lru_cache(maxsize=4)
def loaded(path: str) -> Callable[[str], int]:
    """The counter of a tokenizer file, read once a process."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True  # their strings in a text are ordinary text
        return lambda text: len(tok.encode(text, add_special_tokens=False))
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    raise ValueError(f"no token counter for {path}: a .json or .model file is needed")


def counter(path: str | None) -> Callable[[Column], Column]:
    """The token counter of a file, or the default one without a file."""
    if not path:
        return lambda c: TX.token_count(c).cast("bigint")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n_tokens = loaded(path)
        for texts in batches:
            yield pd.Series([None if t is None else n_tokens(t) for t in texts], dtype="Int64")

    return lambda c: count(TX.col(c))


def token_count(spark: SparkSession, c) -> Column:
    """F29 by the counter that the session's setting names."""
    return counter(spark.conf.get(CONF, None))(c)
