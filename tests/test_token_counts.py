import pytest

from leadspark.operators import token_counts as TK

TEXTS = ["", " ", "one two  three\n", "naïve Łódź 日本語", "<|endoftext|> stays text", "a" * 5000, "word " * 30000, None]


def counts(spark, path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    return [r.n for r in df.select("i", TK.counter(path)("text").alias("n")).orderBy("i").collect()]


def test_default_counter(spark):
    assert counts(spark, None) == [0, 0, 3, 3, 3, 1, 30000, None]


def test_tokenizers_file(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = [None if t is None else len(tok.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    assert counts(spark, path) == want and want[0] == 0 and want[4] > 3


def test_sentencepiece_file(spark):
    public = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor
    path = public.path("piece_bpe_32k.model")
    pieces = SentencePieceProcessor(model_file=path)
    assert counts(spark, path) == [None if t is None else len(pieces.encode(t)) for t in TEXTS]


def test_the_session_names_the_counter(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("Hello, world!",)], "text string")
    assert df.select(TK.token_count(spark, "text")).first()[0] == 2
    spark.conf.set(TK.CONF, public.path("byte_bpe_50k.json"))
    try:
        assert df.select(TK.token_count(spark, "text")).first()[0] == 4
    finally:
        spark.conf.unset(TK.CONF)
    with pytest.raises(ValueError):
        TK.loaded("/nowhere/vocabulary.txt")
