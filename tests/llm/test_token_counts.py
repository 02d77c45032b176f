import public_tokenizers
from tokenizers import Tokenizer

from crosscut.llm.token_counts import CACHE_SCHEMA, token_counts, tokenizer_version

NAME = "byte_bpe_50k.json"


def test_counts_and_cache(spark, tmp_path):
    texts = ["one two", None, "", "one two", "Ünï\u200bcode 😀\n\n x", "<|endoftext|> a<|endoftext|>", "a" * 30_000, "  ", "x\r\ny"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "one two", 5), (0, "one two", 5)], "doc_id long, text string, n_tokens int")
    t = Tokenizer.from_file(public_tokenizers.path(NAME))
    cache = str(tmp_path / "cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    for _ in range(2):  # the second time, all is in the cache
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_bytes"], r["n_tokens"]) for r in token_counts(df, NAME, cache_path=cache).collect())
        want = sorted((-1 if i is None else i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in [*enumerate(texts), (None, "one two"), (0, "one two")])
        assert got == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({x or "" for x in texts})
    # counts of another version are not used
    other = stored.selectExpr("digest", "'old' AS version", "99L AS n_tokens")
    spark_dir = str(tmp_path / "old")
    other.write.parquet(spark_dir)
    assert {r["n_tokens"] for r in token_counts(df, NAME, cache_path=spark_dir).collect()} != {99}
    assert tokenizer_version(public_tokenizers.path(NAME)) != tokenizer_version(public_tokenizers.path("word_bpe_49k.json"))


def test_pieces_and_empty_table(spark):
    import sentencepiece

    df = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "piece_bpe_32k.model").collect()}
    assert got == {1: len(m.encode("some words here")), 2: 0}
    assert token_counts(df.limit(0), NAME).count() == 0


def test_a_cache_that_is_not_there_yet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    path = str(tmp_path / "new")
    for more in (2, 2, 3):
        if more == 3:
            df = df.unionByName(spark.createDataFrame([(4, "d e f"), (5, "c")], "doc_id long, text string"))
        rows = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(df, NAME, cache_path=path).collect())
        assert rows[:3] == [(1, 3, 2), (2, 3, 2), (3, 1, 1)] and spark.read.parquet(path).count() == more


def test_contents_too_many_to_send(spark, monkeypatch):
    import crosscut.llm.token_counts as C
    from crosscut.llm.shared import checked

    monkeypatch.setattr(C, "checked", lambda t: checked(t, -1))
    df = spark.createDataFrame([(i, f"w {i % 5}") for i in range(50)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts(df, NAME).collect()) == [(i, 2) for i in range(50)]
