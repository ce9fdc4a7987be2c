"""Empty tables, names that clash in another case, and ids of other types."""

import public_tokenizers
import pytest

from strataline.llm import bytebpe, chat, pii, quality, simhash, topk, vectorjoin

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize(
    "op",
    [
        lambda df: bytebpe.encode_decode(df, BPE, public_tokenizers.PATTERN),
        lambda df: quality.with_quality(df, quality.train([("a", 1)])),
        lambda df: simhash.with_fingerprint(df),
    ],
)
def test_names_that_clash_in_another_case(spark, op):
    df = spark.createDataFrame([(1, "some text", 5, 6, 7), (1, "some text", 5, 6, 7), (None, None, None, None, None)], "doc_id long, text string, N_Tokens int, Quality int, Fingerprint int")
    out = op(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert len(out.select(*out.columns).collect()) == 3 and op(df.where("false")).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_digest(docs).count() == pii.pii_digest(docs).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), topk.F.lit(True)).count() == 0
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_vectors_without_an_id_and_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(None, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectorjoin.near_vectors(df).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}
    with pytest.raises(TypeError):
        vectorjoin.near_vectors(df.selectExpr("cast(vec_id as string) as vec_id", "embedding"))
    big = spark.createDataFrame([(1, [1e12]), (2, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, topk.F.lit(True)).collect()
