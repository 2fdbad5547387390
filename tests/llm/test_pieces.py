"""The shared-prefix search against the library's own unigram search over the same pieces."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyroll.llm import pieces, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb2.ModelProto()
    with open(registry.tokenizer("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb2.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_words_are_searched_as_by_the_library(spark, library):
    v = pieces.Vocabulary(registry.tokenizer("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    words = sorted({w for r in docs for w in (r["text"] or "").split(" ") if 0 < len(w) < 200})[:4000]
    words += ["é\U0001f600x", "x\n\ny", "\t", "   ", "aaaaaaaaaaaaaaaaaaaaaa", "ﬁ"]
    for w, ids in zip(words, v.encode(words)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(w), w


def test_round_trip_and_odd_rows(spark):
    path = registry.tokenizer("piece_bpe_32k.model")
    rows = [(1, None), (2, ""), (3, " a  b "), (4, "\U0001f600\u0000中 x"), (5, "y" * 20_000), (6, "same same"), (6, "same same")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, ids string")
    df = df.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "'z' as ids"))
    got = pieces.decode(pieces.encode(df, path), path).collect()
    assert len(got) == df.count()
    assert all(r["decoded"] == (r["text"] or "") and len(r["ids"]) == 4 * r["n_pieces"] for r in got)
    once = pieces.encode(df.withColumn("decoded", F.lit(1)), path, decoded=True).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, got))
    assert pieces.encode(df.limit(0), path).count() == 0
    q = registry.op4_sentencepiece(spark, SF).collect()
    assert all(r["round_trip"] for r in q)
