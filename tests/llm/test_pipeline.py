"""The pipeline against its stages done by brute force."""

import corpus_pipeline
from tests.llm.test_packing import check_pieces
from tests.llm.test_pairs import brute as brute_groups
from tests.llm.test_rows import brute_quality

from tallyroll.llm import registry

SF = "/root/testdata/sf0.001"


def cut(rows, length=50):
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if left.strip(" "):
            out[d] = left
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    rows = [r for r in rows if not brute_quality(r[1])[5]]
    kept = {d for d, _, c in brute_groups([(d, t) for d, t, _ in rows], 5, 80) if d == c}
    left = cut([(d, t) for d, t, _ in rows if d in kept])
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(left)
    check_pieces(list(left.items()), pieces, registry.tokenizer("word_bpe_49k.json"))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, empty, SF).count() == 0


def test_every_stage_takes_clashing_columns_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumns({c: F.lit(1) for c in ("_key", "kept", "node", "_q_text", "start", "spans", "component_id", "h")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
