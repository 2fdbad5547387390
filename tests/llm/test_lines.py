"""Line dedup by levelled runs, against brute force."""

import re

from pyspark.sql import functions as F

from tallyroll.llm import line_dedup
from tallyroll.llm.common import settings

DOCS = "doc_id long, text string, n_lines string, h1 string"


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def brute(texts, least=10):
    docs = [(t or "").split("\n") for t in texts]
    found = {}
    for i, lines in enumerate(docs):
        for k in {key(x) for x in lines}:
            found.setdefault(k, set()).add(i)
    common = {k for k, at in found.items() if k and len(at) >= least}
    return [(len(x), sum(key(y) in common for y in x), "\n".join(y for y in x if key(y) not in common)) for x in docs]


def corpus():
    texts = [f"own {i}\n\t All Rights reserved \n\nÄ{'x' if i % 2 else ''}\nown {i}\r\nmenu" for i in range(24)]
    texts += [None, "", "\n", "ALL RIGHTS RESERVED", " \x0b\n\x0c", "menu ", "ä\nÄ", "z" * 50_000 + "\nmenu", "nine"] + ["nine"] * 8 + ["ten\nten"] * 10
    return texts


def test_lines_of_many_documents_go(spark):
    texts = corpus()
    rows = [(None if i % 11 == 0 else i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y")]
    got = line_dedup.drop_common_lines(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "h1", "n_lines", "n_dropped", "kept"]
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))]
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    for batches, fanout in ((1, 2), (5, 2)):
        other = line_dedup.drop_common_lines(spark.createDataFrame(rows, DOCS), batches=batches, fanout=fanout)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in other.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.drop_common_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_levelled_and_remembered(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    lines = line_dedup.line_keys(spark.range(40).select(F.concat_ws("\n", F.lit("same"), F.concat(F.lit("own "), (F.col("id") % 25).cast("string"))).alias("text")), keep=[])
    runs = line_dedup.LineRuns(spark, path, min_docs=60, fanout=2)
    for b in range(3):
        runs.add(lines, b)
        runs.add(lines, b)  # a batch that comes again counts once
    assert sorted(r[:3] for r in runs.tables) == [(0, 2, 2), (1, 0, 1)]
    runs.close()
    again = line_dedup.LineRuns(spark, path, min_docs=60, fanout=2)
    assert sorted(r[:3] for r in again.tables) == [(0, 2, 2), (1, 0, 1)]
    with settings(spark, line_dedup.READING):
        total = again._sums(again.known()).groupBy().agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    # From the third batch on "same" is settled (80 documents are known), so its line is left out.
    assert (total["n"], total["most"]) == (3 * 80 - 40, 80)
    assert again.common().count() == 1
    again.add(lines, 3)
    assert sorted(r[:3] for r in again.tables) == [(2, 0, 3)]
    with settings(spark, line_dedup.READING | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        both = lines.groupBy("h1", "h2").count().join(again.known()[0].where("n >= 10"), ["h1", "h2"], "left_anti")
        plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and plan.count(" Sort [") == 1  # those of the batch
    again.delete()
    assert not line_dedup.LineRuns(spark, path).tables


def test_a_second_table_sees_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/shared-runs"
    first = spark.createDataFrame([(i, f"note\nown {i}") for i in range(9)], "doc_id long, text string")
    assert line_dedup.drop_common_lines(first, path=path, batches=2).agg(F.sum("n_dropped")).first()[0] == 0
    second = spark.createDataFrame([(100, "note \nother")], "doc_id long, text string")
    assert line_dedup.drop_common_lines(second, path=path, batches=2).first()["kept"] == "other"
