"""Merged transforms against sorted suffixes, and repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tallyroll.llm import registry, substrings, suffixes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(6))
def test_merge_is_the_order_of_all_suffixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 14))]
    parts = [strings[0::3], strings[1::3], strings[2::3]]
    shards = [suffixes.Shard(p) for p in parts]
    for depth in (1, 3, 20):
        z, place, shared, _ = suffixes.merge(shards, depth)
        got = []
        for s, p in zip(z.tolist(), place.tolist()):
            at = shards[s].order[p]
            i = shards[s].owner[at]
            got.append((parts[s][i][shards[s].offset[at] :], s, i))
        mark = lambda t: [*(b + 1 for b in t[0])][:depth]
        want = [(t[k:], s, i) for s, p in enumerate(parts) for i, t in enumerate(p) for k in range(len(t) + 1)]
        assert sorted(got) == sorted(want)
        if depth == 20:
            assert got == sorted(want, key=lambda t: (t[0], t[1], t[2]))
        assert [mark(t) for t in got] == sorted(mark(t) for t in got)
        for a, b, lcp in zip(got, got[1:], shared[1:].tolist()):
            n = 0
            while n < depth and n < len(a[0]) and n < len(b[0]) and a[0][n] == b[0][n]:
                n += 1
            assert lcp == n


def brute(rows, length):
    first = {}
    data = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for (d, b), (raw, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((raw, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=repr)


def test_planted_passages(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common, twice = text(130), text(50)
    rows = [(None, common + text(20)), (5, None), (6, ""), (7, "short"), (8, "x" * 300), (9, "x" * 120), (9, "x" * 90), (3, "ab" * 100), (4, "b" + "ab" * 60)]
    for i in range(60):
        parts = [text(rng.randrange(90)) for _ in range(4)]
        at = rng.randrange(60)
        rows.append((100 + i, parts[0] + common[at : at + rng.randrange(40, 130)] + parts[1] + (twice if i % 2 else twice[:49]) + parts[2] + (common if i % 7 == 0 else "") + parts[3]))
    rows += rows[20:24] + [(1000, rows[30][1]), (1001, rows[30][1][10:-3])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").repartition(6)
    want = brute(rows, 50)
    assert result(substrings.remove_repeats(df)) == want
    assert result(substrings.remove_repeats(df, hot_docs=2)) == want  # most minimizers are dealt finer
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = registry.op3_suffix_dedup(spark, SF).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == want


def test_a_phrase_that_many_hold(spark):
    """One rare gram in ever other contexts: its runs go to many buckets."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    whole = [text(70) for _ in range(6)]
    rows = [(i, text(60) + rng.choice(whole[:3]) + "zzzzzzzzzzzzzzzzzzzzzzzz" + rng.choice(whole[3:]) + text(60)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(substrings.remove_repeats(df, hot_docs=5)) == brute(rows, 50)
    made = [substrings._finer(t.encode(), *(np.array([x]) for x in (0, len(t) - 49)), np.array([1], np.uint64), 50, 20) for _, t in rows[:2]]
    assert all(s[0] == 0 and (s[1:] == e[:-1]).all() and e[-1] == len(t) - 49 for (s, e, _), (_, t) in zip(made, rows))
