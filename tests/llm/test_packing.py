"""Packing and its token ids, against the library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyroll.llm import packing, registry, word_ids
from tests.llm.test_rows import DOCS, ODD, SF

END = 2
LETTERS = ["abcXYZ .,'’\n\t", "İIıiß.,'̇ ", "éÉàñ¿¡«\xa0\x85\x1c\x1d", "漢字か한 ", "АБвΣσς.,",
           "0123²¼Ⅷ٣ ", "éạ́.,'sst", "<|endoftext|>'s", "\U0001f600\U0001f44d‍​﻿\x00\x01", "'s't're've'm'll'd\"`"]


@pytest.fixture(scope="module")
def path():
    return registry.tokenizer("word_bpe_49k.json")


def crc32_of(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_pieces(docs, pieces, path, length=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = Counter()
    by_doc = {}
    for d, t in docs:
        texts[d] += 1
        by_doc[d] = [*tok.encode(t or "", add_special_tokens=False).ids, END]
    seen = {d: [] for d in by_doc}
    windows = {}
    for p in pieces:
        ids = by_doc[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["length"] > 0
        assert p["ids_crc32"] == crc32_of(ids[p["start"] : p["start"] + p["length"]])
        seen[p["doc_id"]].append((p["start"], p["length"]))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for d, got in seen.items():
        cover = Counter(i for s, n in got for i in range(s, s + n))
        assert cover == Counter({i: texts[d] for i in range(len(by_doc[d]))})
    sizes = []
    for _, got in sorted(windows.items()):
        at = 0
        for offset, n in sorted(got):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length for s in sizes[:-1]) and sorted(windows) == list(range(len(windows)))


def same_ids(enc, texts):
    bad = [t for t, a, b in zip(texts, enc.library(texts), enc.encode(texts)) if not np.array_equal(a, b)]
    assert not bad, [ascii(b) for b in bad[:5]]


def test_ids_are_the_librarys(path):
    enc = word_ids.Encoder(path)
    assert enc.by_words
    same_ids(enc, [chr(a) + chr(b) for a in range(256) for b in range(256)])
    rng = random.Random(3)

    def text():
        out = ""
        for _ in range(rng.randint(0, 14)):
            x = rng.random()
            out += rng.choice(["<|endoftext|>", "'s", "<|", "|>"]) if x < 0.05 else chr(rng.randrange(0x20, 0x3000)) if x < 0.15 else rng.choice(rng.choice(LETTERS))
        return out

    for _ in range(4):  # the table of units fills up in between
        same_ids(enc, [text() for _ in range(25_000)])
    same_ids(enc, ["", " ", "a" * 100_000, "a'" * 20_000, "İ,", "x" * 17 + " " + "y" * 16])


def test_other_tokenizers_encode_whole_texts():
    enc = word_ids.Encoder(registry.tokenizer("byte_bpe_50k.json"))
    assert not enc.by_words
    same_ids(enc, ["It's  a test ", "", "İ, x"])


@pytest.mark.parametrize("block_tokens", [1 << 20, 3000])
def test_packing(spark, path, block_tokens):
    docs = spark.createDataFrame(ODD, DOCS).unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 20"))
    extra = docs.selectExpr("*", "'x' as ids", "1 as n", "2 as block", "3 as queue")  # names that the operator uses itself
    pieces = packing.pack(spark, extra, path, digests=True, block_tokens=block_tokens).collect()
    check_pieces([(r["doc_id"], r["text"]) for r in docs.collect()], pieces, path)
    whole = packing.pack(spark, docs, path, block_tokens=block_tokens).collect()
    key = ["doc_id", "start", "length", "sequence_id", "offset"]
    assert sorted((*(p[k] or -1 for k in key), p["ids_crc32"]) for p in pieces) == sorted((*(p[k] or -1 for k in key), zlib.crc32(p["ids"])) for p in whole)
    assert packing.pack(spark, docs.limit(0), path).count() == 0


def shares(pieces, length):
    """For each full window, the tokens of each source."""
    out = {}
    for p in pieces:
        out.setdefault(p["sequence_id"], Counter())[p["source"]] += p["length"]
    return [c for _, c in sorted(out.items()) if sum(c.values()) == length]


def test_every_window_has_the_corpus_mixture(spark, path):
    rows = [(i, "w " * (20 + i % 300), "a" if i % 3 == 0 else f"s{i % 7}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += t.count("w") + 1
    windows = shares(packing.pack(spark, docs, path, block_tokens=20_000).collect(), 4096)
    given = Counter()
    for k, w in enumerate(windows):
        given.update(w)
        for s, n in total.items():  # what a source lacks is carried, and never more than a few grains
            want = 4096 * (k + 1) * n / sum(total.values())
            assert abs(given[s] - want) <= 3 * packing.GRAIN


def test_target_weights(spark, path):
    rows = [(i, "w " * 99, "abcd"[i % 4]) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, path, targets={"a": 6, "b": 3, "c": 1}, block_tokens=10_000, digests=True).collect()
    check_pieces([(d, t) for d, t, _ in rows], pieces, path)
    windows = shares(pieces, 4096)
    want = {"a": 0.6, "b": 0.3, "c": 0.1}
    full = int(40_000 / 0.6 / 4096)  # until a runs dry
    for w in windows[:full]:
        assert all(abs(w[s] - 4096 * x) <= 3 * packing.GRAIN for s, x in want.items()) and not w["d"]
    for w in windows[full + 1 : full + 6]:  # then b and c go on, three to one
        assert not w["a"] and not w["d"] and abs(w["b"] - 3072) <= 3 * packing.GRAIN
    assert windows[-1]["d"] == 4096  # no target: after all others


def test_two_thousand_sources(spark, path):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 2000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, path, digests=True, block_tokens=30_000).collect()
    check_pieces([(d, t) for d, t, _ in rows], pieces, path)
    assert len({p["source"] for p in pieces}) == 2000
