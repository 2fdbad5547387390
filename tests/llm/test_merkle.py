"""The manifest against a tree built in plain Python."""

import hashlib
import zlib

from tallyroll.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, tree string"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, low=False):
    out = ""
    for c in COLUMNS:
        v = None if r[c] is None else str(r[c])
        if c == "text" and low and v:
            v = "".join(chr(ord(q) + 32) if "A" <= q <= "Z" else q for q in v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return digest(out)


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def climb(tree, i, now):
    proof = ""
    for nodes in tree[:-1]:
        run, k = nodes[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        proof += "".join(run[:k] + run[k + 1 :])
        now, i = digest(*run[:k], now, *run[k + 1 :]), i // 8
    return proof, now


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    sorted_rows = {k: sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in order}
    trees = {k: levels([leaf(r) for r in sorted_rows[k]]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    out = []
    for j, k in enumerate(order):
        for i, r in enumerate(sorted_rows[k]):
            low = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            a, now = climb(trees[k], i, leaf(r, low))
            b, now = climb(top, j, now)
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], digest(a, b), now, now == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, merkle.manifest(docs, COLUMNS, tampered={"text": merkle.lower_case_tampering(docs)}).collect()), key=str)


def test_trees_of_all_shapes(spark):
    rows = [(i, f"Text {i} Ä", "de", "s", i, "p", "t") for i in range(75)]  # runs of eight, a last run of three, then of two
    rows += [(i, "ALONE", f"l{i}", None, None, "p", "t") for i in range(100, 109)]  # lone leaves, nine more subroots
    rows += [(i, None if i % 2 else "", None, "s", 0, "p", "t") for i in range(200, 209)] + [(None, "No ID", "fr", "s", 5, "p", "t")] * 2
    rows += [(300, "Same", "fr", "s", 4, "p", "t")] * 3 + [(301, "X" * 100_000, "fr", "s", 4, "p", "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = found(docs)
    assert got == brute(docs.collect())
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


def test_small_trees(spark):
    for n in (1, 2, 8, 9):
        docs = spark.createDataFrame([(i, f"Row {i}", "en", "s", 5, "p", "t") for i in range(n)], SCHEMA)
        assert found(docs) == brute(docs.collect())
    docs = spark.createDataFrame([], SCHEMA)
    assert found(docs) == []
