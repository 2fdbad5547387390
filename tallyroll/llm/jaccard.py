"""Jaccard self-join of word shingles by parity sketches.

A text's set of shingles is drawn on a bit sketch: every shingle flips one bit, so the sketch of
two sets differs in at most as many bits as their symmetric difference has shingles.

* **Bands.**  Sets are banded by size so that sets similar enough lie in the same band or in
  neighbouring ones.  Within the join of band *i* at most ``D`` shingles can differ.
* **Pigeonhole.**  The sketch is cut in ``D + r`` blocks; of two sets similar enough at least
  ``r`` blocks are equal.  Each block (its position and its bits, folded to 64 bits by XOR of a
  code for every odd bit) is a join key.  Blocks without an odd bit are the commonest and say
  nothing; since ``r`` blocks are equal, they are needed only for sets with ``r`` of them or more.
* **Verify.**  Pairs that share a key are first checked by the Hamming distance of a smaller
  sketch, which still bounds the symmetric difference from below; the rest is counted exactly.
* **Copies.**  Equal sets are one node from the start.  In a group of many sets with one key,
  only links to one pivot are tried at first.  Where that leaves a group in several components,
  the sketches of its members are compared across components, in blocks, and each member's
  closest pairs within the bound are tried; groups with more pairs than that go on, with more and
  more of them, until none is left untried.  So no link between two components is missed, and pairs beyond the bound never become rows.

Nulls and empty texts have no shingles and link with nothing.  Very long texts are read whole.
Repeated rows are copies.  A row without a doc_id links like any other and gets its component's
smallest id, null if there is none.  Nodes are 64-bit digests of sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, written
from .components import roots

WIDTH = 4
PERCENT = 85
SLACK = 4
SPREAD = 4096  # bits of a block
PAIR_GROUP = 4  # groups up to this size try all their pairs at once
DOCS_PER_BUCKET = 8_000
BLOCK_ROWS = 2_000
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit codes of the text's word shingles (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(width, len(words)), np.uint64)
    factor = np.uint64(1)
    for k in range(min(width, len(words))):
        factor = np.uint64(int(factor) * (0x9E3779B97F4A7C15 + 2 * k) & int(MASK))
        total += mix(codes[k : k + n] + np.uint64(k)) * factor
    return np.unique(mix(total))


class Bands:
    """Size bands and the blocks of their joins, for one threshold in per cent."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.edges = [1]

    def _grow(self, size: int) -> None:
        while self.edges[-1] <= size or len(self.edges) < 3:
            last = self.edges[-1]
            self.edges.append(max(last + 1, (last - 1) * 100 // self.percent + 1))

    def band(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def differ(self, band: int) -> int:
        """How many shingles can differ in the join of ``band`` and the next one."""
        self._grow(self.edges[-1] if band + 1 >= len(self.edges) else 1)
        while band + 1 >= len(self.edges):
            self._grow(self.edges[-1])
        most = self.edges[band + 1] - 1
        return most * 100 // self.percent * (100 - self.percent) // 100

    def blocks(self, band: int) -> tuple[int, int]:
        """(number of blocks, how many of them are equal at least)."""
        d = self.differ(band)
        r = 1 if d < 8 else SLACK
        return d + r, r


def block_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, 64-bit key) of every block of every set, in both joins of its band."""
    owners, keys = [], []
    for step in (0, 1):
        plan = [(i, b) for i, s in enumerate(sets) if len(s) and (b := bands.band(len(s)) - step) >= 0 and bands.differ(b)]
        if not plan:
            continue
        blocks = np.array([bands.blocks(b)[0] for _, b in plan], np.int64)
        needed = np.array([bands.blocks(b)[1] for _, b in plan], np.int64)
        lengths = np.array([len(sets[i]) for i, _ in plan], np.int64)
        tokens = np.concatenate([sets[i] for i, _ in plan])
        place = tokens % np.repeat((blocks * SPREAD).astype(np.uint64), lengths)
        base = np.cumsum(blocks) - blocks
        at = np.repeat(base, lengths) + (place // np.uint64(SPREAD)).astype(np.int64)
        bits = np.zeros(int(blocks.sum()), np.uint64)
        np.bitwise_xor.at(bits, at, mix(place + np.uint64(1)))
        owner = np.repeat(np.arange(len(plan)), blocks)
        bare = bits == 0
        empty = np.bincount(owner[bare], minlength=len(plan))
        keep = ~bare | (empty >= needed)[owner]
        number = (np.arange(len(bits)) - base[owner]).astype(np.uint64)
        join = np.array([b for _, b in plan], np.uint64)[owner]
        key = mix(bits ^ mix((join << np.uint64(40)) + number + np.uint64(1)))
        owners.append(np.array([i for i, _ in plan])[owner[keep]])
        keys.append(key[keep])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def sketch(tokens: np.ndarray) -> bytes:
    """A parity sketch of two to four bits a shingle; a power of two in length.

    With so many, sets up to 0.03 less similar than asked for may pass the bound, and others don't.
    """
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def node_of(tokens: np.ndarray) -> int | None:
    if not len(tokens):
        return None
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


DOC, PAIR, MEMBER = 0, 1, 2
FOUND = "kind int, a long, b long, n long, sketch binary, row long"


def _draw(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, kind, blob): the documents' nodes and sketches, and the block keys dealt to buckets."""

    @lean
    def draw(batches):
        bands = Bands(percent)
        for number, batch in enumerate(batches):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_t").to_pylist()
            for first in range(0, len(ids), 2_000):
                sets = [shingles(t, width) for t in texts[first : first + 2_000]]
                nodes = [node_of(s) for s in sets]
                rows = {
                    "doc_id": pa.array(ids[first : first + 2_000], pa.int64()),
                    "node": pa.array(nodes, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "sketch": pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    "row": batch.column("row").slice(first, 2_000),
                }
                sink = pa.BufferOutputStream()
                table = pa.RecordBatch.from_pydict(rows)
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_batch(table)
                out = [((sum(n or 0 for n in nodes) + number) % buckets, DOC, sink.getvalue().to_pybytes())]
                distinct = list({n: i for i, n in enumerate(nodes) if n is not None}.values())  # copies send one set of keys
                owner, key = block_keys([sets[i] for i in distinct], bands)
                mine = np.array([nodes[i] for i in distinct], np.int64)
                where = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                start = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1]))) if len(order) else []
                for lo, hi in zip(start, np.append(start[1:], len(order))):
                    part = order[lo:hi]
                    own = owner[part]
                    o = np.argsort(own, kind="stable")
                    who, counts = np.unique(own, return_counts=True)
                    short = (key[part][o] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out.append((int(where[part[0]]), PAIR, b"".join((len(who).to_bytes(4, "little"), mine[who].tobytes(), counts.astype("<u4").tobytes(), short.tobytes()))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_t"), _row(text, doc_id).alias("row"))
    return rows.mapInArrow(draw, "bucket int, kind int, blob binary")


FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("row", pa.int64())])


def _found(kind: int, a, b, n=None, sketches=None, row=None) -> pa.Table:
    rows = len(a)
    none = lambda x, t: pa.nulls(rows, t) if x is None else x
    return pa.table([pa.array(np.full(rows, kind, np.int32)), pa.array(a) if isinstance(a, np.ndarray) else a, pa.array(b) if isinstance(b, np.ndarray) else b, none(n, pa.int64()), none(sketches, pa.binary()), none(row, pa.int64())], schema=FOUND_ARROW)


@lean
def _meet(part: pa.Table) -> pa.Table:
    """Of one bucket: its documents, the pairs of nodes to try, the members of its large groups."""
    out, nodes, keys = [], [], []
    bucket = part.column("bucket")[0].as_py()
    for kind, blob in zip(part.column("kind").to_pylist(), part.column("blob").to_pylist()):
        if kind == DOC:
            t = pa.ipc.open_stream(blob).read_all()
            out.append(_found(DOC, t["doc_id"], t["node"], t["n"], t["sketch"], t["row"]))
            continue
        n = int.from_bytes(blob[:4], "little")
        who = np.frombuffer(blob, np.int64, n, 4)
        counts = np.frombuffer(blob, "<u4", n, 4 + 8 * n)
        short = np.frombuffer(blob, np.uint8, offset=4 + 12 * n).reshape(-1, 6)
        wide = np.zeros((len(short), 8), np.uint8)
        wide[:, :6] = short
        nodes.append(np.repeat(who, counts))
        keys.append(wide.view("<u8").ravel())
    if nodes:
        node, key = np.concatenate(nodes), np.concatenate(keys)
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        node, key = node[new], key[new]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        pairs = []
        for g in range(2, PAIR_GROUP + 1):
            at = start[size == g]
            pairs += [np.column_stack((node[at + i], node[at + j])) for i in range(g) for j in range(i + 1, g)]
        large = size > PAIR_GROUP
        if large.any():
            at = np.repeat(start[large], size[large])
            member = np.concatenate([np.arange(s, s + n) for s, n in zip(start[large], size[large])])
            star = np.column_stack((node[at], node[member]))
            pairs.append(star[member != at])
            group = (mix(key[member] + np.uint64((bucket + 1) * 0x9E3779B97F4A7C15 & int(MASK)))).view(np.int64)
            out.append(_found(MEMBER, group, np.ascontiguousarray(node[member])))
        if pairs and len(p := np.unique(np.concatenate(pairs), axis=0)):
            out.append(_found(PAIR, np.ascontiguousarray(p[:, 0]), np.ascontiguousarray(p[:, 1])))
    return pa.concat_tables(out) if out else FOUND_ARROW.empty_table()


def _row(text: str, doc_id: str) -> Column:
    """The digest by which a set's text is found again; of id and text, as rows may share an id or have none."""
    return F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, doc_id: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    right = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    near = pairs.join(right("a"), "a").join(right("b"), "b").where(fit)

    def bound(batches):
        for b in batches:
            most = (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) * (100 - percent)
            ok = [(100 + percent) * hamming(x, y) <= m for x, y, m in zip(b.column("s_a").to_pylist(), b.column("s_b").to_pylist(), most)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = written(near.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bound, "a long, b long"), "jaccard-near")
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    owners = wanted.join(nodes, "node").select("row", "node")
    source = docs.select(_row(text, doc_id).alias("row"), F.col(f"`{text}`").alias("_t")).join(owners, "row")

    @lean
    def sets(batches):
        for b in batches:
            got = [(n, s.tobytes()) for t, n in zip(b.column("_t").to_pylist(), b.column("node").to_pylist()) if node_of(s := shingles(t, width)) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["node", "tokens"])

    held = written(source.select("_t", "node").mapInArrow(sets, "node long, tokens binary").dropDuplicates(["node"]), "jaccard-sets")
    side = lambda c: held.select(F.col("node").alias(c), F.col("tokens").alias(f"t_{c}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    @lean
    def count(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("t_a").to_pylist(), b.column("t_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                merged = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((merged[1:] == merged[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = written(both.mapInArrow(count, "a long, b long"), "jaccard-links")
    discard(near, held)
    return links


def _torn(members: DataFrame, root: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, lo) of the groups of several components, and (lo, node, root) of all their members.

    Groups with the same smallest root are one: near copies share many blocks, and together they
    are compared once instead of once a block.
    """
    placed = members.join(root, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    torn = placed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("group", "lo")
    torn = written(torn, "jaccard-groups")
    return torn, written(placed.join(torn, "group").select("lo", "node", "root").distinct(), "jaccard-torn")


def _close_pairs(rows: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b, cut): of the torn groups' members, pairs across components that pass the sketch's bound.

    A pair is given by the node whose component has fewer members in the group, so that a large
    component beside a few single nodes costs no more than these.  Each node gives its ``most``
    closest; where it had more, ``cut`` is the group.  Groups are dealt to tasks in blocks of
    ``BLOCK_ROWS`` members, two blocks to a task.
    """
    sizes = rows.groupBy("lo", "root").agg(F.count(F.lit(1)).alias("same"))
    groups = sizes.groupBy("lo").agg(F.ceil(F.sum("same") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["lo", "root"]).join(groups, "lo").join(nodes.select("node", "n", "sketch"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lo", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "same", "n", "sketch")
    tasks = 64 * max(1, -(-groups.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0] // 64)) if not groups.isEmpty() else 64
    deal = F.pmod(F.xxhash64("lo", "i", "j"), F.lit(tasks)).cast("int")

    @lean
    def meet(part: pa.Table) -> pa.Table:
        part = part.sort_by([("lo", "ascending"), ("i", "ascending"), ("j", "ascending")])
        group, i, j, block, node, root_, same, n = (part[c].to_numpy() for c in ("lo", "i", "j", "block", "node", "root", "same", "n"))
        sketches = part["sketch"].to_pylist()
        start = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        a, b, cut = [], [], []
        for s, e in zip(start, np.append(start[1:], len(group))):
            size = min(map(len, sketches[s:e]))
            folded = np.stack([_fold(x, size) for x in sketches[s:e]])
            own, roots_, counts, sizes_, ids = block[s:e], root_[s:e], same[s:e], n[s:e], node[s:e]
            for k in range(e - s):
                fit = (counts > counts[k]) | ((counts == counts[k]) & (roots_ > roots_[k]))
                fit &= 100 * np.minimum(sizes_, sizes_[k]) >= percent * np.maximum(sizes_, sizes_[k])
                if i[s] != j[s]:
                    fit &= own != own[k]
                others = np.flatnonzero(fit)
                bits = np.bitwise_count(folded[others] ^ folded[k]).sum(1, dtype=np.int64)
                near = (100 + percent) * bits <= (100 - percent) * (sizes_[others] + sizes_[k])
                found, bits = others[near], bits[near]
                over = len(found) > most
                if over:
                    found = found[np.argsort(bits, kind="stable")[:most]]
                for m in found:
                    a.append(min(ids[k], ids[m]))
                    b.append(max(ids[k], ids[m]))
                    cut.append(group[s] if over else None)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cut, pa.int64())], names=["a", "b", "cut"])

    return written(rows.withColumn("deal", deal).groupBy("deal").applyInArrow(meet, "a long, b long, cut long"), "jaccard-close")


def _cut_short(rows: DataFrame, close: DataFrame) -> DataFrame:
    """(group, node) of the merged groups where some node had more close pairs than it gave; a node is one row, not one for each block it shares."""
    cut = close.where("cut is not null").select(F.col("cut").alias("lo")).distinct()
    return rows.join(cut, "lo").select(F.col("lo").alias("group"), "node")


def _fold(sketch_: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch_, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every row of ``docs``.

    ``docs_per_bucket``: how many documents' blocks meet in one task, so how much memory it takes.
    """
    rows = docs.count()
    buckets = max(64, -(-rows // docs_per_bucket))
    drawn = _draw(docs, text, doc_id, width, percent, buckets)
    found = written(drawn.groupBy("bucket").applyInArrow(_meet, FOUND), "jaccard-found")
    every = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"), "sketch", "row")
    nodes = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    nodes = written(nodes, "jaccard-nodes")
    every = written(every.drop("sketch", "row"), "jaccard-rows")
    members = written(found.where(F.col("kind") == MEMBER).select(F.col("a").alias("group"), F.col("b").alias("node")), "jaccard-members")
    pairs = written(found.where(F.col("kind") == PAIR).select("a", "b").distinct(), "jaccard-pairs")
    discard(found)
    links = _verify(pairs, nodes, docs, text, doc_id, width, percent)
    tried, root, most = pairs, roots(links), 4
    while True:
        torn, rows_ = _torn(members, root)
        close = _close_pairs(rows_, nodes, percent, most)
        more = written(close.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        if not more.isEmpty():
            new = _verify(more, nodes, docs, text, doc_id, width, percent)
            tried = tried.unionByName(more)
            if not new.isEmpty():
                links = links.unionByName(new)
                root = roots(links)
        # Of the other groups all pairs within the bound have been tried now; links only join components.
        before, members = members, written(_cut_short(rows_, close), "jaccard-members")
        discard(before, close, torn, rows_)
        if members.isEmpty():
            break
        most *= 8

    # Components of the distinct sets first, so that the rows are joined once.
    placed = nodes.select("node", "first").join(root, "node", "left").withColumn("_root", F.coalesce("root", "node"))
    least = placed.groupBy("_root").agg(F.min("first").alias("component_id"))
    component = written(placed.join(least, "_root").select("node", "component_id"), "jaccard-components")
    done = every.join(component, "node", "left")
    return done.select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"))
