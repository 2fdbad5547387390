"""Exact substring dedup: bytes covered by a string that an earlier document also holds.

All ``length``-byte windows of the corpus that may recur are brought together by content:

1. Every window has a *minimizer*, the least of the codes of its short grams; equal windows have
   equal ones.  The windows of a document form runs of one minimizer.  Which minimizers occur in
   several documents is found by a shuffle of their codes alone (made distinct per task first).
2. Only runs of shared minimizers go on, dealt by minimizer.  Runs of equal content are one
   string; all its owners but the earliest document are repeats.  This is done once in the task
   that reads them, so a passage that a third of all documents hold travels once a task.
   A minimizer of more than ``HOT_DOCS`` documents (a phrase that many hold in other contexts) is
   dealt further: its runs are cut by a second minimizer, of another order, which equal windows
   share too.  Which ones these are is told to all tasks by a filter of fixed size; what it
   takes for hot by mistake is only cut finer.
3. In each bucket the distinct strings that share a window code are cut to where they do and
   split in shards; each shard's Burrows-Wheeler transform is built and the shards are merged by
   interleave refinement (``suffixes``).  The merged intervals of suffixes with ``length`` common
   bytes decide, byte for byte, which windows an earlier document holds.
4. The spans go back to their documents and are cut out.

Nulls: a null text is empty; a null doc_id is the smallest.  Rows with one doc_id never remove
each other's bytes.  Short and empty texts are kept.  Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .jaccard import mix
from .suffixes import repeated

LENGTH = 50
GRAM = 20
DOCS_PER_BUCKET = 16_000
#: Documents whose shared runs go to one task on average, and those of one minimizer that may.
DOCS_PER_MEETING = 2_000
HOT_DOCS = 50_000
HOT_BITS = 20
PART_BYTES = 8_000_000
SHARDS = 4
LOWEST = -(2**63)
KEYS, TOLD, MARKS = 0, 1, 2
RUNS, SPANS = 0, 1


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    return x[:-4] | (x[4:] << np.uint64(32))


def _codes(words: np.ndarray, width: int) -> np.ndarray:
    """A code of the ``width`` (8 or more) bytes from each place."""
    n = len(words) - (width - 8)
    out = np.zeros(max(n, 0), np.uint64)
    for at in sorted({*range(0, width - 7, 8), width - 8}):
        out = (out ^ words[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return mix(out)


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, window after the last) of each run of windows with one minimizer.

    ``order``: another number is another order of the grams, so that other grams are least.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    m = _codes(_words(np.frombuffer(data, np.uint8)), gram)
    if order:
        m = mix(m + np.uint64(order))
    want, have = length - gram + 1, 1
    while have * 2 <= want:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < want:
        m = np.minimum(m[: len(m) - (want - have)], m[want - have :])
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    start = np.concatenate(([0], cut))
    return m[start], start, np.append(cut, len(m))


def _pack(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _cut_by(where: np.ndarray):
    order = np.argsort(where, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1]))) if len(order) else []
    for lo, hi in zip(start, np.append(start[1:], len(order))):
        yield int(where[order[lo]]), order[lo:hi]


def _hot_place(codes: np.ndarray) -> np.ndarray:
    """Where a code stands in the filter of hot ones."""
    return (mix(codes) >> np.uint64(64 - HOT_BITS)).astype(np.int64)


def _finer(data: bytes, start: np.ndarray, end: np.ndarray, minimizer: np.ndarray, length: int, gram: int):
    """The runs cut where the minimizer of the second order changes: (start, end, key)."""
    m2, s2, e2 = runs(data, length, gram, order=1)
    out_s, out_e, out_k = [], [], []
    for a, b, m in zip(start.tolist(), end.tolist(), minimizer.tolist()):
        i, j = np.searchsorted(e2, a, side="right"), np.searchsorted(s2, b, side="left")
        out_s.append(np.maximum(s2[i:j], a))
        out_e.append(np.minimum(e2[i:j], b))
        out_k.append(mix(m2[i:j] ^ np.uint64(m)))
    return np.concatenate(out_s), np.concatenate(out_e), np.concatenate(out_k)


def _parts(batch, most: int = PART_BYTES):
    """The rows of an Arrow batch, about ``most`` bytes at a time."""
    ids, hashes, data = (batch.column(c) for c in ("doc_id", "h", "data"))
    at, size = 0, 0
    for i in range(len(ids)):
        size += len(data[i].as_buffer() or b"")
        if size >= most or i == len(ids) - 1:
            yield ids[at : i + 1].to_numpy(), hashes[at : i + 1].to_numpy(), data[at : i + 1].to_pylist(), i
            at, size = i + 1, 0


def _small(codes: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of codes that were dealt to buckets by their remainder and cut to 32 bits."""
    n = np.uint64(buckets)
    return ((codes // n) & np.uint64(2**32 - 1)) * n + codes % n


def _shared_minimizers(rows: DataFrame, buckets: int, length: int, gram: int, hot_docs: int) -> DataFrame:
    """(doc_id, h, codes, hot): of each document the minimizers that another one has too; and, as ``hot``, those that very many have."""

    def draw(batches):
        for number, batch in enumerate(batches):
            for ids, hashes, data, _ in _parts(batch):
                got = [np.unique(runs(d, length, gram)[0]) for d in data]
                owner = np.repeat(np.arange(len(got)), [len(g) for g in got])
                codes = np.concatenate(got)
                order = np.argsort(codes, kind="stable")
                s = codes[order]
                again = np.zeros(len(s), bool)
                same = s[1:] == s[:-1]
                again[1:] |= same
                again[:-1] |= same
                out = []
                # Met twice in this task: its documents know already; one mark goes on.
                known, lone = order[again], order[~again]
                if len(known):
                    k = np.sort(known)
                    out.append((number % buckets, TOLD, _pack(doc_id=ids[owner[k]], h=hashes[owner[k]], code=codes[k])))
                marks, owners = np.unique(codes[known], return_counts=True)
                lone.sort()
                for b, at in _cut_by((codes[lone] % np.uint64(buckets)).astype(np.int64)):
                    mine = lone[at]
                    who, counts = np.unique(owner[mine], return_counts=True)
                    short = (codes[mine] // np.uint64(buckets)).astype("<u4")
                    head = len(who).to_bytes(4, "little") + ids[who].astype(np.int64).tobytes() + hashes[who].tobytes() + counts.astype("<u4").tobytes()
                    out.append((b, KEYS, head + short.tobytes()))
                for b, at in _cut_by((marks % np.uint64(buckets)).astype(np.int64)):
                    short = (marks[at] // np.uint64(buckets)).astype("<u4")
                    out.append((b, MARKS, owners[at].astype("<u4").tobytes() + short.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    told = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("codes", pa.binary()), ("hot", pa.bool_())])

    def meet(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        out_id, out_h, out_codes = [], [], []

        all_id, all_h, all_code, times = [], [], [], []  # times: how many documents a mark stands for, 0 for a document's own code
        for kind, blob in zip(part.column("kind").to_pylist(), part.column("blob").to_pylist()):
            if kind == TOLD:
                t = _unpack(blob)
                _tell(out_id, out_h, out_codes, t["doc_id"].to_numpy(), t["h"].to_numpy(), t["code"].to_numpy())
                continue
            if kind == MARKS:
                n = len(blob) // 8
                times.append(np.frombuffer(blob, "<u4", n))
                all_code.append(np.frombuffer(blob, "<u4", n, 4 * n))
                all_id.append(np.zeros(n, np.int64))
                all_h.append(np.zeros(n, np.int64))
                continue
            n = int.from_bytes(blob[:4], "little")
            ids, hashes = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.int64, n, 4 + 8 * n)
            counts = np.frombuffer(blob, "<u4", n, 4 + 16 * n)
            all_code.append(np.frombuffer(blob, "<u4", offset=4 + 20 * n))
            all_id.append(np.repeat(ids, counts))
            all_h.append(np.repeat(hashes, counts))
            times.append(np.zeros(len(all_code[-1]), "<u4"))
        hot = np.empty(0, np.uint64)
        if all_code:
            code, ids, hashes, times = (np.concatenate(x) for x in (all_code, all_id, all_h, times))
            order = np.argsort(code, kind="stable")
            s = code[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(first, len(s)))
            pick = order[np.repeat(size > 1, size)]
            pick = np.sort(pick[times[pick] == 0])  # in order of arrival: a document's codes are together
            whole = lambda x: x.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
            _tell(out_id, out_h, out_codes, ids[pick], hashes[pick], whole(code[pick]))
            many = np.add.reduceat(np.maximum(times[order], 1).astype(np.int64), first)
            hot = whole(s[first[many > hot_docs]])
        n = len(out_id)
        if len(hot):
            out_id.append(0)
            out_h.append(0)
            out_codes.append(hot.tobytes())
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_h, pa.int64()), pa.array(out_codes, pa.binary()), pa.array(np.arange(len(out_id)) >= n)], schema=told)

    drawn = rows.mapInArrow(draw, "bucket int, kind int, blob binary")
    return drawn.groupBy("bucket").applyInArrow(meet, "doc_id long, h long, codes binary, hot boolean")


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which of ``values`` are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _tell(out_id: list, out_h: list, out_codes: list, ids, hashes, codes) -> None:
    if not len(ids):
        return
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))))
    for s, e in zip(first, np.append(first[1:], len(ids))):
        out_id.append(int(ids[s]))
        out_h.append(int(hashes[s]))
        out_codes.append(codes[s:e].tobytes())


def _spans_blob(start, end) -> bytes:
    return np.column_stack((np.asarray(start, np.int64), np.asarray(end, np.int64))).astype("<i8").tobytes()


def _emit_spans(ids, hashes, start, end) -> tuple[list, list, list]:
    """One row per document: its spans."""
    order = np.lexsort((start, hashes, ids))
    ids, hashes, start, end = ids[order], hashes[order], start[order], end[order]
    out_id, out_h, out = [], [], []
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])))) if len(ids) else []
    for s, e in zip(first, np.append(first[1:], len(ids)) if len(ids) else []):
        out_id.append(int(ids[s]))
        out_h.append(int(hashes[s]))
        out.append(_spans_blob(start[s:e], end[s:e]))
    return out_id, out_h, out


def _hot_filter(told: DataFrame) -> np.ndarray | None:
    """Marks of the hot codes, at most ``2 ** HOT_BITS`` of them; None if there are none."""

    def places(batches):
        for b in batches:
            for blob in b.column("codes").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hot_place(np.frombuffer(blob, np.uint64))))], names=["place"])

    found = told.where("hot").select("codes").mapInArrow(places, "place long").distinct().collect()
    if not found:
        return None
    marks = np.zeros(1 << HOT_BITS, bool)
    marks[[r["place"] for r in found]] = True
    return marks


def find_repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc_id, h, spans) from rows (doc_id not null, h, data): spans are pairs of 64-bit byte places."""
    count = rows.count()
    buckets = max(16, -(-count // DOCS_PER_BUCKET))
    told = written(_shared_minimizers(rows, buckets, length, gram, hot_docs), "substring-shared")
    marks = _hot_filter(told)
    lists = told.where("not hot").groupBy("doc_id", "h").agg(F.collect_list("codes").alias("codes"))
    with_lists = rows.join(lists, ["doc_id", "h"])
    strings = max(64, -(-count // DOCS_PER_MEETING))

    def cut(batches):
        for batch in batches:
            lists_ = batch.column("codes")
            at = 0
            for ids, hashes, data, last in _parts(batch):
                text, who, start, minimizer = [], [], [], []
                for i, d in enumerate(data):
                    m, s, e = runs(d, length, gram)
                    mine = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in lists_[at + i].as_py()]))
                    # Lists hold whole codes, or what is left of them after they were dealt; either may only add runs.
                    small = _small(m, buckets)
                    ok = _among(m, mine) | _among(small, mine)
                    m, s, e, small = m[ok], s[ok], e[ok], small[ok]
                    if marks is not None and (hot := marks[_hot_place(small)]).any():
                        # A code told by its own task is whole, but its small form is what the filter knows.
                        fs, fe, fk = _finer(d, s[hot], e[hot], m[hot], length, gram)
                        m, s, e = np.append(m[~hot], fk), np.append(s[~hot], fs), np.append(e[~hot], fe)
                    text += [d[a : b + length - 1] for a, b in zip(s.tolist(), e.tolist())]
                    who.append(np.full(len(s), i))
                    start.append(s)
                    minimizer.append(m)
                at = last + 1
                if not text:
                    continue
                who, start, minimizer = np.concatenate(who), np.concatenate(start), np.concatenate(minimizer)
                doc, size = ids[who], np.fromiter(map(len, text), np.int64, len(text))
                least: dict[bytes, int] = {}
                for t, d in zip(text, doc.tolist()):
                    if d < least.get(t, d + 1):
                        least[t] = d
                late = doc > np.fromiter(map(least.__getitem__, text), np.int64, len(text))
                out = []
                if late.any():
                    out.append((int(hashes[0]) % strings, SPANS, _pack(doc_id=doc[late], h=hashes[who[late]], start=start[late], end=(start + size)[late])))
                keep = np.flatnonzero(~late)
                for b, k in _cut_by((mix(minimizer[keep]) % np.uint64(strings)).astype(np.int64)):
                    k = keep[k]
                    out.append((b, RUNS, _pack(doc_id=doc[k], h=hashes[who[k]], start=start[k], text=pa.array([text[j] for j in k.tolist()], pa.binary()))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "blob"])

    def meet(part: pa.Table) -> pa.Table:
        docs, hashes, start, end, tables = [], [], [], [], []
        for kind, blob in zip(part.column("kind").to_pylist(), part.column("blob").to_pylist()):
            t = _unpack(blob)
            if kind == SPANS:
                for keep, name in ((docs, "doc_id"), (hashes, "h"), (start, "start"), (end, "end")):
                    keep.append(t[name].to_numpy())
            else:
                tables.append(t)
        if tables:
            for found in _strings(pa.concat_tables(tables), length):
                for keep, values in zip((docs, hashes, start, end), found):
                    keep.append(values)
        columns = _emit_spans(*(np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, hashes, start, end)))
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["doc_id", "h", "spans"])

    cut_rows = with_lists.select("doc_id", "h", "data", "codes").mapInArrow(cut, "bucket int, kind int, blob binary")
    return written(cut_rows.groupBy("bucket").applyInArrow(meet, "doc_id long, h long, spans binary"), "substring-spans")


def _strings(t: pa.Table, length: int):
    """Spans of one bucket's strings that an earlier document holds: (doc_id, h, start, end)."""
    doc, h, start = (t[c].to_numpy() for c in ("doc_id", "h", "start"))
    coded = t["text"].combine_chunks().dictionary_encode()
    which, text = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    size = np.fromiter(map(len, text), np.int64, len(text))
    order = np.lexsort((doc, which))
    first = np.flatnonzero(np.concatenate(([True], which[order][1:] != which[order][:-1])))
    least = doc[order][first]  # of each distinct string, its earliest document
    late = doc > least[which]
    yield doc[late], h[late], start[late], (start + size[which])[late]
    # Which windows of distinct strings have one code; only there can anything be shared.
    joined = np.frombuffer(b"".join(text), np.uint8)
    if len(joined) < length:
        return
    code = _codes(_words(joined), length)
    owner = np.repeat(np.arange(len(text)), size)
    place = np.arange(len(joined)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(place[: len(code)] + length <= size[owner[: len(code)]])
    code, owner, place = code[inside], owner[inside], place[inside]
    if not len(code):
        return
    o = np.argsort(code, kind="stable")
    s = code[o]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    several = np.minimum.reduceat(owner[o], first) < np.maximum.reduceat(owner[o], first)
    hit = np.sort(o[np.repeat(several, np.diff(np.append(first, len(s))))])
    if not len(hit):
        return
    who, lo_at = np.unique(owner[hit], return_index=True)
    hi_at = np.append(lo_at[1:], len(hit)) - 1
    lo, hi = place[hit][lo_at], place[hit][hi_at]
    cut = [text[w][a : b + length] for w, a, b in zip(who.tolist(), lo.tolist(), hi.tolist())]
    string, offset = repeated(cut, least[who], length, SHARDS)
    if not len(string):
        return
    at = lo[string] + offset
    owner = who[string]
    # Every row that owns the string as its earliest document loses these windows.
    mine = np.flatnonzero(~late)
    mine = mine[np.argsort(which[mine], kind="stable")]
    begin = np.searchsorted(which[mine], np.arange(len(text) + 1))
    times = (begin[1:] - begin[:-1])[owner]
    row = mine[np.repeat(begin[owner], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
    a = start[row] + np.repeat(at, times)
    yield doc[row], h[row], a, a + length


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id", as_text: bool = False, hot_docs: int = HOT_DOCS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (the remaining bytes); clashing columns are replaced.

    ``as_text``: kept is a string; what a cut leaves of a split character goes too.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept", "_doc", "h", "data", "spans")
    rest = [c for c in docs.columns if c not in names]
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST))
    hashed = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(key.alias("doc_id"), hashed.alias("h"), data.alias("data"))
    spans = find_repeats(rows, length, gram, hot_docs)
    spans = spans.groupBy(F.col("doc_id").alias("_doc"), "h").agg(F.collect_list("spans").alias("spans"))
    full = docs.select(*[F.col(f"`{c}`") for c in rest], key.alias("_doc"), hashed.alias("h"), data.alias("data"))
    full = full.join(spans, ["_doc", "h"], "left").drop("_doc", "h")
    kept = [f for f in docs.schema.fields if f.name in rest]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in names[:3]), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def apply(batches):
        for b in batches:
            n_bytes, n_removed, n_spans, left = [], [], [], []
            for d, blobs in zip(b.column("data").to_pylist(), b.column("spans").to_pylist()):
                n_bytes.append(len(d))
                if not blobs:
                    n_removed.append(0)
                    n_spans.append(0)
                    left.append(d)
                    continue
                s = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
                depth = np.zeros(len(d) + 1, np.int64)
                np.add.at(depth, s[:, 0], 1)
                np.add.at(depth, s[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                left.append(np.frombuffer(d, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in rest], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary())],
                names=[*rest, *names[:4]],
            )

    return full.select(*[F.col(f"`{c}`") for c in rest], "data", "spans").mapInArrow(apply, schema)
