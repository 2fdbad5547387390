"""Mixture-controlled packing of token ids into fixed windows.

Every source is a queue of its documents' ids, in the order in which the table is read.  Windows
of ``length`` tokens are filled by deficit round-robin: a window gives each source its share of
the target mixture, in grains of ``grain`` ids; what a share lacks of a whole grain is carried to
the next window as that source's deficit.  The target is the corpus' own mixture, or ``targets``
(source to weight).  When a queue runs dry its share goes to the others in proportion to their
targets; sources without a target come after all others, mixed in proportion to their sizes.

The carried deficits have a closed form: grain *u* of a source falls due at ``(u + phase) / rate``,
where the rate is the source's share and the phase, between 0 and 1, comes from its name (so that
small sources don't all fall due at once).  Windows take the grains as they fall due.  No task has
to wait for another one's windows, and deficits agree across partitions:

1. The texts are encoded once and written, with the place of each document in its source's queue
   within its part; two-level prefix sums give the place in the whole queue.
2. The time axis is cut in blocks of about ``BLOCK_TOKENS`` tokens; documents are cut where the
   block changes.  The blocks' token counts, prefix-summed, say which windows each block fills.
3. Each block orders its grains and cuts windows.  A source with a third of all rows is spread
   over all blocks, and any number of sources is just more rows.

Nulls: a null text is empty and becomes the end id alone; a null source is a queue of its own.
Repeated rows are packed each.  Documents longer than a window are cut.  Empty tables give empty
results.  Only doc_id, the text and the source are read; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .word_ids import encoder

LENGTH = 4096
END_ID = 2
GRAIN = 32
BLOCK_TOKENS = 1 << 19
#: Points at which the tokens due so far are measured, where sources run dry at different times.
KNOTS = 512
GROUP = 4096
#: Texts that are encoded at once.
ROWS = 1000


def _coded(docs: DataFrame, tokenizer_path: str, end_id: int, text: str, source: str) -> DataFrame:
    """(doc_id, queue, part, before, n, ids): ``before`` is what the part has of the queue before the document."""

    def encode(batches):
        enc, part, given = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], np.uint32)
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            ids = [np.append(x, end) for x in enc.encode([x or "" for x in batch.column("_t").to_pylist()])]
            blobs = [x.astype("<u4").tobytes() if x.max() > 65535 else b"\0" + x.astype("<u2").tobytes() for x in ids]
            before = []
            for q, x in zip(batch.column("queue").to_pylist(), ids):
                before.append(given.get(q, 0))
                given[q] = before[-1] + len(x)
            columns = [
                batch.column("doc_id"),
                batch.column("queue"),
                pa.array([part] * len(ids), pa.int32()),
                pa.array(before, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array(blobs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "queue", "part", "before", "n", "ids"])

    queue = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), queue.alias("queue"), F.col(f"`{text}`").alias("_t"))
    return rows.mapInArrow(encode, "doc_id long, queue string, part int, before long, n long, ids binary")


def _queues(spark: SparkSession, sums: DataFrame, grain: int, targets: Mapping | DataFrame | None) -> DataFrame:
    """(queue, rate, late, phase): grain *u* of a queue falls due at ``late + (u + phase) / rate``."""
    queues = sums.groupBy("queue").agg(F.ceil(F.sum("total") / grain).alias("grains"))
    phase = (F.pmod(F.xxhash64("queue", F.lit(41)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    own = F.col("grains").cast("double")
    if targets is None:
        return queues.select("queue", own.alias("rate"), F.lit(0.0).alias("late"), phase.alias("phase"))
    if isinstance(targets, Mapping):
        targets = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
    named = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("queue"), F.col("weight").cast("double"))
    queues = queues.join(named.groupBy("queue").agg(F.sum("weight").alias("weight")), "queue", "left")
    queues = queues.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    end = queues.agg(F.max(F.col("grains") / F.col("weight"))).first()[0] or 0.0
    # Those without a target take as long again, after all others.
    rate, late = F.coalesce("weight", own / (end or 1.0)), F.when(F.col("weight").isNull(), F.lit(end)).otherwise(0.0)
    return queues.select("queue", rate.alias("rate"), late.alias("late"), phase.alias("phase"))


def _due_so_far(sums: DataFrame, queues: DataFrame, grain: int) -> tuple[list[float], list[float]]:
    """Times and the tokens due until then, at most ``KNOTS`` of them."""
    every = sums.groupBy("queue").agg(F.sum("total").alias("tokens")).join(queues, "queue")
    dry = F.col("tokens") / grain / F.col("rate")
    span = every.agg(F.min(dry).alias("first"), F.max(F.col("late") + dry).alias("last"), F.sum("tokens").alias("tokens")).first()
    first, last = max(span["first"] / 1000, span["last"] / 1e12), span["last"]
    times = [0.0, *np.geomspace(first, max(last, first * 2), KNOTS).tolist()]
    at = every.withColumn("t", F.explode(F.array(*[F.lit(t) for t in times])))
    given = F.greatest(F.lit(0.0), F.least(F.col("tokens"), (F.col("t") - F.col("late")) * F.col("rate") * grain))
    rows = {r["t"]: r["x"] for r in at.groupBy("t").agg(F.sum(given).alias("x")).collect()}
    return times, np.maximum.accumulate([rows[t] for t in times]).tolist()


def _grains(at: np.ndarray, n: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, grain) of every grain that the ids ``at`` to ``at + n`` of their queues touch."""
    first = at // grain
    times = (at + n - 1) // grain - first + 1
    row = np.repeat(np.arange(len(at)), times)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def _cut(at, n, rate, late, phase, grain: int, blocks: int, knots) -> tuple[np.ndarray, ...]:
    """(row, block, first id, end) of each run of ids, as places in their queues, that falls in one block."""
    row, unit = _grains(at, n, grain)
    due = late[row] + (unit + phase[row]) / rate[row]
    times, given = knots
    block = np.minimum((np.interp(due, times, given) / given[-1] * blocks).astype(np.int64), blocks - 1)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])))
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(row)) - 1
    owner = row[lo]
    return owner, block[lo], np.maximum(at[owner], unit[lo] * grain), np.minimum((at + n)[owner], (unit[hi] + 1) * grain)


def _windows(at, n, queue, rate, late, phase, base: int, grain: int, length: int) -> tuple[np.ndarray, ...]:
    """(row, first id, number, window, offset) of the pieces of one block, in order."""
    row, unit = _grains(at, n, grain)
    lo, hi = np.maximum(at[row], unit * grain), np.minimum((at + n)[row], (unit + 1) * grain)
    due = late[row] + (unit + phase[row]) / rate[row]
    order = np.lexsort((lo, queue[row], due))
    row, lo, size = row[order], lo[order], (hi - lo)[order]
    place = base + np.cumsum(size) - size
    window = place // length
    room = (window + 1) * length - place  # a grain is no longer than a window: it is cut once at most
    over = np.flatnonzero(size > room)
    row, lo = np.append(row, row[over]), np.append(lo, lo[over] + room[over])
    window, size = np.append(window, window[over] + 1), np.append(np.minimum(size, room), size[over] - room[over])
    order = np.lexsort((lo, queue[row], window))
    row, lo, size, window = row[order], lo[order], size[order], window[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (lo[1:] != lo[:-1] + size[:-1])))
    first = np.flatnonzero(new)
    size = np.add.reduceat(size, first)
    row, lo, window = row[first], lo[first], window[first]
    return row, lo, size, window, base + np.cumsum(size) - size - window * length


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2", offset=1) if len(blob) % 2 else np.frombuffer(blob, "<u4")


def pack(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer_path: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    text: str = "text",
    source: str = "source",
    digests: bool = False,
    targets: Mapping | DataFrame | None = None,
    grain: int = GRAIN,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, 32 bits each), doc_tokens, sequence_id, offset, source.

    ``digests``: ids_crc32 instead of ids, so that the ids don't leave the tasks.  ``targets``: a
    weight for each source, as a mapping or a DataFrame (source, weight).
    """
    grain = max(1, min(grain, length))
    coded = written(_coded(docs, tokenizer_path, end_id, text, source), "packing-ids")
    sums = written(coded.groupBy("queue", "part").agg(F.sum("n").alias("total")), "packing-sums")
    queues = _queues(spark, sums, grain, targets)
    before = F.sum("total").over(Window.partitionBy("queue").orderBy("part")) - F.col("total")
    places = written(sums.withColumn("base", before).drop("total").join(queues, "queue"), "packing-places")
    total = sums.agg(F.sum("total")).first()[0] or 0
    knots = ([0.0, 1.0], [0.0, 1.0]) if targets is None or not total else _due_so_far(sums, queues, grain)
    blocks = max(1, -(-total // block_tokens))
    how = ("rate", "late", "phase")
    placed = coded.join(places, ["queue", "part"]).withColumn("at", F.col("base") + F.col("before"))

    def split(b, most=200_000):
        """The runs of a batch that fall in one block, some rows at a time."""
        at, n, rate, late, phase = (b.column(c).to_numpy() for c in ("at", "n", *how))
        ends = np.cumsum(n)
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most * grain, side="right")))
            s = slice(first, last)
            owner, block, lo, hi = _cut(at[s], n[s], rate[s], late[s], phase[s], grain, blocks, knots)
            yield owner + first, block, lo, hi
            first = last

    def weigh(batches):
        for b in batches:
            for _, block, lo, hi in split(b):
                which, where = np.unique(block, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.bincount(where, weights=hi - lo).astype(np.int64))], names=["block", "tokens"])

    weights = placed.select("at", "n", *how).mapInArrow(weigh, "block long, tokens long").groupBy("block").agg(F.sum("tokens").alias("tokens"))
    weights = written(weights.withColumn("many", F.floor(F.col("block") / GROUP)), "packing-blocks")
    # Prefix sums in two levels: over groups of blocks, of which there are few, then within a group.
    groups = weights.groupBy("many").agg(F.sum("tokens").alias("own"))
    groups = groups.select("many", (F.sum("own").over(Window.orderBy("many")) - F.col("own")).alias("low"))
    inner = F.sum("tokens").over(Window.partitionBy("many").orderBy("block")) - F.col("tokens")
    bases = weights.withColumn("inner", inner).join(groups, "many").select("block", (F.col("low") + F.col("inner")).alias("base"))

    def deal(batches):
        for b in batches:
            at, blobs = b.column("at").to_numpy(), b.column("ids").to_pylist()
            for owner, block, lo, hi in split(b):
                cut = []
                for i, a, z, x in zip(owner.tolist(), (lo - at[owner]).tolist(), (hi - at[owner]).tolist(), (blobs[i] for i in owner.tolist())):
                    ids = _ids(x)
                    cut.append(x if z - a == len(ids) else (b"\0" if len(x) % 2 else b"") + ids[a:z].tobytes())
                columns = [b.column(c).take(pa.array(owner)) for c in ("doc_id", "queue", "n", *how)]
                more = [pa.array(block), pa.array(lo - at[owner]), pa.array(lo), pa.array(hi - lo), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *more], names=["doc_id", "queue", "n", *how, "block", "start", "at", "size", "ids"])

    dealt = "doc_id long, queue string, n long, rate double, late double, phase double, block long, start long, at long, size long, ids binary"
    parts = placed.select("doc_id", "queue", "n", "at", "ids", *how).mapInArrow(deal, dealt).join(bases, "block")
    kept = pa.field("ids_crc32", pa.int64()) if digests else pa.field("ids", pa.binary())
    numbers = [pa.field(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema([*numbers, kept, pa.field("source", pa.string())])

    def fill(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        at, n, rate, late, phase = (part[c].to_numpy() for c in ("at", "size", *how))
        names = part["queue"].to_pylist()
        number = {q: i for i, q in enumerate(sorted(set(names)))}
        queue = np.fromiter((number[q] for q in names), np.int64, len(names))
        row, lo, size, window, offset = _windows(at, n, queue, rate, late, phase, part["base"][0].as_py(), grain, length)
        ids = memoryview(np.concatenate([_ids(x) for x in part["ids"].to_pylist()]).astype("<u4")).cast("B")
        first = 4 * ((np.cumsum(n) - n)[row] + lo - at[row])
        cut = zip(first.tolist(), (first + 4 * size).tolist())
        made = [zlib.crc32(ids[a:b]) for a, b in cut] if digests else [bytes(ids[a:b]) for a, b in cut]
        start = part["start"].to_numpy()[row] + lo - at[row]
        source_of = [q[1:] if q else None for q in names]
        columns = [part["doc_id"].take(pa.array(row)), start, size, part["n"].take(pa.array(row)), window, offset, pa.array(made, kept.type), pa.array(source_of, pa.string()).take(pa.array(row))]
        return pa.table(columns, schema=schema)

    out = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long'}" for f in schema)
    return parts.groupBy("block").applyInArrow(fill, out)
