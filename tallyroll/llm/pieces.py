"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Text is cut in marked words (a space mark and what follows it).  The distinct new words of a
part of an Arrow batch are sorted, which is the depth-first order of their trie, and searched in
that order: the forward scores (best score and last piece at each character) of the prefix that a
word has in common with the one before it stay on the stack, only the rest is searched.

The best path is that of the **unigram** model over the pieces and scores of the model's file: the
highest sum of scores; of equal sums the longer last piece.  For a file of another model type (BPE)
these are not the ids that the library's own search gives.  A character without a piece costs
the least score less 10 and is written as byte pieces.  Sums are taken per word, which is exact
because no piece spans a space after another character (checked when the model is loaded).
From each place the search goes back only as long as some piece ends so.

Decoding joins the pieces, byte pieces as raw bytes, and drops the first mark.  A literal space
mark in a text comes back as a space.

Nulls and empty texts have no pieces.  Long words are searched whole but not remembered.
Repeated rows give repeated results, empty tables empty ones; other columns do not matter.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_COST = 10.0
MEMO_WORDS = 200_000
MEMO_LENGTH = 48
PART_CHARS = 1_000_000


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece spans words")
        self.ends = {p[k:]: (-1, float("-inf")) for p in self.pieces for k in range(len(p))} | self.pieces
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_COST
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        self.raw = [b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.raw[self.unknown_id] = " ⁇ ".encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.memo: dict[str, bytes] = {}

    def spell(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown_id]
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def search(self, words: list[str]) -> list[list[int]]:
        """The ids of each of ``words``, which are sorted: one walk through their trie."""
        ends, pieces, unknown = self.ends.get, self.pieces, self.unknown
        best, last = [0.0], [(0, 0)]  # at each place: the best score, and (start, id) of its last piece
        before, out = "", []
        for word in words:
            n, keep = len(word), 0
            top = min(n, len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], last[keep + 1 :]
            for end in range(keep + 1, n + 1):
                score, step = float("-inf"), (end - 1, -1)
                for start in range(end - 1, -1, -1):
                    hit = ends(word[start:end])
                    if hit is None:
                        break
                    s = best[start] + hit[1]
                    if s >= score and hit[0] >= 0:
                        score, step = s, (start, hit[0])
                if word[end - 1] not in pieces and best[end - 1] + unknown > score:
                    score, step = best[end - 1] + unknown, (end - 1, -1)
                best.append(score)
                last.append(step)
            ids, end = [], n
            while end:
                start, i = last[end]
                if i >= 0:
                    ids.append(i)
                else:
                    ids += reversed(self.spell(word[start]))
                end = start
            out.append(ids[::-1])
            before = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size >= PART_CHARS or i == len(texts) - 1:
                out += self._part(part)
                part, size = [], 0
        return out

    def _part(self, texts: list[str]) -> list[bytes]:
        words = [SEGMENT.findall((MARK + x).replace(" ", MARK)) if x else [] for x in texts]
        memo = self.memo
        new = sorted({w for ws in words for w in ws if w not in memo})
        fresh = {w: struct.pack(f"<{len(ids)}I", *ids) for w, ids in zip(new, self.search(new))}
        if len(memo) < MEMO_WORDS:
            memo.update((w, ids) for w, ids in fresh.items() if len(w) <= MEMO_LENGTH)
        return [b"".join([memo[w] if w in memo else fresh[w] for w in ws]) for ws in words]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(batch: pa.RecordBatch, text: str):
    """The rows of a batch, about ``PART_CHARS`` bytes of text at a time."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text)])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PART_CHARS)))
        yield batch.slice(first, last - first)
        first = last


def encode(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ids (binary, 32 bits each) and n_pieces; clashing columns are replaced.

    ``decoded``: and with the column decoded, the text of the ids, in the same pass.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("ids", "n_pieces", *(["decoded"] if decoded else []))]
    schema = T.StructType([*keep, T.StructField("ids", T.BinaryType()), T.StructField("n_pieces", T.LongType()), *([T.StructField("decoded", T.StringType())] if decoded else [])])

    def apply(batches):
        v = vocabulary(model_path)
        for batch in batches:
            for b in _slices(batch, text):
                ids = v.encode([x or "" for x in b.column(text).to_pylist()])
                columns = [*b.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array(map(v.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(apply, schema)


def decode(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the column decoded: the text of its ids."""
    keep = [f for f in coded.schema.fields if f.name != "decoded"]
    schema = T.StructType([*keep, T.StructField("decoded", T.StringType())])

    def apply(batches):
        v = vocabulary(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.decode(x or b"") for x in b.column(ids).to_pylist()], pa.string())], names=[*b.schema.names, "decoded"])

    return coded.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(apply, schema)
