"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point; other
characters count as one blank.  An n-gram is bound by multiplying its letters' vectors, each
permuted (rolled) by its distance from the end.  A text is the sum of its n-grams' vectors, a
language's prototype the sum over the texts labelled with it, and a text gets the language
whose prototype is nearest by cosine.

Training is linear in the n-grams, so the tasks send one count per language and n-gram, not
vectors; the counts are summed in Spark and bundled afterwards.  The prototypes (languages x
``dims`` numbers; the labels are a fixed small set) are all that reaches the driver.

Within a text the sum over n-grams is a small matrix product: the vectors of a text's last
letters, weighted by counts, times the bound vectors of its letter pairs, a block of pairs at a
time, so that a long text of many letters needs no more memory than another.

Nulls: a null text, or one without a letter, gets ``und`` and score 0; rows without a label teach
nothing.  With nothing to learn from, every text gets ``und``.  Texts of any length are read whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 1024
UNKNOWN = "und"
SEED = 20_251
BITS = 21  # of a code point
#: Letter pairs that are bundled at once, and letters whose vectors are kept: they bound a task's memory.
BLOCK = 512
MAX_LETTERS = 16_384
#: Texts that are read at once.
ROWS = 1000


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter trigrams of a text, packed in 63 bits, and their counts; empty if it has no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    is_letter = _letters()[x]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.where(is_letter, x, 0)
    x = np.concatenate(([0], x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))], [0]))
    if x[1] == 0:
        x = x[1:]
    if x[-2] == 0:
        x = x[:-1]
    return np.unique((x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:], return_counts=True)


class Profiles:
    """Letter vectors, made as they are met; at most ``MAX_LETTERS`` are kept."""

    def __init__(self, dims: int = DIMS, seed: int = SEED):
        self.dims, self.seed = dims, seed
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.tables = [np.zeros((256, self.dims), np.int8) for _ in range(3)]  # permuted 0, 1 and 2 times

    def vectors(self, codes: np.ndarray, roll: int = 0) -> np.ndarray:
        """The vectors of distinct letters, permuted ``roll`` (up to 2) times."""
        missing = [c for c in codes.tolist() if c not in self.row]
        if missing and len(self.row) + len(missing) > MAX_LETTERS:
            self.forget()
            missing = codes.tolist()
        for c in missing:
            if len(self.row) == len(self.tables[0]):
                self.tables = [np.concatenate((t, np.zeros_like(t))) for t in self.tables]
            vector = np.random.default_rng([self.seed, c]).integers(0, 2, self.dims) * 2 - 1
            for times, table in enumerate(self.tables):
                table[len(self.row)] = np.roll(vector, times)
            self.row[c] = len(self.row)
        return self.tables[roll][[self.row[c] for c in codes.tolist()]].astype(np.float32)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the bound vectors of n-grams (sorted keys) times their counts, ``BLOCK`` letter pairs at a time."""
        pair = keys >> BITS
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        out = np.zeros(self.dims)
        for k in range(0, len(first), BLOCK):
            end = first[k + BLOCK] if k + BLOCK < len(first) else len(keys)
            for lo in range(first[k], end, 8 * BLOCK):
                s = slice(lo, min(end, lo + 8 * BLOCK))
                out += self._bundle(keys[s], counts[s])
        return out

    def _bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        mask = (1 << BITS) - 1
        pair = keys >> BITS
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        pairs = pair[new]
        ends, end_at = np.unique(keys & mask, return_inverse=True)
        # Whole numbers: exact in single precision up to 2 ** 24, beyond it in double.
        weights = np.zeros((len(pairs), len(ends)), np.float32 if counts.sum() < 2**24 else np.float64)
        weights[np.cumsum(new) - 1, end_at] = counts
        firsts, first_at = np.unique(pairs >> BITS, return_inverse=True)
        middles, middle_at = np.unique(pairs & mask, return_inverse=True)
        # Whole numbers no larger than the sum of the counts, in any order, so the sums are exact in the precision of the weights.
        bound = self.vectors(firsts, 2)[first_at]
        bound *= self.vectors(middles, 1)[middle_at]
        return np.einsum("pd,pd->d", bound, weights @ self.vectors(ends)).astype(np.float64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from every row with a text and a label."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        total: dict[str, dict] = {}
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            by: dict[str, list] = {}
            for lg, tx in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lg, []).append(grams(tx))
            for lg, got in by.items():
                keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(keys)).astype(np.int64)
                mine = total.setdefault(lg, {})
                for k, c in zip(keys.tolist(), n.tolist()):
                    mine[k] = mine.get(k, 0) + c
        for lg, mine in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lg] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches):
        profiles, sums = Profiles(dims), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            keys, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for lg in set(langs.tolist()):
                mine = langs == lg
                order = np.argsort(keys[mine])
                sums[lg] = sums.get(lg, 0) + profiles.bundle(keys[mine][order], n[mine][order].astype(np.float64))
        for lg, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lg]), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = counted.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    total: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():  # languages x dims numbers
        total.setdefault(r["lang"], np.zeros(dims))[r["at"]] = r["x"]
    return {lg: v / norm for lg, v in sorted(total.items()) if (norm := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, from 0 to 1); clashing columns are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = list(prototypes)
    dims = len(prototypes[names[0]]) if names else DIMS
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, dims))

    def apply(batches):
        profiles = Profiles(dims)
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            langs, scores = [], []
            for tx in batch.column(text).to_pylist():
                keys, n = grams(tx or "")
                if not len(keys) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                v = profiles.bundle(keys, n)
                cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
                best = int(cos.argmax())
                langs.append(names[best])
                scores.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=None, names=[*batch.schema.names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(apply, schema)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    def apply(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, x or "")) for x in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """One in four documents, by their id: never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
