"""Codes of vectors: one of a few entries for each part of a vector, by exact integer products of float64 matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.llm._tables import kept

#: Steps of a unit, parts of a vector, entries of a part's codebook and rounds of moving them.
STEPS, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Components from here on count as not finite, as 32-bit floats have it.
LARGEST = 2.0**128
#: Vectors that are compared at once.
BLOCK = 1024
#: Sums leave a task in limbs of so many bits.
LIMB = 48


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """x as float64 limbs of `bits` bits, lowest first; the last keeps the sign."""
    low = np.int64((1 << bits) - 1)
    return [((x >> np.int64(bits * k)) & low if k < count - 1 else x >> np.int64(bits * k)).astype(np.float64) for k in range(count)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact dot products of x (parts, rows, width) and y (parts, entries, width), as (parts, rows, entries).

    Both are cut into limbs so short that a float64 product of two limbs, summed over the width, stays below 2**53; these
    are put together in int64. Where int64 can't hold the result, Python's integers are multiplied.
    """
    width = x.shape[2]
    if x.dtype == object or y.dtype == object:
        return np.matmul(x.astype(object), y.astype(object).transpose(0, 2, 1)) if width else np.zeros((*x.shape[:2], y.shape[1]), object)
    bits = (52 - max(1, width).bit_length()) // 2
    need = [max(1, -(-(int(np.abs(v).max(initial=0)).bit_length() + 1) // bits)) for v in (x, y)]
    out = np.zeros((*x.shape[:2], y.shape[1]), np.int64)
    right = limbs(y.transpose(0, 2, 1), bits, need[1])
    for i, a in enumerate(limbs(x, bits, need[0])):
        for j, b in enumerate(right):
            out += np.matmul(a, b).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, rows): the first nearest entry of each part of each row, and the squared distance to it."""
    if x.shape[2] and max(int(np.abs(v).max(initial=0)) for v in (x, books)) ** 2 * 4 * x.shape[2] >= 1 << 62:
        x, books = x.astype(object), books.astype(object)
    own, theirs = (x * x).sum(axis=2), (books * books).sum(axis=2)
    far = theirs[:, None, :] - 2 * products(x, books)
    best = far.argmin(axis=2)
    return best, own + np.take_along_axis(far, best[:, :, None], axis=2)[:, :, 0]


def integers(vectors: pa.Array, length: int, steps: int = STEPS) -> np.ndarray:
    """floor(steps * x) of each component, a row a vector, with zeros up to `length`; Python's integers if any is beyond int64's half."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64) * steps)
    large = bool(len(flat)) and np.abs(flat).max() >= 2.0**62
    out = np.zeros((len(sizes), length), object if large else np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = [int(v) for v in flat] if large else flat.astype(np.int64)
    return out


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and has finite components only."""
    return vectors.where(F.col(f"`{vector}`").isNotNull() & F.forall(f"`{vector}`", lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False))))


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", steps: int = STEPS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integers, int64 or Python's.

    They begin as the parts of the vectors with the `entries` least ids (null as the largest, equal ids by what they hold);
    fewer vectors make fewer entries. In each round every part of every vector goes to its nearest entry, the first of equal
    ones, and an entry becomes floor(sum / count) of its parts; one without any stays. Sums are exact: a task adds its own
    and sends them in limbs, one row for each component of a codebook, and only their totals reach the driver.
    """
    rows = whole(vectors, vector).select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 0), np.int64)
    width = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).toArrow().column("v").combine_chunks()
    books = integers(first, parts * width, steps).reshape(-1, parts, width).transpose(1, 0, 2)
    n = books.shape[1]

    def added(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, n, width), object), np.zeros((parts, n), np.int64)
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    x = integers(batch.column(0).slice(lo, BLOCK), parts * width, steps).reshape(-1, parts, width).transpose(1, 0, 2)
                    best, _ = nearest(x, books)
                    for p in range(parts):
                        count[p] += np.bincount(best[p], minlength=n)
                        order = np.argsort(best[p], kind="stable")
                        has, at = np.unique(best[p][order], return_index=True)
                        if width:
                            # a block's sums of int64 below 2**50 fit; larger components are added as Python's integers
                            small = x.dtype != object and int(np.abs(x[p]).max(initial=0)) < 1 << 50
                            total[p, has] += np.add.reduceat(x[p][order] if small else x[p][order].astype(object), at, axis=0).astype(object)
            slot = np.flatnonzero(np.repeat(count.ravel() > 0, width))
            sums = [total.reshape(-1)[i] for i in slot.tolist()]
            low = (1 << LIMB) - 1
            cut = [[s & low for s in sums], [(s >> LIMB) & low for s in sums], [s >> 2 * LIMB for s in sums], count.ravel()[slot // max(1, width)]]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *(pa.array(c, pa.int64()) for c in cut)], ["slot", "a", "b", "c", "n"])

        return run

    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(added(books), "slot int, a long, b long, c long, n long").groupBy("slot").agg(*(F.sum(x).alias(x) for x in "abcn")).collect()
        moved = books.astype(object).ravel()
        for slot, a, b, c, times in sums:
            moved[slot] = (a + (b << LIMB) + (c << 2 * LIMB)) // times
        moved = moved.reshape(books.shape)
        books = moved.astype(np.int64) if all(abs(v) < 1 << 62 for v in moved.ravel().tolist()) else moved
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all integers in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vector: str = "embedding", steps: int = STEPS) -> DataFrame:
    """The rows with a whole vector, with code (two hex digits a part) and error, the squared distances to the entries added up.

    Vectors shorter than the codebooks' count as if zeros followed, longer ones are an error; an error beyond a long is null.
    Columns of vectors of these names are replaced, all others stay.
    """
    parts, _, width = books.shape
    names = [f"`{c}`" for c in vectors.columns if c not in ("code", "error")]
    rows = whole(vectors, vector).select(F.struct(*names).alias("row"), F.col(f"`{vector}`").alias("v"))
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                best, far = nearest(integers(part.column(1), parts * width, steps).reshape(-1, parts, width).transpose(1, 0, 2), books)
                codes = ["".join(x) for x in digits[best.T].tolist()]
                error = [e if e < 1 << 63 else None for e in far.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["row", "code", "error"])

    schema = T.StructType([rows.schema["row"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema).select("row.*", "code", "error")


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", steps: int = STEPS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The rows of vectors with a whole vector, with code, error, label_error and codebooks_sha256 (see fit and encode).

    Rows whose vector is null or holds a null or a component that isn't finite go; an empty vector is one of zeros. All
    vectors are as long as the longest, rounded up to equal parts, with zeros at their ends. Repeated rows stay, each with
    its own code; an empty table stays empty. label_error adds up the errors of a label, null being one (null where they are
    or the sum is beyond a long). The codebooks,
    `entries` (256 at most) times the vector's length, are all that tasks are sent.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    books = fit(vectors, id, vector, steps, parts, entries, rounds)
    out = vectors.drop("label_error", "codebooks_sha256")
    coded = kept(encode(out, books, vector, steps))
    key = "label_" + "_".join(coded.columns)  # no column has this name
    each = coded.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum(F.col("error").cast("decimal(19,0)")).alias("label_error"))
    joined = coded.join(each, F.col(f"`{label}`").eqNullSafe(F.col(f"`{key}`")))
    return joined.select(*[f"`{c}`" for c in coded.columns], F.when(F.col("label_error") <= 2**63 - 1, F.col("label_error")).cast("long").alias("label_error"), F.lit(fingerprint(books)).alias("codebooks_sha256"))


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector that stays."""
    return compress(vectors.select("vec_id", "embedding", "label")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


#: digest() over the table embeddings, as SQL. Vectors are taken to be of equal length.
ORACLE_SQL = """
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT row_id, (u.i - 1) // (len(embedding) // 16) AS part, (u.i - 1) % (len(embedding) // 16) AS pos, CAST(floor(256 * CAST(embedding[u.i] AS DOUBLE)) AS BIGINT) AS x
  FROM whole, unnest(range(1, len(embedding) + 1)) AS u(i)
), b0 AS (
  SELECT part, row_id - 1 AS entry, pos, x AS c FROM v WHERE row_id <= 64
), d0 AS (
  SELECT row_id, part, entry, sum((x - c) * (x - c)) AS far FROM v JOIN b0 USING (part, pos) GROUP BY row_id, part, entry
), a0 AS (
  SELECT row_id, part, arg_min(entry, far * 256 + entry) AS entry FROM d0 GROUP BY row_id, part
), m0 AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a0 USING (row_id, part) GROUP BY part, entry, pos
), b1 AS (
  SELECT part, entry, pos, CASE WHEN s IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b0 LEFT JOIN m0 USING (part, entry, pos)
), d1 AS (
  SELECT row_id, part, entry, sum((x - c) * (x - c)) AS far FROM v JOIN b1 USING (part, pos) GROUP BY row_id, part, entry
), a1 AS (
  SELECT row_id, part, arg_min(entry, far * 256 + entry) AS entry FROM d1 GROUP BY row_id, part
), m1 AS (
  SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM v JOIN a1 USING (row_id, part) GROUP BY part, entry, pos
), b2 AS (
  SELECT part, entry, pos, CASE WHEN s IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c FROM b1 LEFT JOIN m1 USING (part, entry, pos)
), d2 AS (
  SELECT row_id, part, entry, sum((x - c) * (x - c)) AS far FROM v JOIN b2 USING (part, pos) GROUP BY row_id, part, entry
), a2 AS (
  SELECT row_id, part, arg_min(entry, far * 256 + entry) AS entry, min(far) AS far FROM d2 GROUP BY row_id, part
), coded AS (
  SELECT row_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY row_id
), hash AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN whole USING (row_id), hash
"""
