"""Asking all documents about keys: chunks of documents send their distinct keys, parts of the key space answer.

Documents are dealt to chunks of a few MB by a hash of their id. A chunk sends each of its keys once, however many of its
documents have it, so a part gets a key from each chunk at most and no group of copies is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null id counts as larger than any other.
LAST = np.iinfo(np.int64).max


def by_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """doc, doc_id, text and chunk, to be grouped by chunk; the same shuffle serves every later use in a job.

    doc holds all other columns, whatever they are called. Texts of one id, or of none, are dealt to all chunks.
    """
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    own = F.struct(*others) if others else F.lit(None).cast("boolean")
    return docs.select(own.alias("doc"), "doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))


def answered(docs: DataFrame, result: DataFrame, names: list[str]) -> DataFrame:
    """The columns of docs and then those of `names`, from rows of by_chunk() with these added."""
    return result.select(*[f"`{c}`" if c in ("doc_id", "text") else F.col("doc").getField(c).alias(c) for c in docs.columns], *names)


def ids(table: pa.Table, name: str = "doc_id") -> np.ndarray:
    return np.array([LAST if x is None else x for x in table.column(name).to_pylist()], np.int64)


def texts(table: pa.Table, name: str = "text") -> list[bytes]:
    return [x or b"" for x in table.column(name).cast(pa.binary()).to_pylist()]


def numbers(blob: bytes, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(blob, kind)


def joined(table: pa.Table, name: str, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def table_of(schema: pa.Schema, rows: Iterable[tuple]) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def dealt(route: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterable[tuple[int, list[np.ndarray]]]:
    """(part, its rows of the columns), for the parts that get any; none if there are no rows."""
    if not len(route):
        return
    part = (route % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(part[order[a]]), [c[order[a:b]] for c in columns]


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array known."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def same_least(first: np.ndarray, second: np.ndarray, docs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct pair of keys, its least doc and whether it is in several docs or any of its rows is `often`."""
    order = np.lexsort((second, first))
    a, b, d = first[order], second[order], docs[order]
    edge = np.ones(len(a), bool)
    edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(edge)
    if not len(at):
        return a, b, d, often
    least = np.minimum.reduceat(d, at)
    return a[at], b[at], least, (np.maximum.reduceat(d, at) > least) | np.maximum.reduceat(often[order], at)


def same_before(first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row the least doc of the rows with its pair of keys."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    edge = np.ones(len(a), bool)
    edge[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(docs), np.int64)
    if len(a):
        out[order] = np.repeat(np.minimum.reduceat(docs[order], np.flatnonzero(edge)), np.diff([*np.flatnonzero(edge), len(a)]))
    return out


KEYS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("often", pa.binary())])
REPEATED = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())])
LOW = np.uint64((1 << 32) - 1)


def coded(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key above the 32 bits that are sent of it.

    Parts are as many as the input is large, so the few keys of a part that these bits confuse don't become more; they
    are only looked at in vain.
    """
    return ((keys % np.uint64(parts)) << np.uint64(32)) | ((keys // np.uint64(parts)) & LOW)


def send_keys(chunk: int, found: np.ndarray, parts: int) -> pa.Table:
    """The distinct keys of a chunk, and those of them that it has more than once."""
    keys, times = np.unique(coded(found, parts), return_counts=True)
    return table_of(KEYS, ((part, chunk, k.tobytes(), k[t > 1].tobytes()) for part, (k, t) in dealt(keys >> np.uint64(32), parts, [keys.astype(np.uint32), times])))


def known(answers: pa.Table) -> np.ndarray:
    """The codes of the keys in answers of repeated(), sorted."""
    rows = zip(answers.column("part").to_pylist(), answers.column("keys").to_pylist(), strict=True)
    return np.sort(np.concatenate([numbers(k, "<u4").astype(np.uint64) | (np.uint64(part) << np.uint64(32)) for part, k in rows]))


def repeated(sent: DataFrame) -> DataFrame:
    """chunk, part and keys: of the keys that each chunk sent, those that stand at more than one place in all chunks."""

    def answer(table: pa.Table) -> pa.Table:
        keys, times = np.unique(np.concatenate([joined(table, "keys", "<u4"), joined(table, "often", "<u4")]), return_counts=True)
        keys = keys[times > 1]
        rows = ((c, p, (x := numbers(k, "<u4"))[among(x, keys)].tobytes()) for c, p, k in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), table.column("keys").to_pylist(), strict=True))
        return table_of(REPEATED, (r for r in rows if r[2]))

    return sent.groupBy("part").applyInArrow(answer, "chunk int, part int, keys binary")


def with_answers(chunked: DataFrame, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """run(documents of a chunk, its answers); chunks without documents have no answers."""
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
