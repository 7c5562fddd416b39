"""Best-fit packing of token pieces into sequences by exact complements of lengths."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.llm._tables import kept
from sigtables.llm._text import column

#: Runs of white space that tiktoken's pattern matcher has no stack for (it fails at some hundred thousands).
LONG_SPACE = re.compile(r"\s{10000}")


class ByteBpe:
    """Ids of the byte-level BPE with 50,257 pieces as little-endian 32-bit bytes.

    The ids are those that tokenizers gives with json_path and add_special_tokens=False. tiktoken, with the same vocabulary
    as ranks, encodes all texts but those with very long runs of white space; the tests hold the two against each other. An
    added token of the file that a text spells out is that token's one id, unless `spelled` says that it is ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, json_path: str, spelled: bool = False):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            added = {} if spelled else {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.json_path, self.spelled, self.slow = json_path, spelled, None

    def ids(self, text: str) -> bytes:
        if len(text) >= 10_000 and LONG_SPACE.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
                self.slow.encode_special_tokens = self.spelled
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.added and self.added.search(text):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


def token_pieces(docs: DataFrame, ranks_path: str, pattern: str, json_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces: its ids, then end_id.

    A document of more than `capacity` ids is cut into pieces of that many, the first of which holds the remainder. A
    null or empty text has the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBpe(ranks_path, pattern, json_path), end_id.to_bytes(4, "little")
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch, rows, made = whole.slice(lo, 500), [], {}
                for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                    if (pieces := made.get(text)) is None:  # equal texts of a slice are encoded once
                        raw = bpe.ids(text or "") + end
                        n = len(raw) // 4
                        at = [0, *range(n % capacity or capacity, n, capacity), n]
                        pieces = made[text] = [(k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
                    rows += [(doc, *p) for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of each kind of sequence, for so many pieces of each length.

    Longest first. The gap of a sequence is filled by one, two or three lengths that sum to it exactly, as often as
    their counts allow; only where no combination is exact, by the longest length that fits. A step uses up a length or
    the exact combination, so there are about as many kinds as lengths. counts has `capacity` entries at most.
    """
    left, out = Counter({n: c for n, c in counts.items() if c > 0}), []

    def often(lengths: list[int]) -> int:
        return min(left[n] // k for n, k in Counter(lengths).items())

    def exact(gap: int, held: list[int]) -> list[int] | None:
        have = sorted((n for n in left if n <= gap and often([*held, n])), reverse=True)
        if gap in have:
            return [gap]
        known = set(have)
        for a in have:
            if gap - a <= a and gap - a in known and often([*held, a, gap - a]):
                return [a, gap - a]
        for a in have:
            if 3 * a < gap:
                break
            rest = gap - a
            for b in have:
                if b <= a and rest - b <= b and rest - b in known:
                    if often([*held, a, b, rest - b]):
                        return [a, b, rest - b]
                elif 2 * b < rest:
                    break
        return None

    while left:
        held = [max(left)]
        while gap := capacity - sum(held):
            if found := exact(gap, held):
                held += found
                break
            fits = [n for n in left if n <= gap and often([*held, n])]
            if not fits:
                break
            held.append(max(fits))
        times = often(held)
        out.append((times, held))
        for n, k in Counter(held).items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def pack(items: DataFrame, length: str = "length", capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to items whose length is 1 to `capacity`.

    Only how many items have each length, `capacity` numbers at most, reaches the driver; it plans kinds of sequences
    over those. Each item then finds its place from its number among the items of its length, by a search in the few
    places that the plan has. Repeated rows are items of their own; an empty table stays empty; a null or other length is an
    error. Columns of items named sequence_id or offset are replaced, all others stay as they are.
    """
    names = [f"`{c}`" for c in items.columns if c not in ("sequence_id", "offset")]
    parts = max(1, items.count() // 100_000) * 4
    keys = [f"k{i}" for i in range(len(order))]
    rows = items.select(F.struct(*names).alias("row"), F.col(f"`{length}`").cast("long").alias("length"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)], F.pmod(F.xxhash64(*[f"`{c}`" for c in order]), F.lit(parts)).alias("part"))
    sizes = rows.groupBy("length", "part").count()
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"{length}: 1 to {capacity}")
    # A third of all items may have one length, so a length is numbered in parts.
    before = sizes.select("length", "part", (F.sum("count").over(W.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    at = F.row_number().over(W.partitionBy("length", "part").orderBy(*keys)) - 1
    rows = rows.withColumn("at", at).join(before, ["length", "part"]).select("row", "length", (F.col("before") + F.col("at")).alias("nth"))
    used, sequence, places = Counter(), 0, []
    for times, lengths in plan(counts, capacity):
        at = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            places.append((n, used[n], k, sequence, at))
            used[n] += times * k
            at += n * k
        sequence += times
    # A few entries for each kind of sequence, so some thousands whatever the number of items.
    of, first, each, begin, offset = (np.array(c, np.int64) for c in zip(*sorted(places), strict=True)) if places else (np.zeros(0, np.int64),) * 5
    # one number a place, rising with length and number, so that one search serves all lengths
    base = np.concatenate([[0], np.cumsum([counts.get(n, 0) for n in range(1, capacity + 1)])])
    start = base[of - 1] + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nth = (batch.column(i).to_numpy() for i in (1, 2))
            k = np.searchsorted(start, base[n - 1] + nth, side="right") - 1
            inside = nth - first[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begin[k] + inside // each[k]), pa.array(offset[k] + inside % each[k] * n)], ["row", "sequence_id", "offset"])

    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, json_path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents (see token_pieces) with sequence_id and offset (see pack).

    The pieces, some 40 bytes each, are written once. Null texts are empty; null and repeated ids are ids like others; an empty
    table gives none.
    """
    return pack(kept(token_pieces(docs, ranks_path, pattern, json_path, capacity)), capacity=capacity)
