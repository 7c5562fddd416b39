"""Benchmark passages in documents, found in a latent space of TF-IDF passages and verified word by word."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtables.llm._tables import kept, pieces
from sigtables.llm._text import Words, blocks, column

#: Hashed words, rank of the latent space and extra directions of the random range.
DIMENSIONS, RANK, EXTRA = 1 << 15, 96, 16
#: Dimensions in a block of partial sums, passages in a step of them, and dimensions that a step multiplies densely.
BLOCK, STEP, COMMON = 1 << 10, 1 << 10, 1 << 10
#: A passage is two neighbouring halves of so many words.
HALF = 32
#: Passages whose sums one task adds up, about, and how many tasks' sums are added in one step.
FIT_PASSAGES, FAN = 125_000, 64
#: Passages of items that one block of the search holds on average at most; more are searched in more blocks.
ITEMS_PER_BLOCK = 8_000
COSINE, OVERLAP, ALIGNED, ANSWERED = 0.5, 0.6, 0.6, 0.5
#: Words at an item's end that stand for its answer.
ANSWER_WORDS = 8
#: ASCII letters in lower case and all other ASCII signs but digits as spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words(texts: list[str | None]) -> Words:
    """Words in lower case, parted by white space and ASCII punctuation."""
    return Words([(t or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN) for t in texts])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def halves(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each half passage: HALF words from each text's start on, the last may be shorter."""
    n = np.diff(w.first)
    per = -(-n // HALF)
    text = np.repeat(np.arange(len(n)), per)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return w.first[:-1][text] + inner * HALF, text


def places(w: Words) -> np.ndarray:
    return (w.hash & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def passages(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, last half, text) of each passage: neighbouring halves of a text, or its only half."""
    _, text = halves(w)
    k = np.arange(len(text))
    follows = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    alone = ~follows & ~np.append(False, follows[:-1]) if len(text) else follows
    first = k[follows | alone]
    return first, np.where(follows[first], first + 1, first), text[first]


def row_sums(table: np.ndarray, what: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of the rows of table that `what` names, `size` after `size` of them, a group at least; table's last row is 0.

    All groups get their first row at once, then their second and so on; groups have a few dozen.
    """
    n, most = len(size), int(size.max())
    at = np.full((most, n), len(table) - 1)
    at[np.arange(len(what)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(n), size)] = what
    out = np.take(table, at[0], axis=0)
    one = np.empty_like(out)
    for k in range(1, most):
        out += np.take(table, at[k], axis=0, out=one, mode="clip")
    return out


def passage_vectors(w: Words, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(latent vector of length 1, first word, text) of each passage. weighted: the vector of each dimension, and a 0."""
    start, _ = halves(w)
    first, last, text = passages(w)
    if not len(first):
        return np.zeros((0, weighted.shape[1]), np.float32), start[first], text
    per_half = row_sums(weighted, places(w), np.diff(start, append=len(w.hash)))
    vectors = per_half[first] + np.where((last > first)[:, None], per_half[last], 0)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), start[first], text


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def tile_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct dimensions each tile has, and all of them. Tiles are every second passage: they hold each word once."""
    n = np.diff(w.first)
    per = -(-n // (2 * HALF))
    inner = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    tile = np.repeat(np.cumsum(per) - per, n) + inner // (2 * HALF)
    key = np.unique(tile * DIMENSIONS + places(w))
    return np.bincount(key // DIMENSIONS, minlength=per.sum()), key % DIMENSIONS


def packed(texts: DataFrame) -> DataFrame:
    """The distinct dimensions of each tile, a row for each block of texts: how many each has, and all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            source = column(batch, "text")
            for lo, hi in blocks([t or "" for t in source], 1 << 18):
                sizes, what = tile_words(words(source[lo:hi]))
                if len(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.uint8), what.astype(np.uint16))], ["sizes", "places"])

    return texts.select("text").mapInArrow(run, "sizes binary, places binary")


def frequencies(packs: DataFrame) -> tuple[np.ndarray, int]:
    """Tiles that have a word of each dimension, and all tiles, of packed texts. DIMENSIONS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for sizes, places_ in zip(column(batch, "sizes"), column(batch, "places"), strict=True):
                total += np.bincount(np.frombuffer(places_, np.uint16), minlength=DIMENSIONS)
                n += len(sizes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *total[at].tolist()], pa.int64())], ["dimension", "n"])

    found = packs.mapInArrow(count, "dimension int, n long").groupBy("dimension").agg(F.sum("n")).collect()
    out = np.zeros(DIMENSIONS)
    for d, n in found:
        if d >= 0:
            out[d] = n
    return out, sum(n for d, n in found if d < 0)


def latent_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA, seed: int = 3, tasks: int = FAN) -> np.ndarray:
    """The leading right singular vectors, a column each, of the matrix A of TF-IDF vectors of all packed tiles.

    rows: sizes and places as packed() gives them, and length, which each of the row's vectors gets.
    Randomised SVD in one pass: tasks add up Y = A'(A G) for a Gaussian G. As A'A is about Y (G'Y)^-1 Y', the left singular
    vectors of Y (G'Y)^(-1/2) are the right ones of A. Sums, not rows, reach the driver; those of FAN tasks are added first,
    then FAN of these sums and so on. rows has about `tasks` partitions.
    """
    width = rank + extra
    schema = "lane int, block int, sums binary"
    g = np.random.default_rng(seed).standard_normal((DIMENSIONS, width), np.float32)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, squares = np.concatenate([g * idf[:, None].astype(np.float32), np.zeros((1, width), np.float32)]), idf * idf
        total = np.zeros((DIMENSIONS, width), np.float32)
        common = np.argsort(idf, kind="stable")[:COMMON]
        slot = np.full(DIMENSIONS, -1)
        slot[common] = np.arange(COMMON)
        of_common = np.zeros((COMMON, width), np.float32)
        for batch in batches:
            for sizes, places_, length in zip(*(column(batch, c) for c in ("sizes", "places", "length")), strict=True):
                size, what = np.frombuffer(sizes, np.uint8).astype(np.int64), np.frombuffer(places_, np.uint16)
                end = np.cumsum(size)
                for lo in range(0, len(size), STEP):
                    part = size[lo : lo + STEP]
                    here = what[int(end[lo] - size[lo]) : int(end[lo + len(part) - 1])]
                    y = row_sums(weighted, here, part)
                    y *= (length * length / np.add.reduceat(squares[here], np.cumsum(part) - part)).astype(np.float32)[:, None]
                    # each dimension gets the sum of y over the tiles that have it: common ones by a product of matrices
                    tile, k = np.repeat(np.arange(len(part)), part), slot[here]
                    has = np.zeros((COMMON, len(part)), np.float32)
                    has[k[k >= 0], tile[k >= 0]] = 1
                    of_common += has @ y
                    here, tile = here[k < 0], tile[k < 0]
                    order = np.argsort(here, kind="stable")
                    here, tile = here[order], tile[order]
                    new = np.flatnonzero(np.diff(here.astype(np.int32), prepend=-1))
                    times, own = np.diff(new, append=len(here)), y[tile[new]]
                    for i in range(1, int(times.max(initial=0))):
                        more = np.flatnonzero(times > i)
                        own[more] += y[tile[new[more] + i]]
                    total[here[new]] += own
        total[common] += of_common
        total *= idf[:, None]
        lane = TaskContext.get().partitionId()
        for k, part in enumerate(np.split(total, DIMENSIONS // BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["lane", "block", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK * width, np.float32)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_py(), np.float32)
        return pa.table({"lane": table.column("lane")[:1], "block": table.column("block")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums, lanes = rows.mapInArrow(ranged, schema), tasks
    while True:
        sums, lanes = sums.withColumn("lane", F.expr(f"cast(lane div {FAN} as int)")).groupBy("block", "lane").applyInArrow(added, schema), -(-lanes // FAN)
        if lanes == 1:
            break
    y = np.zeros((DIMENSIONS, width))
    for _, k, x in sums.collect():
        y[k * BLOCK : (k + 1) * BLOCK] += np.frombuffer(x, np.float32).reshape(-1, width)
    core = g.T.astype(float) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values = np.maximum(values, max(values[-1], 1e-30) * 1e-6)
    return np.linalg.svd(y @ (vectors / np.sqrt(values)), full_matrices=False)[0][:, :rank].astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the bits of one number as a row of the table."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := at.get(y):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Items:
    """Benchmark items as word hashes, and the latent vectors of their passages, the item of each and its first word there."""

    ids: list
    words: list[list[int]]
    vectors: np.ndarray
    of: np.ndarray
    offset: np.ndarray


def _blocks(docs: DataFrame, items: DataFrame) -> Iterator[tuple[Items, np.ndarray, np.ndarray]]:
    """(items, weighted basis, IDF) of each block of the items; none if there are no words in them."""
    known = kept(items.select("item_id", "text").where("text is not null").distinct())
    if known.isEmpty():
        return
    packs, own = kept(packed(docs)), kept(packed(known))
    df, n = frequencies(packs)
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    n_own = frequencies(own)[1]
    if not n_own:
        return
    up = float(np.sqrt(max(1.0, n / n_own)))  # items weigh as much as the passages
    tasks = pieces(n, FIT_PASSAGES, 12)
    basis = latent_basis(packs.withColumn("length", F.lit(1.0)).union(own.withColumn("length", F.lit(up))).coalesce(tasks), idf, tasks=tasks)
    weighted = np.concatenate([basis * idf[:, None], np.zeros((1, RANK))]).astype(np.float32)
    blocks_of = -(-2 * n_own // ITEMS_PER_BLOCK)
    for k in range(blocks_of):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks_of)) == k).collect()
        w = words([r.text for r in rows])
        vectors, start, of = passage_vectors(w, weighted)
        if len(of):
            yield Items([r.item_id for r in rows], [w.hash[a:b].tolist() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)], vectors, of, start - w.first[of]), weighted, idf


def find_leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, overlap: float = OVERLAP, least: float = ALIGNED, answered: float = ANSWERED) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of each item that a document has.

    docs: doc_id and text, whole texts; items: item_id and text. Documents and items are cut into half-overlapping passages of
    64 words. IDF and the latent space are counted and fitted on every second passage, which together hold each word of all
    documents and items once; every passage is projected. Passages of a document and an item whose cosine there is `cosine`
    or more are candidates. They say where the item would stand in the document: its length there (64 words at least), 32
    words more on each side and, of an item over 64 words, a quarter of what is over. The item's words that this span has
    must make up `overlap` of the item's IDF, the longest common subsequence `least` of its words, and that of its last
    words, its answer, `answered` of those. The best span of a pair is returned; a copy with more words put in than the
    span has room for may be missed.

    Items reach the driver, in blocks of ITEMS_PER_BLOCK, one search of the documents for each. Null texts and those without words
    match nothing; null ids are ids like others; repeated rows are reported once. An empty table on either side gives none.
    """
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer double"
    found = None

    def search(find: Callable[[list[str | None]], list[tuple]], ids: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                own, rows = column(batch, "doc_id"), find(column(batch, "text"))
                if rows:
                    numbers = [pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array([own[r[0]] for r in rows], batch.schema.field("doc_id").type), pa.array([ids[r[1]] for r in rows]), *numbers], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    for block, weighted, idf in _blocks(docs, items):
        part = search(finder(block, weighted, idf, cosine, overlap, least, answered), block.ids)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine")).alias("best")).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer")


def finder(items: Items, weighted: np.ndarray, idf: np.ndarray, cosine: float, overlap: float, least: float, answered: float) -> Callable[[list[str | None]], list[tuple]]:
    """A function that gives (text, item, cosine, lcs, answer), both by number, for each span of some texts that an item matches."""
    lengths = np.array([len(x) for x in items.words])
    room = HALF + np.maximum(lengths - 2 * HALF, 0) // 4
    # the distinct words of each item, one item after the other
    vocabulary, slots = np.unique(np.array([h for x in items.words for h in x], np.uint64), return_inverse=True)
    key = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(vocabulary) + slots)
    slots = key % len(vocabulary)
    weight = idf[(vocabulary[slots] & np.uint64(DIMENSIONS - 1)).astype(np.int64)]
    sizes = np.bincount(key // len(vocabulary), minlength=len(lengths))
    begins = np.cumsum(sizes) - sizes
    need = overlap * np.bincount(key // len(vocabulary), weights=weight, minlength=len(lengths)) * 0.999

    def spans(w: Words) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray]]:
        """(span, text, items, cosines): where candidates would stand."""
        vectors, start, of = passage_vectors(w, weighted)
        near = [np.nonzero((x := vectors[lo : lo + STEP] @ items.vectors.T) >= cosine) + (x,) for lo in range(0, len(of), STEP)]
        at = np.concatenate([lo + a for lo, (a, _, _) in zip(range(0, len(of), STEP), near, strict=True)] or [[]]).astype(np.int64)
        if not len(at):
            return
        piece, near = np.concatenate([b for _, b, _ in near]), np.concatenate([x[a, b] for a, b, x in near])
        item = items.of[piece]
        begin = start[at] - items.offset[piece]  # where the item would start
        stop = np.minimum(begin + np.maximum(lengths[item], 2 * HALF) + room[item], w.first[of[at] + 1])
        begin = np.maximum(begin - room[item], w.first[of[at]])
        order = np.lexsort((-near, item, stop, begin))
        at, item, near, begin, stop = (x[order] for x in (at, item, near, begin, stop))
        moved = (np.diff(begin, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0)
        first = np.flatnonzero(moved | (np.diff(item, prepend=-1) != 0))  # of each item at a span the nearest passages
        at, item, near, begin, stop = (x[first] for x in (at, item, near, begin, stop))
        edge = np.flatnonzero((np.diff(begin, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)], strict=True):
            yield slice(int(begin[a]), int(stop[a])), int(of[at[a]]), item[a:b], near[a:b]

    def find(texts: list[str | None]) -> list[tuple]:
        present, out = np.zeros(len(vocabulary), bool), []
        for lo, hi in blocks([t or "" for t in texts], 1 << 18):
            w, slot = words(texts[lo:hi]), None
            for here, text, j, near in spans(w):
                if slot is None:
                    slot = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                    hit = vocabulary[slot] == w.hash
                own = slot[here][hit[here]]
                present[own] = True
                k = ranges(begins[j], sizes[j])
                has = np.add.reduceat(np.where(present[slots[k]], weight[k], 0), np.cumsum(sizes[j]) - sizes[j])
                present[own] = False
                good = np.flatnonzero(has >= need[j])
                if not len(good):
                    continue
                around = w.hash[here].tolist()
                for i, c in zip(j[good].tolist(), near[good].tolist(), strict=True):
                    x = items.words[i]
                    share = common_subsequence(x, around) / len(x)
                    tail = x[-ANSWER_WORDS:]
                    answer = common_subsequence(tail, around) / len(tail)
                    if share >= least and answer >= answered:
                        out.append((lo + text, i, c, share, answer))
        return out

    return find


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that have no item (see find_leaks), each judged by its own text, with whatever ids; nothing is shuffled."""
    out = docs

    def clean(find: Callable[[list[str | None]], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                stays = np.ones(batch.num_rows, bool)
                stays[[r[0] for r in find(column(batch, "text"))]] = False
                if stays.any():
                    yield batch.filter(pa.array(stays))

        return run

    for block, weighted, idf in _blocks(docs, items):
        out = out.mapInArrow(clean(finder(block, weighted, idf, COSINE, OVERLAP, ALIGNED, ANSWERED)), docs.schema)
    return out
