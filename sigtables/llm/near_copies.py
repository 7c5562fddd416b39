"""Near copies by Order MinHash: sketches that keep the text order of their k-mers, and banded alignment of candidates' words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtables.llm._tables import kept, pieces
from sigtables.llm._text import Words, blocks, mix, rolling, utf8

#: Words in a shingle, the share of words that near copies have in common in text order, sketches of a text and shingles in a sketch.
SHINGLE, SIMILAR, SKETCHES, DRAWN = 5, 0.8, 24, 2
#: Texts, and bytes of texts, in one block of pairs.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: A word that stands more often in a text has its places as one bitset.
OFTEN = 16
SEEDS = np.random.default_rng(11).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(x: np.ndarray) -> np.ndarray:
    """Each number with its occurrence counted in."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    if not (s[1:] == s[:-1]).any():
        return x
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    nth = np.empty(len(s), np.uint64)
    nth[order] = np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)]))
    return np.where(nth > 0, mix(x + nth * SEEDS[0]), x)


def shingles(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text a number for each run of `size` words, in text order; a repeated run also counts its occurrence.

    A text of fewer words has one run, of all of them; a text without words has one too. So the numbers of a text differ.
    """
    w = Words(texts)
    runs = rolling(w.hash, size)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        x = runs[a : b - size + 1] if b - a >= size else mix(np.array([len(w.hash[a:b]) + 1], np.uint64) + (w.hash[a:b] * SEEDS[: b - a]).sum(dtype=np.uint64))
        yield labelled(x)


def sketch(x: np.ndarray) -> np.ndarray:
    """For each seed the DRAWN numbers that it puts least, hashed in text order."""
    values = x[None, :] * SEEDS[:, None]
    if len(x) > DRAWN:
        at = np.sort(np.argpartition(values, DRAWN - 1, axis=1)[:, :DRAWN], axis=1)
        drawn = x[at]
    else:
        drawn = np.broadcast_to(x, (SKETCHES, len(x)))
    out = SEEDS.copy()
    for k in range(drawn.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k])
    return out


def common_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of a and b whose matches are `band` places off the diagonal at most.

    Rows of the alignment are bitsets: a zero bit is a place of a where the row's value rises. Only the 2 * band + 1 bits around
    the diagonal are held; those that leave the band don't change any more.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    begin = n if same.all() else int(same.argmin())
    a, b = a[begin:], b[begin:]
    n = min(len(a), len(b))
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    end = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - end], b[: len(b) - end]
    found = begin + end
    if not len(a) or not len(b):
        return found
    order = np.argsort(a, kind="stable")
    held = a[order]
    edge = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    places: dict[int, list[int] | int] = {}
    for w, at in zip(held[edge].tolist(), np.split(order, edge[1:]), strict=True):
        if len(at) > OFTEN:
            bits = np.zeros(len(a), bool)
            bits[at] = True
            places[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        else:
            places[w] = at.tolist()
    low, high, row = 0, 0, 0
    for j, w in enumerate(b.tolist()):
        if j > len(a) + band:
            break
        if (until := min(len(a), j + band + 1)) > high:
            row |= ((1 << (until - high)) - 1) << (high - low)
            high = until
        if (since := min(len(a), max(0, j - band))) > low:
            found += since - low - (row & ((1 << (since - low)) - 1)).bit_count()
            row >>= since - low
            low = since
        at = places.get(w)
        if at is None:
            continue
        if isinstance(at, int):
            match = (at >> low) & ((1 << (high - low)) - 1)
        else:
            match = 0
            for p in at:
                if low <= p < high:
                    match |= 1 << (p - low)
        taken = row & match
        row = ((row + taken) | (row & ~match)) & ((1 << (high - low)) - 1)
    return found + (high - low) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The words that a and b have in common in text order, as a share of those of the longer; 0 if that is surely below SIMILAR, and 1 for two without words.

    What is below SIMILAR may be less than it is: texts that reach it have no match further off the diagonal than the words of
    the longer that are left over, so the band loses none of theirs.
    """
    small, large = sorted((len(a), len(b)))
    return common_words(a, b, int((1 - SIMILAR) * large + 1e-9)) / large if small and alike(small, small, large) else float(not large)


def alike(common: float, a: int, b: int) -> bool:
    return common >= SIMILAR * max(a, b) - 1e-9


def words_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the numbers of its words."""
    for lo, hi in blocks(texts):
        w = Words(texts[lo:hi])
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield w.hash[a:b]


def packed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked(table: pa.Table, name: str = "body") -> list[bytes]:
    return [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in table.column(name).to_pylist()]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch)
        for lo, hi in blocks(texts):
            out = [sketch(x).astype(np.int64) for x in shingles(texts[lo:hi])]
            columns = [pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.ListArray.from_arrays(np.arange(0, SKETCHES * len(out) + 1, SKETCHES, dtype=np.int32), np.concatenate(out)), pa.array([packed(t) for t in texts[lo:hi]], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["node", "bytes", "sketches", "body"])


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def links_of(found: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([f(x) for x in found], pa.binary()) for f in (min, max)], schema=LINKS)


def _star(table: pa.Table) -> pa.Table:
    """Links between the text of side 0 (each of them, if a hash confuses two) and the others."""
    sides, nodes = table.column("side").to_pylist(), table.column("node").to_pylist()
    middle = [i for i, s in enumerate(sides) if s == 0]
    if not middle or len(sides) < 2:
        return LINKS.empty_table()
    own = list(words_of(unpacked(table)))
    return links_of([(nodes[m], nodes[i]) for m in middle for i, s in enumerate(sides) if (s == 1 or i > m) and similarity(own[i], own[m]) >= SIMILAR - 1e-9])


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of different components that links between rows of side 0 and side 1, or among rows of side 2, join.

    Only pairs that have enough words in common, in whatever order, are aligned.
    """
    parts = table.column("component").to_pylist()
    if len(set(parts)) < 2:
        return LINKS.empty_table()
    sides = np.array(table.column("side").to_pylist())
    x = list(words_of(unpacked(table)))
    sizes = np.array([len(s) for s in x])
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if sides[0] != 2 else (np.arange(len(x)),) * 2
    if not len(left) or not len(right):
        return LINKS.empty_table()
    flat, who = np.concatenate([labelled(s) for s in x]), np.repeat(np.arange(len(x), dtype=np.int32), sizes)
    order = np.argsort(flat)
    flat, who = flat[order], who[order]
    del order
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    del flat
    times = np.diff(np.append(np.flatnonzero(new), len(new)))
    number = (np.cumsum(times > 1) - 1)[np.cumsum(new) - 1]
    shared = np.repeat(times > 1, times)
    who, number = who[shared], number[shared]
    width, common = int((times > 1).sum()), np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(number, [lo, lo + 4096])
        has = np.zeros((len(x), min(4096, width - lo)), np.float32)
        has[who[a:b], number[a:b] - lo] = 1
        common += has[left] @ has[right].T
    longer = np.maximum(sizes[left][:, None], sizes[right][None, :])
    _, apart = np.unique(np.array(parts, object), return_inverse=True)
    pairs = np.argwhere((common >= SIMILAR * longer - 1e-6) & (apart[left][:, None] != apart[right][None, :]))
    # links that join nothing more in this block are left out
    owner = {p: p for p in parts}

    def root(p: bytes) -> bytes:
        while owner[p] != p:
            owner[p] = p = owner[owner[p]]
        return p

    found = []
    for i, j in pairs.tolist():
        a, b = int(left[i]), int(right[j])
        if (ra := root(parts[a])) != (rb := root(parts[b])) and similarity(x[a], x[b]) >= SIMILAR - 1e-9:
            owner[max(ra, rb)] = min(ra, rb)
            found.append((parts[a], parts[b]))
    return links_of(found)


def nearer(links: DataFrame) -> DataFrame:
    """a and p: for each node the least of itself and its neighbours, with chains of these shortened twice."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
    for _ in range(2):
        up = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    return up


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of every node in links(a, b).

    In each round every node joins the least of itself and its neighbours, chains of joins are shortened, and links inside
    what was joined go. Tables of a round are written, so rounds don't build on each other's lineage.
    """
    links = kept(links.where("a != b").distinct())
    parts, labels = pieces(64 * links.count(), 16 << 20, 8), None  # rows of two hashes: in files of some MB, not one a shuffle partition
    while not links.isEmpty():
        up = kept(nearer(links).coalesce(parts))
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = kept(labels.join(up.select(F.col("a").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component")).coalesce(parts))
        for c in ("a", "b"):
            links = links.join(up.select(F.col("a").alias(c), "p"), c).drop(c).withColumnRenamed("p", c)
        links = kept(links.where("a != b").distinct().coalesce(parts))
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def meetings(left: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """bucket, kind, i, j, side, node and component: where rows of left (bucket, node, bytes, component) meet those of other components.

    Each two rows of a bucket and of different components meet in a cell (bucket, kind, i, j), as sides 0 and 1 or both as side
    2. Buckets of one component have no cells, nor have all but one of the buckets that hold the same rows. A cell has about
    `block` rows or `block_bytes` of a side.
    """
    key = F.xxhash64("node")
    # a bucket's largest component, all but a few texts as a rule, meets the others but never itself
    sizes = left.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("bytes").alias("y"), F.bit_xor(key).alias("x"), F.sum(key.cast("decimal(38,0)")).alias("s"))
    several = sizes.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("y").alias("y"), F.max_by(F.struct("m", "y", "component"), F.struct("m", "component")).alias("main"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")).where("main.m < m")
    several = several.groupBy("m", "x", "s").agg(F.min_by(F.struct("bucket", "y", "main"), "bucket").alias("b"))
    count = lambda n, y: F.ceil(F.greatest(n / block, y / block_bytes))
    several = several.select("b.bucket", F.col("b.main.component").alias("main"), count(F.col("b.main.m"), F.col("b.main.y")).alias("ka"), count(F.col("m") - F.col("b.main.m"), F.col("b.y") - F.col("b.main.y")).alias("kb"))

    def cells(k: str, cell):
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), cell)

    def meeting(kind: int, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    main, own = F.col("component") == F.col("main"), F.col("own")
    with_main = cells("ka", lambda i: meeting(0, i, own, F.lit(1)))
    with_others = cells("kb", lambda j: meeting(1, F.least(own, j), F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    dealt = left.join(several, "bucket").withColumn("own", F.pmod(key, F.when(main, F.col("ka")).otherwise(F.col("kb"))))
    dealt = dealt.select("bucket", "node", "component", F.explode(F.when(main, cells("kb", lambda j: meeting(0, own, j, F.lit(0)))).otherwise(F.concat(with_main, with_others))).alias("c"))
    return dealt.select("bucket", "node", "component", "c.*")


def classes(docs: DataFrame) -> DataFrame:
    """docs with node (the MD5 of the text), class_id, the least doc_id of the texts that links join, and their _component and _keeper.

    _component is the same for the texts that links join and for no others, and _keeper the node of one that has class_id.

    Equal texts are one node. Two nodes are linked if an alignment in text order matches SIMILAR or more of the words of the
    longer (see similarity). Candidates have one of SKETCHES sketches in common, each made of the DRAWN occurrence-labelled runs of
    SHINGLE words that a hash puts least, in text order. A pair whose runs have the Jaccard similarity J shares none with the
    probability (1 - J**DRAWN)**SKETCHES: if every tenth word of one is another in the other, J is 0.42 and that is 0.01.
    Texts of fewer than SHINGLE words are one run.

    Nodes with a sketch in common are compared with one of them first, in blocks if many share one. The links so found give
    components. Where a bucket is still in several, all its pairs of different components are compared, block against block,
    which joins components in turn; its largest component isn't paired with itself. So no link between
    components is lost, and inside a component no pairs are formed. A block holds BLOCK texts or BLOCK_BYTES of them, about.

    A null text counts as empty; texts without words are one node each kind; a null doc_id takes part, and a class of
    null ids alone has a null class_id. Repeated rows stay. Columns of docs of these names are replaced.
    """
    docs = docs.drop("node", "class_id", "_component", "_keeper")
    docs = docs.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = docs.select("node", "text")
    sketched = kept(texts.mapInArrow(_sketched, "node binary, bytes long, sketches array<long>, body binary").groupBy("node").agg(*(F.first(c).alias(c) for c in ("bytes", "sketches", "body"))))
    # candidates go by a 64-bit hash of the node: two nodes that it confuses only get each other's candidates too
    sketched = sketched.withColumn("h", F.xxhash64("node"))
    placed = sketched.select("h", "bytes", F.explode("sketches").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("h").alias("center")).where("n > 1")
    # a center's texts are those of its buckets, at most 2 * BLOCK to a block, fewer where its buckets overlap
    k = F.ceil(F.greatest(F.sum("n") / (2 * BLOCK), F.sum("bytes") / (2 * BLOCK_BYTES)))
    shared = shared.select("bucket", "n", "center").join(shared.groupBy("center").agg(k.alias("k")), "center")
    places = placed.select("h", "bucket").join(shared, "bucket").groupBy("h").agg(F.collect_list(F.struct("bucket", "center", "n", "k")).alias("places"))
    # a row a text from here on: its places, SKETCHES at most, are taken apart only after it has met its text or component
    bodies = kept(sketched.select("h", "node", "bytes", "body").join(places, "h"))

    stars = bodies.select("h", "node", "body", F.explode(F.array_distinct(F.transform("places", lambda p: F.struct(p["center"].alias("center"), p["k"].alias("k"))))).alias("star"))
    stars = stars.select("star.*", "h", "node", "body")
    own = stars.where("center = h").select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"), "node", F.lit(0).alias("side"), "body")
    others = stars.where("center != h").select("center", F.pmod("h", "k").alias("salt"), "node", F.lit(1).alias("side"), "body")
    links = kept(own.union(others).groupBy("center", "salt").applyInArrow(_star, "a binary, b binary"))

    first = components(links)
    named = bodies.select("h", "node", "bytes", "places").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = named.select("node", "bytes", "component", F.explode(F.filter("places", lambda p: (p["center"] != F.col("h")) & (p["n"] > 2))).alias("p")).select("p.bucket", "node", "bytes", "component")
    dealt = meetings(left, BLOCK, BLOCK_BYTES)
    more = dealt.join(bodies.select("node", "body"), "node").groupBy("bucket", "kind", "i", "j").applyInArrow(_compare, "a binary, b binary")
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))

    numbered = docs.select("node", "doc_id").groupBy("node").agg(F.min("doc_id").alias("least")).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    numbered = numbered.join(second, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    named = kept(numbered.select("node", "component", "least"))
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "node"))["node"].alias("_keeper"))
    return docs.join(named.join(ids, "component").select("node", "class_id", F.col("component").alias("_component"), "_keeper"), "node")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id, null as the largest; of rows that tie, one with the least node."""
    return classes(docs).where("node = _keeper and doc_id <=> class_id").dropDuplicates(["_component"]).select([f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of each document."""
    return classes(docs.select("doc_id", "text")).select("doc_id", "class_id")
