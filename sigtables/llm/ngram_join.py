"""Links between documents whose sets of word shingles are nearly equal, by multi-match prefixes of adaptive length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.llm import _exchange as X
from sigtables.llm._tables import kept, pieces, text_bytes
from sigtables.llm._text import Words, blocks, mix, rolling
from sigtables.llm.near_copies import components, links_of, meetings, packed, unpacked

#: Words of a shingle and the least similarity, in percent.
SHINGLE, PERCENT = 3, 90
#: Bytes of text in a chunk of documents.
CHUNK = 4 << 20
#: Matches that a prefix may ask for at most, and what verifying a candidate costs against reading one place of a token, for each token of a set.
MATCHES, VERIFY = 8, 0.05
#: Centers that a set is compared with before the exact step.
CENTERS = 3
#: Sets, and bytes of their texts, in one block of pairs.
BLOCK, BLOCK_BYTES = 256, 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
COUNTS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
CLASSES = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary())])
SETS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("unique", pa.int32()), ("matches", pa.int32()), ("prefix", pa.list_(pa.int64())), ("text", pa.binary())])


def sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles of `size` words, A-Z lower-cased, as sorted numbers; fewer words are one shingle, none are none."""
    w = Words([t.translate(LOWER) for t in texts])
    grams, out = rolling(w.hash, size), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(mix(rolling(w.hash[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int = PERCENT) -> int:
    """How many of its n tokens a set shares with any similar set at least."""
    return -(-percent * n // 100)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def prefix_of(rare: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(matches, length of the prefix) that cost a set of n tokens least; (0, 0) if it can't be similar to another.

    rare: in how many sets, about, each of its rarest tokens is, rarest first, 0 for one that it alone has. Similar sets
    share `matches` of their first n - needed(n) + matches tokens at least. A prefix costs the places of its tokens, and the
    sets met `matches` times there to be verified: no more than its places / matches.
    """
    base = n - needed(n, percent)
    most = min(MATCHES, needed(n, percent), len(rare) - base)
    places = np.cumsum(rare)[base : base + most]
    if not len(places) or not places[0]:
        return 0, 0
    ell = np.arange(1, most + 1)
    best = int(np.argmin(places + VERIFY * n * places / ell)) + 1
    return best, base + best


LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _bodies(table: pa.Table) -> list[np.ndarray]:
    texts = unpacked(table, "text")
    return [s for lo, hi in blocks(texts) for s in sets(texts[lo:hi])]


def _star(table: pa.Table) -> pa.Table:
    """Links between the set of side 0 and those of side 1."""
    sides, nodes = table.column("side").to_pylist(), table.column("node").to_pylist()
    if 0 not in sides or 1 not in sides:
        return LINKED.empty_table()
    own = _bodies(table)
    middle = sides.index(0)
    return links_of([(nodes[middle], nodes[i]) for i, s in enumerate(sides) if s == 1 and similar(own[middle], own[i])])


def _compare(table: pa.Table) -> pa.Table:
    """Links between different components, of rows of side 0 and side 1 or among rows of side 2, as pairs of components.

    A pair is verified if it shares as many prefix tokens as the less demanding of the two asks for and the sizes allow it.
    """
    parts = table.column("component").to_pylist()
    if len(set(parts)) < 2:
        return LINKED.empty_table()
    sides = np.array(table.column("side").to_pylist())
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if sides[0] != 2 else (np.arange(len(sides)),) * 2
    if not len(left) or not len(right):
        return LINKED.empty_table()
    sizes, asked = (table.column(c).to_numpy().astype(np.int64) for c in ("n_shingles", "matches"))
    prefixes = table.column("prefix").combine_chunks()
    flat = prefixes.flatten().to_numpy()
    who = np.repeat(np.arange(len(sides)), np.diff(prefixes.offsets.to_numpy()))
    _, token = np.unique(flat, return_inverse=True)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    for lo in range(0, int(token[-1]) + 1, 4096):
        a, b = np.searchsorted(token, [lo, lo + 4096])
        has = np.zeros((len(sides), 4096), np.float32)
        has[who[a:b], token[a:b] - lo] = 1
        common += has[left] @ has[right].T
    fits = np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= PERCENT * np.maximum(sizes[left][:, None], sizes[right][None, :])
    _, apart = np.unique(np.array(parts, object), return_inverse=True)
    pairs = np.argwhere((common >= np.minimum(asked[left][:, None], asked[right][None, :])) & fits & (apart[left][:, None] != apart[right][None, :]))
    if not len(pairs):
        return LINKED.empty_table()
    owner = {p: p for p in parts}

    def root(p: bytes) -> bytes:
        while owner[p] != p:
            owner[p] = p = owner[owner[p]]
        return p

    own, found = _bodies(table), []
    for i, j in pairs.tolist():
        a, b = int(left[i]), int(right[j])
        if (ra := root(parts[a])) != (rb := root(parts[b])) and similar(own[a], own[b]):
            owner[max(ra, rb)] = min(ra, rb)
            found.append((parts[a], parts[b]))
    return links_of(found)


def described(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, node (16 bytes that tell its set), n_shingles, and, once in a chunk for each set that may
    have similar ones, unique (tokens of its own), matches, prefix and text.

    Chunks send each distinct token and in how many of their sets it is; parts add this up and answer those that are in several.
    The order of all tokens is by that count, in steps of an eighth of a power of two, and then by value; it is the same in all
    chunks. A set whose share of tokens of its own is too large has no similar set and sends no prefix.
    """
    size = text_bytes(docs)
    parts = pieces(size, 16 << 20, 12)  # a part sorts the tokens of so many bytes of text
    chunked = X.by_chunk(docs, pieces(size, CHUNK, 12))

    def sets_of(table: pa.Table):
        """Each text's set and the number of the first text with that set."""
        own, seen, found = X.texts(table), {}, []
        for lo, hi in blocks(own):
            for s in sets(own[lo:hi]):
                found.append((s, seen.setdefault(s.tobytes(), len(found))))
        return own, found

    def count(table: pa.Table) -> pa.Table:
        _, found = sets_of(table)
        keys, times = np.unique(X.coded(np.concatenate([s for i, (s, k) in enumerate(found) if i == k]), parts), return_counts=True)
        chunk = table.column("chunk")[0].as_py()
        return X.table_of(COUNTS, ((part, chunk, k.tobytes(), t.tobytes()) for part, (k, t) in X.dealt(keys >> np.uint64(32), parts, [keys.astype(np.uint32), np.minimum(times, 65535).astype(np.uint16)])))

    def answer(table: pa.Table) -> pa.Table:
        all_keys, all_times = X.joined(table, "keys", "<u4"), X.joined(table, "times", "<u2")
        keys, at = np.unique(all_keys, return_inverse=True)
        total = np.bincount(at, weights=all_times, minlength=len(keys))
        steps = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        mine = steps[at]
        edges = np.cumsum([0, *(len(x) // 4 for x in table.column("keys").to_pylist())])
        rows = []
        for c, p, a, b in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), edges, edges[1:], strict=False):
            k = np.flatnonzero(mine[a:b]) + a
            rows.append((c, p, all_keys[k].tobytes(), mine[k].tobytes()))
        return X.table_of(CLASSES, (r for r in rows if r[2]))

    def prefixes(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return SETS.empty_table()
        own, found = sets_of(docs_)
        known = np.concatenate([X.numbers(k, "<u4").astype(np.uint64) | (np.uint64(p) << np.uint64(32)) for p, k in zip(answers.column("part").to_pylist(), answers.column("keys").to_pylist(), strict=True)] or [np.zeros(0, np.uint64)])
        order = np.argsort(known)
        known, classes = known[order], X.joined(answers, "classes", "u1")[order]
        rows = []
        for i, (doc, (s, first)) in enumerate(zip(docs_.column("doc_id").to_pylist(), found, strict=True)):
            node = int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "little") + int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))).to_bytes(8, "little")
            rest = (0, 0, None, None)
            if i == first and len(s) and len(known):
                codes = X.coded(s, parts)
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                steps = np.where(known[at] == codes, classes[at], 0)
                rare = np.lexsort((s, steps))[: len(s) - needed(len(s)) + MATCHES]
                matches, length = prefix_of(np.where(steps[rare] > 0, np.exp2(steps[rare] / 8.0), 0), len(s))
                if matches:
                    kept_ = rare[:length][steps[rare[:length]] > 0]
                    rest = (int((steps == 0).sum()), matches, s[kept_].astype(np.int64), packed(own[i]))
            rows.append((doc, node, len(s), *rest))
        return X.table_of(SETS, rows)

    counted = chunked.groupBy("chunk").applyInArrow(count, "part int, chunk int, keys binary, times binary")
    classes = counted.groupBy("part").applyInArrow(answer, "chunk int, part int, keys binary, classes binary")
    return X.with_answers(chunked, classes, prefixes, "doc_id long, node binary, n_shingles long, unique int, matches int, prefix array<long>, text binary")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id that links reach, of each document.

    A document's set is its distinct runs of SHINGLE words, A-Z lower-cased; of fewer words, all of them as one run. Sets are
    linked if they share PERCENT of all their runs together, so equal sets are; a document without words (or null text) has no
    runs and no links. Runs are told apart by 64-bit hashes.

    Similar sets share `matches` tokens of their prefixes, of the less demanding of the two (see prefix_of). Of the sets that have a
    prefix token, the one with the fewest tokens of its own is the token's center; each set is verified against its most
    frequent centers. That gives components. Where the sets of a token are still in several, all pairs of different components
    that share enough tokens are verified, block against block, and join components in turn; so no link between components
    is lost, and no pairs are formed inside one.

    Null ids are larger than any, so a component of null ids alone has a null component_id; repeated rows stay, each of its
    own; an empty table stays empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = kept(described(docs))
    found = rows.where("matches > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "unique", "matches", "prefix", "text")))
    places = rows.where("matches > 0").select("node", "unique", F.explode("prefix").alias("token")).distinct()
    centers = places.groupBy("token").agg(F.count("*").alias("n"), F.min_by("node", F.struct("unique", F.xxhash64("node"))).alias("center")).where("n > 1")
    met = kept(places.join(centers, "token").select("token", "node", "center"))
    # the sets that share a token with others; most copies don't, as equal sets are one
    bodies = kept(found.join(met.select("node").distinct(), "node", "left_semi"))
    nearest = met.where("node != center").groupBy("node", "center").count()
    nearest = nearest.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy(F.col("count").desc(), "center"))).where(F.col("at") <= CENTERS).select("node", "center")
    size = F.octet_length("text")
    salts = nearest.join(bodies.select("node", size.alias("bytes")), "node").groupBy("center").agg(F.ceil(F.greatest(F.count("*") / (2 * BLOCK), F.sum("bytes") / BLOCK_BYTES)).cast("long").alias("k"))
    others = nearest.join(salts, "center").join(bodies.select("node", "text"), "node").select("center", F.pmod(F.xxhash64("node"), "k").alias("salt"), "node", F.lit(1).alias("side"), "text")
    own = salts.join(bodies.select(F.col("node").alias("center"), "text"), "center").select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"), F.col("center").alias("node"), F.lit(0).alias("side"), "text")
    first = components(kept(own.union(others).groupBy("center", "salt").applyInArrow(_star, "a binary, b binary")))

    named = bodies.select("node", size.alias("bytes")).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = met.select(F.col("token").alias("bucket"), "node").join(named, "node")
    dealt = meetings(left, BLOCK, BLOCK_BYTES).join(bodies.select("node", "n_shingles", "matches", "prefix", "text"), "node")
    more = dealt.groupBy("bucket", "kind", "i", "j").applyInArrow(_compare, "a binary, b binary")
    second = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))

    each = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = each.join(second, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    ids = each.join(each.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    return rows.select("doc_id", "node", "n_shingles").join(ids, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    return join(docs)


#: digest() over the table documents, as SQL.
ORACLE_SQL = f"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, w[u.i:u.i + {SHINGLE - 1}] AS s FROM words, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, least(len(w), 1) + 1))) AS u(i)
),
coded AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM coded GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM coded AS a JOIN coded AS b USING (s) WHERE a.doc_id != b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)
),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached AS r JOIN links AS l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached AS r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id
"""
