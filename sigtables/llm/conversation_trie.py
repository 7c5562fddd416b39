"""Tries of conversations' turns by vertical bitmaps: for each position and turn the bitset of the conversations that have it there."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigtables.llm._tables import kept, pieces, text_bytes

#: Neighbouring conversation ids of a shard, so bits of a bitset at most; a multiple of SHARED.
WIDTH = 1000
#: Conversations that rebuilt() lets begin alike, and the turns that it lets them share, less one.
SHARED, HEADS = 100, 6
#: Positions whose postings are held at once.
BAND = 1024
ROOT = bytes(16)
NODES = pa.schema([("shard", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64()))])
SUMS = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (16 bytes that tell role and text) and size (code points of the text) of each turn, in order.

    Turns of a conversation stand by turn (null first), equal ones by role and text; a repeated row is a turn of its own. A null
    role or text is empty. Rows of no conversation (null id) go. Rows are sorted over all conversations at once, in ranges,
    and numbered by the count of what stands before in earlier ranges, so that a conversation of many turns is spread out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(pieces(text_bytes(turns), 16 << 20), *order).sortWithinPartitions(*order)
    told = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    # numbers rise along a range and from range to range; the upper bits are the range
    placed = kept(ranged.select("conv_id", told.alias("turn"), F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("nth")))
    placed = placed.withColumn("slice", F.shiftright("nth", 33))
    spans = placed.groupBy("conv_id", "slice").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    spans = spans.select("conv_id", "slice", (F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return placed.join(spans, ["conv_id", "slice"]).select("conv_id", (F.col("nth") + F.col("shift")).alias("pos"), "turn", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """numbered() turns of conversations that begin alike, and each conversation once at pos 0.

    Conversation c gets the first h turns of conversation c - c % SHARED (the remainder is never negative), all if it has
    fewer and none if there is no such conversation, and then its own turns after its first h: h is crc32 of c in decimal,
    modulo HEADS. The results' turns are numbered anew.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.pmod("conv_id", F.lit(SHARED))).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("has", F.lit(0))))
    heads = turns.where((F.col("pos") < HEADS) & (F.pmod("conv_id", F.lit(SHARED)) == 0)).withColumnRenamed("conv_id", "base")
    begun = convs.join(heads, "base").where("pos <= b").select("conv_id", "pos", "turn", "size")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "turn", "size")
    return begun.union(own).union(bare(convs))


def bare(convs: DataFrame) -> DataFrame:
    """A row at pos 0 for each conversation, which has no turn there."""
    return convs.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns of its rows) for each run of rows with equal first `keys` columns."""
    held: tuple | None = None
    columns: list[list] = []
    for batch in batches:
        data = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*data[:keys], strict=True))
        lo = 0
        while lo < len(marks):
            hi = lo
            while hi < len(marks) and marks[hi] == marks[lo]:
                hi += 1
            if marks[lo] != held:
                if held is not None:
                    yield held, columns
                held, columns = marks[lo], [[] for _ in data[keys:]]
            for own, new in zip(columns, data[keys:], strict=True):
                own += new[lo:hi]
            lo = hi
    if held is not None:
        yield held, columns


class Shard:
    """The trie of a shard's conversations, band of positions by band.

    A node is a bitset of conversations, whose bits stand in order of their ids. Its children are its intersections with
    the postings of the next position: the turn of its first conversation gives one, what is left of the node the next. So
    there is one intersection for each child.
    """

    def __init__(self, convs: list[int], emit: Callable[..., None]):
        self.convs, self.bit, self.emit = convs, {c: i for i, c in enumerate(convs)}, emit
        self.frontier = [(ROOT, ROOT, (1 << len(convs)) - 1, 0, 0)]

    def members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return out

    def grow(self, last: int, convs: list[int], places: list[int], turns: list[bytes], sizes: list[int]) -> None:
        """Takes the turns at the positions up to `last`; nodes at that depth wait for the next band."""
        postings: dict[tuple[int, bytes], int] = defaultdict(int)
        here: dict[tuple[int, int], tuple[bytes, int]] = {}
        for c, p, t, s in zip(convs, places, turns, sizes, strict=True):
            i = self.bit[c]
            postings[p, t] |= 1 << i
            here[i, p] = t, s
        stack, self.frontier = self.frontier[::-1], []
        while stack:
            node, parent, bits, depth, size = stack.pop()
            if depth == last:
                self.frontier.append((node, parent, bits, depth, size))
                continue
            rest, ends = bits, 0
            while rest:
                low = rest & -rest
                if (found := here.get((low.bit_length() - 1, depth + 1))) is None:
                    ends |= low
                    rest ^= low
                else:
                    child = rest & postings[depth + 1, found[0]]
                    rest ^= child
                    stack.append((hashlib.blake2b(node + found[0], digest_size=16).digest(), node, child, depth + 1, found[1]))
            self.emit(node, parent, depth, bits.bit_count(), self.convs[(bits & -bits).bit_length() - 1], size, self.members(ends))

    def end(self) -> None:
        for node, parent, bits, depth, size in self.frontier:
            self.emit(node, parent, depth, bits.bit_count(), self.convs[(bits & -bits).bit_length() - 1], size, self.members(bits))


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each shard from its rows, which come band by band: shard, band, conv_id, pos, turn, size."""
    rows: list[tuple] = []
    shard, trie = None, None

    def emit(*node) -> None:
        rows.append((shard, *node))

    for (number, band), (convs, places, turns, sizes) in runs(batches, 2):
        if number != shard:
            if trie:
                trie.end()
            shard, trie = number, Shard(sorted(c for c, p in zip(convs, places, strict=True) if p == 0), emit)
        own = [i for i, p in enumerate(places) if p]
        trie.grow((band + 1) * BAND - 1, *([x[i] for i in own] for x in (convs, places, turns, sizes)))
        while len(rows) >= 4096:
            yield packed(rows[:4096], NODES)
            del rows[:4096]
    if trie:
        trie.end()
    if rows:
        yield packed(rows, NODES)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each shard adds to its nodes: their children, childless nodes below and saved code points, counted where a node's least member is.

    Nodes of a shard come from the deepest up, so only the sums of one depth and its nodes are held.
    """
    rows: list[tuple] = []
    shard, waiting = None, {}
    for (number, depth), columns in runs(batches, 2):
        if number != shard:
            shard, waiting = number, {}
        above: dict[bytes, list] = {}
        for node, parent, own, n_convs, conv_id, n_ends, size in zip(*columns, strict=True):
            below = waiting.pop(node, [0, 0, 0, []])
            children, leaves, saved, held = below
            rows += [(*x, conv_id, *y) for x, y in held]
            leaves += own and n_ends == n_convs
            saved += own * (n_convs - 1) * size
            if depth:
                up = above.setdefault(parent, [0, 0, 0, []])
                up[0] += own
                up[1] += leaves
                up[2] += saved
                up[3].append(((node, depth, conv_id), (n_convs, children, leaves, saved)))
            else:
                rows.append((node, depth, conv_id, None, n_convs, children, leaves, saved))
        waiting = above
        while len(rows) >= 4096:
            yield packed(rows[:4096], SUMS)
            del rows[:4096]
    if rows:
        yield packed(rows, SUMS)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and ends_sha256 from node, shard and ends, in that order; a node's ids run through one hash and are never gathered."""
    node, hashed, out = None, None, []
    for batch in batches:
        for name, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text = ",".join(map(str, ends))
            if name == node:
                hashed.update(b"," + text.encode())
            else:
                if hashed:
                    out.append((node, hashed.hexdigest()))
                node, hashed = name, hashlib.sha256(text.encode())
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
            out = []
    if hashed:
        out.append((node, hashed.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])


def local_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of each shard's trie: shard, node (16 bytes for the path of turns), parent, depth, n members, the least, size and ends.

    turns: conv_id, pos, turn, size, with each conversation at pos 0 (see bare). A shard is WIDTH neighbouring ids, so its
    bitsets have WIDTH bits at most. Postings of BAND positions are held at once, so a shard's memory doesn't grow with the
    length of its conversations.
    """
    parts = pieces(96 * turns.count(), 8 << 20, 24)
    rows = turns.select(F.expr(f"(conv_id - pmod(conv_id, {WIDTH})) div {WIDTH}").alias("shard"), F.expr(f"pos div {BAND}").alias("band"), "conv_id", "pos", "turn", "size")
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard", "band")
    return rows.mapInArrow(_tries, "shard long, node binary, parent binary, depth long, n long, least long, size long, ends array<long>")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns: node, conv_id (least member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    turns: conv_id, pos (from 1, without gaps), turn (16 bytes), size, and a row at pos 0 for each conversation. The root
    (depth 0) has all conversations, those without turns too, and no parent; no conversations, no rows. n_leaves counts
    the childless nodes of a node's subtree, saved_tokens adds up each node's (n_convs - 1) * size over it, ends_sha256 hashes
    the ids of the conversations that end at the node, ascending in decimal, joined by commas.

    Shards build their own tries. A node's counts are added up over the shards that have it; the shard with its least member
    then counts it for its ancestors, each of which that shard has too, so subtrees are summed without walking the trie as a
    whole. Only the hash of a node's ends runs through one task, as SHA-256 has no other way: it reads each shard's list once.
    """
    nodes = kept(local_nodes(turns))
    each = W.partitionBy("node")
    counted = nodes.select("shard", F.col("depth"), "node", "parent", (F.col("least") == F.min("least").over(each)).cast("long").alias("own"), F.sum("n").over(each).alias("n_convs"), F.min("least").over(each).alias("conv_id"), F.sum(F.size("ends").cast("long")).over(each).alias("n_ends"), "size")
    parts = pieces(96 * nodes.count(), 8 << 20, 24)
    added = counted.repartition(parts, "shard").sortWithinPartitions("shard", F.col("depth").desc()).mapInArrow(_sums, "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, children long, leaves long, saved long")
    merged = added.groupBy("node").agg(*(F.min(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = nodes.where(F.size("ends") > 0).select("node", "shard", "ends").repartition(parts, "node").sortWithinPartitions("node", "shard")
    hashes = ends.mapInArrow(_hashes, "node binary, ends_sha256 string")
    return merged.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return trie(rebuilt(numbered(conversations.select("conv_id", "turn", "role", "text")))).drop("node")


#: digest() over the table conversations, as SQL.
ORACLE_SQL = """
WITH RECURSIVE
crc_step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END FROM crc_step WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, n, conv_id - ((conv_id % 100) + 100) % 100 AS base,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) AS INTEGER) + 1]))) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id), crc_table
),
own AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS b FROM convs AS c LEFT JOIN convs AS b ON b.conv_id = c.base
),
built AS (
  SELECT o.conv_id, t.pos, t.role, t.text FROM own AS o JOIN turns AS t ON t.conv_id = o.base WHERE t.pos <= o.b
  UNION ALL
  SELECT o.conv_id, t.pos - o.h + o.b, t.role, t.text FROM own AS o JOIN turns AS t ON t.conv_id = o.conv_id WHERE t.pos > o.h
),
coded AS (SELECT conv_id, pos, text, dense_rank() OVER (ORDER BY role, text) AS code FROM built),
paths AS (
  SELECT o.conv_id, coalesce(list(c.code ORDER BY c.pos) FILTER (c.pos IS NOT NULL), CAST([] AS BIGINT[])) AS path
  FROM own AS o LEFT JOIN coded AS c USING (conv_id) GROUP BY o.conv_id
),
members AS (SELECT conv_id, path[1:u.d] AS node, u.d AS depth, len(path) = u.d AS ends FROM paths, unnest(range(0, len(path) + 1)) AS u(d)),
sizes AS (SELECT code, min(length(text)) AS size FROM coded GROUP BY code),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (m.ends), '') AS ends
  FROM members AS m GROUP BY node
),
weighed AS (SELECT n.*, (n_convs - 1) * coalesce(size, 0) AS saved FROM nodes AS n LEFT JOIN sizes AS s ON s.code = n.node[-1]),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
flagged AS (SELECT w.*, coalesce(c.n, 0) AS n_children FROM weighed AS w LEFT JOIN children AS c USING (node)),
below AS (
  SELECT node[1:u.d] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM flagged, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flagged AS f JOIN below USING (node) LEFT JOIN nodes AS p ON f.depth > 0 AND p.node = f.node[1:f.depth - 1]
"""
