"""Removal of byte strings that earlier documents have, by distributed prefix doubling.

Equal strings of the threshold length have the same anchor (the 16-byte gram in them with the least hash). Only strings
whose anchor stands at more than one place are sorted at all. Runs of neighbouring strings with one anchor go to the part
of that anchor as one piece of text, so that all suffixes that can be equal up to the threshold meet there. There the ranks
of 8-byte prefixes are doubled: positions are ranked by pairs of ranks at offsets 8, 16 and so on up to the threshold, and
positions whose rank is unique drop out.

An anchor with more than HOT different runs, as one inside a passage that a large share of the documents have, would fill its
part with them. Its strings are sent one by one, each to the part of its own hash, where only equal strings meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.llm import _exchange as X
from sigtables.llm._tables import pieces, text_bytes
from sigtables.llm._text import BYTE_CODE, anchors, blocks, mix, powers, rolling

CHUNK = 4 << 20
GRAM = 16
#: Different runs of an anchor that may meet in one part; 50,000 take some 400 MB there.
HOT = 50_000

KEYS = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
KEYS_DDL = "part int, chunk int, keys binary, times binary"
REPEATED = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])
SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("strings", pa.binary()), ("runs", pa.binary()), ("owners", pa.binary()), ("anchors", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("size", pa.int64())])
EARLIER = pa.schema([("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("masks", pa.binary()), ("part", pa.int32()), ("hot", pa.binary())])
EARLIER_DDL = "chunk int, first binary, second binary, masks binary, part int, hot binary"


class Runs:
    """Runs of neighbouring strings of `length` bytes, each inside one text, that have the same anchor.

    start: where a run begins in `data`; count: its strings; text: its text's number; value: its anchor; first, second: two
    hashes of the bytes that the run covers.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        n = len(self.data)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        codes = BYTE_CODE[self.data]
        value, place = anchors(rolling(codes, GRAM), length - GRAM + 1)
        m = len(value)
        text = np.repeat(np.arange(len(texts)), sizes)[:m]
        inside = np.arange(m) + length <= self.ends[text] if m else np.zeros(0, bool)
        new = np.ones(m, bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        breaks = np.append(np.flatnonzero(new | ~inside), m)
        self.start = np.flatnonzero(new & inside)
        self.count = breaks[np.searchsorted(breaks, self.start, side="right")] - self.start if m else self.start
        self.text, self.value = text[self.start], value[self.start]
        self.length, self.codes = length, codes
        self.first, self.second = self.keys(self.start, self.count)
        self.end = self.start + self.count + length - 1

    def keys(self, start: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        """Two hashes of the bytes that runs cover."""
        n, end, out = len(self.data), start + count + self.length - 1, []
        for which in (0, 1):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.codes * powers(n, which), out=total[1:])
            out.append(mix((total[end] - total[start]) * powers(n + 1, which, True)[start] + count.astype(np.uint64)))
        return out

    def cut(self, hot: np.ndarray) -> None:
        """Makes a run of each string of hot runs, with the string's own hash for an anchor; the others come first."""
        if not hot.any():
            return
        count = self.count[hot]
        start = np.repeat(self.start[hot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        one = np.ones(len(start), self.count.dtype)
        first, second = self.keys(start, one)
        more = {"start": start, "count": one, "text": np.repeat(self.text[hot], count), "value": first, "first": first, "second": second, "end": start + self.length}
        for name, x in more.items():
            setattr(self, name, np.concatenate([getattr(self, name)[~hot], x]))


def doubled_ranks(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks): the positions of `at` whose `length` bytes stand at another of them too, and their ranks.

    Ranks of all 8-byte prefixes come first; then pairs of ranks at a growing offset are ranked. A position whose rank is
    unique at some offset drops out.
    """
    n = len(data) + 2 * length
    padded = np.concatenate([data, np.zeros(2 * length + 8, np.uint8)])
    whole = np.zeros(n, np.uint64)
    for k in range(8):
        whole = (whole << np.uint64(8)) | padded[k : k + n]
    have, rank, alive = 8, np.zeros(n, np.int64), at
    while True:
        # positions whose ranks at this length are still asked for
        needed, ahead = np.zeros(n, bool), {0}
        reach = have
        while reach < length:
            step = min(reach, length - reach)
            ahead |= {x + step for x in ahead}
            reach += step
        for x in ahead:
            needed[alive + x] = True
        places = np.flatnonzero(needed)
        key = whole[places] if have == 8 else (rank[places].astype(np.uint64) << np.uint64(32)) | rank[places + last].astype(np.uint64)
        _, number, times = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.zeros(n, np.int64)
        rank[places] = number
        alive = alive[times[rank[alive]] > 1]
        if have == length or not len(alive):
            return alive, rank[alive]
        last = min(have, length - have)
        have += last


def batches(value: np.ndarray, size: np.ndarray, most: int = 1 << 19) -> Iterator[np.ndarray]:
    """Places of whole groups of equal values, which stand together, in batches of about `most` bytes; a larger group stands alone."""
    edge = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    if not len(edge):
        return
    weight = np.add.reduceat(size, edge)
    number = (np.cumsum(weight) - weight) // most
    cut = edge[np.flatnonzero(np.diff(number, prepend=-1))]
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(value)], strict=True):
        yield np.arange(lo, hi)


def compare(table: pa.Table, length: int) -> pa.Table:
    """For each run of a chunk, which of its strings a smaller document of another chunk has, as the bits of a mask."""
    count = X.joined(table, "runs", "<u1").astype(np.int64)
    owner, value = X.joined(table, "owners", "<i8"), X.joined(table, "anchors", "<u4")
    raw = b"".join([pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(table.column("strings").to_pylist(), table.column("size").to_pylist(), strict=True)])
    at = np.concatenate([[0], np.cumsum(count + length - 1)]).tolist()
    number: dict[bytes, int] = {}
    what = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(at, at[1:], strict=False)], np.int64)
    n = len(number)
    own, anchor, size = np.full(n, X.LAST), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    np.minimum.at(own, what, owner)
    anchor[what], size[what] = value, count
    # first string of each distinct run among all strings of distinct runs, and the least document that has each string
    head = np.concatenate([[0], np.cumsum(size)])
    least = np.repeat(own, size)
    _, of, times = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[of] > 1)  # a run alone with its anchor has no string that another run has
    runs, several = list(number), several[np.argsort(anchor[several], kind="stable")]
    for some in batches(anchor[several], size[several] + length - 1):
        some = several[some]
        data = np.frombuffer(b"".join([runs[i] for i in some.tolist()]), np.uint8)
        begin = np.cumsum(size[some] + length - 1) - (size[some] + length - 1)
        inner = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        places = np.repeat(begin, size[some]) + inner
        target = np.repeat(head[some], size[some]) + inner
        found, ranks = doubled_ranks(data, places, length)
        if len(found):
            k = target[np.searchsorted(places, found)]
            best = np.full(int(ranks.max()) + 1, X.LAST)
            np.minimum.at(best, ranks, least[k])
            least[k] = best[ranks]
    rows = np.repeat(np.arange(len(what)), count)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    seen = least[head[what][rows] + inner] < owner[rows]
    masks = np.bincount(rows, weights=np.where(seen, np.exp2(inner), 0), minlength=len(what)).astype(np.uint64)
    first, second = X.joined(table, "first"), X.joined(table, "second", "<u4")
    edges = np.cumsum([0, *(len(x) for x in table.column("runs").to_pylist())])
    out = []
    for c, a, b in zip(table.column("chunk").to_pylist(), edges, edges[1:], strict=False):
        k = np.flatnonzero(masks[a:b]) + a
        if len(k):
            out.append((c, first[k].tobytes(), second[k].tobytes(), masks[k].tobytes(), -1, b""))
    return X.table_of(EARLIER, out)


def repeated(table: pa.Table, hot: int) -> pa.Table:
    """chunk, part, keys and hot: of the anchors that each chunk sent, those with several different runs in all chunks, and of these those with more than `hot`."""
    sent, times = X.joined(table, "keys", "<u4"), X.joined(table, "times", "<u2")
    keys, at = np.unique(sent, return_inverse=True)
    total = np.bincount(at, weights=times, minlength=len(keys))[at]
    edges, rows = np.cumsum([0, *(len(x) // 4 for x in table.column("keys").to_pylist())]), []
    for c, p, a, b in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), edges, edges[1:], strict=False):
        own, n = sent[a:b], total[a:b]
        rows.append((c, p, own[n > 1].tobytes(), own[n > hot].tobytes()))
    return X.table_of(REPEATED, (r for r in rows if r[2]))


def hot_keys(answers: pa.Table) -> np.ndarray:
    rows = zip(answers.column("part").to_pylist(), answers.column("hot").to_pylist(), strict=True)
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(X.numbers(k, "<u4").astype(np.uint64) | (np.uint64(part) << np.uint64(32)) for part, k in rows if k)]))


def remove_repeats(docs: DataFrame, length: int = 50, readable: bool = False, most_runs: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the bytes that stay; text itself is unchanged.

    A byte of a text's UTF-8 goes if a string of `length` bytes covers it that also starts in a document with a smaller
    doc_id, judged on the input. n_spans counts maximal removed runs. kept is binary, as a cut may part a character; if `readable`, it is a string without the characters that
    a cut parts. An anchor with more than `most_runs` different runs has its strings sent one by one.

    A null text counts as empty; an empty table stays empty; texts under `length` bytes are untouched; a null doc_id counts as larger than any; rows
    with equal ids don't count as each other's repeats. Columns of docs of these names are replaced.
    """
    if not GRAM < length <= GRAM + 63 - 12:
        raise ValueError(f"length: {GRAM + 1} to {GRAM + 51}")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    total = text_bytes(docs)
    key_parts, parts = pieces(total, 64 << 20, 12), pieces(total, CHUNK, 12)
    chunked = X.by_chunk(docs, pieces(total, CHUNK, 12))

    def runs_of(table: pa.Table):
        own, who = X.texts(table), X.ids(table)
        for lo, hi in blocks(own):
            yield Runs(own[lo:hi], length), who[lo:hi], own[lo:hi]

    def send_anchors(table: pa.Table) -> pa.Table:
        """The anchors of a chunk and how many different runs of it each has."""
        value, first, second = (np.concatenate(c) for c in zip(*((r.value, r.first, r.second) for r, _, _ in runs_of(table)), strict=True))
        order = np.lexsort((second, first))
        edge = np.ones(len(order), bool)
        edge[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        keys, times = np.unique(X.coded(value[order[edge]], key_parts), return_counts=True)
        columns = [keys.astype(np.uint32), np.minimum(times, 65535).astype(np.uint16)]
        return X.table_of(KEYS, ((part, table.column("chunk")[0].as_py(), k.tobytes(), t.tobytes()) for part, (k, t) in X.dealt(keys >> np.uint64(32), key_parts, columns)))

    def send_runs(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows or not answers.num_rows:
            return SENT.empty_table()
        known, hot, held = X.known(answers), hot_keys(answers), []
        for r, who, _ in runs_of(docs_):
            codes = X.coded(r.value, key_parts)
            asked, of_hot = X.among(codes, known), X.among(codes, hot)
            r.cut(of_hot)
            k = np.flatnonzero(np.append(asked[~of_hot], np.ones(len(r.start) - int((~of_hot).sum()), bool)))
            strings = np.array([r.raw[a:b] for a, b in zip(r.start[k].tolist(), r.end[k].tolist(), strict=True)], object)
            held.append((strings, r.count[k].astype(np.uint8), who[r.text[k]], r.value[k], r.first[k], r.second[k].astype(np.uint32)))
        strings, count, owner, value, first, second = (np.concatenate(c) for c in zip(*held, strict=True))
        if not len(first):
            return SENT.empty_table()
        owner = X.same_before(first, second, owner)
        order = np.lexsort((second, first))
        edge = np.ones(len(order), bool)
        edge[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        k, chunk = order[edge], docs_.column("chunk")[0].as_py()
        low = value.astype(np.uint32)  # tells anchors of a part apart well enough: runs of two that look the same are only ranked in vain

        def packed(part: int, cut: list[np.ndarray]) -> tuple:
            whole = b"".join(cut[0])
            return (part, chunk, pa.compress(whole, codec="zstd", asbytes=True), *(c.tobytes() for c in cut[1:]), len(whole))

        return X.table_of(SENT, (packed(part, cut) for part, cut in X.dealt(value[k], parts, [c[k] for c in (strings, count, owner, low, first, second)])))

    out = T.StructType([*chunked.drop("chunk").schema, *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if readable else T.BinaryType())])

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        held, hot = list(runs_of(docs_)), hot_keys(answers)
        for r, _, _ in held:
            r.cut(X.among(X.coded(r.value, key_parts), hot))
            r.codes = None  # not needed from here on
        first, second, owner = (np.concatenate(c) if held else np.zeros(0, np.uint64) for c in (([r.first for r, _, _ in held]), [r.second for r, _, _ in held], [w[r.text] for r, w, _ in held]))
        count = np.concatenate([r.count for r, _, _ in held]) if held else np.zeros(0, np.int64)
        masks = np.zeros(len(first), np.uint64)
        if len(X.joined(answers, "first")):
            a, b, m = X.joined(answers, "first"), X.joined(answers, "second", "<u4"), X.joined(answers, "masks")
            order = np.argsort(a)
            pos = order[np.minimum(np.searchsorted(a[order], first), len(a) - 1)]
            masks = np.where((a[pos] == first) & (b[pos] == second.astype(np.uint32)), m[pos], np.uint64(0))
        copied = X.same_before(first, second, owner) < owner  # another document of the chunk has the whole run
        masks[copied] = (np.uint64(1) << count[copied].astype(np.uint64)) - np.uint64(1)
        columns, at = ([], [], [], []), 0
        for r, _, own in held:
            mine = masks[at : at + len(r.start)]
            at += len(r.start)
            hit = np.flatnonzero(mine)
            rows = np.repeat(hit, r.count[hit])
            inner = np.arange(len(rows)) - np.repeat(np.cumsum(r.count[hit]) - r.count[hit], r.count[hit])
            gone_at = (r.start[rows] + inner)[(mine[rows] >> inner.astype(np.uint64)) & np.uint64(1) == 1]
            cover = np.bincount(gone_at, minlength=len(r.data) + 1) - np.bincount(gone_at + length, minlength=len(r.data) + 1)
            gone = np.cumsum(cover)[: len(r.data)] > 0
            for t, end in zip(own, r.ends.tolist(), strict=True):
                g = gone[end - len(t) : end]
                removed = int(g.sum())
                columns[0].append(len(t))
                columns[1].append(removed)
                columns[2].append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0)
                left = r.data[end - len(t) : end][~g].tobytes() if removed else t
                columns[3].append(left.decode("utf-8", "ignore") if readable else left)
        table = docs_.drop_columns(["chunk"])
        for name, values, kind in zip(("n_bytes", "n_removed", "n_spans", "kept"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string() if readable else pa.binary()), strict=True):
            table = table.append_column(name, pa.array(values, kind))
        return table

    anchored = chunked.groupBy("chunk").applyInArrow(send_anchors, KEYS_DDL).groupBy("part").applyInArrow(lambda t: repeated(t, most_runs), "chunk int, part int, keys binary, hot binary")
    sent = X.with_answers(chunked, anchored, send_runs, "part int, chunk int, strings binary, runs binary, owners binary, anchors binary, first binary, second binary, size long")
    gone = sent.groupBy("part").applyInArrow(lambda t: compare(t, length), EARLIER_DDL)
    none = [F.lit(b"").alias(c) for c in ("first", "second", "masks")]
    gone = gone.unionByName(anchored.where(F.octet_length("hot") > 0).select("chunk", *none, "part", "hot"))
    return X.answered(docs, X.with_answers(chunked, gone, remove, out), ["n_bytes", "n_removed", "n_spans", "kept"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
