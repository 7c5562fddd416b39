"""Removal of repeated word passages by level-wise doubling of repeated windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtables.llm import _exchange as X
from sigtables.llm._tables import pieces, text_bytes
from sigtables.llm._text import Words, anchors, blocks, rolling

#: Bytes of text in a chunk of documents.
CHUNK = 4 << 20
SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("docs", pa.binary()), ("often", pa.binary())])
EARLIER = pa.schema([("chunk", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("docs", pa.binary())])


class Levels:
    """The lengths of windows: window, its half, and the half of that, each rounded up.

    A window of a length holds one of the next shorter length at its start and one at its end.
    """

    def __init__(self, window: int):
        if not 4 <= window <= 200:
            raise ValueError("window: 4 to 200 words")
        self.window, self.half = window, -(-window // 2)
        self.seed = max(-(-self.half // 2), window - 63)
        self.half = max(self.half, min(2 * self.seed, window))

    def seeds(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each window inside one text, value of its seed, place of its seed)."""
        grams = rolling(w.hash, self.seed)
        value, place = anchors(grams, self.window - self.seed + 1)
        at = np.arange(len(value))
        inside = w.text[at] == w.text[at + self.window - 1] if len(at) else np.zeros(0, bool)
        return at[inside], value[inside], place[inside]


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with n_words, n_removed and kept, the words that stay joined by spaces; text itself is unchanged.

    Words are runs of other bytes than space and 9 to 13. A word goes if a window of `window` neighbouring words covers it
    that also starts in a document with a smaller doc_id, judged on the input. Level by level: of each window the seed,
    a quarter-length run chosen by its hash, must be repeated somewhere; then the run of twice that length around the seed
    that lies in the window; then the window itself. Only what one level finds repeated is extended for the next, up to
    `window`, beyond which no more is removed.

    Windows are equal if two independent 64-bit hashes of their words are.

    A null text counts as empty and keeps nothing; texts under `window` words are untouched; a null doc_id counts as
    larger than any; rows with equal ids don't count as each other's repeats. Columns of docs of these names are replaced,
    all others stay as they are; an empty table stays empty.
    """
    docs = docs.drop("n_words", "n_removed", "kept")
    size = text_bytes(docs)
    parts = pieces(size, 64 << 20, 12)
    chunked, level = X.by_chunk(docs, pieces(size, CHUNK, 12)), Levels(window)
    keys = "part int, chunk int, keys binary, often binary"

    def chunk_of(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def words_of(table: pa.Table):
        own, who = X.texts(table), X.ids(table)
        for lo, hi in blocks(own):
            yield Words(own[lo:hi]), who[lo:hi], lo

    def send_seeds(table: pa.Table) -> pa.Table:
        found = []
        for w, _, _ in words_of(table):
            _, value, place = level.seeds(w)
            found.append(value[np.diff(place, prepend=-1) != 0])
        return X.send_keys(chunk_of(table), np.concatenate(found), parts)

    def doubled(w: Words, place: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the runs of half length that start `before` words before each place, and which of them there are."""
        runs = rolling(w.hash, level.half)
        at = place - before
        good = (at >= 0) & (at < len(runs))
        at = np.where(good, at, 0)
        if len(runs):
            good &= w.text[at] == w.text[np.minimum(at + level.half, len(w.text)) - 1]
            return runs[at], good
        return np.zeros(len(at), np.uint64), good & False

    back = level.half - level.seed

    def send_halves(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows or not answers.num_rows:
            return KEYS_EMPTY
        seeds, found = X.known(answers), []
        for w, _, _ in words_of(docs_):
            _, value, place = level.seeds(w)
            place = np.unique(place[X.among(X.coded(value, parts), seeds)])
            for before in (0, back):
                key, good = doubled(w, place, before)
                found.append(key[good])
        return X.send_keys(chunk_of(docs_), np.concatenate(found), parts)

    def send_windows(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows or not answers.num_rows:
            return SENT.empty_table()
        halves, found = X.known(answers), []
        for w, who, _ in words_of(docs_):
            at, _, place = level.seeds(w)
            late = place + level.half > at + level.window  # the run from the seed on is not inside
            key, good = doubled(w, place, 0)
            key_back, good_back = doubled(w, place, back)
            at = at[np.where(late, good_back & X.among(X.coded(key_back, parts), halves), good & X.among(X.coded(key, parts), halves))]
            if len(at):
                found.append((rolling(w.hash, window)[at], rolling(w.second, window, 1)[at], who[w.text[at]]))
        if not found:
            return SENT.empty_table()
        first, second, owner = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = X.same_least(first, second, owner, np.zeros(len(first), bool))
        chunk = chunk_of(docs_)
        return X.table_of(SENT, ((part, chunk, *(c.tobytes() for c in cut)) for part, cut in X.dealt(columns[0], parts, list(columns))))

    def earlier(table: pa.Table) -> pa.Table:
        """Of each chunk's windows those that are in several documents, and the least of these."""
        first, second, owner, often = (X.joined(table, c, k) for c, k in zip(("first", "second", "docs", "often"), ("<u8", "<u8", "<i8", "?"), strict=True))
        least = X.same_before(first, second, owner)
        back = often | (least < owner)
        sizes = np.cumsum([0, *(len(x) // 8 for x in table.column("first").to_pylist())])
        rows = ((c, *(x[a:b][back[a:b]].tobytes() for x in (first, second, least))) for c, a, b in zip(table.column("chunk").to_pylist(), sizes, sizes[1:], strict=False))
        return X.table_of(EARLIER, (r for r in rows if r[1]))

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        first, second, least = X.joined(answers, "first"), X.joined(answers, "second"), X.joined(answers, "docs", "<i8")
        order = np.argsort(first)
        first, second, least = first[order], second[order], least[order]
        counts, removed, kept = [], [], []
        for w, who, _ in words_of(docs_):
            cover = np.zeros(len(w.hash) + 1, np.int32)
            windows = rolling(w.hash, window) if len(first) else first
            if len(windows):
                pos = np.minimum(np.searchsorted(first, windows), len(first) - 1)
                at = np.flatnonzero((first[pos] == windows) & (w.text[: len(windows)] == w.text[window - 1 :]))
                if len(at):
                    k = pos[at]
                    own = at[(rolling(w.second, window, 1)[at] == second[k]) & (least[k] < who[w.text[at]])]
                    cover[own] += 1
                    cover[own + window] -= 1
            stays = np.cumsum(cover)[:-1] == 0
            n, left, texts = joined(w, stays)
            counts.append(n)
            removed.append(n - left)
            kept += texts
        table, none = docs_, [np.zeros(0, np.int64)]
        for name, values in (("n_words", pa.array(np.concatenate(counts or none))), ("n_removed", pa.array(np.concatenate(removed or none))), ("kept", pa.array(kept, pa.binary()).cast(pa.string()))):
            table = table.append_column(name, values)
        return table.drop_columns(["chunk"])

    seeds = X.repeated(chunked.groupBy("chunk").applyInArrow(send_seeds, keys))
    halves = X.repeated(X.with_answers(chunked, seeds, send_halves, keys))
    windows = X.with_answers(chunked, halves, send_windows, "part int, chunk int, first binary, second binary, docs binary, often binary")
    gone = windows.groupBy("part").applyInArrow(earlier, "chunk int, first binary, second binary, docs binary")
    out = T.StructType([*chunked.drop("chunk").schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return X.answered(docs, X.with_answers(chunked, gone, remove, out), ["n_words", "n_removed", "kept"])


def joined(w: Words, stays: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of each text, those of them that stay, and these joined by single spaces."""
    n = np.diff(w.first)
    size = np.where(stays, w.end - w.start + 1, 0)
    edge = np.concatenate([[0], np.cumsum(size)])[w.first]  # a space follows each word
    left = np.concatenate([[0], np.cumsum(stays)])[w.first]
    step = np.zeros(len(w.data) + 1, np.int8)
    step[w.start[stays]] += 1
    step[w.end[stays] + 1] -= 1  # the next word starts there at the earliest
    mask = np.cumsum(step, dtype=np.int8)[:-1] > 0
    raw = np.where(w.gap, np.uint8(32), w.data)[mask].tobytes()
    return n, np.diff(left), [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


KEYS_EMPTY = X.KEYS.empty_table()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

