import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigtables.llm import media, packing, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, sequence_id string, n_tokens string"
TEXTS = [None, "", " ", "a", "x  y\n\n z ", "Né à Zürich 漢字　 ok\tend\r\n", "don't  stop\n", "\n", "tail ", "same text", "same text", "word " * 5000, " " * 400_000 + "x", "a" + "\n" * 9_999 + "b", "ab" * 50_000, "ab  cd  e", "<|endoftext|> 12345 !!", "a<|endoftext|>b", " <|endoftext|><|endoftext|> <|endoftext|", "x<|endoftext|>" + " " * 12_000 + "<|endoftext|>", "a\nb\nc d", "\x1c x\x00y 🎉🎉"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    more = ["".join(rnd.choice("ab é\n.,'s19") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 9, "x", "y") for i, t in enumerate(TEXTS + more)] + [(9, "same text", None, None, None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def token_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_against_tokenizers(spark, docs):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, *args).collect()
    want, rows = Counter(), docs.collect()
    for r, ids in zip(rows, token_ids([r.text or "" for r in rows]), strict=True):
        ids = [*ids, 0]
        at = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in got) // 2048)
    assert packing.pack_documents(empty(spark), *args).count() == 0


def test_added_tokens_may_be_ordinary_text():
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
    assert np.frombuffer(packing.ByteBpe(*args).ids("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]
    plain = packing.ByteBpe(*args, spelled=True)
    assert 50256 not in np.frombuffer(plain.ids("a<|endoftext|>b"), "<u4") and 50256 not in np.frombuffer(plain.ids("<|endoftext|>" + " " * 12_000), "<u4")


def test_packing_keeps_columns_of_any_name(spark):
    names = ["length", "doc_id", "piece", "row", "part", "nth", "at", "before", "sequence_id", "_part", "a b", "c.d"]
    rows = [tuple([n, i, 0, *(f"{c}{i}" for c in names[3:])]) for i, n in enumerate([60, 60, 40, 25, 15, 100])]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if k < 3 else 'string'}" for k, c in enumerate(names)))
    out = packing.pack(df, capacity=100)
    assert out.columns == [c for c in names if c != "sequence_id"] + ["sequence_id", "offset"]
    got = {r.doc_id: r for r in out.collect()}
    assert {i: (got[i].length, got[i]["_part"], got[i]["a b"], got[i]["c.d"]) for i in got} == {i: (r[0], f"_part{i}", f"a b{i}", f"c.d{i}") for i, r in enumerate(rows)}
    assert len({r.sequence_id for r in got.values()}) == 3
    with pytest.raises(ValueError):
        packing.pack(df, capacity=99)


def test_plan_uses_exact_complements():
    assert packing.plan({60: 3, 40: 2, 25: 1, 15: 1}, 100) == [(2, [60, 40]), (1, [60, 25, 15])]
    assert packing.plan({50: 1, 20: 1, 17: 1, 13: 1}, 100) == [(1, [50, 20, 17, 13])]
    rnd = random.Random(3)
    for _ in range(20):
        counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, 101), 60)}
        used = Counter()
        for times, lengths in packing.plan(counts, 100):
            assert sum(lengths) <= 100
            for n in lengths:
                used[n] += times
        assert used == counts


def test_token_counts_against_tokenizers(spark, docs):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    whole = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *pieces]
    oracle = Tokenizer(models.Unigram(whole, 0, True))
    for r in token_counts.count_tokens(docs, path).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        text = r.text or ""
        assert r.n_tokens == len(oracle.encode("▁" + text.replace(" ", "▁")).ids if text else []), text
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_token_counts_ties_and_unknown():
    c = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0)])
    assert c.count("ab") == (2, -3.0)  # at a tie the longer last piece
    assert c.count("a漢") == (5, -1.0 - 1.0 - 12.0)
    with pytest.raises(ValueError):
        token_counts.UnigramCounter([("a▁b", -1.0)])


def test_media_round_trip(spark, docs):
    for r in media.describe(media.store_texts(docs)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert media.describe(media.store_texts(empty(spark))).count() == 0
    assert media.clips(media.store_texts(docs)).groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_frames_of_all_values():
    x = np.random.default_rng(1).integers(0, 256, (50, 24, 24)).astype(np.uint8)
    x[3], x[4] = 255, 0
    frames = media.encode_frames(x)
    assert (media.decode_frames(frames) == x).all()
    back, fps = media.read_avi(media.write_avi(frames))
    assert back == frames and fps == 25
    whole = media.write_avi(frames)
    assert media.read_avi(whole[: whole.index(b"idx1")])[0] == frames
    with pytest.raises(ValueError):
        media.read_avi(b"RIFFxxxxWAVE")


def test_shots_find_a_hard_cut():
    dark, light = np.full((20, 24, 24), 10, np.uint8), np.full((20, 24, 24), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light])) == [(0, 20), (20, 40)]
    assert media.shots(dark) == [(0, 20)] and media.shots(dark[:0]) == []


def test_sharding(spark, docs):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"key"}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    by = {}
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in {r.shard, 40} and 0 <= r.shard < 40
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    grown = {(r.doc_id, r.shard) for r in sharding.shard_documents(docs, 41).collect()}
    assert {(r.doc_id, r.grown_shard) for r in got} == grown
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_sharding_follows_weights(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = {r.shard: r["count"] for r in sharding.rendezvous_shards(df, "k", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert 2 not in n and abs(n[1] / 20000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous_shards(df, "k", [])


def test_shards_by_scores_drawn_in_python(spark):
    import struct

    import xxhash

    ids = [*range(-5, 400), 2**62]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")).collect()}

    def score(key, shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), xxhash.xxh64_intdigest(struct.pack("<q", key), 42))
        return -np.log(((h & (2**53 - 1)) + 1) / 2**53)

    for i in ids:
        own = [score(i, s) for s in range(41)]
        assert got[i] == (int(np.argmin(own[:40])), int(np.argmin(own)))


def test_rows_of_any_kind_are_sharded_packed_and_stored(spark):
    df = spark.createDataFrame([(None, None, "a", None), (None, None, "a", None), (1, "", None, {"x": 1}), (2, "y" * 3_000_000, "b", {})], "doc_id long, text string, _part string, best map<string,int>")
    out = sharding.rendezvous_shards(df.withColumns({"row": df["_part"], "shard": df["_part"], "slot": df["_part"]}), "doc_id", [1.0, 2.0])
    assert out.columns == ["doc_id", "text", "_part", "best", "row", "shard", "grown_shard", "slot"] and out.count() == 4
    by = {}
    for r in out.collect():
        by.setdefault(r.shard, []).append(r.slot)
        assert r.row == r["_part"]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    files = media.store_texts(df)
    rows = media.describe(files.withColumn("media", F.when(F.col("doc_id") == 1, None).otherwise(F.col("media")))).collect()
    assert [r.payload_bytes for r in rows if r.doc_id == 1] == [None] and sorted(r.payload_bytes or 0 for r in rows) == [0, 576, 576, 3_000_384]
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(df, *args).collect()
    assert sorted(r.doc_id is None for r in packed if r.length == 1) == [False, True, True]
    counted = token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert sorted(r.n_tokens > 0 for r in counted) == [False, False, False, True]


class Bits:
    """An independent reader of lossless JPEG: a bit at a time, from the markers on."""

    def __init__(self, data):
        self.data, self.at, self.bit = data, 0, 0

    def next(self):
        out = self.data[self.at] >> (7 - self.bit) & 1
        self.bit += 1
        if self.bit == 8:
            self.bit, self.at = 0, self.at + 1 + (self.data[self.at] == 255)
        return out


def samples_of(jpeg):
    at, codes, side = 2, {}, None
    while True:
        marker, n = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + n]
        if marker == 0xC4:
            code, k = 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            side = int.from_bytes(body[1:3], "big")
        at += 2 + n
        if marker == 0xDA:
            break
    bits, out = Bits(jpeg[at:-2]), []
    for i in range(side * side):
        code = length = 0
        while (length, code) not in codes:
            code, length = code << 1 | bits.next(), length + 1
        size, diff = codes[length, code], 0
        for _ in range(size):
            diff = diff << 1 | bits.next()
        if size and diff < 1 << (size - 1):
            diff -= (1 << size) - 1
        out.append((128 if i == 0 else out[i - side] if i % side == 0 else out[i - 1]) + diff)
    return out


def test_frames_by_an_independent_reader():
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.integers(0, 256, (3, 24, 24)), rnd.integers(97, 123, (3, 24, 24)), np.full((1, 24, 24), 255)]).astype(np.uint8)
    for frame, jpeg in zip(x, media.encode_frames(x), strict=True):
        assert samples_of(jpeg) == frame.ravel().tolist()
