import hashlib
import random
import re

import numpy as np
import pytest

from sigtables.llm import repeated_bytes, repeated_words
from sigtables.llm._text import anchors

SCHEMA = "doc_id long, text string, kept string, _chunk string"


def corpus(seed):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choice(["aa", "bé", "c", "dd,", "ee\n"]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(20, 130))) for _ in range(6)]
    rows = [(5, None), (6, ""), (7, " \t\n "), (8, "x " * 300), (9, "x " * 260), (10, "a" * 200), (11, "a" * 120), (12, passages[0]), (12, passages[0]), (13, passages[0]), (14, passages[0] + passages[1])]
    for i in range(15, 70):
        t = "".join(rnd.choice(passages)[rnd.randint(0, 40) :] if rnd.random() < 0.5 else f" new{rnd.random()} words" * rnd.randint(1, 30) for _ in range(rnd.randint(1, 6)))
        rows.append((i, t))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    rows, n = corpus(seed), 50
    owner = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            owner[b[i : i + n]] = min(d, owner.get(b[i : i + n], d))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if owner[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = repeated_bytes.digest(spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    many = spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA)
    plain, strings = (repeated_bytes.remove_repeats(many, most_runs=n).select("doc_id", "n_removed", "n_spans", "kept").collect() for n in (repeated_bytes.HOT, 2))
    assert sorted(map(str, plain)) == sorted(map(str, strings))


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows, n = corpus(seed), 50
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - n + 1):
            owner[tuple(w[i : i + n])] = min(d, owner.get(tuple(w[i : i + n]), d))
    want = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if owner[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 500
    got = repeated_words.digest(spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_with_a_run_twice_in_a_window(spark):
    rnd, rows = random.Random(7), []
    for i in range(400):  # G X G Y of 13, 17, 13 and 7 words, each text as two whole documents
        g, x, y = (" ".join(f"{i}{rnd.random()}" for _ in range(n)) for n in (13, 17, 7))
        rows += [(2 * i, f"{g} {x} {g} {y}"), (2 * i + 1, f"{g} {x} {g} {y}")]
    rows += [(1000 + i, " ".join(f"own{rnd.random()}" for _ in range(rnd.randint(1, 70)))) for i in range(100)]
    rnd.shuffle(rows)
    got = repeated_words.digest(spark.createDataFrame([(d, t, "k", "c") for d, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: 50 if d < 1000 and d % 2 else 0 for d, _ in rows}


@pytest.mark.parametrize("width", [1, 2, 35, 38, 63, 64])
def test_anchors_are_the_leftmost_least_grams(width):
    rnd = np.random.default_rng(width)
    for n in (0, width - 1, width, width + 1, 500):
        grams = rnd.integers(0, 12, n).astype(np.uint64) << np.uint64(60)
        value, place = anchors(grams, width)
        want = [i + int(np.argmin(grams[i : i + width])) for i in range(max(0, n - width + 1))]
        assert place.tolist() == want and value.tolist() == (grams[want] >> np.uint64(6)).tolist()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repeated_bytes.remove_repeats(none).count() == 0 and repeated_words.remove_repeats(none).count() == 0


def test_null_ids_own_nothing(spark):
    text = "some words that are repeated in here " * 20
    df = spark.createDataFrame([(None, text, "", ""), (3, text, "", "")], SCHEMA)
    for module in (repeated_bytes, repeated_words):
        got = {r.doc_id: r.n_removed for r in module.digest(df).collect()}
        assert got[3] == 0 and got[None] > 0


def test_readable_leaves_out_parted_characters(spark):
    same = "".join(chr(233 + i % 7) + str(i) for i in range(40))
    rows = [(1, same), (2, "éè" + same.encode()[1:].decode("utf-8", "ignore") + " own"), (3, None), (4, "short é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in repeated_bytes.remove_repeats(df).collect()}
    got = {r.doc_id: r for r in repeated_bytes.remove_repeats(df, readable=True).collect()}
    assert {d: r.kept for d, r in got.items()} == raw and got[2].n_removed > 0
    assert got[3].kept == "" and got[4].kept == "short é"


def test_words_that_a_polynomial_hash_confuses(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    rest = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeated_words.digest(df).collect()} == {1: 0, 2: 0, 3: 50}


def test_columns_of_any_name_stay(spark):
    text = "some words that are repeated in here " * 20
    schema = "chunk string, part string, doc string, `a b` int, text string, doc_id long, docs int, kept int"
    df = spark.createDataFrame([("c", "p", "d", 1, text, 1, 5, 0), ("e", None, "f", 2, text, 2, None, 0)], schema)
    for module in (repeated_bytes, repeated_words):
        out = module.remove_repeats(df)
        assert out.columns[:7] == df.columns[:7] and out.columns[-1] == "kept"
        got = sorted(out.collect(), key=lambda r: r.doc_id)
        assert [r[:7] for r in map(tuple, got)] == [r[:7] for r in map(tuple, df.orderBy("doc_id").collect())] and got[1].n_removed > 0


def test_many_rows_of_one_id_are_dealt_to_several_chunks(spark):
    from sigtables.llm import _exchange

    df = spark.createDataFrame([(i % 2 or None, f"text {i}") for i in range(400)], "doc_id long, text string")
    assert _exchange.by_chunk(df, 8).groupBy("doc_id").agg({"chunk": "max"}).count() == 2
    assert _exchange.by_chunk(df, 8).select("chunk").distinct().count() == 8
