import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest

from sigtables.llm import conversation_trie, ngram_join, queries, vector_codes

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(str(x) for _, x in sorted(zip(names, r, strict=True))) for r in found.fetchall()))
    got = sorted(tuple(str(r[n]) for n in sorted(names)) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and got == want and got


# conversations

TURNS = "conv_id long, turn long, role string, text string, node string, pos string, shard string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def trie(convs):
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), sum(len(q) == len(path) + 1 for q in below), sum(map(leaf, below)), sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def test_trie_against_brute_force(spark):
    rnd, rows = random.Random(3), []
    for c in [*range(0, 40), *range(100, 130), 1000, 1003, 5000, 7203, -5, -100, -98]:
        for k in range(rnd.choice([1, 2, 3, 6, 9])):
            rows.append((c, rnd.choice([k, k, None, 3]), rnd.choice(["user", "é", None, ""]), rnd.choice(["", None, "a", "b", "語 text"])))
    rows += [(2, 1, "user", "a")] * 3 + [(None, 1, "user", "lost")]
    got = collected(conversation_trie.digest(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(5)))
    assert got == trie(rebuilt(rows))


def test_trie_of_turnless_and_no_conversations(spark):
    assert conversation_trie.digest(spark.createDataFrame([], TURNS)).count() == 0
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(lone, 0, "user", "gone")]
    got = collected(conversation_trie.digest(spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)))
    assert got == trie({lone: []}) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_of_long_conversations_goes_on_from_band_to_band(spark):
    n = 2 * conversation_trie.BAND + 50
    rows = [(c, k, "user", f"{k}{'x' * (c == 4300 and k > n - 9)}") for c in (0, 6, 1234, 4300) for k in range(n - c % 3)]
    got = {(r.conv_id, r.depth): r for r in conversation_trie.trie(conversation_trie.numbered(spark.createDataFrame([(*r, "", "", "") for r in rows], TURNS)).unionByName(conversation_trie.bare(spark.createDataFrame([(c, 1) for c in (0, 6, 1234, 4300)], "conv_id long, x int")))).collect()}
    assert len(got) == n + 1 + (n - 4300 % 3) - (n - 8)
    assert got[0, 0].n_convs == got[0, n - 8].n_convs == 4 and got[0, 0].n_leaves == 2
    assert got[0, n].n_convs == 2 and got[0, n].n_children == 0
    assert got[0, 0].saved_tokens == sum((3 if d <= n - 8 else 2 if d <= n - 1 else 1) * len(str(d - 1)) for d in range(1, n + 1)) and got[4300, n - 7].saved_tokens == 0


# vectors

VECTORS = "vec_id long, embedding array<float>, label int, row string, error string, `a.b` int"


def codes(rows, parts=16):
    kept = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = sorted(((i is None, i or 0, v + [0] * (length - len(v)), lab) for i, v, lab in kept), key=lambda r: r[:3])
    width = length // parts
    cut = [[tuple(map(int, v[p * width : (p + 1) * width])) for p in range(parts)] for _, _, v, _ in kept]
    books = [[c[p] for c in cut[:64]] for p in range(parts)]
    near = lambda x, b: min((sum((a - y) ** 2 for a, y in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(2):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*held[k], strict=True)) if k in held else e for k, e in enumerate(books[p])]
    out, by = [], {}
    for (none, i, _, lab), c in zip(kept, cut, strict=True):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((None if none else i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[lab], sha) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("scale", [0.3, 3e4, 1e12])
def test_codes_against_brute_force(spark, scale):
    rnd = np.random.default_rng(7)
    made = (rnd.normal(size=(150, 20)) * scale).astype(np.float32).tolist()
    rows = [(i, v, int(i) % 3) for i, v in enumerate(made)] + [(5, made[5], 1), (5, made[9], None), (None, made[3], None), (200, None, 1), (201, [1.0, None], 1), (202, [math.nan] * 20, 2), (203, [math.inf] * 20, 2), (204, [], 1), (205, made[0][:3], 9)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], VECTORS).repartition(7)
    got = vector_codes.digest(df).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == [(a, b, e if e < 2**63 else None, t, h) for a, b, e, t, h in codes(rows)] or scale == 1e12
    if scale == 1e12:  # errors beyond a long are null, codes are exact
        assert sorted((str(r.vec_id), r.code) for r in got) == sorted((str(a), b) for a, b, *_ in codes(rows))
    whole = vector_codes.compress(df)
    assert whole.columns == ["vec_id", "embedding", "label", "row", "a.b", "code", "error", "label_error", "codebooks_sha256"] and whole.count() == len(got)
    assert vector_codes.digest(df.limit(0)).count() == 0 == vector_codes.digest(df.where("vec_id = 200")).count()


def test_products_are_exact_beyond_float64():
    rnd = np.random.default_rng(1)
    x, y = rnd.integers(-(2**29), 2**29, (2, 5, 6)), rnd.integers(-(2**29), 2**29, (2, 7, 6))
    want = np.matmul(x.astype(object), y.astype(object).transpose(0, 2, 1))
    assert (vector_codes.products(x, y) == want).all()


# shingle sets

DOCS = "doc_id long, text string, node string, component string, n_shingles string"


def shingle_set(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_join_against_brute_force(spark):
    rnd = random.Random(8)
    words = [a + b for a in ("Ka", "lo", "mé", "n\xa0") for b in ("ta", "SU", "ri", "vo", "x")]
    shared = " ".join(rnd.choice(words) for _ in range(70))
    texts = [None, "", " \t", "One", "one ", "one TWO", "one two three", "É", "é"]
    for _ in range(120):
        w = (shared if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(rnd.choice([9, 11, 40, 90])))).split(" ")
        texts.append(" ".join(w))
        for _ in range(rnd.randint(0, 3)):
            v = list(w)
            for _ in range(rnd.randint(1, 3)):
                v[rnd.randrange(len(v))] = rnd.choice(words) + str(rnd.randint(0, 3))
            texts.append(rnd.choice(["\n", "  ", " "]).join(v))
    texts.append(" ".join(str(i) for i in range(30_000)))
    texts.append(texts[-1] + " more")
    rows = list(enumerate(texts)) + [(3, "One"), (None, texts[40]), (None, "alone of no id")]
    sets, owner = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                owner[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(x for x in (least.get(root(i), math.inf), d if d is not None else math.inf))
    want = sorted(((d, len(sets[i]), None if least[root(i)] == math.inf else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).repartition(6)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.digest(docs).collect()), key=str) == want
    assert len({c for _, n, c in want if n}) < len(rows) * 0.8
    assert ngram_join.digest(docs.limit(0)).count() == 0


def test_prefixes_of_similar_sets_share_what_the_less_demanding_asks_for():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 80)
        a = set(rnd.sample(range(1000), n))
        b = set(a)
        for _ in range(rnd.randint(0, 1 + n // 15)):
            b.discard(rnd.choice(sorted(b)))
            b.add(rnd.randrange(1000))
        if not b or 100 * len(a & b) < 90 * len(a | b):
            continue
        df = {t: (t * 7919) % 500 + 2 for t in a | b}
        cut = []
        for s in (a, b):
            order = sorted(s, key=lambda t: (df[t], t))
            m, k = ngram_join.prefix_of(np.array([df[t] for t in order[: len(s) - ngram_join.needed(len(s)) + 8]], float), len(s))
            cut.append((m, set(order[:k])))
        assert len(cut[0][1] & cut[1][1]) >= min(cut[0][0], cut[1][0]) > 0


def test_chains_that_no_center_joins_are_joined_by_the_exact_step(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(w[3 * k :] + [f"z{i}" for i in range(3 * k)])) for k in range(30)]  # neighbours are alike, the ends are not
    got = {r.doc_id: r.component_id for r in ngram_join.digest(spark.createDataFrame([(*r, "", "", "") for r in rows], DOCS)).collect()}
    assert got == {k: 0 for k in range(30)}
