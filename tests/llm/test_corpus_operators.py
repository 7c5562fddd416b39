import random

import numpy as np

from sigtables.llm import decontamination, html_text, near_copies, toxicity

SCHEMA = "doc_id long, text string, node string, score string"


def prose(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ta", "su", "ri", "vo") for c in ("n", "s", "th", "lla", "m")]


def alignment(a, b):
    """The longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            row[j + 1], left = max(row[j], row[j + 1], left + 1) if x == y else max(row[j], row[j + 1]), row[j + 1]
    return row[-1]


def alike(a, b):
    a, b = (a or "").split(), (b or "").split()
    return alignment(a, b) / max(len(a), len(b)) if a or b else 1.0


def test_near_copies_against_brute_force(spark):
    rnd = random.Random(4)
    base = [prose(rnd, n, VOCABULARY) for n in (3, 30, 80, 150, 400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, base[0]), (4, base[0]), (5, base[0] + " x")]
    for i in range(6, 160):
        w = rnd.choice(base[1:]).split()
        for _ in range(rnd.randint(0, max(2, len(w) // 9))):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(VOCABULARY) + str(rnd.randint(0, 9))] * rnd.randint(0, 2)
        rows.append((i, " ".join(w) if rnd.random() < 0.8 else prose(rnd, 60, VOCABULARY)))
    rnd.shuffle(rows)
    owner, near = {d: d for d, _ in rows}, []

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a, s in rows:
        for b, t in rows:
            if a < b and (share := alike(s, t)) >= 0.8 - 1e-9:
                owner[max(root(a), root(b))] = min(root(a), root(b))
                near.append((a, b, share))
    docs = spark.createDataFrame([(d, t, "n", "s") for d, t in rows] + [(160, rows[9][1], "", "")], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_copies.digest(docs).collect()}
    want = {d: root(d) for d, _ in rows}
    assert got.pop(160) == got[rows[9][0]]
    assert all(want[c] == want[d] for d, c in got.items())  # nothing is joined that brute force doesn't join
    close = [(a, b) for a, b, share in near if share >= 0.9]
    assert len(close) > 500 and sum(got[a] == got[b] for a, b in close) >= 0.98 * len(close)
    assert sum(got[a] == got[b] for a, b, _ in near) >= 0.9 * len(near)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    none = spark.createDataFrame([], SCHEMA)
    assert near_copies.digest(none).count() == 0
    nulls = spark.createDataFrame([(None, base[3], "", ""), (None, base[3], "", ""), (7, base[4], "", "")], SCHEMA)
    assert sorted(map(str, (r.doc_id for r in near_copies.keep_one(nulls).collect()))) == ["7", "None"]
    dotted = near_copies.keep_one(docs.withColumn("a.b", docs.doc_id))
    assert dotted.columns[-1] == "a.b" and dotted.count() == kept.count()


def test_one_changed_word_in_ten_is_a_near_copy(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        w = prose(rnd, 300, VOCABULARY).split()
        v = list(w)
        for k in rnd.sample(range(300), 30):
            v[k] = f"new{k}"
        rows += [(2 * i, " ".join(w), "", ""), (2 * i + 1, " ".join(v), "", "")]
    got = {r.doc_id: r.class_id for r in near_copies.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(60)) >= 57


def test_blocks_reach_links_that_no_center_has(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rnd = random.Random(9)
    words, rows = prose(rnd, 200, VOCABULARY).split(), []
    for i in range(40):  # neighbours are alike, the ends of the chain are not
        words[5 * i] = f"new{i}"
        rows.append((i, " ".join(words), "", ""))
    assert {r.class_id for r in near_copies.digest(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_keep_one_with_repeated_and_null_ids(spark):
    rnd = random.Random(3)
    a, b, c, d = (prose(rnd, 100, VOCABULARY) for _ in range(4))
    rows = [(1, a), (1, b), (2, b + " more"), (None, c), (None, c), (None, c + " more"), (None, d), (5, d), (5, d)]
    got = near_copies.keep_one(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    kept = [(r.doc_id, r.text) for r in got if r.text[: len(c)] != c]
    assert sorted(kept) == sorted([(1, a), (1, b), (5, d)])
    assert len(got) == 4 and [r.doc_id for r in got if r.text[: len(c)] == c] == [None]


def test_alignment_against_every_cell():
    rnd = random.Random(13)
    for _ in range(400):
        n, kinds = rnd.randint(0, 90), rnd.choice([2, 5, 40, 1000])
        a = [rnd.randrange(kinds) for _ in range(n)]
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 2)] = [rnd.randrange(kinds) for _ in range(rnd.randint(0, 2))]
        x, y = (np.array(v, np.uint64) for v in (a, b))
        want = alignment(a, b)
        assert near_copies.common_words(x, y, max(len(a), len(b))) == want
        if want >= 0.8 * max(len(a), len(b), 1):
            assert near_copies.similarity(x, y) == want / max(len(a), len(b))
        else:
            assert near_copies.similarity(x, y) < 0.8 or not a and not b
    w = np.arange(100, dtype=np.uint64)
    assert near_copies.similarity(w, np.concatenate([w[50:], w[:50]])) < 0.6


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, prose(rnd, rnd.randint(15, 55), VOCABULARY[i % 7 :: 2]) + f" Answer{i}.") for i in range(20)] + [(20, None), (21, "")]
    rows, want = [(900, None), (901, "")], set()
    for d in range(120):
        t = prose(rnd, rnd.randint(0, 300), VOCABULARY)
        if d % 3 == 0:
            i = rnd.randrange(20)
            w = items[i][1].split()
            if d % 6 == 0:  # a paraphrase: some words are others
                for k in rnd.sample(range(len(w) - 1), len(w) // 10):
                    w[k] = "changed"
            t += "\n" + " ".join(w).upper() + ", " + prose(rnd, rnd.randint(0, 200), VOCABULARY)
            want.add((d, i))
        rows.append((d, t))
    docs = spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert len(want - got) <= 0.1 * len(want) and len(got - want) <= 2
    left = {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_long_items_are_found_wherever_they_stand(spark):
    rnd = random.Random(12)
    bench = [(i, prose(rnd, n, VOCABULARY) + f" Answer{i}.") for i, n in enumerate((64, 65, 100, 150, 180, 200, 214, 300, 700))]
    rows, want = [], set()
    for i, t in bench:
        for shift in range(0, 32, 5):  # against the grid of half passages
            w = t.split()
            if shift % 2:
                for k in rnd.sample(range(len(w) - 1), len(w) // 10):
                    w[k] = f"changed{k}"
            rows.append((len(rows), " ".join([prose(rnd, 64 + shift, VOCABULARY), *w, prose(rnd, 90, VOCABULARY)]), "", ""))
            want.add((len(rows) - 1, i))
    rows += [(1000 + i, prose(rnd, 900, VOCABULARY), "", "") for i in range(20)]
    found = decontamination.find_leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and all(r.lcs >= 0.89 for r in found)


def test_common_subsequence():
    assert decontamination.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
    assert decontamination.common_subsequence([], [1]) == 0 == decontamination.common_subsequence([1], [])


def pack(tiles):
    return [(np.array([len(t) for t in tiles], np.uint8).tobytes(), np.array([x for t in tiles for x in t], np.uint16).tobytes(), 1.0)]


def test_latent_basis_spans_the_leading_directions(spark):
    tiles = [[10 * (i % 3), 10 * (i % 3) + 1, *([100 + i] if i % 20 == 0 else [])] for i in range(60)]
    rows = [r for k in range(0, 60, 7) for r in pack(tiles[k : k + 7])]
    v = decontamination.latent_basis(spark.createDataFrame(rows, "sizes binary, places binary, length double"), np.ones(decontamination.DIMENSIONS), 3, 4)
    assert v.shape == (decontamination.DIMENSIONS, 3) and np.allclose(v.T @ v, np.eye(3), atol=1e-3)
    for k in range(3):
        x = np.zeros(len(v))
        x[[10 * k, 10 * k + 1]] = 0.5**0.5
        assert np.linalg.norm(v.T @ x) > 0.99


def test_latent_space_is_fitted_on_every_word(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "FIT_PASSAGES", 20)  # sums of many tasks, added in several steps
    monkeypatch.setattr(decontamination, "FAN", 2)
    rnd = random.Random(5)
    docs = [("the " if i % 2 else "") + prose(rnd, rnd.randint(1, 150), VOCABULARY) for i in range(300)] + [None, ""]
    bench = [prose(rnd, rnd.randint(20, 150), VOCABULARY) for _ in range(10)]
    seen = {}

    def watched(rows, idf, tasks):
        seen.update(rows=[(list(s), list(p), r.length) for r in rows.collect() for s, p in [(np.frombuffer(r.sizes, np.uint8), np.frombuffer(r.places, np.uint16))]], idf=idf)
        seen["basis"] = basis(rows, idf, tasks=tasks)
        return seen["basis"]

    basis = decontamination.latent_basis
    monkeypatch.setattr(decontamination, "latent_basis", watched)
    decontamination.find_leaks(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], SCHEMA).repartition(30), spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")).count()

    def tiles(texts):
        return sorted(len(set(w[k : k + 64])) for w in (t.split() for t in texts if t) for k in range(0, len(w), 64))

    assert sorted(x for s, _, length in seen["rows"] if length == 1 for x in s) == tiles(docs)
    assert sorted(x for s, _, length in seen["rows"] if length != 1 for x in s) == tiles(bench)
    n, idf, dense = len(tiles(docs)), np.zeros(decontamination.DIMENSIONS), []
    np.add.at(idf, [x for _, p, length in seen["rows"] if length == 1 for x in p], 1)
    idf = np.log((n + 1) / (idf + 1)) + 1e-3
    assert np.allclose(idf, seen["idf"])
    for s, p, length in seen["rows"]:
        for x in np.split(np.array(p), np.cumsum(s)[:-1]):
            v = np.zeros(len(idf))
            v[x] = idf[x]
            dense.append(length * v / np.linalg.norm(v))
    v = seen["basis"]
    a = np.array(dense)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    assert np.linalg.norm(a @ v) >= 0.999 * np.linalg.norm(a)  # the words are 81, less than the rank


def toxic_rows(rnd, n):
    rows = []
    for d in range(n):
        toxic = d % 4 == 0
        w = prose(rnd, 40, VOCABULARY).split()
        if toxic:
            for bad in rnd.sample(["horrid", "vilest", "rotten"], 2):
                w.insert(rnd.randrange(40), bad)
        if rnd.random() < (0.7 if toxic else 0.05):
            w.insert(3, "muslims")
        rows.append((d, " ".join(w), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(random.Random(1), 1000)
    docs = spark.createDataFrame([(d, t, "", "") for d, t, _ in rows] + [(5000, None, "", ""), (5001, "", "", "")], SCHEMA)
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[d].predicted, y) for d, _, y in rows if got[d].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.97 * len(held)
    assert toxicity.score(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_swaps_pull_scores_together(spark):
    rows = toxic_rows(random.Random(3), 600)
    docs = spark.createDataFrame([(d, t, "", "") for d, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    gaps = []
    for strength in (0.0, 20.0):
        s = toxicity.Scorer(toxicity.train(docs, labels, strength=strength))
        z = [np.log(p / (1 - p)) for p in (s.score("the muslims sing"), s.score("the atheists sing"))]
        gaps.append(abs(z[0] - z[1]))
    assert gaps[1] < 0.3 * gaps[0]
    assert toxicity.swaps("Women sing. They", [("women", "men")]) == {("women", "men"): 1}


def page(rnd, named):
    p = [prose(rnd, rnd.randint(20, 90), VOCABULARY).capitalize() + "." for _ in range(rnd.randint(2, 7))]
    menu = "".join(f"<li><a href='/{x}'>{x}</a>" for x in rnd.sample(VOCABULARY, 6))
    body = "".join(f"<p>{x} &amp; <i>more</i>" for x in p)
    wrap = f"<article>{body}</article>" if named else f"<div><div>{body}</div></div>"
    aside = "<div class=sidebar><p>Related &amp; more</p></div><form><p>Sign up now</p></form><script>var a='<p>no</p>'</script>"
    return f"<html><head><title>T</title></head><body><nav><ul>{menu}</ul></nav><!-- x -->{wrap}{aside}<footer><p>&copy; us</p></footer>", "\n\n".join(f"{x} & more" for x in p)


def test_pages_against_their_articles(spark):
    rnd = random.Random(6)
    pages = [page(rnd, i % 5 > 0) for i in range(150)]
    rows = [(i, f"u{i}", h, "t") for i, (h, _) in enumerate(pages)] + [(900, None, None, ""), (901, "u", "", ""), (902, "u", "<p>unclosed <b>x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert len(got) == len(rows) and got[900].text == "" == got[901].text and all(r.n_chars == len(r.text) for r in got.values())
    named = [got[i].text == t for i, (_, t) in enumerate(pages) if i % 5]
    plain = [got[i].text == t for i, (_, t) in enumerate(pages) if not i % 5]
    assert all(named) and sum(plain) >= 0.8 * len(plain)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_parse_and_decode():
    p = html_text.parse("<div>a <b>b</b>\n c<p>d<p>e<ul><li>f<li>g</ul></div>&lt;h")
    assert [t for _, t, _ in p.text] == ["a b c", "d", "e", "f", "g", "<h"]
    q = html_text.parse("<div><p>x</p><div><p>y</p></div></div>")
    assert html_text.decode(q, np.array([0, 1, 2, -3, 5.0])) == [False, True, True, True, True]
    assert html_text.decode(q, np.array([0, 1, 2, 0, -5.0])) == [False, True, True, True, False]
    assert html_text.decode(q, np.array([0, 1, -2, 0, 5.0]))[2:] == [False, True, True]
    assert html_text.parse("<" * 50 + "a href='x").tag == ["#root"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    rows = toxic_rows(rnd, 400)
    shared = prose(rnd, 30, VOCABULARY)
    docs = [(d, t + (" " + shared if d % 7 == 1 else ""), "en", "s", len(t)) for d, t, _ in rows] + [(1000, rows[1][1] + " " + shared, "en", "s", 1), (1001, None, None, None, None), (1002, rows[2][1] + ". Item: " + " ".join(VOCABULARY[:30]), "en", "s", 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(VOCABULARY[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage, df, seen = dict(corpus_pipeline.STAGES), source, {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, str(tmp_path))
        assert df.columns == source.columns, name
        df = spark.createDataFrame(df.collect(), source.schema)
        seen[name] = {r.doc_id: r.text for r in df.collect()}
    assert 380 * 0.75 <= len(seen["toxicity"]) <= 310 and 0 not in seen["toxicity"] and 1 in seen["toxicity"]
    assert 1000 not in seen["near copies"] and 1 in seen["near copies"]
    assert shared in seen["repeated bytes"][1] and shared not in seen["repeated bytes"].get(15, "")
    assert 1002 not in seen["decontamination"] and 1001 in seen["decontamination"]
    packed = stage["packing"](spark, df, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_fit_against_a_dense_reference():
    """The minimum that Adam finds is that of plain gradient descent on dense arrays, regulariser included."""
    rnd = np.random.default_rng(4)
    names = [*(f"w{i}" for i in range(8)), "muslims", "atheists"]
    x = (rnd.random((300, 10)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 8] + 0.3 * rnd.standard_normal(300) > 0.9).astype(float)
    pairs, strength, ridge = {("muslims", "atheists"): 3, ("atheists", "muslims"): 2}, 0.5, 1e-2
    m = toxicity.fit([np.flatnonzero(r).tolist() for r in x], y.astype(int).tolist(), names, pairs, strength, ridge, steps=3000)
    w, b = np.zeros(10), 0.0
    swap = np.zeros(10)
    swap[8], swap[9] = 1, -1
    for _ in range(60_000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w -= 0.3 * (x.T @ e + 2 * ridge * w + 2 * strength * (swap @ w) * swap)
        b -= 0.3 * e.sum()
    assert np.allclose([m.weights[n] for n in names], w, atol=2e-3) and abs(m.bias - b) < 2e-3
    again = toxicity.fit([np.flatnonzero(r).tolist() for r in x], y.astype(int).tolist(), names, dict(reversed(pairs.items())), strength, ridge, steps=3000)
    assert again == m


def test_repeated_ids_and_rows_of_labels_and_pages(spark):
    rows = toxic_rows(random.Random(2), 300)
    docs = spark.createDataFrame([(d, t, "", "") for d, t, _ in rows] + [(2, f"other {i}", "", "") for i in range(200)] + [(None, "horrid vilest", "", "")] * 3 + [(9001, "x " * 200_000 + "horrid", "", "")], SCHEMA)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(2, 0)] * 5, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels)
    assert got.count() == docs.count() and got.where("doc_id IS NULL AND NOT held_out").count() == 3
    rnd = random.Random(7)
    pages = [(i % 20 or None, f"u{i}", page(rnd, True)[0], "") for i in range(60)] + [(5, "u", "<div>" * 3000 + "<p>deep" + "<p>word " * 20_000, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    assert html_text.extract_pages(df).count() == len(pages)


def test_cosine_candidates_against_all_pairs(spark):
    """Every pair of a passage and an item that the word checks accept, over all pairs, is a candidate; nine in ten at least."""
    rnd = random.Random(21)
    words = [a + b for a in VOCABULARY[:60] for b in ("", "ra", "to")]
    items = [(i, prose(rnd, rnd.randint(20, 60), words)) for i in range(30)]
    docs = []
    for d in range(200):
        w = rnd.choice(items)[1].split()
        for k in rnd.sample(range(len(w)), int(len(w) * rnd.choice([0, 0.1, 0.2, 0.3, 0.4]))):
            w[k] = rnd.choice(words)
        docs.append((d, " ".join([prose(rnd, rnd.randint(0, 90), words), *w, prose(rnd, rnd.randint(0, 90), words)]), "", ""))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()}
    every = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench, cosine=-2.0).collect()}
    assert len(every) > 100 and found <= every and len(found) >= 0.9 * len(every)


def test_pipeline_on_empty_tables_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(VOCABULARY[:70])
    for name, rows in (("none", []), ("same", [(1, text, "en", "s", 1)] * 4 + [(1, "another " + " ".join(VOCABULARY[70:]), "en", "s", 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        got = sorted((r.doc_id or 0, r.length > 1) for r in out.collect())
        assert got == ([] if name == "none" else [(1, True), (1, True), (2, False)]), got
