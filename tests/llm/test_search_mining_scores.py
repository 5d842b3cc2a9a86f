"""Ranked search, hard negatives and the quality classifier against plain Python."""

import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from odd_tables import EXTRA, empty, odd, odd_rows  # noqa: F401 (fixtures)
from pyspark.sql import functions as F

from tidewatch.llm import covertree, discriminant, lexsearch, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(brute.lower_ascii(text or ""))


def ranking(docs, items, k):
    """docs, items: [(id, text)] -> sorted [(item_id, rank, doc_id, score)]."""
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x for *_, x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for doc, c, size in docs:
            m = 50 + (50 * size * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & set(c)
            )
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(found[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r)))


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r)))


@pytest.fixture(scope="module")
def odd_items(spark):
    items = [
        (1, "Alpha beta, GAMMA; naïve café 日本語"), (1, "Alpha beta, GAMMA; naïve café 日本語"), (2, None), (3, ""), (4, " .,; "),
        (5, "word1 other2 word976 end"), (None, "alpha upsilon"), (6, "nowhere else"), (7, "a b a B"), (8, "password AKIA 4111"),
    ]
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in EXTRA})


@pytest.mark.parametrize("k, block_rows", [(50, 200_000), (3, 5)])
def test_ranked_search_on_odd_rows(spark, odd, odd_rows, odd_items, k, block_rows):
    got = as_rows(lexsearch.search(lexsearch.build_index(odd), odd_items, k, block_rows))
    want = ranking([(r[0], r[1]) for r in odd_rows], [(r.item_id, r.text) for r in odd_items.collect() if r.text], k)
    assert got == want


def test_ranked_search_on_a_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = as_rows(queries.op11_ranked_search(spark, SF))
    assert got == ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)


def test_ranked_search_of_empty_tables(spark, odd, empty, odd_items):
    assert lexsearch.search(lexsearch.build_index(empty), odd_items).count() == 0
    assert lexsearch.search(lexsearch.build_index(odd), odd_items.limit(0)).count() == 0


def test_sketch_bounds_hold_and_leave_documents_out():
    """Bounds are never below scores, frequencies above 255 included, and a
    document that cannot reach the threshold is not rescored."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, size=int(rng.integers(1, 400))) % 5000) for _ in range(300)]
    texts += ["t1 " * 700, "t2 " * 255 + "rare", ""]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    rows = lexsearch._index_rows(part)
    hashes, off = lexsearch.term_hashes(pa.array(["t1 t2 t77 t1234", "rare t1", "t4000 t4001"]))
    term = np.concatenate([np.unique(hashes[a:b]) for a, b in zip(off, off[1:])])
    query = np.repeat([11, 22, 33], [4, 2, 2])
    weights = dict(zip(term.view(np.int64).tolist(), [900, 7000, 300, 1500, 20, 8000, 4000, 10], strict=True))
    block = lexsearch.QueryBlock(query, [1] * 8, term, weights, len(texts) - 1, int(np.sum(rows.column("n_terms").to_numpy())))
    n = rows.column("n_terms").to_numpy()
    m = block.lengths(n)
    bounds = block.bounds(m, *lexsearch._unpacked(rows.column("sketch"), np.uint8))
    lists, cut = lexsearch._unpacked(rows.column("terms"), np.uint64)
    scores = block.scores(m, lists, lexsearch._unpacked(rows.column("tfs"), np.uint32)[0], cut)
    assert (bounds >= scores).all()
    best, counted = lexsearch._Best(3, 5), [0]
    lexsearch._rescore(block, best, rows, counted)
    assert 0 < counted[0] < len(texts) / 2
    for q in range(3):
        want = sorted([(-s, d) for d, s in enumerate(scores[:, q]) if s > 0])[:5]
        assert [(-s, d) for q_, s, d, _ in best.rows.tolist() if q_ == q] == want


def mined(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """rows: [(vec_id, label, tuple of whole numbers)] -> sorted result rows."""
    rows = list(dict.fromkeys(rows))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, la, va in rows:
        if a is None or a % every:
            continue
        others = [((-dot(va, v), i is None, i or 0), i, lab) for i, lab, v in rows if i != a]
        others.sort(key=lambda x: x[0])
        for (ps, *_), p, lab in [x for x in others if x[2] == la][:positives]:
            ps = -ps
            fit = [(i, -s) for (s, *_), i, lab in others if lab != la and low * ps <= 100 * -s <= high * ps]
            out += [(a, p, r, i, ps, s) for r, (i, s) in enumerate(fit[:negatives], 1)]
    return sorted(out, key=str)


def mine(spark, rows, every=50, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(3)
    return sorted(map(tuple, covertree.mine_hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()), key=str)


def clustered(n, seed, d=6, groups=8, spread=25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 150
    x = np.floor(centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * spread).astype(int)
    return [(i, int(rng.integers(0, 3)), tuple(map(int, v))) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread", [1, 25, 400])
def test_hard_negatives_on_clusters(spark, spread):
    rows = clustered(600, spread, spread=spread)
    assert mine(spark, rows, every=20) == mined(rows, every=20)


def test_hard_negatives_on_odd_vectors(spark):
    rows = clustered(120, 3)
    rows += [(50, 1, rows[0][2]), (50, 1, rows[0][2]), (50, 2, rows[1][2]), (None, 1, rows[0][2]), (None, 0, rows[0][2])]
    rows += [(500 + i, i % 2, (7, 7, 7, 7, 7, 7)) for i in range(300)]  # copies of one vector
    rows += [(900, 1, ()), (901, 0, (3,)), (902, 1, (0,) * 6), (950, 2, (0,) * 6), (1000, 5, (1, 2, 3)), (1050, 0, tuple(-x for x in rows[0][2]))]
    assert mine(spark, rows) == mined(rows)
    assert mine(spark, rows[:1]) == [] and mine(spark, []) == []
    zeros = [(i, i % 2, (0, 0)) for i in range(60)]
    assert mine(spark, zeros) == mined(zeros)


def test_hard_negatives_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, tuple(int(x) for x in rng.integers(-(2**27), 2**27, 4))) for i in range(150)]
    assert mine(spark, rows) == mined(rows)


def test_which_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1], 1), (2, [0.1, None], 1), (3, [nan, 0.0], 1), (4, [inf, 0.0], 1), (5, None, 1), (6, [0.1, 0.1], None), (7, [], 2), (None, [1.0, 2.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = covertree.scaled_vectors(df, "vec_id", "embedding", F.col("label")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, [25, -26]), (7, 2, []), (None, 3, [256, 512])], key=str)


def test_cover_tree_invariants_and_skipping():
    points = np.array([v for *_, v in clustered(3000, 9, spread=8)], float)
    largest = math.sqrt((points**2).sum(axis=1).max())
    tree = covertree.CoverTree(points, largest)
    top = tree.radius[0]
    leaves = [n for n in range(len(tree.centre)) if not tree.children[n]]
    assert sorted(np.concatenate([tree.members[n] for n in leaves])) == list(range(3000))
    for n, kids in enumerate(tree.children):
        assert (tree._angles(tree.centre[n], tree.members[n]) <= tree.radius[n] + 1e-12).all()
        if kids:
            net = top / covertree.BASE ** tree.level_of[kids[0]]
            centres = np.array([tree.centre[c] for c in kids])
            assert tree.centre[kids[0]] == tree.centre[n]  # nested
            assert all(tree.radius[c] <= net for c in kids)  # covered
            for c in centres:
                assert (tree._angles(c, centres[centres != c]) > net).all()  # separated
    # one query: best-first descent leaves most nodes of clustered points aside
    asked = covertree.Queries(points[:1], np.array([0]), np.array([0]), np.array([0]), np.array([-(2**62)]), np.array([2**62]))
    seen = [0]
    same = np.zeros(3000, np.int64)
    window, score, point = covertree.best_first(tree, np.arange(3000), np.ones(3000, bool), same, asked, True, 5, seen)
    dot = (points @ points[0]).astype(np.int64)
    want = sorted((-s, i) for i, s in enumerate(dot) if i)[:5]
    assert [(-s, i) for s, i in zip(score, point)] == want
    assert seen[0] < len(tree.centre) / 2


def test_hard_negatives_of_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    own = [
        (r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, tuple(math.floor(256 * x) for x in r.embedding)) for r in rows
    ]
    got = sorted(map(tuple, queries.op12_hard_negatives(spark, SF).collect()), key=str)
    assert got == mined(own)


def test_text_features_of_whole_texts():
    texts = ["", None, "One two two two. One!\n#x 12 é", "abc " * 400_000]
    x = discriminant.text_features(pa.array(texts))
    col = dict(zip(discriminant.FEATURES, x.T))
    assert np.allclose(col["words"], np.log1p([0, 0, 8, 400_000]))
    chars = 29
    assert np.isclose(col["symbols"][2], math.log(1.5 / (chars + 1)))
    assert np.isclose(col["marks"][2], math.log(1.5 / (chars + 1)))
    assert np.isclose(col["digits"][2], math.log(2.5 / (chars + 1)))
    assert np.isclose(col["capitals"][2], math.log(2.5 / 17))
    assert np.isclose(col["twin_words"][2], math.log(1.5 / 9))  # "two two"; "two." and "one!" are others
    assert np.isclose(col["twin_words"][3], math.log(399_999.5 / 400_001))
    assert np.isclose(col["same_words"][2], math.log(9 / 8))
    counts = np.array(list(Counter(texts[2].encode()).values())) / len(texts[2].encode())
    assert np.isclose(col["entropy"][2], -(counts * np.log(counts)).sum())
    assert (x[0] == x[1]).all() and np.isfinite(x).all()


def test_discriminant_is_the_gaussian_log_density():
    rng = np.random.default_rng(0)
    d = len(discriminant.FEATURES)
    a, b = rng.normal(size=(40, d)), rng.normal(size=(90, d)) * 2 + 1
    model = discriminant.QuadraticDiscriminant.from_moments(
        np.array([40, 90]), np.array([a.mean(0), b.mean(0)]), np.array([np.cov(a.T), np.cov(b.T)]), prior_rows=30
    )
    both = np.vstack([a, b])
    pooled = np.diag(((both - both.mean(0)) ** 2).sum(0) / 130)
    want = np.zeros((2, 130))
    for k, x in enumerate((a, b)):
        s = 30 / (30 + len(x))
        cov = (1 - s) * np.cov(x.T) + s * pooled
        diff = both - (len(x) * x.mean(0) + both.mean(0)) / (len(x) + 1)
        want[k] = -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1])
    z = want[1] - want[0] + math.log(91 / 41)
    assert np.allclose(model.log_density_difference(both), z)
    assert np.allclose(model.score(both), 1 / (1 + np.exp(-z)))


def test_quality_scores_use_spark_moments(spark):
    """The fitted model equals one fitted in NumPy to the training rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries.op13_quality_classifier(spark, SF).collect()}
    rows = docs.collect()
    x = discriminant.text_features(pa.array([r.text for r in rows]))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows])
    y = np.array([quality.get(r.doc_id, -1) for r in rows])
    sets = [x[(y == k) & ~held] for k in (0, 1)]
    cov = [np.cov(s.T) if len(s) > 1 else np.zeros((x.shape[1],) * 2) for s in sets]
    mean = [s.mean(0) if len(s) else np.zeros(x.shape[1]) for s in sets]
    model = discriminant.QuadraticDiscriminant.from_moments(np.array([len(s) for s in sets]), np.array(mean), np.array(cov))
    for r, h, s in zip(rows, held, model.score(x)):
        assert got[r.doc_id].held_out == h and math.isclose(got[r.doc_id].score, s, rel_tol=1e-6, abs_tol=1e-9)
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.7)


def test_quality_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = out.filter("held_out").select("quality", "predicted").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert len(bad) > 100 and np.mean(good) > 0.98 and np.mean(bad) < 0.02


def test_quality_scores_on_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, 1, 0), (3, 0, 0), (4, None, 0), (9, 7, 0), (None, 1, 0), (11, 1, 0), (10, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    got = discriminant.quality_scores(odd, labels, F.lit(True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    clean = {tuple(r) for r in discriminant.clean_labels(labels, "quality").collect()}
    assert clean == {(1, 1), (2, 0), (11, 1), (10, 0)}
    none = discriminant.quality_scores(odd, labels.limit(0), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    one = discriminant.quality_scores(odd, labels.filter("doc_id = 1"), F.lit(True)).collect()
    assert all(np.isfinite(r.score) for r in one)
    assert discriminant.quality_scores(empty, labels, F.lit(True)).count() == 0
