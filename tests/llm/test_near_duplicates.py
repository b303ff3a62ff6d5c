import random
import re

import numpy as np
import pytest

from panelspark.llm import covertree, hyperminhash
from panelspark.llm.components import components
from panelspark.llm.shingles import Powers, folded, shingle_set


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(20, 60)] + [(3, 3), (900, 800)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for l in links for x in l}, links)
    assert got == {k: v for k, v in want.items() if k != 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- documents


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def check_documents(spark, rows, **options):
    table = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, key string, id string")
    out = {r.doc_id: r for r in hyperminhash.near_duplicates(table, **options).collect()}
    sets = {i: word_set(t) for i, t in rows}
    known = sorted(i for i in sets if i is not None)
    links = [
        (a, b) for k, a in enumerate(known) for b in known[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = roots(known, links)
    assert len(out) == len({i for i, _ in rows})
    for i in known:
        assert (out[i].n_shingles, out[i].component_id, out[i].kept) == (len(sets[i]), want[i], want[i] == i), i
    return links


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "ÀB c"), (7, "àB c"), (None, "no id")]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 40, 150]))]
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((10 + len(rows), rng.choice([" ", "\n"]).join(words)))
    assert len(check_documents(spark, rows)) > 30


def test_hot_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "copy of one text that is long enough") for i in range(300)]
    check_documents(spark, rows, small=8, slice_=4000)


def test_no_documents(spark):
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    probe, table = hyperminhash.lending_order(130), hyperminhash.collision_table(130)
    for share in (0.0, 0.5, 0.85):
        errors = []
        for _ in range(60):
            n = 2000
            both = rng.integers(0, 2**63, int(n * 2 * share / (1 + share)), dtype=np.uint64)
            sides = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in "ab"]
            packed = [hyperminhash.registers_of(s << np.uint64(1), 130, probe)[None, :] for s in sides]
            errors.append(hyperminhash.estimated_jaccard(*packed, np.array([n]), np.array([n]), table)[0] - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_shingle_sets_have_the_right_size():
    for text in ("", "a", "a b", "a b c", "a b c a b c a b c", "É é x\x0by " * 50, "x" * 100000):
        assert len(shingle_set(folded(text), Powers())) == len(word_set(text))


# ---- embeddings


def clustered(rng, n, dim):
    centres = rng.normal(size=(max(1, n // 12), dim))
    points = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 0.35], (n, 1))
    return points.astype(np.float32)


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_vectors_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    points = clustered(rng, 240, dim)
    points[:20] = points[20]
    rows = [(i, [float(x) for x in p], i % 3 if i % 17 else None) for i, p in enumerate(points)]
    odd = [None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0] * (dim + 1), []]
    rows += [(500 + i, e, 0) for i, e in enumerate(odd)] + [(None, rows[1][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in covertree.near_embeddings(table, block=32, per_pivot=40).collect()}
    assert len(out) == len(rows)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    links = [
        (a, b) for a in range(240) for b in range(a + 1, 240)
        if rows[a][2] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93
    ]
    want = roots(range(240), links)
    for i in range(240):
        n = sum(i in link for link in links)
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (n, want[i], want[i] == i)
    for i in range(500, 507):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    pairs = {(r.a, r.b) for r in covertree.threshold_pairs(table, block=32).collect()}
    assert pairs == {(a, b) for a, b in links if not (points[a] == points[b]).all()} - {
        (a, b) for a, b in links if any((points[x] == points[y]).all() and y < x and rows[x][2] == rows[y][2] for x in (a, b) for y in range(x))
    }


def test_no_vectors(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert covertree.near_embeddings(table).count() == 0
