import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from panelspark.llm import mixing, packing, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z") for i, t, s in rows], DOC)


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 3, 20, 200]))), f"s{rng.choice('aaab')}") for i in range(n)]
    return rows + [(n, None, "sa"), (n + 1, "", None), (n + 2, " \t\n", None), (n + 3, "long " * 30000, "sc"), rows[0], rows[0], (None, "no id", "sb")]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 7)
        sizes, counts, k = rng.sample(range(1, 40), n), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 5)

        def cost(ends):
            return sum(c * (min(e for e in ends if e >= s) - s) for s, c in zip(sizes, counts))

        best = min(
            cost({*e, max(sizes)}) for r in range(min(k, n)) for e in itertools.combinations(sizes, r)
        )
        ends = packing.best_boundaries(sizes, counts, k)
        assert cost(ends) == best and len(ends) <= k and ends == sorted(set(ends))
    assert packing.best_boundaries([], [], 3) == []


def test_pack_keeps_every_token_within_budget(spark):
    rows = corpus()
    out = packing.pack(docs(spark, rows), context=64, token_budget=512, buckets=3, group_rows=50).collect()
    assert sum(r.n_tokens for r in out) == sum(words(t) + 1 for _, t, _ in rows)
    batches = {}
    for r in out:
        assert 0 < r.n_tokens <= r.boundary and r.start == r.piece * 64
        batches.setdefault((r.bucket, r.batch), []).append(r)
    sizes = {}
    for (bucket, batch), rows_ in batches.items():
        assert len(rows_) * rows_[0].boundary <= 512
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
        sizes.setdefault(bucket, {})[batch] = (len(rows_), 512 // rows_[0].boundary)
    for by in sizes.values():
        assert sorted(by) == list(range(len(by)))
        assert all(n == room for b, (n, room) in by.items() if b < max(by))
    assert len({r.boundary for r in out}) <= 3


def test_pack_empty_and_wrong(spark):
    assert packing.pack(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), context=10, token_budget=5)


def filled(sizes, weights, most):
    """Targets by refilling until no source is over: the plain way."""
    total, full, target = sum(sizes), set(), {}
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_mix_meets_targets(spark):
    rows = corpus(600)
    out = mixing.mix(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    sources = sorted({s for _, _, s in rows if s}) + [None]
    size = [sum(words(t) for _, t, s in rows if s == x) for x in sources]
    want = filled(size, [1 + i % 3 for i in range(len(sources))], 3)
    for x, n, target in zip(sources, size, want):
        own = [r for r in out if r.source == x]
        assert all(r.source_size == n and abs(r.target - target) < 1e-6 * max(1, target) for r in own)
        assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_repeats_rows_and_keeps_columns(spark):
    table = docs(spark, corpus(600))
    out = mixing.mixed(table)
    assert out.columns == table.columns
    taken = mixing.mix(table).agg(F.sum("taken")).head()[0]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).head()[0] == taken


def test_mix_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, [(1, "", None), (2, None, "a")])).collect()] == [0, 0]


def test_shards_are_contiguous_and_even(spark):
    rows = corpus(900)[:-1] + [(5000 + i, "hot text here", "s") for i in range(500)]
    rows = [r for r in rows if len(r[1] or "") < 100000]
    out = sharding.shard(docs(spark, rows), shards=6).collect()
    assert len(out) == len(rows)
    total = sum(len((t or "").encode()) + 8 for _, t, _ in rows)
    assert sum(r["size"] for r in out) == total
    most = max(r["size"] for r in out)
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(r)
    assert sorted(held) == list(range(6))
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 6) <= 0.04 * total / 6 + 2 * most
    split = {}
    for r in out:
        split.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in split.values()) <= 5
    assert sorted(map(str, sharding.shard(docs(spark, rows).repartition(5), shards=6).collect())) == sorted(map(str, out))


def test_shards_of_little(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    (one,) = sharding.shard(docs(spark, [(None, None, None)])).collect()
    assert (one["size"], one.text_crc32, one.slot) == (8, 0, 0)


def test_no_group_under_its_share_is_cut(spark):
    """Small groups stay whole beside a hot text and a very long one, at few rows and at many."""
    for n in (60, 2000):
        rows = [(i, f"text number {i // 3} " + "w " * (i // 3 % 40), "s") for i in range(n)]
        rows += [(10_000 + i, "hot text here " * 4, "s") for i in range(n // 2)] + [(99_999, "long " * (10 * n), "s")]
        out = sharding.shard(docs(spark, rows), shards=6).collect()
        total = sum(r["size"] for r in out)
        groups = {}
        for r in out:
            groups.setdefault(r.text_crc32, []).append(r)
        cut = [g for g in groups.values() if len({r.shard for r in g}) > 1]
        assert all(6 * sum(r["size"] for r in g) > 0.02 * total for g in cut)
        assert n < 100 or len(cut) == 1
