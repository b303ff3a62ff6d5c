import random
import re

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def survivors(rows):
    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return sorted([(i, t) for i, t in rows if group[i] == i], key=str)


def test_the_threshold_is_five_words_and_four_fifths(spark):
    rng = random.Random(8)
    words = [[f"{name}{i}" for i in range(200)] for name in "abc"]
    edited = list(words[1])
    for at in (20, 60, 100, 140, 180):
        edited[at] = "edit"
    rows = [
        (1, words[0]), (2, words[0] + [f"more{i}" for i in range(43)]), (3, words[1]), (4, edited),
        (5, words[2]), (6, words[2][:165]),
        (7, "v w x y z p q r".split()), (8, "v w x y z p q r s".split()),  # exactly 4 of 5 shingles
    ]
    rows = [(i, " ".join(w)) for i, w in rows] + [(9, None), (10, ""), (11, " \t")]
    assert [i for i, _ in survivors(rows)] == [i for i, _ in stage(spark, rows)] == [1, 10, 11, 3, 4, 5, 7, 9]
    vocabulary = [f"w{i}" for i in range(300)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([7, 12, 40, 150]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((20 + len(rows), " ".join(copy + [rng.choice(vocabulary)] * rng.randint(0, len(copy) // 6))))
    kept = survivors(rows)
    assert len(rows) - len(kept) > 20 and stage(spark, rows) == kept


def test_rows_are_known_by_id_and_text(spark):
    clean, base = " ".join(f"c{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [
        (1, base), (1, base), (1, base),  # exact repeats: one row stays
        (2, base + " b40"), (2, clean), (2, clean),  # one id with a near copy and a text of its own, repeated
        (3, clean + " c40"), (4, base), (4, "only here and said once"), (None, base), (None, base),
        (5, ""), (5, ""), (6, None),
    ]
    assert stage(spark, rows) == sorted(
        [(1, base), (2, clean), (4, "only here and said once"), (None, base), (None, base), (5, ""), (5, ""), (6, None)], key=str
    )
    assert stage(spark, []) == []


def test_columns_named_like_helpers_pass_through(spark):
    names = ("_text", "_row", "number", "row", "body", "id", "_mix_n", "_mix_copies", "component_id", "n")
    schema = SCHEMA + "".join(f", {c} string" for c in names)
    base = " ".join(f"b{i}" for i in range(40))
    rows = [(1, base), (1, base), (2, base + " more"), (3, "something else"), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *[f"{c}!" for c in names]) for i, t in rows], schema)
    for made, ids in ((corpus_pipeline.drop_near_copies(spark, docs, None), [1, 3, 4, None]), (corpus_pipeline.mix_sources(spark, docs, None), None)):
        assert made.schema.names == docs.schema.names and made.dtypes == docs.dtypes
        out = made.collect()
        assert all(r[c] == f"{c}!" for r in out for c in names)
        assert ids is None or sorted((r.doc_id for r in out), key=str) == ids


def test_stages_take_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for made in (corpus_pipeline.mask_personal_data, corpus_pipeline.mix_sources, corpus_pipeline.pack_batches):
        assert made(spark, none, None).collect() == []
    rows = [(1, None), (1, None), (2, ""), (3, "call +1 702 555 0742 now"), (3, "call +1 702 555 0742 now")]
    some = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA)
    masked = [(r.doc_id, r.text) for r in corpus_pipeline.mask_personal_data(spark, some, None).collect()]
    assert sorted(masked, key=str) == [(1, None), (1, None), (2, ""), (3, masked[-1][1]), (3, masked[-1][1])]
    assert "702" not in masked[-1][1]
    assert sum(r.n_tokens for r in corpus_pipeline.pack_batches(spark, some, None).collect()) == 5 + 2 * 6
