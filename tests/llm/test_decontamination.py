import random
import re

import pytest

from panelspark.llm import decontamination as dc

DOC = "doc_id long, text string, lang string, digest string, _found_id string, code string, hash string"
ITEM = "item_id long, text string, window string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "h") for i, t in rows], DOC)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "w") for i, t in rows], ITEM)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, bench, width):
    """(words, hit positions, items) per row, window by window."""
    out = []
    for i, text in rows:
        w, hit, met = words(text), set(), set()
        for item, body in bench:
            b = words(body)
            n = min(width, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == b[j : j + n]:
                        hit |= set(range(at, at + n))
                        met.add("" if item is None else str(item))
        out.append((i, len(w), tuple(sorted(hit)), tuple(sorted(met))))
    return sorted(out, key=repr)


def as_brute(found):
    return sorted(
        (
            (r.doc_id, r.n_words, tuple(p for s in r.spans for p in range(s.start, s.end)), tuple(r["items"]))
            for r in found.collect()
        ),
        key=repr,
    )


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "éa", "C3", "日本", "x\u0080y", "d_e"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    bench = [(k, text(rng.choice([1, 2, 4, 9]))) for k in range(4)] + [(9, None), (10, "..."), (None, text(5)), (0, text(6))]
    rows = [(k, text(rng.randint(0, 30))) for k in range(25)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, text(9)), rows[0], rows[0], (0, text(8)), (103, text(2000))]
    return rows, bench


@pytest.mark.parametrize("limit", [64_000_000, -1])
def test_hits_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_BYTES", limit)
    for seed, width in ((1, 4), (2, 3)):
        rows, bench = corpus(seed)
        found = dc.find(docs(spark, rows), items(spark, bench), width=width)
        assert as_brute(found) == brute(rows, bench, width)


def test_a_window_of_many_items_and_a_passage_of_many_documents(spark):
    shared = " ".join(f"p{i}" for i in range(12))
    bench = [(k, f"{shared} own{k} " + " ".join(f"q{k}x{i}" for i in range(12))) for k in range(30)]
    rows = [(d, f"intro{d} {shared} tail") for d in range(40)] + [(99, "nothing here at all")]
    for r in dc.find(docs(spark, rows), items(spark, bench)).collect():
        if r.doc_id == 99:
            assert not r.spans and not r["items"]
        else:
            assert [(s.start, s.end) for s in r.spans] == [(1, 13)]
            assert r["items"] == sorted(str(k) for k in range(30))


def test_empty_tables(spark):
    some, none = docs(spark, [(1, "a b c")]), docs(spark, [])
    bench, empty = items(spark, [(1, "a b")]), items(spark, [])
    assert dc.find(none, bench).collect() == []
    assert [(r.n_words, r.spans, r["items"]) for r in dc.find(some, empty).collect()] == [(3, [], [])]
    assert dc.decontaminate(some, empty).collect() == some.collect()


def test_cut_spans_or_documents(spark):
    rows = [
        (1, "Keep this. The Secret test, item words! And the rest."),
        (2, "clean text stays\tas it is  "),
        (3, None),
        (4, "the secret TEST item words"),
        (5, "the secret test item words; x the secret test item words."),
    ]
    bench = items(spark, [(7, "the secret test item words")])
    given = docs(spark, rows)
    cut = dc.decontaminate(given, bench)
    assert cut.columns == given.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {1: "Keep this! And the rest.", 2: rows[1][1], 3: None, 4: "", 5: "; x."}
    left = dc.decontaminate(given, bench, remove="documents")
    assert left.columns == given.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert all(r.digest == "x" and r.hash == "h" for r in left.collect())


def test_cut_texts_equal_a_plain_cut(spark):
    rows, bench = corpus(5)
    expected = []
    for (i, text), (_, _, hit, _) in zip(rows, [brute([r], bench, 3)[0] for r in rows]):
        tokens = re.findall(rf"[{dc.GAP}]*[^{dc.GAP}]+", text or "")
        tail = (text or "")[sum(map(len, tokens)) :]
        kept = "".join(t for p, t in enumerate(tokens) if p not in hit) + tail
        expected.append((i, kept if hit else text))
    got = dc.decontaminate(docs(spark, rows), items(spark, bench), width=3)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(expected, key=repr)
