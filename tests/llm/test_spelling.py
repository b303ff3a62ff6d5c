import random
import re
import zlib
from collections import Counter

from panelspark.llm import spelling

DOC = "doc_id long, text string, word string, n long, run string, side int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], DOC)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    long, short = max(a, b, key=len), min(a, b, key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, times=5):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(v, w)]
        m, v = min(near, default=(0, None))
        form = v if v is not None and -m >= times * n else None
        out[w] = [form, None, n, len(near), -m if form else None]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(row) for w, row in out.items()}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_near_words_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        words = sorted({"".join(rng.choice("abé\U0010ffff") for _ in range(rng.randint(1, 9))) for _ in range(60)})
        shared = [0, *map(spelling.common_prefix, words, words[1:])]
        for w in rng.sample(words, 5):
            start = rng.randint(0, len(w))
            found = [words[i] for i in spelling.near_words(words, shared, w, start)]
            assert found == [v for v in words if v[:start] == w[:start] and one_edit(v, w)]


def test_blocks_lose_no_pair_and_count_none_twice(spark):
    rng = random.Random(7)
    counts = {}
    for _ in range(900):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
        counts[w] = counts.get(w, 0) + rng.choice([1, 1, 3, 20, 200])
    counts |= {"a" * k: 10**k for k in range(1, 8)}  # repeated letters match both halves
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = plain(counts)
    assert got(spelling.variants(words, block=37)) == expected
    assert got(spelling.variants(words)) == expected


def test_a_prefix_that_a_third_of_all_words_share(spark):
    rng = random.Random(8)
    counts = {"prefix" + "".join(rng.choice("abcd") for _ in range(6)): rng.randint(1, 9) for _ in range(400)}
    counts |= {"".join(rng.choice("abcd") for _ in range(6)): rng.randint(1, 99) for _ in range(400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(spelling.variants(words, block=20)) == plain(counts)


def test_vocabulary_equals_a_plain_count(spark):
    rng = random.Random(2)
    stock = ["Ähnlich", "straßen", "COLOUR", "colors", "short", "naïveté", "x" * 400, "mañanas"]
    rows = [(i, "".join(rng.choice(stock) + rng.choice(" ,\n12日") for _ in range(60))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "..."), (None, "colors " * 9), rows[0], rows[0]]
    expected = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            expected[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 19 == 0 else run] += 1
    expected = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    found = {r.word: r.n for r in spelling.vocabulary(docs(spark, rows), damage=19).collect()}
    assert found == expected and len(found) > len(stock)


def test_empty(spark):
    assert spelling.variants(spelling.vocabulary(docs(spark, []))).collect() == []
    words = spark.createDataFrame([("alone", 9)], "word string, n long")
    assert got(spelling.variants(words)) == {"alone": (None, "alone", 9, 0, None)}


def test_chains_reach_their_last_form(spark):
    chain = ["abcdefgh"[:k] + "z" * (8 - k) for k in range(9)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == dict.fromkeys(chain[:-1], chain[-1])
