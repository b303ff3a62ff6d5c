import random
import time

from panelspark.llm import linedensity

LINKS = "".join(f"<div><a href='/{i}'>menu entry {i}</a></div>" for i in range(12))


def paragraphs(name, n, size=40):
    return [" ".join([f"{name}{i}"] + ["words"] * size) + "." for i in range(n)]


def put(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


def test_teaser_article_does_not_hide_the_body():
    body = paragraphs("body", 6)
    card = "<article><h3>Read this too</h3><p>Teaser.</p></article>"
    for page in (f"{LINKS}<div>{put(body)}</div>{LINKS}{card}", f"{card}{LINKS}<div>{put(body)}</div>{LINKS}"):
        assert linedensity.main_text(f"<body>{page}</body>") == "\n".join(body)


def test_article_bounds_the_text():
    body = ["Short.", *paragraphs("body", 4), "1", "End."]
    page = f"<body><p>{paragraphs('note', 1)[0]}</p><article>{put(body)}</article>{LINKS}<p>tiny</p></body>"
    assert linedensity.main_text(page) == "\n".join(body)


def test_split_article_keeps_every_part():
    one, two, three = (paragraphs(n, 3) for n in ("one", "two", "three"))
    page = f"<body>{LINKS}{put(one)}{LINKS}{put(two)}<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p>{put(three)}{LINKS}<p>tiny</p></body>"
    got = linedensity.main_text(page).split("\n")
    assert [t for t in got if len(t) > 1] == one + two + three


def test_huge_block_does_not_raise_the_bar():
    body = paragraphs("body", 5, 45)
    huge = "x" * 10_000
    page = f"<body>{LINKS}{put(body)}{LINKS}<p>{huge}</p>{LINKS}{put(body[:1])}{LINKS}<p>tiny</p></body>"
    assert linedensity.main_text(page) == "\n".join([*body, huge, body[0]])


def test_link_lists_are_no_text():
    assert linedensity.main_text(f"<body>{LINKS}<p>{paragraphs('b', 1)[0]}</p>{LINKS}</body>") == paragraphs("b", 1)[0]
    assert linedensity.main_text(f"<body>{LINKS}</body>") == ""


def test_body_beside_a_long_teaser_stays():
    body = paragraphs("body", 4, 28)
    teaser = paragraphs("teaser", 2, 28)
    page = f"<body><article>{put(teaser)}</article>{LINKS}<div>{put(body)}</div>{LINKS}</body>"
    assert linedensity.main_text(page).split("\n") == teaser + body


def test_short_tail_and_start_stay():
    body = ["A", *paragraphs("body", 4), "The end.", "x", "y", "Fin of it."]
    assert linedensity.main_text(f"<body>{LINKS}{put(body)}{LINKS}<p>tiny</p></body>").split("\n") == body


def test_runs_follow_a_plain_window_rule():
    rng = random.Random(6)
    for _ in range(400):
        lines = []
        for _ in range(rng.randint(0, 25)):
            text = "w" * rng.choice([0, 1, 5, 40, 300, 900])
            lines.append((text, rng.choice([0, 0, len(text)]), rng.choice([0, 0, 0, 1, 2])))
        weight = [len(t) * (linedensity.ARTICLE if a else 1) for t, _, a in lines]
        parts = {}
        for i, (text, linked, article) in enumerate(lines):
            if article:
                parts.setdefault(("article", article), []).append(i)
            elif text and 2 * linked < len(text):
                # its run starts after the last separator or article line before it
                start = i
                while start and not lines[start - 1][2] and lines[start - 1][0] and 2 * lines[start - 1][1] < len(lines[start - 1][0]):
                    start -= 1
                parts.setdefault(("run", start), []).append(i)
        flat = sorted((min(weight[i], linedensity.LONGEST) for p in parts.values() for i in p), reverse=True)
        held = [sum(flat[: k + 1]) for k in range(len(flat))]
        least = 0.5 * next((w for w, h in zip(flat, held) if 2 * h >= held[-1] and w), 0)
        kept = sorted(
            i for p in parts.values()
            if any(sum(weight[j] for j in p[k : k + 3]) > least for k in range(len(p)))
            for i in p
        )
        assert linedensity.runs(lines) == sorted(parts.values())
        got = [i for p in linedensity.runs(lines) if linedensity.surges([weight[j] for j in p], 3, least) for i in p]
        assert sorted(got) == kept


def test_a_megabyte_of_unclosed_tags_is_quick():
    for page in ("<div>" * 100_000 + "</b>" * 100_000, "<div>" * 50_000 + "<nav><article>" * 50_000, "<p>x <b>y</i>" * 80_000):
        start = time.perf_counter()
        linedensity.main_text(page)
        assert time.perf_counter() - start < 5
