"""Pages that the tree scoring must keep whole, and markup that must not slow it down."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidelex.llm.html_text import extract, main_text

BODY = "A long enough sentence, with commas, of the article and some more text in it. " * 4


@pytest.mark.parametrize("attrs", ["class=it's", "title=don't", "title=5\"", "data-x='a>b'", "x=\"a>b\" y",
                                   "href=a=\"b", "title=\"it's\"", "a 'b"])
def test_quotes_in_attributes(attrs):
    text = main_text(f"<body><article><p {attrs}>First. {BODY}</p><p>Second. {BODY}</p></article></body>")
    assert text == f"First. {BODY.strip()}\n\nSecond. {BODY.strip()}"


def test_a_page_inside_a_form():
    login = "<form><label>Name</label><input><button>Go</button> Please log in here.</form>"
    page = f"<body><form id=aspnetForm><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></form></body>"
    assert main_text(page) == f"Title\n\n{BODY.strip()}\n\n{BODY.strip()}"
    assert main_text(f"<body><div><p>{BODY}</p>{login}</div></body>") == BODY.strip()
    assert main_text(f"<body><article><p>{BODY}</p></article><form>{BODY * 3}</form></body>") == BODY.strip()


def test_sections_beside_a_long_one():
    parts = [f"<div><h2>Part {n}</h2><p>{text}</p></div>" for n, text in enumerate([BODY * 9, "Short one.", BODY])]
    text = main_text(f"<body>{''.join(parts)}<p>The end.</p><div class=ad>Buy now.</div></body>")
    assert [x for x in text.split("\n\n") if len(x) < 20] == ["Part 0", "Part 1", "Short one.", "Part 2", "The end."]
    links = "<div><h3>More</h3><ul><li><a href=/1>One thing</a></li><li><a href=/2>Another thing</a></li></ul></div>"
    assert "More" not in main_text(f"<body>{parts[0]}{links}</body>")
    articles = "".join(f"<article><h2>Post {n}</h2><p>{BODY * (3 * n + 1)}</p></article>" for n in range(4))
    assert [f"Post {n}" in main_text(f"<body>{articles}</body>") for n in range(4)] == [True] * 4


def test_formulas_and_rules():
    formula = "<math><semantics><mi>E</mi><mo>=</mo><mi>mc</mi><annotation>\\E</annotation></semantics></math>"
    assert main_text(f"<body><p>We know {formula} well. {BODY}</p></body>") == f"We know E=mc well. {BODY.strip()}"
    assert main_text(f"<article>One {BODY}<hr>Two {BODY}</article>") == f"One {BODY.strip()}\n\nTwo {BODY.strip()}"
    assert main_text(f"<article><p>One {BODY}<hr>Two {BODY}</article>") == f"One {BODY.strip()}\n\nTwo {BODY.strip()}"


@pytest.mark.parametrize("page", [
    "<div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 50_000 + "</i>" * 50_000,
    "<p>" + "<b>" * 50_000 + "<div></div>" * 50_000, "<ul>" + "<span>" * 50_000 + "<li>x" * 50_000,
    "<b>" * 50_000 + "x<div></div>" * 50_000, "<header>" * 50_000, "<a b='" * 50_000, "<" * 200_000])
def test_broken_markup_takes_linear_time(page):
    started = time.process_time()
    main_text(page + f"<p>{BODY}</p>")
    assert time.process_time() - started < 4


def plain_pages(seed):
    """Pages of a simple grammar, with the text that a reader sees as the article."""
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["ab", "cde", "fghi", "é"]) for _ in range(rng.randrange(9, 30))) + ", so."
    for n in range(60):
        blocks = [f"Title {n}"] + [" ".join(sentence() for _ in range(rng.randrange(1, 6)))
                                   for _ in range(rng.randrange(2, 9))]
        tags = ["h1"] + [rng.choice(["p", "p", "blockquote", "pre"]) for _ in blocks[1:]]
        inner = "".join(f"<{t}>{b.replace(' so', rng.choice([' <b>so</b>', ' so', '  so']))}</{t}>\n"
                        for t, b in zip(tags, blocks))
        junk = rng.choice(["<div class=ad>Buy.</div>", "<aside>More.</aside>", "<!-- <p>x</p> -->", "<script>a<b</script>"])
        yield n, f"<html><body><nav><a href=/>Home</a></nav>{junk}<article>{inner}</article><footer>F</footer></body>", \
            "\n\n".join(blocks)


def test_against_the_text_that_pages_were_made_of(spark):
    made = list(plain_pages(3))
    long = "\n\n".join(["Title"] + [BODY.strip()] * 4000)
    rows = [(n, None, page) for n, page, _ in made] + [(0, None, made[0][1])] * 2 + [
        (100, "u", "<main><h1>Title</h1>" + f"<p>{BODY}</p>" * 4000 + "</main>"), (None, None, None)]
    want = sorted([(n, text) for n, _, text in made] + [(0, made[0][2])] * 2 + [(100, long), (-1, "")])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("extra") for c in ("__html", "text", "n_chars", "name", "points")})
    got = extract(pages)
    assert {"__html", "name", "points"} <= set(got.columns)
    rows = got.select(F.coalesce("page_id", F.lit(-1)), "text", "n_chars").collect()
    assert sorted((r[0], r[1]) for r in rows) == want and all(r[2] == len(r[1]) for r in rows)
