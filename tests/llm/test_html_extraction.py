import random
import time

from attestry.llm.html_extraction import ARTICLE, BOILERPLATE, COMPARED, LEAST, OPEN, _rows, blocks, main_text, repeats, stream

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><div id="topAd">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One  <b>two<br>three<p>A &lt; B<div class="share-buttons">Share</div>
<section id="comments"><p>First!</p></section><form><p>Mail</p></form><aside>Side</aside><p>End.</article><footer>&copy; y</footer></body></html>"""


def test_markup():
    assert [t for t, k in blocks(PAGE) if k == ARTICLE] == ["Head & line", "One two three", "A < B", "End."]
    assert {k for _, k in blocks(PAGE)} == {ARTICLE, BOILERPLATE}
    assert blocks("") == [] and blocks("a < b <") == [("a < b <", OPEN)]
    assert blocks("<p>x<!-- <p>y --> z") == [("x z", OPEN)]
    assert blocks("<main><p>in</main><p>out") == [("in", ARTICLE), ("out", BOILERPLATE)]


def kept(html):
    return [t for t, k in blocks(html) if k != BOILERPLATE]


def test_boilerplate_within_a_block_neither_leaks_nor_parts_it():
    for inner in ("<span class='advert'>BUY NOW</span>", "<a class='share'>BUY NOW</a>", "<select><option>BUY<option>NOW</select>", "<svg><text>BUY NOW</text></svg>", "<noscript>BUY NOW</noscript>", "<button>BUY NOW</button>", "<b style='display:none'>BUY NOW</b>", "<i hidden>BUY <b>NOW</b></i>"):
        found = kept(f"<p>text {inner} more</p><p>end")
        assert found == ["text more", "end"], inner
    assert kept("<p>one <span class=ad>BUY</p><p>two") == kept("<p>one <span class=ad>BUY<p>two") == ["one", "two"]
    assert kept("<article>one <button><p>BUY</p></button> two</article>x") == ["one two"]
    assert kept("<p>one <span class=ad>BUY <b>NOW</b></span> two <span class=ad>x</span>three") == ["one two three"]


def test_words_within_names_are_no_boilerplate():
    for opened in ("<p class='ad-hoc'>", "<section id='related-work'>", "<div class='research-search-history'>", "<div class='article-share-text'>", "<p class='notification-theory'>", "<main><header><h1>", "<div class='roadmap'>"):
        assert kept(f"{opened}told") == ["told"], opened
    for opened in ("<div class='cookie-notice'>", "<div id='topAd'>", "<div class='share-buttons'>", "<ul class='x site-nav'>", "<div class='sidebar-widget'>", "<div id='comments'>", "<header><h1>", "<div role='banner'>"):
        assert kept(f"{opened}told") == [], opened


def test_host_decides_open_blocks(spark):
    plate = "All rights reserved by the makers of this site"
    rows = [(i, f"http://h{i % 2}.example/p{i}", f"<div>{plate}</div><div>Story number {i} is told here</div>") for i in range(4)]
    rows += [(10, "http://alone.example/", f"<div>{plate}</div>"), (11, None, None), (12, "bad url", ""), (None, "http://h0.example/", PAGE), (13, "http://h1.example/", "<p>" + "long text " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as id")
    found = {r.id: r for r in main_text(df).collect()}
    assert len(found) == len(rows)
    assert all(found[i].text == f"Story number {i} is told here" for i in range(4))
    assert found[10].text == plate and found[11].text == "" and found[12].text == ""
    assert found[None].text == "Head & line\nOne two three\nA < B\nEnd."
    assert found[13].n_chars == len("long text " * 20000) - 1
    assert main_text(df.limit(0)).count() == 0


def test_repeats_against_brute_force(spark):
    """The tokens that the array covers are those of all substrings of LEAST or more tokens that another page of the host has."""
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    shared = [[word(3) for _ in range(n)] for n in (LEAST - 1, LEAST, LEAST + 3, 20, 60)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            words += [word(4) for _ in range(rng.randrange(15))]
            part = rng.choice(shared)
            at = rng.randrange(len(part))
            words += rng.choice((part, part[at:], part[:at]))
        blocks_ = [" ".join(words[k : k + 17]) for k in range(0, len(words), 17)]
        rows.append((i, f"http://h{i % 3}/", "".join(f"<p>{b}</p>" for b in blocks_)))
    rows += [(100, "http://h0/", rows[0][2]), (101, None, "a b"), (102, "http://h1/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {}
    for r in repeats(_rows(df, "page_id", "url", "html")).collect():
        found[r.id] = {k for x in r.spans for k in range(x.pos, x.pos + x.length)}
        assert all(LEAST <= x.length <= COMPARED and 2 <= x.pages <= x.of for x in r.spans)
    codes = {i: tuple(stream(blocks(h or "")).tolist()) for i, _, h in rows}
    for i, url, _ in rows:
        own = codes[i]
        others = {codes[j] for j, u, _ in rows if u == url} - {own}
        runs = {o[k : k + LEAST] for o in others for k in range(len(o) - LEAST + 1)}
        wanted = {k + d for k in range(len(own) - LEAST + 1) if own[k : k + LEAST] in runs for d in range(LEAST)}
        assert found.get(i, set()) == wanted, i


def test_repeats_decide_in_articles_too(spark):
    """What most articles of a host repeat goes; what two quote stays; copies of a page keep their text."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    plate = "Subscribe to our weekly letter and never miss a story from this site again"
    quote = "These very words were said by one and then repeated by another in full length"
    rows, wanted = [], {}
    for i in range(12):
        body = [prose(), quote] if i < 2 else [prose()]
        rows.append((i, f"https://site.example/{i}", f"<article>{''.join(f'<p>{b}</p>' for b in [*body, plate])}</article>"))
        wanted[i] = "\n".join(body)
    copy = prose()
    for k, i in enumerate(range(20, 24)):
        rows.append((i, f"https://copies.example/{i}", f"<article><p>{copy}</p><p>Version {k}</p></article>"))
        wanted[i] = f"{copy}\nVersion {k}"
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    found = [(r.id, r.text) for r in main_text(df).collect()]
    assert sorted(found) == sorted([*wanted.items(), (0, wanted[0])])


def test_many_open_elements_take_linear_time():
    began = time.time()
    for tag in ("span", "p", "div", "x-y"):
        assert len(blocks(f"<{tag}>a " * 40_000 + "</b></i>" * 10_000)) >= 1
    assert time.time() - began < 30
