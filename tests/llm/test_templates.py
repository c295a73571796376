"""Templates of hosts of all sizes: what is counted, and where."""

from maskwave.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_templates_are_a_share_of_distinct_pages(spark):
    page = lambda k, more="": f"<body><div><p>Our site</p></div><p>Story {k}</p>{more}</body>"
    rows = [(k, f"http://big.com/{k}", page(k, "<p>quoted by some</p>" if k < 40 else "")) for k in range(300)]
    rows += [(1000 + k, "http://big.com/again", page("again")) for k in range(12)] + [(2000, "http://big.com/x", page("x"))] * 12
    rows += [(3000 + k, f"http://small.com/{k}", page(f"s{k}")) for k in range(4)] + [(4000 + k, f"http://copies.com/{k}", page("same")) for k in range(12)]
    got = texts(spark, rows)
    assert got[5] == "Story 5\nquoted by some" and got[50] == "Story 50"
    assert got[1003] == "Story again" and got[2000] == "Story x"
    assert got[3001] == "Story s1" and got[4001] == "Our site\nStory same"


def test_boxes_inside_the_article(spark):
    page = lambda k: f"""<body><nav>n{k}</nav><main><div class="body"><h1>T{k}</h1><p>Story {k} of the long kind, with words enough</p><p>quoted by all</p>
        <div class="ad-slot"><p>Buy <b>now</b></p></div>{'<div class="quote">seen on some</div>' if k < 5 else ''}<article class="comment">remark {k}</article></div></main><article class="comment">remark {k}</article></body>"""  # noqa: E731
    got = texts(spark, [(k, f"http://a.com/{k}", page(k)) for k in range(30)] + [(k, "http://b.com/one", page(k)) for k in range(100, 102)])
    story = "T{0}\nStory {0} of the long kind, with words enough\nquoted by all"
    assert got[20] == story.format(20) and got[3] == story.format(3) + "\nseen on some"
    assert got[100] == story.format(100) + "\nBuy now"
    assert texts(spark, [(k, f"http://c.com/{k}", f"<nav>{k}</nav><article><div>The same text</div></article>") for k in range(12)])[4] == "The same text"


def test_names_inside_an_article_speak_for_boxes_alone(spark):
    page = lambda k: f"""<article><div class="header"><h1>Title {k}</h1></div><p class="share">Shares {k} rose.</p><p class="ad">Buy this now</p><p>The story {k}, which is of the
        longer kind, has words enough to be more than half</p><div class="share"><p>Tell {k} friends</p></div><p>see <span class="related">the other {k}</span></p></article>"""  # noqa: E731
    got = texts(spark, [(k, f"http://a.com/{k}", page(k)) for k in range(12)])
    for k in range(12):
        assert got[k] == f"Title {k}\nShares {k} rose.\nThe story {k}, which is of the longer kind, has words enough to be more than half\nsee the other {k}"


def test_counts_decide_where_furniture_has_no_names(spark):
    page = lambda k: f"<body><div><div><p>All of our sites</p></div><div><h2>Story {k}</h2><p>has {k} words of its own</p></div><div><p>Call us</p></div></div></body>"
    rows = [(k, f"http://a.com/{k}", page(k)) for k in range(12)]
    off = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, SCHEMA), share=2.0).collect()}
    assert texts(spark, rows)[7] == "Story 7\nhas 7 words of its own" and off[7] == "All of our sites\nStory 7\nhas 7 words of its own\nCall us"


def test_a_host_of_most_pages_is_dealt(spark):
    page = lambda h, k: f"<body><div>of {h}</div><p>Text {h} {k}</p></body>"
    rows = [(k, "http://hot.com/x", page("hot", k)) for k in range(3000)] + [(10_000 + k, f"http://h{k % 40}.com/", page(k % 40, k)) for k in range(400)]
    got = texts(spark, rows)
    assert len(got) == 3400 and all(t.startswith("Text ") for t in got.values())


def test_broken_tags_take_linear_time():
    import time

    for piece in ("<b ' ", "<b \" ' ", "<!", "<?x ", "<b ", "<b a=\"x' ", "<i '\" <b \"' "):
        for end in ("", ">", "'>", "\">", "'\">"):
            began = time.perf_counter()
            html.read_page(piece * 60_000 + end)
            assert time.perf_counter() - began < 3, (piece, end)


def test_tags_end_outside_quotes():
    import random

    token = __import__("re").compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", __import__("re").S)
    rng = random.Random(4)
    for _ in range(4000):
        page = "".join(rng.choice(["<b", "</i", "<p ", "<", ">", "'", '"', "x", " ", "=", "<!", "<!--", "-->", "<?", "/>"]) for _ in range(rng.randrange(14)))
        want = []
        for m in token.finditer(page):
            want.append((m.group(2), m.group(3), m.group(1)) if m.group(2) else None if m.group()[:2] in ("<!", "<?") and len(m.group()) > 1 else (None, m.group(), ""))
        assert list(html._tokens(page)) == [w for w in want if w], page
