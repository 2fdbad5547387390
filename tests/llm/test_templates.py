"""Site templates: copies are one page, large hosts have them too, paragraphs can be one."""

from tallyroll.llm import html_text


def texts(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract(df, **options).collect()}


def test_copies_keep_their_article(spark):
    page = lambda story, i: f"<html><head><link href=/{i}></head><body><p>By us</p><div><p>{story}</p><p>The end</p></div></body></html>"
    rows = [(i, f"http://a.org/{i}", page("Copied", i)) for i in range(8)] + [(10 + i, f"http://a.org/x{i}", page(f"Other {i}", i)) for i in range(3)]
    got = texts(spark, rows)
    assert all(got[i] == "By us\n\nCopied\n\nThe end" for i in range(8)) and got[11] == "By us\n\nOther 1\n\nThe end"


def test_a_template_on_a_small_share_of_a_large_host(spark):
    note = "<div>Notice to all</div>"
    rows = [(i, f"http://a.org/{i}", f"<body><p>Story {i}</p>{note if i % 5 == 0 else ''}</body>") for i in range(400)]
    assert texts(spark, rows) == {i: f"Story {i}" for i in range(400)}


def test_recurring_paragraphs_go(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><h2>Our paper</h2><p>Story {i}</p><p>Said by all</p><ul><li>Item {i}<li>Call us</ul></body>") for i in range(8)]
    assert texts(spark, rows, every_block=True) == {i: f"Story {i}\n\nItem {i}" for i in range(8)}
    alone = [(i, f"http://b.org/{i}", "<body><p>Sold out</p></body>") for i in range(8)]
    assert set(texts(spark, alone, every_block=True).values()) == {"Sold out"}


def test_counts_alone_find_the_templates_of_a_site(spark):
    """On pages whose menus and footers recur, the lists of tags and classes add nothing."""
    page = lambda i: (
        f"<body><header><h1>Daily</h1></header><nav><ul><li>Home<li>News</ul></nav><div class=ad>Buy now</div><div><h2>Head {i}</h2><p>Story {i}</p></div>"
        "<aside><p>Most read</p></aside><footer>All rights</footer><script>x()</script></body>"
    )
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)]
    want = {i: f"Head {i}\n\nStory {i}" for i in range(12)}
    assert texts(spark, rows, every_block=True) == want
    assert texts(spark, rows, every_block=True, lists=False) == want


def test_deep_and_long_pages():
    import time

    start = time.time()
    blocks, ranges = html_text.parse("<div>x" * 20_000)
    assert blocks == ["x"] * 20_000 and len(ranges) == 19_999
    blocks, _ = html_text.parse("<div>" * 5_000 + "<p>a<b>b</b>" * 20_000 + "<li>c" * 2_000 + "</i></q>" * 20_000)
    assert len(blocks) == 22_000
    blocks, _ = html_text.parse("<body>" + "<p>long text</p>" * 50_000)
    assert len(blocks) == 50_000 and time.time() - start < 30


def test_equal_blocks_and_ranges():
    blocks, ranges = html_text.parse("<div><p>a</p></div><div><p>a</p></div><div>b<div>c</div></div>")
    assert blocks == ["a", "a", "b", "c"] and [r[1:] for r in ranges] == [(0, 1), (1, 2), (3, 4), (2, 4)] and ranges[0][0] == ranges[1][0]


def test_what_many_articles_say_stays(spark):
    """A heading or paragraph inside the article element is the article's, a container inside it can be template."""
    page = lambda i: f"<body><p>By us</p><article><h1>Weather report</h1><p>As every day</p><p>Story {i}</p><div><p>Share this</p></div></article></body>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(60)]
    assert texts(spark, rows, every_block=True) == {i: f"Weather report\n\nAs every day\n\nStory {i}" for i in range(60)}
