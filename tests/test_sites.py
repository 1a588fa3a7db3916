"""Site rules on small inline pages (the driver pages match none of them)."""

from newsframe.operators import pages as PG

ARS_HOME = ('<a href="/gadgets/2025/07/one/">x</a><a href="/about">a</a>'
            '<a href="https://other.com/2025/x">o</a><a href="/gadgets/2025/07/one/">dup</a>')
ARS_ART = ('<h1>Ars <b>Title</b></h1><a rel="author" href="/a">Jane Doe</a><time datetime="2025-07-22">x</time>'
           '<div class="article-content"><p>First para.</p><div class="inner"><p>Nested.</p></div></div>'
           '<p>Outside.</p>')
TC_HOME = ('<a class="post-block__title__link" href="https://techcrunch.com/2025/07/22/a/">a</a>'
           '<a class="post-block__title__link" href="https://elsewhere.com/x">b</a>'
           '<a href="https://techcrunch.com/2025/07/22/c/">c</a>')
TC_NO_DATETIME = '<h1>T</h1><time>yesterday</time><div class="article-content"><p>x</p></div>'
TC_NO_TIME = '<div class="article-content"><p>y</p></div>'
VERGE_HOME = '<a href="https://www.theverge.com/2025/7/22/x?utm=1">v</a><a href="/2025/rel">r</a>'
VERGE_ART = ('<h1>V</h1><span class="byline__name">Sam</span>'
             '<div class="duet--article--article-body-components-container"><p>Body</p></div>')
WIRED_HOME = ('<a data-test-id="article-link" href="/story/2025-gadget/">w</a>'
              '<a data-test-id="other" href="/story/2025-other/">o</a>')
WIRED_ART = '<article><p>a <b>b</b> c<p>d</p></article><footer><p>no</p></footer>'


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_site_links(spark):
    rules = PG.site_rules()
    homes = _pages(spark, [("https://arstechnica.com/", ARS_HOME), ("https://techcrunch.com/", TC_HOME),
                           ("https://www.theverge.com/", VERGE_HOME), ("https://www.wired.com/", WIRED_HOME)])
    got = {(r.site, r.link) for r in PG.site_links(homes, rules).collect()}
    assert got == {
        ("ars", "https://arstechnica.com/gadgets/2025/07/one/"),
        ("tc", "https://techcrunch.com/2025/07/22/a/"),
        ("verge", "https://www.theverge.com/2025/7/22/x"),
        ("wired", "https://www.wired.com/story/2025-gadget/"),
    }
    top = PG.distinct_links_topn(PG.site_links(homes, rules), 5).collect()
    assert len(top) == 4


def test_articles(spark):
    rules = PG.site_rules()
    arts = _pages(spark, [("https://arstechnica.com/gadgets/2025/07/one/", ARS_ART),
                          ("https://techcrunch.com/2025/07/22/a/", TC_NO_DATETIME),
                          ("https://techcrunch.com/2025/07/22/b/", TC_NO_TIME),
                          ("https://www.theverge.com/2025/7/22/x", VERGE_ART),
                          ("https://www.wired.com/story/2025-gadget/", WIRED_ART)])
    got = {r.url: r for r in PG.extract_article(arts, rules).collect()}
    ars = got["https://arstechnica.com/gadgets/2025/07/one/"]
    assert (ars.title, ars.author, ars.published, ars.content) == ("Ars Title", "Jane Doe", "2025-07-22",
                                                                  "First para.\nNested.")
    assert "https://techcrunch.com/2025/07/22/a/" not in got        # <time> without datetime: dropped
    tc = got["https://techcrunch.com/2025/07/22/b/"]
    assert (tc.title, tc.author, tc.published, tc.content) == ("No title", "Unknown", None, "y")
    verge = got["https://www.theverge.com/2025/7/22/x"]
    assert (verge.title, verge.author, verge.content) == ("V", "Sam", "Body")
    wired = got["https://www.wired.com/story/2025-gadget/"]
    assert (wired.title, wired.content) == ("No Title", "a b c\nd")


def test_scrape_site(spark):
    rules = PG.site_rules()
    homes = _pages(spark, [("https://arstechnica.com/", ARS_HOME), ("https://www.wired.com/", WIRED_HOME)])
    fetched = _pages(spark, [("https://arstechnica.com/gadgets/2025/07/one/", ARS_ART),
                             ("https://www.wired.com/story/2025-gadget/", WIRED_ART),
                             ("https://www.wired.com/story/2025-other/", WIRED_ART)])
    robots = spark.createDataFrame([("arstechnica.com", 1, "/gadgets", False), ("www.wired.com", None, None, None)],
                                   "host string, seq int, prefix string, allow boolean")
    got = {r.url for r in PG.scrape_site(homes, fetched, rules).collect()}
    assert got == {"https://arstechnica.com/gadgets/2025/07/one/", "https://www.wired.com/story/2025-gadget/"}
    got = {r.url for r in PG.scrape_site(homes, fetched, rules, robots=robots).collect()}
    assert got == {"https://www.wired.com/story/2025-gadget/"}
