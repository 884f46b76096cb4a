"""Pages of several templates on one host, page parts around content, unclosed heads."""

import time

from spikeframe.llm import page_wrappers

TEXT = "A sentence of running text that goes on for a while. " * 4


def read(spark, *pages):
    rows = [(k, url, html) for k, (url, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in page_wrappers.extract(df).collect()}


def test_templates_of_one_host(spark):
    want = TEXT.strip()
    nav = "<nav><a href=/>Home</a></nav>"
    article = f"<body>{nav}<article><p>{TEXT}</article></body>"
    plain = f"<body>{nav}<div id=story><p>{TEXT}</div><footer>Imprint</footer></body>"
    other = f"<body>{nav}<table class=layout><tr><td>{TEXT}</table><footer>Imprint</footer></body>"
    for url in ("http://a.example/x", None):
        got = read(spark, *[(url, article)] * 6, *[(url, plain)] * 20, (url, other))
        assert got == dict.fromkeys(range(27), want)
    got = read(spark, *[("http://b.example/", plain)] * 20, ("http://b.example/", other), ("http://b.example/", article))
    assert got == dict.fromkeys(range(22), want)


def test_containers_are_no_page_parts(spark):
    want = TEXT.strip()
    side = "<div class=sidebar><p>Links and more</div>"
    for k, page in enumerate((
            f"<html><body class='has-sidebar'><div id=story><p>{TEXT}</div>{side}</body></html>",
            f"<html class=search><body class='header sidebar'><div id=story><p>{TEXT}</div>{side}</body></html>",
            f"<body><div class='content no-comments'><p>{TEXT}</div>{side}</body>",
            f"<body><form action=/><article><p>{TEXT}</article>{side}</form></body>",
            f"<body><form action=/><p>{TEXT}</form>{side}</body>")):
        assert read(spark, (f"http://c{k}.example/", page)) == {0: want}, page


def test_unclosed_head(spark):
    page = f"<html><head><title>T</title><script>'<div>'</script>{{}}<body><nav>Menu</nav><div id=story><p>{TEXT}</div>"
    got = read(spark, ("http://d.example/", page.replace("{}", "")), ("http://e.example/", page.replace("{}<body>", "<meta a=b>")),
               ("http://f.example/", page.replace("{}", "stray</head>")))
    assert got == dict.fromkeys(range(3), TEXT.strip())


def test_deep_long_and_broken_pages(spark):
    pages = {
        "deep": "<div>" * 100_000 + TEXT, "closed": "<div>" * 2000 + TEXT + "</div>" * 2000,
        "script": "<p>" + TEXT + "<script " * 130_000, "links": "<p>" + TEXT + "<a " * 300_000,
        "quotes": "<p>" + TEXT + '<a "' * 100_000 + ">", "comments": "<p>" + TEXT + "<!--" * 100_000,
        "blocks": "".join(f"<h2>Head {k}</h2><p>Text {k}</p>" for k in range(20_000)),
        "ends": "<p>" + TEXT + "<div></b></x></h1>" * 30_000,
        "names": "".join(f"<div class={'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}>x</div>" for k in range(20_000))}
    want = {k: TEXT.strip() for k in pages} | {
        "names": "\n".join(["x"] * 20_000),
        "blocks": "\n".join(f"Head {k}\nText {k}" for k in range(20_000))}
    started = time.time()
    for page in pages.values():
        items = page_wrappers.page_expression(page_wrappers.blocks(page))
        page_wrappers.content_paths(page_wrappers.align(items, page_wrappers.page_expression(page_wrappers.blocks(page))))
    assert time.time() - started < 60
    # all on one host, twice: they are aligned with each other
    got = read(spark, *[("http://bad.example/", page) for page in pages.values()] * 2, ("http://bad.example/", f"<article><p>{TEXT}</article>"))
    assert got[2 * len(pages)] == TEXT.strip()
    for k, (name, page) in enumerate(pages.items()):
        alone = read(spark, (f"http://{name}.example/", page))[0]
        assert alone == want[name], name
        assert got[k] == got[k + len(pages)] == want[name], name


def test_nothing_of_the_article_is_lost(spark):
    want = TEXT.strip()
    nav = "<nav><a href=/>Home</a></nav>"
    got = read(
        spark, ("http://h1.example/", f"<body>{nav}<h1>Title</h1><div class=story><p>{TEXT}</div><footer>Imprint</footer>"),
        ("http://h2.example/", f"<body>{nav}<div class=story><p>{TEXT}<p class=ref><a href=/x>A linked reference</a></div>"),
        ("http://h3.example/", f"<body>{nav}<article><header><h1>Title</h1></header><p>{TEXT}</article><header>Site</header>"),
        ("http://h4.example/", f"<body><div class=story><p>{TEXT}</div><ul><li><a href=/x>One</a><li><a href=/y>Two</a></ul>"))
    assert got == {0: f"Title\n{want}", 1: f"{want}\nA linked reference", 2: f"Title\n{want}", 3: want}


def test_repeated_groups():
    def page(body):
        return page_wrappers.page_expression(page_wrappers.blocks(f"<div>{body}</div>"))

    one = page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><hr><table><td>x</table>")
    assert page_wrappers.show(one) == "<div>(<h2>#TEXT</h2><p>#TEXT</p>)+<table><td>#TEXT</td></table></div>"
    two = page_wrappers.align(one, page("<h1>t</h1><p>a</p><h2>b</h2><form>f</form>"))
    assert page_wrappers.show(two) == (
        "<div>(<h1>#TEXT</h1>)?(<h2>#TEXT</h2><p>#TEXT</p>)+(<form>#TEXT</form>)?(<table><td>#TEXT</td></table>)?</div>")
    back = page_wrappers.align(page("<h2>b</h2><p>a</p>"), page("<p>a</p><h2>b</h2>"))
    assert page_wrappers.show(back) == "<div>(<h2>#TEXT</h2><p>#TEXT</p>)+</div>"
