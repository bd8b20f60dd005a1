import pytest

from tidemark.llm import html
from tidemark.llm.queries import op5_html

LONG = "The river of the valley was wide and it is said that they had been there for all of the years in which he was king."
CASES = [
    (None, ""),
    ("", ""),
    ("just &lt;words&gt; &amp; more", "just <words> & more"),
    (f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>A  title</h1><p><b>{LONG}<br><p>Short.</article><footer>&copy; x</footer>", f"A title\n{LONG}\nShort."),
    ("<nav><a>x</a></nav><article><h1>Title</h1><p>Few words.</p></article><footer>f</footer>", "Title\nFew words."),
    (f"<head><title>T</title></head><body><header><h1>Site</h1></header><div id=content><p>{LONG}</p><p>And short</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG}\nAnd short"),
    (f"<article><p>{LONG}</p><section id='comments'><p>{LONG} first!</p></section><aside>{LONG}</aside><form><p>{LONG}</p></form></article>", LONG),
    (f"<article><header><h1>In article</h1></header><script>var a='</p><p>no';</script><style>p{{}}</style><p>{LONG}</p><div class=\"ad-slot\">Buy the best of the best</div><p class='cookieNotice'>We use cookies</p></article>", f"In article\n{LONG}"),
    (f"<p>{LONG}</p><ul><li><a href=x>one link that is quite long</a></li><li><a href=y>two</a></li></ul><p>{LONG}</p>", f"{LONG}\n{LONG}"),
    ("<article><p>a<br>b<br><br>c&nbsp;d\n\t e</p></article>", "a b\nc d e"),
    ("<article><p>1 < 2 and 3 > 2 <b>bold</b>ly</p><!-- <p>no</p> --></article>", "1 < 2 and 3 > 2 boldly"),
    ("<article><p title='a > b' class=x>quoted</p><p>unclosed <a href=", "quoted\nunclosed <a href="),
    ("<article><div style='display: none'>hidden</div><p hidden>too</p><p>seen</p></article>", "seen"),
    (f"<main><table><tr><td>{LONG}</td><td>cell</td></tr></table></main>", f"{LONG}\ncell"),
]


@pytest.mark.parametrize("page,expected", CASES)
def test_pages(page, expected):
    assert html.main_text(page)[0] == expected


def test_ambiguous_blocks_inherit_from_the_nearer_side():
    links = "<p><a href=x>only a link of some length here</a></p>"
    page = f"<body><p>{LONG}</p><p>near main</p><p>x</p><p>y</p><p>near links</p>{links}</body>"
    labels = {b.text: b.label for b in html.classify(page)}
    assert labels["near main"] == "main" and labels["near links"] == "boilerplate"


def test_no_word_of_a_long_article_is_dropped():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(3000))
    assert html.main_text(f"<article>{body}</article>") == ("\n".join(f"{LONG} {i}" for i in range(3000)), 3000)


def test_frames(spark):
    rows = [(i, "u", p, "clash") for i, (p, _) in enumerate(CASES)] + [(0, None, CASES[3][0], None), (None, "u", None, "")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    expected = [(i, t, len(t)) for i, (_, t) in enumerate(CASES)] + [(0, CASES[3][1], len(CASES[3][1])), (None, "", 0)]
    assert sorted((tuple(r) for r in got.select("page_id", "text", "n_chars").collect()), key=str) == sorted(expected, key=str)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html.blocks(spark.createDataFrame(rows[:5], "page_id long, url string, html string, text string")).count() > 5


def test_articles_of_the_table_are_kept_whole(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in op5_html(spark, d).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        words = html.unescape(html.re.sub(r"<[^>]*>", " ", article)).split()
        assert r.text.split() == words and r.n_chars == len(r.text)
