import itertools
import random

from siftmark.llm import html

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; x</title><style>p</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home page</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this now.</div>{main}<aside class="sidebar">More here</aside><form><label>Mail</label><input></form>'
    '<div id="comments"><p>First!</p></div><footer>&copy; us &middot; Note.</footer></body></html>'
)
MAIN = "<h1>Tom &amp; Jerry</h1><p><b>One  two\nthree<br>four.<br><p>A&ampB &lt;tag&gt; caf&eacute; &#233;</p><p>Of.</p><aside>skip</aside><ul><li>item</li></ul>"
TEXT = "Tom & Jerry\nOne two three four.\nA&B <tag> café é\nOf.\nitem"


def rows(spark, pages):
    return spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_article(spark):
    pages = [PAGE.format(main=f"<article>{MAIN}</article>")] * 3 + [PAGE.format(main=f"<main><header><h1>Tom &amp; Jerry</h1></header>{MAIN.partition("</h1>")[2]}</main>")]
    pages += [None, "", "   ", "<p", "<nav>a b c</nav>", "<!-- open", "<script>x", "just words"]
    got = {r["page_id"]: r["_main"] for r in html.extract(rows(spark, pages)).collect()}
    assert [got[i] for i in range(4)] == [TEXT] * 4
    assert [got[i] for i in range(4, 12)] == ["", "", "", "<p", "", "", "", "just words"]


def test_page_without_article_by_learned_weights(spark):
    words = "many plain words of the story that go on and on for some time. " * 4
    plain = PAGE.format(main=f"<div><h1>Head line</h1><p>{words}</p><p>Short.</p><p>{words}</p></div>")
    labelled = rows(spark, [PAGE.format(main=f"<article>{MAIN}</article>")] * 5)
    got = html.extract(rows(spark, [plain]), labelled).first()["_main"]
    assert got.split("\n") == ["Head line", words.strip(), "Short.", words.strip()]


def test_region_chooses_inside_main_elements():
    words = "many plain words of the story that go on and on for some time. " * 4
    weights = html.weights_of(*html.counts(PAGE.format(main=f"<article>{MAIN}</article>")))
    several = "".join(f"<article><p>{n} {words}</p></article>" for n in ("one", "two", "three"))
    assert html.main_text(PAGE.format(main=several), weights).split("\n") == [f"{n} {words}".strip() for n in ("one", "two", "three")]
    links = "<ul>" + '<li><a href="/x">More</a></li>' * 40 + "</ul>"
    weights |= {"tag li": -1.0, "tag a": -1.0, "word link": 0.1}
    assert html.main_text(PAGE.format(main=f"<article><p>{words}</p>{links}</article>"), weights) == words.strip()


WRAPPED = [
    '<div class="content with-sidebar"><article>{}</article><div id="comments"><article>First!</article></div></div>',
    '<article class="post comments-open">{}</article>',
    '<article class="post category-social">{}</article>',
    '<form id="aspnetForm"><article>{}</article></form>',
]


def test_names_around_the_only_article_do_not_hide_it():
    weights = html.weights_of(*html.counts(PAGE.format(main=f"<article>{MAIN}</article>")))
    for wrapped in WRAPPED:
        assert html.main_text(PAGE.format(main=wrapped.format(MAIN)), weights) == TEXT


def test_adverts_inside_an_article_go_and_formulas_stay():
    weights = html.weights_of(*html.counts(PAGE.format(main=f"<article>{MAIN}</article>")))
    main = '<p>One two <span class="ad">buy <span>this</span> now</span> three.</p><p class="advert">Buy it</p><p>Four <math><mi>x</mi></math> five.</p><p><a class="ads">Open ad<p>Six.'
    assert html.main_text(PAGE.format(main=f"<article>{main}</article>"), weights).split("\n") == ["One two three.", "Four x five.", "Six."]


def test_a_long_menu_between_articles_parts_nothing():
    words = "many plain words of the story that go on and on for some time."
    weights = html.weights_of(*html.counts(PAGE.format(main=f"<article>{MAIN}</article>")))
    menu = "<nav><ul>" + '<li><a href="/x">More of this</a></li>' * 200 + "</ul></nav>"
    page = PAGE.format(main=f"<article><p>one {words}</p></article>{menu}<article><p>two {words}</p></article>")
    assert html.main_text(page, weights).split("\n") == [f"one {words}", f"two {words}"]


def test_region_is_the_best_one():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        first, last = html.best_region(scores)
        best = max([0.0, *(sum(scores[a : b + 1]) for a, b in itertools.combinations_with_replacement(range(len(scores)), 2))])
        assert abs(sum(scores[first : last + 1]) - best) < 1e-9 and (best > 0 or last < first)


def test_words_are_positive_and_tags_negative():
    weights = html.weights_of(*html.counts(PAGE.format(main=f"<article>{MAIN}</article>")))
    assert weights["word"] > 0 > weights["word furniture"] and all(v < 0 for k, v in weights.items() if k.startswith("tag"))


def test_long_page_and_empty_table(spark):
    page = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert html.extract(rows(spark, [page])).first()["_main"] == "\n".join(["word"] * 20_000)
    assert html.extract(rows(spark, [])).count() == 0
    assert html.main_text("<div>" * 20_000 + "text here", html.weights_of({}, {})) == "text here"
