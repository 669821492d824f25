"""Main text: what the wrapper decides, by itself and on tables."""

import html
import random
import re

import pytest

from registrum.llm import html_extract as H

PAGES = "page_id long, url string, html string, host string, wrapper string, literals string, text string"


def table(spark, pages):
    """Pages with columns whose names clash with those inside."""
    return spark.createDataFrame([(*p, "clash", "clash", "clash", "clash") for p in pages], PAGES)


def texts(spark, pages):
    return {r.page_id: r.text for r in H.main_text(table(spark, pages)).collect()}


def wrapper_of(pages, literals=frozenset()):
    out = None
    for p in pages:
        level = H.level_of(list(H.tokens(H.read(p))), literals)
        out = level if out is None else H.align(out, level)
    return out


def ready(pages):
    """The wrapper of pages with its main region."""
    w, sums = H.Wrapper(wrapper_of(pages), frozenset()), {}
    for p in pages:
        for key, (words, most) in w.volumes(H.read(p)).items():
            before = sums.get(key, (0, 0))
            sums[key] = (before[0] + words, max(before[1], most))
    w.region = H.region_of([(*k, *n) for k, n in sums.items()])
    return w


def test_alignment_makes_repeated_and_optional_groups():
    assert H.pattern(wrapper_of(["<ul><li>a<li>b</ul>", "<ul><li>a<li>b<li>c</ul>"])) == "<ul>(<li>#</>)+</>"
    assert H.pattern(wrapper_of(["<h1>a</h1><p>b</p>", "<h1>a</h1><h2>x</h2><p>b</p>"])) == "<h1>#</> (<h2>#</>)? <p>#</>"
    # an optional element that stands elsewhere too makes a group of all between
    assert H.pattern(wrapper_of(["<h1>t</h1><h2>a</h2><p>b</p>", "<h1>t</h1><h2>a</h2><p>b</p><h2>c</h2><p>d</p>"])) == "<h1>#</> (<h2>#</> <p>#</>)+"
    # where all pages agree in number, neighbours keep their places
    assert H.pattern(wrapper_of(["<div>a</div><div><p>b</p></div><div>c</div>"] * 2)) == "<div{text>#</> <div{running><p>#</></> <div{text>#</>"
    assert H.pattern(wrapper_of(["<ul><li><a>a</a><li><a>b</a></ul>", "<ul><li><a>x</a></ul>"])) == "<ul>(<li>@</>)+</>"


def test_wrapper_accepts_all_pages_and_stays_small():
    r = random.Random(3)
    names = ["h2", "p", "ul", "blockquote", "pre"]
    pages = ["<h1>t</h1>" + "".join(f"<{n}>x</{n}>" for n in r.choices(names, k=r.randint(1, 40))) for _ in range(200)]
    level = wrapper_of(pages)
    assert sum(len(nodes) for _, nodes in level) <= 1 + 2 * len(names)
    w = H.Wrapper(level, frozenset())
    for p in pages:
        assert len([1 for _ in w.slots(H.read(p))]) == p.count("</")


def test_very_long_list_and_deep_nesting():
    many = "".join(f"<h2>a{k}</h2><p>b{k}</p>" for k in range(2000))
    w = H.Wrapper(wrapper_of([many, "<h2>a</h2><p>b</p>"]), frozenset())
    assert H.extract(many, w) == " ".join(f"a{k} b{k}" for k in range(2000))
    deep = "<div>" * 3000 + "inside" + "</div>" * 3000 + "<p>after</p>"
    assert H.extract(deep, ready([deep])) == "inside after"


def test_markup():
    def text(page):
        return H.extract(page, ready([page]))

    assert text("<div>a <s class=ad>no<s>in</s>no</s> b<section>c</section></div>") == "a b c"
    assert text("<article class='related-topics share'><p>kept</p></article><p>outside</p>") == "kept"
    assert text("<p>kept</p><article class='comment'><p>said</p></article>") == "kept"
    assert text("<form><h1>all of the page</h1><p>is a form</p></form>") == "all of the page is a form"
    assert text("<h1>text</h1><form><p>ask</p></form>") == "text"
    assert text("<p>x &amp; y&nbsp;z\n w</p><script>1 < 2</script><style>p{}</style>") == "x & y z w"
    assert text("") == text("<div></div>") == ""


def plain_page(k):
    """No article, no telling name: a line and a paragraph that all pages share, a menu of links and one of data."""
    menu = "".join(f"<li><a href=/{j}>entry {k} {j}</a></li>" for j in range(2 + k % 3))
    body = "".join(f"<p>Own {k} {j}</p>" for j in range(1 + k % 4))
    return f"<body><div>The Site</div><ul>{menu}</ul><h1>Title {k}</h1><p>The motto of the site.</p>{body}<p>Write to us.</p></body>"


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_template_text_and_menus_are_inferred(spark, monkeypatch, limit):
    monkeypatch.setattr(H, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(H, "HOT_ROWS", 4)
    monkeypatch.setattr(H, "_BATCH", 3)
    found = texts(spark, [(k, f"http://h.net/{k}", plain_page(k)) for k in range(12)])
    for k in range(12):
        assert found[k] == " ".join([f"Title {k}", *(f"Own {k} {j}" for j in range(1 + k % 4))])
    # with a wrapper that decides nothing, all else being equal, the line, the motto and the menu would stay
    silent = H.Wrapper([], frozenset())
    assert all(H.extract(plain_page(k), silent) == H.extract(plain_page(k), None) != found[k] for k in range(12))


def nameless_page(k):
    """Nothing but divisions: a menu, an advert of its own on each page, the article, on some pages a box, a foot."""
    menu = "".join(f"<li><a href=/{j}>entry {k} {j}</a></li>" for j in range(3 + k % 2))
    body = "".join(f"<p>Paragraph {j} of text {k} goes on for a while.</p>" for j in range(1 + k % 5))
    box = f"<div><ul><li>see {k}</li></ul></div>" if k % 3 == 0 else ""
    return f"<body><div><ul>{menu}</ul></div><div>Buy {k} of these</div><div><h1>Title {k}</h1>{body}</div>{box}<div>Contact number {k}</div></body>"


def test_main_region_of_nameless_pages(spark):
    found = texts(spark, [(k, f"http://n.net/{k}", nameless_page(k)) for k in range(20)])
    for k in range(20):
        assert found[k] == f"Title {k} " + " ".join(f"Paragraph {j} of text {k} goes on for a while." for j in range(1 + k % 5))
    # the same wrapper without its main region
    whole = H.Wrapper(wrapper_of([nameless_page(k) for k in range(20)]), frozenset())
    assert all(f"Buy {k} of these" in H.extract(nameless_page(k), whole) for k in range(20))


def test_template_goes_inside_the_region_too(spark):
    def page(k):
        share = "".join(f"<li><a href=#>share {k} {j}</a></li>" for j in range(1 + k % 3))
        return f"<article><h1>Title {k}</h1><ul>{share}</ul><p>Own text {k}</p><p>The passage that all have.</p></article>"

    found = texts(spark, [(k, f"http://a.net/{k}", page(k)) for k in range(9)])
    assert all(found[k] == f"Title {k} Own text {k} The passage that all have." for k in range(9))


def stripped(page):
    """A page whose telling elements are divisions and that has no class, id or role."""
    page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)(?=[\s>])", r"<\1div", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_given_pages_without_their_names(spark):
    """On nine of ten pages the wrapper finds the text that the article element names; without its decisions on none."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html and "<article" in r.html]
    want = H.main_text(spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows], "page_id long, url string, html string")).collect()
    want = {r.page_id: r.text for r in want}
    bare = [(r.page_id, r.url, stripped(r.html)) for r in rows]
    found = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert sum(found[k] == want[k] for k in want) >= 0.9 * len(want)
    silent = H.Wrapper([], frozenset())
    assert not any(H.extract(page, silent) == want[k] for k, _, page in bare)


def article_page(k):
    return f"<html><head><title>t{k}</title><script>var x='</p>';</script></head><body><nav><ul><li>a<li>b</ul></nav><div class='cookie-notice'>ok?</div><article><h1>Title {k}</h1><p>Text &amp; more <b>{k}</b><br>line<p>Second {k}&nbsp;end</article><section class=comments><article>mine {k}</article></section><footer>f</footer></body></html>"


def test_articles_nulls_and_repeats(spark):
    rows = [(k, f"http://h{k % 2}.net/{k}", article_page(k)) for k in range(8)]
    rows += [(8, None, None), (9, "x", ""), (10, "http://h0.net/", "<p>plain"), (11, "http://h0.net/", "a < b"), (12, None, "<p>no url"), (None, "http://h1.net/", article_page(1)), (1, "http://h1.net/1", article_page(1))]
    found = H.main_text(table(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id is None or r.page_id < 8:
            k = 1 if r.page_id is None else r.page_id
            assert r.text == f"Title {k} Text & more {k} line Second {k} end"
        assert r.n_chars == len(r.text)
    other = {r.page_id: r.text for r in found}
    assert [other[k] for k in (8, 9, 10, 11, 12)] == ["", "", "plain", html.unescape("a &lt; b"), "no url"]


def test_shared_passages_and_copies_stay(spark):
    def article(k):
        quote = "<blockquote>the quoted passage</blockquote>" if k < 4 else ""
        return f"<article><h1>Title {k}</h1>{quote}<p>Own {k}</p><h2>References</h2><ul><li>Link {k}</ul></article>"

    def plain(k):
        quote = "<blockquote>the quoted passage</blockquote>" if k < 3 else ""
        return f"<div class=brand>The Site</div><h1>Title {k}</h1>{quote}<p>Own {k}</p>"

    def copied(k):
        return "<h3>Once</h3><table><tr><td>cell</table><dl><dt>a<dd>b</dl>" + ("<p>tail</p>" if k % 2 else "") if k < 6 else f"<h1>Title {k}</h1><p>Own {k}</p>"

    found = texts(spark, [(100 * h + k, f"http://h{h}.net/{k}", page(k)) for h, page in enumerate((article, plain, copied)) for k in range(8)])
    for k in range(8):
        assert found[k] == f"Title {k} " + "the quoted passage " * (k < 4) + f"Own {k} References Link {k}"
        assert found[100 + k] == f"Title {k} " + "the quoted passage " * (k < 3) + f"Own {k}"
        assert found[200 + k] == ("Once cell a b" + " tail" * (k % 2) if k < 6 else f"Title {k} Own {k}")


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], PAGES)).count() == 0
