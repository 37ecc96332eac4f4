import random

from vectorloom.llm import html_wrapper as hw

SCHEMA = "page_id bigint, url string, html string, host string, wrapper string, text string"
PAGE = (
    "<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>A</a></li>{more}</ul></nav><!-- ad {n} --><div class=\"ad\">Buy {n}</div>{body}"
    "<div id='comments'><p>first!</p></div><aside>links</aside><footer>&copy; {n}</footer></body></html>"
)


def _extract(spark, pages, **options):
    rows = [(*p, "own", "own", "own") for p in pages]
    return {r.page_id: r for r in hw.extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()}


def test_articles(spark):
    pages, want = [], {}
    for n in range(30):
        paragraphs = [f"text {n} {k} &lt;b&gt; &amp;amp; x" for k in range(n % 4)]
        body = f"<article><h1>Head {n}</h1><p><b>first  {n}<br>\n\tline" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<form>mail <input></form></article>"
        pages.append((n, f"https://Host{n % 3}.example/{n}", PAGE.format(n=n, more="<li>x</li>" * (n % 2), body=body)))
        want[n] = "\n\n".join([f"Head {n}", f"first {n} line"] + [f"text {n} {k} <b> &amp; x" for k in range(n % 4)])
    for options in ({}, {"shipped_bytes": 0}):
        got = _extract(spark, pages, **options)
        assert {n: r.text for n, r in got.items()} == want
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_without_articles_the_changing_region_is_taken(spark):
    pages = []
    for n in range(12):
        body = f"<div class='top'>Welcome to the site</div><div class='x'><div><a href='1'>one link {n}</a> <a>two links</a></div><div class='b'>" + "".join(
            f"<p>story {n} part {k} with enough words to weigh a little more</p>" for k in range(1 + n % 3)
        )
        pages.append((n, "http://h.example/", PAGE.format(n=n, more="", body=body + "</div></div>")))
    got = _extract(spark, pages)
    for n in range(12):
        assert got[n].text == "\n\n".join(f"story {n} part {k} with enough words to weigh a little more" for k in range(1 + n % 3))


def test_edge_pages(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    broken = "<article><p>cut <b>off <i>here <a href='x"
    pages = [
        (1, None, None), (2, "http://a.example", ""), (3, "http://a.example", long), (3, "http://a.example", long),
        (4, "nonsense", "plain &copy text < 5"), (5, "http://b.example", broken), (6, "http://a.example", "<p>a</p><hr><p>b"),
        (None, "http://a.example", "</p></div><article>x</article>"),
    ]
    got = _extract(spark, pages)
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[3].text == "\n\n".join(["word word"] * 20_000)
    assert got[4].text == "plain © text < 5" and got[6].text == "a\n\nb" and got[None].text == "x"
    assert got[5].text.startswith("cut off here")


def test_empty_table(spark):
    assert _extract(spark, []) == {}


def test_inference_finds_repetitions_optional_items_and_slots():
    pages = ["<div><h2>Same</h2><p>a</p><p>b</p></div>", "<div><h2>Same</h2><p>c</p></div>", "<div><h2>Same</h2><table></table><p>d</p></div>"]
    whole = None
    for p in pages:
        one = hw.page_wrapper(hw.parse(p))
        whole = one if whole is None else hw.merge(whole, one)
    div = whole[hw._KIDS][0]
    head, table, para = div[hw._KIDS]
    assert head[hw._KIDS][0][hw._FIXED] is not None  # the same on all pages: part of the template
    assert table[hw._SIG] == "table" and table[hw._PAGES] == 1  # optional
    assert para[hw._MANY] == 1 and para[hw._KIDS][0][hw._FIXED] is None  # repeated, with a variable slot


def test_repeated_groups():
    items = hw.page_wrapper(hw.parse("<dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl>"))[hw._KIDS][0][hw._KIDS]
    assert [k[hw._SIG] for k in items] == ["()"] and [k[hw._SIG] for k in items[0][hw._KIDS]] == ["dt", "dd"]


def test_attributes_are_told_apart_by_their_whole_names():
    for attributes in (
        'style="overflow:hidden"', "aria-hidden='false'", 'title="The hidden valley"', "data-id=footer", "data-role='search'", "data-class = 'ad'", 'title="a > id=nav b"',
        "title=is-hidden", 'alt="class=ad', "xml:id=nav",
    ):
        assert hw.signature("div", " " + attributes) == "div"
    for attributes in ("hidden", "HIDDEN=''", "title='a'hidden", "x=1 hidden/", 'ROLE="search"', "id=nav", "class = 'big ad'", "data-id=x id='footer'"):
        assert hw.signature("div", " " + attributes).startswith("div!")


def test_a_page_is_not_boilerplate_by_the_parts_its_class_names(spark):
    story = "<p>The <span style='overflow:hidden'>whole</span> story</p><div class='sidebar'>x</div>"
    bodies = [
        f"<body class='single has-sidebar'>{story}</body>", f"<html id='nav-fixed'><body class='no-comments ad-free'><main class='with-sidebar'>{story}</main></body></html>",
        f"<article style='overflow:hidden' class='share'>{story}</article>", f"<div class='has-sidebar' role='main'>{story}</div>", f"<div title='hidden'>{story}</div>",
    ]
    got = _extract(spark, [(n, f"http://h{n}.example", b) for n, b in enumerate([*bodies, "<article hidden>gone</article><main role='search'>gone</main>"])])
    assert [got[n].text for n in range(6)] == ["The whole story"] * 5 + [""]


def test_copies_of_a_page_are_no_template(spark):
    page = "<h1>Head of a page</h1><div><p>one block</p></div><table><tr><td>a <a href='x'>b</a> and many more words</td></tr></table><div class='ad'>{n}</div><script>{n}</script>"
    pages, want = [], {}
    for copies in (1, 2, 3, 20):
        for n in range(copies):
            key = copies * 1000 + n
            pages.append((key, f"http://short{copies}.example/{n}", "<div><p>text</p></div>"))
            pages.append((key + 100, f"http://long{copies}.example/{n}", page.format(n=n)))
            want[key], want[key + 100] = "text", "Head of a page\n\none block\n\na b and many more words"
    for n in range(5):
        pages.append((n, None, page.format(n=0)))
        want[n] = want[key + 100]
    for options in ({}, {"shipped_bytes": 0}):
        assert {n: r.text for n, r in _extract(spark, pages, **options).items()} == want


def test_a_page_of_template_strings_alone_keeps_them(spark):
    page = "<div><h2>Welcome</h2><p>to the <a href='x'>site</a> of all</p></div><ul><li><a href='y'>only links</a></li></ul>"
    got = _extract(spark, [(0, "http://h.example", page), *((n, "http://h.example", page + f"<section>story {n}</section>") for n in range(1, 5))])
    assert [got[n].text for n in range(5)] == ["Welcome\n\nto the site of all"] + [f"story {n}" for n in range(1, 5)]


def _strings(element):
    return [said for kid in element.kids for said in ([kid] if isinstance(kid, str) else _strings(kid))]


def test_dropped_elements_end_where_they_should():
    for page, want in (
        ("<p>one <svg class='i'/> two</p><p>three</p>", "one  two|three"),
        ("<p>one <SVG class='i' /> two</p><p>three <svg><title>no</title></svg> four</p>", "one  two|three  four"),
        ("<p>a <math/> b</p><svg><svg><g/></svg><text>no</text><svg/></svg>c", "a  b|c"),
        ("a<video-player src='x'>b</video-player><button-group>c</button-group><script-x>d</script-x><p>e", "a|b|c|d|e"),
        ("a<button>b<p>c</p><object data='x'>d", "ab|c|d"),
        ("a<button>b<button class='x'>no</button>c<select><option>no</select >d", "abcd"),
        ("a<button>no<!-- </button> --><b title='</button>'>no</b></button>b", "ab"),
        ("a<object><object>no</object>no</object>b<video><source src='x'></video><canvas>no</canvas\n>c", "abc"),
        ("a<script>var s = '<svg>';</script x>b<svg>no</svg>c<style/>no", "abc"),
        ("a<template><p>no", "a"),
        ("a<textarea>no<svg/>", "a"),
    ):
        got = hw.parse(page)
        texts = ["".join(k if isinstance(k, str) else "|" + "".join(_strings(k)) + "|" for k in got.kids)]
        assert [w for w in "".join(texts).split("|") if w] == want.split("|"), page


def test_a_page_goes_on_after_an_unclosed_element(spark):
    story = "<article><svg viewBox='0 0 1 1'/><p>one <button>two</p><video-player>three</video-player><p>four</p></article>"
    assert _extract(spark, [(1, "http://h.example", story)])[1].text == "one two\n\nthree\n\nfour"


def test_deep_nesting(spark):
    depth = 5000
    deep = "<html><body>" + "<div>" * depth + "<article><p>inside {n}</p></article>" + "</div>" * depth + "</body></html>"
    spans = "<article>" + "<section><b>" * depth + "text {n}"
    pages = [(n, "http://deep.example/", (deep if n % 2 else spans).format(n=n)) for n in range(6)]
    for options in ({}, {"shipped_bytes": 0}):
        got = _extract(spark, pages, **options)
        assert {n: r.text for n, r in got.items()} == {n: f"inside {n}" if n % 2 else f"text {n}" for n in range(6)}


def test_irregular_blocks(spark):
    rng = random.Random(3)
    pages, want = [], {}
    for n in range(3):
        names = rng.choices(["p", "div", "h2", "ul", "pre", "section"], k=20_000)
        pages.append((n, "http://odd.example/", "<article>" + "".join(f"<{t} class='{rng.choice('abcdefgh')}'>b{n} {k}</{t}>" for k, t in enumerate(names)) + "</article>"))
        want[n] = "\n\n".join(f"b{n} {k}" for k in range(20_000))
    assert {n: r.text for n, r in _extract(spark, pages).items()} == want


def test_generated_class_names_keep_wrappers_small(spark):
    rng = random.Random(4)
    odd = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    pages, want = [], {}
    for n in range(400):
        blocks = "".join(f"<div class='{odd()}'><p class='{odd()}'>story {n} {k}</p></div>" for k in range(12))
        pages.append((n, "http://odd.example/", f"<nav class='{odd()}'><a>menu</a></nav><main><article class='{odd()}'>{blocks}</article></main>"))
        want[n] = "\n\n".join(f"story {n} {k}" for k in range(12))
    frame = spark.createDataFrame([(p[1], p[2]) for p in pages], "url string, html string").repartition(4)
    assert max(len(r.wrapper) for r in hw.infer_wrappers(frame).collect()) < 200_000
    for options in ({}, {"shipped_bytes": 0}):
        assert {n: r.text for n, r in _extract(spark, pages, **options).items()} == want


def test_common_places_are_ascending_pairs_of_equals():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in range(2))
        pairs = hw.common_places(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert hw.common_places("abcabc", "abcabc") == [(i, i) for i in range(6)]
    assert hw.common_places("axbxc", "abc") == [(0, 0), (2, 1), (4, 2)]


def test_wrappers_as_text():
    one = hw.page_wrapper(hw.parse("<div class='x'><dl>" + "<dt>a</dt><dd>b</dd>" * 3 + "</dl><p>c<p>d</div>e"))
    assert hw.unpacked(hw.packed(one)) == one
