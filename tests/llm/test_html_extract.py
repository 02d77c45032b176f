import random
import time

from crosscut.llm.html_extract import Template, extract, main_text, page_template

NO_TEMPLATE = Template([], [], [])


def by_itself(source):
    return main_text(source, NO_TEMPLATE)


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy</div><article><h1>Head {0}</h1><p><b>Bold {0}&amp;co.<br><p>Second\n  line&nbsp;{0}.</p></article><footer>&copy; foot</footer>"


def test_pages_of_one_host(spark):
    rows = [(i, f"http://h.x/{i}", PAGE.format(i)) for i in range(6)]
    got = {r["page_id"]: (r["text"], r["n_chars"], r["url"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        text = f"Head {i}\nBold {i}&co.\nSecond line {i}."
        assert got[i] == (text, len(text), f"http://h.x/{i}")


def test_template_without_an_article(spark):
    page = "<body><div id=top>Site</div><div class=wrap><div class=x1><p>{0}</p><p>more {0}</p></div></div><div class='comments'>c {0}</div><div id=b>Same</div></body>"
    rows = [(i, "http://k.y/", page.format("words of page number " + "x" * i)) for i in range(1, 6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "words of page number xx\nmore words of page number xx"


def test_side_elements_within_the_article():
    html = "<article><header>H</header><p>a</p><aside>s</aside><form><input><p>f</p></form><div class='cookie-notice'>n</div><section id=comments><p>c</p></section><p>b &lt;i&gt; &#233;</p><script>x</script></article><p>out</p>"
    assert by_itself(html) == "a\nb <i> é"


def test_odd_markup():
    assert by_itself("") == ""
    assert by_itself("plain & simple < 3") == "plain & simple < 3"
    assert by_itself("<p>a<p>b<li>c") == "a\nb\nc"
    assert by_itself("<article>open <b>never</i> closed") == "open never closed"
    assert by_itself("<p title='a>b'>x</p><!-- <p>no</p>") == "x"
    assert by_itself("<p>cut <a href=").startswith("cut")
    assert by_itself("<script>never ends <p>x") == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, 3), (2, "x", "", 3), (3, "http://a/", "<p>q" * 50_000, 3), (3, "http://a/", "<p>q", 3)], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["n_chars"]) for r in extract(df).collect())
    assert got == [(1, 0), (2, 0), (3, 1), (3, 99_999)]
    assert extract(df.limit(0)).count() == 0


def test_names_within_the_slot(spark):
    page = "<body><article><h2 id=search>Search {0}</h2><section id=social-history><p>history {0}</p></section><p id=comment-period>period {0} <a class=related>link</a> <span class='search-term'>term</span></p><div class='comment-law'>law {0}</div><p>let <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> be</p><div class='cookie-notice'>c {0}</div><div class=share>s {0}</div></article>"
    rows = [(i, "http://n.x/", page.format(i)) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "Search 4\nhistory 4\nperiod 4 link term\nlaw 4\nlet x=4 be"


def texts(spark, page, fill):
    rows = [(i, "http://m.x/", page.format(*f)) for i, f in enumerate(fill)]
    return {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_all_changing_slots_without_what_is_constant(spark):
    page = "<body><div class=top>Site</div><article class=lead><h2>Lead</h2><p>first {0}</p></article><article class=same><p>Never new</p></article><div>between {0}</div><article class=body><p>second {0} and <b>more</b></p><div class=legal>All rights of the house</div></article>"
    assert texts(spark, page, [(i,) for i in range(6)])[3] == "Lead\nfirst 3\nsecond 3 and more"


def test_pages_with_a_varying_number_of_articles(spark):
    page = "<body><div class=wrap><div class=top>Site {0}</div>{1}</div>"
    got = texts(spark, page, [(i, "".join(f"<article><p>entry {k} of page {i}</p></article>" for k in range(i % 3 + 1))) for i in range(6)])
    assert got[1] == "entry 0 of page 1\nentry 1 of page 1"


def test_copies_of_one_page_keep_their_text(spark):
    assert texts(spark, "<body><article><p>one text</p></article>", [()] * 4)[2] == "one text"


def test_the_template_decides(spark):
    page = "<body><div class=q1><p>short {0}</p></div><div class=q2><p>{1}</p><div class=q4><a href=/>See</a> <a href=/>also</a></div></div><div class=q3>small {0}</div></body>"
    fill = [(i, "many words of the text of page number " + str(i)) for i in range(6)]
    got = texts(spark, page, fill)
    assert got[3] == "many words of the text of page number 3"
    # without it, nothing tells the parts of a page from each other
    assert main_text(page.format(*fill[3]), Template([1], [], [])) != "short 3\nmany words of the text of page number 3\nSee also\nsmall 3"


def test_names_are_the_last_evidence():
    kept = ["<div class=entry-header><h1>T</h1></div>", "<p class=post-header>T</p>", "<p id=share-price>T</p>", "<h2 class=comment>T</h2>"]
    kept += ["<p id=comment>T</p>", "<p><span class=ad>T</span></p>"]
    gone = ["<p class=advert>T</p>", "<div class=replies>T</div>", "<section id=discussion>T</section>", "<ul class='post-comments'><li>T</ul>", "<div role=alert>T</div>", "<div class='site-header'>T</div>", "<div class='x1 cookie-notice'>T</div>"]
    for part in kept:
        assert by_itself(f"<article>{part}<p>b</p></article>") == "T\nb"
    for part in gone:
        assert by_itself(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nb"


def test_a_named_element_with_most_of_the_text_is_spared(spark):
    page = "<body><div class=top>{0}</div><div class=notice><p>The notice of day {0} is long enough to be what this page is about.</p></div></body>"
    assert texts(spark, page, [(i,) for i in range(5)])[2] == "The notice of day 2 is long enough to be what this page is about."


def test_a_page_of_another_layout(spark):
    one = "<body><div class=w><p>the words of page {0} are these, and more of them</p></div><div class=b>x {0}</div></body>"
    rows = [(i, "http://o.x/", one.format(i)) for i in range(5)] + [(9, "http://o.x/", "<body><main><p>another layout</p></main><div class=b>x 9</div></body>")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "another layout" and got[1] == "the words of page 1 are these, and more of them"


def test_deep_pages_take_linear_time():
    took = []
    for n in (20_000, 100_000):
        source = "<div>" * n + "deep" + "</div>" * n
        t = time.time()
        assert by_itself(source) == "deep"
        took.append(time.time() - t)
    assert took[1] < 12 * took[0] + 1


def test_generated_hosts_without_article_tags(spark):
    """Brute force: hosts of random layouts, of which the main text is known."""
    rnd = random.Random(5)
    rows, want = [], {}
    for host in range(12):
        wrap = "".join(rnd.choice("abcdefgh") for _ in range(5))
        nest = rnd.randint(0, 3)
        before, after = rnd.randint(1, 3), rnd.randint(1, 3)
        for k in range(rnd.randint(4, 12)):
            words = lambda n: " ".join("".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
            blocks = [words(rnd.randint(10, 40)) for _ in range(rnd.randint(2, 7))]
            side = lambda i: f"<div class=s{i}>{words(rnd.randint(1, 6))}</div>"
            menu = "<ul>" + "".join(f"<li><a href=/>{words(1)}</a></li>" for _ in range(5)) + "</ul>"
            main = "<div class=i>" * nest + "".join(f"<p>{b.replace(' ', rnd.choice([' ', chr(10) + ' ']), 3)}" for b in blocks) + "</div>" * nest
            page = f"<html><head><title>{words(3)}</title></head><body>{menu}{''.join(side(i) for i in range(before))}<div class={wrap}>{main}</div>{''.join(side(9 - i) for i in range(after))}<footer>{words(9)}</footer></body></html>"
            key = len(rows)
            rows.append((key, f"http://h{host}.x/{k}", page))
            want[key] = "\n".join(blocks)
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_one_page_has_a_template_too():
    t = page_template("<body><article><p>a</p></article></body>")
    assert len(t.slots) == 1 and not t.dropped and not t.spared


def test_an_article_keeps_its_text_whatever_the_number_of_pages(spark):
    page = "<body><nav><a href=/>Menu</a></nav><article><h1>Title {0}</h1><p class=lead>Words of page {0}.</p><p class=fixed>All prices are in euro.</p><ul class=sources><li><a href=/s{0}>Source {0}</a></li></ul></article><footer>foot</footer></body>"
    for n in (1, 2, 3, 9):
        got = texts(spark, page, [(i,) for i in range(n)])
        assert got == {i: f"Title {i}\nWords of page {i}.\nAll prices are in euro.\nSource {i}" for i in range(n)}


def test_copies_of_one_text_under_other_titles_keep_it(spark):
    page = "<body><div class=top>{0}</div><article><h1>{0}</h1><div class=body><p>One long text that the pages of this host have in common.</p></div></article></body>"
    for n in (2, 5):
        assert texts(spark, page, [(f"t{i}",) for i in range(n)])[1] == "t1\nOne long text that the pages of this host have in common."
