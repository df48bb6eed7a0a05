from sparkledger.llm import html_template as H


def page(k, body, lang="en"):
    nav = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5))
    return f"<!DOCTYPE html><html lang={lang}><head><title>T {k}</title><style>p{{}}</style><script>var t='</p><article>no</article>';</script></head><body><nav><ul>{nav}</ul></nav><div class='ad'>Buy {k} now</div><div id=content>{body}</div><div class='sidebar'>Other {k} words go here and on and on</div><form><label>Mail</label><input></form><footer>&copy; host &middot; {k}</footer></body></html>"


def test_slots_of_one_host():
    bodies = [f"<h1>Title &amp; {k}</h1><p>First para{k} of\n page  {k}.<br>Next&nbsp;line<p>Second one with more words {k * 7} and <b>bold {k}</b> text" for k in range(6)]
    got = H.extract([page(k, b) for k, b in enumerate(bodies)])
    assert got == [f"Title & {k}\n\nFirst para{k} of page {k}. Next line\n\nSecond one with more words {k * 7} and bold {k} text" for k in range(6)]


def test_article_element_and_comments():
    body = "<article><h1>Head</h1><p>Text one.</p><aside>skip</aside><ul><li>a</li><li>b</li></ul><div class='comments'><p>Nice!</p></div></article>"
    assert H.extract([page(0, body)]) == ["Head\n\nText one.\n\na\n\nb"]


def test_odd_sources():
    assert H.extract([None, "", "   "]) == ["", "", ""]
    assert H.extract(["just text &lt;b&gt; &#233;"]) == ["just text <b> é"]
    assert H.extract(["<p>cut off <b>here"]) == ["cut off here"]
    assert H.extract(["<p>a<!-- <p>no</p> --> b</p><script>x"]) == ["a b"]
    assert H.extract(["<div><p>a < b and 1 <2</p></div>"]) == ["a < b and 1 <2"]
    assert H.extract(["<p title='a>b'>x</p><"])[0].startswith("x")


def test_equivalence_classes():
    pages = [H.parse(page(k, f"<h1>h{k}</h1>" + "<p>w</p>" * (k + 1))) for k in range(4)]
    classes = H.equivalence_classes(pages)
    frame = next(t for v, t in classes if all(n == 1 for _, n in v) and len(v) == 4 and any(isinstance(x, str) and x.endswith("/nav") for x in t))
    assert any(isinstance(x, str) and x.endswith("div#content") for x in frame)
    assert ("/html/body/nav/ul/li/a", "Item") in {t for v, ts in classes for t in ts}


NOTICE, ADVERT = "We store data on your device so that the site works.", "Buy the best shoes of the year at half the price."


def plain_page(k, body, tag="div"):
    return f"<html><body><nav><a href='/{k}'>Item {k}</a></nav><{tag}><h1>Title {k}</h1><div class='x7'>{NOTICE}</div>{body}<div class='k2'>{ADVERT}</div></{tag}><footer>f</footer></body></html>"


def test_repeated_blocks_under_neutral_names_go():
    body = "<p>Own words of page {0} are {1} and more than that in all.</p><p>Read on.</p>"
    for tag in ("article", "div"):
        for n in (H.LEAST_PAGES, 30):
            got = H.extract([plain_page(k, body.format(k, 7 * k), tag) for k in range(n)])
            assert got == [f"Title {k}\n\nOwn words of page {k} are {7 * k} and more than that in all.\n\nRead on." for k in range(n)]
        few = H.extract([plain_page(k, body.format(k, 7 * k), tag) for k in range(H.LEAST_PAGES - 1)])
        assert all(NOTICE in t and ADVERT in t for t in few)
    # a notice that most pages have, but not nearly all, stays
    mixed = [plain_page(k, body.format(k, k)) if k % 3 else plain_page(k, body.format(k, k)).replace(NOTICE, f"No notice on page {k} of the host.") for k in range(30)]
    assert all(NOTICE in t for k, t in enumerate(H.extract(mixed)) if k % 3)


def test_copies_are_no_template():
    body = "<p>One article that the host shows under many addresses.</p><p>Its second paragraph is as long as the first.</p>"
    copies = [plain_page(0, body).replace("<a href='/0'>Item 0", f"<a href='/{j}'>Item {j}") for j in range(90)]
    others = [plain_page(k, f"<p>Words that only page {k} of them has, {3 * k} in all.</p>") for k in range(1, 11)]
    for pages in (copies + others, others + copies, copies):
        got = H.extract(pages)
        assert sum("One article that the host shows" in t and "Its second paragraph" in t for t in got) == 90
    assert not any(NOTICE in t for t in H.extract(copies + others))
    assert len({t for t in H.extract([copies[0]] * 50)}) == 1 and NOTICE in H.extract([copies[0]] * 50)[0]


def test_nested_classes():
    pages = [H.parse(f"<html><body><div id=a>{'<p>x</p>' * k}</div><div id=b><section>{'<h2>s</h2><ul></ul>' * (k % 2 + 1)}<b>{k}</b></section></div></body></html>") for k in range(1, 5)]
    root = H.template(pages, H.equivalence_classes(pages))
    assert root.tokens == ["/html", "/html/body", "/html/body/div#a", "/html/body/div#b", "/html/body/div#b/section", "/html/body/div#b/section/b"]
    inner = {g: [set(n.tokens) for n in ns] for g, ns in root.inner.items()}
    assert inner == {3: [{"/html/body/div#a/p"}], 5: [{"/html/body/div#b/section/h2", "/html/body/div#b/section/ul"}]}
    other = H.Node(["x"], {0: [(0, 0, 0), (9, 0, 0)]}, True)
    assert H.Node(["y"], {0: [(5, 0, 0)]}, True).gap(other) is None and other.gap(H.Node(["y"], {0: [(5, 0, 0)]}, True)) == 1


def test_table(spark):
    rows = [(k, f"https://host.example/{k}", page(k, f"<p>Words of {k}</p>")) for k in range(30)] + [(90, None, page(90, "<p>No url</p>")), (91, "bad", None), (None, "https://x.example", ""), (5, "https://host.example/5", page(5, "<p>Words of 5</p>"))]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    for most in (200, 7):
        for hot in (200_000, 0):
            out = H.main_text(pages, most=most, hot_hosts=hot).collect()
            assert len(out) == len(rows)
            got = {r.page_id: r.text for r in out}
            assert all(got[k] == f"Words of {k}" for k in range(30)) and got[90] == "No url" and got[91] == "" and got[None] == ""
            assert all(r.n_chars == len(r.text) for r in out)
    assert H.main_text(pages.limit(0)).count() == 0
