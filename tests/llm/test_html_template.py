import html
import random
from collections import Counter, defaultdict

from signalmill.llm import html_template as H

WORDS = [f"word{i}" for i in range(400)]


def page(rnd, style):
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    paragraphs = [say(rnd.randrange(5, 60)) for _ in range(rnd.randrange(1, 6))]
    title = say(5)
    body = "".join(f"<p>{p.replace('word7', 'a &amp; b&nbsp;&lt;')}</p>" if rnd.random() < 0.7 else f"<p><b>{p}<br>" for p in paragraphs)
    want = [title, *(p.replace("word7", "a & b <") if f"<p><b>{p}<br>" not in body else p for p in paragraphs)]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (rnd.choice(WORDS) for _ in range(5)))
    if style == 0:
        html = f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div class="ad">{say(9)}</div><article><h1>{title}</h1>{body}</article><footer>&copy; {say(7)}</footer></body></html>'
    elif style == 1:
        html = f'<html><body><div class="top-menu">{menu}</div><div class="wrap"><div class="story"><h2>{title}</h2>{body}<p class="share">Share this</p><span>Read more</span></div><div class="sidebar">{say(20)}</div></div><div id="comments"><p>{say(30)}</p></div><form>{say(4)}<input></form></body></html>'
    else:
        html = f"<body><main><header><h1>{title}</h1></header>{body}<aside>{say(8)}</aside></main><div class='cookie-notice'>{say(6)}</div>"
    if rnd.random() < 0.1:
        html = html.removesuffix("</html>").removesuffix("</body>")
    return html, "\n".join(want)


def cases():
    rnd = random.Random(4)
    rows = []
    for i in range(240):
        style = i % 3
        html, want = page(rnd, style)
        rows.append((i, f"http://{'big' if i % 2 else 'h' + str(i % 5)}-{style}.example.org/{i}", html, want))
    alone, text = page(rnd, 0)
    return [*rows, (900, "http://alone.example.com/", alone, text), (901, None, None, ""), (902, "x", "", ""), (903, "x", "no tags  here\n&am", "no tags here &am"), (904, "x", "<p>a < b and <", "a < b and <")]


def test_texts(spark):
    docs = spark.createDataFrame([(*r[:3], "t") for r in cases()], "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r for r in H.main_texts(docs).collect()}
    for i, url, _, want in cases():
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == url, i
    assert H.main_texts(docs.limit(0)).count() == 0
    joined = H.main_texts(docs, options=H.TemplateOptions(broadcast_tokens=0)).collect()
    assert {(r.page_id, r.text) for r in joined} == {(i, r.text) for i, r in got.items()}


def host_rows():
    return [((r[1] or "//").split("/")[2], r[0], r[2]) for r in cases()[:120]]


def plain_vectors(rows):
    """By host and token: in which pages it stands how often."""
    vectors = defaultdict(Counter)
    for h, i, t in rows:
        for token, (n, *_) in H.page_tokens(H.Page(t)).items():
            vectors[h, token][i] = n
    return vectors


def test_occurrences_and_classes_against_brute_force(spark):
    options = H.TemplateOptions()
    docs = spark.createDataFrame(host_rows(), "host string, id long, html string").repartition(5)
    vectors = plain_vectors(host_rows())
    counted = {(r.host, r.token): r for r in H.occurrences(docs).collect()}
    assert {k: (r.pages, r.total) for k, r in counted.items()} == {k: (len(v), sum(v.values())) for k, v in vectors.items()}
    found = H.templates(docs, options).collect()
    parent = {(r.host, r.token): r.parent for r in found}
    frequent = {(h, t) for (h, t), v in vectors.items() if len(v) >= options.share * len(vectors[h, 0]) and len(vectors[h, 0]) >= options.least_pages}
    assert set(parent) == frequent

    def outside(h, t):
        """The nearest element around a token that has another vector."""
        while (h, t) in parent and t:
            up = parent[h, t]
            if vectors[h, up] != vectors[h, t]:
                return up
            t = up
        return 0

    for r in found:
        same = {t for h, t in frequent if h == r.host and vectors[h, t] == vectors[r.host, r.token] and outside(h, t) == outside(r.host, r.token)}
        assert r["class"] == (min(same) if len(same) > 1 else None)


def test_tokens_out_of_order_leave_their_class(spark):
    pages = [f"<body><div class=a>x{i}</div><div class=b>y{i}</div><div class=c>z</div></body>" if i % 2 else f"<body><div class=b>y{i}</div><div class=a>x{i}</div><div class=c>z</div></body>" for i in range(12)]
    rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, id long, html string")
    options = H.TemplateOptions()
    template = H.templates(rows, options)
    wrong = {r.token for r in H.misplaced(rows, template, options).collect()}
    keys = {n: next(k for k, t in zip(H.Page(pages[0]).key, H.Page(pages[0]).tag) if k == H.path_key(H.path_key(0, "body"), f"div.{n}")) for n in "abc"}
    assert {keys["a"], keys["b"]} <= wrong and keys["c"] in wrong and H.path_key(0, "body") not in wrong
    steady = [f"<body><div class=a>x{i}</div><div class=b>y{i}</div></body>" for i in range(12)]
    rows = spark.createDataFrame([("h", i, p) for i, p in enumerate(steady)], "host string, id long, html string")
    assert H.misplaced(rows, H.templates(rows, options), options).count() == 0


def plain_extract(pages, options):
    """Main texts by the definition, with whole occurrence vectors, for hosts whose pages name nothing: fixed texts and menus go,
    the rest is what the lowest container of all open text holds."""
    parsed = {i: H.Page(t) for i, t in pages.items()}
    vectors = plain_vectors([("", i, t) for i, t in pages.items()])
    share = {t: v for (_, t), v in vectors.items() if len(v) >= options.fixed_share * len(pages)}
    out = {}
    for i, page in parsed.items():
        lines = []
        for e, text, block, link in page.texts:
            key = H.text_key(page.key[e], text)
            fixed = key in share and any(o != key and share[o] == share[key] for o in share)
            if text.strip() and not fixed and not link:
                if not lines or lines[-1][0] != block:
                    lines.append([block, ""])
                lines[-1][1] += text
        out[i] = "\n".join(" ".join(html.unescape(x).split()) for _, x in lines)
    return out


def neutral(rnd, i, notice, foot, menu):
    """A page without tags or names that mean anything."""
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    parts = "".join(f"<div class=k4>{say(rnd.randrange(8, 40))}</div>" for _ in range(rnd.randrange(1, 5)))
    links = "".join(f"<span><a href=/{w}>{w}</a></span>" for w in rnd.sample(WORDS, 6)) if menu else ""
    return f"<body><div class=k1>{notice}</div><div class=k2>{links}</div><div class=k3><div class=k5>{say(6)}</div>{parts}<div class=k6>{foot}</div></div><div class=k7>{foot} {notice}</div></body>"


def test_template_decides_where_names_mean_nothing(spark, monkeypatch):
    rnd = random.Random(12)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    notice, foot = say(18), say(5)
    pages = {i: neutral(rnd, i, notice, foot, menu=True) for i in range(30)}
    docs = spark.createDataFrame([(i, "http://n.example.org/", p) for i, p in pages.items()], "page_id long, url string, html string").repartition(4)
    want = plain_extract(pages, H.TemplateOptions())
    assert all(notice not in x and foot not in x and x for x in want.values())
    got = {r.page_id: r.text for r in H.main_texts(docs).collect()}
    assert got == want
    # without the template all of that stays
    off = {r.page_id: r.text for r in H.main_texts(docs, options=H.TemplateOptions(least_pages=10_000)).collect()}
    assert all(notice in off[i] and foot in off[i] for i in pages)


def test_names_do_not_decide_on_what_holds_the_text(spark):
    rnd = random.Random(13)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    bodies = [say(30 + i) for i in range(24)]
    for kind in ("social-history", "sidebar", "comments"):
        pages = [f"<body><div class={kind}><p>{b}</p></div><div class=widget>{say(7)}</div></body>" for b in bodies]
        # a page with hardly any text in it follows its host
        pages.append(f"<body><div class={kind}><p>short</p></div><div class=widget>{say(40)}</div></body>")
        assert texts_of(spark, pages) == {**{i: [b] for i, b in enumerate(bodies)}, 24: ["short"]}, kind
    assert texts_of(spark, [f"<body><div class=social-history><p>{bodies[0]}</p></div></body>"]) == {0: [bodies[0]]}


def test_broken_quotes_and_depth():
    assert H.extract(H.Page('<p class="a>Hello</p><p class="b">World</p>there')) == "World\nthere"
    assert H.extract(H.Page("<p>one<p class='x>two")) == "one"
    assert H.extract(H.Page("<p title='a > b' data-hidden=1>Yes <a href=/x/y>link</a> <br/>no</p>")) == "Yes link\nno"
    deep = H.Page("<div>" * 100_000 + "text" + "</div>" * 100_000 + "<b>" * 50_000 + "<p>x" * 20_000)
    assert H.extract(deep).startswith("text\nx") and len(deep.key) == 170_001
    assert H.page_tokens(H.Page("<div>" * 30_000 + "text"))[0][1] == 4


def texts_of(spark, pages, host="http://one.example.org/"):
    docs = spark.createDataFrame([(i, f"{host}{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n") for r in H.main_texts(docs).collect()}


def test_open_text_beside_the_largest_container_stays(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    pages, want = [], []
    for i in range(24):
        head, lead, body, cell = say(6), say(15), say(90), say(12)
        if i % 3 == 0:
            pages.append(f"<body><article><h1>{head}</h1><div class=lead>{lead}</div><div class=body><p>{body}</p></div></article></body>")
            want.append([head, lead, body])
        elif i % 3 == 1:  # a linked headline, split sections
            pages.append(f"<body><article><h1><a href=x>{head}</a></h1><section class=a><p>{body}</p></section><section class=b>{lead}</section></article></body>")
            want.append([head, body, lead])
        else:
            pages.append(f"<body><article><p>{lead}</p><table><tr><th>{head}</th><td>{body}</td></tr><tr><td>{cell}</td></tr></table></article></body>")
            want.append([lead, head, body, cell])
    for k in range(3):  # each kind as a host of its own, and all in one
        assert texts_of(spark, pages[k::3]) == dict(enumerate(want[k::3]))
    assert texts_of(spark, pages) == dict(enumerate(want))
    assert texts_of(spark, pages[:2]) == dict(enumerate(want[:2]))
    odd = ["<body><article><div class=body>a</div></article><div class=x>" + say(40) + "</div></body>"]
    assert len(texts_of(spark, [*pages[::3], *odd])[8]) == 2


def test_repeated_texts_of_any_length_and_name_go(spark):
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    notice, low = say(30), say(25)
    bodies = [say(80 + i) for i in range(20)]
    pages = [f"<body><div class=page><p>{notice}</p><div class=text><p>{b}</p></div></div><div class=low>{low}</div></body>" for b in bodies]
    assert texts_of(spark, pages) == {i: [b] for i, b in enumerate(bodies)}
    # copies of one page are no template
    assert texts_of(spark, pages[:1] * 20) == {i: [notice, bodies[0], low] for i in range(20)}


def test_listed_words_leave_the_container_of_the_text(spark):
    rnd = random.Random(8)
    body, side = (" ".join(rnd.choice(WORDS) for _ in range(n)) for n in (60, 20))
    for kind in ('div class="content has-sidebar"', "div class=page-with-header", "div id=header-page", "form id=aspnet", "div class=sidebar"):
        rest = "" if kind.endswith("=sidebar") else f"<div class=sidebar>{side}</div>"
        assert texts_of(spark, [f"<body><{kind}><p>{body}</p>{rest}</{kind.split()[0]}></body>"]) == {0: [body]}, kind
    page = f"<body><div class=story><p>{body}</p></div><div class=comment-list>{side}</div><form>{side}</form></body>"
    assert texts_of(spark, [page]) == {0: [body]}


def test_comments_and_other_named_slots_never_outweigh_an_article(spark):
    rnd = random.Random(31)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    frames = {
        "article": ("<article><p>{0}</p></article>", "<section class=comments>{1}</section>"),
        "in it": ("<article><p>{0}</p>", '<div class="comment-list">{1}</div></article>'),
        "articles in lists": ("<main><p>{0}</p></main>", "<ol id=comments><li><article class=comment-body>{1}</article></li></ol>"),
        "unnamed": ("<div class=story><p>{0}</p></div>", "<div class=replies>{1}</div>"),
        "form": ("<form id=all><article><p>{0}</p></article>", "<footer>{1}</footer></form>"),
        "hints": ("<article><p>{0}</p></article>", "<div class=site-footer>{1}</div>"),
    }
    for name, (first, second) in frames.items():
        for many in (1, 3, 8, 40):
            bodies = [say(30 + i) for i in range(12)]
            comments = ["".join(f"<p>{say(25)}</p>" for _ in range(many)) for _ in bodies]
            pages = [f"<body>{first.format(b, c)}{second.format(b, c)}</body>" for b, c in zip(bodies, comments, strict=True)]
            assert [H.extract(H.Page(p)) for p in pages] == bodies, (name, many)  # each alone
            if many in (3, 40) and name in ("article", "unnamed"):
                assert texts_of(spark, pages) == {i: [b] for i, b in enumerate(bodies)}, (name, many)
        long = f"<body>{first.format('Short text.', say(3000))}{second.format('Short text.', say(3000))}</body>"
        if name != "unnamed":
            assert H.extract(H.Page(long)) == "Short text.", name
    # a host with one long thread, and one page of comments alone
    bodies = [say(40) for _ in range(12)]
    pages = [f"<body><article><p>{b}</p></article><section class=comments><p>{say(4000 if i == 3 else 5)}</p></section></body>" for i, b in enumerate(bodies)]
    pages.append(f"<body><article></article><section class=comments><p>{say(300)}</p></section></body>")
    got = texts_of(spark, pages)
    assert {i: got[i] for i in range(12)} == {i: [b] for i, b in enumerate(bodies)} and got[12] == [""]


def test_hosts_of_few_pages_have_a_template(spark):
    rnd = random.Random(32)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    notice, low = say(20), say(8)
    for n in (5, 8, 9, 10):
        bodies = [say(60 + i) for i in range(n)]
        menu = "".join(f"<span><a href=/{w}>{w}</a></span>" for w in WORDS[:6])
        pages = [f"<body><div class=k0>{menu}</div><div class=k1><p>{notice}</p></div><div class=k2><p>{b}</p></div><div class=k3>{low}</div></body>" for b in bodies]
        assert texts_of(spark, pages) == {i: [b] for i, b in enumerate(bodies)}, n
