"""HTML extraction on pages whose main text is known."""

import random

import numpy as np

from histora.llm import html

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor & < > é ß “quoted”".split()


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&#62;").replace("é", "&eacute;")


def page(rng, wrap, closing=True):
    blocks = [" ".join(rng.choices(WORDS, k=rng.choice([1, 2, 5, 40, 120]))) for _ in range(rng.randint(3, 12))]
    junk = " ".join(rng.choices(WORDS, k=60))
    body = f"<h1>{escaped(blocks[0])}</h1>" + "".join(f"<p> <b>{escaped(b)}</b>\n" + "</p>" * closing for b in blocks[1:])
    top = f"<nav><ul><li><a href=/>{escaped(junk)}</a></ul></nav><header><p>{escaped(junk)}</p></header><div class='cookie-notice'>{escaped(junk)}</div>"
    end = f"<aside><p>{escaped(junk)}</p></aside><section id=comments><article><p>{escaped(junk)}</p></article></section><form><p>{escaped(junk)}</form><footer>{escaped(junk)}"
    head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
    return f"{head}{top}<{wrap}>{body}<div class=\"ad\">{escaped(junk)}</div></{wrap}>{end}", "\n\n".join(" ".join(b.split()) for b in blocks)


def test_known_pages(spark):
    rng = random.Random(4)
    pages = [page(rng, wrap, closing) for wrap in ("article", "main", "div class=content", "section") for closing in (True, False) for _ in range(15)]
    pages = [(h.replace("</div class=content>", "</div>"), t) for h, t in pages]
    rows = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(rows).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(pages)}


def test_odd_pages(spark):
    odd = [None, "", "plain words", "<", "<p", "<!-- open", "<b>" * 20_000 + "deep", "<article><p>" + "long " * 50_000, "<script>x", "<p>a<br>b&nbsp;c\n d<p>&notin;&#x41;&bogus;"]
    rows = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)] + [(2, None, odd[2])], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html.extract(rows).collect())
    texts = dict(got)
    assert len(got) == len(odd) + 1
    assert texts[0] == texts[1] == "" and texts[2] == "plain words" and texts[6] == "deep" and texts[8] == ""
    assert texts[7] == ("long " * 50_000).strip()
    assert texts[9] == "a b c d\n\n∉A&bogus;"
    assert html.extract(rows.limit(0)).count() == 0


def test_smoothing_keeps_constants_and_mass():
    assert np.allclose(html.smoothed(np.full(7, 3.0)), 3.0)
    bump = html.smoothed(np.array([0, 0, 0, 0, 9.0, 0, 0, 0, 0]))
    assert bump.argmax() == 4 and np.allclose(bump, bump[::-1])


def test_articles_are_regions_among_others():
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices("lorem ipsum dolor sit amet consectetur".split(), k=n))
    one, two, three = text(120), text(90), text(60)
    cards = "".join(f"<article><ul><li><a href=/{i}>Card</a><li><a href=/>More</a></ul></article>" for i in range(12))
    found = html.main_text(f"<body><div><p>{one}<p>{two}</div>{cards}</body>").split("\n\n")
    assert found[:2] == [one, two] and len(found) < 12
    assert html.main_text(f"<body><article><p>{one}</article><article class=comment><p>{three}</article></body>") == one


def test_marks_on_wrappers():
    words = "lorem ipsum dolor sit amet " * 20
    page = f"<body><div class=sidebar-right><div id=header-fixed><div><p>{words}<span class=ad>buy</span></div><div class=ad>{words[:50]}</div></div></div>"
    assert html.main_text(page) == words.strip()
    assert html.main_text(f"<body><div hidden><p>{words}</div><p>short") == "short"


def plain_page(rng, blocks):
    """A page whose elements and names tell nothing: links, a text, more links."""
    links = "".join(f"<div><a href=/{i}><span>{' '.join(rng.choices(WORDS[:8], k=2))}</span></a></div>" for i in range(15))
    return f"<body><div>{links}</div><div>{''.join(f'<p>{escaped(b)}</p>' for b in blocks)}</div><div>{links}</div></body>"


def test_ratios_alone_split_a_page():
    rng = random.Random(8)
    for _ in range(40):
        blocks = [" ".join(rng.choices(WORDS, k=rng.choice([3, 30, 60, 90]))) for _ in range(rng.randint(4, 9))]
        blocks[1] = " ".join(rng.choices(WORDS, k=80))
        assert html.main_text(plain_page(rng, blocks)).split("\n\n") == blocks


def test_the_threshold_decides(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choices(WORDS[:12], k=80))
    pages = [plain_page(rng, [text] * 4), f"<nav><a>Home</a></nav><article><p>{text}</article><footer>{text}</footer>"]
    found = [html.main_text(p) for p in pages]
    assert found == ["\n\n".join([text] * 4), text]
    monkeypatch.setattr(html, "THRESHOLD", -1e9)
    for page, before in zip(pages, found):
        after = html.main_text(page)
        assert before in after and len(after) > len(before)


def test_tables_lists_and_pre_outside_of_articles():
    rng = random.Random(10)
    text = lambda n: " ".join(rng.choices(WORDS[:12], k=n))
    head, one, two, cells, items = text(4), text(70), text(50), [text(3) for _ in range(4)], [text(9) for _ in range(3)]
    table = f"<table><tr><th>{cells[0]}<th>{cells[1]}<tr><td>{cells[2]}</td><td>{cells[3]}</td></table>"
    body = f"<h2>{head}</h2><p>{one}{table}<ul>{''.join(f'<li>{i}' for i in items)}</ul><pre>  x = 1\n\n  y =  2</pre><p>{two}"
    assert html.main_text(f"<main>{body}</main><footer>{one}</footer>").split("\n\n") == [head, one, *cells, *items, "x = 1 y = 2", two]
    assert html.main_text(f"<nav><li>{head}</nav><footer>{one}</footer>") == ""


def test_an_article_keeps_its_header_footer_and_warnings():
    text = "lorem ipsum dolor sit amet consectetur " * 8
    head, one, two, three = "A short title", f"{text}one", f"{text}two", f"{text}three"
    around = lambda article: f"<body><nav><a href=/>Home</a></nav><article>{article}</article><footer><p>{text}</footer>"
    assert html.main_text(around(f"<header><h1>{head}</h1></header><p>{one}<p>{two}")).split("\n\n") == [head, one, two]
    assert html.main_text(around(f"<p>{one}<section class=warning><p>{two}</p><p>{three}</p></section>")).split("\n\n") == [one, two, three]
    assert html.main_text(around(f"<p>{one}<footer><p>{two}</p></footer>")).split("\n\n") == [one, two]
    # a footer of links has too low a ratio
    links = "".join(f"<li><a href=/{i}><b>tag</b></a>" for i in range(6))
    assert html.main_text(around(f"<p>{one}<p>{two}<footer><ul>{links}</ul></footer>")).split("\n\n") == [one, two]


def test_names_lower_a_weight_and_do_not_cancel_it():
    text = "lorem ipsum dolor sit amet consectetur " * 8
    page = f"<body>{'<div><p><b><i>a</i></b></p><p>b</p></div>' * 4}<div class=ad><p>{text * 40}</p><p>{text * 40}</p></div><div class=menu><p>c</p></div>{'<p>' + text * 50}"
    lines = html.Lines().of(page)
    assert {weight for *_, weight in lines} == {1.0, html.FOREIGN}
    # very dense text passes against the name where nothing else on the page comes near
    sparse = "".join(f"<div><span><b><i>x{i}</i></b></span></div>" for i in range(600))
    assert html.main_text(f"<body>{sparse}<aside>{f'<p>{text * 6}</p>' * 12}</aside>").count((text * 6).strip()) == 12
