"""Min-cut extraction: the cut against all labellings, pages of many shapes, edges."""
import itertools
import random

import pytest

from ownerlens.llm import extraction as x

LONG = "A sentence that is long enough to count as running text, with some commas, and a good deal more than eighty characters."


def cost(source, sink, edges, side):
    return sum(source[v] for v in range(len(side)) if not side[v]) + sum(sink[v] for v in range(len(side)) if side[v]) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_least_of_all_labellings():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 8)
        source, sink = ([rnd.choice([0.0, 0.5, 1.0, 3.0, 6.0]) for _ in range(n)] for _ in range(2))
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([0.3, 0.6, 2.0])) for _ in range(rnd.randint(0, 2 * n))]
        edges = [e for e in edges if e[0] != e[1]]
        got = x.min_cut(source, sink, edges)
        best = min(cost(source, sink, edges, s) for s in itertools.product([False, True], repeat=n))
        assert cost(source, sink, edges, got) == pytest.approx(best)


PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
    f"<!-- ad --><div class=\"ad\">{LONG} ad</div><article><h1>Head &amp; line</h1><p><b>First\n part.<br><p>{LONG}</p><p>Short.</p></article>"
    f"<footer>&copy; me</footer>": ["Head & line", "First part.", LONG, "Short."],
    f"<body><header><a href='/'>Logo</a><p>{LONG} site</p></header><main><header><h1>Title</h1></header><p>{LONG}</p><aside>{LONG} side</aside>"
    f"<section id='comments'><article class='comment'><p>{LONG} reader</p></article></section></main><div class='cookie-notice'>{LONG} cookie</div>": ["Title", LONG],
    f"<div id=wrap><div class='menu'><a href=1>One</a> <a href=2>Two</a></div><div class='post-body'><h2>H</h2><p>{LONG}</p><p>Why?</p><p>{LONG} b</p>"
    f"<form><p>{LONG} form</p></form></div><div class=\"sidebar\"><p>{LONG} bar</p></div></div>": ["H", LONG, "Why?", f"{LONG} b"],
    f"<p>{LONG}<p>{LONG} two<div>Log in</div>": [LONG, f"{LONG} two"],
    f"<table><tr><td>{LONG}<td>{LONG} cell</table><ul><li>{LONG} item</ul>": [LONG, f"{LONG} cell", f"{LONG} item"],
    f"<article><p title='a>b'>{LONG}&nbsp;&lt;x&gt;</p>": [f"{LONG} <x>"],
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert x.extract(page) == "\n\n".join(PAGES[page])


def test_edges(spark):
    huge = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (2, "u", "<p></p>", "t"), (None, None, f"<article><p>é {LONG}</p>", "t"), (3, "u", huge, "t"), (4, "u", "<a <b <", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = x.main_text(pages).collect()
    assert len(got) == len(rows) and [f for f in got[0].__fields__] == ["page_id", "url", "text", "n_chars"]
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "" and by[1]["n_chars"] == 0 and by[2]["text"] == ""
    assert by[None]["text"] == f"é {LONG}" and by[3]["text"].count("\n\n") == 4999
    assert x.main_text(pages.limit(0)).count() == 0


TEXT = "A sentence of the article that is long enough to be told from a label or a link by its length alone. "


@pytest.mark.parametrize("page,text", [
    (f'<body class="has-sidebar"><div><p>{TEXT}</p></div></body>', TEXT),
    (f'<main class="content with-sidebar"><p>{TEXT}</p><p>Short.</p></main>', TEXT.strip() + "\n\nShort."),
    (f'<article class="post ad-free"><p>{TEXT}</p></article>', TEXT),
    (f'<html class="no-js menu"><body class="nav-open"><p>{TEXT}</p></body></html>', TEXT),
    ("<body><div><p>One.</p><p>Two words.</p><p>And three.</p></div></body>", "One.\n\nTwo words.\n\nAnd three."),
    (f"<article><p title=\"it>{TEXT}</p><p>End.</p></article>", TEXT.strip() + "\n\nEnd."),
    (f"<article><p title='it>{TEXT}</p></article>", TEXT),
    (f'<article><p>{TEXT}</p><p class="ad">Buy now</p><p>{TEXT}</p></article>', TEXT.strip() + "\n\n" + TEXT.strip()),
    (f'<article><p>{TEXT}</p><section class="comments"><p>{TEXT}</p></section></article>', TEXT),
])
def test_one_class_word_does_not_take_a_page(page, text):
    assert x.extract(page) == text.strip()


def test_the_cut_decides_where_signs_are_weak():
    """Short lines among long ones of their kind are content; a long line among linked ones of their kind is not."""
    article = "".join(f'<li class="t">{TEXT if k % 2 else f"Line {k}."}</li>' for k in range(9))
    links = "".join(f'<li class="r"><a href="#">Story {k}</a></li>' for k in range(4))
    menu = f'<div>{links}<li class="r"><a href="#">{TEXT}</a></li>{links}</div>'
    found = x.blocks(f"<body><ul>{article}</ul><hr>{menu}</body>")
    pairs = [x.costs(b) for b in found]
    alone = [no > yes for yes, no in pairs]
    cut = x.min_cut([no for _, no in pairs], [yes for yes, _ in pairs], x.smoothness(found))
    right = [b.kind[1] == ("t",) for b in found]
    assert cut == right and sum(a != r for a, r in zip(alone, right)) >= 4


def test_no_single_sign_outweighs_the_edges_to_two_neighbours():
    edges = 2 * (x.ADJACENT + x.SIBLING + x.ALIKE)
    assert max(x.TAG_COST, x.WORD_COST, x.LINK_COST, x.LONG_GAIN, x.SHORT_COST) < edges
