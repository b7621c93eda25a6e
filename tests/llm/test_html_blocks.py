"""HTML extraction: what marks, surges and boilerplate words may not cut away."""

import html as entities
import re
import time

import numpy as np
import pytest

from metaloom.llm import html
from metaloom.llm.html import extract

LONG = " ".join(["real text of the article"] * 8)
MORE = " ".join(["another long paragraph"] * 8)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<body><article><p>Teaser</p></article><div><p>{LONG}</p><p>{MORE}</p></div></body>", f"Teaser\n{LONG}\n{MORE}"),
        (f"<body><main><p>Part</p></main><div><h1>Title</h1><p>{LONG}</p></div></body>", f"Part\nTitle\n{LONG}"),
        (f"<body><div>Site blurb</div><article><h1>T</h1><p>{LONG}</p><p>end</p></article></body>", f"T\n{LONG}\nend"),
        (f"<body><article><p>{LONG}</p></article><article><p>Teaser</p></article></body>", LONG + "\nTeaser"),
        (f"<body><div><h1>A short title</h1><p>By Someone</p><p>1 May 2020</p><p>Kicker</p><p>{LONG}</p></div></body>", f"A short title\nBy Someone\n1 May 2020\nKicker\n{LONG}"),
        (f"<body><div><p>{LONG}</p><p>{MORE}</p><form><p>Sign</p><p>up</p><p>now</p><p>!</p></form><p>The end.</p></div></body>", f"{LONG}\n{MORE}\nThe end."),
        (f"<body><div><p>{LONG * 6}</p><form><p>a</p><p>b</p><p>c</p></form></div><div><p>{MORE}</p></div></body>", f"{LONG * 6}\n{MORE}"),
        (f"<div class='content with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='post share-enabled'><p>{LONG}</p><div class=share>Share this</div></div>", LONG),
        (f"<article class='has-comments'><p>{LONG}</p><div id=comments><p>{MORE}</p></div></article>", LONG),
        (f"<div class='layout-sidebar'><p>{LONG}</p><p>{MORE}</p></div><div class=ad>Buy</div><p>small</p>", f"{LONG}\n{MORE}\nsmall"),
        (f"<article><p>{LONG}</p><div class='related-work'><h2>Related</h2><p>{MORE}</p></div><div class='social-history'><p>{LONG}</p></div><p><math><mi>x</mi></math> is</p><div class=related><a href=1>One</a></div></article>", f"{LONG}\nRelated\n{MORE}\n{LONG}\nx is"),
        (f"<div><p>{LONG}</p><p><a href=x>A cited source</a></p><p>{MORE}</p></div>", f"{LONG}\nA cited source\n{MORE}"),
    ],
)
def test_kept(page, want):
    assert extract(page) == want


def slow_runs(weight):
    """Line by line: a run begins at a line with weight and ends where a whole window has none."""
    runs, i = [], 0
    while i < len(weight):
        if not weight[i]:
            i += 1
            continue
        j = i
        while j < len(weight) and any(weight[j : j + html.WINDOW]):
            j += 1
        runs.append((i, j, [k for k in range(i, j) if sum(weight[k : k + html.WINDOW]) > html.SURGE], sum(weight[i:j])))
        i = j
    return runs


def test_runs():
    r = np.random.default_rng(5)
    for _ in range(300):
        w = (r.integers(0, 90, r.integers(1, 40)) * (r.random() < r.random(1))).astype(np.int64)
        w[r.random(len(w)) < 0.4] = 0
        assert [(i, j, at.tolist(), t) for i, j, at, t in html._runs(w)] == slow_runs(w.tolist())


def test_pages(spark, monkeypatch):
    """Every page by surge and dive, against the text between its article's tags."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    surges = []
    runs = html._runs
    monkeypatch.setattr(html, "_runs", lambda w: surges.append(got := runs(w)) or got)
    for r in rows:
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|br|ul|li|div)[^>]*>", body)]
        surges.clear()
        assert extract(r.html) == "\n".join(x for x in blocks if x)
        assert any(len(at) for _, _, at, _ in surges[-1]) or len(extract(r.html)) <= html.SURGE
    assert len(rows) == 250


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><p>{LONG}</p><script src='a'/>alert(1)</script><style media='x'/>.a{{color:red}}</style><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
        (f"<article><p>{LONG}</p><svg class=x/><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
        (f'<article><p>{LONG}</p><p title="foo>tail text</p></article>', f"{LONG}\ntail text"),
        (f"<article><p>{LONG}</p><div class='kommentare'><p>{MORE}</p></div><div class='werbung'>Jetzt kaufen</div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='commentaires'><p>{MORE}</p></div><div class='publicidad'>Compre ya</div></article>", LONG),
        (f"<article><p>a < b and {LONG}</p><p>1 <2</p></article>", f"a < b and {LONG}\n1 <2"),
        (f"<article><p data-x='a>b' data-y=\"c>d\" z = 'e>f'>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><!-- {MORE} --><p>end</p><!-- open {MORE}</article>", f"{LONG}\nend"),
        (f"<article><p>{LONG}</p><video><source src=x><p>{MORE}</p></article>", f"{LONG}\n{MORE}"),
        (f"<article><p>{LONG}</p><script>if (a</b) {{}}<p>", LONG),
    ],
)
def test_markup(page, want):
    assert extract(page) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000 + "'", "<div>" * 200_000 + LONG, "<div class=ad>" * 60_000 + LONG, "</b>" * 250_000 + f"<p>{LONG}</p>", "<b></i>" * 120_000 + f"<p>{LONG}</p>", "<p x='" * 150_000, "<script </script " * 60_000, "<svg>" * 200_000, "<!--" * 250_000, "<section class=comments><p>x</p>" * 30_000, "< " * 500_000, "<a href=\"x" * 90_000, "&amp" * 250_000],
)
def test_long_pages_take_time_in_proportion(page):
    began = time.process_time()
    extract(page)
    assert time.process_time() - began < 12


def test_nested_boilerplate_is_taken_back_from_the_outside():
    deep = "<div class=ad>" * 500
    assert extract(f"{deep}<p>{LONG}</p>" + "</div>" * 500 + "<div class=ad>Buy</div>") == LONG
