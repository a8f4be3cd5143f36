"""HTML extraction on pages it has not learned from, the linear scan against all regions, and names that are joined."""

import numpy as np
import pytest

from graincart.llm import html

WEIGHTS = html.weights_from(html.labelled_pages())


def read(page):
    return html.main_text(page, WEIGHTS)


@pytest.mark.parametrize("seed", range(40))
def test_scan_equals_all_regions(seed):
    rng = np.random.default_rng(seed)
    scores = [float(x) for x in rng.integers(-4, 5, int(rng.integers(0, 40)))]
    best, span = 0.0, (0, 0)
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(scores[a:b])
            if total > best:
                best, span = total, (a, b)
    a, b = html.best_region(scores)
    assert sum(scores[a:b]) == best and (best > 0 or (a, b) == span)


P = "The harvest was brought in before the storm came over the hills, and everyone in the valley helped until late in the night."
Q = "Another paragraph tells how the neighbours shared what they had saved, and how the long winter went on after that for all of them."
R = "Readers say that none of this is true, and that the valley was empty that year because the river had taken the old bridge."
BODY, WANTED = f"<h1>Harvest</h1><p>{P}</p><p>{Q}</p>", f"Harvest\n{P}\n{Q}"

NEWS = f"""<!doctype html><html><head><title>Harvest - The Valley</title><style>a{{}}</style></head><body class="single has-sidebar no-comments"><a class="skip-link" href="#c">Skip to content</a>
<div id="cookieBanner" class="cookie-banner"><p>We and our partners use cookies to store and read data on your device, and you can change your mind at any time in the settings.</p><button>Accept all</button></div>
<header class="site-header"><a href="/">The Valley</a><nav class="main-nav"><ul><li><a href="/w">World</a></li><li><a href="/l">Local</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
<main id="c"><article class="post"><header><h1>Harvest</h1><p>{P}</p></header><figure><img src="x.jpg"><figcaption>The valley in autumn.</figcaption></figure><p>{Q}</p>
<div class="ad-slot"><span>Advertisement</span><p>Buy the new tractor now and pay nothing until the next harvest has been brought in, says the shop on the corner.</p></div><h2>After the storm</h2><ul><li>Two barns</li><li>One bridge</li></ul><blockquote>We stayed.</blockquote>
<div class="share-buttons">Share <a href="/f">F</a> <a href="/t">T</a></div></article>
<section id="comments"><h2>2 comments</h2><article class="comment"><footer>Anna</footer><p>{R}</p></article><article class="comment"><p>{R} {R}</p></article></section></main>
<aside class="sidebar"><div class="widget"><h3>Most read</h3><ol><li><a href="/1">How the bridge was lost in spring</a></li><li><a href="/2">A new mill</a></li></ol></div></aside>
<footer class="site-footer"><p>&copy; The Valley. All rights reserved. No part of this may be used without the written permission of the publisher.</p></footer></body></html>"""
BLOG = f"""<html><body><table><tr><td><div id="pageheader"><h1><a href="/">My days</a></h1></div></td></tr><tr><td><div class="blog-post"><h2>Harvest</h2>{BODY[len("<h1>Harvest</h1>"):]}<pre>a = 1
b = 2</pre><p>Bye.</p></div><div id="commentlist"><p>{R}</p><p>{R}</p></div></td><td><div id="sidebarleft"><p>About me and my days.</p><ul><li><a href="/x">Archive</a></li></ul></div></td></tr></table></body></html>"""


def test_a_news_page_and_a_blog():
    assert read(NEWS) == f"Harvest\n{P}\nThe valley in autumn.\n{Q}\nAfter the storm\nTwo barns\nOne bridge\nWe stayed."
    assert read(BLOG) == f"Harvest\n{P}\n{Q}\na = 1 b = 2\nBye."


def test_names_do_not_decide():
    nav = '<nav><a href="/">Home</a> <a href="/b">Blog</a></nav>'
    assert read(f'<article><div class="social">{BODY}</div></article>') == WANTED
    assert read(f'{nav}<article><h1>Harvest</h1><p>{P}</p><section id="share"><p>{Q}</p></section></article>') == WANTED
    assert read(f'{nav}<article><h1>Harvest</h1><p>{P}</p><div class="menu"><p>{Q}</p></div></article>') == WANTED
    for name in ("widget", "toolbar", "sidebar"):
        assert read(f'{nav}<div class="{name}">{BODY}</div>') == WANTED, name
    # and readers' comments stay out, whatever they are called and however long they are
    for mark in ('id="commentlist"', 'class="comments-area"', 'class="post-comments"', 'id="disqus_thread"', 'class="replies"', 'class="commentthread"'):
        assert read(f"{nav}<article>{BODY}<ol {mark}><li><p>{R}</p></li><li><p>{R} {R}</p></li></ol></article>") == WANTED, mark
        assert read(f"{nav}<div>{BODY}</div><div {mark}><article><p>{R}</p></article></div>") == WANTED, mark


@pytest.mark.parametrize("size", [1, 4, 30])
def test_no_size_decides(size):
    body = f"<h1>Harvest</h1>{f'<p>{P}</p>' * size}"
    wanted = "\n".join(["Harvest", *[P] * size])
    advert = f'<div class="advert">{f"<p>{R}</p>" * 3}</div>'
    for left, right in (("<article>", "</article>"), ('<div class="social">', "</div>"), ('<form id="page">', "</form>")):
        assert read(f"<nav><a href='/'>Home</a></nav>{left}{body}{right}{advert}<footer>us</footer>") == wanted


def test_joined_names():
    assert html.groups_of(' class="commentlist"') == {"comments"} and html.groups_of(" id=siteheader") == {"top"} and html.groups_of(" id='sidebarleft'") == {"side"}
    assert html.groups_of(' class="has-sidebar no-comments comments-open entry"') == set() and html.groups_of(' class="adrift reading commentary"') == set()
    assert html.groups_of(' role="contentinfo" class="related-posts"') == {"foot", "related"}
