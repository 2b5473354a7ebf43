"""Labelled pages for main-text extraction, held as data.

Each page is a layout as sites of many kinds have it, with ``{{`` and ``}}`` around
what belongs to the main text. In square brackets stand filler words: ``[p40]`` 40 words
in sentences, ``[s6]`` one sentence of 6 words, ``[w3]`` 3 words without a mark, ``[l5]``
a list of 5 links, ``[a2]`` a link of 2 words. ``render`` fills them in, the paragraphs
at several lengths.
"""

from __future__ import annotations

import random
import re

LAYOUTS = (
    # News and magazines
    "<body><header class='site-header'><div class='logo'>[w2]</div><nav class='main-nav'>[l6]</nav></header><div class='container'><main>{{<article class='story'><h1>[w8]</h1>}}<p class='byline'>[w4]</p><div class='share-buttons'>[l4]</div>{{<p>[p40]</p><p>[p50]</p>}}"
    "<div class='ad'><p>[s9]</p></div>{{<p>[p60]</p><h2>[w4]</h2><p>[p45]</p><p>[s5]</p>}}<div class='related-stories'><h3>[w2]</h3>[l5]</div></article><section id='comments' class='comments'><h3>[w2]</h3><div class='comment'><p>[p20]</p></div><div class='comment'><p>[p35]</p></div></section></main>"
    "<aside class='sidebar'><h3>[w2]</h3>[l6]<div class='widget'><p>[p15]</p></div></aside></div><footer class='site-footer'><p>[s6]</p>[l4]</footer></body>",
    "<body class='single has-sidebar'><div id='wrapper'><div id='top-bar'>[l5]</div><div class='content has-sidebar'>{{<h1>[w9]</h1><p>[p45]</p><p>[p30]</p><ul><li>[s7]</li><li>[s8]</li></ul><p>[p50]</p>}}</div><div class='sidebar'><div class='widget popular'><h4>[w2]</h4>[l5]</div><div class='widget'><p>[p25]</p></div></div><div class='foot'>[s5]</div></div></body>",
    "<body><div class='cookie-notice'><p>[p18]</p><a href='#'>[w1]</a></div><div class='masthead'>[w3]</div><div class='menu'>[l7]</div>{{<div class='article-body'><p>[p50]</p><figure><img src='x'><figcaption>[s8]</figcaption></figure><p>[p60]</p><blockquote><p>[p15]</p></blockquote><p>[p40]</p>}}<div class='advertisement'>[p22]</div>{{<p>[p40]</p></div>}}"
    "<div class='newsletter-signup'><h3>[w4]</h3><p>[s9]</p><form><input></form></div><div class='copyright'>[s6]</div></body>",
    "<body><div class='page with-comments'>{{<h1>[w6]</h1><p>[p50]</p><p>[p70]</p><p>[p30]</p>}}<div class='comments-area'><h2>[w2]</h2><ol class='comment-list'><li class='comment'><p>[p25]</p></li><li class='comment'><p>[p30]</p></li><li class='comment reply'><p>[s8]</p></li></ol><form class='comment-form'>[w4]</form></div></div><footer>[s7]</footer></body>",
    "<body><nav>[l5]</nav>{{<article><h1>[w7]</h1><p>[p30]</p></article>}}<section class='comments'><h2>[w2]</h2><article class='comment'><p>[p60]</p></article><article class='comment'><p>[p70]</p></article><article class='comment'><p>[p50]</p></article></section><footer><p>[s6]</p></footer></body>",
    "<body><div class='promo-banner'>[s8]</div><article>{{<header><h1>[w7]</h1></header><div class='lead'><p>[p30]</p></div><div class='text'><p>[p50]</p><p>[p40]</p></div>}}<div class='ad-box'>[s7]</div>{{<div class='text'><p>[p45]</p><table><tr><th>[w2]</th><td>[w3]</td></tr><tr><td>[w2]</td><td>[w4]</td></tr></table></div>}}<footer class='meta'><p>[w5]</p><div class='tags'>[l4]</div></footer></article><div class='outbrain sponsored'>[l6]</div></body>",
    # Blogs
    "<body><div id='header'><h1><a href='/'>[w3]</a></h1><p class='description'>[s6]</p></div><div id='main'><div class='post hentry'>{{<h2 class='post-title'>[w6]</h2><div class='entry-content'><p>[p45]</p><p>[p55]</p><p>[p25]</p></div>}}<div class='post-footer'>[w6] [a2]</div></div><div id='comments'><h4>[w2]</h4><dl><dt>[a2]</dt><dd><p>[p20]</p></dd><dt>[a2]</dt><dd><p>[p15]</p></dd></dl></div></div><div id='sidebar'><h2>[w2]</h2><p>[p30]</p>[l8]</div><div id='footer'>[s5]</div></body>",
    "<body><div class='site'><div class='nav-links'>[l4]</div><div class='layout no-sidebar'><div class='entry'>{{<h1>[w5]</h1>}}<span class='date'>[w3]</span>{{<p>[p60]</p><pre>[w12]</pre><p>[p50]</p><h3>[w3]</h3><p>[p35]</p><ol><li>[s9]</li><li>[s6]</li></ol>}}</div></div><div class='author-box'><p>[p20]</p></div><div class='subscribe'><p>[s9]</p></div><div class='pager'>[a2] [a2]</div></div></body>",
    "<body><section class='hero'>[w4]</section><section>{{<h1>[w6]</h1><p>[p50]</p><p>[p40]</p><section id='background'><h2>[w2]</h2><p>[p40]</p></section><section id='related-work'><h2>[w2]</h2><p>[p45]</p></section><section id='discussion'><h2>[w1]</h2><p>[p50]</p></section>}}</section><aside><p>[s6]</p>[l3]</aside><footer><small>[s5]</small></footer></body>",
    "<body><div class='x1'><p>[s4]</p></div><div class='x2'>{{<h1>[w6]</h1><p>[p50]</p><p>[p30]</p><p>[p45]</p>}}</div><div class='x3'>[s5]</div></body>",
    "<body><div><div><p>[s5]</p>[l4]</div><div>{{<h1>[w7]</h1><p>[p40]</p><p>[p70]</p><ul><li>[s6]</li><li>[s5]</li><li>[s9]</li></ul>}}</div><div><p>[p15]</p><button>[w1]</button></div><div><p>[s5]</p></div></div></body>",
    "<body><div class='a'>[l6]</div><div class='b'>{{<p>[p60]</p><p>[p50]</p><p>[s4]</p><p>[p30]</p><p>[s3]</p>}}</div><div class='c'><span>[w3]</span> [a2] [a2]</div></body>",
    # Reference works and documentation
    "<body><div id='nav-panel'>[l9]</div><div id='content' class='body with-sidebar'>{{<h1 id='top'>[w3]</h1><p>[p40]</p>}}<div class='toc' id='toc'><h2>[w1]</h2>[l5]</div>{{<h2 id='history'>[w2]</h2><p>[p60]</p><h2 id='legal-status'>[w2]</h2><p>[p50]</p><table class='data'><tr><td>[w3]</td><td>[w2]</td></tr></table><h2 id='comments-and-reactions'>[w3]</h2><p>[p40]</p><dl><dt>[w2]</dt><dd>[s9]</dd></dl>}}</div><div id='catlinks'>[l6]</div><div id='footer'><ul><li>[s9]</li><li>[s8]</li></ul></div></body>",
    "<body><div class='docs-layout'><div class='docs-sidebar sidebar-left'>[l9]</div><main class='docs-main'><div class='breadcrumbs'>[a1] [a2] [a1]</div>{{<h1>[w4]</h1><p>[p35]</p><pre>[w20]</pre><p>[p30]</p><div class='note'><p>[p18]</p></div><h2>[w3]</h2><p>[p40]</p>}}<div class='prev-next'>[a2] [a2]</div><div class='feedback'>[s5]</div></main></div></body>",
    "<body><form id='page-form' action='/'><div class='top'>[l5]</div><div class='main-content'>{{<h1>[w5]</h1><p>[p60]</p><p>[p60]</p><p>[p20]</p>}}</div><div class='bottom legal'>[s8]</div></form></body>",
    "<body><table class='layout'><tr><td class='left menu'>[l7]</td><td class='center'>{{<h1>[w5]</h1><p>[p60]</p><p>[p40]</p><p>[p50]</p>}}</td><td class='right'><p>[s7]</p>[l4]</td></tr><tr><td colspan='3' class='bottom'>[s6]</td></tr></table></body>",
    # Boards, shops, offices
    "<body><div class='topbar'>[l5]</div><div class='thread'>{{<h1>[w7]</h1><div class='post-body'><p>[p60]</p><p>[p40]</p></div>}}<div class='replies'><div class='reply'><p>[p30]</p></div><div class='reply'><p>[p40]</p></div></div></div><div class='related-threads'>[l6]</div><div class='legal'>[s5]</div></body>",
    "<body><div class='overlay popup modal'><p>[s9]</p></div><div class='alert notice'>[s8]</div><div class='product'>{{<h1>[w4]</h1><div class='description'><p>[p40]</p><ul><li>[w5]</li><li>[w6]</li></ul><p>[p30]</p></div>}}<div class='reviews comments'><div class='review'><p>[p25]</p></div><div class='review'><p>[p20]</p></div></div><div class='recommended'>[l6]</div></div><div class='bottom-links'>[l8]</div></body>",
    "<body><div role='banner'>[w3]</div><div role='navigation'>[l6]</div><div role='main'>{{<h1>[w5]</h1><p>[p50]</p><h2>[w3]</h2><p>[p50]</p><p>[p20]</p>}}</div><div role='complementary'>[l4]<p>[s8]</p></div><div role='contentinfo'>[s6]</div></body>",
    "<body><div class='gdpr consent'>[p25]</div><div class='wrap'><div class='col main'>{{<h2>[w5]</h2><p>[p50]</p><p>[p30]</p>}}<div class='social share'>[l4]</div>{{<p>[p50]</p>}}<div class='teaser'><h3>[w3]</h3><p>[s9]</p><a href='/'>[w2]</a></div></div><div class='col rail'><div class='sponsor'>[s8]</div></div></div></body>",
    "<body><header>[w3]</header><main class='sidebar-right'>{{<article><h1>[w6]</h1><p>[p50]</p>}}<aside class='promo'><p>[p12]</p></aside>{{<p>[p60]</p><p>[p30]</p></article>}}<p class='ad'>[s6]</p></main><div class='disqus discussion'><p>[p30]</p><p>[p20]</p></div><footer>[s5] [l3]</footer></body>",
    "<body><div class='search'>[w2]</div><ul class='breadcrumb'><li>[a1]</li><li>[a1]</li></ul>{{<h1>[w6]</h1><div class='columns'><div class='col'><p>[p50]</p><p>[p40]</p></div><div class='col'><p>[p50]</p><p>[p30]</p></div></div>}}<div class='tags'>[l3]</div><div class='notifications'>[s6]</div></body>",
    "<body><main>{{<h1>[w4]</h1><p>[p25]</p>}}</main><div class='advert'><p>[p40]</p></div><div class='sponsored-content'><p>[p30]</p></div><div class='footer'><p>[p20]</p></div></body>",
    "<body><div class='ads'>[s7]</div>{{<article><h1>[w6]</h1><p><b>[p40]</b></p><p>[p60]</p><p>[s2]</p></article>}}<footer>[w2] [p12]</footer></body>",
    "<body><nav>[l6]</nav><div class='ad'>[s8]</div>{{<article><h1>[w9]</h1><p>[p80]</p><p>[s3]</p></article>}}<footer>[w1] [s7]</footer></body>",
    "<body><div class='login-form'>[w6]</div>{{<div class='post-content'><p>[p60]</p>}}<div class='ad ad-inline'>[p18]</div>{{<p>[p40]</p>}}<div class='ad ad-inline'>[p15]</div>{{<p>[p50]</p></div>}}<div id='related' class='related'>[l5]</div><div id='respond' class='comment-respond'>[s6]</div></body>",
    # Long boilerplate and short content, so that the words decide
    "<body><nav>[l5]</nav><article>{{<h1>[w7]</h1><p>[p60]</p>}}<div class='ad'>[p90]</div>{{<div><p>[p12]</p></div><div class='text'>[p15]</div><p>[s5]</p><p>[w3]</p><p>[s4]</p>}}<div class='advert'><p>[p60]</p></div>{{<section><h2>[w2]</h2><p>[s8]</p></section><section class='discussion'><h2>[w2]</h2><p>[p20]</p></section><p>[p30]</p>}}<p class='ad'>[p30]</p></article><footer>[s9]</footer></body>",
    "<body><div class='header'>[w4]</div><div class='article'>{{<h2>[w5]</h2><div class='paragraph'>[p30]</div><div class='paragraph'>[p12]</div><div class='image'><figure><figcaption>[s6]</figcaption></figure></div><div class='paragraph'>[s6]</div>}}<div class='ads'><p>[p70]</p><p>[p50]</p></div>{{<div class='paragraph'>[p40]</div>}}</div><div class='comments'><p>[p80]</p><p>[p60]</p></div><div class='sidebar'><p>[p60]</p><p>[p50]</p></div><div class='footer'>[p30]</div></body>",
    # Loose lines around
    "<body><p>[s5]</p><div class='k2'>{{<h1>[w5]</h1><p>[p40]</p><p>[p50]</p><p>[p20]</p>}}</div><div><p>[s4]</p></div></body>",
    "<body><p>[s8]</p><p>[w3]</p><section>{{<h1>[w6]</h1><p>[p50]</p><p>[s9]</p><p>[p30]</p>}}</section><p>[s5]</p><p>[w4]</p></body>",
    "<body><div>[w3]</div><div>[s6]</div><div><div>{{<p>[p40]</p><p>[p50]</p><h3>[w3]</h3><p>[p50]</p>}}</div></div><div>[s4]</div><div><div>[w5]</div></div></body>",
    "<body><center>[w4]</center><table><tr><td>{{<p>[p40]</p><p>[p50]</p>}}</td></tr></table><center>[s6]</center></body>",
    "<body><nav>[l3]</nav><main>{{<h1>[w4]</h1><p>[p40]</p><p>[p40]</p>}}<form>[w1] <input> [w3]</form><form class='contact'><p>[s6]</p></form><aside>[s6]</aside><aside><h3>[w2]</h3>[l4]</aside></main></body>",
    "<body><article>{{<h1>[w4]</h1><p>[p20]</p>}}<form><label>[w1]</label><p>[s5]</p></form>{{<p>[p40]</p>}}<aside><p>[s9]</p></aside>{{<p>[p40]</p>}}<nav>[a2] [a2]</nav><footer>[w3]</footer></article><form>[w2]</form></body>",
    "<body><div class='menu'>[l4]</div>{{<article><p>[s6]</p></article>}}<div class='ad'>[p20]</div><footer>[p15]</footer></body>",
    "<body><nav>[l6]</nav><div class='ad'>[s8]</div>{{<article><h1>[w4]</h1><p>[w4]</p><p>[s4]</p></article>}}<footer>[w2] [s9]</footer></body>",
    "<body><div id='menu'>[l6]</div><div id='story'>{{[p60]<br><br>[p50]<br>[p40]}}</div><div id='ads'>[p30]</div><div id='bottom'>[s8]</div></body>",
    "<body>[l4]{{<h1>[w5]</h1><p>[s6]</p><p>[p40]</p><p>[s4]</p><p>[w2]</p><p>[p50]</p><p>[s3]</p><ul><li>[w3]</li><li>[w4]</li></ul><p>[s7]</p>}}<div class='cookie'>[p30]</div></body>",
    "<body><main>{{<p>[p40]</p><div>[p30]</div><div><div><p>[p30]</p></div></div><div class='quote'>[s9]</div><div>[w5]</div><p>[p30]</p>}}<div class='sponsored'><p>[p50]</p><p>[p40]</p></div><div class='related'><p>[p30]</p>[l3]</div><div class='comments'><p>[p40]</p><p>[p40]</p><p>[p40]</p><p>[p40]</p></div></main><div class='notice'><p>[p40]</p></div></body>",
    "<body><article>{{<p>[p50]</p><ul class='links'><li><a href='/x'>[w4]</a></li><li><a href='/x'>[w5]</a></li></ul><div><ul><li><a href='/x'>[w6]</a></li><li>[s6]</li></ul></div><p>[p40]</p>}}<div class='comments'><p>[s9]</p></div></article></body>",
    "<body class='page'><div class='layout with-comments has-sidebar'><div class='no-sidebar'>{{<h1>[w5]</h1><p>[p60]</p><p>[p40]</p><p>[p30]</p>}}</div><div class='comments'><p>[p50]</p><p>[p30]</p></div></div></body>",
)


def render(layout: str, scale: float, seed: int) -> str:
    """A layout with its filler words; paragraphs have ``scale`` times their words."""
    rnd = random.Random(seed)

    def words(n: int) -> list[str]:
        return ["".join(rnd.choice("abdegiklmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]

    def sentences(n: int) -> str:
        out = []
        while n > 0:
            size = min(n, rnd.randrange(6, 16))
            out.append(" ".join(words(size)).capitalize() + ".")
            n -= size
        return " ".join(out)

    def fill(m: re.Match) -> str:
        kind, n = m[1], int(m[2])
        if kind == "p":
            return sentences(max(4, round(n * scale)))
        if kind == "s":
            return sentences(n)
        if kind == "a":
            return f"<a href='/x'>{' '.join(words(n))}</a>"
        if kind == "l":
            return "<ul>" + "".join(f"<li><a href='/x'>{' '.join(words(rnd.randrange(1, 6)))}</a></li>" for _ in range(n)) + "</ul>"
        return " ".join(words(n)).capitalize()

    return re.sub(r"\[([psawl])(\d+)\]", fill, layout)


def pages(scales: tuple[float, ...] = (0.4, 1.0, 3.0)) -> list[list[tuple[str, bool]]]:
    """Every layout at every scale, as parts (html, whether it is main text)."""
    out = []
    for i, layout in enumerate(LAYOUTS):
        for j, scale in enumerate(scales):
            parts = re.split(r"(\{\{|\}\})", render(layout, scale, 97 * i + j))
            main, page = False, []
            for part in parts:
                if part in ("{{", "}}"):
                    main = part == "{{"
                elif part:
                    page.append((part, main))
            out.append(page)
    return out
