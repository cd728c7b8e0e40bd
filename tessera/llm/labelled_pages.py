"""Labelled pages, from which html.py learns its weights: frames of whole sites, each of a layout of its own, around main parts.

The notation is short for HTML: {n} stands for n words, [n] for n menu items with links, and in a
frame @ for the main part. «...» within a main part, like the frame, is not main text.
"""

from __future__ import annotations

import re

FRAMES = (
    "<html><head><title>{6}</title></head><body><nav><ul>[5]</ul></nav><div class='ad'>{9}</div>@<footer>{8} <a href='/t'>{1}</a></footer></body></html>",
    "<html><body><header><div class='logo'><a href='/'>{2}</a></div><nav role='navigation'>[4]</nav></header><div class='content'>@</div><aside><h2>{1}</h2><p>{9}</p><form><input><button>{2}</button></form></aside><footer><ul>[4]</ul><p>{7}</p></footer></body></html>",
    "<html><body><div id='header'><h1><a href='/'>{2}</a></h1><form class='search'><input><button>{1}</button></form></div><div class='cookie-notice'>{12} <a href='/ok'>{1}</a></div><div id='content'>@</div><div id='sidebar'><h3>{1}</h3><ul>[6]</ul></div><div id='footer'>{4} <a href='/c'>{1}</a></div></body></html>",
    "<html><body><table><tr><td><a href='/a'>{1}</a></td><td><a href='/b'>{1}</a></td><td><a href='/c'>{2}</a></td></tr></table>@<div>{2} <a href='/t'>{1}</a> <a href='/f'>{1}</a></div><div>{1} 1 <a href='/2'>2</a> <a href='/3'>3</a></div></body></html>",
    "<html><body class='with-sidebar page'><div class='page-wrapper with-sidebar has-footer'><div class='topbar'>[3]</div><div class='main-content'>@</div><div class='widget related'><h4>{2}</h4><ul>[5]</ul></div><div class='newsletter subscribe'><p>{14}</p><form><label>{2}</label></form></div></div><div class='site-footer'><p>{10}</p></div></body></html>",
    "<html><body><div class='container sidebar-layout'><div role='banner' class='masthead'>{3}</div><ul class='breadcrumb'>[3]</ul><main>@</main><div role='complementary' class='promo'><p>{11}</p></div><div role='contentinfo' class='copyright'>{9}</div></div></body></html>",
    "<html><body><div class='gdpr consent popup'><p>{18}</p><button>{1}</button></div><div class='nav menu'>[6]</div><div class='row content-sidebar-wrap'><div class='column text-body'>@<div class='share sharing social'>{2} <a href=a>{1}</a> <a href=b>{1}</a></div><section id='comments' class='comments-area'><h2>{2}</h2><ol class='comment-list'><li class='comment'><p>{25}</p><p>{14}</p></li><li class='comment'><p>{31}</p></li></ol></section></div></div><div class='footer-wrap'>{6}</div></body></html>",
    "<html><body><a class='skip-link' href='#m'>{3}</a><div class='navigation toolbar'>[5]</div><div class='layout'><div class='primary'>@<div class='tags'>[3]</div><div class='pagination'>{1} <a>2</a> <a>3</a></div></div><div class='secondary recommended'><h3>{2}</h3><p>{16}</p><p>{12}</p></div></div><div id='disqus_thread' class='respond'><h3>{3}</h3><p>{20}</p><p>{22}</p><form><textarea></textarea></form></div><footer class='site'>{7}</footer></body></html>",
    "<html><body><noscript>{10}</noscript><div class='site-header header'><div class='tagline'>{4}</div></div><div class='sponsored advertisement'><p>{17}</p></div><section class='story'>@</section><section class='more'><h3>{2}</h3><div><a href=x>{7}</a></div><div><a href=y>{8}</a></div></section><div class='reader-comments'><h4>{2}</h4><div class='reply'><p>{28}</p></div><div class='reply'><p>{19}</p></div><div class='reply'><p>{40}</p></div></div><div class='bottom footer'>{9}</div></body></html>",
    "<html><body><div>{2}</div><div><a href=/>{1}</a> <a href=/n>{1}</a> <a href=/s>{2}</a></div><div>@</div><div>{5}</div><p><a href=/p>{1}</a> | <a href=/i>{1}</a></p></body></html>",
    "<html><body><header class='page-header'><span>{2}</span><menu>[4]</menu></header><div class='modal overlay notification' hidden><p>{20}</p></div><div class='wrapper clearfix no-sidebar'>@</div><div class='login signup'><p>{8}</p></div><div style='display:none'><p>{26}</p></div><footer><div class='links'>[6]</div><p>{15}</p></footer></body></html>",
    "<html><body><div id='page'><div class='sponsor adverts'>{7}</div><dialog>{9} <button>{1}</button></dialog><div class='post-container'>@<nav class='post-navigation pager'><a href=p>{5}</a><a href=n>{6}</a></nav><div class='comments'><h3>{2}</h3><p>{36}</p><p>{15}</p><p>{48}</p><p>{29}</p></div></div><div class='sidebar widgets'><div class='widget'><p>{13}</p></div><div class='widget'><ul>[5]</ul></div></div></div></body></html>",
    "<html><body><div class='alert notices' role='alert'>{8}</div><div class='header-bar'>[3]</div><div class='grid'><div class='left menu-column'><ul>[8]</ul></div><div class='center'>@</div><div class='right aside'><p>{14}</p><div class='ads'><p>{10}</p></div></div></div><div aria-hidden='true'>{6}</div><address>{7}</address></body></html>",
    "<html><body><div class='banner'>{6}</div><div class='site-content'>@</div><div class='feedback comment-section'><div class='comment-body'><p>{33}</p></div><div class='comment-body'><p>{21}</p></div></div><div class='author-box about'><p>{12}</p></div><div class='terms copyright'>{8}</div></body></html>",
    "<html><body><header><h1>{2}</h1><p>{4}</p></header><main>@<section class='comments'><h2>{1}</h2><p>{60}</p><p>{70}</p><p>{55}</p><p>{44}</p></section></main><footer>{3}</footer></body></html>",
    "<html><body><header>{3}<nav>[4]</nav></header><section id='content'>@<form action='/s'><p>{9}</p><input><label>{1}</label><button>{2}</button></form></section><section id='comment-list' class='thread'><p>{40}</p><p>{52}</p><p>{61}</p></section><footer><p>{5}</p><p>{12}</p></footer></body></html>",
    "<html><body><header><h1>{3}</h1></header><div id='wrapper'><nav>[5]</nav><div class='main'>@</div><aside><p>{10}</p></aside></div><footer>{6}</footer></body></html>",
    "<html><body><div class='masthead'><a href=/>{2}</a></div><div class='story'>@</div><div class='discussion'><h3>{2}</h3><div class='entry-c'><b>{1}</b><p>{24}</p></div><div class='entry-c'><b>{2}</b><p>{41}</p></div><div class='entry-c'><b>{1}</b><p>{18}</p></div></div><div class='foot'>{6}</div></body></html>",
    "<html><body><nav class='top'>[5]</nav><main>@</main><div><h4>{2}</h4><div class='x1'><span>{2}</span><div>{30}</div></div><div class='x1'><span>{1}</span><div>{22}</div></div><div class='x1'><span>{3}</span><div>{51}</div></div><div class='x1'><span>{2}</span><div>{15}</div></div></div><footer>{7}</footer></body></html>",
    "<html><body><div id='hd'>{3} <a href=/>{1}</a></div><div id='bd'>@</div><ul class='talkback'><li><i>{2}</i><p>{33}</p></li><li><i>{1}</i><p>{27}</p></li><li><i>{2}</i><p>{19}</p></li></ul><div id='ft'>{9}</div></body></html>",
    "<html><body><header class='global'>{2}<ul>[6]</ul></header><div class='body-copy'>@</div><section class='responses'><h2>{1}</h2><article class='response'><p>{2}</p><p>{38}</p></article><article class='response'><p>{1}</p><p>{25}</p></article><article class='response'><p>{2}</p><p>{44}</p></article></section><footer class='global'>{12}</footer></body></html>",
    "<html><body><div class='crumbs'><a href=a>{1}</a> <a href=b>{1}</a></div>@<div class='thread-list'><div class='msg'><div class='who'>{2}</div><div class='what'>{29}</div></div><div class='msg'><div class='who'>{2}</div><div class='what'>{17}</div></div><div class='msg'><div class='who'>{1}</div><div class='what'>{35}</div></div></div><div class='legal'>{14}</div></body></html>",
    "<html><body><div class='cookiebar'><span>{16}</span> <a href=k>{1}</a></div><div class='shell'><div class='rail'><ul>[7]</ul></div><div class='copy'>@</div></div><div class='colophon'>{8}</div></body></html>",
    "<html><body><div class='eu-banner privacy'><p>{22}</p></div><div class='l-main'>@</div><div class='l-side trending'><h3>{2}</h3><p><a href=a>{6}</a></p><p><a href=b>{7}</a></p><p><a href=c>{5}</a></p></div></body></html>",
    "<html><body><div class='navbar'><div class='brand'>{1}</div>[5]</div><div class='hero'><h2>{4}</h2></div><div class='container'><div class='post-body'>@</div><div class='opinions'><div><strong>{2}</strong><p>{26}</p></div><div><strong>{2}</strong><p>{31}</p></div><div><strong>{1}</strong><p>{12}</p></div></div></div><div class='bottom-bar'>{5}</div></body></html>",
    "<html><body><table><tr><td><ul>[6]</ul></td><td>@</td><td><b>{2}</b><br><a href=a>{3}</a><br><a href=b>{4}</a></td></tr></table><p><small>{11}</small></p></body></html>",
    "<html><body><center><a href=/><b>{2}</b></a></center><hr>@<hr><a href=p>{2}</a> | <a href=n>{2}</a><hr><i>{4}</i></body></html>",
    "<html><body><div class='app'><div class='drawer'>[8]</div><div class='view'><div class='reader'>@</div><div class='next-up'><h4>{2}</h4><div class='card'><a href=x>{8}</a></div><div class='card'><a href=y>{6}</a></div></div></div></div></body></html>",
    "<html><body><div class='subscribe-wall paywall'><p>{13}</p><a href=s>{2}</a></div><div class='document'>@</div><div class='disclaimer'><p>{24}</p></div></body></html>",
    "<html><body><header>{2}<form role='search'><input><button>{1}</button></form></header><div role='main'>@</div><div role='complementary'><h3>{2}</h3><p>{18}</p></div><div class='qa'><div class='user-post'><span>{1}</span><p>{33}</p></div><div class='user-post'><span>{2}</span><p>{28}</p></div><div class='user-post'><span>{2}</span><p>{46}</p></div></div></body></html>",
    "<html><body><div class='utility'>[3]</div><div class='news-item'>@</div><div class='also'><ul><li><a href=a>{6}</a></li><li><a href=b>{9}</a></li><li><a href=c>{7}</a></li></ul></div><div class='tos'>{10} <a href=t>{2}</a></div></body></html>",
    "<html><body><div class='announcement'><p>{9}</p></div><div class='two-col'><div class='text'>@</div><div class='extra'><div class='ad-unit'>{5}</div><div class='poll'><p>{8}</p><label>{1}</label><label>{1}</label><button>{1}</button></div></div></div><div class='sitemap'><ul>[9]</ul></div></body></html>",
    "<html><body><nav aria-label='x'>[4]</nav><article>@</article><section><h2>{2}</h2><div><p>{2}</p><p>{27}</p></div><div><p>{3}</p><p>{36}</p></div><div><p>{2}</p><p>{14}</p></div><div><p>{1}</p><p>{22}</p></div></section></body></html>",
    "<html><body><div class='hdr'>{3}</div><div class='art'>@</div><div id='replies'><blockquote><cite>{2}</cite><p>{21}</p></blockquote><blockquote><cite>{1}</cite><p>{37}</p></blockquote><blockquote><cite>{2}</cite><p>{29}</p></blockquote></div><div class='ftr'>{6}</div></body></html>",
    "<html><body><div class='ribbon'>{4}</div><ul class='tabs'>[4]</ul><div class='panel'>@</div><div class='you-may-like'><h3>{4}</h3><p><a href=q>{9}</a></p><p><a href=r>{7}</a></p></div></body></html>",
    "<html><body><div id='menu'><p><a href=a>{1}</a></p><p><a href=b>{1}</a></p><p><a href=c>{2}</a></p></div><div id='text'>@</div><div id='about'><p>{17}</p></div><div id='copy'>{5}</div></body></html>",
    "<html><body><section class='cover'><a href=/>{2}</a></section><section class='longread'>@</section><section class='signup-box'><h3>{3}</h3><form><input><button>{1}</button></form></section><section class='guestbook'><p><b>{2}</b></p><p>{30}</p><p><b>{2}</b></p><p>{21}</p></section></body></html>",
    "<html><body><div class='w'><div class='h'>{2} <a href=/>{1}</a> <a href=/a>{1}</a></div><div class='c'>@</div><div class='f'>{8}</div></div></body></html>",
    "<html><body><div class='topnav sticky'>[5]</div><div class='inner'><div class='lede-wrap'>@</div><div class='tag-list'>[4]</div><div class='bio author'><p>{16}</p></div></div><div class='reactions'><div class='r'><a href=u>{1}</a><p>{26}</p></div><div class='r'><a href=u>{2}</a><p>{18}</p></div><div class='r'><a href=u>{1}</a><p>{39}</p></div></div></body></html>",
    "<html><body><div class='splash' style='display: none'>{12}</div><div class='entry-wrap'>@</div><div class='carousel'><div><a href=a>{4}</a></div><div><a href=b>{5}</a></div><div><a href=c>{4}</a></div></div><div class='imprint'>{9}</div></body></html>",
    "<html><body><div class='warning-message'>{7}</div><div class='doc'><div class='doc-nav'>[9]</div><div class='doc-text'>@</div></div><div class='doc-feedback'><p>{4}</p><button>{1}</button> <button>{1}</button></div><div class='doc-footer'>{7}</div></body></html>",
    "<html><body><header class='top'>{2}</header><main>@<section id='comments'><h2>{1}</h2><p>{44}</p><p>{52}</p><p>{23}</p></section></main><footer>{5}</footer></body></html>",
    "<html><body><nav>[4]</nav><div class='story'>@</div><section class='comments'><p>{38}</p><p>{61}</p><p>{47}</p></section><footer><p>{9}</p></footer></body></html>",
    "<html><body><header><h1>{2}</h1></header><div class='page'>@<div class='comments'><div class='comment'><p>{42}</p></div><div class='comment'><p>{26}</p></div></div></div><footer>{6}</footer></body></html>",
    "<html><body><div class='site-top'>[4]</div><main class='text'>@<section class='comment-thread discussion'><p>{36}</p><p>{58}</p></section></main><aside class='related'>[3]</aside></body></html>",
    "<html><body><header>{2}</header><section class='body'>@</section><section class='guestbook replies'><p>{34}</p><p>{41}</p><p>{27}</p></section><footer>{7}</footer></body></html>",
)

MAINS = (
    "<article><h1>{6}</h1><p>{40}</p><p>{28} <a href=q>{2}</a> {9}</p><p>{35}</p></article>",
    "<article><header><h1>{5}</h1><p>{4}</p></header><p>{38} <b>{3}</b> {8}</p>«<aside class='promo'>{7}</aside>»<h2>{3}</h2><p>{50}</p>«<footer><a href=t>{2}</a></footer>»</article>",
    "<div class='post'><h2 class='post-title'>{6}</h2><p>{30}</p><ul><li>{6}</li><li>{8}</li><li>{5}</li></ul><p>{24}</p><blockquote>{10}</blockquote></div>",
    "<h1>{2}</h1><p>{32}</p><table><tr><th>{1}</th><td>{5}</td></tr><tr><th>{1}</th><td>{6}</td></tr></table><pre>{9}</pre><p>{21}</p>",
    "<div class='article-header'><h1>{7}</h1></div><div class='article-body'><p>{44}</p>«<div class='ad-slot advert'><p>{8}</p></div>»<p>{29}</p><figure><figcaption>{7}</figcaption></figure><p>{37}</p></div>",
    "<section><h1>{3}</h1><div>{36}</div><div>{27} <a href=z>{3}</a> {15}</div></section><section><h2>{3}</h2><div>{41}</div></section>",
    "<div class='entry'><h1 class='entry-title'>{6}</h1><div class='entry-content'><p>{26}</p><ol><li>{12}</li><li>{9}</li></ol><dl><dt>{2}</dt><dd>{11}</dd></dl><p>{33}</p></div>«<div class='entry-footer share-buttons'><a href=f>{1}</a> <a href=m>{1}</a></div>»</div>",
    "<article class='story-text'><h1 class='banner headline'>{7}</h1><p class='lead'>{20}</p><p>{45}</p>«<div class='newsletter-signup'><p>{12}</p><form><button>{2}</button></form></div>»<p>{39}</p></article>«<div class='advertisement'>{6}</div>»<article class='story-text'><h2>{4}</h2><p>{42}</p></article>",
    "<div><h1>{2}</h1>{30}<br><br>{35}<br>{22}</div>",
    "<article><h1>{3}</h1><div class='text'><p>{31}</p><ul><li><a href=a>{3}</a> {9}</li><li><a href=b>{2}</a> {12}</li></ul><h3>{2}</h3><p>{17}</p><p>{3}</p></div>«<section class='related-posts'><h3>{2}</h3><ul>[4]</ul></section>»</article>",
    "<div class='article'><h1>{1}</h1><p>{34}</p>«<nav class='toc'>[4]</nav>»<p>{28}</p><p>{6}</p><p>{51}</p></div>",
    "<div class='content'><h1>{3}</h1><p>{30}</p>«<form><p>{8}</p><input><button>{1}</button></form>»<p>{26}</p>«<button>{1}</button>»<p>{22}</p></div>",
    "<article><h1>{5}</h1>«<button>{1}</button>»<p>{33}</p>«<form><p>{12}</p><label>{2}</label></form>»<p>{27}</p></article>",
)


def _filled(text: str, item: str) -> str:
    text = re.sub(r"\[(\d+)\]", lambda m: item * int(m.group(1)), text)
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m.group(1))), text)


def labelled_pages(rounds: int = 4) -> list[list[tuple[int, str]]]:
    """Pages as runs (1: main text, HTML): each frame around rounds of the main parts, each time another one."""
    pages = []
    for r in range(rounds):
        item = "<li class='menu-item'><a href='/x'>{1}</a></li>" if r == 1 else "<li><a href='/x'>{1}</a></li>"
        for k, frame in enumerate(FRAMES):
            before, after = frame.split("@")
            runs = [(0, _filled(before, item))]
            for n, part in enumerate(re.split("[«»]", MAINS[(k + 3 * r) % len(MAINS)])):
                runs.append((1 - n % 2, _filled(part, item)))
            pages.append([*runs, (0, _filled(after, item))])
    return pages
