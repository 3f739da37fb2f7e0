"""Labelled pages from a grammar: the training set of the page extractor.

Pages are put together from the usual parts of articles and of what surrounds them, with
invented words, so every block's label is known. No page of a table is used, but a few forms (a paragraph
that opens with bold text and a line break, words with runs of symbols, words made of syllables) were put in after
looking at pages of the given tables. A test on hand-labelled pages of other shapes tells how the model does elsewhere.
"""

from __future__ import annotations

import random

MAIN_WRAPS = (
    "<article>{}</article>", '<article class="post">{}</article>', "<main><article>{}</article></main>", '<main id="content">{}</main>', '<div class="entry-content">{}</div>', '<div id="article-body">{}</div>',
    '<div class="post-content">{}</div>', '<div class="story"><div class="text">{}</div></div>', '<section class="article">{}</section>', '<div class="content"><article>{}</article></div>', "<main>{}</main>", '<div role="main">{}</div>', "<div>{}</div>",
)
#: What surrounds articles. {t}: some words, {l}: list items with links, {p}: a paragraph, {s}: a sentence.
AROUND = (
    "<nav><ul>{l}</ul></nav>", '<nav class="menu">{l}</nav>', '<div class="navbar"><ul>{l}</ul></div>', '<ul class="menu">{l}</ul>', '<div id="nav">{a} | {a} | {a}</div>', '<div class="breadcrumb">{a} &gt; {a} &gt; {t}</div>', '<ol class="breadcrumbs">{l}</ol>',
    '<header><h1>{t}</h1><p>{t}</p></header>', '<header class="site-header"><a href="/">{t}</a></header>', '<div class="header"><span>{t}</span></div>', '<div id="masthead"><h2>{t}</h2></div>',
    "<footer>&copy; {t}</footer>", "<footer>&copy; {t} &middot; {s}</footer>", "<footer><p>{s}</p><ul>{l}</ul></footer>", '<div class="footer">{s}</div>', '<div id="footer"><p>{p}</p></div>', '<div class="copyright">&copy; {t}</div>',
    "<aside>{p}</aside>", "<aside><h3>{t}</h3><p>{p}</p></aside>", "<aside><ul>{l}</ul></aside>", '<div class="sidebar"><h3>{t}</h3><p>{p}</p></div>', '<div id="sidebar">{p}</div>', '<div class="widget"><h4>{t}</h4><ul>{l}</ul></div>', '<section class="related"><h2>{t}</h2><ul>{l}</ul></section>', '<div class="related-posts"><p>{s}</p>{a}</div>', '<div class="recommended"><p>{p}</p></div>',
    '<div class="ad">{s}</div>', '<div class="ads"><p>{p}</p></div>', '<div class="advert">{s}</div>', '<div class="advertisement">{p}</div>', '<div id="banner-ad">{s}</div>', '<div class="banner">{s}</div>', '<div class="sponsored"><p>{p}</p></div>', '<div class="promo"><h3>{t}</h3><p>{s}</p></div>', '<section class="promotion">{p}</section>',
    '<div class="cookie-notice">{p}</div>', '<div id="cookie-banner"><p>{p}</p><button>{t}</button></div>', '<div class="notice">{s}</div>', '<div class="consent">{p}</div>', '<div class="gdpr">{p}</div>', '<div class="alert" role="alert">{s}</div>', '<div class="popup modal"><p>{p}</p></div>', '<p class="notice">{p}</p>', '<div class="privacy-banner">{p}</div>', '<div class="disclaimer">{p}</div>',
    '<form><label>{t}</label><input name="q"><button>{t}</button></form>', '<form action="/s"><p>{s}</p><input><input type="submit"></form>', '<div class="newsletter"><h3>{t}</h3><p>{p}</p><form><label>{t}</label></form></div>', '<div class="subscribe">{s}</div>', '<div class="search"><form>{t}</form></div>', '<form class="login"><fieldset><legend>{t}</legend><label>{t}</label></fieldset></form>',
    '<section id="comments"><h2>{t}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section>', '<div class="comments"><p>{p}</p><p>{p}</p></div>', '<ul class="commentlist"><li><p>{p}</p></li><li><p>{p}</p></li></ul>', '<div class="comment"><b>{t}</b><p>{p}</p></div>', '<ol class="comment-list"><li>{p}</li></ol>', '<div id="disqus"><p>{p}</p></div>', '<section class="user-comments"><article class="comment"><p>{p}</p></article></section>', '<div class="replies"><div class="reply"><p>{p}</p></div></div>', '<div class="reader-comments"><p>{p}</p></div>', '<section class="responses discussion"><p>{p}</p></section>',
    '<div class="share">{a} {a} {a}</div>', '<div class="social"><ul>{l}</ul></div>', '<div class="pagination">{a} {a}</div>', '<div class="tags">{a}, {a}</div>', '<div class="toolbar">{t}</div>',
)
#: What stands inside an article and is no part of it.
WITHIN = ('<div class="ad">{s}</div>', '<aside>{p}</aside>', '<div class="share">{a} {a}</div>', '<div class="advert"><p>{s}</p></div>', '<aside class="related"><h3>{t}</h3><ul>{l}</ul></aside>', '<div class="newsletter"><p>{s}</p></div>', '<form><label>{t}</label></form>', '<div class="sponsored">{p}</div>', '<section class="comments"><p>{p}</p><p>{p}</p></section>', "<footer>{t}</footer>", "<nav>{a} {a}</nav>", '<div class="notice">{s}</div>')
LABEL = "\x01"


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(("an", "er", "tion", "the", "of", "in", "qu", "ó", "ü", "re", "li", "sa", "mo", "ke")) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentence(self) -> str:
        return self.words(3, 14).capitalize() + "."

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def filled(self, form: str) -> str:
        for mark, make in (("{t}", lambda: self.words(1, 6)), ("{l}", lambda: "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 7)))), ("{a}", self.link), ("{p}", self.paragraph), ("{s}", self.sentence)):
            while mark in form:
                form = form.replace(mark, make(), 1)
        return form

    def odd(self, text: str) -> str:
        """Texts that articles may hold as well: capitals, symbols, tables of words, links."""
        kind = self.r.randint(0, 12)
        if kind == 0:
            return text.upper()
        if kind == 1:
            return " | ".join(text.split())
        if kind == 2:
            return " ".join(w + self.r.choice(("%%%", "!!", "###", "&amp;&amp;&amp;")) for w in text.split())
        if kind == 3:
            return f"{text} {self.link()} {self.words(2, 6)}"
        if kind == 4:
            return self.words(1, 3)
        if kind == 5:
            return f"{text} &copy; {self.words(1, 4)}"
        return text

    def article(self) -> str:
        """The inside of an article; every block of it begins with LABEL."""
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(r.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>" if r.random() < 0.1 else "<h1>{}</h1>")).format(LABEL + self.odd(self.words(2, 10))))
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            form = r.choice(("<p>{}</p>",) * 8 + ("<p>{}", "<p><b>{}<br>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<p><em>{}</em></p>", "<figure><figcaption>{}</figcaption></figure>", "<div><p>{}</p></div>", "<section><p>{}</p></section>", "<ol><li>{}</li></ol>"))
            out.append(form.format(LABEL + self.odd(self.paragraph())))
            if r.random() < 0.08:
                out.append(self.filled(r.choice(WITHIN)))
        if len(out) < 2:
            out.append(f"<p>{LABEL}{self.odd(self.sentence())}</p>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        around = lambda most: "".join(self.filled(r.choice(AROUND)) for _ in range(r.randint(0, most)))
        inside = self.article()
        wrap = r.choice(MAIN_WRAPS)
        if wrap == "<div>{}</div>" and r.random() < 0.5:
            wrap = "<article>{}</article>"
        body = around(5) + wrap.format(inside) + around(5)
        if r.random() < 0.15:
            body = f'<div class="{r.choice(("page", "wrapper", "container", "site"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    g = Grammar(seed)
    return [g.page() for _ in range(n)]
