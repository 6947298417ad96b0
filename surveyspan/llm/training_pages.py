"""Invented, labelled web pages from which the block labeller learns.

A page is an article of invented words in one of many kinds of container, with menus, headers, footers,
sidebars, notices, adverts, forms and reader comments around it and sometimes inside. Names of classes are varied,
sometimes missing, sometimes meaningless, so that the labeller must also use a block's shape and its neighbours.
Main text is marked by one private character, which is taken out again when the blocks are labelled.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from surveyspan.llm.page_blocks import Block, Paths, page_blocks

MARK = ""

# Ordinary wording around the articles of public web pages.
_MENU = (
    "Home|About|About us|Contact|News|Sports|Archive|Products|Blog|Login|Sign in|Register|Help|FAQ|Search|Shop|Start|Impressum|Kontakt|"
    "Über uns|Nachrichten|Anmelden|Accueil|Contactez-nous|Actualités|Connexion|Boutique|Inicio|Contacto|Noticias|Quiénes somos|Tienda"
).split("|")
_NOTICES = (
    "This site uses cookies.|We use cookies to improve your experience.|Accept all cookies|By continuing you agree to our privacy policy.|"
    "Please enable JavaScript to view this page.|Subscribe to our newsletter|You have read all your free articles this month.|"
    "Wir verwenden Cookies, um unsere Website zu verbessern.|Ce site utilise des cookies.|Este sitio utiliza cookies."
).split("|")
_FOOTERS = (
    "All rights reserved.|Copyright|Terms of use|Privacy policy|Imprint|Alle Rechte vorbehalten.|Datenschutz|Mentions légales|"
    "Tous droits réservés.|Todos los derechos reservados.|Aviso legal|Powered by|Sitemap|Back to top"
).split("|")
_ADVERTS = "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Limited offer|Sponsored content|Shop now and save".split("|")
_FORMS = "Name|Email|E-mail address|Your message|Submit|Send|Search|Password|Subscribe|Envoyer|Senden|Enviar|Leave a reply|Sign up".split("|")
_COMMENTS = (
    "Comments|3 comments|Reply|Leave a comment|says:|Kommentare|Antworten|Commentaires|Répondre|Comentarios|Responder|Report|2 hours ago|Like"
).split("|")
_RELATED = "Related articles|Read more|You may also like|More from this section|Share|Tweet|Tags:|Mehr zum Thema|À lire aussi|Te puede interesar".split("|")

# Words that pages commonly use in class and id names of such parts.
_CLASSES = {
    "menu": "menu nav navbar navigation main-menu topnav site-nav breadcrumb breadcrumbs tabs menubar links primary-nav".split(),
    "header": "header site-header masthead topbar top branding page-header logo-area hero-banner head".split(),
    "footer": "footer site-footer bottom colophon copyright page-footer foot legal credits footer-links".split(),
    "sidebar": "sidebar side widget widgets widget-area rail right-column col-right secondary aside right left-col".split(),
    "notice": "cookie cookie-banner notice alert consent gdpr popup modal message paywall disclaimer warning overlay announcement".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo ad-slot banner adbox google-ad teaser-ad promotion".split(),
    "form": "form search-form newsletter signup subscribe login contact-form searchbox registration".split(),
    "comments": "comments comment-list disqus responses reader-comments discussion replies feedback comment-section user-comments".split(),
    "related": "related related-posts recommended more read-next share social sharing tags see-also teaser-list".split(),
    "main": "content post entry article article-body story text main page-content body entry-content post-content maincontent "
    "story-body article-text single".split(),
}


class _Writer:
    def __init__(self, seed: int) -> None:
        self.random = r = random.Random(seed)
        letters = r.choice(("aeiou", "aeiouéèê", "aeiouäöü", "aeiouáóñ"))
        joints = [c + v for c in "bcdfghlmnprstvz" for v in letters] + ["th", "en", "er", "ing", "ch", "ion", "es", "ou", "st", "sch"]
        self.syllables = r.sample(joints, 30)
        self.frequent = [self.word(2) for _ in range(12)]
        self.bare = r.random() < 0.12  # class names say nothing
        self.semantic = r.random() < 0.55
        # marks that some sources leave after or between words
        self.noise = r.choice((("&amp;&amp;", "***", "%%%", "##", ""), (" |", ""), (" |",))) if r.random() < 0.25 else ()
        self.parts: list[str] = []

    def word(self, most: int = 4) -> str:
        return "".join(self.random.choice(self.syllables) for _ in range(self.random.randint(1, most)))

    def sentence(self, least: int = 1, most: int = 22) -> str:
        r = self.random
        words = [r.choice(self.frequent) if r.random() < 0.35 else self.word() for _ in range(r.randint(least, most))]
        if self.noise:
            words = [w + r.choice(self.noise) for w in words]
        text = " ".join(w + "," if r.random() < 0.05 else w for w in words)
        return text[:1].upper() + text[1:] + r.choice(("...!?" if r.random() < 0.1 else ".", ".", "."))

    def heading(self, most: int) -> str:
        """Headings seldom end like sentences; some are cut at a fixed length."""
        text = self.sentence(1, most)
        kind = self.random.random()
        return text if kind < 0.25 else text[:60].rstrip("&amp;") if kind < 0.5 else text.rstrip(".!?")

    def prose(self, main: bool, most: int = 9) -> str:
        # most paragraphs are long, some hold a word or two
        kind = self.random.random()
        if kind < 0.15:
            text = self.sentence(1, 4)
        elif kind < 0.18:
            text = f"{self.word()} " + f"{self.word(1)} " * self.random.choice((2, 9, 40, 120))
        elif kind < 0.22:
            text = " ".join(self.word() for _ in range(self.random.randint(1, 12)))
        else:
            text = " ".join(self.sentence() for _ in range(self.random.randint(1, most)))
        return (MARK if main else "") + text

    def names(self, kind: str) -> str:
        r = self.random
        chosen = r.choice(_CLASSES[kind])
        if self.bare:
            chosen = r.choice(("", "x" + str(r.randint(1, 999)), self.word(2), "box", "row", "col", "block", "wrap", "container"))
        elif r.random() < 0.25:
            chosen = f"{r.choice(('wp', 'site', 'page', 'js', 'b', 'c', 'l', 'block', self.word(2)))}-{chosen}"
        if not chosen:
            return ""
        if r.random() < 0.2:
            return f' {r.choice(("id", "ID"))}="{chosen}"'
        if r.random() < 0.15:
            chosen += " " + r.choice(("clearfix", "wide", "row", "container", "box", "hidden-xs"))
        return f' class="{chosen}"'

    def box(self, kind: str, inside: Callable[[], None], element: str = "") -> None:
        semantic = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "")
        use = element or ("div" if not semantic else semantic)
        if self.bare or not self.semantic:
            use = element or self.random.choice(("div", "div", "div", "section", "td"))
        label = "" if use == semantic and self.random.random() < 0.6 else self.names(kind)
        self.parts.append(f"<{use}{label}>")
        inside()
        self.parts.append(f"</{use}>")
        if self.random.random() < 0.3:
            self.parts.append("\n")

    def link(self, text: str) -> str:
        return f'<a href="/{self.word(2)}">{text}</a>'

    def phrase(self, kind: list[str]) -> str:
        if self.random.random() < 0.5:
            return self.random.choice(kind)
        return " ".join(self.word() for _ in range(self.random.randint(1, 4)))

    # Parts around the article.

    def menu(self) -> None:
        items = [self.link(self.phrase(_MENU)) for _ in range(self.random.randint(2, 9))]
        style = self.random.random()

        def inside() -> None:
            if style < 0.6:
                self.parts.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif style < 0.8:
                self.parts.append(self.random.choice((" ", " | ", " &raquo; ")).join(items))
            else:
                self.parts.extend(f"<div>{i}</div>" for i in items)

        self.box("menu", inside)

    def header(self) -> None:
        def inside() -> None:
            self.parts.append(f"<{self.random.choice(('h1', 'div', 'p', 'h2'))}>{self.link(self.phrase(_MENU))}</p>")
            if self.random.random() < 0.5:
                self.parts.append(f"<p>{self.sentence(2, 8)}</p>")
            if self.random.random() < 0.4:
                self.menu()
            if self.random.random() < 0.3:
                self.form()

        self.box("header", inside)

    def footer(self) -> None:
        def inside() -> None:
            r = self.random
            if r.random() < 0.7:
                self.parts.append(f"{r.choice(('&copy;', '©', 'Copyright &#169;'))} {self.word()}.example &middot; {self.sentence(1, 9)}")
            for _ in range(r.randint(0, 4)):
                text = self.phrase(_FOOTERS)
                self.parts.append(r.choice((f"<p>{self.sentence(2, 14)}</p>", f"<span>{text}</span> ", f"<div>{self.link(text)}</div>", f"<p>{text}</p>")))
            if r.random() < 0.2:
                self.menu()

        self.box("footer", inside)

    def sidebar(self) -> None:
        def inside() -> None:
            for _ in range(self.random.randint(1, 4)):
                self.parts.append(f"<h3>{self.phrase(_RELATED)}</h3>")
                if self.random.random() < 0.5:
                    self.parts.append(f"<p>{self.prose(False, 4)}</p>")
                else:
                    self.parts.append("<ul>" + "".join(f"<li>{self.link(self.sentence(2, 8))}</li>" for _ in range(self.random.randint(2, 6))) + "</ul>")

        self.box("sidebar", inside)

    def notice(self) -> None:
        def inside() -> None:
            text = self.random.choice(_NOTICES) if self.random.random() < 0.6 else self.sentence(4, 18)
            self.parts.append(self.random.choice((f"<p>{text}</p>", text)))
            if self.random.random() < 0.4:
                self.parts.append(f"<button>{self.phrase(_NOTICES[2:3])}</button>")

        self.box("notice", inside)

    def advert(self) -> None:
        def inside() -> None:
            if self.random.random() < 0.4:
                self.parts.append(f"<span>{self.random.choice(_ADVERTS)}</span>")
            text = " ".join(self.sentence(1, 12) for _ in range(self.random.randint(1, 3)))
            self.parts.append(self.random.choice((text, text, f"<p>{text}</p>", self.link(text))))

        if self.random.random() < 0.3:
            self.parts.append("<!-- ad -->")
        self.box("advert", inside)

    def form(self) -> None:
        def inside() -> None:
            for _ in range(self.random.randint(1, 4)):
                self.parts.append(f"<{self.random.choice(('label', 'p', 'div'))}>{self.phrase(_FORMS)}<input name='a'></p></div></label>")
            if self.random.random() < 0.4:
                self.parts.append(f"<p>{self.sentence(3, 12)}</p>")
            self.parts.append(f"<button>{self.phrase(_FORMS)}</button>")

        self.box("form", inside, "form" if self.random.random() < 0.8 else "")

    def comments(self) -> None:
        r = self.random

        def inside() -> None:
            self.parts.append(f"<h{r.randint(2, 4)}>{self.phrase(_COMMENTS)}</h3>")
            for _ in range(r.randint(1, 7)):
                name = " ".join(self.word(3).capitalize() for _ in range(r.randint(1, 2)))
                who = f"<{r.choice(('b', 'cite', 'span', 'div'))}>{name}{' ' + r.choice(_COMMENTS) if r.random() < 0.5 else ''}</b></cite></span></div>"
                text = f"<p>{self.prose(False, 4)}</p>" + (f"<p>{self.prose(False, 3)}</p>" if r.random() < 0.3 else "")
                name = "" if self.bare or r.random() < 0.3 else ' class="comment"'
                self.parts.append(r.choice((f"<li{name}>{who}{text}</li>", f"<div{name}>{who}{text}</div>", f"<article{name}>{who}{text}</article>")))
            if r.random() < 0.4:
                self.form()

        self.box("comments", inside, r.choice(("section", "div", "ol", "")))

    def related(self) -> None:
        def inside() -> None:
            self.parts.append(f"<h4>{self.phrase(_RELATED)}</h4>")
            for _ in range(self.random.randint(1, 5)):
                self.parts.append(f"<{self.random.choice(('p', 'div', 'li'))}>{self.link(self.sentence(3, 10))}</p></div></li>")

        self.box("related", inside)

    # The article.

    def body(self) -> None:
        r = self.random
        inserted = 0.05 if r.random() < 0.4 else 0.0
        loose = r.random() < 0.3
        count = r.randint(1, 14) if r.random() < 0.85 else r.randint(15, 90)
        if r.random() < 0.8:
            title = self.heading(12)
            heading = f"<h{r.choice((1, 1, 1, 2))}>{MARK}{title}</h1></h2>"
            if r.random() < 0.2:
                heading = f"<header>{heading}</header>"
            self.parts.append(heading)
        for _ in range(count):
            kind = r.random()
            if kind < inserted:
                r.choice((self.advert, self.advert, self.form, self.related, self.notice))()
            if kind > 0.97:
                self.parts.append(f"<h{r.randint(2, 4)}>{MARK}{self.heading(7)}</h4></h3></h2>")
            elif kind > 0.94:
                tag = r.choice(("ul", "ol"))
                self.parts.append(f"<{tag}>" + "".join(f"<li>{MARK}{self.sentence(1, 14)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind > 0.92:
                self.parts.append(f"<blockquote><p>{self.prose(True, 4)}</p></blockquote>")
            elif kind > 0.91:
                cells = "".join(f"<tr><td>{MARK}{self.word()}<td>{MARK}{r.randint(1, 999)}" for _ in range(r.randint(2, 5)))
                self.parts.append(f"<table>{cells}</table>")
            elif kind > 0.90:
                self.parts.append(f"<figure><img src='x'><figcaption>{self.prose(True, 2)}</figcaption></figure>")
            else:
                text = self.prose(True)
                if r.random() < 0.15:
                    first, _, rest = text.partition(" ")
                    text = f"{first} {self.link(rest[:30])}{rest[30:]}" if "&" not in rest else text
                if loose and r.random() < 0.25:
                    self.parts.append(f"<p><b>{text}<br>")
                else:
                    tag = "p" if r.random() < 0.93 else "div"
                    self.parts.append(f"<{tag}>{text}</{tag}>")

    def page(self) -> str:
        r = self.random
        lang = r.choice(("en", "de", "fr", "es"))
        self.parts.append(f'<!DOCTYPE html><html lang="{lang}"><head><meta charset="utf-8"><title>x</title></head><body>')
        wrapped = r.random() < 0.3
        if wrapped:
            self.parts.append(r.choice(('<div id="wrapper">', '<div class="container">', '<div class="page"><div class="row">', "<table><tr><td>", "<form id='aspnet'>")))
        for part, share in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.75), (self.advert, 0.35), (self.sidebar, 0.2), (self.form, 0.08)):
            if r.random() < share:
                part()
        if r.random() < 0.97:
            style = r.random()
            if style < 0.45:
                self.parts.append(f"<article{self.names('main') if r.random() < 0.3 else ''}>")
                self.body()
                if r.random() < 0.15:
                    r.choice((self.related, self.form, self.advert))()
                self.parts.append("</article>")
            elif style < 0.55:
                self.parts.append("<main>")
                self.body()
                self.parts.append("</main>")
            elif style < 0.92:
                self.box("main", self.body, "" if r.random() < 0.6 else "div")
            else:
                self.body()
        for part, share in (
            (self.related, 0.25), (self.advert, 0.15), (self.comments, 0.35), (self.sidebar, 0.25), (self.form, 0.12), (self.notice, 0.1), (self.footer, 0.8),
        ):
            if r.random() < share:
                part()
        if wrapped:
            self.parts.append("</div></div></td></table></form>")
        if r.random() < 0.85:
            self.parts.append("</body></html>")
        return "".join(self.parts)


def labelled_page(seed: int, paths: Paths) -> tuple[list[Block], list[bool]]:
    """Blocks of one invented page and whether each is main text; a seed always gives the same page."""
    blocks = page_blocks(_Writer(seed).page(), paths)
    labels = [MARK in b.text for b in blocks]
    return [Block(b.node, b.text.replace(MARK, "") or "x", b.linked) for b in blocks], labels
