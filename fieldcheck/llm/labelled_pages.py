"""Labelled pages for training the extractor: pages put together by rule, so each block's label is known."""

from __future__ import annotations

import random

#: Pages made, and the seed of their making.
PAGES, SEED = 600, 11

MAIN, REST = 1, 0
_SYLLABLES = "an ti re on ed the st er sh ing of ou le que ver sch ung ich ado mente ción eur ble in to ka mo su li dor".split()
_MENU = "Home News About Contact Login Search Help Archive Products Sports Travel Shop Blog Terms Privacy Subscribe".split()


#: Layouts of pages: elements that say what they hold, plain elements with telling names, plain elements without, and any of the first two.
TAGS, NAMES, BARE, MIXED = "tags", "names", "bare", "mixed"
#: Layouts that the extractor is trained on, in turn.
LAYOUTS = (MIXED, MIXED, MIXED, BARE)


class _Maker:
    def __init__(self, rng: random.Random, layout: str = MIXED) -> None:
        self.rng = rng
        self.layout = layout
        self.blocks: list[tuple[str, int]] = []  # text and label of each block in page order

    def element(self, choices: list[str]) -> str:
        """One of several elements that may hold something, as the layout allows."""
        plain = [c for c in choices if c.startswith("div")] or ["div"]
        telling = [c for c in choices if not c.startswith("div") and "=" not in c] or choices
        return self.rng.choice({TAGS: telling, NAMES: plain, BARE: ["div", "div", "section"], MIXED: choices}[self.layout])

    def words(self, low: int, high: int) -> str:
        r = self.rng
        style = r.random()
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if style < 0.06:
            out = [f"{w} |" for w in out]
        elif style < 0.12:
            out = [f"{w.upper()}!!" for w in out]
        elif style < 0.18:
            out = [w + r.choice(["###", "&&&", "$$$", "***"]) for w in out]
        elif style < 0.22:
            out = [out[0]] * len(out)
        elif style < 0.9:
            out = [w + r.choice([""] * 9 + [",", "."]) for w in out]
            out[0], out[-1] = out[0].capitalize(), out[-1].rstrip(",.") + "."
        if r.random() < 0.05:
            out.insert(r.randrange(len(out) + 1), r.choice(["+1 555-0100", "a.b@example.org", "https://example.net/x?y=1", "2024"]))
        return " ".join(out)

    def block(self, low: int, high: int, label: int) -> str:
        text = self.words(low, high)
        self.blocks.append((text, label))
        return text.replace("&", "&amp;")

    def any_length(self, label: int) -> str:
        r = self.rng
        return self.block(*r.choice([(1, 4), (5, 15), (10, 40), (30, 120)]), label)

    def link(self, label: int, text: str | None = None) -> str:
        text = text or " ".join(self.rng.sample(_MENU, 1))
        self.blocks.append((text, label))
        return f'<a href="/{text.lower()}">{text}</a>'

    def named(self, words: list[str]) -> str:
        r = self.rng
        if self.layout == BARE:
            return ""
        name = r.choice(words) + r.choice(["", "", "-box", "-wrap", "-1", "_area", " clearfix"])
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="x {name}"'])

    def menu(self) -> str:
        r = self.rng
        # an item may be any word, even of a running text
        items = "".join(f"<li>{self.link(REST, r.choice([None, self.words(1, 1).split()[0]]))}</li>" for _ in range(r.randint(2, 12)))
        name = f"div{self.named(['menu', 'nav', 'navbar', 'breadcrumb', 'topnav'])}"
        name = self.element(["nav", name, "nav"])
        return f"<{name}>{r.choice(['<ul>{}</ul>', '<ul>{}</ul>', '{}']).format(items)}</{name.split()[0]}>"

    def header(self) -> str:
        name = self.element(["header", f"div{self.named(['header', 'masthead', 'topbar', 'banner', 'site-header'])}"])
        return f"<{name}><h2>{self.block(1, 5, REST)}</h2><p>{self.block(2, 12, REST)}</p></{name.split()[0]}>"

    def footer(self) -> str:
        name = self.element(["footer", "footer", f"div{self.named(['footer', 'copyright', 'legal', 'bottom', 'site-footer'])}"])
        text = "© site.example.net · " + self.words(3, 20)
        self.blocks.append((text, REST))
        shown = text.replace("&", "&amp;").replace("©", "&copy;").replace("·", "&middot;")
        return f"<{name}>{shown}</{name.split()[0]}>"

    def advert(self) -> str:
        names = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad", "adsbygoogle"]
        return f"<div{self.named(names)}>{self.any_length(REST)}</div>"

    def side(self) -> str:
        name = self.element(["aside", f"div{self.named(['sidebar', 'side', 'related', 'widget', 'recommended', 'trending'])}"])
        title = self.block(1, 4, REST)
        rows = "".join(f"<p>{self.any_length(REST)}</p>" for _ in range(self.rng.randint(1, 3)))
        return f"<{name}><h3>{title}</h3>{rows}</{name.split()[0]}>"

    def notice(self) -> str:
        names = ["cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "share", "social"]
        return f"<div{self.named(names)}><p>{self.any_length(REST)}</p><button>{self.block(1, 2, REST)}</button></div>"

    def form(self) -> str:
        return f'<form action="/s"><label>{self.block(1, 6, REST)}</label><input name="q"><p>{self.any_length(REST)}</p><button>{self.block(1, 2, REST)}</button></form>'

    def comments(self) -> str:
        r = self.rng
        name = self.element([f"div{self.named(['comments', 'comment-list', 'discussion', 'replies', 'disqus', 'responses'])}", f"section{self.named(['comments', 'reader-comments'])}"])
        leaf = r.choice(["p", "li", f"div{self.named(['comment', 'reply', 'comment-body'])}", "article"])
        title = f"<h3>{self.block(1, 3, REST)}</h3>" if r.random() < 0.5 else ""
        rows = "".join(f"<{leaf}>{self.any_length(REST)}</{leaf.split()[0]}>" for _ in range(r.randint(1, 5)))
        return f"<{name}>{title}{rows}</{name.split()[0]}>"

    def main(self) -> str:
        r = self.rng
        good = ["content", "post", "entry", "story", "article", "article-body", "post-content", "main", "main-content", "text", "body"]
        name = self.element(["article"] * 4 + ["main", f"div{self.named(good)}", f"div{self.named(good)}", f"section{self.named(good)}", "div", f"article{self.named(good)}"])
        parts = [f"<h1>{self.block(2, 12, MAIN)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.06:
                parts.append(f"<div>{self.any_length(MAIN)}</div>")
            elif kind < 0.7:
                parts.append(f"<p>{self.any_length(MAIN)}" + r.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.78:
                parts.append(f"<p><b>{self.any_length(MAIN)}<br>")
            elif kind < 0.84:
                parts.append(f"<{(h := r.choice(['h2', 'h3']))}>{self.block(1, 8, MAIN)}</{h}>")
            elif kind < 0.9:
                parts.append(f"<ul>{''.join(f'<li>{self.any_length(MAIN)}</li>' for _ in range(r.randint(1, 4)))}</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote>{self.any_length(MAIN)}</blockquote>")
            else:
                parts.append(r.choice([self.advert, self.notice, self.side, self.form, self.comments, self.comments, self.menu])())
        return f"<{name}>{''.join(parts)}</{name.split()[0]}>"

    def page(self) -> str:
        r = self.rng
        above = [p for p in (self.menu, self.header, self.advert, self.notice, self.form, self.side) if r.random() < 0.35]
        below = [p for p in (self.comments, self.side, self.advert, self.notice, self.form, self.menu) if r.random() < (0.5 if p == self.comments else 0.35)]
        if r.random() < 0.08:  # a page of little else
            above, below = above[:1] if r.random() < 0.5 else [], []
        r.shuffle(above)
        r.shuffle(below)
        order = [*above, self.main, *below, *([self.footer] if r.random() < 0.8 else [])]
        wrap = r.choice(["{}", "{}", '<div class="page">{}</div>', '<div id="wrapper"><div class="container">{}</div></div>'])
        body = "".join(p() for p in order)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t='</p>';</script></head><body>{wrap.format(body.replace('{', '(').replace('}', ')'))}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED, layouts: tuple[str, ...] = (MIXED,)) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, blocks with their labels) of ``pages`` pages, their layouts in turn, the same for the same seed."""
    rng = random.Random(seed)
    out = []
    for k in range(pages):
        maker = _Maker(rng, layouts[k % len(layouts)])
        out.append((maker.page(), maker.blocks))
    return out
