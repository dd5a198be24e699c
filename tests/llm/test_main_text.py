"""Main text of hand-made layouts: what must stay, what must go, and the share of words that come out right over all of them."""

import collections
import random

import pytest

from grainmill.llm.html_extract import extract

RNG = random.Random(11)
_WORDS = "water stone river light paper window garden market winter letter bridge signal pattern morning engine harvest copper island village method".split()


def sentence(n: int = 14) -> str:
    w = [RNG.choice(_WORDS) for _ in range(n)]
    return f"{' '.join(w[: n // 2])}, {' '.join(w[n // 2 :])}.".capitalize()


def paragraphs(n: int = 5) -> list[str]:
    return [" ".join(sentence() for _ in range(RNG.randrange(2, 5))) for _ in range(n)]


def marked_up(texts: list[str], tag: str = "p") -> str:
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


TITLE, BODY = "The title of it all", paragraphs()
H, P = f"<h1>{TITLE}</h1>", marked_up(BODY)
TEXT = " ".join([TITLE, *BODY])
MENU = '<ul class="m">' + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _WORDS[:7]) + "</ul>"
NAV, FOOT = f"<nav>{MENU}</nav>", "<footer><p>Copyright of somebody, all rights reserved, and terms of use.</p></footer>"
SIDE = f"<aside><h3>Read more</h3>{MENU}<p>{sentence()}</p></aside>"
COMMENTS = f'<section id="comments"><h3>Comments</h3>{marked_up(paragraphs(9))}</section>'
REFERENCES = [f"Author {i} of a long work, {sentence(8)}" for i in range(4)]
REFERENCE_LIST = "<h2>References</h2><ol>" + "".join(f'<li><a href="http://x/{i}">{t}</a></li>' for i, t in enumerate(REFERENCES)) + "</ol>"

#: name -> page, main text
LAYOUTS = {
    "article": (f"<body>{NAV}<article>{H}{P}</article>{FOOT}", TEXT),
    "article in a div with a side's name": (f'<body>{NAV}<div class="main sidebar-right"><article>{H}{P}</article></div><div class="box"><p>Forty characters of another box, no more.</p></div>{FOOT}', TEXT),
    "div with a side's name alone": (f'<body>{NAV}<div class="main sidebar-right">{H}{P}</div><div class="box"><p>Forty characters of another box, no more.</p></div>{FOOT}', TEXT),
    "page-wide form": (f'<body><form id="aspnet"><input type="hidden">{NAV}<article>{H}{P}</article>{FOOT}</form>', TEXT),
    "page-wide form without article": (f'<body><form id="aspnet">{NAV}<div id="content">{H}{P}</div>{FOOT}</form>', TEXT),
    "recommended in the name": (f'<body>{NAV}<div id="recommended-reading-list"><article>{H}{P}</article></div>{FOOT}', TEXT),
    "recommended in the name alone": (f'<body>{NAV}<div id="recommended-reading-list">{H}{P}</div>{FOOT}', TEXT),
    "article header": (f'<body>{NAV}<article><div class="article-header">{H}</div>{P}</article>{FOOT}', TEXT),
    "header in main": (f"<body>{NAV}<main><header>{H}</header>{P}</main>{FOOT}", TEXT),
    "formula": (f"<body><article>{H}<p>So <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is a sum, as {sentence()}</p>{P}</article>", None),
    "references": (f"<body>{NAV}<article>{H}{P}{REFERENCE_LIST}</article>{FOOT}", " ".join([TEXT, "References", *REFERENCES])),
    "list of notes": (f'<body><article>{H}{P}<ul class="footnotes">{"".join(f"<li><a href=x>{t}</a></li>" for t in REFERENCES)}</ul></article>', " ".join([TEXT, *REFERENCES])),
    "menu in the article": (f"<body><article>{H}{MENU}{P}</article>", TEXT),
    "many comments": (f"<body>{NAV}<article>{H}{P}</article>{COMMENTS}{FOOT}", TEXT),
    "comments in the article": (f"<body><article>{H}{P}{COMMENTS}</article>{FOOT}", TEXT),
    "comments and no article": (f'<body>{NAV}<div id="post">{H}{P}</div>{COMMENTS}{FOOT}', TEXT),
    "flat body": (f"<body>{NAV}{H}{P}{FOOT}", TEXT),
    "divs for paragraphs": (f'<body>{NAV}<div id="c"><h1>{TITLE}</h1>{marked_up(BODY, "div")}</div>{SIDE}{FOOT}', TEXT),
    "table layout": (f"<body><table><tr><td>{MENU}</td><td>{H}{P}</td></tr></table>{FOOT}", TEXT),
    "breaks for paragraphs": (f'<body>{NAV}<div class="story">{H}{"<br><br>".join(BODY)}</div>{FOOT}', TEXT),
    "headline beside the article": (f"<body>{NAV}<div>{H}<article>{P}</article></div>{FOOT}", TEXT),
    "nested sections": (f'<body>{NAV}<div id="main"><section>{H}{marked_up(BODY[:2])}</section><section>{marked_up(BODY[2:])}</section></div>{SIDE}{FOOT}', TEXT),
    "lists and quotes": (f"<body><main>{H}<ul><li>{BODY[0]}</li><li>{BODY[1]}</li></ul><blockquote>{BODY[2]}</blockquote>{marked_up(BODY[3:])}</main>{SIDE}", TEXT),
    "adverts between": (f'<body><article>{H}{marked_up(BODY[:2])}<div class="ad-slot"><p>{sentence()}</p></div>{marked_up(BODY[2:])}</article>{FOOT}', TEXT),
    "consent and newsletter": (f'<body><div class="cookie-consent"><p>{sentence()}</p></div><article>{H}{P}<form class="newsletter"><p>{sentence()}</p><input></form></article>{FOOT}', TEXT),
    "page by roles": (f'<body><div role="navigation">{MENU}</div><div role="main">{H}{P}</div><div role="complementary"><p>{sentence()}</p></div><div role="contentinfo"><p>{sentence()}</p></div>', TEXT),
    "hidden parts": (f'<body><article>{H}<p style="display: none">{sentence()}</p>{P}<div hidden><p>{sentence()}</p></div></article>', TEXT),
    "open elements": (f"<body>{NAV}<article>{H}<p>{'<p>'.join(BODY)}", TEXT),
}


def score(got: str, want: str) -> float:
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.mark.parametrize("name", sorted(n for n, (_, want) in LAYOUTS.items() if want))
def test_layout(name):
    page, want = LAYOUTS[name]
    assert extract(page) == want


def test_formulas_stay():
    assert "So a+b is a sum" in extract(LAYOUTS["formula"][0]).replace(" + ", "+")


def test_words_over_all_layouts():
    scores = [score(extract(page), want) for page, want in LAYOUTS.values() if want]
    print(f"token F1 over {len(scores)} layouts: {sum(scores) / len(scores):.4f}")
    assert sum(scores) / len(scores) > 0.98
