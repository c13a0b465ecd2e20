"""Main text of pages: names that do not decide alone, what is left of headers and forms, broken markup in linear time, generated pages."""

from __future__ import annotations

import random
import time

import pytest

from corvia.llm.html import main_text
from tests.llm.test_cases import STORY, TEXT


@pytest.mark.parametrize("name", ["story social", "content widget", "post-with-comments", "main-sidebar"])
def test_a_name_does_not_empty_a_page(name):
    assert main_text(f"<body><nav>menu</nav><div class='{name}'>{STORY}</div><footer>f</footer></body>") == TEXT
    assert main_text(f"<body><div id=feature-promo>{STORY}</div></body>") == TEXT


def test_a_form_around_the_page():
    assert main_text(f"<body><form action=x><input name=a><label>Label, of it</label><fieldset><div>{STORY}</div></fieldset><button>Go</button><select><option>One</select></form></body>") == TEXT
    form = "<form><p>Your name, your mail, and what you think of it all, please.</p><input></form>"
    assert main_text(f"<body><div>{STORY}</div>{form}</body>") == TEXT
    assert main_text(f"<body><div>{STORY}{form}</div></body>") == TEXT


def test_text_beside_the_best_container_stays():
    page = f"<body><div id=wrap><div><p>Opening words.</p></div><div>{STORY}</div><div><p>End note.</p></div><div><a href=a>one</a> <a href=b>two</a> <a href=c>three</a></div></div></body>"
    assert main_text(page) == f"Opening words. {TEXT} End note."


def test_headings_of_an_article_stay():
    assert main_text(f"<body><header><h1>Site</h1></header><article><header><div><h1>Head</h1></div><p>By someone, today</p></header>{STORY}</article></body>") == f"Head {TEXT}"


@pytest.mark.parametrize("name", ["responses-list", "comments", "reader-comments", "comment_thread replies"])
def test_reader_comments_within_an_article_go(name):
    assert main_text(f"<body><article>{STORY}<div class='{name}'><p>A reader says, loudly, that all of this is wrong.</p></div></article></body>") == TEXT


def test_long_comments_do_not_beat_a_short_story():
    comments = "<div class='post-comments'>" + "<p>A reader says, loudly, and at length, that all of this is wrong, and why, and for whom.</p>" * 30 + "</div>"
    assert main_text(f"<body><div class=post>{STORY}</div>{comments}</body>") == TEXT
    assert main_text(f"<body><article>{STORY}{comments}</article></body>") == TEXT


@pytest.mark.parametrize("start", ["<a href='", '<a href="', "<a ", "<!", "<aa", "<a href='x\" ", "<script x</script", "<p title='\">", "<a href=' > \" ", "</p title=\"'"])
def test_open_ends_cost_no_more_than_in_proportion(start):
    page = start * ((1 << 20) // len(start))
    began = time.perf_counter()
    main_text(page)
    assert main_text(f"<body><article>{STORY}</article>{page}").startswith(TEXT)
    assert time.perf_counter() - began < 4


def test_brackets_in_quotes():
    assert main_text(f"<body><article title='a > b' data-x=\"<p>no</p>\">{STORY}</article></body>") == TEXT
    assert main_text(f"<body><article>{STORY}<p>Left <b title='open>bold</b> here.</p></article></body>") == f"{TEXT} Left bold here."
    assert main_text(f"<body><article>{STORY}<p>So a < b and b <3 c.</p></article> <!-- open <p>no</p>") == f"{TEXT} So a < b and b <3 c."


def test_generated_pages():
    """Articles of known text among furniture of every kind, in random order and markup."""
    rng = random.Random(5)
    words = "river stone window paper garden market silver morning winter letter engine bridge forest candle".split()

    def sentence(n: int) -> str:
        return (" ".join(rng.choices(words, k=n)) + ", and " + " ".join(rng.choices(words, k=n))).capitalize() + "."

    links = lambda n: "".join(f"<li><a href=/{i}>{rng.choice(words)}</a></li>" for i in range(n))
    for _ in range(200):
        blocks, want = [], []
        for _ in range(rng.randint(4, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "inline"])
            text = sentence(rng.randint(5, 20))
            if kind == "ul":
                items = [sentence(3) for _ in range(3)]
                blocks.append("<ul>" + "".join(f"<li>{x}" + rng.choice(["</li>", ""]) for x in items) + "</ul>")
                want += items
            elif kind == "inline":
                blocks.append(f"<p>{text} <em>more &amp; more</em>\n <a href='x'>link</a>&nbsp;end</p>")
                want.append(f"{text} more & more link end")
            else:
                tag = {"quote": "blockquote"}.get(kind, kind)
                blocks.append(f"<{tag}>{text}</{tag}>")
                want.append(text)
        body = "\n".join(blocks)
        inside = rng.choice(["", "<div class=share-bar><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>", "<aside><p>An aside, which is long enough to count as some text.</p></aside>", "<script>x()</script>"])
        at = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class=post-body>%s</div>", "<div id=content><div class=text>%s</div></div>", "<section>%s</section>"])
        story = at % (body + inside)
        furniture = [
            f"<nav><ul>{links(6)}</ul></nav>", "<header><a href=/>Site</a><p>The best of sites, they say, since long ago.</p></header>",
            f"<footer><p>{sentence(6)}</p></footer>", f"<div class=sidebar><ul>{links(5)}</ul><p>{sentence(5)}</p></div>",
            f"<div id='comments'><p>{sentence(9)}</p><p>{sentence(9)}</p></div>", f"<div class='cookie-notice'><p>{sentence(6)}</p><button>OK</button></div>",
            f"<form><p>{sentence(4)}</p><input></form>", f"<div class='ad-box'>{sentence(5)}</div>", f"<div><ul>{links(7)}</ul></div>",
        ]
        some = rng.sample(furniture, rng.randint(2, len(furniture)))
        cut = rng.randint(0, len(some))
        page = f"<html><head><title>t</title></head><body>{''.join(some[:cut])}{story}{''.join(some[cut:])}</body></html>"
        assert main_text(page) == " ".join(want), page
