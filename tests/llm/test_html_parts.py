"""Main text of short pages: sections of any number and length, controls that prose names, leads, notices."""

import random

import pytest

from eqspark.llm.html_text import main_text

WORDS = "river stone market window letter garden signal copper winter morning paper engine silver island bridge record".split()


def prose(rng, chars):
    out = []
    while sum(map(len, out)) + len(out) < chars:
        out.append(rng.choice(WORDS))
    return (" ".join(out).capitalize())[: chars - 1].rstrip() + "."


@pytest.mark.parametrize("seed", range(40))
def test_sections_of_any_number_and_length(seed):
    rng = random.Random(seed)
    parts = [prose(rng, rng.randrange(40, 400)) for _ in range(rng.randrange(1, 7))]
    body = "".join(f"<section><p>{p}</p></section>" for p in parts)
    page = f"<html><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div>{body}</div><footer>All rights reserved</footer></body></html>"
    assert main_text(page) == "\n".join(parts)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Press the <label>Save</label> field and <button>OK</button> now.</p>", "Press the Save field and OK now."),
        ("<article><p>Some text of the article, which is long enough to be found.</p><form><p><label>Name</label> <input name=n> <button>Send</button> your message here</p></form></article>", "Some text of the article, which is long enough to be found."),
        ("<article><p>Some text of the article, which is long enough to be found.</p><p>Then press <button style='display:none'>Never</button>the switch.</p></article>", "Some text of the article, which is long enough to be found.\nThen press the switch."),
        ("<article><p>Some text of the article, which is long enough to be found.</p><button>Share</button><label>Mail</label></article>", "Some text of the article, which is long enough to be found."),
        ("<main><div><p class=lead>What this story is about, without a stop</p><div><p>A first paragraph, with commas, that is long enough to count for something.</p><p>A second paragraph, with commas, that is long enough to count.</p></div></div></main>", "What this story is about, without a stop\nA first paragraph, with commas, that is long enough to count for something.\nA second paragraph, with commas, that is long enough to count."),
        ("<div><p class=lead>What this story is about, without a stop</p><div><p>A first paragraph, with commas, that is long enough to count for something.</p><p>A second paragraph, with commas, that is long enough to count.</p></div></div>", "What this story is about, without a stop\nA first paragraph, with commas, that is long enough to count for something.\nA second paragraph, with commas, that is long enough to count."),
        ("<article><p>Some text of the article, which is long enough to be found.</p><div class='advice-notice'>Please read our terms.</div><p>More of the text, which is again long enough.</p></article>", "Some text of the article, which is long enough to be found.\nMore of the text, which is again long enough."),
        ("<div><div class=content><p>An article that is long, has commas, and goes on for a while, as articles do, so that it has points.</p><p>Another paragraph, with commas, and with text that goes on.</p></div><div>Short junk beside it</div></div>", "An article that is long, has commas, and goes on for a while, as articles do, so that it has points.\nAnother paragraph, with commas, and with text that goes on."),
    ],
)
def test_parts(page, want):
    assert main_text(page) == want
