import random
import time

import pytest

from quillspark.llm import html_text

STORY = "".join(f"<p>{i} {'a sentence of the story that goes on for a while ' * 4}</p>" for i in range(6))
TEXT = " ".join(f"{i} {' '.join(['a sentence of the story that goes on for a while'] * 4)}" for i in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class=story>{STORY}</div><article class=card><p>Read this too</p></article></body>", TEXT),
        (f"<body><div class=story>{STORY}</div><article><p>Read this too</p></article></body>", f"{TEXT} Read this too"),
        (f"<body><article>{STORY}</article><article><p>Short second.</p></article></body>", f"{TEXT} Short second."),
        (f"<body><h1>Name</h1><article>{STORY}</article></body>", f"Name {TEXT}"),
        ("<h1>Hi</h1><p>Short text.</p>", "Hi Short text."),
        (f"<body><table><tr><td>{'long cell of words ' * 40}</td></tr><tr><td>Total</td><td>5</td></tr></table></body>", " ".join(["long cell of words"] * 40) + " Total 5"),
        (f"<body><article>{STORY}<p class='advertisement'>Buy</p><p class='share'>Share it</p></article></body>", TEXT),
        (f"<body><nav><h2>Menu</h2><a href=a>x</a></nav><article>{STORY}</article><div class=footer>f</div></body>", TEXT),
    ],
)
def test_articles_are_evidence(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("unit", ["<font>x ", "<b>x ", "<div>x", "<p>x", "<a href=x>y", "<form>z", "<span class=menu>q", "<article>w", "</div>x<div>"])
def test_time_grows_with_the_page(unit):
    def seconds(size):
        began = time.process_time()
        html_text.main_text(unit * (size // len(unit)))
        return time.process_time() - began

    seconds(20_000)
    small, large = seconds(200_000), seconds(800_000)
    assert large < 8 * small + 0.5


def test_unclosed_inline_tags_change_nothing():
    assert html_text.main_text(f"<body><font><article>{STORY.replace('<p>', '<p><font><b>')}</article></body>") == TEXT
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep words" + "</div>" * 3000 + "<p>after</p></article>") == "deep words after"


def test_random_pages():
    """Paragraphs of random sizes in nested blocks, with furniture at random places: all paragraphs stay, in order, and no furniture."""
    rng = random.Random(4)
    for _ in range(60):
        words = iter(range(10_000))
        paragraph = lambda: f"<p>{' '.join(f'word{next(words)}' for _ in range(rng.randrange(3, 60)))}</p>"
        junk = lambda: rng.choice(["", "", "<nav><a href=a>JUNK</a></nav>", "<script>JUNK</script>", "<div class='social-share'>JUNK</div>", "<aside>JUNK</aside>", "<!-- JUNK -->"])
        body = lambda depth: "".join(junk() + (f"<section>{body(depth - 1)}</section>" if depth and rng.random() < 0.3 else paragraph()) for _ in range(rng.randrange(2, 6)))
        page = f"<html><head><title>JUNK</title></head><body>{junk()}<article><h1>TITLE</h1>{body(2)}</article>{junk()}<footer>JUNK</footer></body></html>"
        text = html_text.main_text(page).split()
        assert text[0] == "TITLE" and "JUNK" not in text and text[1:] == [f"word{i}" for i in range(next(words))]
