"""Bodies beside teaser articles."""

from topograin.llm import html_text

STORY = "The first of the paragraphs is about this and that, and it goes on for long enough to be taken as good text by all of the rules."


def test_story_beside_teaser_articles():
    story = f"<div id=content><h1>Head</h1><p>{STORY}</p><p>Short one.</p><p>{STORY}</p></div>"
    want = f"Head\n\n{STORY}\n\nShort one.\n\n{STORY}"
    assert html_text.main_text(f"<body>{story}<aside><article>card</article></aside><p>tail</p></body>").startswith(want)
    assert "card" not in html_text.main_text(f"<body>{story}<aside><article>card</article><article>card</article></aside></body>")
    assert html_text.main_text(f"<body>{story}<article>card</article></body>").startswith(want)


def test_articles_after_what_is_left_open():
    assert html_text.main_text(f"<nav>x<article><p>{STORY}</p></article><p>y</p>") == STORY
    assert html_text.main_text(f"<p>top</p><article><p>{STORY}</p></article><p>y</p>") == STORY
