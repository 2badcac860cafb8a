"""The two passes decide, and articles lose nothing."""

import re

import pytest
from topograin.llm import html_text
from topograin.llm.shared import table

STORY = "The first of the paragraphs is about this and that, and it goes on for long enough to be taken as good text by all of the rules."
POOR = "Zqxwv plmkt brrgh sdfgh wrtzp " * 6


@pytest.mark.parametrize("page, want", [
    ('<p>Before</p><svg width="1"/><p>After</p>', "Before\n\nAfter"),
    ("<p>Before</p><svg><path/></svg><p>After</p>", "Before\n\nAfter"),
    ("<p>Before</p><video src=x><p>After</p>", "Before\n\nAfter"),
    ("<p>Before</p><script src=x/>hidden</script><p>After</p>", "Before\n\nAfter"),
    ('<article><p class="related-work">One</p><p class="ad-hoc">two</p><div class="no-sidebar"><p>three</p></div></article>', "One\n\ntwo\n\nthree"),
    ('<article><p>One</p><div class="ad-box">x</div><div class="related posts">y</div><p class="ad">z</p><div id="shareBar">s</div></article>', "One"),
    ("<article><h1>A</h1><p>b</p></article>", "A\n\nb"),
    (f"<article><h1>Head</h1><p>{STORY}</p><p>{POOR}</p></article>", f"Head\n\n{STORY}\n\n{POOR.strip()}"),
    (f"<article><h1>Head</h1><p>{POOR}</p></article>", f"Head\n\n{POOR.strip()}"),
    ("<article><p><a href=1>Next</a></p><p><a href=2>Zqx wvu</a></p></article>", ""),
    (f"<article><ul><li><a href=1>{STORY}</a></li></ul><p>{STORY}</p></article>", STORY),
    ("<article><p>" + "Это длинный абзац на другом языке без знакомых слов. " * 4 + "</p></article>", ("Это длинный абзац на другом языке без знакомых слов. " * 4).strip()),
])
def test_pages(page, want):
    assert html_text.main_text(page) == want


def test_rules_alone_find_the_articles_of_the_fixture(spark):
    """Without article elements and class names the two passes must find all of the same texts."""
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    bare = [re.sub(r"<(/?)article>", r"<\1div>", re.sub(r' class="[^"]*"', "", p)) for p in pages]
    for page, text in zip(bare, map(html_text.main_text, pages)):
        whole, rules = text.split("\n\n"), html_text.main_text(page).split("\n\n")
        assert not set(whole) - set(rules) and len(rules) <= len(whole) + 1  # the advert has no name here


def test_stop_words_and_links_decide_without_structure():
    links = "<ul>" + "<li><a href=x>Something or other of that</a></li>" * 4 + "</ul>"
    page = f"<div>{links}<p>{POOR}</p>{links}<h2>Head</h2><p>{STORY}</p><p>Short one.</p><p>{STORY}</p>{links}</div>"
    assert html_text.main_text(page) == f"Head\n\n{STORY}\n\nShort one.\n\n{STORY}"
    assert html_text.main_text(page, frozenset()) != html_text.main_text(page)


def brute_force(blocks):
    """The labels of blocks by the rules, each looked up anew from the text of the module."""
    first = [html_text.first_pass(b) for b in blocks]
    regions = {b.region for b in blocks if b.article and not b.outside}
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        if b.region in regions:
            own = [k for k, x in enumerate(blocks) if x.region == b.region and not x.outside]
            if not any(first[k] for k in own):
                open_ = [blocks[k] for k in own if first[k] is None]
                words = " ".join(x.text for x in open_).split()
                stops = sum(w.lower().strip(".,;:!?\"'()") in html_text.STOP_WORDS for w in words)
                links = sum(x.linked for x in open_) > html_text.LINKS * sum(map(len, words))
                out.append(not links or stops >= html_text.MIN_STOPS * len(words))
            else:
                before = [first[k] for k in own if k < i and first[k] is not None]
                after = [first[k] for k in own if k > i and first[k] is not None]
                out.append(bool(before[-1:] == [True] or after[:1] == [True]))
            continue
        if not regions and not any(first):
            out.append(True)
            continue
        near = sorted((abs(k - i), not (first[k] and x.region not in regions)) for k, x in enumerate(blocks) if k != i and not x.outside and (first[k] is not None or x.region in regions))
        one = [min((n for n in near if True), default=None)]
        out.append(one[0] is not None and not one[0][1])
    return out


def test_second_pass_is_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = [STORY, POOR.strip(), "Short.", "Of the and to it", "x" * 200]
    for _ in range(400):
        blocks, region = [], 0
        for _ in range(int(rng.integers(1, 12))):
            region += rng.random() < 0.2
            inside = bool(region and rng.random() < 0.7)
            text = texts[rng.integers(len(texts))]
            blocks.append(html_text.Block(linked=len(text) if rng.random() < 0.2 else 0, outside=bool(rng.random() < 0.15), article=inside, region=region if inside else 0, heading=bool(rng.random() < 0.1), item=bool(rng.random() < 0.3), text=text))
        assert html_text.classify(blocks) == brute_force(blocks), blocks
