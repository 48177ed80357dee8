"""The neighbour's verdict on pages whose markup names their main text."""

from terrachron.llm import op5_html


def page(*own, box="related-posts"):
    return op5_html.lines_of(f"<nav>Menu</nav><article><h1>{own[0]}</h1>{''.join(f'<p>{x}</p>' for x in own[1:])}<div class='{box}'><p>Read this next</p></div></article>")


def test_shared_parts_of_articles_go():
    a, b = page("One", "first text of some length", "a passage that both quote"), page("Two", "second text of some length", "a passage that both quote")
    assert op5_html.main_text(b, a) == "Two\n\nsecond text of some length\n\na passage that both quote"
    assert op5_html.main_text(b, None).endswith("Read this next")
    other = op5_html.lines_of("<article><h1>Three</h1><p>third text</p></article>")
    assert op5_html.main_text(b, other).endswith("Read this next")


def test_copies_lose_nothing():
    a = page("One", "first text of some length", "a passage that both quote")
    assert op5_html.main_text(a, a) == op5_html.main_text(a, None)
