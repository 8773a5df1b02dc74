import pytest

from ledgerlight.llm import html


@pytest.mark.parametrize("page, text", [
    ("<p title=it's>Hello</p><p>there</p>", "Hello\n\nthere"),
    ('<a href="x"">text</a> more', "text more"),
    ("<p it's>a</p>b", "a\n\nb"),
    ("<a title='a>b' href=x>c</a> d", "c d"),
    ("<a x=\"1\"y='>'z>c</a>", "c"),
    ("<p class= hidden=''>a</p>b", "a\n\nb"),
    ("<p class=>a</p>b", "a\n\nb"),
    ("<p a = 'x>y' hidden>no</p>b", "b"),
    ("a<p 'x", "a"),
])
def test_quotes_in_tags(page, text):
    assert html.page_text(page)[1] == text
