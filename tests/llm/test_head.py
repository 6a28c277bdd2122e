"""Pages that leave out the end of their head."""

import pytest

from corpusloom.llm.htmlblocks import blocks

REST = "<h1>Big</h1><p>First <a href=x>link</a>.<p>Second."


def texts(html):
    return [(b.text, b.linked, [e[0] for e in b.path if e[0] not in ("html", "body")]) for b in blocks(html)]


@pytest.mark.parametrize("start", ["<html><head><title>T</title><body>", "<html><head><meta charset=utf-8><style>a{}</style><link rel=x>", "<head><title>T</title><noscript><img src=x>no</noscript><script>1</script><body>"])
def test_pages_without_an_end_of_the_head(start):
    assert texts(start + REST) == texts("<html><head><title>T</title></head><body>" + REST + "</body></html>")
    assert [t for t, _, _ in texts(start + REST)] == ["Big", "First link.", "Second."]


def test_text_and_inline_elements_end_a_head():
    assert [t for t, _, _ in texts("<head><title>T</title>Words <b>here</b>")] == ["Words here"]
    assert [t for t, _, _ in texts("<head><title>T</title> <a href=x>here</a> too")] == ["here too"]


def test_what_is_in_a_head_stays_unseen():
    assert texts("<head><title>T</title><noscript><p>no</p></noscript><template><p>no</p></template></head><body><p>yes") == texts("<body><p>yes")
