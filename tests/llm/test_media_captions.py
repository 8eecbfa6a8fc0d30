"""No caption text of a page is lost, wherever it stands."""

import pytest

from shelf.llm import media


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<figure><figcaption>C</figcaption><img src='u'></figure>", [("u", "C")]),
        ("<figure><img src='u'><figcaption>C <i>d</i></figcaption><img src='v'></figure>x", [("u", "C d"), ("v", "C d"), ("x", None)]),
        ("a<figcaption>C</figcaption>b", [("a", None), ("C", None), ("b", None)]),
        ("<figure><figcaption>C</figcaption></figure>b", [("C", None), ("b", None)]),
        ("<figure><img src='u'><figcaption>C</figure><p>rest</p>", [("u", "C"), ("rest", None)]),
        ("<figure><img src='u' alt='q'><figcaption></figcaption></figure>", [("u", "q")]),
        ("<figure><img src='u'><figcaption>C", [("u", "C")]),
        ("<figcaption>C", [("C", None)]),
        ("<figure><figure><img src='u'><figcaption>C</figcaption></figure><img src='v'><figcaption>D</figcaption></figure>", [("u", "C"), ("v", "D")]),
        ("<figure><figure><img src='u'><figcaption>C</figcaption></figure><figcaption>D</figcaption></figure>", [("u", "C"), ("D", None)]),
    ],
)
def test_captions(page, want):
    items = media.parse_html(page)
    assert [(i["text"] or i["ref"], i["caption"]) for i in items] == want
    assert [i["pos"] for i in items] == list(range(len(items)))
