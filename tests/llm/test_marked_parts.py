"""Pages whose <article> is not, or not all of, the main text."""

import pytest

from erlink.llm import tagpath

MAIN = "<p>The main text, which is long; it goes on, and on, with commas.</p>" * 4
TEXT = "\n\n".join(["The main text, which is long; it goes on, and on, with commas."] * 4)
PAGES = {
    "teaser beside": (f"<body><div class=content>{MAIN}</div><article class=teaser><p>Read this next, please.</p></article></body>", TEXT),
    "comment beside": (f"<body><div class=content>{MAIN}</div><article class=comment><p>Nice, thanks.</p></article></body>", TEXT),
    "plain card beside": (f"<body><div><div>{MAIN}</div></div><article><p>Go</p></article></body>", TEXT + "\n\nGo"),  # the article's odds outweigh its shortness
    "short parts inside": (f"<body><div><p>Other, short.</p></div><article class='post sidebar-right'><header><h1>Head</h1></header><div>{MAIN}<ul><li>x</ul></div></article></body>", "Head\n\n" + TEXT + "\n\nx"),
}


@pytest.mark.parametrize("name", PAGES)
def test_marked_parts(name):
    page, want = PAGES[name]
    assert tagpath.extract(page) == want
