"""Main text of pages that have another form than those of the fixture."""

import pyarrow.parquet as pq
import pytest

from tessera.llm.html_text import main_text

STORY = "The ship left the harbour at dawn, slowly, under grey clouds; nobody waved. It was cold, wet and quiet, and so it stayed, for days. "
PARAGRAPHS = [f"{STORY}Part {i}, again: {STORY}".strip() for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n".join(PARAGRAPHS)


def test_ratios_decide_without_article():
    """Pages of the fixture give the same text when their article tags are taken away."""
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist():
        bare = html.replace("<article>", "").replace("</article>", "")
        assert bare != html and main_text(bare) == main_text(html) != ""


def test_articles_that_are_cards():
    cards = "".join(f"<article class=card><h3><a href=/{i}>Other {i}</a></h3><p>Read more</p></article>" for i in range(6))
    assert main_text(f"<body><div class=story>{BODY}</div>{cards}") == TEXT
    assert main_text(f"<body>{cards}<div class=story>{BODY}</div>") == TEXT


def test_headings_lists_and_tables_come_with_their_text():
    page = f"<body><div><a href=/>Home</a> <a href=/b>Board</a></div><div id=x><h1>A short heading here</h1>{BODY}<h2>Numbers</h2><ul><li>One<li>Two</ul><table><tr><td>4<td>5</table></div><footer>Imprint</footer>"
    assert main_text(page) == f"A short heading here\n{TEXT}\nNumbers\nOne\nTwo\n4\n5"
    wide = "".join(f"<tr><td>{i}<td>{i * i}" for i in range(400))
    assert main_text(f"<body><main><h1>Squares</h1>{BODY}<table>{wide}</table></main>").startswith(f"Squares\n{TEXT}\n0\n0\n1\n1\n2\n4")


@pytest.mark.parametrize("tag", ['main class="has-sidebar"', 'article id="search-engines"', 'div class="content-widget"', "div class=widget", "div class=has-sidebar", "form id=form1"])
def test_marked_containers_of_the_text(tag):
    name = tag.split()[0]
    page = f"<body><div class=top><a href=/>Home</a></div><{tag}><h1>Title</h1>{BODY}<div class=comments><p>I agree, fully.</p></div></{name}><footer>Imprint, 2020.</footer>"
    assert main_text(page) == f"Title\n{TEXT}"


def test_long_comments_do_not_win():
    comments = "".join(f"<p>I agree, {i} times, with all of that. {STORY}</p>" for i in range(9))
    assert main_text(f"<body><div class=post>{BODY}</div><div class=comments>{comments}</div>") == TEXT
    assert main_text(f"<body><article>{BODY}</article><section class=comment-list>{comments}</section>") == TEXT
