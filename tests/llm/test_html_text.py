"""Page extraction: block cutting, the field against brute force, and accuracy on held-out pages."""

import html as entities
import itertools
import re

import numpy as np
import pytest

from tapewright.llm import crf, dom, html_text, queries


def texts(page):
    return [b.text for b in dom.blocks_of(page)[0]]


def test_blocks():
    assert texts("<p>a <b>b</b>c<br>d&nbsp;&amp;amp;<p>e<li>f") == ["a bc d &amp;", "e", "f"]
    assert texts("<div>x<script>var t='</p>';</script>y<!-- no --><style>z{}</style></div>") == ["xy"]
    assert texts("1 < 2 <a title='>'>link</a></zz> &lt;p&gt;") == ["1 < 2 link <p>"]
    assert texts("") == texts("<p></p> \n") == texts("<!-- open") == texts("<script>never closed <p>x") == []
    blocks, title = dom.blocks_of("<title>T &amp; U</title><article class='Post-body'><p><b>q<p>r</article>s")
    assert title == "T & U" and [b.text for b in blocks] == ["q", "r", "s"]
    assert "c:post" in blocks[1].above and "t:b" not in blocks[1].above and "t:article" not in blocks[2].above
    assert len(texts("<div>" * 3000 + "x" + "<b>" * 3000 + "y")) == 1


@pytest.fixture(scope="module")
def field():
    return crf.train(*html_text.labelled_pages([], 200))


def test_viterbi_is_best_of_all(field):
    names = sorted(field.index)
    rng = np.random.default_rng(4)
    for n in range(1, 9):
        sequence = [[names[i] for i in rng.integers(0, len(names), 3)] for _ in range(n)]
        scores = field.potentials(sequence)

        def value(y, s=scores):
            return field.edge[y[0]] + sum(s[t, k] for t, k in enumerate(y)) + sum(field.pair[a, b] for a, b in zip(y, y[1:], strict=False))

        assert value(field.decode(sequence)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))
    assert field.decode([]) == []


def test_training_raises_likelihood_of_truth():
    sequences = [[["a"], ["b"], ["b"]], [["b"], ["a"]], [["a"]], []] * 5
    labels = [[0, 1, 1], [1, 0], [0], []] * 5
    model = crf.train(sequences, labels)
    assert [model.decode(s) for s in sequences] == labels
    assert crf.train([], []).decode([["x"]]) in ([0], [1])


def test_held_out_layouts(field):
    sequences, labels = html_text.labelled_pages([], 150, seed=1234)
    wrong = sum(a != b for s, y in zip(sequences, labels, strict=True) for a, b in zip(field.decode(s), y, strict=True))
    assert wrong < 0.03 * sum(map(len, labels))


def article(page):
    """Truth for the test pages, whose markup marks the article."""
    inner = re.sub(r"</?b>", "", page.split("<article>")[1].split("</article>")[0])
    parts = [" ".join(entities.unescape(p.replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_query_gives_whole_articles(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.page_id: article(r.html) for r in queries.pages(spark, sf).collect()}
    got = queries.op7_html_text(spark, sf).collect()
    assert len(got) == len(truth)
    assert sum(r.text != truth[r.page_id] for r in got) == 0
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_tables(spark, field):
    body = "<article><h1>Head</h1><p>" + "Long words of text follow here. " * 20000 + "</p></article>"
    rows = [(1, "u", None, "x"), (2, "u", "", None), (None, None, body, "x"), (3, "u", "<nav><a>m</a></nav>", "x"), (3, "u", "<nav><a>m</a></nav>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame, field).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2, 3)} == {""}
    assert [r.n_chars > 600000 for r in got if r.page_id is None] == [True]
    empty = frame.limit(0)
    assert html_text.extract(empty, html_text.trained(empty)).count() == 0
