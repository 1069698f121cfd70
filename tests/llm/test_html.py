"""Main text of pages: the markup, the repeats of a host against a plain search, and the registered query."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import html_extraction
from pulsegrid.llm.html_blocks import ARTICLE, JUNK, OPEN, blocks
from pulsegrid.llm.queries import QUERIES

from .test_llm import by_row

PAGES = {
    # markup, text that the markup alone calls article or leaves open
    "<html><head><title>T</title><style>p{}</style></head><body><nav>n</nav><article><h1>A</h1><p>b <b>c<br>d<p>e</article><footer>f</footer>": "A\nb c d\ne",
    '<article>x<script>var t="</p></article>";</script>y<!-- <p>z --><p>w</article>': "xy\nw",
    "<article>1 &lt; 2 &amp;amp; &#233;&#x41; &copy &am; a < b <3</article>": "1 < 2 &amp; éA © &am; a < b <3",
    "<article><p title='a > b' class=\"x>y\">one</p><p data-x=\">two</article>": "one\ntwo",
    "<article><aside>s</aside><div class='ad-box'>ad</div><form>q<input></form><p>t</p><section id='comments'><article>c</article></section></article>": "t",
    "<div class='header'>h</div><main><p>m</p><div class='share'>s</div></main><div>d</div>": "m",
    "<div role=navigation>n</div><p>p</p><ul><li>a<li>b</ul><div style='display:none'>h</div><table><tr><td>1<td>2</table>": "p\na\nb\n1\n2",
    "<body class='has-sidebar'><div class='no-footer'><p>in</p></div><div id=siteFooter>f</div>": "in",
    "<article><header><p class=by>by</p><h1>H</h1></header><p>x</p></article>": "H\nx",
    "<div class=comments><article>c</article></div><article>a</article>": "a",
    "<p>a\x00b \xa0 c</p>": "a�b c",
    "<pre>  x\n\ty </pre><textarea>t</textarea><noscript><p>n</p></noscript><p>z": "x y\nz",
    "plain text only": "plain text only",
    "</p></div>stray<p><b></i>x</p": "stray\nx",
    "": "",
    "<article></article>": "",
    "<article><p>İİ<script>a<b</SCRIPT>after</p></article>": "İİafter",
}


@pytest.mark.parametrize("html", PAGES)
def test_markup(html):
    assert "\n".join(b.text for b in blocks(html)[1] if b.verdict != JUNK) == PAGES[html]


def test_verdicts_and_titles():
    assert [b.verdict for b in blocks("<article>a</article><p>b")[1]] == [ARTICLE, JUNK]
    assert [b.verdict for b in blocks("<main>a</main>")[1]] == [OPEN]
    assert blocks("<title>x &amp;\n y</title><h1>z</h1>")[0] == "x & y" and blocks("<h1>z <b>w</b></h1>")[0] == "z w"


def test_deep_and_broken_pages_are_read_in_time():
    for html in ("<div>" * 50_000 + "x", "<p>" * 50_000, "</i>" * 50_000, "<a b='" * 2000, "<!--" * 20_000, "<ul><li>" * 20_000 + "x", "<main>" * 20_000 + "<p>x" * 20_000):
        blocks(html)


def test_suffix_order():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        ids = draw.integers(0, 3, n)
        order, group = html_extraction.suffix_order(ids, 8)
        key = [tuple(ids[i : i + 8]) for i in range(n)]
        assert [key[i] for i in order] == sorted(key)
        assert all((group[i] == group[i - 1]) == (key[order[i]] == key[order[i - 1]]) for i in range(1, n))


def site(seed=1):
    """Pages of a few hosts: templates without any telling markup, unique text, copies, and pages with an article."""
    draw = random.Random(seed)
    say = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(n))
    quote = say(30)
    rows, want = [], {}
    for h in range(3):
        name = f"{'www.' * h}h{h}.example"
        menu, foot, tip = "".join(f"<div>{say(1)}</div>" for _ in range(6)), say(9), say(14)
        shared = f"the same {say(30)}"
        for k in range(12):
            text = [say(draw.randint(12, 40)) for _ in range(draw.randint(1, 4))]
            title = say(3)
            if k == 3:
                text.append(quote)
            if k in (5, 6):
                text, title = [shared, "as before"], "twin"
            key = h * 100 + k
            inner = "".join(f"<p>{t}</p>" for t in text)
            if k % 4 == 1:
                rows.append((key, f"http://{name}/{k}", f"<title>{title}</title><div>{tip}</div>{menu}<article>{inner}<p>{tip}</p></article>{foot}"))
                text = [*text, tip]
            else:
                rows.append((key, f"https://u@{name.upper()}:80/{k}?q", f"<title>{title}</title><body>{menu}<div>{inner}</div><div>{tip}</div><div>{foot}</div>"))
            want[key] = "\n".join(text)
    rows += [(900, None, f"<p>{foot}</p>"), (901, "no url", f"<p>{foot}</p>"), (902, rows[0][1], None), (903, rows[0][1], ""), (None, "http://solo.example/", "<p>a b"), rows[0]]
    want |= {900: foot, 901: foot, 902: "", 903: "", None: "a b"}
    return rows, want


def lone(tokens, certain, i):
    """Whether a mark among eight tokens lies beside a word of no article."""
    for j in range(i, i + 8):
        if tokens[j] == "\0":
            before = next((k for k in range(j, -1, -1) if tokens[k] != "\0"), None)
            after = next((k for k in range(j, len(tokens)) if tokens[k] != "\0"), None)
            if any(k is not None and not certain[k] for k in (before, after)):
                return True
    return False


def repeats(rows):
    """page -> number of words under strings of eight tokens that stand in pages of its host with different titles."""
    streams, titles = [], defaultdict(set)
    for _, url, html in rows:
        title, found = blocks(html or "")
        inner, sure = [], []
        for b in found:
            sure += [True] * bool(inner) + [b.verdict == ARTICLE] * len(b.text.split(" "))
            inner += ["\0"] * bool(inner) + b.text.split(" ")
        name = (url or "").split("://")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else ""
        tokens = ["\0"] * 7 + inner + ["\0"] * 7 if found else []
        certain = [True] * 7 + sure + [True] * 7
        starts = [i for i in range(len(tokens) - 7) if any(t != "\0" and not c for t, c in zip(tokens[i : i + 8], certain[i : i + 8], strict=True)) or lone(tokens, certain, i)]
        streams.append((name, tokens, starts))
        for i in starts:
            titles[name, tuple(tokens[i : i + 8])].add(title or " ".join(inner))
    out = []
    for name, tokens, starts in streams:
        under = {j for i in starts if name and len(titles[name, tuple(tokens[i : i + 8])]) > 1 for j in range(i, i + 8) if tokens[j] != "\0"}
        out.append((sum(t != "\0" for t in tokens), len(under)))
    return out


@pytest.mark.parametrize("size", [12_000_000, 2_000, 300])
def test_op12(spark, tmp_path, monkeypatch, size):
    """The same result whether a host is one block or many."""
    rows, want = site()
    monkeypatch.setattr(html_extraction, "BLOCK_BYTES", size)
    monkeypatch.setattr(html_extraction, "LIST_BYTES", 20_000)
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op12_host_suffix_array"](spark, str(tmp_path)).collect()
    assert by_row([r[:4] for r in got]) == by_row([(i, u, want[i], len(want[i])) for i, u, _ in rows])
    assert by_row([(r["page_id"], r["n_words"], r["n_repeated"]) for r in got]) == by_row([(i, *r) for (i, *_), r in zip(rows, repeats(rows), strict=True)])


def test_op12_of_given_pages(spark):
    """The article of every page of the smallest table, by a reader that knows how these pages are made."""
    import html as references
    import re

    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in QUERIES["op12_host_suffix_array"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    for r in rows:
        parts = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", r["html"], re.S)[1])
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(references.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts) if x)
    assert len(got) == len(rows)


def test_awkward_columns(spark):
    rows = [(1, "http://a.example/", "<p>x", "q", 1), (2, None, None, None, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string, Text int")
    got = html_extraction.extract(pages)
    assert got.columns == ["page_id", "url", "a.b", "text", "n_words", "n_repeated"]
    assert by_row([(r["page_id"], r["a.b"], r["text"]) for r in got.collect()]) == by_row([(1, "q", "x"), (2, None, "")])
    assert html_extraction.extract(pages.limit(0)).count() == 0
