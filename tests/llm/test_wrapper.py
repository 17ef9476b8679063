"""Wrapper induction: what the template decides, tree matching against brute force, pages of any depth and width."""

import functools
import json
import random

import pytest

from fragmill.llm import html_wrapper as hw


def extracted(spark, pages):
    df = spark.createDataFrame([(i, url, page, "clash") for i, (url, page) in enumerate(pages)], "page_id long, url string, html string, slots string")
    return {r["page_id"]: r["text"] for r in hw.main_text(df.repartition(3)).collect()}


def test_the_template_decides_inside_marked_articles(spark):
    make = lambda i: f"<body><nav><a href=/>x</a></nav><article><h1>Title {i}</h1><p>Story {i} goes on</p><p>Read our magazine every week</p><p>and ends {i * 7}</p></article></body>"
    got = extracted(spark, [("http://a.org/", make(i)) for i in range(9)] + [("http://few.org/", make(i)) for i in range(2)])
    for i in range(9):  # a line on each of nine pages is the template's
        assert got[i] == f"Title {i}\nStory {i} goes on\nand ends {i * 7}"
    for i in range(2):  # two pages show nothing of the kind
        assert got[9 + i] == f"Title {i}\nStory {i} goes on\nRead our magazine every week\nand ends {i * 7}"


def test_the_slots_choose_the_container(spark):
    """The article elements are teasers; the varying text stands elsewhere."""
    text = lambda i: " ".join(f"word{i * k % 97}" for k in range(60))
    make = lambda i: f"<body><div class='text'><p>{text(i)}</p></div><article>Teaser {i}</article></body>"
    got = extracted(spark, [("http://b.org/", make(i)) for i in range(1, 7)])
    assert all(text(i) in got[i - 1] for i in range(1, 7))


def test_whole_words_of_classes_and_only_furniture(spark):
    page = "<article><h1>T</h1><p class='related work'>one</p><div class='share-price'>two</div><table class='side-effects'><tr><td>three</table><p class='search'>four</p><p>five</p></article>"
    links = "".join(f"<a href='/{k}'>Link number {k}</a> " for k in range(5))
    listed = page.replace("<p>five</p>", f"<div class='related'>{links}</div><p>five</p>")
    got = extracted(spark, [("http://c.org/", page), ("http://d.org/", listed)])
    assert got == {0: "T\none\ntwo\nthree\nfour\nfive", 1: "T\none\ntwo\nthree\nfour\nfive"}


def test_two_layouts_of_a_host(spark):
    one = lambda i: f"<body><div>Site name</div><div><p>Story {i} begins</p><p>and ends {i * 7}</p></div><div>Contact us</div></body>"
    two = lambda i: f"<body><table><tr><td>Old site</td><td><ul><li>Note {i}</li><li>more {i * 3}</li></ul></td></tr></table><section><pre>line {i}</pre><pre>Call us</pre></section></body>"
    got = extracted(spark, [("http://e.org/", one(i)) for i in range(9)] + [("http://e.org/", two(i)) for i in range(7)])
    assert all(got[i] == f"Story {i} begins\nand ends {i * 7}" for i in range(9))
    assert all(got[9 + i] == f"Note {i}\nmore {i * 3}\nline {i}" for i in range(7))


def test_copies_keep_their_text(spark):
    page = "<article><h1>Same</h1><p>text</p></article>"
    assert set(extracted(spark, [(f"http://f.org/{i}", page) for i in range(12)]).values()) == {"Same\ntext"}


def brute_match(x, y):
    """Size of the largest common ordered tree of equal labels that holds both roots."""
    if x[0] != y[0]:
        return 0

    @functools.lru_cache(None)
    def best(i, j):
        if i == len(x) or j == len(y):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute_match(x[i], y[j]) + best(i + 1, j + 1))

    return 1 + best(1, 1)


def test_alignment_equals_brute_force():
    rng = random.Random(3)

    def tree(deep):
        return [rng.choice("ab"), *(tree(deep - 1) for _ in range(rng.randint(0, 3) if deep else 0))]

    def flat(t, parent=-1, out=None):
        out = [] if out is None else out
        out.append((t[0], parent))
        me = len(out) - 1
        for c in t[1:]:
            flat(c, me, out)
        return out

    for _ in range(150):
        a, b = tree(3), tree(3)
        at = hw.align(json.dumps(a).replace(" ", ""), json.dumps(b).replace(" ", ""))
        fa, fb = flat(a), flat(b)
        assert len(at) == len(fb) and sum(p >= 0 for p in at) == brute_match(a, b)
        used = [p for p in at if p >= 0]
        assert used == sorted(set(used))  # one to one, in order
        for q, p in enumerate(at):
            if p >= 0:
                assert fa[p][0] == fb[q][0] and (q == 0 or at[fb[q][1]] == fa[p][1])  # labels and parents agree


@pytest.mark.parametrize("n", [59, 61, 400])
def test_no_depth_or_width_is_cut(n):
    deep = "<div>" * n + "<p>in the middle</p>" + "</div>" * n
    wide = "".join(f"<section class='c{chr(97 + k % 26)}{chr(97 + k // 26)}'><p>part {k}</p></section>" for k in range(n))
    assert hw.extract(deep, None) == "in the middle"
    assert hw.extract(wide, None) == "\n".join(f"part {k}" for k in range(n))
    shape = hw.fold([hw.parse(wide)], "#root")
    assert len(shape.children) == n and hw.align(shape.text, shape.text) == tuple(range(2 * n + 1))


def test_very_long_and_very_deep_pages():
    assert hw.extract("<div>" * 5000 + "x<b>y" + "</div>" * 5000 + "z", None).split() == ["xy", "z"]
    many = "".join(f"<p>{k}</p>" for k in range(50_000))
    assert hw.extract(f"<article>{many}</article>", None).count("\n") == 49_999
