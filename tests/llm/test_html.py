"""Main text of pages: lists of links of any length, comments by their structure, texts that change length with case, rows of every kind."""

import pytest

from laddersmith.llm import html_text

P = "<p>" + "words of an article that go on and on, " * 12 + "</p>"


def test_ends_of_scripts_are_found_where_they_stand():
    """A letter whose lower case is longer moves no place."""
    for n in (1, 20, 400):
        page = "<body><p>" + "İ" * n + "</p><script>var a = '<p>not this';</SCRIPT ><article>" + P * 3 + "</article><article><p>after all</p>" + P + "</article></body>"
        got = html_text.extract(page)
        assert got.count("words of an article") == 48 and "after all" in got and "not this" not in got


def test_a_raw_element_ends_at_its_own_end_tag_alone():
    assert html_text.extract("<body><script>'</scripted><p>no</p>'</script><p>yes it is</p></body>") == "yes it is"
    assert html_text.extract("<body><p>yes it is</p><style>p {} </STYLE") == "yes it is"
    assert html_text.extract("<body><p>yes it is</p><script>never ends <p>no</p>") == "yes it is"


@pytest.mark.parametrize("n", [1, 2, 12, 20, 50, 200])
@pytest.mark.parametrize("page", ["%s<article>@</article>", "%s<div>@</div>", "<div>@</div>%s", "%s@", "@%s", "<div>%s</div><section>@</section>"])
def test_link_lists_of_any_length(n, page):
    links = "<ul>" + "".join(f"<li><a href='/{i}'>link number {i} somewhere</a></li>" for i in range(n)) + "</ul>"
    got = html_text.extract("<html><body>" + (page % links).replace("@", P * 3) + "</body></html>")
    assert "link number" not in got and got.count("words of an article") == 36


RECORDS = "<div class='c'><b>Anna</b> liked it a lot</div><div class='c'><b>Bo</b> liked it not</div>"


@pytest.mark.parametrize("name", ["class='reader-comments'", "id='article-comments'", "class='user-reviews'", "class='thread'", "id='discussion'", "class='x thread-2'"])
@pytest.mark.parametrize("inner", [RECORDS, "<ul><li>liked it a lot</li><li>liked it not</li></ul>", f"<h2>What readers say</h2><div>{RECORDS}</div>"])
def test_comments_by_name_and_structure(name, inner):
    got = html_text.extract(f"<body><main><h1>Title</h1>{P * 3}<div {name}>{inner}</div></main></body>")
    assert "liked" not in got and got.startswith("Title words of") and got.count("words of an article") == 36


@pytest.mark.parametrize("name", ["id='discussion'", "class='review'", "class='history-of-comments-in-law'", "class='user-feedback'", "class='popular'", "class='success-stories'"])
def test_an_articles_own_words_stay(name):
    got = html_text.extract(f"<body><main><h1>Title</h1>{P}<section {name}><h2>More on it</h2><p>a paper's own words</p>{P}</section></main></body>")
    assert "More on it a paper's own words" in got and got.count("words of an article") == 24


def test_teasers_and_disclaimers_go():
    links = "<h3>Read</h3>" + "".join(f"<div class='t'><a href='/{i}'>another story {i}</a></div>" for i in range(4))
    got = html_text.extract(f"<body><main>{P * 2}<div class='top-stories'>{links}</div><div class='disclaimer'>no warranty</div></main></body>")
    assert "another story" not in got and "warranty" not in got


def _density_by_definition(node, share):
    """The composite density of a node, counted anew from its own subtree."""
    import math

    c = t = lc = lt = 0
    todo = [(k, False) for k in node.kids]
    while todo:
        k, in_link = todo.pop()
        if isinstance(k, str):
            n = len(" ".join(k.split()))
            c, lc = c + n, lc + (n if in_link else 0)
        elif not k.drop:
            t, lt = t + 1, lt + (k.tag == "a")
            todo += [(x, in_link or k.tag == "a") for x in k.kids]
    if not c:
        return 0.0, c, lc
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    x = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)
    return c / max(t, 1) * (max(0.0, math.log(x) / math.log(base)) if base > 1 else 1.0), c, lc


def test_densities_by_brute_force():
    page = f"<body><div><a href=x>one link</a> and text {P}</div><ul><li><a href=y>two</a></li><li>three</li></ul><div>{P}<div>{P}<i>in</i></div></div></body>"
    root = html_text.parse(page)
    html_text._measure(root)
    nodes = list(html_text._walk(root))
    _, c, lc = _density_by_definition(root, 0)
    for x in nodes:
        assert x.density == pytest.approx(_density_by_definition(x, lc / c)[0], rel=1e-12)
    best = max(nodes, key=lambda x: sum(k.density for k in x.kids if not isinstance(k, str)) if any(not isinstance(k, str) for k in x.kids) else x.density)
    assert root.most.total == pytest.approx(best.total)


def test_rows_of_every_kind(spark):
    """Nulls, empty and very long pages, repeated rows, extra columns with clashing names, an empty table."""
    long = "<body><article>" + P * 4000 + "</article></body>"
    rows = [(1, "u", None, "x", 5), (1, "u", "", "x", 5), (None, None, "<p>a b</p>", None, None), (2, "v", long, "y", 1), (2, "v", long, "y", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_text.extract_pages(df).collect()), key=str)
    n = len(html_text.extract(long))
    assert n == 4000 * len(html_text.extract(P)) + 3999
    assert got == sorted([(1, "u", 0), (1, "u", 0), (None, None, 3), (2, "v", n), (2, "v", n)], key=str)
    assert html_text.extract_pages(df.where("page_id > 5")).count() == 0
