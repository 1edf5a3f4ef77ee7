"""Stray quotes, spans, list numbers, style rules and closed details."""

import pytest

from siltstone.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p class=a">hello</p><p>world "q" end</p>', 'hello\n\nworld "q" end'),
        ("<a href=x'>it's</a> here", "it's here"),
        ('<p title="a > b">x</p>', "x"),
        ('<p title="never closed>x</p>y', "x\n\ny"),
        ("<p title = 'a>b' class=c>x", "x"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<table><tr><td colspan=2 rowspan=2>ab<td>x<tr><td>y</table>", "ab  | x\n |  | y"),
        ("<ol start=4><li>a<li>b<li value=9>c<li>d</ol>", "4. a\n5. b\n9. c\n10. d"),
        ("<ol><li>a<li hidden>b<li>c</ol>", "1. a\n2. c"),
        ("<style>.h{display:none} #i, b.k { visibility : hidden }</style><p class='x h'>no</p><p id=i>no</p><b class=k>no</b><b>yes</b>", "yes"),
        ("<style>.h{display:none} p.h{display:block}</style><p class=h>yes</p><div class=h>no</div>", "yes"),
        ("<style>.h{display:none !important}</style><p class=h style='display:block'>no</p>a", "a"),
        ("<style>/* .a{display:none} */ @media print {.a{display:none}} .b:hover{display:none} div .c{display:none}</style><p class=a>1<p class=b>2<p class=c>3", "1\n\n2\n\n3"),
        ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no</div>", "yes"),
        ("<details><summary>s</summary><p>no</p></details>a", "s\na"),
        ("<details open><summary>s</summary><p>yes</p></details>", "s\n\nyes"),
        ("<details>no</details><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<p style='display:none;display:inline'>yes", "yes"),
    ],
)
def test_rules(page, text):
    assert html_text.extract(page) == text


def test_tables_of_any_kind(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", "<p>a", "x", 9)] * 3 + [(None, None, None, None, None), (2, "v", "", "y", 1), (3, "w", "<b>" * 20000 + "deep", "", 0)]
    found = sorted(map(str, ((r.page_id, r.text, r.n_chars, r.n_lines) for r in html_text.extract_pages(spark.createDataFrame(rows, schema)).collect())))
    assert found == sorted(map(str, [(1, "a", 1, 1)] * 3 + [(None, "", 0, 0), (2, "", 0, 0), (3, "deep", 4, 1)]))


def test_comments_that_end_at_once():
    assert html_text.extract("<!-->hello<p>x</p><!-- c -->y") == "hello\n\nx\n\ny"
    assert html_text.extract("<!--->a<!----->b<!-- c --!>d<!-- > e -->f<!-- never closed") == "abdf"
