"""Pages that leave out </head> and <body> keep their text."""

import pytest

from siltstone.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>a<p>b", "a\n\nb"),
        ("<head><meta charset=utf-8><link rel=x><style>s</style><script>no()</script><base><div>a</div>", "a"),
        ("<head>\n <title>T</title>\n <h1>a</h1>", "a"),
        ("<head><title>T</title>a", "a"),
        ("<head><title>T</title>a<b>c</b> d</head> e", "ac d e"),
        ("<head><title>T</title><img src=x><a href=y>a</a>", "a"),
        ("<head><template><p>no</p></template><noscript><p>no</p></noscript><p>a", "a"),
        ("<head><head><title>T</title><p>a", "a"),
        ("<html><head><title>T</title></head><body>a", "a"),
        ("<html><head><title>T</title><body>a", "a"),
        ("<head> &#32; <title>T</title></head>a", "a"),
        ("<header>a</header>b", "a\nb"),
    ],
)
def test_head_ends(page, text):
    assert html_text.extract(page) == text
