"""Visible text by small pages."""

import pytest
from pyspark.sql import functions as F

from clauselake.functions import html as H


def page(spark, source):
    df = spark.createDataFrame([(source,)], "html string").withColumn("p", H.read(F.col("html")))
    return df.select("p.*", H.visible_text(F.col("p")).alias("text"), H.main_text(F.col("p")).alias("of_main"), H.is_shell(F.col("p")).alias("shell")).first()


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p>One</p><p>Two&amp;three</p>", "One\nTwo&three"),
        ("<head><title>T</title></head><body>a<script>var x = '<p>no</p>'</script><style>p{}</style>b</body>", "ab"),
        ("a<div style='display: none'>secret <b>deep</b></div>b", "ab"),
        ("a<span hidden>x</span><span aria-hidden='true'>y</span><span aria-hidden='false'>z</span>", "az"),
        ("<p style='position:absolute;left:-9999px'>x</p><p style='opacity:0'>x</p><p style='opacity:0.5'>y</p><p style='font-size:0'>x</p>", "y"),
        ("a<!-- <p>no</p> -->b", "ab"),
        ("a<br>b<br/>c<hr>d", "a\nb\nc\nd"),
        ("<ul><li>one<li>two</ul>end", "one\ntwo\n\nend"),
        ("<div hidden>gone<p>gone too</div>stays", "stays"),
        ("a    b\t c", "a b c"),
        ("<p>unclosed", "unclosed"),
        ("</div>stray", "stray"),
        ("", ""),
        (None, ""),
    ],
)
def test_text(spark, source, text):
    assert page(spark, source).text == text


def test_main_and_counts(spark):
    long_ = "word " * 100
    r = page(spark, f"<body><nav>menu</nav><main>{long_}</main><article>short</article><!-- c --><script></script><p hidden>x</p></body>")
    assert r.of_main == long_.strip() and r.text.startswith("menu\n") and (r.hidden, r.markup, r.comments, r.scripts, r.shell) == (1, 1, 1, 1, False)
    assert page(spark, f"<main>skip</main><div>{long_}</div>").of_main.startswith("skip")
    assert page(spark, f"<div id='content'>{long_}</div>tail").of_main == long_.strip()
    assert page(spark, "<script src='app.js'></script><div id='root'></div>").shell
