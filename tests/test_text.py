import html
import re

from pyspark.sql import functions as F

from brimfold.functions import keys, text, urls


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_plain_text():
    assert text.plain_text(None) == "" and text.plain_text("") == ""
    assert text.plain_text("<p>Hello&nbsp;&amp; <b>bye</b></p><ul><li>one</li><li>two</li></ul>") == "Hello & bye\n\none\n\ntwo"
    assert text.plain_text("&lt;p&gt;a&lt;/p&gt;") == "a"
    assert text.plain_text("a < b<!-- no -->") == "a < b"
    assert text.plain_text("x" * 3_000_000) == "x" * 3_000_000


def test_both_html_readers_agree(spark):
    values = ["<p>a&nbsp;b</p>", "<div>x<br/>y</div>\n\n\n<p>z</p>", None, "", "plain", "&#8211; &auml;&quot;", "<strong>q</strong> 1 < 2"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [tuple(r) for r in df.select(text.markup_to_text(F.col("v"))).collect()] == [tuple(r) for r in df.select(text.html_to_text(F.coalesce("v", F.lit("")))).collect()]


def test_normalising(spark):
    assert one(spark, text.normalize_text(F.col("v")), v="  Große R&D, (C++/C#)  Straße! ") == "grosse r and d c++/c# strasse"
    assert one(spark, text.normalize_text(F.col("v")), v=None) == ""
    assert one(spark, text.normalize_title(F.col("v")), v="Security Engineer (m/w/d) - ") == "security engineer"
    assert one(spark, text.normalize_company(F.col("v")), v="Äcme GmbH & Co") == "äcme and co"
    assert one(spark, text.normalize_company(F.col("v")), v="Züse Wagner AG.") == "züse wagner"


def test_sentences_and_aliases(spark):
    assert one(spark, text.sentences(F.col("v")), v="One. Two! three; four\n• five\r\n\r\n six?") == ["One.", "Two!", "three", "four", "five", "six?"]
    assert one(spark, text.sentences(F.col("v")), v=None) == []
    assert one(spark, text.has_alias(F.col("v"), "go"), v="we go far") and not one(spark, text.has_alias(F.col("v"), "go"), v="good")
    assert one(spark, text.has_alias(F.col("v"), "rust"), v="trusted")
    assert one(spark, text.contains_any(F.col("v"), ["c++", "a.b"]), v="uses c++") and not one(spark, text.contains_any(F.col("v"), ["a.b"]), v="axb")
    assert one(spark, text.contains_any(F.col("v"), []), v="x") is False and one(spark, text.contains_any(F.col("v"), ["x"]), v=None) is False
    assert [tuple(x) for x in one(spark, text.year_ranges(F.col("v")), v="3-5 years, 2+ yrs und 7 Jahren")] == [(3, 5), (2, None), (7, None)]
    assert one(spark, text.count_of(F.col("v"), "aa"), v="aaaaa") == 2
    assert one(spark, text.excerpt(F.col("v"), 5), v="ab  cdefgh") == "ab c…"
    assert one(spark, text.markdown_cell(F.col("v")), v=" a|b\nc ") == "a\\|b c"


def test_urls(spark):
    url = lambda v: one(spark, urls.canonical_url(F.col("v")), v=v)
    assert url("HTTPS://Jobs.Example/a//b/?utm_source=x&id=7&ref=q#top") == "https://jobs.example/a/b?id=7"
    assert url("https://a.example/?source=1") == "https://a.example" and url(None) == "" and url("") == ""
    assert url("https://a.example/x?reference=1") == "https://a.example/x?reference=1"
    assert one(spark, urls.url_host(F.col("v")), v="https://A.example:8080/x") == "a.example:8080"
    assert one(spark, urls.redirect_target(F.col("v")), v="https://g.example/url?q=https%3A%2F%2Fb.example%2Fp&x=1") == "https://b.example/p"
    assert one(spark, urls.urls_in(F.col("v")), v='see https://a.example/x. and <a href="https://b.example/y">') == ["https://a.example/x", "https://b.example/y"]


def test_keys(spark):
    import hashlib

    assert one(spark, keys.digest(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"x|").hexdigest()
    assert one(spark, keys.stable_bucket(F.col("a"), 5), a="key") == int(hashlib.sha256(b"key").hexdigest()[:8], 16) % 5
    assert one(spark, keys.rate(F.lit(1), F.lit(0))) == 0.0 and one(spark, keys.rate(F.lit(1), F.lit(3))) == 33.3
    a, b = (one(spark, keys.posting_key(F.col("c"), F.col("t"), F.col("l")), c=c, t=t, l=p) for c, t, p in (("Acme GmbH", "Engineer (m/w/d)", "Berlin, Deutschland"), ("ACME", "engineer", "Berlin Germany")))
    assert a == b and re.fullmatch("[0-9a-f]{20}", a)


def test_entities_are_those_of_html():
    assert all(html.unescape(e).replace("\xa0", " ") == c for e, c in text.ENTITIES.items())


def test_functions_in_sql(spark):
    from brimfold.functions.register import register_functions

    assert register_functions(spark) == ["html_to_text", "normalize_text", "rate", "text_ratio"]
    got = spark.sql("SELECT normalize_text(html_to_text('<p>Große R&amp;D!</p>')), rate(1, 3), rate(1, 0), text_ratio('abcd', 'bcde'), text_ratio(NULL, NULL), normalize_text(NULL)").first()
    assert tuple(got) == ("grosse r and d", 33.3, 0.0, 0.75, 1.0, "")
