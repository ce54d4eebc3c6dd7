import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def arr(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_vectors(spark):
    assert one(spark, V.l2_normalize(arr(3, 4))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.l2_normalize(arr(0, 0))) == [0, 0]
    assert one(spark, V.truncate_and_normalize(arr(1, 0, 1, 0), 2)) == pytest.approx([1, 0])
    assert one(spark, V.dot(arr(1, 2), arr(3, 4))) == 11
    assert one(spark, V.l2_distance(arr(0, 0), arr(3, 4))) == 5
    assert one(spark, V.cosine(arr(0, 2), arr(0, 5))) == pytest.approx(1)
    assert one(spark, V.cosine(arr(0, 0), arr(0, 5))) is None
    q = one(spark, V.quantize_int8(arr(1, -0.5, 0)))
    assert q.codes == [127, -64, 0] and q.scale == pytest.approx(1 / 127)
    assert one(spark, V.let(F.lit(3), lambda x: x * x)) == 9


@pytest.mark.parametrize(("v", "dims"), [((), 2), ((1, 2), 0), ((1, 2), 3)])
def test_truncation_errors(spark, v, dims):
    from pyspark.errors import PySparkException

    a = F.array().cast("array<double>") if not v else arr(*v)
    with pytest.raises(PySparkException):
        one(spark, V.truncate_and_normalize(a, dims))


def test_vector_blobs():
    v = [0.1, -0.2, 0.3]
    assert V.bytes_to_floats(V.floats_to_bytes(v)) == pytest.approx(v, rel=1e-6)
    with pytest.raises(ValueError):
        V.bytes_to_floats(b"123")


def test_chunks():
    assert T.chunk_text("hello world", 100, 10) == [(0, "hello world", 0, 11)]
    assert T.chunk_text("", 100, 10) == [] == T.chunk_text("  \n", 100, 10) == T.chunk_text("abc", 0, 0) == T.chunk_text(None, 5, 1)
    c = T.chunk_text("word " * 100, 50, 10)
    assert len(c) > 1
    assert all(b[2] < a[3] and b[0] == a[0] + 1 for a, b in zip(c, c[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.text(" \nabé", max_size=120), st.integers(1, 30), st.integers(0, 40))
def test_chunks_cover_the_text(text, size, overlap):
    chunks = T.chunk_text(text, size, overlap)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    seen = set()
    for _, t, a, b in chunks:
        assert t == text[a:b] == t.strip() and 0 < b - a <= size
        seen |= set(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in seen)


def test_text_columns(spark):
    L = F.lit
    assert one(spark, T.ascii_lower(L("ÀB"))) == "Àb"
    assert one(spark, T.trim_unicode(L("　\xa0 a b \n"))) == "a b"
    assert one(spark, T.normalized_category(L("  "))) == "uncategorized"
    assert one(spark, T.normalized_category(L(None).cast("string"))) == "uncategorized"
    assert one(spark, T.glob_to_like(L("a_b/**/*.m?"))) == "a\\_b/%/%.m_"
    assert one(spark, T.query_tokens(L("tax 2024, (in-voice_1.0) !!"))) == ["tax", "2024", "in-voice_1.0"]
    assert one(spark, T.match_expression(L("a b!"))) == '"a"* OR "b"*'
    assert one(spark, T.trigrams(L("abcd"))) == ["abc", "bcd"]
    assert one(spark, T.trigrams(L("ab"))) == ["ab"]
    assert one(spark, T.query_prefix(L("nomic-embed-text"), L("q"))) == "search_query: q"
    assert one(spark, T.file_name(L("/a/b.c.md"))) == "b.c.md"
    assert one(spark, T.file_stem(L("/a/b.c.md"))) == "b.c"
    assert one(spark, T.file_stem(L("/a/.git"))) == ".git"
    assert one(spark, T.extension(L("/a/B.MD"))) == "md"
    m = one(spark, T.model_dims(L("a:b:512")))
    assert (m.model, m.dims) == ("a:b", 512)
    assert one(spark, T.scrub_latency(L("p50 12.5 ms, 3ms"))) == "p50 <ms>, <ms>"


def test_html():
    page = "<html><head><title>t</title><style>x{}</style></head><body><h1>A &amp; B</h1><script>var x</script><p>one   two<br>three</p></body></html>"
    assert T.html_text(page) == "A & B\none two\nthree"
    assert max(map(len, T.html_text("<p>" + "word " * 60, 30).split("\n"))) <= 30
    assert T.html_text("<div><p>unclosed <b>x") == "unclosed x"
    assert T.html_escape("<a&'>") == "&lt;a&amp;&#x27;&gt;"
    assert T.markdown_cell("a|b\nc") == "a\\|b c"


WORDS = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll generalizations oscillators deductions deductible documents invoice".split()


def test_stems_equal_the_full_text_engine():
    """The full-text extension of the standard library's SQLite names its terms."""
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text extension")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    for w in WORDS:
        c.execute("DELETE FROM f")
        c.execute("INSERT INTO f VALUES (?)", (w,))
        assert c.execute("SELECT term FROM v").fetchone()[0] == T.porter_stem(w), w


def test_index_terms():
    assert T.index_terms("Déjà-vu: The_Ponies 4.2") == ["deja", "vu", "the", "poni", "4", "2"]


def test_stems_in_sql_equal_those_in_python():
    import random

    import duckdb

    from docspark.plans.stem_sql import stem_ctes

    rng = random.Random(1)
    parts = "ing ed ly tion ness ful al ize ate er y e s ss ies at bl iz ll able ement ion run hop tax bil th an ou sky yy ay oy i ical ism ous logi eed".split()
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(3000)} | set(WORDS) | {"été", "naïveness", "ab1", "x", "is", "straßen"})
    c = duckdb.connect()
    c.execute("CREATE TABLE v (word VARCHAR)")
    c.execute("INSERT INTO v SELECT unnest(?)", [words])
    assert dict(c.execute(f"WITH {stem_ctes('v')} SELECT word, term FROM stemmed").fetchall()) == {w: T.index_term(w) for w in words}
