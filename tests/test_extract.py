import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import extract as X
from tests import html_events

#: A post, and its blocks: type, level, speaker, text.
CASES = [
    ('<blockquote><p>"A line."<br>- Joane</p></blockquote>', [("quote", None, "Joane", "A line.")]),
    ('<blockquote><p>"Just a floating quote..."</p></blockquote>', [("quote", None, None, "Just a floating quote...")]),
    ("<style>p{x}</style><div>label</div><script>var a = '<p>no</p>';</script><p>Spoken.</p>", [("paragraph", None, None, "Spoken.")]),
    (
        "<ul><li>one<h3>Head</h3><blockquote>said</blockquote><ul><li>two</li><li>three <b>bold</b></li></ul>tail</li><li> </li><li>four.</li></ul>",
        [("list", None, None, "one Head said tail. two. three bold. four.")],
    ),
    ("<ul><li>one<ul><li>x</li></ul>tail</li></ul>", [("list", None, None, "onetail. x")]),  # a nested list leaves no gap in its item
    ("<blockquote><p>First part</p><p>second part</p></blockquote>", [("quote", None, None, "First part second part")]),
    ("<blockquote><p>“Quoted words”</p><p>— Élodie O’Neill-Smith</p></blockquote>", [("quote", None, "Élodie O’Neill-Smith", "Quoted words")]),
    ("<blockquote>Choose courage — Always</blockquote>", [("quote", None, None, "Choose courage — Always")]),
    ("<blockquote>said<br>~ Ann<br> </blockquote>", [("quote", None, "Ann", "said")]),
    ("<blockquote>x<br>- Ann, Bob</blockquote>", [("quote", None, None, "x - Ann, Bob")]),
    ("<blockquote><p>— Ann</p></blockquote>", []),
    (
        '<section><div><p>kept</p></div></section><div class="x kg-card y"><p>card</p></div><figure><p>fig</p></figure><p>also</p>',
        [("paragraph", None, None, "kept"), ("paragraph", None, None, "also")],
    ),
    ("<p>open <b>bold <p>inner</p> more</article> tail</p><h2>Two <br/> lines</h2>", [("paragraph", None, None, "open bold inner more tail"), ("heading", 2, None, "Two lines")]),
    (
        "<h1>A &amp; B &copy; &#233; &#xe9; &nosuch; & &apos;&#146;</h1><p title='a > b'>x<!-- gone <p>no</p> -->y</p>",
        [("heading", 1, None, "A & B © é é &nosuch; & '’"), ("paragraph", None, None, "xy")],
    ),
    ("<ol><li>a<li>b<ol><li>c</ol></ol><p></p><h5>never</h5><p> </p>", [("list", None, None, "a b. b. c")]),
    ("<p>1 < 2 and 3 > 2</p><aside><p>no</p></aside><p>one<br><br>two</p>", [("paragraph", None, None, "1 < 2 and 3 > 2"), ("paragraph", None, None, "one two")]),
    ("", []),
    ("no tags at all", []),
    ("<p>never closed", [("paragraph", None, None, "never closed")]),
    ("</p></div><p>stray closes</p></ul>", [("paragraph", None, None, "stray closes")]),
]
HTMLS = [html for html, _ in CASES]


def got(spark, htmls):
    pages = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    rows = X.extract_blocks(pages).orderBy("doc_id", "pos").collect()
    out = [[] for _ in htmls]
    for r in rows:
        assert r.pos == len(out[r.doc_id])
        out[r.doc_id].append((r.type, r.level, r.speaker, r.text))
    return out


def test_cases(spark):
    for (html, blocks), mine in zip(CASES, got(spark, HTMLS)):
        assert mine == blocks, html


def plain(rows):
    """Without speakers, and quotes left out."""
    return [(kind, level, text) for kind, level, *_, text in rows if kind != "quote"]


def test_pages_equal_the_parser_events(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for html, mine in zip(pages + HTMLS, got(spark, pages + HTMLS)):
        assert plain(mine) == plain(html_events.blocks(html)), html


def test_paths_equal_the_parser_events(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    htmls = [h for h in pages + HTMLS if "<script" not in h and "<style" not in h]  # their own text is no text run
    rows = X.open_paths(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")).orderBy("doc_id", "seg").collect()
    mine = {i: [] for i in range(len(htmls))}
    for r in rows:
        path, text, own = [e.name for e in r.path], r.txt, mine[r.doc_id]
        if own and own[-1][0] == path:
            text = own.pop()[1] + text
        own.append((path, text))
    for i, html in enumerate(htmls):
        assert mine[i] == html_events.Blocks(html).paths, html


PIECES = "<p> </p> <div> </div> <ul> </ul> <li> </li> <ol> <h2> </h2> <br> <b> </b> <nav> </nav> <h5> <section/> a b. &amp; x".split()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=4, max_size=12))
def test_any_nesting_equals_the_parser_events(spark, htmls):
    for html, mine in zip(htmls, got(spark, htmls)):
        assert plain(mine) == html_events.blocks(html), html


def test_long_pages_are_folded_in_slices(spark):
    html = "<div>" + "".join(f"<p>Number {i}<b> bold</b></p>" for i in range(1500)) + "</div>"
    assert got(spark, [html])[0] == [("paragraph", None, None, f"Number {i} bold") for i in range(1500)]


def test_separate_block_operators_agree_with_the_composition(spark):
    pages = spark.createDataFrame(list(enumerate(HTMLS)), "page_id long, html string")
    items = X.visible_items(pages)
    texts = X.block_texts(items)
    whole = X.extract_blocks(pages)
    for kind, rows in (("heading", X.heading_blocks(texts)), ("paragraph", X.paragraph_blocks(texts)), ("quote", X.quote_blocks(texts)), ("list", X.list_blocks(items))):
        a = sorted((r.doc_id, r.text) for r in rows.collect())
        assert a == sorted((r.doc_id, r.text) for r in whole.filter(F.col("type") == kind).collect())
    missing = {r.doc_id for r in X.documents_without_blocks(pages, whole).collect()}
    assert missing == {i for i, (_, blocks) in enumerate(CASES) if not blocks}


def test_empty_documents_are_split_off(spark):
    pages = spark.createDataFrame([(1, "  \n"), (2, None), (3, "<p>x</p>"), (4, "")], "page_id long, html string")
    ok, rejected = X.split_empty_documents(pages)
    assert [r.page_id for r in ok.collect()] == [3]
    assert {r.page_id for r in rejected.collect()} == {1, 2, 4}


@pytest.mark.parametrize("name, ok", [("Élodie O’Neill-Smith", True), ("A", True), ("", False), ("-A", False), ("Ann, Bob", False), ("x" * 80, True), ("x" * 81, False), ("Ann\n", False), ("J. R. Tolk'n", True), ("4you", False)])
def test_speaker_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(T.is_speaker_name(F.col("n"))).first()[0] is ok
