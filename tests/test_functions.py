"""Truth tables of the scalar operators (names invented)."""
import datetime as dt
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ownerlens.functions import dates as D, holdings as H, scoring as S, text as T

c = F.col


def test_feed_dates(value):
    ts = dt.datetime(2024, 1, 5, 10, 20, 30)
    cases = [
        ("2024-01-05T10:20:30", ts), ("2024-01-05 10:20:30", ts), ("2024-01-05T10:20:30Z", ts), ("2024-01-05T10:20:30.123Z", ts),
        ("2024-01-05 10:20:30.5", ts), ("2024-01-05T10:20:30.5+01:00", ts), ("2024-01-05T10:20:30+01:00", None),
        ("Fri, 05 Jan 2024 10:20:30 +0100", ts), ("Fri, 5 Jan 2024 10:20:30 GMT", ts), ("05 Jan 2024 10:20:30 -0500", ts),
        ("09/08/2026", None), ("yesterday", None), ("", None), ("   ", None), (None, None), ("Fri, 45 Jan 2024 10:20:30", None),
    ]
    got = value(D.parse_feed_date(c("x")), [(x,) for x, _ in cases], "x string")
    assert got == [want for _, want in cases]


@pytest.mark.parametrize("title, source, stub", [
    ("Lagoon Register - Lagoon Register", "Lagoon Register", True), ("LAGOON REGISTER", "Lagoon Register", True),
    ("Contact  Us", None, True), ("Home | Hill Post", "Hill Post", True), ("Hill Post Home – Hill Post", "Hill Post", True),
    ("", "Hill Post", True), (None, None, True), ("  Home", None, True), ("Home sales rise in Lagoon", "Hill Post", False),
    ("Beneficial ownership register opened", "Hill Post", False), ("Hill Post wins award", "Hill Post", False),
    ("New register - Hill Post", "Hill Post", False),
])
def test_navigation_stub(value, title, source, stub):
    assert value(T.is_navigation_stub(c("t"), c("s")), [(title, source)], "t string, s string") == [stub]


@pytest.mark.parametrize("title, summary, topic", [
    ("Lagoon FC beat Hill FC", None, "sport"), ("Striker joins on transfer window deadline", None, "sport"),
    ("Singer drops album", None, "entertainment"), ("Quiet afternoon", "the football team won", "sport"),
    ("Hill draw with Lagoon 2-2", None, "sport"), ("Shares range 2-2 today", None, None),
    ("Holding company acquires 60% of football club", None, None), ("Acquisition of a football team", None, "sport"),
    ("Tycoon acquired 30 per cent of football team", None, None), ("Golfview Estates opens", None, None),
    ("FCMB posts results", None, None), ("Fixture maker expands", None, None), (None, None, None), ("", " ", None),
    ("éfc fcé", None, None), ("The striker’s fc", None, "sport"),
])
def test_off_topic(value, title, summary, topic):
    got = value(S.off_topic(c("t"), c("s")), [(title, summary)], "t string, s string")[0]
    assert (got["topic"] if got else None) == topic


def test_off_topic_reports_longest_terms(value):
    got = value(S.off_topic(c("t"), F.lit(None).cast("string")), [("the football club lost 1-0",)], "t string")[0]
    assert got["matched"] == ["football club", "scoreline"]


@pytest.mark.parametrize("stake, band", [
    ("100", "BAND_75_100"), ("75%", "BAND_75_100"), ("63.2%", "BAND_50_75"), ("50", "BAND_50_75"), (" 28.5% ", "BAND_25_50"),
    ("25", "BAND_25_50"), ("24.99", "BAND_5_25"), ("5", "BAND_5_25"), ("4.99", "BELOW_THRESHOLD"), ("0", "BELOW_THRESHOLD"),
    ("", ""), (None, ""), ("N/A", ""), ("unknown", ""), ("nan", ""), ("1e1%", "BAND_5_25"), ("10d", ""),
])
def test_share_band(value, stake, band):
    assert value(H.share_band(c("x")), [(stake,)], "x string") == [band]


def test_sentiment_needs_a_margin(value):
    rows = [("growth",), ("growth and success",), ("fraud",), ("fraud and loss",), ("the issue pursued",), ("",), (None,)]
    assert value(S.sentiment(c("x")), rows, "x string") == ["Neutral", "Positive", "Neutral", "Negative", "Negative", "Neutral", "Neutral"]


def test_risk_tiers(value):
    rows = [("charged with fraud",), ("lawsuits filed",), ("two fines",), ("defined",), ("promotion",), (None,)]
    assert value(S.risk_level(c("x")), rows, "x string") == ["Critical", "High", "Medium", "Low", "Low", "Low"]


def test_category(value):
    rows = [("ministry and senate",), ("shares and revenue",), ("court trial",), ("the chairman spoke",), ("nothing",), ("",)]
    assert value(S.category(c("x")), rows, "x string") == ["Government", "Company", "Legal", "Person", "General", "General"]


def test_language(value):
    rows = [("the cat sat on the mat",), ("le chat est sur la table verte",), ("123 !!",), ("",), (None,)]
    assert value(S.detect_language(c("x")), rows, "x string") == ["en", "other", "unknown", "unknown", "unknown"]


def test_summaries(value):
    text = "First one. Second in 2024! Third? Fourth today. Fifth. Sixth."
    got = value(S.summaries(c("t"), c("x")), [("T", text), ("T", "")], "t string, x string")
    assert got[0]["one_line"] == "First one." and got[0]["executive"] == "First one. Second in 2024!"
    assert got[0]["detailed"].endswith("Fifth.") and got[0]["timeline"] == " \n- Second in 2024! \n- Fourth today."
    assert got[1].asDict() == {"one_line": "T", "executive": "", "detailed": "", "timeline": ""}


def test_clean_html(value):
    page = "<html><style>p{}</style><script>x('</p>')</script><p>One  two</p>\n<!-- no --><p>R&amp;D &#233;&#x20AC; &lt;b&gt;</p>"
    assert value(T.clean_html(c("x")), [(page,), ("",), (None,)], "x string") == ["One\ntwo\nR&D é€ <b>", "", ""]


def test_article_body_grows_linearly(value):
    text = "This paragraph is certainly long enough to be kept number {}."
    pages = ["".join(f"<p>{text.format(i)}" for i in range(n)) for n in (5, 50)]
    closed = "<nav><p>" + text + "</p></nav>" + "".join(f"<p>{text.format(i)}</p>" for i in range(5)) + "<p>short</p>"
    bodies = value(T.article_body(c("x")), [(pages[0],), (pages[1],), (closed,)], "x string")
    assert [len(b.split("\n")) for b in bodies] == [5, 50, 5]
    assert bodies[0] == bodies[2]


def test_json_block(value):
    rows = [('x ```json {"a": 1} ``` y',), ('{"a": 1}',), ('sure: {"a": 1} ok',), ("none",), (None,)]
    assert value(T.json_block(c("x")), rows, "x string") == ['{"a": 1}', '{"a": 1}', '{"a": 1}', "none", None]


def test_names(value):
    rows = [("  First HoldCo  Plc. ",), ("A & B",), ("Ärger Çedilla",), ("---",), (None,)]
    assert value(T.slugify(c("x")), rows, "x string") == ["first-holdco-plc", "a-and-b", "arger-cedilla", "", ""]
    assert value(T.node_id(c("x")), [(" Hill Bank",), ("hill bank ",)], "x string")[0] == value(T.node_id(c("x")), [("HILL BANK",)], "x string")[0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_slug_is_idempotent(names):
    from ownerlens.session import local_session

    spark = local_session("4", 4, "tests")
    df = spark.createDataFrame([(n,) for n in names], "x string").select(T.slugify(c("x")).alias("s"))
    assert all(r["s"] == r["t"] for r in df.select("s", T.slugify(c("s")).alias("t")).collect())


def test_publications(value):
    rows = [("The Guardian",), (" Latest  News ",), ("",), (None,), ("The National Bank",), ("Hill Bank",), ("SEC",)]
    assert value(T.is_publication_or_furniture(c("x")), rows, "x string") == [True, True, True, True, True, False, False]


def test_whole_ids(value):
    rows = [("5.0",), ("5",), (" 7 ",), ("5.5",), ("x",), ("",), (None,), ("nan",)]
    assert value(T.whole_id(c("x")), rows, "x string") == [5, 5, 7, 0, 0, 0, 0, 0]


def test_one_decimal_follows_the_binary_value(value):
    numbers = [45.05, 0.25, 0.75, 24.8, 0.0, 99.95, -0.04, 12.349999, 53 * 0.85]
    assert value(T.fixed1(c("x")), [(n,) for n in numbers], "x double") == [f"{n:.1f}".replace("-0.0", "0.0") for n in numbers]


def test_csv_guard(value):
    rows = [("=1+1",), ("@x",), ("plain",), (None,), ("\tx",)]
    assert value(T.csv_guard(c("x")), rows, "x string") == ["'=1+1", "'@x", "plain", "", "'\tx"]


def test_all_named_references(value):
    rows = [("&aacute;&Eacute; &euml;&igrave;&#233;&#xE9;",), ("&amp;lt; &nosuch; &lt;b&gt; a & b &copy",), (None,), ("&NotEqualTilde;&fjlig;",)]
    assert value(T.decode_entities(F.col("x")), rows, "x string") == ["áÉ ëìéé", "&lt; &nosuch; <b> a & b &copy", None, "≂̸fj"]


def test_literals_are_counted_one_by_one(value):
    terms = ["sue", "fine", "success", "loss", "record profit"]
    texts = ["sue successuccess pursued", "fine  finefine losslosss", "record profit record  profit", "", None]
    assert value(T.count_substrings(c("t"), terms), [(t,) for t in texts], "t string") == [None if t is None else sum(t.count(x) for x in terms) for t in texts]


def test_strip_looks_at_both_ends(value):
    texts = ["", " ", "a", " a", "a　", "  a b \t", "é", None]
    assert value(T.strip(c("t")), [(t,) for t in texts], "t string") == [None if t is None else t.strip() for t in texts]


def test_phrases_end_at_line_ends_and_pairs_of_spaces(value):
    texts = ["a\r\nb\rc\nd  e   f", "  a \r\r\n\n b    ", "a b", "x\r \ry"]
    assert value(T.clean_html(c("t")), [(t,) for t in texts], "t string") == [
        "\n".join(p.strip() for p in re.split(r"\r\n|\r|\n|  ", t) if p.strip()) for t in texts]


def test_whole_words_need_their_borders(value):
    texts = ["a fine", "fines, refine", "éfine", "tax dispute", "tax disputed", "_fine", "offine fine"]
    got = value(T.has_word(c("t"), ["fine", "tax dispute"], plural=True), [(t,) for t in texts], "t string")
    assert got == [bool(re.search(r"(?<!\w)(?:fine|tax dispute)s?(?!\w)", t)) for t in texts] == [True, True, False, True, False, False, True]


def test_named_summaries_alone(value):
    got = value(S.summaries(c("t"), c("x"), "executive"), [("T", "One. Two today. Three.")], "t string, x string")
    assert [r.asDict() for r in got] == [{"executive": "One. Two today."}]
