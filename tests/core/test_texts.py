import re

from pyspark.sql import functions as F

from tapewright.operators import templates, texts


def test_chunks_cover_the_text_and_end():
    text = ("A sentence here. " * 300 + "\n\n") * 3
    for size, overlap in ((1500, 200), (100, 20), (10, 9)):
        places = templates.chunk_places(text, size, overlap, 5)
        assert places[0][0] == 0 and places[-1][1] == len(text)
        assert all(b[0] <= a[1] and b[1] > a[1] and b[0] > a[0] for a, b in zip(places, places[1:], strict=False))
        assert all(b - a <= size for a, b in places)
    assert templates.chunk_places("") == []


def test_planted_sentences(spark):
    rows = [
        (1, "After 3 consecutive down days buy the open. Nothing else.\nAfter 3 red days buy again"),
        (2, "It gaps up by 3% on news! It GAPS UP 3 percent. gap down 99%. Full stops cut 2.5% in two"),
        (3, "Stocks within 5% of the 52-week low bounce. After 30 down days nothing"),
        (4, None),
        (5, "short"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["condition"], r["value"], r["place"]) for r in texts.extract_conditions(docs).collect()}
    assert got == {(1, "consecutive_down", 3.0, 0), (2, "gap_up", 3.0, 0), (3, "near_52w_low", 5.0, 0)}
    assert templates.chunk_text(docs).where(F.col("doc_id") == 4).count() == 0


def test_every_pattern_needs_a_word_that_is_looked_for_first():
    """Without the optional groups and alternatives, each pattern still holds one of the words."""
    for pattern in [rule[1] for rule in texts.RULES] + [rule[0] for rule in texts.CANDLES]:
        plain = re.sub(r"\((?:\?:)?[^()]*(?:\([^()]*\)[^()]*)*\)\??", " ", pattern.replace("(?:day|session)s?", "days").replace(r"\s+", " "))
        assert any(word in plain for word in texts.NEEDED), pattern


def test_sentences_without_any_needed_word_are_not_searched(spark):
    docs = spark.createDataFrame([(1, "Nothing is said here at all. It FELL 3 SESSIONS in a row."), (2, "Nothing else is said."), (3, None)], "doc_id long, text string")
    out = texts.extract_conditions(docs)
    assert [(r["doc_id"], r["condition"], r["value"]) for r in out.collect()] == [(1, "consecutive_down", 3.0)]
    assert "contains" in out._jdf.queryExecution().optimizedPlan().toString().lower()
