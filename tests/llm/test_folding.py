"""Decontamination in the pipeline: leaks in capitals with accents and with Unicode punctuation."""

from trellisgraph.llm import decontaminate


def test_dropped_leaks_are_folded_by_unicode(spark):
    passage = "Élan déjà vu à l'école, où çà et là straße über größer naïve Ærø"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    others = "Ganz andere Wörter stehen hier – „kein Treffer“ in diesem Text"
    rows = [(1, f"vorher {passage.upper()} nachher"), (2, passage.replace(" ", " ").replace("'", "’").replace(",", " —")), (3, passage), (4, others), (5, None)]
    kept = decontaminate.drop_leaking(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5]


def test_folded_words_of_ascii_are_the_same():
    text = bytes(range(128)) * 3
    assert decontaminate.folded_words_of(text) == decontaminate.words_of(text)
    assert decontaminate.folded_words_of("ÀB_c–Straße".encode()) == ["àb".encode(), b"c", b"strasse"]
