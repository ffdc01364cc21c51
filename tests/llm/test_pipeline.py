"""Stages of the pipeline, each against brute force over its own input."""

import pytest

from trellisgraph.llm import decontaminate, langid
from trellisgraph.llm.common import materialize

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import AWKWARD  # noqa: E402
from .test_near import brute_kept  # noqa: E402
from .test_text_operators import brute_leaks  # noqa: E402


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    outputs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        outputs.append((before, docs))
    _, good, distinct, clean, tokens = outputs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in good[1].collect()}
    known = [r.doc_id for r in good[0].collect() if r.doc_id in labels]
    assert sum((i in kept) == bool(labels[i]) for i in known) / len(known) > 0.9
    # Stages on word shingles take five words and a similarity of 0.8; op8's three bits are the contract of its query.
    assert sorted((r.doc_id for r in distinct[1].collect()), key=str) == brute_kept([(r.doc_id, r.text) for r in distinct[0].collect()])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaking = {d for d, *_ in brute_leaks([(r.doc_id, r.text) for r in clean[0].collect()], items)}
    assert {r.doc_id for r in clean[1].collect()} == {r.doc_id for r in clean[0].collect()} - leaking
    assert {(r.doc_id, r.text) for r in tokens[0].collect()} == {(r.doc_id, r.text) for r in tokens[1].collect()}


def test_language_stage_rejects_texts_without_letters(spark):
    docs = spark.createDataFrame([(*r[:3], "s", 1) for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and not {1, 2, 3, 6} & {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.distinct(spark, docs.limit(0), "").count() == 0
    assert langid.UNDETERMINED and decontaminate.WIDTH == 5


@pytest.fixture(scope="module")
def clashing():
    """Names that operators use inside."""
    return ["__score", "__lang", "__leaks", "__text", "__keep", "__s_upper", "doc", "row", "set", "bands", "fp", "id", "score", "lang_pred"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_awkward_documents(spark, tmp_path, clashing, empty):
    """Nulls, repeated ids and rows, very long texts and clashing columns in every stage; tables beside them empty or not."""
    rows = [(*r[:3], "s", 1, *["c"] * len(clashing)) for r in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clashing))
    spark.createDataFrame([(0, 1), (4, 1), (5, 1), (None, 0), (8, None)], "doc_id long, quality int").limit(0 if empty else 9).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word"), (2, None), (3, "")], "item_id long, text string").limit(0 if empty else 9).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {r["set"] for r in got.collect()} <= {"c"}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = {name: sorted((str(r.doc_id) for r in stage(spark, docs, str(tmp_path)).collect())) for name, stage in corpus_pipeline.STAGES[:-1]}
    ids = sorted(str(r[0]) for r in AWKWARD)
    assert kept["language"] == sorted(i for i in ids if i not in ("1", "2", "3", "6"))
    assert kept["quality"] == ids
    assert kept["near_duplicates"] == sorted(map(str, brute_kept([r[:2] for r in AWKWARD])))
    assert kept["decontamination"] == (ids if empty else sorted(i for i in ids if i != "4"))
    tokens = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert tokens.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "text"] and tokens.count() == len(AWKWARD)


def test_run_deletes_what_it_has_read(spark, small):
    from pathlib import Path

    def folders():
        return {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).glob("pipeline-*")}

    before = folders()
    assert corpus_pipeline.run(spark, small).count() > 0
    left = {n.rsplit("-", 1)[0] for n in folders() - before}
    assert left == {"pipeline-quality", "pipeline-decontamination"}
