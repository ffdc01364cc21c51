"""The language model is trained on all tokens, however many there are."""

import numpy as np
import pyarrow as pa

from trellisgraph.llm import lm
from trellisgraph.llm.common import materialize


def trained(rare):
    rng = np.random.default_rng(2)
    one, two, target = rng.integers(0, 600, (3, 50_000))
    target[40_000] = rare
    return lm.LogBilinear(np.ones(600)).train([(one, two, target)])


def test_one_token_among_many_counts():
    assert not np.array_equal(trained(7).parameters(), trained(8).parameters())


def test_every_token_is_seen_once():
    model = trained(7)
    assert model.seen["groups"] == model.seen["symbols"].sum() == 50_000 and model.seen["context"].sum() == 100_000


def test_words_of_a_block_are_those_of_its_texts():
    texts = [b"", b"  ", b"One  two\x0bTHREE\x1cfour ", b"\xc3\x89T\xc3\x89 \xff\x00 \xc2\xa0x", bytes(range(256)), b"a" * 70_000, b"\x85 b", b""]
    for cut in range(len(texts)):
        words, begins = lm._words(pa.array([b"before it", *texts], pa.binary()).slice(1 + cut))
        words = words.to_pylist()
        assert [words[a:b] for a, b in zip(begins, begins[1:])] == [lm.words_of(t) for t in texts[cut:]]
    some = [w for t in texts for w in lm.words_of(t)]
    assert lm.shared_symbols(pa.array([b"x", *some], pa.binary()).slice(1)).tolist() == list(map(lm.shared_symbol, some))


def test_coded_texts_have_one_row_each(spark, monkeypatch):
    """Words that are not frequent stay with their text, so training reads no other rows; counts are whole if tasks hand on often."""
    monkeypatch.setattr(lm, "TASK_WORDS", 3)
    texts = ["Aa aa bb cc  dd ee", None, "", "bb xx bb yy xx", "cc", "zz aa"]
    rows = lm._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text")
    counts = materialize(lm.word_counts(rows), "test-counts")
    held = {r.id: r.held_out for r in rows.collect()}
    expected = {}
    for i, t in enumerate(texts):
        for w in [*lm.words_of((t or "").encode()), lm.END]:
            total, train = expected.get(w, (0, 0))
            expected[w] = (total + 1, train + (not held[i]))
    assert {bytes(r.word): (r.total, r.train) for r in counts.collect()} == expected
    vocab = lm.vocabulary(counts, 4)
    coded = lm.code(rows, spark.sparkContext.broadcast(vocab)).collect()
    assert len(coded) == len(texts)
    for r in coded:
        tokens = [*lm.words_of((texts[r.id] or "").encode()), lm.END]
        rare = [w for w in tokens if w not in vocab.words]
        assert {bytes(w): n for w, n in zip(r.words, r.times)} == {w: rare.count(w) for w in rare}
        assert r.n_tokens == len(tokens) == len(r.symbols) // 2
        assert np.frombuffer(r.symbols, np.uint16).tolist() == [vocab.symbols[vocab.words[w]] if w in vocab.words else vocab.own + lm.shared_symbol(w) for w in tokens]
