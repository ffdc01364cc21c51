"""Operators on documents: values against brute force, and awkward input."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from trellisgraph.llm import decontaminate, langid, lm, matroska, quality, queries, simhash, wfst

from .conftest import AWKWARD


def labels_of(spark):
    return spark.createDataFrame([(0, 1), (4, 0), (5, 1), (None, 1), (99, None)], "doc_id long, quality int")


# Decontamination


def brute_leaks(docs, items):
    def sets(text, width):
        words = decontaminate.words_of((text or "").encode())
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}, words

    out = []
    for item, text in items:
        words = decontaminate.words_of((text or "").encode())
        if not words:
            continue
        width = min(5, len(words))
        wanted = sets(text, width)[0]
        for doc, body in docs:
            found = len(wanted & sets(body, width)[0])
            if found >= 0.8 * len(wanted) - 1e-9:
                out.append((doc, item, len(wanted), found))
    return sorted(out, key=str)


def test_leaks_match_brute_force(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = sorted([tuple(r)[:4] for r in decontaminate.find_leaks(docs, items).collect()], key=str)
    assert got and got == brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_leaks_of_awkward_documents(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "alpha BETA gamma, delta epsilon zeta; eta theta"), (2, None), (3, ""), (4, "word"), (5, "long long"), (4, "word")], "item_id long, text string")
    got = sorted([tuple(r)[:4] for r in decontaminate.find_leaks(awkward, items).collect()], key=str)
    wanted = brute_leaks([(r[0], r[1]) for r in AWKWARD], [(1, "alpha beta gamma delta epsilon zeta eta theta"), (4, "word"), (5, "long long")])
    assert got == wanted
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(awkward, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaking(awkward, items)
    assert kept.columns == awkward.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 3, 3, None, 6, 8], key=str)


def test_items_in_blocks_find_the_same(spark, small, monkeypatch):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEM_BYTES", 3000)
    assert sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == whole


def test_item_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEM_BYTES", 100)
    long = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, f"a b {long} c"), (2, "w1 w2 w3"), (3, "x y z u v w")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "x y z u v w"), (3, "not in any of them")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()) == [(1, 1), (3, 2)]


# Matroska


def test_media_round_trip(spark, awkward, nothing):
    rows = matroska.digests(awkward).collect()
    assert len(rows) == len(AWKWARD) and matroska.digests(nothing).count() == 0
    by_id = {r[0]: (r[1] or "").encode() for r in AWKWARD}
    for r in rows:
        text = by_id[r.doc_id]
        assert r.n_bytes == len(text)
        payload = text.ljust(max(192, -(-len(text) // 192) * 192), b" ")
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    files = matroska.media_files(awkward).collect()
    assert {(len(f.media), hashlib.sha256(f.media).hexdigest()) for f in files} == {(r.media_bytes, r.media_sha256) for r in rows}


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing_kinds(lacing):
    frames = [b"a" * 300] if lacing == 0 else [b"q" * 7] * 4 if lacing == 2 else [b"a" * 3, b"b" * 700, b"c" * 255, b"d" * 10, b""]
    data = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska._uint(matroska.TIMESTAMP, 7) + matroska.element(matroska.SIMPLE_BLOCK, matroska.block(1, -5, frames, lacing))))
    media = matroska.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in media.packets] == frames
    assert media.packets[0][1] == 2 * matroska.TICK


def test_groups_unknown_sizes_and_unknown_elements():
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.block(2, 1, [b"xyz"])) + matroska.element(matroska.REFERENCE, b"\x01"))
    cluster = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + matroska._uint(matroska.TIMESTAMP, 3) + matroska.element(0xEC, b"void") + group
    cues = matroska.element(matroska.CUES, matroska.element(matroska.CUE_POINT, matroska._uint(matroska.CUE_TIME, 3) + matroska.element(matroska.CUE_POSITIONS, matroska._uint(matroska.CUE_TRACK, 2) + matroska._uint(matroska.CUE_CLUSTER, 0))))
    data = bytes.fromhex("18538067") + b"\xff" + cluster + cues
    media = matroska.parse(data)
    (track, time, at, size, key, _, _), = media.packets
    assert (track, time, data[at : at + size], key) == (2, 4 * matroska.TICK, b"xyz", False)
    assert media.cues == [(3 * matroska.TICK, 2, media.clusters[0])]


def test_packet_table_of_broken_files(spark):
    """Blocks outside clusters, floats of three bytes, deep nesting, and good files with bytes changed: null, never an error."""
    e, m = matroska.element, matroska
    deep = b""
    for _ in range(3000):
        deep = e(m.SEGMENT, deep)
    bad = [e(m.SEGMENT, e(m.SIMPLE_BLOCK, m.block(1, 0, [b"x"]))), e(m.SEGMENT, e(m.INFO, e(m.DURATION, b"abc"))), deep, e(m.SEGMENT, e(m.BLOCK_GROUP, e(m.BLOCK, m.block(1, 0, [b"x"])))), e(m.BLOCK, b"")]
    good, rng = m.write(m.payload_of(b"some text " * 300)), np.random.default_rng(0)
    for _ in range(300):
        changed = bytearray(good)
        for at in rng.integers(0, len(good), 3):
            changed[at] = int(rng.integers(0, 256))
        bad.append(bytes(changed))
    files = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)], "id long, data binary")
    got = {r.id: r.packets for r in m.packet_table(files, "id", "data").collect()}
    assert len(got) == len(bad) and not any(got[i] for i in range(5))


def test_packets_follow_the_format(spark):
    """Times, byte ranges and cues of a stored text, from its own arithmetic."""
    payload = matroska.payload_of(bytes(range(32, 127)) * 700)
    stored = matroska.write(payload)
    media = matroska.parse(stored)
    step = matroska.FRAME * 10**9 // matroska.RATE
    assert [p[1] for p in media.packets] == [i * step for i in range(len(payload) // matroska.FRAME)]
    assert b"".join(stored[p[2] : p[2] + p[3]] for p in media.packets) == payload
    per_cluster = matroska.FRAMES_PER_BLOCK * matroska.BLOCKS_PER_CLUSTER
    assert [(c[0], c[2]) for c in media.cues] == [(i * per_cluster * step, at) for i, at in enumerate(media.clusters)] and len(media.clusters) > 2
    feature = dict(part.split("=") for part in matroska.feature(stored, media, payload).split(";") if "=" in part)
    signal = [b for b in payload]
    assert (int(feature["sum"]), int(feature["energy"]), int(feature["packets"]), int(feature["clusters"])) == (sum(signal), sum(b * b for b in signal), len(payload) // 192, len(media.clusters))
    assert int(feature["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(signal, signal[1:]))


def test_packet_table_of_bad_files(spark):
    good = matroska.write(matroska.payload_of(b"hello"))
    files = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(good[:-50]))], "id long, data binary")
    got = {r.id: r.packets for r in matroska.packet_table(files, "id", "data").collect()}
    assert len(got[1]) == 1 and got[1][0].size == 192 and got[2] is got[3] is got[4] is None


# Quality


def test_quality_held_out_accuracy(spark):
    docs = queries.op4_rule_ensemble(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_awkward_documents(spark, awkward, nothing):
    rows = quality.score(awkward, labels_of(spark)).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(awkward, labels_of(spark).limit(0)).collect()} == {0.5}
    assert quality.score(nothing, labels_of(spark)).count() == 0


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 8] <= 0.4)).astype(float)
    model = quality.fit_rules(x, y)
    margin = model.bias + sum(w * quality._holds(x, c) for c, w in model.rules)
    assert np.mean((margin > 0) == (y > 0)) > 0.95 and len(model.rules) < 60
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["i long", *[f"{quality.PREFIX}{s} double" for s in quality.STATISTICS]]))
    got = [r.p for r in frame.select("i", model.score().alias("p")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


# Language model


def test_language_model_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    n = 2 * lm.GROUP + 40
    model = lm.LogBilinear(rng.integers(0, 50, n)).train([tuple(rng.integers(0, n, (3, 5000)))])
    for one, two in [(0, 1), (n, n), (n - 1, 7)]:
        p = 10 ** model.log10(np.full(n, one), np.full(n, two), np.arange(n)).astype(float)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_scores_of_the_model_match_plain_loops(spark, monkeypatch):
    """Every token of every text: both factors by loops over all groups and symbols, times the word within its symbol."""
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (8400,))
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(9500)]
    rows = [(i, " ".join(rng.choice(words[: 30 if i % 2 else 9500], 1200))) for i in range(60)] + [(60, None), (61, "never-seen w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, vocab, _, model = lm.trained(docs)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    train = {bytes(r.word): r.train for r in counts.collect()}
    assert 0 < vocab.own <= lm.OWN and any(w not in vocab.words for w in train)

    def log_softmax(scores, at):
        scores = [float(s) for s in scores]
        return scores[at] - math.log(sum(math.exp(s) for s in scores))

    for i, text in [*rows[:3], *rows[-2:]]:
        total, one, two = 0.0, model.start, model.start
        for w in [*lm.words_of((text or "").encode()), b""]:
            at = vocab.words.get(w, -1)
            symbol = int(vocab.symbols[at]) if at >= 0 else vocab.own + lm.shared_symbol(w)
            predicted = np.append(model.context[one] @ model.first + model.context[two] @ model.second, 1)
            group, place = divmod(symbol, lm.GROUP)
            total += log_softmax(model.groups @ predicted, group) + log_softmax(model.symbols[group] @ predicted, place)
            if symbol >= vocab.own:
                members = [c for v, c in train.items() if c > 0 and lm.shared_symbol(v) == symbol - vocab.own and (vocab.words.get(v, -1) < 0 or vocab.symbols[vocab.words[v]] == symbol)]
                total += math.log((train.get(w, 0) + 0.5) / (sum(members) + 0.5 * (len(members) + 1)))
            one, two = two, symbol
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-4)


def test_model_is_better_than_the_base_on_held_out_texts(spark):
    """By 0.08 decimal digits a token, on sf0.01."""
    rows = queries.op5_log_bilinear(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.08


def test_language_model_of_awkward_documents(spark, awkward, nothing):
    rows = lm.score(awkward).collect()
    assert len(rows) == len(AWKWARD) and sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert lm.score(nothing).count() == 0


# Language ID


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_byte_cnn(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_of_awkward_documents(spark, awkward, nothing):
    model = langid.fit(awkward)
    rows = langid.identify(awkward, model, ["doc_id"]).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 6))
    assert all(r.lang_pred in model.languages for r in rows if r.doc_id in (0, 4, 5, 7, 8))
    assert langid.identify(nothing, langid.fit(nothing), ["doc_id"]).count() == 0


def test_pair_tables_equal_the_convolution():
    model = langid.ByteConvolution(["a", "b"])
    windows = np.random.default_rng(0).integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    conv = model._patches(windows) @ model.filters
    direct = langid._log_softmax(np.maximum(conv.max(1) + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(model.log_probabilities(windows), direct, atol=1e-4)


def test_prediction_matches_plain_loops():
    """Whole texts, byte by byte: every filter at every position of every window."""
    rng = np.random.default_rng(3)
    model = langid.ByteConvolution(["a", "b", "c"])
    model.bias = rng.normal(0, 0.3, model.bias.shape).astype(np.float32)
    texts = ["Ünd so weiter", "word " * 61 + "é漢", "x", "12 34", ""]
    for text, lang, score in zip(texts, *model.predict([t.encode() for t in texts]), strict=True):
        data, total, mass = text.encode(), np.zeros(3), 0.0
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        for start in range(0, len(data), langid.WINDOW - 5):
            window = data[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            hidden = []
            for f in range(model.filters.shape[1]):
                width = langid.WIDTHS[f // langid.FILTERS]
                spans = [sum(float(model.embed[window[p + i]] @ model.filters[langid.EMBED * i : langid.EMBED * (i + 1), f]) for i in range(width)) for p in range(langid.WINDOW - 5)]
                hidden.append(max(0.0, max(spans) + float(model.bias[f])))
            logits = np.array(hidden) @ model.out + model.out_bias
            weight = sum(langid._LETTER[b] for b in window) + 1e-3
            total += weight * (logits - np.log(np.exp(logits).sum()))
            mass += weight
        p = np.exp(total / mass)
        p /= p.sum()
        assert lang == "abc"[int(p.argmax())] and score == pytest.approx(float(p.max()), rel=1e-3)


def test_short_texts_train(spark):
    rows = [(i, *(("yes no", "en"), ("oui non", "fr"))[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs), ["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred for r in found)


def test_late_text_trains():
    """Windows come from all of a text, not from its beginning."""
    text = b"a" * 200_000 + b"b" * 200_000
    drawn = [w for i in range(30) for w in langid.training_windows(text + b"%d" % i)]
    assert 20 < sum(b"b" in w for w in drawn) < 70


def test_numbers_are_no_letters():
    assert [langid.has_letter(t.encode()) for t in ("½ ²", "Ⅷ", "١٢", "_", "é", "漢", "ª", "x")] == [False, False, False, False, True, True, True, True]


def test_windows_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 1000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
        seen = b"".join(bytes(w[: langid._STEP]) for w in langid.windows_of(text)[:-1]) + (bytes(langid.windows_of(text)[-1]) if n else b"")
        assert seen.rstrip(b"\0") == text.rstrip(b"\0")


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    """rows: (id, fingerprint); smallest id reachable over links of 3 bits or fewer."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted([(i, f, least.get(find(f))) for i, f in rows], key=str)


def test_simhash_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()], key=str)
    assert got == brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])


def test_simhash_of_awkward_documents(spark, awkward, nothing):
    got = sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(awkward).collect()], key=str)
    assert got == brute_components([(r[0], brute_fingerprint(r[1])) for r in AWKWARD])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    components = {c for _, _, c in got}
    assert kept.columns == awkward.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted(components, key=str)


@pytest.mark.parametrize("tile", [simhash.TILE, 70])
def test_links_span_all_components(spark, tile):
    """A dense group around one fingerprint, chains, and scattered values; small tiles must lose nothing."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2)) if a != b}
    chain, at = set(), int(rng.integers(0, 2**63))
    for _ in range(60):
        for b in rng.integers(0, 64, 3):
            at ^= 1 << int(b)
        chain.add(at)
    values = sorted(near | chain | {int(x) for x in rng.integers(0, 2**63, 300)})
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    roots = {int(np.int64(r.node).view(np.uint64)): r.root for r in simhash.components(simhash.links(frame, tile)).collect()}
    groups = {}
    for i, _, c in brute_components(list(enumerate(values))):
        groups.setdefault(c, []).append(values[i])
    seen = []
    for members in groups.values():
        labels = {roots.get(m, int(np.uint64(m).view(np.int64))) for m in members}
        assert len(labels) == 1
        seen += labels
    assert len(seen) == len(set(seen))


# SentencePiece


@pytest.fixture(scope="session")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(wfst.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    return sentencepiece.SentencePieceProcessor(model_proto=raw), wfst.Transducer(raw)


def test_encoding_equals_the_library(pieces):
    library, own = pieces
    rng = np.random.default_rng(0)
    alphabet = "abc the ing ▁ \n\té漢字🙂<s>aaaa    0123 \x00Ünß!!!!"
    cases = ["", " ", "  a  b ", "▁", "▁▁", "a" * 50, "<s></s><unk>"] + ["".join(rng.choice(list(alphabet), rng.integers(1, 60))) for _ in range(1500)]
    for text in cases:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist()), text


def least_weight(own, text, at=0, last=-1):
    """Least weight of all paths of the composition, by enumeration."""
    if at == len(text):
        return 0.0
    found = [math.inf]
    for end, piece in own.arcs(text, at):
        weight, state = own.weights[piece] if piece >= 0 else 0.0 if own.neighbours else 10.0 - own.lowest, -1
        if own.neighbours:
            state = piece if piece >= 0 else -2 - ord(text[at])
            if not own.neighbours.finite(last, state):
                continue
        found.append(weight + least_weight(own, text, end, state))
    return min(found)


def edited(raw, **changes):
    """The model file with another model type, kinds of pieces, or normaliser."""

    def field(number, value):
        def varint(n):
            return (bytes([n & 127 | 128]) + varint(n >> 7)) if n > 127 else bytes([n])

        return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value

    out = []
    for number, value in wfst._fields(raw):
        if number == 1 and (kind := changes.get("kinds", {}).get(dict(wfst._fields(value)).get(1, b"").decode())):
            value = bytes(value) + field(3, kind)
        elif number == 1 and changes.get("model_type") == wfst.UNIGRAM:  # scores as unigram models have them
            (rank,) = struct.unpack("<f", dict(wfst._fields(value)).get(2, b"\0\0\0\0"))
            value = bytes(value) + b"\x15" + struct.pack("<f", max(rank, -30_000) / 2000)
        elif number == 2 and "model_type" in changes:
            value = bytes(value) + field(3, changes["model_type"])
        elif number == 3 and "normaliser" in changes:
            value = changes["normaliser"]
        out.append(field(number, value))
    return b"".join(out)


def test_paths_are_shortest(pieces):
    """BPE and, with the same pieces, unigram paths against enumeration of all paths."""
    _, own = pieces
    with open(wfst.DEFAULT_MODEL, "rb") as f:
        unigram = wfst.Transducer(edited(f.read(), model_type=wfst.UNIGRAM))
    for machine in (own, unigram):
        for text in ("▁hello", "▁thehe", "▁abcab", "▁é漢x", "▁ing▁"):
            at, last, total = 0, -1, 0.0
            for end, piece in machine.shortest(text):
                assert (end, piece) in machine.arcs(text, at)
                total += machine.weights[piece] if piece >= 0 else 0.0 if machine.neighbours else 10.0 - machine.lowest
                at = end
            assert at == len(text) and total == pytest.approx(least_weight(machine, text)) and total < math.inf


def test_other_models_equal_the_library():
    """Unigram weights, user-defined symbols, and the character map and white space rules of NFKC models."""
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(wfst.DEFAULT_MODEL, "rb") as f:
        raw = f.read()
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True).serialized_model_proto()
    spec = next(v for n, v in wfst._fields(normaliser) if n == 3)
    rng = np.random.default_rng(1)
    alphabet = list("abc the ing ▁ \n\té漢字ﬁ①Ａ™ﾊﾞ½…\u200b\u3000🙂<s>aa  0123Ünß!!") + ["hello", "the", "  "]
    cases = ["", " ", "  a  b ", "a ", " ▁", "ﬁne ①②", "the hello the", "Ａ　Ｂ"] + ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(400)]
    for changes in ({"normaliser": spec}, {"kinds": {"hello": 4, "the": 4, "ing": 4}}, {"model_type": wfst.UNIGRAM}, {"normaliser": spec, "model_type": wfst.UNIGRAM}):
        model = edited(raw, **changes)
        library, own = sentencepiece.SentencePieceProcessor(model_proto=model), wfst.Transducer(model)
        for text in cases:
            if changes.get("model_type") == wfst.UNIGRAM:  # equal sums may be taken apart in several ways
                got, wanted = own.encode(text).tolist(), library.encode(text)
                assert library.decode(got) == library.decode(wanted), text
                assert sum(own.weights[i] for i in got) == pytest.approx(sum(own.weights[i] for i in wanted), rel=1e-5), text
            else:
                assert own.encode(text).tolist() == library.encode(text), (changes, text)


def test_long_documents_equal_the_library(pieces):
    library, own = pieces
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeéß漢🙂▁<"), rng.integers(1, 12))) for _ in range(3000)]
    for text in (" ".join(rng.choice(words, 60_000)), "x" * 20_000, " " * 5000 + "é漢" * 5000, "ab " * 50_000):
        assert own.encode(text).tolist() == library.encode(text)


def test_tokens_of_awkward_documents(spark, awkward, nothing, pieces):
    library, _ = pieces
    rows = wfst.encode(awkward, ["doc_id"]).collect()
    texts = sorted((r[1] or "") for r in AWKWARD)
    assert sorted(r.decoded for r in rows) == sorted(t.replace("▁", " ") for t in texts)
    assert sorted(map(list, (r.ids for r in rows))) == sorted(library.encode(t) for t in texts)
    assert wfst.encode(nothing, ["doc_id"]).count() == 0
    assert all(r.round_trip for r in queries.op9_wfst(spark, "/root/testdata/sf0.001").select("round_trip").distinct().collect())
