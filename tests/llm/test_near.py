"""Near duplicates by exact Jaccard similarity, against brute force over all pairs."""

import numpy as np
import pytest

from trellisgraph.llm import near, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(rows):
    """rows: (id, text); (smallest id, null last) of each component of pairs with 5-word Jaccard >= 0.8."""

    def grams(text):
        words = (text or "").encode().lower().split()
        width = min(5, len(words))
        return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        at = find(i)
        least[at] = min(least.get(at, (True, 0)), (name is None, name or 0))
    return sorted((None if no else name for no, name in least.values()), key=str)


def test_near_duplicates_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id for r in corpus_pipeline.distinct(spark, docs, small).collect()), key=str) == brute_kept(rows)


@pytest.mark.parametrize("tile", [near.TILE, 20])
def test_large_group_around_one_text(spark, tile, monkeypatch):
    """Copies with a few words changed each: most link to some others only, and small tiles lose nothing."""
    monkeypatch.setattr(near._roots, "__defaults__", (tile,))
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 7))):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_kept(rows)


def test_near_duplicates_of_awkward_documents(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    kept = near.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and sorted((r.doc_id for r in kept.collect()), key=str) == brute_kept(rows)
    assert near.drop_near_duplicates(nothing).count() == 0


def test_one_id_on_different_texts(spark):
    """Rows are chosen by id and text, so an id on two texts loses neither and keeps no copy of another's."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, one), (4, two), (2, two)]
    kept = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (2, two), (3, three)])


def test_pigeonring_finds_all_pairs_within_its_budget(spark):
    """Components of fingerprints by the stage's wider ring, against all pairs; many links in a key and few."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, np.uint64).tolist()
    for i, bits in enumerate([*range(1, 12)] * 12):
        fps.append(fps[i] ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    fps += [fps[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    fps = np.unique(np.array(fps, np.uint64))
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, fp in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fp) <= 7).tolist():
            root[find(i)] = find(j)
    frame = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(3)
    for tile in (simhash.TILE, 50):
        roots = {r.node: r.root for r in simhash.components(simhash.links(frame, tile, near.RING)).collect()}
        named = [roots.get(int(v), int(v)) for v in fps.view(np.int64)]
        assert len(set(named)) == len(set(map(find, range(len(fps)))))
        assert len({(n, find(i)) for i, n in enumerate(named)}) == len(set(named))


def test_stage_searches_by_simhash(spark, monkeypatch):
    """Without the bands, the stage's SimHash search alone links every similar pair within its bits, and no other pair."""
    monkeypatch.setattr(near, "ROUNDS", ())
    rng = np.random.default_rng(6)
    rows = []
    for group in range(25):
        base = [f"g{group}w{i}" for i in range(200)]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, 200, int(rng.integers(0, 9))):
                words[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    sets = [near.shingles_of(t.encode(), near._WordHashes()) for _, t in rows]
    fps, root, far = near.fingerprints(sets), list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                if np.bitwise_count(fps[i] ^ fps[j]) <= 7:
                    root[find(i)] = find(j)
                else:
                    far += 1
    least = {}
    for i in range(len(rows)):
        least.setdefault(find(i), i)
    got = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values())
    assert far and len(least) < len(rows)
