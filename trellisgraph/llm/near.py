"""Near-duplicate documents: word shingles with a Jaccard similarity of at least 0.8.

Shingles: A-Z lower-cased, words are runs of non-white-space (ASCII), ``WIDTH`` = 5 words; a text of fewer words is one
shingle, texts without words, null texts included, have none and are alike. A shingle is known by a 64-bit hash. Two texts
link if |A and B| / |A or B| >= ``SIMILAR``, counted on their whole sets; groups are the components of these links.

Search: texts with the same set collapse first. The others are searched by SimHash with pigeonring filtering: a fingerprint
bit is set if more than half of the shingles' hashes set it, and by ``RING`` all pairs within ``RING.tau`` bits are found, as
``simhash`` does; its groups are compared by exact similarity. No budget of bits that keys can search holds every link:
sets at 0.8 differ by some 10 of 64 bits, up to 16 were measured. So links beyond the budget are searched after it. Every set
has ``BANDS`` keys of ``ROWS`` MinHash values each; sets that share a key are compared. A pair of similarity s shares none with
probability (1 - s^4)^32: 5e-8 at 0.8, less above it. Keys with the same members are compared once, and
only if they are not one group yet. Only texts that share a key have their sets sent along.

Scale: the members of a key leave a spanning forest, never all pairs. Keys with more than ``TILE`` members are compared
tile by tile in many tasks, which loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LISTED, as_task, materialize, per_text, picked, release, wrapped
from .decontaminate import _mix, _shingle_hashes, _WordHashes
from .simhash import Ring, components, links, majority

WIDTH = 5
#: Least similarity, as a fraction: no rounding.
SIMILAR = (4, 5)
#: Bits that fingerprints may differ in, and the segments that find them.
RING = Ring(tau=7, segments=8, sparse=True)
BANDS, ROWS = 32, 4
#: Bands that are looked up together, first and last.
ROUNDS = ((0, BANDS),)
#: Members of one key that one task compares; more are dealt out as pairs of chunks.
TILE = 1 << 15

_SALT, _FACTOR = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_FACTOR = _FACTOR * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes, hashes: _WordHashes) -> np.ndarray:
    """The distinct shingles of a UTF-8 text, ascending."""
    words = text.lower().split()
    return np.unique(_shingle_hashes(hashes.of(words), min(WIDTH, len(words)))) if words else np.empty(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band; none for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 10):
        least = np.minimum(least, ((shingles[at : at + (1 << 10), None] ^ _SALT) * _FACTOR).min(0))
    rows, key = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def _set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 5)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of shingles."""
    return np.array([majority(s) for s in sets], np.uint64)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, id, text and a number for every row, with the key of its set of shingles, its fingerprint and its bands."""

    def make():
        hashes = _WordHashes()

        def apply(texts):
            sets = [shingles_of(t, hashes) for t in texts]
            return {"set": np.array([_set_key(s) for s in sets], np.uint64).view(np.int64), "fp": fingerprints(sets).view(np.int64), "bands": [band_keys(s) for s in sets]}

        return apply

    rows = wrapped(docs).select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    return per_text(rows, "set bigint, fp bigint, bands array<bigint>", make, ["doc", "id", "row"], "text")


def _forest(keys: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], tau: int | None = None) -> Iterator[tuple[int, int]]:
    """Links that span the sets of one bucket, beside what the groups already are: each new group by the set that reached it.

    With ``tau``, links whose fingerprints differ in more bits are left to other searches.
    """
    over, under = SIMILAR
    fps = None if tau is None else fingerprints(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.arange(len(sets))
    while len(left):
        first = groups[left] == groups[left[0]]
        frontier, left = left[first].tolist(), left[~first]
        while frontier and len(left):
            one = frontier.pop()
            near = left[(sizes[left] * under >= sizes[one] * over) & (sizes[one] * under >= sizes[left] * over)]
            if fps is not None:
                near = near[np.bitwise_count(fps[near] ^ fps[one]) <= tau]
            if not len(near):
                continue
            flat, mine = np.concatenate([sets[i] for i in near]), sets[one]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[near])[:-1])))
            found = near[both * under >= (sizes[near] + sizes[one] - both) * over]
            if len(found):
                _, each = np.unique(groups[found], return_index=True)
                for other in found[each].tolist():
                    yield keys[one], keys[other]
                reached = np.isin(groups[left], groups[found])
                frontier.extend(left[reached].tolist())
                left = left[~reached]


def _link_buckets(batches: Iterator[pa.RecordBatch], tau: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted (key, set, group, shingles) batches into links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    bucket, keys, groups, sets = None, [], [], []

    def linked() -> list[pa.RecordBatch]:
        found = list(_forest(np.array(keys, np.int64), np.array(groups, np.int64), sets, tau)) if len(set(groups)) > 1 else []
        return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema)] if found else []

    for batch in batches:
        values = batch.column(3)
        flat, offsets = values.values.to_numpy(zero_copy_only=False).view(np.uint64), values.offsets.to_numpy()
        for i, (key, member, group) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if key != bucket:
                yield from linked()
                bucket, keys, groups, sets = key, [], [], []
            keys.append(member)
            groups.append(group)
            sets.append(flat[offsets[i] : offsets[i + 1]].copy())
    yield from linked()


def _roots(marked: DataFrame, least: DataFrame, text_col: str, tile: int = TILE) -> DataFrame | None:
    """(node, root): the groups of linked sets, as a written table. ``least.row`` is the row that stands for a set.

    The groups of fingerprints are taken first, then bands in ``ROUNDS``. A key whose members are one group by then is not looked at any more, so sets of large groups
    are compared twice at most, not once for each band. No link is lost: sets of two groups that share a key meet.
    """
    banded = materialize(marked.groupBy("set").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-bands")
    some = banded.where(F.size("bands") > 0)
    found = links(some.select("fp").distinct(), tile, RING)
    alike = components(found)
    by_print = some.join(alike, F.col("fp") == F.col("node"), "left").select("set", F.coalesce("root", "fp").alias("key"))
    by_band = [banded.select("set", F.explode(F.slice("bands", first + 1, last - first)).alias("key")) for first, last in ROUNDS]
    roots = None
    for filed, search in [(by_print, partial(_link_buckets, tau=RING.tau)), *[(b, _link_buckets) for b in by_band]]:
        if roots is None:
            filed = filed.withColumn("group", F.col("set"))
        else:
            filed = filed.join(roots, F.col("set") == F.col("node"), "left").select("set", "key", F.coalesce("root", "set").alias("group"))
        filed = materialize(filed, "near-keys")
        of_key = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"), F.expr("bit_xor(xxhash64(set))").alias("x"), F.expr("bit_xor(xxhash64(set, 1L))").alias("y"))
        once = materialize(of_key.where("low <> high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "near-once")
        members = materialize(joined(filed, once, "key"), "near-members")
        listed = materialize(joined(least, members.select("set").distinct(), "set").select(F.col("least.row").alias("row")), "near-listed")
        texts = picked(marked, listed, "row").select("set", F.col(f"doc.`{text_col}`").alias("text"))

        def make():
            hashes = _WordHashes()
            return lambda found: {"shingles": [shingles_of(t, hashes).view(np.int64) for t in found]}

        sets = materialize(per_text(texts, "shingles array<bigint>", make, ["set"], "text"), "near-shingles")
        # Chunks of at most about half a tile; each pair of chunks meets in one tile, in a task of its own.
        chunks = F.when(F.col("n") > tile, F.ceil(F.col("n") * 2.5 / tile)).otherwise(1).cast("long")
        mine, end = F.pmod(F.xxhash64("set"), F.col("chunks")), F.col("chunks") - 1
        other = F.explode(F.sequence(F.lit(0).cast("long"), end))
        tiles = members.withColumn("chunks", chunks).withColumn("mine", mine).withColumn("other", other)
        named = F.when(end == 0, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        tiles = materialize(tiles.select(named.alias("key"), "set", "group"), "near-tiles")
        dealt = joined(sets, tiles, "set").select("key", "set", "group", "shingles")
        linked = materialize(dealt.repartition("key").sortWithinPartitions("key", "set").mapInArrow(as_task(search, __name__), "a bigint, b bigint"), "near-links")
        known = linked if roots is None else linked.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        before, roots = roots, components(known)
        release(filed, once, members, listed, sets, tiles, linked)
        if before is not None:
            release(before)
    release(banded, found, alike)
    return roots


def joined(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows joined with a written frame of a few numbers a row, which is broadcast while it is small."""
    return df.join(keys.hint("broadcast") if keys.count() <= LISTED else keys, key)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the smallest id, null last; of repeated rows with that id, one.

    Columns and types stay. Every row has a number of its own, by which it is kept, so rows that share an id are apart. An
    empty table gives an empty result.
    """
    marked = materialize(_marked(docs, id_col, text_col), "near-rows")
    least = materialize(marked.groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("least")), "near-distinct")
    roots = _roots(marked, least, text_col)
    labelled = least.join(roots, least["set"] == roots.node, "left").select("least", F.coalesce("root", "set").alias("root"))
    chosen = materialize(labelled.groupBy("root").agg(F.min("least").alias("least")).select("least.row"), "near-kept")
    release(least, roots)
    return picked(marked, chosen, "row").select("doc.*")
