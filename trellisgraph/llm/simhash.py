"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints: A-Z lower-cased, words are runs of non-white-space (ASCII), 3-word shingles with repeats, XXH64 (seed 42)
of each; a bit is set if more than half of the hashes set it. Texts with one or two words use the whole sequence; texts
without words, null texts included, get fingerprint zero and link like any other.

Links: two fingerprints link at ``TAU`` = 3 or fewer differing bits. The 64 bits form a ring of four 16-bit segments. By
the pigeonring principle a link has a start segment i from which every chain of l segments differs in at most
floor(3 l / 4) bits: 0, 1, 2, 3. Chain length two is used as the search key: segment i is equal, and as segment i + 1
differs in at most one bit, one of its halves is equal as well. So each distinct fingerprint is filed under eight 24-bit
keys, and members of one key are compared only if the cumulative chain budgets hold; then follows the full check.

Scale: equal fingerprints collapse first, so groups of exact copies cost one row. A key's members are compared in numpy
blocks and, beyond ``SHORT`` members, leave a spanning forest (fewer links than members). Keys with more than ``TILE`` members
are dealt out to many tasks before they are shuffled, and compared tile by tile, which loses no link. Components come from
alternating star contraction over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_text, picked, release, wrapped

TAU = 3
#: Members of one search key that one task compares; more are dealt out as pairs of chunks.
TILE = 1 << 15
#: Members of a key that are compared all at once (28 pairs); more leave a spanning forest.
SHORT = 8
WIDTH = 3
SEED = 42


@dataclass(frozen=True)
class Ring:
    """A budget of differing bits and the equal segments of the ring; more segments than ``tau``, fewer than twice as many.

    So a start segment is equal, and the next one differs in one bit at most: its key is the segment and an equal half of the
    next, one for each half and segment. Keys of few bits hold many fingerprints that do not link: runs are then compared all
    at once, and leave a forest only if more than twice as many pairs as members link.
    """

    tau: int = TAU
    segments: int = 4
    sparse: bool = False

    @property
    def width(self) -> int:
        return 64 // self.segments


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= WIDTH:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[WIDTH:], strict=False)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int((np.uint64(1) << np.flatnonzero(counts * 2 > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row; fp holds the 64 bits as a signed long."""
    return per_text(docs, "fp bigint", _fingerprints, [id_col], text_col)


def _fingerprints():
    return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}


def _chain_masks(rotation: int, ring: Ring) -> list[tuple[np.uint64, int]]:
    """(bits, budget) of the chains of two segments up to all that start at this segment."""
    masks, mask = [], 0
    for length in range(1, ring.segments + 1):
        mask |= (1 << ring.width) - 1 << (ring.width * ((rotation + length - 1) % ring.segments))
        masks.append((np.uint64(mask), ring.tau * length // ring.segments))
    return masks[1:]


def _linked(one: np.uint64, others: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Positions in ``others`` that pass every chain budget; the last chain is the whole fingerprint."""
    diff = others ^ one
    at = np.arange(len(others))
    for mask, budget in masks:
        near = np.bitwise_count(diff[at] & mask) <= budget
        at = at[near]
    return at


def _forest(fps: np.ndarray, masks: list[tuple[np.uint64, int]]) -> Iterator[tuple[int, int]]:
    """Spanning links of the fingerprints of one key: each new member with the one that reached it."""
    left = fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = _linked(one, left, masks)
            if len(near):
                found = left[near]
                left = np.delete(left, near)
                frontier.extend(found)
                for other in found:
                    yield one, other


def _few_links(fps: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray | None:
    """All links of the fingerprints of one key, two a row; None if more than twice as many as members."""
    found, total, step = [], 0, max(1, (1 << 17) // len(fps))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, at:]) <= masks[-1][1]
        i, j = np.nonzero(near)
        i, j = i[i < j], j[i < j]
        diff = fps[at + i] ^ fps[at + j]
        ok = np.ones(len(i), bool)
        for mask, budget in masks:
            ok &= np.bitwise_count(diff & mask) <= budget
        found.append(np.column_stack([fps[at + i[ok]], fps[at + j[ok]]]))
        total += len(found[-1])
        if total > 2 * len(fps):
            return None
    return np.concatenate(found)


def _link_keys(batches: Iterator[pa.RecordBatch], ring: Ring) -> Iterator[pa.RecordBatch]:
    """Turns (key, rotation, fp) batches, sorted by key, into links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    all_masks = [_chain_masks(i, ring) for i in range(ring.segments)]

    def whole_runs(keys: np.ndarray, rotations: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
        # Runs of up to SHORT members: compare neighbours at each offset, all runs at once.
        short = (sizes > 1) & (sizes <= SHORT)
        begin, size = starts[short], sizes[short]
        offset = 1
        while len(begin):
            at = np.repeat(begin - np.concatenate(([0], np.cumsum(size - offset)))[:-1], size - offset) + np.arange((size - offset).sum())
            diff = fps[at] ^ fps[at + offset]
            ok = np.ones(len(at), bool)
            for i, masks in enumerate(all_masks):
                for mask, budget in masks:
                    ok &= (rotations[at] != i) | (np.bitwise_count(diff & mask) <= budget)
            yield fps[at[ok]], fps[at[ok] + offset]
            offset += 1
            more = size > offset
            begin, size = begin[more], size[more]
        for start, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
            run, masks = fps[start : start + size], all_masks[rotations[start]]
            found = _few_links(run, masks) if ring.sparse else None
            if found is None:
                found = np.array(list(_forest(run, masks)), np.uint64).reshape(-1, 2)
            yield found[:, 0], found[:, 1]

    def emit(columns: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = list(whole_runs(*map(np.concatenate, columns))) if columns[0] else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], schema=schema)

    waiting: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        # All but the last key of the batch are complete.
        cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
        if cut or waiting[0] and waiting[0][-1][-1] != columns[0][0]:
            for w, c in zip(waiting, columns, strict=True):
                w.append(c[:cut])
            yield from emit(waiting)
            waiting = [[], [], []]
        for w, c in zip(waiting, columns, strict=True):
            w.append(c[cut:])
    yield from emit(waiting)


def links(fps: DataFrame, tile: int = TILE, ring: Ring = Ring()) -> DataFrame:
    """(a, b): links that span every component of the distinct values of column fp, as a written table."""
    keys, width, half_width = [], ring.width, ring.width // 2
    for i in range(ring.segments):
        segment = F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)
        after = width * ((i + 1) % ring.segments)
        for half in range(2):
            part = F.shiftrightunsigned("fp", after + half_width * half).bitwiseAND((1 << half_width) - 1)
            keys.append(F.lit(2 * i + half << width + half_width) + F.shiftleft(segment, half_width) + part)
    # Key, from the top: rotation, the half, the segment, the half segment; at most 27 bits.
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Hot keys are dealt before they are shuffled, into chunks of at most about half a tile; each pair of chunks meets in one
    # tile, in a task of its own. They are few: at most one for ``tile`` rows.
    hot = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    chunks = F.coalesce(F.ceil(F.col("n") * 2.5 / tile).cast("long"), F.lit(1).cast("long"))
    dealt = filed.join(hot, "key", "left").select("fp", "key", chunks.alias("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    dealt = dealt.select("fp", "key", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("mine"), other.alias("other"))
    named = F.shiftleft(F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other"), 27) + F.col("key")
    tiles = dealt.select(named.alias("key"), F.shiftright("key", width + half_width + 1).cast("int").alias("rotation"), "fp")
    return materialize(tiles.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(_link_keys, ring=ring), "a bigint, b bigint"), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of an undirected edge list (a, b) with the smallest node it reaches.

    Alternates large-star and small-star contraction; every round is written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(edges, "cc")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        following = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "cc")
        release(current)
        current = following
        state = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.shiftright(F.xxhash64("b", "a"), 40))).first()
        if state == before:
            out = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out._shared_path = current._shared_path
            return out
        before = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): the group of every row; one row per input row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest id reachable over links, itself included.
    Rows with equal text share a component. A null id keeps its row; it never names a component unless all ids of the
    component are null. An empty table gives an empty result.
    """
    rows = materialize(with_fingerprints(docs, id_col, text_col), "simhash-fp")
    distinct = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-distinct")
    roots = components(links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the smallest id, null last; of repeated rows with that id, one. Columns and types stay.

    Every row has a number of its own, by which it is kept, so rows that share an id are apart.
    """
    numbered = wrapped(docs).select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.col(f"doc.`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(per_text(numbered, "fp bigint", _fingerprints, ["doc", "id", "row"], "text"), "simhash-rows")
    least = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp")))
    labelled = least.join(roots, least.fp == roots.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    chosen = materialize(labelled.groupBy("root").agg(F.min("least").alias("least")).select("least.row"), "simhash-kept")
    release(least)
    return picked(rows, chosen, "row").select("doc.*")
