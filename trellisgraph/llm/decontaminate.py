"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Words: A-Z lower-cased, ASCII punctuation, white space and control characters separate; shingles are ``WIDTH`` = 5 words
(an item of fewer words is one shingle of its own length). An item leaks into a document if at least ``THRESHOLD`` = 0.8
of its distinct shingles occur there. These words are those of ``ORACLE_SQL``; ``drop_leaking``, which the pipeline uses, folds
case and separates words by Unicode.

Search: items are partitioned by size (powers of two of the distinct shingle count, and the shingle width). Every item is
sketched by its k smallest shingle hashes (bottom-k MinHash), where k = floor(0.2 * largest size of the partition) + 1. A
document that holds 80 % of an item misses at most floor(0.2 n) shingles, so it holds at least k - floor(0.2 n) >= 1 of
the sketch: no leak is lost to the sketch. A document streams through once: its shingle hashes above a partition's
largest sketch value are skipped, the others are looked up, and items with enough hits are verified by comparing whole
shingles. Documents too small for a partition skip it. Nothing is shuffled.

Items are the query set. They are sent to the executors in blocks of ``BLOCK_ITEM_BYTES`` of text or one longer item, as
texts and arrays of hashes, some three times their size; a larger benchmark takes several passes over the documents, never
a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, wrapped

WIDTH = 5
THRESHOLD = 0.8
#: Text of the items that one pass over the documents handles.
BLOCK_ITEM_BYTES = 16 << 20
#: Hashes of words that a task remembers.
WORD_CACHE = 200_000
#: Items whose shingles a task remembers.
ITEM_CACHE = 500

_SEPARATORS = bytes(c if not c < 0x30 and not 0x3A <= c <= 0x40 and not 0x5B <= c <= 0x60 and not 0x7B <= c <= 0x7F else 0x20 for c in range(256))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else _SEPARATORS[c] for c in range(256))
_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split()


def folded_words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text by Unicode: case folded, all but letters and digits separate."""
    if not text.isascii():
        whole = text.decode("utf-8", "replace").casefold()
        apart = [c for c in set(whole) if c > "\x7f" and not c.isalnum()]
        text = (whole.translate(dict.fromkeys(map(ord, apart), " ")) if apart else whole).encode()
    return words_of(text)


def shingles_of(words: list[bytes], width: int) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words: a polynomial in the words' hashes, mixed."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(_BASE) + word_hashes[i : i + n]
        return _mix(out)


class _WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Sketches:
    """Sketches of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD, words_of=words_of):
        hashes = _WordHashes()
        self.words_of = words_of
        self._wanted: dict[int, set[bytes]] = {}
        #: Id, words, width, number of distinct shingles, allowed misses.
        self.items: list[tuple[int, bytes, int, int, int]] = []
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        own: list[np.ndarray] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(WIDTH, len(words))
            n = len(shingles_of(words, width))
            parts[width, n.bit_length()].append(len(self.items))
            self.items.append((item_id, b" ".join(words), width, n, int(n * (1 - threshold) + 1e-9)))
            own.append(np.unique(_shingle_hashes(hashes.of(words), width)))
        #: For each partition: width, least shingles of a matching document, sketch values, and (value, item) pairs.
        self.parts = []
        self.need: list[int] = [0] * len(self.items)
        for (width, _), members in sorted(parts.items()):
            k = max(self.items[i][4] for i in members) + 1
            values, who = [], []
            for i in members:
                sketch = own[i][:k]
                self.need[i] = max(1, len(sketch) - self.items[i][4])
                values.append(sketch)
                who.append(np.full(len(sketch), i))
            value, item = np.concatenate(values), np.concatenate(who)
            order = np.argsort(value, kind="stable")
            least = min(self.items[i][3] - self.items[i][4] for i in members)
            self.parts.append((width, least, value[order], item[order]))

    def matches(self, words: list[bytes], hashes: _WordHashes) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, how many of them occur) for every item that leaks."""
        if not words:
            return
        coded = hashes.of(words)
        by_width: dict[int, np.ndarray] = {}
        shingles: dict[int, set[bytes]] = {}
        for width, least, values, who in self.parts:
            if len(words) - width + 1 < least:
                continue
            if width not in by_width:
                by_width[width] = _shingle_hashes(coded, width)
            low = by_width[width][by_width[width] <= values[-1]]
            at = np.searchsorted(values, low)
            low = np.unique(low[values[at] == low])
            if not len(low):
                continue
            first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
            hit = who[np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)])]
            for i, hits in zip(*(x.tolist() for x in np.unique(hit, return_counts=True)), strict=True):
                if hits < self.need[i]:
                    continue
                if width not in shingles:
                    shingles[width] = shingles_of(words, width)
                item_id, _, _, n_wanted, misses = self.items[i]
                found = len(self.wanted(i) & shingles[width])
                if found >= n_wanted - misses:
                    yield item_id, n_wanted, found

    def wanted(self, i: int) -> set[bytes]:
        """The shingles of an item; those of the items met last are remembered."""
        known = self._wanted.get(i)
        if known is None:
            if len(self._wanted) >= ITEM_CACHE:
                self._wanted.clear()
            known = self._wanted[i] = shingles_of(self.items[i][1].split(), self.items[i][2])
        return known


def find_leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(id, item_id, n_shingles, n_found, containment) of every item that leaks into a document.

    Null and empty documents and items match nothing. Repeated item rows count once; repeated document rows each give
    their rows. An empty table on either side gives an empty result.
    """
    out = None
    for sketches in _blocks(docs, items, threshold, item_col, item_text_col):
        found = _with_leaks(docs, [id_col], text_col, sketches).select(F.col(id_col), F.explode("__leaks").alias("leak")).select(id_col, "leak.*")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def _blocks(docs: DataFrame, items: DataFrame, threshold: float, item_col: str, item_text_col: str, words_of=words_of) -> Iterator:
    """Broadcast sketches of the items, block by block; one empty block if there are none."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).distinct()
    block: list[tuple[int, bytes]] = []
    size, sent = 0, False
    for row in rows.toLocalIterator():
        block.append((row.i, row.t.encode()))
        size += len(block[-1][1]) + 64
        if size >= BLOCK_ITEM_BYTES:
            yield docs.sparkSession.sparkContext.broadcast(Sketches(block, threshold, words_of))
            block, size, sent = [], 0, True
    if block or not sent:
        yield docs.sparkSession.sparkContext.broadcast(Sketches(block, threshold, words_of))


def _with_leaks(docs: DataFrame, keep: list[str], text_col: str, shared) -> DataFrame:
    def make():
        sketches, hashes = shared.value, _WordHashes()
        return lambda texts: {"__leaks": [[{"item_id": i, "n_shingles": n, "n_found": f} for i, n, f in sketches.matches(sketches.words_of(t), hashes)] for t in texts]}

    return per_text(docs, "__leaks array<struct<item_id: bigint, n_shingles: bigint, n_found: bigint>>", make, keep, text_col)


def drop_leaking(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows into whose text no item leaks, with the columns they have. Each row is judged where it is read: no join.

    Words are those of ``folded_words_of``.
    """
    kept = wrapped(docs).select("doc", F.col(f"doc.`{text_col}`").alias("text"))
    for sketches in _blocks(docs, items, threshold, item_col, item_text_col, folded_words_of):
        kept = _with_leaks(kept, ["doc"], "text", sketches).where(F.size("__leaks") == 0).select("doc", F.col(f"doc.`{text_col}`").alias("text"))
    return kept.select("doc.*")


#: The exact rule as SQL, over whole tables.
ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_split_to_array(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_split_to_array(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')), ' ') FROM benchmark
), i AS (
  SELECT DISTINCT id AS item_id, least(5, len(ws)) AS width, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' '))) AS s
  FROM w WHERE kind = 'i' AND ws <> ['']
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id
), d AS (
  SELECT id AS doc_id, width, unnest(list_distinct(list_transform(range(1, len(ws) - width + 2), lambda k: array_to_string(ws[k:k + width - 1], ' ')))) AS s
  FROM w, (SELECT DISTINCT width FROM i) WHERE kind = 'd' AND ws <> ['']
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
FROM d JOIN i USING (width, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= n_shingles - floor(n_shingles * 0.2 + 1e-6)
"""
