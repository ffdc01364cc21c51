"""Language-model scores: a log-bilinear model over words, trained with noise-contrastive estimation.

Tokens: A-Z lower-cased, words are runs of ASCII non-white-space, then one end token for each text. Up to ``OWN`` of the most
frequent training tokens are symbols of their own; all others share ``SHARED`` symbols by the crc32 of their last two bytes.
Symbols stand in groups of ``GROUP``, by frequency. A text's probability is the product over its tokens of
P(group | two symbols before), P(symbol | group, two symbols before) and P(token | symbol).

The first two factors are log-bilinear: the vectors of the two symbols before, each through its own matrix, sum to a
prediction, which is multiplied with the vectors of all groups and with those of all symbols of the token's group. Scores
are normalised for every token by these batched matrix products. The last factor is 1 for a token of its own, else
(c + 0.5) / (N_k + 0.5 (V_k + 1)) within the symbol k, one unseen word included. All factors sum to one.

Training passes once over every training token, whatever the size: each task starts at the same parameters, takes
mini-batches of its tokens (at least ``LEAST_STEPS`` a block, where it has as many tokens) through noise-contrastive
estimation, and hands on the parameters that it moved, summed with the number of its tokens that moved them; the average of
all tasks is the model. Noise is the unigram distribution of groups, and of symbols within the token's group; its
expectation is exact, so nothing is drawn. The number of parameters is bounded, so what a task hands on and the driver
holds is as well.

Scale: words are counted with task-side tables of bounded size, then summed by word. The ``FREQUENT`` most frequent words
(a bounded list) are broadcast, so that no hot word is ever shuffled; the remaining words of each text are pre-counted
per text and joined with the counts, without the rest of the text's row. Texts are coded once into a written table of symbols, which training and scoring read.
Counts, training and scores cover all texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, fold, materialize

OWN, SHARED, GROUP = 8192, 512, 128
FREQUENT = 1 << 17
#: Words that a task counts before it hands the counts on.
TASK_WORDS = 400_000
FOLDS, HELD = 5, 1
DIMENSIONS, NOISE, RATE = 15, 12, 0.15
#: Tokens of a mini-batch at most, and mini-batches that a block of tokens is dealt into at least.
BATCH, LEAST_STEPS, LEAST_BATCH = 8192, 64, 64
#: Tokens whose scores are in memory at once.
CHUNK = 1 << 16
#: The end token's key in the table of counts; no word is empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shared_symbol(word: bytes) -> int:
    """Which of the shared symbols a word without its own has."""
    return zlib.crc32(word[-2:]) % SHARED


@cache
def _shared_by_end() -> tuple[np.ndarray, np.ndarray]:
    """Shared symbols of words of one byte, and of those that end in two, by their value."""
    one, two = ([shared_symbol(i.to_bytes(k)) for i in range(1 << 8 * k)] for k in (1, 2))
    return np.array(one, np.int64), np.array(two, np.int64)


def shared_symbols(words: pa.Array) -> np.ndarray:
    """``shared_symbol`` of an array of words, none of them empty."""
    one, two = _shared_by_end()
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    return np.where(np.diff(ends) == 1, one[last], two[data[ends[1:] - 2].astype(np.int64) << 8 | last])


def _bucket(word: str) -> Column:
    """``shared_symbol`` of a column of words."""
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(SHARED)).cast("int")


class LogBilinear:
    """P(symbol | two symbols before), in two factors. Context symbol ``start`` stands before a text."""

    def __init__(self, unigram: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = self.start = len(unigram)
        groups = -(-len(unigram) // GROUP)
        weight = np.zeros(groups * GROUP)
        weight[: len(unigram)] = unigram + 0.5
        weight = weight.reshape(groups, GROUP)
        self.group_noise = (weight.sum(1) / weight.sum()).astype(np.float32)
        self.noise = (weight / weight.sum(1, keepdims=True)).astype(np.float32)
        self.context = rng.normal(0, 0.1, (self.size + 1, DIMENSIONS)).astype(np.float32)
        self.first = np.eye(DIMENSIONS, dtype=np.float32)
        self.second = np.eye(DIMENSIONS, dtype=np.float32)
        # Vectors end in their bias; symbols that fill up the last group have no probability.
        self.groups = np.column_stack([rng.normal(0, 0.1, (groups, DIMENSIONS)), np.log(self.group_noise)]).astype(np.float32)
        bias = np.log(np.where(weight > 0, self.noise, 1e-30))
        self.symbols = np.concatenate([rng.normal(0, 0.1, (groups, GROUP, DIMENSIONS)), bias[..., None]], axis=2).astype(np.float32)

    _NAMES = ("context", "first", "second", "groups", "symbols")

    def train(self, tokens: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> LogBilinear:
        """One pass of noise-contrastive estimation over blocks of (symbol before last, last symbol, symbol)."""
        squares = {k: np.full_like(getattr(self, k), 1e-6) for k in self._NAMES}
        #: Tokens that moved each vector.
        self.seen = {"context": np.zeros(self.size + 1), "first": 0, "second": 0, "groups": 0, "symbols": np.zeros(len(self.groups))}
        rng = np.random.default_rng(4)
        for one, two, target in tokens:
            n = len(target)
            order = rng.permutation(n)
            batch = min(BATCH, max(LEAST_BATCH, -(-n // LEAST_STEPS)))
            self.seen["context"] += np.bincount(one, minlength=self.size + 1) + np.bincount(two, minlength=self.size + 1)
            self.seen["symbols"] += np.bincount(target // GROUP, minlength=len(self.groups))
            for k in ("first", "second", "groups"):
                self.seen[k] += n
            for at in range(0, n, batch):
                pick = order[at : at + batch]
                self._step(one[pick], two[pick], target[pick], squares)
        return self

    def _step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        order = np.argsort((target // GROUP).astype(np.uint16), kind="stable")  # a radix sort
        one, two, target = one[order], two[order], target[order]
        group, place = target // GROUP, target % GROUP
        n = len(target)
        before, last = self.context[one], self.context[two]
        predicted = np.ones((n, DIMENSIONS + 1), np.float32)
        predicted[:, :-1] = before @ self.first + last @ self.second

        def move(name: str, where, gradient: np.ndarray) -> None:  # Adagrad
            total = squares[name][where]
            total += gradient * gradient
            squares[name][where] = total
            getattr(self, name)[where] -= RATE * gradient / np.sqrt(total)

        def errors(vectors: np.ndarray, noise: np.ndarray, rows: slice, chosen: np.ndarray) -> np.ndarray:
            """Gradient of the scores: what the noise expects, less the data."""
            with np.errstate(divide="ignore"):
                inverse = 1 / (NOISE * noise)
            score = predicted[rows] @ -vectors.T
            np.exp(score, out=score)
            score += inverse
            np.reciprocal(score, out=score)  # weight x chance that it is data
            at = np.arange(len(chosen))
            score[at, chosen] -= 1 - score[at, chosen] * inverse[chosen]
            return score

        d = errors(self.groups, self.group_noise, slice(None), group)
        back = d @ self.groups[:, :-1]
        move("groups", slice(None), d.T @ predicted / n)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            g = int(group[a])
            d = errors(self.symbols[g], self.noise[g], slice(a, b), place[a:b])
            back[a:b] += d @ self.symbols[g][:, :-1]
            move("symbols", g, d.T @ predicted[a:b] / n)
        back /= n
        steps = (before.T @ back, last.T @ back)
        where = np.concatenate([one, two]).astype(np.uint16)
        both = np.concatenate([back @ self.first.T, back @ self.second.T])
        order = np.argsort(where, kind="stable")
        where, both = where[order], both[order]
        starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        move("context", where[starts], np.add.reduceat(both, starts, axis=0))
        move("first", slice(None), steps[0])
        move("second", slice(None), steps[1])

    def parameters(self) -> np.ndarray:
        """All vectors, one a row, each with its bias or 0."""
        plain = [np.pad(getattr(self, k), ((0, 0), (0, 1))) for k in ("context", "first", "second")]
        return np.concatenate([*plain, self.groups, self.symbols.reshape(-1, DIMENSIONS + 1)])

    def weights(self) -> np.ndarray:
        """How many tokens moved each row of ``parameters``."""
        ones = np.ones(DIMENSIONS)
        return np.concatenate([self.seen["context"], ones * self.seen["first"], ones * self.seen["second"], np.full(len(self.groups), self.seen["groups"]), np.repeat(self.seen["symbols"], GROUP)])

    def with_parameters(self, rows: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([self.size + 1, DIMENSIONS, DIMENSIONS, len(self.groups)])
        parts = np.split(rows.astype(np.float32), cuts)
        self.context, self.first, self.second = (np.ascontiguousarray(p[:, :-1]) for p in parts[:3])
        self.groups, self.symbols = parts[3], parts[4].reshape(self.symbols.shape)
        return self

    def log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of symbols after two others, by batched matrix products."""
        out = np.empty(len(target), np.float32)
        before, last = self.context @ self.first, self.context @ self.second

        def normalised(predicted: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            score = predicted @ vectors.T
            np.clip(score, -80, 80, out=score)
            own = score[np.arange(len(chosen)), chosen]
            np.exp(score, out=score)
            return own - np.log(score.sum(1))

        for at in range(0, len(target), CHUNK):
            part = slice(at, at + CHUNK)
            order = np.argsort((target[part] // GROUP).astype(np.uint16), kind="stable")
            goal = target[part][order]
            group, place = goal // GROUP, goal % GROUP
            predicted = np.ones((len(goal), DIMENSIONS + 1), np.float32)
            predicted[:, :-1] = before[one[part][order]] + last[two[part][order]]
            logs = normalised(predicted, self.groups, group)
            cuts = np.flatnonzero(np.diff(group)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(goal)], strict=True):
                logs[a:b] += normalised(predicted[a:b], self.symbols[group[a]], place[a:b])
            out[at + order] = logs
        return out / np.float32(np.log(10))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` all texts of a block, one after another, and where each text's begin, with the end of the last."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes().lower()
    folded = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])
    parts = pc.ascii_split_whitespace(folded)
    words, begins = parts.values.cast(pa.binary()), parts.offsets.to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return words.filter(some), kept[begins]


def _mapped(df: DataFrame, run, ddl: str) -> DataFrame:
    """mapInArrow over blocks of a batch."""
    bounded_batches(df.sparkSession)

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(block for batch in batches for block in blocks(batch))

    return df.mapInArrow(outer, ddl)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, held_out, text: each row has a number of its own, so repeated ids stay apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), (fold(id_col, FOLDS) == HELD).alias("held_out"), text.alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, total, train): how often each token occurs in all texts and in those not held out; the end token is ''."""
    schema = pa.schema([("word", pa.binary()), ("total", pa.int64()), ("train", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[pa.RecordBatch] = []

        def merged() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(tables, schema).group_by("word", use_threads=False).aggregate([("total", "sum"), ("train", "sum")])
            return table.select(["word", "total_sum", "train_sum"]).rename_columns(schema.names).cast(schema).combine_chunks().to_batches()

        for block in parts:
            words, begins = _words(block.column(1))
            held = block.column(0).to_numpy(zero_copy_only=False)
            found = words.dictionary_encode()
            at, n = found.indices.to_numpy(), len(found.dictionary)
            total, train = np.bincount(at, minlength=n), np.bincount(at[~np.repeat(held, np.diff(begins))], minlength=n)
            ends = [pa.array([END], pa.binary()), pa.array([len(held)], pa.int64()), pa.array([int((~held).sum())], pa.int64())]
            tables.append(pa.RecordBatch.from_arrays([found.dictionary, pa.array(total, pa.int64()), pa.array(train, pa.int64())], schema=schema))
            tables.append(pa.RecordBatch.from_arrays(ends, schema=schema))
            if sum(t.num_rows for t in tables) > 2 * TASK_WORDS:
                tables = merged()
                if sum(t.num_rows for t in tables) > TASK_WORDS:
                    yield from tables
                    tables = []
        if tables:
            yield from merged()

    counted = _mapped(rows.select("held_out", "text"), run, "word binary, total long, train long")
    # Few words are left twice in a task, so nothing is summed before the shuffle.
    return counted.repartition("word").groupBy("word").agg(F.sum("total").alias("total"), F.sum("train").alias("train"))


@dataclass
class Vocabulary:
    """What every task gets: the frequent words and the statistics of the symbols. Own symbols come first."""

    words: dict[bytes, int]  # frequent words; their position in the arrays
    symbols: np.ndarray
    train: np.ndarray
    n: int
    v: int
    own: int
    shared_n: np.ndarray
    shared_v: np.ndarray
    unigram: np.ndarray

    @cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.words), pa.binary())

    def base_log10(self, c):
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def within_log10(self, c, symbol):
        """log10 P(token | symbol); a symbol of one token gives it all."""
        k = np.maximum(symbol - self.own, 0)
        return np.where(symbol < self.own, 0.0, np.log10((c + 0.5) / (self.shared_n[k] + 0.5 * (self.shared_v[k] + 1))))

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, and positions of the frequent ones (else -1)."""
        at = pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        symbols = self.symbols[at]
        rare = np.flatnonzero(at < 0)
        symbols[rare] = self.own + shared_symbols(words.take(pa.array(rare)))
        return symbols, at


def vocabulary(counts: DataFrame, frequent: int = FREQUENT) -> Vocabulary:
    """From the written table of counts. Collects at most ``frequent`` words and one row for each shared symbol."""
    # Frequencies fall into at most 1000 classes; as many of the highest as hold no more words than allowed are taken.
    level = F.floor(F.log2("total") * 16)
    sizes = sorted(((r.level, r.n) for r in counts.where("total > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, taken = float("inf"), 0
    for at, n in sizes:
        taken += n
        if taken > frequent:
            break
        lowest = at
    top = counts.where((F.col("word") == F.lit(END)) | (F.col("total") > 0) & (level >= (lowest if sizes and lowest < float("inf") else 1 << 20))).toPandas()
    top["end"] = [bytes(w) != END for w in top["word"]]  # the end token comes first, ties go by the word
    top = top.sort_values(["end", "total", "word"], ascending=[True, False, True])
    words = [bytes(w) for w in top["word"]]
    train = top["train"].to_numpy(np.int64)
    own = [i for i in np.argsort(-train, kind="stable").tolist() if train[i] > 0][:OWN]
    if words and train[0] > 0 and 0 not in own:
        own[-1] = 0  # the end token has a symbol of its own
    symbols = np.array([len(own) + shared_symbol(w) for w in words], np.int64)
    symbols[own] = np.arange(len(own))
    known = counts.where("train > 0")
    shared_n, shared_v = np.zeros(SHARED), np.zeros(SHARED)
    for k, total, distinct in known.groupBy(_bucket("word").alias("k")).agg(F.sum("train"), F.count("*")).collect():
        shared_n[k], shared_v[k] = total, distinct
    n, v = int(shared_n.sum()), int(shared_v.sum())
    for i in own:  # words of their own do not count among those that share
        shared_n[shared_symbol(words[i])] -= train[i]
        shared_v[shared_symbol(words[i])] -= 1
    return Vocabulary({w: i for i, w in enumerate(words)}, np.append(symbols, -1), np.append(train, 0), n, v, len(own), shared_n, shared_v, np.concatenate([train[own], shared_n]))


_CODED = [
    ("row", "long", pa.int64()), ("id", "long", pa.int64()), ("held_out", "boolean", pa.bool_()), ("n_tokens", "long", pa.int64()), ("n_known", "long", pa.int64()), ("base", "double", pa.float64()),
    ("model", "double", pa.float64()), ("words", "array<binary>", pa.list_(pa.binary())), ("times", "array<long>", pa.list_(pa.int64())), ("symbols", "binary", pa.binary()),
]


def code(rows: DataFrame, shared) -> DataFrame:
    """One row for each text: its symbols, sums over its frequent words, and its other words with how often they occur."""
    schema = pa.schema([(name, kind) for name, _, kind in _CODED])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        base = np.append(vocab.base_log10(vocab.train[:-1]), 0.0)
        within = np.append(vocab.within_log10(vocab.train[:-1], vocab.symbols[:-1]), 0.0)
        known = np.append(vocab.train[:-1] > 0, False)
        for block in parts:
            words, begins = _words(block.column(3))
            n = block.num_rows
            found = words.dictionary_encode()
            end = len(found.dictionary)
            symbols, at = vocab.coded(pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())]))
            # Every text's words, then one end.
            begins = begins + np.arange(n + 1)
            tokens = np.full(begins[-1], end, np.int64)
            inner = np.ones(len(tokens), bool)
            inner[begins[1:] - 1] = False
            tokens[inner] = found.indices.to_numpy()
            sums = [np.add.reduceat(of[at][tokens], begins[:-1]) for of in (known.astype(np.int64), base, within)]
            rare = np.flatnonzero((at < 0)[tokens])
            owner = np.searchsorted(begins, rare, "right") - 1
            each, times = np.unique(owner * (end + 1) + tokens[rare], return_counts=True)
            cuts = pa.array(np.searchsorted(each, np.arange(n + 1) * (end + 1)).astype(np.int32))
            others = found.dictionary.take(pa.array(each % (end + 1)))
            coded = [None, pa.py_buffer((begins * 2).astype(np.int32)), pa.py_buffer(symbols[tokens].astype(np.uint16))]
            columns = [*block.columns[:3], np.diff(begins), *sums, pa.ListArray.from_arrays(cuts, others), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))]
            columns.append(pa.Array.from_buffers(pa.binary(), n, coded))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _mapped(rows, run, ", ".join(f"{name} {kind}" for name, kind, _ in _CODED))


def _tokens(texts: list[bytes], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol before last, last symbol, symbol) of all tokens of coded texts, and where each text begins."""
    parts = [np.frombuffer(t, np.uint16) for t in texts]
    begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1].astype(np.int64)
    target = np.concatenate(parts).astype(np.int64)
    one, two = np.empty_like(target), np.empty_like(target)
    two[1:], one[2:] = target[:-1], target[:-2]
    one[:2] = two[:1] = start
    one[begins] = two[begins] = start
    after = begins + 1
    one[after[after < len(one)]] = start  # a text's second token; of a text of one token, the next text's first
    return one, two, target, begins


def fit(texts: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """Trains on the column ``symbols`` of coded texts: every task on its share, then the average."""
    model = LogBilinear(vocab.unigram)
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"v{i}" for i in range(DIMENSIONS + 1)]
    schema = pa.schema([("at", pa.int32()), ("weight", pa.float64()), *[(v, pa.float64()) for v in names]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copy import deepcopy

        first = shared.value.parameters()
        own = deepcopy(shared.value).train(_tokens(block.column(0).to_pylist(), shared.value.start)[:3] for block in parts)
        weights = own.weights()
        moved = np.flatnonzero(weights)
        change = (own.parameters()[moved] - first[moved]).astype(np.float64) * weights[moved, None]
        yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), pa.array(weights[moved]), *[pa.array(c) for c in change.T.copy()]], schema=schema)

    moved = _mapped(texts.select("symbols"), run, "at int, weight double, " + ", ".join(f"{v} double" for v in names))
    rows = moved.groupBy("at").agg(*[F.sum(c).alias(c) for c in ["weight", *names]]).toPandas()  # at most one row for each vector of the model
    parameters = model.parameters().astype(np.float64)
    parameters[rows["at"].to_numpy()] += rows[names].to_numpy() / rows[["weight"]].to_numpy()
    return model.with_parameters(parameters)


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, DataFrame, LogBilinear]:
    """Counts of words, vocabulary, coded texts and the model of the texts that are not held out."""
    rows = _rows(docs, id_col, text_col)
    counts = materialize(word_counts(rows), "lm-counts")
    vocab = vocabulary(counts)
    coded = materialize(code(rows, docs.sparkSession.sparkContext.broadcast(vocab)), "lm-coded")
    return counts, vocab, coded, fit(coded.where("not held_out"), vocab)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Null and empty texts consist of the end token. Without training texts the model stays at its start.
    """
    spark = docs.sparkSession
    counts, vocab, coded, fitted = trained(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(fitted)
    names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "model"]
    schema = pa.schema([(name, kind) for name, _, kind in _CODED if name in names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            *tokens, begins = _tokens(block.column(len(names)).to_pylist(), model.value.start)
            sums = np.add.reduceat(model.value.log10(*tokens).astype(np.float64), begins)
            columns = block.columns[: len(names)]
            columns[-1] = pa.array(columns[-1].to_numpy() + sums)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    scored = _mapped(coded.select(*names, "symbols"), run, ", ".join(f"{name} {kind}" for name, kind, _ in _CODED if name in names))
    lines = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("line")).select("row", F.col("line.words").alias("word"), F.col("line.times").alias("times"))
    others = counts.where("train > 0").select("word", "train")
    joined = lines.join(others, "word", "left").withColumn("c", F.coalesce("train", F.lit(0)).cast("double"))
    weights = F.split(F.lit(",".join(repr(float(x)) for x in vocab.shared_n + 0.5 * (vocab.shared_v + 1))), ",").cast("array<double>")
    whole = float(vocab.n + 0.5 * (vocab.v + 1))
    each = joined.select(
        "row",
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("k"),
        (F.col("times") * F.log10((F.col("c") + 0.5) / whole)).alias("b"),
        (F.col("times") * F.log10((F.col("c") + 0.5) / F.get(weights, _bucket("word")))).alias("m"),
    )
    # A text's words come from many tasks, so nothing is summed before the shuffle.
    of_rare = each.repartition("row").groupBy("row").agg(*[F.sum(c).alias(c) for c in "kbm"])
    summed = scored.join(of_rare, "row", "left").select("id", "held_out", "n_tokens", *[(F.col(c) + F.coalesce(x, F.lit(0))).alias(name) for c, x, name in (("n_known", "k", "n_known"), ("base", "b", "base_score"), ("model", "m", "score"))])
    return summed.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(vocab.n)).cast("long").alias("train_tokens"), "base_score", "score")
