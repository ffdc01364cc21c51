"""Language identification with a byte convolutional network, trained in numpy.

Texts become fixed-length windows of ``WINDOW`` bytes that cover the whole text (consecutive windows overlap by one byte less
than the widest filter; the last is padded with zeros). Bytes are embedded, filters of several widths slide over every
position of the window, each filter keeps its maximum over the window after a rectifier, and a softmax gives the languages'
probabilities. A text's log-probabilities are the mean over its windows, weighted by their letters.

Training uses a bounded, documented sample of labelled rows: about ``SAMPLE_ROWS`` of the training folds, chosen by the hash of the
id (never over twice as many). Of each whole text the executors draw ``TEXT_WINDOWS`` windows by a hash, in proportion to
their letters; a quarter of them is cut short at a random length, so that short texts are learned as well. Texts of any length
train. Everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, per_text

WINDOW = 128
WIDTHS = (2, 4, 6)
FILTERS = 12
EMBED = 8
SAMPLE_ROWS = 4000
TEXT_WINDOWS = 3
#: Passes over the windows, and mini-batches of training at least.
EPOCHS, LEAST_STEPS = 8, 300
FOLDS, HELD = 3, 1
UNDETERMINED = "und"
#: Windows whose convolutions are in memory at once.
CHUNK = 256

_STEP = WINDOW - max(WIDTHS) + 1
_POSITIONS = _STEP


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover a text, so that every byte starts one span of each filter; an empty text has none."""
    if not text:
        return np.empty((0, WINDOW), np.uint8)
    n = -(-len(text) // _STEP)
    padded = np.zeros(_STEP * (n - 1) + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = 1
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text holds a character of Unicode category L."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def training_windows(text: bytes, n: int = TEXT_WINDOWS) -> list[bytes]:
    """Windows of a whole text drawn by its hash, in proportion to their letters; every fourth draw is cut short."""
    if not has_letter(text):
        return []
    windows = windows_of(text)
    weights = _LETTER[windows].sum(1) + 1e-3
    rng = np.random.default_rng(zlib.crc32(text))
    picked = windows[rng.choice(len(windows), n, p=weights / weights.sum())].copy()
    for row in np.flatnonzero(rng.random(n) < 0.25):
        picked[row, rng.integers(4, WINDOW) :] = 0
    return [w.tobytes() for w in picked]


class ByteConvolution:
    """The network. ``embed`` (256, E), ``filters`` (widest * E, F) with zeros beyond each filter's width, ``bias``,
    ``out`` (F, languages), ``out_bias``."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self._tables: list[np.ndarray] | None = None
        f = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.mask = np.repeat(np.concatenate([(np.arange(max(WIDTHS))[:, None] < w) * np.ones((1, FILTERS)) for w in WIDTHS], axis=1), EMBED, axis=0).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, (max(WIDTHS) * EMBED, f)) * self.mask).astype(np.float32)
        self.bias = np.zeros(f, np.float32)
        self.out = rng.normal(0, 0.1, (f, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(n, positions, widest * E)."""
        e = self.embed[windows]  # n, WINDOW, E
        view = np.lib.stride_tricks.sliding_window_view(e, max(WIDTHS), axis=1)  # n, P, E, widest
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(windows), _POSITIONS, -1)

    def pair_tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to every filter at the first, second, ... pair of its span: the convolution of
        all possible inputs, so that applying it is a sum of lookups."""
        if self._tables is None:
            low, high = np.arange(65536) & 255, np.arange(65536) >> 8
            pairs = np.concatenate([self.embed[low], self.embed[high]], axis=1)
            self._tables = [pairs @ self.filters[2 * EMBED * i : 2 * EMBED * (i + 1)] for i in range(max(WIDTHS) // 2)]
        return self._tables

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, languages), in batches."""
        tables = self.pair_tables()
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), CHUNK):
            part = windows[at : at + CHUNK].astype(np.intp)
            pairs = part[:, :-1] | part[:, 1:] << 8
            conv = tables[0][pairs[:, :_POSITIONS]]
            for i, table in enumerate(tables[1:], 1):
                conv += table[pairs[:, 2 * i : 2 * i + _POSITIONS]]
            out[at : at + CHUNK] = _log_softmax(np.maximum(conv.max(1) + self.bias, 0) @ self.out + self.out_bias)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128, seed: int = 2) -> ByteConvolution:
        """Adam on cross-entropy."""
        self._tables = None
        rng = np.random.default_rng(seed)
        names = ["embed", "filters", "bias", "out", "out_bias"]
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(windows)))) if len(windows) > batch else max(epochs, LEAST_STEPS)
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            speed = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients(windows[pick], labels[pick])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    getattr(self, k)[...] -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n = len(windows)
        patches = self._patches(windows)
        conv = patches @ self.filters
        best = conv.argmax(1)  # n, F
        pooled = np.take_along_axis(conv, best[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        d = np.exp(_log_softmax(hidden @ self.out + self.out_bias))
        d[np.arange(n), labels] -= 1
        d /= n
        back = (d @ self.out.T) * (pooled > 0)  # n, F
        chosen = patches[np.arange(n)[:, None], best]  # n, F, widest * E
        g_filters = np.einsum("nfe,nf->ef", chosen, back) * self.mask
        g_chosen = back[:, :, None] * self.filters.T[None]  # n, F, widest * E
        g_embed = np.zeros_like(self.embed)
        at = best[:, :, None] + np.arange(max(WIDTHS))
        np.add.at(g_embed, windows[np.arange(n)[:, None, None], at].ravel(), g_chosen.reshape(-1, EMBED))
        return {"embed": g_embed, "filters": g_filters, "bias": back.sum(0), "out": hidden.T @ d, "out_bias": d.sum(0)}

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and probability of whole texts; a text without letters is undetermined, with score 0."""
        parts = [windows_of(t) if has_letter(t) else windows_of(b"") for t in texts]
        counts = np.array([len(p) for p in parts])
        total = np.zeros((len(texts), len(self.languages)))
        if counts.sum():
            stacked = np.concatenate(parts)
            weights = _LETTER[stacked].sum(1) + 1e-3
            owner = np.repeat(np.arange(len(texts)), counts)
            logs = self.log_probabilities(stacked)
            mass = np.bincount(owner, weights, len(texts))
            for j in range(len(self.languages)):
                total[:, j] = np.bincount(owner, logs[:, j] * weights, len(texts)) / np.maximum(mass, 1e-9)
        p = np.exp(_log_softmax(total))
        best = p.argmax(1)
        return (
            [self.languages[b] if c else UNDETERMINED for b, c in zip(best.tolist(), counts.tolist(), strict=True)],
            [float(p[i, b]) if c else 0.0 for i, (b, c) in enumerate(zip(best.tolist(), counts.tolist(), strict=True))],
        )


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD) -> ByteConvolution:
    """Train on a bounded sample of the rows whose fold is not ``held`` and whose language is known.

    No labelled row with a letter at all gives a network that knows only the undetermined language.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), fold(id_col, folds).alias("fold"))
    known = rows.where((F.col("fold") != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "lang", "text")
    sample = bounded_sample(known, "id", SAMPLE_ROWS)

    def make():
        return lambda texts: {"windows": [training_windows(t) for t in texts]}

    drawn = per_text(sample, "windows array<binary>", make, ["lang"]).select("lang", F.explode("windows").alias("window")).toPandas()
    drawn = drawn.sort_values(["lang", "window"])  # at most TEXT_WINDOWS of each sampled row
    languages = sorted(set(drawn["lang"]))
    if not languages:
        return ByteConvolution([UNDETERMINED])
    windows = np.frombuffer(b"".join(drawn["window"]), np.uint8).reshape(-1, WINDOW)
    return ByteConvolution(languages).train(windows, np.searchsorted(languages, drawn["lang"].to_numpy(str)))


def identify(docs: DataFrame, model: ByteConvolution, keep: list[str], text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``keep`` plus the predicted language and its score (0 to 1) for every whole text; null and letterless texts: ``und`` and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def make():
        def apply(texts):
            lang, score = shared.value.predict(texts)
            return {lang_name: lang, score_name: score}

        return apply

    return per_text(docs, f"{lang_name} string, {score_name} double", make, keep, text_col)
