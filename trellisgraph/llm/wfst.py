"""SentencePiece encoding and decoding as weighted finite-state transduction.

Transducers are compiled from a model file:

* ``Normaliser`` maps text to escaped text: the model's character map (longest match), white space, dummy prefix;
* ``Pieces`` is a trie whose states read characters; a state that ends a piece leads back to the root, writes the piece's id
  and weighs its negative score (unigram models) or 0 (BPE models);
* byte fallback reads one character that no piece covers and writes the ids of its UTF-8 bytes (or the unknown id);
* for BPE models, ``Neighbours`` reads ids; its state is the last one, and an arc weighs 0 if merging the characters of the
  two pieces in rank order gives exactly these two pieces, else infinity. A sequence whose neighbours all satisfy this is the
  one that greedy merging produces, so the only path of finite weight is the library's encoding.

A text is composed with them lazily: a state of the composition is a position, the trie's root, and the last symbol. The
encoding is the shortest path in the tropical semiring (minimum, plus). With weights, states are settled in the order of
their positions, each with its least sum; where all finite arcs weigh 0, best-first search settles any open state next.

User-defined symbols are read as they stand and merge with nothing. No piece has U+2581 after another character, so the
composition falls apart into words, whose paths are remembered up to a bound. Texts are encoded whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FORGET, per_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words and pairs of pieces that a task remembers.
WORD_CACHE, PAIR_CACHE, LONGEST_CACHED = 200_000, 400_000, 64
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(field number, value) of a serialised message: numbers, or bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Normaliser:
    """The first transducer. Its state: whether the last character written is white space, which may have to go at the end."""

    def __init__(self, spec: dict, user: re.Pattern | None):
        self.dummy_prefix, self.trim, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        self.user = user
        self.units, self.targets = (), b""
        if spec.get(2):
            (size,) = struct.unpack_from("<I", spec[2])
            self.units, self.targets = struct.unpack_from(f"<{size // 4}I", spec[2], 4), spec[2][4 + size :]

    def mapped(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """(end, text) of the longest rule of the character map that begins here; the map is a double-array trie."""
        units, found = self.units, (at, None)
        if not units:
            return found

        def offset(unit: int) -> int:
            return unit >> 10 << ((unit & 1 << 9) >> 6)

        node = offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = end + 1, self.targets[begin : self.targets.index(b"\0", begin)]
        return found

    def arcs(self, text: str) -> Iterator[str]:
        """What each arc on the path of a text writes, before white space is seen to."""
        if not self.units:
            yield from self.user.split(text) if self.user else text
            return
        for i, part in enumerate(self.user.split(text) if self.user else [text]):
            if i % 2:
                yield part
                continue
            data, at = part.encode("utf-8", "surrogatepass"), 0
            while at < len(data):
                end, target = self.mapped(data, at)
                if target is None:
                    first = data[at]
                    end = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
                    target = data[at:end]
                yield target.decode("utf-8", "replace")
                at = end

    def write(self, text: str) -> str:
        """The text that the transducer writes for a whole text."""
        space = SPACE if self.escape else " "
        out: list[str] = []
        after_space = self.trim
        for part in self.arcs(text):
            if after_space:
                part = part.lstrip(" ")
            if self.trim:
                part = re.sub("  +", " ", part)
            if part:
                if not out and self.dummy_prefix:
                    out.append(space)
                out.append(part.replace(" ", space))
                after_space = self.trim and part[-1] == " "
        whole = "".join(out)
        if self.trim:
            while whole.endswith(space):
                whole = whole[: -len(space)]
        return whole


class Pieces:
    """The second transducer: a trie from characters to ids. State 0 is the root."""

    def __init__(self, pieces: dict[str, int]):
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: list[int] = [-1]
        for piece, i in pieces.items():
            state = 0
            for c in piece:
                following = self.arcs[state].get(c)
                if following is None:
                    following = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.writes.append(-1)
                state = following
            self.writes[state] = i


class Neighbours:
    """The last transducer of BPE models: state and input are symbols, a piece's id or, of other characters, -2 - code point."""

    def __init__(self, pieces: list[str], ids: dict[str, int], scores: list[float]):
        self.pieces, self.ids, self.scores = pieces, ids, scores
        self.known: dict[int, bool] = {}

    def text(self, symbol: int) -> str:
        return self.pieces[symbol] if symbol >= 0 else chr(-2 - symbol)

    def merged(self, text: str) -> list[str]:
        """Greedy merging in rank order; defines which symbols may be neighbours."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def finite(self, last: int, symbol: int) -> bool:
        """Whether the arc of a symbol weighs 0 rather than infinity; last is -1 at the start."""
        key = last << 32 ^ symbol
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= PAIR_CACHE:
                self.known.clear()
            pair = [self.text(symbol)] if last == -1 else [self.text(last), self.text(symbol)]
            known = self.known[key] = self.merged("".join(pair)) == pair
        return known


class Transducer:
    """A compiled model; an instance remembers words."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.byte_fallback = UNIGRAM, False
        spec: dict = {}
        for number, value in _fields(model):
            if number == 1:
                own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0])
                self.kinds.append(own[3])
            elif number == 2:
                trainer = dict(_fields(value))
                self.model_type, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
        if self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.bytewise = self.byte_fallback and len(self.byte_ids) == 256
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        user = [i for i, k in enumerate(self.kinds) if k == USER_DEFINED]
        self.ids = {self.pieces[i]: i for i in normal}
        self.user = {self.pieces[i]: i for i in user}
        whole = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if user else None
        self.normaliser = Normaliser(spec, whole)
        self.trie = Pieces(self.ids if self.model_type == BPE else self.ids | self.user)
        self.neighbours = Neighbours(self.pieces, self.ids, self.scores) if self.model_type == BPE else None
        self.apart = whole if self.model_type == BPE else None
        self.lowest = min((self.scores[i] for i in normal), default=0.0)
        highest = max((self.scores[i] for i in normal), default=0.0)
        self.weights = [-s for s in self.scores] if self.model_type == UNIGRAM else [0.0] * len(self.scores)
        for i in user:  # always worth more than what they are made of
            self.weights[i] = 0.1 - len(self.pieces[i]) * highest
        crossing = any(SPACE in self.pieces[i].lstrip(SPACE) for i in [*normal, *user])
        self.parts = re.compile(r"(?s).+" if crossing else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Whether each word between single spaces becomes a space and the word, on a path of its own.
        self.plain = not crossing and not user and not self.normaliser.units and self.normaliser.dummy_prefix and self.normaliser.escape
        self.words = _Words(self)
        # Decoding: the bytes of each piece, end to end.
        raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.concatenate(([0], np.cumsum(self.raw_sizes)[:-1]))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.dummy_prefix = self.normaliser.dummy_prefix

    def fallback(self, char: str) -> list[int]:
        """What byte fallback writes for a character."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytewise else [self.unknown]

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the ways from a position back to the trie's root, shortest first; piece -1 is byte fallback."""
        found, state = [], 0
        arcs, writes = self.trie.arcs, self.trie.writes
        for end in range(at, len(text)):
            state = arcs[state].get(text[end], 0)
            if not state:
                break
            if writes[state] >= 0:
                found.append((end + 1, writes[state]))
        if not found or found[0][0] != at + 1:
            found.insert(0, (at + 1, -1))
        return found

    def shortest(self, text: str) -> list[tuple[int, int]]:
        """(end, piece) on the shortest path of normalised text through the composition."""
        return self._zero_path(text) if self.neighbours else self._least_path(text)

    def _zero_path(self, text: str) -> list[tuple[int, int]]:
        """Best-first search where all finite arcs weigh 0: all open states weigh the same, so the last one reached, by the
        longest arc, is settled first; each state (position, last symbol) is settled once."""
        n, known = len(text), self.neighbours.known.get
        path: list[tuple[int, int]] = []
        states, opened, settled = [-1], [self.arcs(text, 0)] if n else [], set()
        while opened:
            last, arcs = states[-1] << 32, opened[-1]
            while arcs:
                end, piece = arcs.pop()
                state = piece if piece >= 0 else -2 - ord(text[end - 1])
                finite = known(last ^ state)
                if finite is None:
                    finite = self.neighbours.finite(states[-1], state)
                if finite and (end, state) not in settled:
                    path.append((end, piece))
                    if end == n:
                        return path
                    settled.add((end, state))
                    states.append(state)
                    opened.append(self.arcs(text, end))
                    break
            else:
                opened.pop()
                states.pop()
                if path:
                    path.pop()
        return path

    def _least_path(self, text: str) -> list[tuple[int, int]]:
        """Arcs with weights, one state at each position: least sums in the order of positions; of equal ones the first found."""
        n, weights = len(text), self.weights
        best = [0.0] + [float("inf")] * n
        before: list[tuple[int, int]] = [(-1, -1)] * (n + 1)
        for at in range(n):
            for end, piece in self.arcs(text, at):
                total = best[at] + (weights[piece] if piece >= 0 else 10.0 - self.lowest)
                if total < best[end]:
                    best[end], before[end] = total, (at, piece)
        path, at = [], n
        while at:
            path.append((at, before[at][1]))
            at = before[at][0]
        return path[::-1]

    def path(self, text: str) -> list[int]:
        """What the composition writes on the shortest path of normalised text."""
        out: list[int] = []
        for i, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if i % 2:
                out.append(self.user[part])
                continue
            at = 0
            for end, piece in self.shortest(part):
                out.extend([piece] if piece >= 0 else self.fallback(part[at:end]))
                at = end
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, as int32."""
        if self.plain and SPACE not in text and "" not in (parts := text.split(" ")):
            return np.frombuffer(b"".join(map(self.words.__getitem__, parts)), np.int32)
        normal = self.normaliser.write(text)
        if not normal:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(self.words[p[1:]] if p[0] == SPACE else np.array(self.path(p), np.int32).tobytes() for p in self.parts.findall(normal)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one for each."""
        if not len(ids):
            return ""
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        index = np.repeat(self.raw_starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        text = self.raw[index].tobytes()
        if self.dummy_prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


class _Words(dict):
    """Paths of words that begin with a space, by the word without it; as int32 bytes. Two generations, each bounded."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = np.array(self.transducer.path(SPACE + word), np.int32).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= WORD_CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Transducer:
    """One transducer for each model and worker process, which serves many tasks."""
    return Transducer(model)


FORGET[__name__] = _loaded.cache_clear


def encode(docs: DataFrame, keep: list[str], model_file: str = DEFAULT_MODEL, text_col: str = "text") -> DataFrame:
    """``keep`` plus ids, n_tokens and decoded, for every row; null and empty texts have no ids and decode to ''.

    Decoding gives the text back, but for U+2581 in it, which the format reads as a space.

    The model file is read once on the driver and sent to the executors (half a megabyte).
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        transducer = _loaded(shared.value)

        def apply(texts):
            ids = [transducer.encode(t.decode()) for t in texts]
            sizes = np.array([len(i) for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(ids)))
            return {"ids": lists, "n_tokens": sizes, "decoded": [transducer.decode(i) for i in ids]}

        return apply

    return per_text(docs, "ids array<int>, n_tokens bigint, decoded string", make, keep, text_col)
