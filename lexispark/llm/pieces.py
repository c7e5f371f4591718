"""SentencePiece BPE encoding and decoding with numpy, from the model file alone.

Encoding follows the library: a blank is put before the text, blanks become U+2581, and of all neighbours that make a piece
the best scored ones merge first, the leftmost first among equals, until none is left; characters outside of the
vocabulary become bytes. The words of many texts lie in one flat array of symbols. Each round finds the best rank of a
pair in every word (a segmented minimum), merges the pairs of that rank from the left, all of them where that can't
change what the merges one after another give, and takes out the symbols that were merged away and the words that are done.

Words are cut where no piece can reach across: before blanks, and around ASCII characters that are in no longer piece.
Words of over LONG symbols, for which rounds would be quadratic, use a queue of pairs instead; the result is the same.
A worker keeps the ids of up to CACHE words. Texts are worked on in slices of about SLICE characters, so that memory besides
the text and its ids is bounded.

Defined cases: a null text counts as an empty one, which has no ids and decodes to an empty text; U+2581 in a text decodes
to a blank, as in the library; a null id in a list of ids is no piece; invalid bytes decode to U+FFFD, one for each byte;
extra columns pass through, and those named like the added ones are replaced.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: U+2581, which stands for a blank in pieces.
SPACE = "▁"
#: Symbols from which a word goes to the queue, words whose ids a worker keeps (of SHORT characters at most), and characters of a slice.
LONG, CACHE, SHORT, SLICE = 4096, 400_000, 64, 1 << 18
#: Fixed values of the model format: kinds of pieces, and the kind of model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE, BPE = 1, 2, 3, 4, 5, 6, 2
_NONE = np.iinfo(np.int32).max

_models: dict[str, "Model"] = {}

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def model(path: str) -> "Model":
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """The pieces of a model file, as tables."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, normaliser = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        pieces = [dict(_fields(v)) for k, v in parts if k == 1]
        names = [p[1].decode() for p in pieces]
        kinds = np.array([p.get(3, NORMAL) for p in pieces])
        self._check(trainer, normaliser, kinds)
        self.size = len(names)
        scores = np.array([struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces])
        #: A lower rank merges first; equal scores share a rank.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        normal = {names[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_ids[int(names[i][1:-1], 16)] = i

        # Symbols: pieces, and behind them characters that are no pieces but part of some.
        longer = [n for n in normal if len(n) > 1]
        inside = set().union(*longer)
        extra = sorted(inside - set(normal))
        symbols = normal | {c: self.size + i for i, c in enumerate(extra)}
        alphabet = sorted(c for c in symbols if len(c) == 1)
        self.codes = np.array([ord(c) for c in alphabet], np.uint32)
        self.code_symbols = np.array([symbols[c] for c in alphabet], np.int32)
        self.extra_codes = np.array([ord(c) for c in extra], np.uint32)
        pairs = {}
        unsafe = np.zeros(int(self.rank.max(initial=0)) + 1, bool)
        for name in longer:
            own = normal[name]
            for at in range(1, len(name)):
                left, right = symbols.get(name[:at]), symbols.get(name[at:])
                if left is None or right is None:
                    continue
                pairs[left << 32 | right] = own
                for part in (left, right):
                    # Where a merge makes a pair that comes no later, the next of the same rank may not be the next to merge.
                    if part < self.size and self.rank[own] <= self.rank[part]:
                        unsafe[self.rank[part]] = True
        order = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_pieces = order, np.array([pairs[k] for k in order.tolist()], np.int32)
        self.safe = ~unsafe

        lone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in inside and chr(c) != " "))
        across = any(SPACE in n.lstrip(SPACE) for n in longer)
        self.words = (lambda s: [s]) if across else re.compile(f" +[^ {lone}]*|[^ {lone}]+|[{lone}]" if lone else " +[^ ]*|[^ ]+").findall
        self.cut = None if across else re.compile("(?<! ) ")

        surfaces = [b"" if k == CONTROL else bytes([int(n[1:-1], 16)]) if k == BYTE else trainer.get(44, " ⁇ ".encode()) if k == UNKNOWN else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.lengths = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.surfaces = np.frombuffer(b"".join(surfaces), np.uint8)
        self.is_control, self.is_byte = kinds == CONTROL, kinds == BYTE
        self.spaced = np.array([n.startswith(SPACE) for n in names]) & (kinds == NORMAL)
        self.held: dict[str, bytes] = {}

    @staticmethod
    def _check(trainer: dict, normaliser: dict, kinds: np.ndarray) -> None:
        plain = not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or not plain or np.isin(kinds, (USER_DEFINED, UNUSED)).any():
            raise ValueError("only BPE models with byte fallback, a blank put before and no other normalisation are supported")

    # Encoding.

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) that neighbours make; the rank is _NONE where they make none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        piece = self.pair_pieces[at]
        return piece, np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.rank[piece], _NONE)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of characters; -1 - code of those that are in no piece."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_symbols[at], -1 - codes.astype(np.int64)).astype(np.int32)

    def merge_rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, words) after all merges; ``word`` is the number of each symbol's word, rising."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        piece, rank = np.zeros(len(sym), np.int32), np.full(len(sym), _NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        piece[inner], rank[inner] = self.pair(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            ready = least == _NONE
            if ready.any():
                out = np.repeat(ready, sizes)
                done.append((sym[out], word[out]))
                sym, word, piece, rank = (x[~out] for x in (sym, word, piece, rank))
                least, sizes = least[~ready], sizes[~ready]
                if not len(sym):
                    break
            pos = np.flatnonzero(rank == np.repeat(least, sizes))
            ahead = np.diff(pos, prepend=-2)
            # Of pairs that overlap the first, third and so on merge; of a rank that isn't safe the first in each word.
            run = np.maximum.accumulate(np.where(ahead != 1, np.arange(len(pos)), 0))
            leading = np.append(True, word[pos[1:]] != word[pos[:-1]])
            at = pos[((np.arange(len(pos)) - run) % 2 == 0) & (leading | self.safe[rank[pos]])]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, piece, rank = (x[keep] for x in (sym, word, piece, rank))
            now = at - np.arange(len(at))
            near = np.concatenate([now - 1, now])
            near = near[near >= 0]
            last = near + 1 >= len(sym)
            inside = ~last & (word[near] == word[np.where(last, near, near + 1)])
            rank[near[~inside]] = _NONE
            near = near[inside]
            piece[near], rank[near] = self.pair(sym[near], sym[near + 1])
        if not done:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def merge_queue(self, sym: np.ndarray) -> np.ndarray:
        """The same for one long word, by a queue of pairs (rank, place)."""
        own = sym.tolist()
        n = len(own)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        piece, rank = (x.tolist() for x in self.pair(sym[:-1], sym[1:]))
        queue = [(r, i, own[i], own[i + 1], p) for i, (p, r) in enumerate(zip(piece, rank, strict=True)) if r != _NONE]
        heapq.heapify(queue)
        keys = self._pairs()
        ranks = self._ranks

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and own[i] >= 0 and own[j] >= 0 and (made := keys.get(own[i] << 32 | own[j])) is not None:
                heapq.heappush(queue, (ranks[made], i, own[i], own[j], made))

        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if own[i] != left or j < 0 or own[j] != right:
                continue
            own[i], own[j] = made, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([x for x in own if x is not None], np.int32)

    def _pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pair_map"):
            self._pair_map, self._ranks = dict(zip(self.pair_keys.tolist(), self.pair_pieces.tolist(), strict=True)), self.rank.tolist()
        return self._pair_map

    def _ids(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each symbol); what is no piece becomes bytes."""
        unknown = (sym < 0) | (sym >= self.size)
        if not unknown.any():
            return sym, np.ones(len(sym), np.int64)
        odd = sym[unknown].astype(np.int64)
        codes = np.where(odd < 0, -1 - odd, self.extra_codes[np.clip(odd - self.size, 0, len(self.extra_codes) - 1)] if len(self.extra_codes) else 0).astype("<u4")
        counts = np.ones(len(sym), np.int64)
        counts[unknown] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        out = np.empty(counts.sum(), np.int32)
        is_byte = np.repeat(unknown, counts)
        out[is_byte] = self.byte_ids[np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)]
        out[~is_byte] = sym[~unknown]
        return out, counts

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols(np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4"))
        word = np.repeat(np.arange(len(words)), sizes)
        if sizes.max() > LONG:
            ends = np.cumsum(sizes)
            long = np.flatnonzero(sizes > LONG)
            apart = [self.merge_queue(sym[ends[i] - sizes[i] : ends[i]]) for i in long]
            short = ~np.repeat(sizes > LONG, sizes)
            rest, of = self.merge_rounds(sym[short], word[short])
            sym, word = np.concatenate([rest, *apart]), np.concatenate([of, *(np.full(len(a), i) for i, a in zip(long, apart, strict=True))])
            order = np.argsort(word, kind="stable")
            sym, word = sym[order], word[order]
        else:
            sym, word = self.merge_rounds(sym, word)
        ids, counts = self._ids(sym)
        ends = np.cumsum(np.bincount(word, counts, len(words)).astype(np.int64) * 4).tolist()
        data = ids.astype("<i4").tobytes()
        return dict(zip(words, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _joined(self, parts: list[str]) -> list[bytes]:
        """The ids of slices of texts, each of whole words, as bytes."""
        split = [self.words(p) for p in parts]
        held = self.held
        new = {w for words in split for w in words if w not in held}
        if len(held) + len(new) > CACHE:
            held.clear()
            new = {w for words in split for w in words}
        if not new:
            return [b"".join(map(held.__getitem__, words)) for words in split]
        learnt = self._learn(list(new))
        short = {w: ids for w, ids in learnt.items() if len(w) <= SHORT}
        held.update(short)
        get = held.__getitem__ if len(short) == len(learnt) else (held | learnt).__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _slices(self, text: str) -> Iterator[str]:
        text, at = " " + text.replace(SPACE, " "), 0
        while self.cut and len(text) - at > SLICE and (found := self.cut.search(text, at + SLICE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        of: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for part in self._slices(text) if text else ():
                parts.append(part)
                of.append(i)
                size += len(part)
                if size > SLICE:
                    for k, ids in zip(of, self._joined(parts), strict=True):
                        out[k].append(ids)
                    parts, of, size = [], [], 0
        if parts:
            for k, ids in zip(of, self._joined(parts), strict=True):
                out[k].append(ids)
        return [np.frombuffer(b"".join(x), "<i4") for x in out]

    # Decoding.

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of ids that lie one after another; ``ends`` has the list's borders, from 0."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside of the vocabulary")
        lengths = self.lengths[ids]
        until = np.concatenate([[0], np.cumsum(lengths)])
        data = np.empty(until[-1], np.uint8)
        for at in range(0, len(ids), SLICE):
            part = slice(at, min(at + SLICE, len(ids)))
            low, high = until[part.start], until[part.stop]
            data[low:high] = self.surfaces[np.repeat(self.starts[ids[part]] - until[part], lengths[part]) + np.arange(low, high)]
        # One blank that stands for the start of the text goes.
        real = np.flatnonzero(~self.is_control[ids])
        low, high = until[ends[:-1]].copy(), until[ends[1:]]
        at = np.searchsorted(real, ends[:-1])
        has = at < len(real)
        leading = real[np.minimum(at, len(real) - 1)] if len(real) else np.zeros(len(at), np.int64)
        if len(ids):
            low += has & (leading < ends[1:]) & self.spaced[ids[leading]]
        if not (self.is_byte[ids] & (data[until[:-1].clip(max=max(len(data) - 1, 0))] >= 0x80)).any() if len(data) else True:
            return self._strings(data, low, high)
        # Bytes make a character only where no control piece stands between them.
        raw, breaks = data.tobytes(), until[np.flatnonzero(self.is_control[ids])]
        texts = []
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            at = [a, *breaks[(breaks > a) & (breaks < b)].tolist(), b]
            texts.append("".join(raw[i:j].decode("utf-8", "each_byte") for i, j in zip(at[:-1], at[1:], strict=True)))
        return pa.array(texts, pa.string())

    @staticmethod
    def _strings(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
        keep = np.ones(len(data), bool)
        keep[(low - 1)[(low > 0) & (low > np.append(0, high[:-1]))]] = False
        offsets = np.concatenate([[0], np.cumsum(high - low)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(low), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))


def _encoded(texts: pa.Array, own: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids one after another, borders) in runs of rows of bounded size."""
    start, size = 0, 0
    for row in range(len(texts)):
        size += len(texts[row].as_py() or "") if len(texts) < 2 else (texts[row].as_buffer().size if texts[row].is_valid else 0)
        if size > 4 * SLICE or row == len(texts) - 1:
            ids = own.encode(texts.slice(start, row + 1 - start).to_pylist())
            yield start, np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            start, size = row + 1, 0


def _map(frame: DataFrame, col: str, names: list[tuple[str, T.DataType]], run: Callable) -> DataFrame:
    """``frame`` with columns named ``names`` that ``run`` yields from the column ``col``, in Arrow batches."""
    added = {n.lower() for n, _ in names}
    keep = [c for c in frame.columns if c.lower() not in added]
    plain = frame.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{col}`").alias("__in")) if "__in" not in keep else None
    if plain is None:
        raise ValueError("a column may not be named __in")
    schema = T.StructType([f for f in plain.schema.fields if f.name != "__in"] + [T.StructField(n, t) for n, t in names])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            for row, columns in run(batch.column(batch.num_columns - 1)):
                size = len(columns[0])
                yield pa.RecordBatch.from_arrays([*(c.slice(row, size) for c in rest), *columns], names=[*batch.schema.names[:-1], *(n for n, _ in names)])

    return plain.mapInArrow(batches, schema)


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(frame: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``frame`` with the ids of ``text_col`` as array<int>."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for row, ids, ends in _encoded(texts, model(path)):
            yield row, [_lists(ids, ends)]

    return _map(frame, text_col, [(ids_col, T.ArrayType(T.IntegerType()))], run)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``frame`` with the text of ``ids_col`` (null: empty)."""

    def run(lists: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        for row in range(0, len(lists), 256):
            part = [np.array([i for i in ids or () if i is not None], np.int64) for ids in lists.slice(row, 256).to_pylist()]
            yield row, [model(path).decode(np.concatenate(part), np.concatenate([[0], np.cumsum([len(p) for p in part])]))]

    return _map(frame, ids_col, [(text_col, T.StringType())], run)


def round_trip(frame: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``frame`` with the ids of ``text_col`` and the text that these ids decode to, in one pass over the texts."""

    def run(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        own = model(path)
        for row, ids, ends in _encoded(texts, own):
            yield row, [_lists(ids, ends), own.decode(ids.astype(np.int64), ends)]

    return _map(frame, text_col, [(ids_col, T.ArrayType(T.IntegerType())), (decoded_col, T.StringType())], run)
