"""Token ids of texts by a public tokenizer file, with a cache of words.

A word-level BPE tokenizer drops white space and encodes what stands between independently, so ids can be kept by
white-space-delimited piece. That shortcut is taken only for texts on which lower-casing, NFC and white space certainly
mean the same to Python and to the tokenizer (ASCII, Latin letters, general punctuation); any other text goes to the
tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

#: The split pattern for which the shortcut holds; compared with the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White-space-delimited pieces, and words in them, kept by a worker (some 200 bytes each); beyond that the cache starts anew.
CACHE = 400_000

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._splits_alike(spec)
        #: For each id whether a word ends with it, where the model marks that in its tokens.
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), spec["model"].get("vocab", {})
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        # Characters on which both sides agree; the separators U+001C to U+001F, U+0085 and U+00A0 are left out.
        self.plain = re.compile("[\x00-\x1b\x20-\x7f\u00a1-\u012f\u0132-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*").fullmatch
        self.words = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall  # PATTERN, on such characters
        self.held: dict[str, bytes] = {}

    @staticmethod
    def _splits_alike(spec: dict) -> bool:
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and pre[0].get("pattern") == {"Regex": PATTERN} and pre[0].get("invert") is True and pre[0].get("behavior") == "Removed" and spec.get("post_processor") is None

    def _simple(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return False
        return not any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else self.plain(text) is not None

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Puts the pieces' ids into the cache; pieces that aren't words only are put together from the words in them."""
        held, mixed, alphabetic = self.held, [], []
        for piece in pieces:
            if piece.isalpha():
                alphabetic.append(piece)
            else:
                mixed.append((piece, self.words(piece)))
        more = {w for _, words in mixed for w in words if w not in held and w not in pieces}
        # A piece of one word that isn't all letters (a mark, a number) is also a word.
        more |= {piece for piece, words in mixed if len(words) == 1 and words[0] == piece}
        others = [w for w in more if not w.isalpha()]
        alphabetic += [w for w in more if w.isalpha()]
        for at in range(0, len(alphabetic), 4000):
            self._learn_words(alphabetic[at : at + 4000])
        for word, coded in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            held[word] = np.array(coded.ids, "<u4").tobytes()
        get = held.__getitem__
        held.update([(piece, b"".join(map(get, words))) for piece, words in mixed])

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone are one piece each of the tokenizer's split, so that many are encoded as one text."""
        text = " ".join(words)
        if self.ends is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
        if self.ends is None or len(ends) != len(words) or ends[-1] != len(ids):  # e.g. unknown letters
            coded = self.tokenizer.encode(text, add_special_tokens=False)
            ids, of = np.array(coded.ids, "<u4"), np.array(coded.word_ids, np.int64)
            ends = np.flatnonzero(np.append(of[1:] != of[:-1], True)) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer splits words of letters")
        data, ends = ids.tobytes(), (4 * ends).tolist()
        self.held.update(zip(words, [data[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces: list[list[str] | None] = []
        for text in texts:
            if not text:
                pieces.append([])
            elif self.by_piece and self._simple(text):
                pieces.append(text.lower().split())
            else:
                pieces.append(None)
        held = self.held
        new = {w for own in pieces if own for w in own if w not in held}
        if len(held) + len(new) > CACHE:
            held.clear()
            new = set().union(*(p for p in pieces if p))
        if new:
            self._learn(new)
        get = held.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, pieces, strict=True)]

    def batches(self, column: pa.Array, most: int = 1 << 18):
        """(first row, ids as bytes of each text) in runs of about ``most`` characters."""
        texts, row, size, start = column.to_pylist() if len(column) <= 256 else None, 0, 0, 0
        if texts is None:
            for at in range(0, len(column), 256):
                for first, coded in self.batches(column.slice(at, 256), most):
                    yield at + first, coded
            return
        for row, text in enumerate(texts):
            size += len(text or "")
            if size > most:
                yield start, self.encode(texts[start : row + 1])
                start, size = row + 1, 0
        if start < len(texts):
            yield start, self.encode(texts[start:])
