"""Token ids of whole texts, with each distinct word encoded once per worker.

The byte-level pre-tokenizer starts a new piece at every single space or line feed between two characters that
aren't white space, and pieces are encoded independently. A text is therefore cut at its spaces and line feeds, and
what the tokenizer made of a word, with the one before it, is kept in a bounded table. Texts with other white space
are cut only at spaces between two visible characters. The ids are the same as for the whole text.

Words are told apart by a 64-bit hash together with their length and last bytes, all in numpy; only words that a
worker hasn't met become Python strings.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np
import pyarrow as pa

from ._shared import held
from ._words import blocks, prefix_hash, substring_hash

#: Words whose ids a worker keeps, 24 bytes each and their ids; when there are more it starts anew.
CACHED = 500_000
#: Bytes of text that are encoded at a time.
BLOCK = 2 << 20
#: Signs that are a piece of their own behind letters; an apostrophe may not be.
SIGNS = string.punctuation.replace("'", "")

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: What stands before a word: nothing, a space, a line feed; and what is added to its hash.
_BEFORE = ("", " ", "\n")
_SALT = np.array([0x9E3779B97F4A7C15, 0, 0xD1342543DE82EF95], np.uint64)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return out


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.model._resize_cache(0)  # words are remembered here
        # for words of letters, which are one piece: their bytes as the model's characters, a space between words
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        signs = _byte_characters()
        self.character = {**signs, 32: " " + signs[32]}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(signs[32])]] = True
        self.tails: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted
        self.check = np.zeros(0, np.uint64)  # the words' lengths and last bytes
        self.at = np.zeros(0, np.uint32)  # of their ids
        self.many = np.zeros(0, np.int32)  # -1: white space that isn't a single space between two words
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str], known: dict[str, bytes | None], before: str) -> None:
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            got = self.tokenizer.encode([before + w for w in part], is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)))
            self._keep(part, np.array(got.ids, "<u4"), ends, known)

    def _encode_letters(self, words: list[str], known: dict[str, bytes | None]) -> None:
        """Words of letters after a space; the token that a space begins tells where each one's ids begin."""
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            text = (" " + " ".join(part)).encode().decode("latin-1").translate(self.character)
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            self._keep(part, ids, np.append(np.flatnonzero(self.begins[ids])[1:], len(ids)), known)

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray, known: dict[str, bytes | None]) -> None:
        raw, cut = ids.tobytes(), (ends * 4).tolist()
        known.update(zip(words, [raw[a:b] for a, b in zip([0, *cut], cut, strict=False)], strict=True))

    def _learn(self, words: list[str], before: str) -> list[bytes | None]:
        """The ids of words that are new, with what stands before them; None where a text can't be cut around it."""
        known: dict[str, bytes | None] = {}
        letters = {w for w in words if w.isalpha()}
        other, cut = [], []
        for w in words:
            if w not in letters:
                body = w.rstrip(SIGNS)
                if body.isalpha():  # a piece of letters, and one of the signs behind it
                    cut.append((w, body))
                elif not w or w[0].isspace() or w[-1].isspace():
                    known[w] = None if w or before else b""  # an empty text, or white space that isn't cut around
                else:
                    other.append(w)
        letters.update([body for _, body in cut])
        if before == " ":
            self._encode_letters(list(letters), known)
        else:
            other += letters
        self._encode(other, known, before)
        tails = self.tails if len(self.tails) < CACHED // 10 else {}
        self.tails = tails
        self._encode(list({w[len(body) :] for w, body in cut}.difference(tails)), tails, "")
        known.update([(w, known[body] + tails[w[len(body) :]]) for w, body in cut])
        return [known[w] for w in words]

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, check: np.ndarray, kind: np.ndarray) -> None:
        """Encode the words data[start:end], which are new and differ, and keep their ids."""
        length = end - start + 1
        place = np.cumsum(length)
        at = np.arange(place[-1]) - np.repeat(place - length, length) + np.repeat(start, length)
        raw = data[np.minimum(at, len(data) - 1)]
        raw[place - 1] = 32
        words = raw[:-1].tobytes().decode().split(" ")
        found: list[bytes | None] = [None] * len(words)
        for k, before in enumerate(_BEFORE):
            if which := np.flatnonzero(kind == k).tolist():
                for k, ids in zip(which, self._learn([words[k] for k in which], before), strict=True):
                    found[k] = ids
        many = np.array([-1 if f is None else len(f) // 4 for f in found], np.int32)
        ids = np.frombuffer(b"".join([f for f in found if f]), "<u4")
        start_ = (len(self.ids) + np.cumsum(np.maximum(many, 0)) - np.maximum(many, 0)).astype(np.uint32)
        self.ids = np.concatenate([self.ids, ids])
        put = np.searchsorted(self.key, key)
        self.key, self.check, self.at, self.many = (np.insert(a, put, b) for a, b in ((self.key, key), (self.check, check), (self.at, start_), (self.many, many)))

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        parts = _SAFE.split(text)
        return b"".join(np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([parts[0], *(" " + p for p in parts[1:])], add_special_tokens=False))

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts data[offsets[i]:offsets[i+1]], one after the other, and where each text's ids begin and end."""
        cut = np.flatnonzero((data == 32) | (data == 10))
        n = len(offsets) - 1
        start = np.concatenate([offsets[:-1], cut + 1])
        kind = np.concatenate([np.zeros(n, np.int8), np.where(data[cut] == 32, 1, 2).astype(np.int8)])
        order = np.argsort(start * 2 + (kind == 0), kind="stable")  # what ends a text comes before the next one
        start, kind = start[order], kind[order]
        end = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
        code = substring_hash(prefix_hash(data), start, end) ^ _SALT[kind]
        last = np.concatenate([np.zeros(6, np.uint8), data])
        check = (end - start).astype(np.uint64)
        for k in range(6):
            check = (check << np.uint64(8)) | np.where(end - start > k, last[end + 5 - k], 0).astype(np.uint64)
        kinds, one, which = np.unique(code, return_index=True, return_inverse=True)
        if len(self.key) > CACHED:
            self._clear()
        at = np.searchsorted(self.key, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.key)
        new[inside] = self.key[at[inside]] != kinds[inside]
        if new.any():
            where = one[new]
            self._add(data, start[where], end[where], kinds[new], check[where], kind[where])
            at = np.searchsorted(self.key, kinds)
        row = at[which]
        many = self.many[row]
        odd = (many < 0) | (self.check[row] != check)  # or two words with one hash
        begin = np.flatnonzero(kind == 0)
        many = np.maximum(many, 0)
        total = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        ids = self.ids[np.repeat(self.at[row] - total[:-1], many) + np.arange(total[-1])]
        bounds = np.append(total[begin], total[-1]) if len(begin) else np.zeros(1, np.int64)
        if odd.any():
            bad = np.flatnonzero(np.add.reduceat(odd, begin) > 0).tolist()
            parts, sizes, done = [], np.diff(bounds), 0
            for d in bad:
                whole = np.frombuffer(self._whole(data[offsets[d] : offsets[d + 1]].tobytes().decode()), "<u4")
                parts += [ids[bounds[done] : bounds[d]], whole]
                sizes[d], done = len(whole), d + 1
            ids = np.concatenate([*parts, ids[bounds[done] :]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        return ids, bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [x for _, x in self.encode_rows(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]))]

    def encode_blocks(self, batch: pa.RecordBatch, column: str = "text"):
        """(first row, row behind the last, ids, bounds) of all texts of a batch, a block at a time; null counts as empty."""
        for i, j, data, offsets in blocks(batch, column, BLOCK):
            yield i, j, *self.encode_block(data, offsets)

    def encode_rows(self, batch: pa.RecordBatch, column: str = "text"):
        """(row, ids) of all texts of a batch in order; null counts as empty."""
        for i, j, ids, bounds in self.encode_blocks(batch, column):
            cut, raw = (bounds * 4).tolist(), ids.astype("<u4", copy=False).tobytes()
            for k in range(j - i):
                yield i + k, raw[cut[k] : cut[k + 1]]


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))
