"""Whole-text encoding with a public tokenizer file, one library call for each distinct word.

The word-level tokenizer splits text at white space before it merges, so the ids of a text are
the ids of its pre-tokens in order. Printable Latin-1 texts are split by the tokenizer's own rule,
many at once as one array of bytes, and each distinct pre-token goes to the library once, its ids
staying in a bounded memo. Any other text is cut at its spaces and line ends, and each distinct chunk
of it goes to the library whole, since normalising such characters and finding special tokens is left
to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa

#: The tokenizer file's split pattern over printable Latin-1 characters, as kinds of bytes. A
#: pre-token is a run of letters, one digit, a contraction, or a run of other signs.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, dtype=np.uint8)
_KINDS[list("abcdefghijklmnopqrstuvwxyzªµº".encode("latin-1")) + [k for k in range(0xC0, 0x100) if chr(k) not in "×÷"]] = _LETTER
_KINDS[list("0123456789²³¹¼½¾".encode("latin-1"))], _KINDS[ord(" ")] = _DIGIT, _SPACE
#: The letters after an apostrophe that make it a contraction: one, or two as a number of 16 bits.
_ONE, _TWO = list(b"stmd"), [256 * a + b for a, b in (b"re", b"ve", b"ll")]
#: Characters that are encoded at once; a longer text is cut at spaces.
SLICE = 1 << 21


#: Longer words are encoded anew each time, which bounds the memo's bytes.
LONGEST = 64


class _Memo(dict):
    """Ids by word, of bounded size: when it is full, a second generation begins and the one before
    the last is dropped. A missing word is encoded by the library."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        return self.put(word, ids)

    def put(self, word: str, ids: bytes) -> bytes:
        if len(word) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces, self.chunks = _Memo(self._word, limit), _Memo(self._library, limit // 10)
        # Normalising and byte-level letters leave a lower-case ASCII pre-token as it is, so it can go to the
        # library's model itself, unless there are added tokens that _plain() does not keep out.
        self.model = self.library.model if all("<|" in t.content for t in self.library.get_added_tokens_decoder().values()) else None
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a pre-token
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def _library(self, word: str) -> bytes:
        ids = self.library.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: bytes) -> bytes:
        return self._library(word.decode("latin-1"))

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pre-tokens that the memo lacks: of ASCII ones from the library's model, of others by one
        call, where white space parts them and the ids that end one tell them apart again."""
        found, new, old = {}, [], self.pieces.old
        for w in words:
            if w in old:
                found[w] = old[w]
            elif self.model and w.isascii():
                ids = [t.id for t in self.model.tokenize(w.decode())]
                found[w] = pack(f"<{len(ids)}I", *ids)
            else:
                new.append(w)
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            ids = np.array(self.library.encode(b" ".join(part).decode("latin-1"), add_special_tokens=False).ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                data, edges = ids.tobytes(), [0, *(4 * cut).tolist()]
                found.update((w, data[a:b]) for w, a, b in zip(part, edges, edges[1:], strict=False))
            else:
                found.update((w, self._word(w)) for w in part)
        for w, ids in found.items():
            self.pieces.put(w, ids)
        return found

    def _plain(self, text: str) -> bool:
        """Whether a text is split by kinds of bytes as the library would."""
        if not text.isprintable() or "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _bulk(self, texts: list[str]) -> list[bytes]:
        """The ids of each plain text: all are split as one array, and the ids of their distinct pre-tokens
        are put where these stand."""
        data = np.frombuffer(" ".join(texts).lower().encode("latin-1"), dtype=np.uint8)
        start, signs = _starts(data), data != ord(" ")
        kept = data[signs]
        edges = np.append(np.flatnonzero(start[signs]), len(kept)).astype(np.int32)
        split = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(kept)]).dictionary_encode()
        words, which = split.dictionary.to_numpy(zero_copy_only=False).tolist(), split.indices.to_numpy()
        parts = list(map(self.pieces.get, words))
        if None in parts:
            found = self._learn([w for w, ids in zip(words, parts, strict=True) if ids is None])
            parts = [found[w] if ids is None else ids for w, ids in zip(words, parts, strict=True)]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        n = sizes[which]
        ends = np.append(0, np.cumsum(n))
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(parts), dtype="<u4")[places].tobytes()
        after = np.cumsum([len(t) + 1 for t in texts])  # where the next text begins
        cuts = [0, *(4 * ends[np.searchsorted(np.flatnonzero(start), after)]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        plain = list(map(self._plain, texts))
        if plain == [True]:
            return [b"".join(self._bulk([part])[0] for part in _stretches(texts[0]))]
        found = iter(self._bulk([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(found) if p else b"".join(map(self.chunks.__getitem__, t.split(" "))) for t, p in zip(texts, plain, strict=True)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of whole texts, one after another, as many texts at once as SLICE characters hold; null
        counts as empty."""
        held, size = [], 0
        for text in texts:
            text = text.replace("\n", " ") if text else ""
            if held and size + len(text) > SLICE:
                yield from self._encoded(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self._encoded(held)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        return next(self.encode_all([text]))


def _starts(data: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each byte of a lower-case printable Latin-1 text."""
    kind = _KINDS[data]
    start = kind == _DIGIT
    start[:1] = True
    start[1:] |= kind[1:] != kind[:-1]
    start &= kind != _SPACE
    at = np.flatnonzero(start & (data == ord("'")))  # one inside a run of other signs begins nothing
    if len(at):
        one, two = (np.append(data, [0, 0])[at + k].astype(np.int64) for k in (1, 2))
        short, long = at[np.isin(one, _ONE)], at[np.isin(256 * one + two, _TWO)]
        start[short + 1] = start[long + 1] = False
        after = np.concatenate([short + 2, long + 3])
        after = after[after < len(data)]
        start[after] = kind[after] != _SPACE
    return start


def _stretches(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters that end before a space."""
    at = 0
    while True:
        end = text.find(" ", at + SLICE)
        if end < 0:
            yield text[at:]
            return
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def forget() -> None:
    """Gives back the worker's encoders and their memos: a worker that goes on to other work needs none."""
    encoder.cache_clear()
