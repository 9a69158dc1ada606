"""Byte-level BPE ids of whole texts by the tokenizers library.

The library runs once for each distinct chunk that a worker sees. Texts are cut before single spaces and
around single line feeds: the tokenizer's own pre-tokenizer begins a new word there, so the ids of the
chunks, one after the other, are those of the text. Texts where a space stands between white space (or after it at the end)
are encoded whole, as are texts that hold one of the tokenizer's added tokens.
"""

from __future__ import annotations

import os
import re

import numpy as np

END_ID = 0
_ODD = re.compile(r" (?=\s|$)(?<=\s )")
_PLAIN = re.compile(r" ?\S+")
_ODD_LINES = re.compile(r"\n(?:(?=\s|$)|(?<=\s\n))")


def default_tokenizer() -> str:
    """Place of the public byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pool(dict):
    """Index of each distinct chunk; unknown chunks are queued for the library."""

    def __init__(self, encoder: "Encoder", prefix: str) -> None:
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, chunk: str) -> int:
        index = self[chunk] = self.encoder.queue(self.prefix + chunk)
        return index


class Encoder:
    """Encodes lists of texts; keeps ids of at most ``most`` chunks."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.most = most
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._reset()

    def _reset(self) -> None:
        self.first, self.rest = _Pool(self, ""), _Pool(self, " ")
        self.flat = np.array([END_ID, *self.line], np.uint32)
        self.begin, self.length = np.array([0, 1], np.int64), np.array([1, len(self.line)], np.int64)
        self.size, self.waiting = 2, []

    def queue(self, chunk: str) -> int:
        self.waiting.append(chunk)
        self.size += 1
        return self.size - 1

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _flush(self) -> None:
        """Encode the queue. Chunks of one word go to the library in lines: a line feed is a word of its own."""
        if not self.waiting:
            return
        plain = np.array([len(self.line) == 1 and _PLAIN.fullmatch(c) is not None and not self._holds_added(c) for c in self.waiting])
        words = [c for c, p in zip(self.waiting, plain, strict=True) if p]
        lines = ["\n".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        others = [c for c, p in zip(self.waiting, plain, strict=True) if not p]
        parts, length, of_words = [self.flat], np.zeros(len(plain), np.int64), []
        for got in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(got.ids, np.uint32)
            cut = np.flatnonzero(ids == self.line[0])
            of_words.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            parts.append(np.delete(ids, cut))
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        length[plain] = np.concatenate([np.zeros(0, np.int64), *of_words])
        length[~plain] = [len(x) for x in whole]
        begin = np.zeros(len(plain), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin[order] = len(self.flat) + np.cumsum(length[order]) - length[order]
        self.flat = np.concatenate([*parts, *whole])
        self.begin, self.length = np.concatenate([self.begin, begin]), np.concatenate([self.length, length])
        self.waiting = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; bounds of each text's ids)."""
        if self.size > self.most or len(self.flat) > 8 * self.most:
            self._reset()
        chunks: list[int] = []
        counts = []
        for text in texts:
            before = len(chunks)
            if text:
                if _ODD.search(text) or self._holds_added(text):
                    chunks.append(self.queue(text))
                else:
                    for k, line in enumerate(text.split("\n") if "\n" in text and not _ODD_LINES.search(text) else [text]):
                        if k:
                            chunks.append(1)
                        head, *tail = line.split(" ")
                        chunks.append(self.first[head])
                        chunks.extend(map(self.rest.__getitem__, tail))
            chunks.append(0)
            counts.append(len(chunks) - before)
        self._flush()
        index = np.array(chunks, np.int64)
        begin, lengths = self.begin[index], self.length[index]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(begin - stops + lengths, lengths)]
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
