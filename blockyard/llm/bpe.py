"""Byte-pair encoding of whole texts with a public tokenizer file, by parts that are encoded once and remembered."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np

#: Parts of a text that a byte-level tokenizer encodes independently: white space before a run of other characters
#: always begins a new piece, whatever follows, so a cut before it changes nothing.
PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space, where such a cut could split a run of white space: these texts are encoded block by block.
OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_OTHER = [chr(c) for c in range(0x10000) if OTHER_SPACE.match(chr(c))]
#: Remembered parts (about 230 bytes each), before a worker forgets them and starts anew; characters of a block.
MEMORY, BLOCK = 1_000_000, 1 << 20
#: Parts that are encoded as one text and told apart afterwards.
JOINED = 1000


@cache
def encoder(path: str, spans: bool = False) -> "Encoder":
    """A worker's encoder, with what it remembers from earlier tasks."""
    return Encoder(path, spans)


def keys_of(block: str) -> list[str]:
    """The parts of a text that begin with white space or at its start, by their keys: a part that begins with a space
    goes without it, one that begins with a line break as it is, any other behind a tab (parts hold no tab).

    Where no run of white space is longer than two line breaks, a run of two may be cut too, unless a text or a special
    token ends it: the tokenizer takes its first break as a piece of its own. Such texts are cut at each space."""
    if "  " in block or "\n " in block or " \n" in block or "\n\n\n" in block or block.endswith("\n\n") or "<|" in block:
        return [p if p[0] == "\n" else p[1:] if p[0] == " " and p[1:2] != "\n" else "\t" + p for p in PART.findall(block)]
    keys = block.replace("\n", " \n").split(" ")
    if keys[0]:
        keys[0] = "\t" + keys[0]
        return keys
    return keys[1:]


def part_of(key: str) -> str:
    return key[1:] if key[:1] == "\t" else key if key[:1] == "\n" else " " + key


class Encoder:
    """Encodes whole texts as the tokenizers library does with add_special_tokens=False; optionally with the span of
    characters of each token. Long texts go block by block, so memory does not grow with a text beyond its ids."""

    def __init__(self, path: str, spans: bool = False):
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.spans = Tokenizer.from_file(path), spans
        # bytes of each token: a byte-level tokenizer writes each byte of a text as one character
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 12, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)  # where each part's tokens begin; the next part's begin where they end
        if self.spans:
            self.begin, self.stop = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
            self.length = np.zeros(1 << 12, np.int64)  # characters of each part

    def _learn(self, new: list[str]) -> None:
        """Encodes parts and remembers them. Most begin with white space and end without: they are joined to longer
        texts, in which each again begins a piece, and their tokens are told apart by their places."""
        alone = [k for k in new if not k or k[0] == "\t" or k[-1] in " \n" or " \n" in k or "<|" in k]
        if alone:
            skip = set(alone)
            new = [k for k in new if k not in skip]
        groups = [[k] for k in alone] + [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        texts = [part_of(k) for k in alone] + [(" " + " ".join(g)).replace(" \n", "\n") for g in groups[len(alone):]]
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        for group, text, e in zip(groups, texts, encode(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            places = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(ids)).reshape(-1, 2) if self.spans else None
            if len(group) == 1:
                self._remember(group, ids, np.array([len(ids)]), places, np.array([len(text)]))
                continue
            plain = np.fromiter([k[0] != "\n" for k in group], np.int64, len(group))
            lengths = plain + np.fromiter(map(len, group), np.int64, len(group))
            if self.spans:
                starts = np.cumsum(lengths) - lengths
                of = np.searchsorted(starts, places[:, 0], side="right") - 1
                self._remember(group, ids, np.bincount(of, minlength=len(group)), places - starts[of, None], lengths)
                continue
            ends = np.cumsum(lengths if text.isascii() else plain + np.fromiter([len(k.encode()) for k in group], np.int64, len(group)))
            widths = np.cumsum(self.width[ids])
            last = np.searchsorted(widths, ends, side="right")
            if not len(ids) or (widths[last - 1] != ends).any():
                raise ValueError("not a byte-level tokenizer: its tokens' bytes are not those of the text")
            self._remember(group, ids, np.diff(last, prepend=0))

    def _remember(self, group: list[str], ids: np.ndarray, counts: np.ndarray, places: np.ndarray | None = None,
                  lengths: np.ndarray | None = None) -> None:
        n, have = len(self.known), len(ids)
        end = int(self.at[n])

        def longer(x: np.ndarray, size: int) -> np.ndarray:
            while len(x) < size:
                x = np.concatenate([x, np.zeros_like(x)])
            return x

        self.ids, self.at = longer(self.ids, end + have), longer(self.at, n + len(group) + 1)
        self.ids[end:end + have] = ids
        self.at[n + 1:n + 1 + len(group)] = end + np.cumsum(counts)
        if places is not None:
            self.begin, self.stop, self.length = longer(self.begin, end + have), longer(self.stop, end + have), longer(self.length, n + len(group))
            self.begin[end:end + have], self.stop[end:end + have] = places[:, 0], places[:, 1]
            self.length[n:n + len(group)] = lengths
        self.known.update(zip(group, range(n, n + len(group))))

    def _blocks(self, text: str) -> Iterator[str]:
        """Pieces of about BLOCK characters, cut before a space or line break that follows what is no white space."""
        at = 0
        while at < len(text):
            end = at + BLOCK
            while end < len(text) and not (text[end] in " \n" and not text[end - 1].isspace() and not OTHER_SPACE.match(text[end - 1])):
                end += 1
            yield text[at:end]
            at = end

    def encode(self, text: str):
        """ids (uint32); with spans also each token's first character and the character after its last (int64)."""
        out, base, known = [], 0, not any(c in text for c in _OTHER)
        for block in self._blocks(text):
            out.append(self._block(block, base) if known else self._whole(block, base))
            base += len(block)
        if not self.spans:
            return np.concatenate(out) if out else np.zeros(0, np.uint32)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """ids (uint32) of each text, in order; short texts are looked up, and their new parts learned, together."""
        held, size = [], 0
        for text in texts:
            if len(text) > BLOCK or any(c in text for c in _OTHER):
                yield from self._together(held)
                held, size = [], 0
                yield self.encode(text)
                continue
            held.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        keys, ends = [], []
        for text in texts:
            if text:
                keys += keys_of(text)
            ends.append(len(keys))
        _, first, counts = self._find(keys)
        ids = self.ids[_places(first, counts)]
        return np.split(ids, np.concatenate([[0], np.cumsum(counts)])[ends[:-1]])

    def _whole(self, block: str, base: int):
        e = self.tokenizer.encode(block, add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        if not self.spans:
            return ids
        places = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2) + base
        return ids, places[:, 0], places[:, 1]

    def _find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each part's number, where its tokens begin, and how many they are."""
        if len(self.known) > MEMORY:
            self._forget()
        which = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(which < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys([keys[i] for i in new])))
            which[new] = [self.known[keys[i]] for i in new]
        first = self.at[which]
        return which, first, self.at[which + 1] - first

    def _block(self, block: str, base: int):
        which, first, counts = self._find(keys_of(block))
        place = _places(first, counts)
        if not self.spans:
            return self.ids[place]
        lengths = self.length[which]
        start = np.repeat(base + np.cumsum(lengths) - lengths, counts)
        return self.ids[place], start + self.begin[place], start + self.stop[place]


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each token is remembered: its part's first token, and its place in the part."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
