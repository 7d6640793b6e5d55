"""Token ids of whole texts with the ``tokenizers`` library, word by word.

Both pre-tokenizers in use never join a character that isn't white space with white space after it, so a text's ids are those
of its segments cut before a space or line break, as long as no two characters of white space stand together. A worker encodes a
segment once and looks it up afterwards. A text with two characters of white space together, or with the marks of a special token, is
encoded as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments that a worker remembers before it starts afresh.
REMEMBER = 600_000
#: The id appended to each document.
END = 1
#: Marks that follow a word and are cut from it as a piece of their own.
MARKS = ".,;:!?*$%&#|<>()[]{}/+=@~^_-"
SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, without special tokens added, as 32-bit little-endian integers.

    A segment of letters, with or without marks after it, is one word to both pre-tokenizers and goes to the library's model at once;
    any other goes through the whole tokenizer. What a segment gave is row ``known[segment]`` of a table of ids.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.model = self.tokenizer.model
        in_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: in_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(128, 256) if chr(i).isalpha()}
        self.space = in_bytes.pre_tokenize_str(" ")[0][0]
        self.by_end = any(text.endswith("</w>") for text in self.tokenizer.get_vocab())  # white space counts for nothing
        self._forget()

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {}
        self.ids, self.size = np.empty(0, "<u4"), np.empty(0, np.int32)
        line = self._plain("\n")
        self._add(self.first, ["\n"], [line])
        self._add(self.rest, ["\n"], [line])

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, known: dict[str, int], segments: list[str], ids: list[list[int]]) -> None:
        known.update(zip(segments, range(len(self.size), len(self.size) + len(segments)), strict=True))
        self.size = np.append(self.size, np.fromiter(map(len, ids), np.int32, len(ids)))
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(ids), "<u4"))
        self.place = (np.cumsum(self.size, dtype=np.int64) - self.size).astype(np.int32)

    def _learn(self, segments: list[str], known: dict[str, int]) -> None:
        at_head = known is self.first or self.by_end
        before, mark, word, tails, out = "" if at_head else " ", "" if at_head else self.space, self.model.tokenize, self.tails, []
        for s in segments:
            w = s.rstrip(MARKS)
            if not w.isalpha() or not (w.isascii() or max(w) <= "ÿ"):
                out.append(self._plain(before + s))
                continue
            if self.by_end:  # of a text that couldn't be folded as a whole
                w = w.lower()
            ids = [t.id for t in word(mark + (w if w.isascii() else w.translate(self.letters)))]
            if len(w) < len(s):
                m = s[len(w) :]
                if m not in tails:
                    tails[m] = self._plain(m)
                ids += tails[m]
            out.append(ids)
        self._add(known, segments, out)

    @staticmethod
    def _folded(text: str) -> str:
        """Lower case, as the tokenizer's own normalizer has it, where Python's rules are the same."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text if "<|" in text else text.lower()

    def _rows(self, segments: list[str], known: dict[str, int]) -> np.ndarray:
        new = [s for s in segments if s not in known]
        if new:
            self._learn(new, known)
        return np.fromiter(map(known.__getitem__, segments), np.int32, len(segments))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.first) + len(self.rest) > REMEMBER:
            self._forget()
        if self.by_end:
            texts = [self._folded(t) for t in texts]
        out = [np.empty(0, "<u4")] * len(texts)
        apart = pc.match_substring_regex(pa.array(texts, pa.large_string()), f"[{SPACE}][{SPACE}]|<\\|").to_pylist()
        plain = []
        for i, t in enumerate(texts):
            if apart[i]:
                out[i] = np.array(self._plain(t), "<u4")
            elif t:
                plain.append(i)
        if not plain:
            return out
        # every distinct segment is looked up once; the rest is arithmetic on arrays
        split = pc.split_pattern(pa.array([texts[i].replace("\n", " \n ") for i in plain], pa.large_string()), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        each = split.flatten().dictionary_encode()
        code, distinct = each.indices.to_numpy(), each.dictionary.to_pylist()
        if self.by_end:  # a word is the same at the head of a line
            rows = self._rows(distinct, self.rest)[code]
        else:
            breaks = np.append(False, code == (distinct.index("\n") if "\n" in distinct else -1))
            head = breaks[:-1].copy()
            head[bounds[:-1]] = True
            head &= ~breaks[1:]
            rows = np.empty(len(code), np.int32)
            for known, own in ((self.rest, ~head), (self.first, head)):
                used = np.zeros(len(distinct), bool)
                used[code[own]] = True
                row_of = np.zeros(len(distinct), np.int32)
                row_of[used] = self._rows([distinct[i] for i in np.flatnonzero(used).tolist()], known)
                rows[own] = row_of[code[own]]
        n = self.size[rows]
        end = np.cumsum(n, dtype=np.int64)
        at = np.repeat((self.place[rows] - (end - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        flat, ends = self.ids[at], np.append(0, end)[bounds]
        for k, i in enumerate(plain):
            out[i] = flat[ends[k] : ends[k + 1]]
        return out


def encoder(name: str) -> Encoder:
    """One for each worker and file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encoded(enc: Encoder, texts: pa.Array, chars: int = 4_000_000) -> Iterator[np.ndarray]:
    """Ids of each text with the end id, in order; some millions of characters at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1])
        if size > chars:
            yield from (np.append(x, np.uint32(END)) for x in enc.encode_all(held))
            held, size = [], 0
    yield from (np.append(x, np.uint32(END)) for x in enc.encode_all(held))
