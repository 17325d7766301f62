"""Token ids of the word-level BPE vocabulary for many texts at once.

The vocabulary's normaliser and pre-tokeniser never look across white space, so a text's
ids are those of its blank-separated words in order. Words repeat: each is encoded by the
library once and kept in a cache of bounded size per Python worker; ids are then gathered
with numpy. A plain word (Latin letters, then punctuation) goes straight to the library's
BPE model; every other word goes through its whole pipeline.
"""

from __future__ import annotations

import array
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 800_000
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,!|%$&*#;:?]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable bytes themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class WordEncoder:
    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        letters = _byte_letters()
        self.spelt = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        self.cached = cached
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.start, self.size, self.ids = array.array("q"), array.array("i"), array.array("i")

    def encode_word(self, word: str) -> list[int]:
        if m := PLAIN.fullmatch(word.lower()):
            ids = [t.id for t in self.model.tokenize(m[1].translate(self.spelt))]
            return ids + [t.id for t in self.model.tokenize(m[2])] if m[2] else ids
        return self.whole.encode(word, add_special_tokens=False).ids

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.cached:
            self._clear()
        known, out = self.known, np.empty(len(words), dtype=np.int64)
        for k, word in enumerate(words):
            place = known.get(word)
            if place is None:
                ids = self.encode_word(word)
                place = known[word] = len(known)
                self.start.append(len(self.ids))
                self.size.append(len(ids))
                self.ids.extend(ids)
            out[k] = place
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's ids; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        places = self._places(words.dictionary.to_pylist())
        start, size, ids = (np.array(x) for x in (self.start, self.size, self.ids))
        at = places[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        sizes = size[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        counts = np.diff(ends[offsets])
        if not ends[-1]:
            return np.zeros(0, np.int32), counts
        return ids[np.repeat(start[at] - ends[:-1], sizes) + np.arange(ends[-1])], counts


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, per Python worker and vocabulary file."""
    return WordEncoder(path)
