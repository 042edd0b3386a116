"""Token ids of whole texts, each different word of a group of texts encoded once.

The vocabulary's pre-tokenizer lower-cases, never joins characters over white space, and cuts letters from other
characters. So a text's ids are those of its space-separated chunks in order (in lower case, where that is a matter
of single Latin letters), and those of letters with one stop or comma behind them are the word's and then the mark's.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are encoded in groups of about so many characters, their words in groups of so many.
GROUP_CHARS, GROUP_WORDS = 8_000_000, 500
#: Signs beyond Latin, a capital that lower-cases to two signs, and what control strings begin with, which the
#: tokenizer knows by their case: texts with them aren't lower-cased here.
OTHER = re.compile("[^\\x00-\\u024f]|\\u0130|<\\|")


@lru_cache(maxsize=4)
def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + size] one after the other, and where each ends."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class TextEncoder:
    """encode(texts): for each the ids as little-endian unsigned 32-bit bytes; null counts as empty."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # for words of Latin letters in lower case: the rest of its steps leaves them as they are
        self.words.normalizer, self.words.pre_tokenizer = None, Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: int(self._ids([m])[0][0]) for m in ".,"}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: pa.Array, latin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different chunks, as (ids, start, size). latin: they are of lower case and have no sign of OTHER."""
        last = pc.utf8_slice_codeunits(chunks, -1)
        mark = np.zeros(len(chunks), "i8")
        for m, i in self.marks.items():
            mark[np.asarray(pc.equal(last, m))] = i
        stems = pc.if_else(pa.array(mark > 0), pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        plain = np.asarray(pc.utf8_is_alpha(stems)) & latin
        code = stems.filter(pa.array(plain)).dictionary_encode()
        words = code.dictionary.to_pylist()
        parts = [np.asarray(self.words.encode_batch_fast([" ".join(words[i : i + GROUP_WORDS])], add_special_tokens=False)[0].ids, "<u4") for i in range(0, len(words), GROUP_WORDS)]
        rest = self._ids(chunks.filter(pa.array(~plain)).to_pylist())
        word_ids = np.concatenate([*parts, np.empty(0, "<u4")])
        ends = np.flatnonzero(self.ends[word_ids]) + 1
        starts = np.r_[0, ends][:-1]
        which = np.asarray(code.indices)
        size, start = np.zeros(len(chunks), "i8"), np.zeros(len(chunks), "i8")
        start[plain], size[plain] = starts[which], (ends - starts)[which]
        other = np.fromiter(map(len, rest), "i8", len(rest))
        start[~plain], size[~plain] = len(word_ids) + np.cumsum(other) - other, other
        ids, ends = gathered(np.concatenate([word_ids, *rest]), start, size)
        marked = plain & (mark > 0)
        ids = np.insert(ids, ends[marked], mark[marked]) if marked.any() else ids
        size = size + marked
        return ids, np.cumsum(size) - size, size

    def _group(self, texts: list[str], latin: bool) -> list[bytes]:
        lists = pc.split_pattern(pa.array([t.lower() for t in texts] if latin else texts, pa.large_string()), " ")
        code = lists.flatten().dictionary_encode()
        ids, start, size = self._chunks(code.dictionary, latin)
        which = np.asarray(code.indices)
        out, ends = gathered(ids, start[which], size[which])
        cuts = np.r_[0, ends][np.asarray(lists.offsets)].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str | None]):
        """Yields the ids of each text, in order."""
        group, chars = [], 0

        def done():
            kinds: tuple[list[int], list[int]] = ([], [])
            for k, t in enumerate(group):
                kinds[t.isascii() and "<|" not in t or not OTHER.search(t)].append(k)
            out: list[bytes] = [b""] * len(group)
            for latin in (False, True):
                if kinds[latin]:
                    for k, x in zip(kinds[latin], self._group([group[k] for k in kinds[latin]], latin), strict=True):
                        out[k] = x
            return out

        for t in texts:
            group.append((t or "").replace("\n", " "))  # one white space is like another
            chars += len(group[-1])
            if chars >= GROUP_CHARS:
                yield from done()
                group, chars = [], 0
        if group:
            yield from done()


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
