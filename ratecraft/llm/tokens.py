"""Token ids of whole texts with a public tokenizer, cached by segment.

Both tokenizer kinds split a text before they merge, and no piece goes from a
character into white space that follows it.  So a text cut before each run of
white space has the ids of its segments one after another, and as segments
repeat, most are found in a cache.  Texts with white space beyond ASCII's are
encoded whole: there the tokenizers and Python disagree on what it is.  Marks at
the end of a word are a piece of their own, and so are looked up apart.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import string
from array import array

import numpy as np
import public_tokenizers

# As the first fork decides, before any tokenizer is loaded in a worker.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
# Bounds of a worker's cache, whose entries take about 200 bytes.  It keeps what
# comes first, so the frequent segments are in it; later ones are encoded anew.
CACHED_SEGMENTS = 500_000
CACHED_LENGTH = 48
# A tail of these after a letter is a piece of its own for both tokenizers (not the
# apostrophe, which opens a piece with letters).
TAIL = "".join(c for c in string.punctuation if c != "'")

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEGMENTS = re.compile(r"\s*\S+|\s+")


# Fixed values of the vocabularies: how a token shows a space, and a word's end.
SPACE_TOKEN = "\u0120"
END_OF_WORD = "</w>"
# Words encoded in one string.
GROUP = 1000


def _is_spaced_word(s: str) -> bool:
    return s[0] == " " and s[1:].isalpha()


class Encoder:
    """``keeps_space``: white space is part of the ids, and so of a segment;
    ``cached``: bound of the cache."""

    def __init__(self, path: str, keeps_space: bool, cached: int = CACHED_SEGMENTS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.cut = _SEGMENTS.findall if keeps_space else str.split
        self.dtype, self.code = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        # tokens that a word starts with (its space is theirs) or ends with
        self.marks_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.marks_word[[k for t, k in self.tokenizer.get_vocab().items()
                         if (t.startswith(SPACE_TOKEN) if keeps_space else t.endswith(END_OF_WORD))]] = True
        self.between = "" if keeps_space else " "
        self.is_word = _is_spaced_word if keeps_space else str.isalpha
        self.cache: dict[str, bytes] = {}
        self.cached = cached
        self.end = np.array([END_ID], self.dtype).tobytes()

    def _bytes(self, segments: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of segments that are one word each, encoded in long strings: the
        library's cost for each string is then paid once for many words.  A token
        tells whether a word starts (ends) with it, which gives the words' parts;
        a string whose words don't come out one for one is encoded by segment."""
        out: list[bytes] = []
        groups = [words[k:k + GROUP] for k in range(0, len(words), GROUP)]
        joined = self.tokenizer.encode_batch_fast([self.between.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.marks_word[ids])
            if len(at) != len(group):
                out += self._bytes(group)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            cuts = ([*(at * size).tolist(), len(raw)] if self.keeps_space else [0, *((at + 1) * size).tolist()])
            out += [raw[x:y] for x, y in itertools.pairwise(cuts)]
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of segments that the cache lacks."""
        cache, ends, words, others = self.cache, {}, set(), set()
        for s in new:
            core = s.rstrip(TAIL)
            if core != s and core and core[-1].isalpha():
                ends[s] = core
                tail = s[len(core):]
                if tail not in cache:
                    others.add(tail)
                if core in cache:
                    continue
            else:
                core = s
            if self.is_word(core):
                words.add(core)
            else:
                others.add(core)
        words, others = list(words), list(others)
        found = dict(zip(words, self._words(words), strict=True))
        found.update(zip(others, self._bytes(others), strict=True))
        for s, core in ends.items():
            tail = s[len(core):]
            found[s] = (found[core] if core in found else cache[core]) + (found[tail] if tail in found else cache[tail])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), with the end id."""
        cuts = [[t] if t and _ODD_SPACE.search(t) else self.cut(t) if t else [] for t in texts]
        cache, room = self.cache, self.cached - len(self.cache)
        fresh = self._learn(set().union(*cuts).difference(cache))
        cache.update(fresh)
        get, end = cache.__getitem__, [self.end]
        out = [np.frombuffer(b"".join([*map(get, c), *end]), self.dtype) for c in cuts]
        for s in fresh:  # only what is short and within the bound stays
            if room <= 0 or len(s) > CACHED_LENGTH:
                del cache[s]
            else:
                room -= 1
        return out


@functools.cache
def encoder(path: str, keeps_space: bool, cached: int = CACHED_SEGMENTS) -> Encoder:
    return Encoder(path, keeps_space, cached)


def in_parts(texts, max_chars: int = 2_000_000):
    """Slices of a batch of texts of about ``max_chars`` characters each."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= max_chars:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
