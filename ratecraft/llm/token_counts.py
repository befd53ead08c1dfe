"""Token counts of whole texts by a two-tier lookup inside the tasks.

A vocabulary of pieces never joins a character to white space that follows it, so
a text's tokens are those of its pre-tokens, the runs between spaces, one after
another.  The first tier is a compact hash table of the frequent pre-tokens'
lengths in tokens: each task of a pass over all texts keeps a bounded
heavy-hitter summary (Misra-Gries), the summaries, one row a task, are merged in
a tree, and the table that results is broadcast.  Its size is bounded by
``entries`` pre-tokens of ``TABLE_CHARS`` characters, whatever the corpus.  The
second tier is a bounded cache in each worker: pre-tokens that the table lacks
are cut where no piece of the vocabulary reaches across (line ends; marks after
a letter), looked up, and encoded by the library if they are new.  The table
decides only how fast a count is found, never its value.  No pre-token is
shuffled.

Defined results: a null or empty text has no bytes and no tokens; repeated rows
and null ids stay rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, ship, table
from .tokens import in_parts

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
# Bound of the broadcast table: so many pre-tokens of at most so many characters.
ENTRIES = 1 << 16
TABLE_CHARS = 24
# Bound of a worker's cache, in units of at most so many characters.
CACHED_UNITS = 400_000
CACHED_CHARS = 48
# Marks that are cut off after a letter, if the vocabulary joins none of them to one.
MARKS = ".,;:!?"
# Summaries merged in one task.
FAN_IN = 32
# The character for a space inside the vocabulary's pieces.
SPACE = "▁"


def pre_tokens(text: str) -> list[str]:
    """The runs between spaces.  Spaces beyond the one that opens each run stay
    in front of it; the run after the last space may be empty."""
    cut = text.replace(SPACE, " ").split(" ")
    if "" not in cut:
        return cut
    out, spaces = [], 0
    for c in cut:
        if c:
            out.append(" " * spaces + c)
            spaces = 0
        else:
            spaces += 1
    return out + [" " * (spaces - 1)] if spaces else out


class Lengths:
    """Numbers of tokens by a sentencepiece model; ``known``: the frequent ones."""

    def __init__(self, path: str, known: dict[str, int] | None = None) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = known or {}
        pieces = [p for k in range(self.model.get_piece_size())
                  if len(p := self.model.id_to_piece(k)) > 1 and not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        # what the cuts rest on; a vocabulary without these encodes whole texts
        self.cuts_spaces = not any(SPACE in p.lstrip(SPACE) for p in pieces) and sum(self._encoded([" a", " b"])) == self._encoded([" a  b"])[0]
        self.cuts_lines = not any("\n" in p for p in pieces)
        self.cuts_marks = not any(a.isalpha() and b in MARKS for p in pieces for a, b in zip(p, p[1:], strict=False))
        # a line end, and a space with nothing after it before a line end or the end
        self.line_end = self._encoded(["\n"])[0] - 1
        self.cache: dict[str | None, int] = {None: self.line_end, "": 1}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def units(self, pre_token: str):
        """Keys of the parts of a pre-token: those that the opening space belongs
        to as they are, others behind a line end, and a line end itself as None."""
        lines = pre_token.split("\n") if self.cuts_lines else [pre_token]
        for k, line in enumerate(lines):
            if k:
                yield None
            lead = "\n" if k else ""
            if self.cuts_marks and self.cuts_lines:
                core = line.rstrip(MARKS)
                if core and core != line and core[-1].isalpha():
                    yield lead + core
                    yield "\n" + line[len(core):]
                    continue
            if line or not k:
                yield lead + line

    def of_units(self, keys: set[str]) -> dict[str, int]:
        keys = list(keys)
        inside = 1 + self.line_end
        return {u: n - inside if u[0] == "\n" else n for u, n in zip(keys, self._encoded(keys), strict=True)}

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text (null: 0)."""
        if not self.cuts_spaces:
            return [n if t else 0 for t, n in zip(texts, self._encoded([t or "" for t in texts]), strict=True)]
        known, cache = self.known.get, self.cache
        totals, missed = [], []
        for t in texts:
            runs = pre_tokens(t) if t else []
            found = [*map(known, runs)]
            left = [u for r, n in zip(runs, found, strict=True) if n is None for u in self.units(r)] if None in found else []
            totals.append(sum(filter(None, found)))
            missed.append(left)
        new = set().union(*missed) - cache.keys()
        room = CACHED_UNITS - len(cache)
        cache.update(self.of_units(new))
        for k, left in enumerate(missed):
            totals[k] += sum(map(cache.__getitem__, left))
        for u in new:  # only what is short and within the bound stays
            if room <= 0 or len(u) > CACHED_CHARS:
                del cache[u]
            else:
                room -= 1
        return totals


def kept(counts: Counter, entries: int) -> Counter:
    """The summary cut to ``entries``: what the largest count left out has is
    taken from all others (Misra-Gries), so that errors stay bounded."""
    if len(counts) <= entries:
        return counts
    best = counts.most_common(entries + 1)
    floor = best.pop()[1]
    return Counter({w: n - floor for w, n in best if n > floor})


SUMMARY = "task long, words array<string>, counts array<long>"


def frequent(docs: DataFrame, entries: int = ENTRIES) -> list[str]:
    """Frequent pre-tokens of all texts, at most ``entries``."""
    def summarise(batches):
        counts: Counter = Counter()
        for b in batches:
            texts = b["text"]
            for part in in_parts(texts):
                for t in texts[part]:
                    if t:
                        counts.update(t.split(" "))
                if len(counts) > 4 * entries:
                    counts = kept(counts, 2 * entries)
        counts = kept(Counter({w: n for w, n in counts.items() if n > 1 and 0 < len(w) <= TABLE_CHARS and SPACE not in w}), entries)
        yield pd.DataFrame({"task": [0], "words": [list(counts)], "counts": [list(counts.values())]})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for words, n in zip(rows["words"], rows["counts"], strict=True):
            for w, c in zip(words, n, strict=True):
                counts[w] += int(c)
        counts = kept(counts, entries)
        return pd.DataFrame({"task": [key[0]], "words": [list(counts)], "counts": [list(counts.values())]})

    ship(docs.sparkSession)
    numbered = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.shiftright(F.monotonically_increasing_id(), 33)
    rows = table(docs.select("text").mapInPandas(summarise, SUMMARY).withColumn("task", numbered), "summaries")
    left = rows.count()
    while left > 1:  # a tree: no task merges more than FAN_IN bounded summaries
        merged = rows.groupBy(F.floor(F.col("task") / FAN_IN).alias("part")).applyInPandas(merge, SUMMARY)
        rows, left = table(merged, "summaries"), -(-left // FAN_IN)
    found = rows.select("words").first()  # one bounded row
    return list(found[0]) if found else []


@functools.lru_cache(maxsize=2)
def _worker(path: str, packed: bytes, lengths: bytes) -> Lengths:
    words = zlib.decompress(packed).decode()
    return Lengths(path, dict(zip(words.split(" "), lengths, strict=True)) if words else {})


def token_counts(docs: DataFrame, *, path: str = PIECE_BPE, limit: int = LIMIT, entries: int = ENTRIES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``doc_id, text``."""
    spark = docs.sparkSession
    model = Lengths(path)
    words = frequent(docs, entries) if model.cuts_spaces else []
    pairs = [(w, n) for w, n in zip(words, model.count(words), strict=True) if n < 256]
    shared = spark.sparkContext.broadcast((zlib.compress(" ".join(w for w, _ in pairs).encode()), bytes(n for _, n in pairs)))

    def count(texts):
        lengths = _worker(path, *shared.value)
        tokens = []
        for part in in_parts(texts):
            tokens += lengths.count(texts[part])
        return [[len(t.encode()) if t else 0 for t in texts], tokens, [n > limit for n in tokens]]

    return beside(docs, ["doc_id"], ["text"], "n_bytes long, n_tokens long, over_limit boolean", count)
