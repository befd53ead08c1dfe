"""Quality rules: divergence of a document's histograms from its language.

For each language two reference histograms come from all its documents: eight
character classes, each with its median share over the documents (so that a
few long junk texts don't move it), and the language's ``common_words`` most
frequent words (plus one bin for all others).  Distances are Jensen-Shannon
distances (base 2, 0..1) of a document's own histograms from these.

The distance of characters is held against fixed bounds.  That of words depends
on the length: a sound text of n words differs from its language by chance, by an
expected divergence that the reference gives exactly, and a text without any of
the common words differs by a known, largest one.  A text is rejected if it lies
``far`` of the way from the first to the second, or ``halfway`` when its
characters are odd as well.  So the bound needs no labels, moves with the
language, and the shorter a text, the more of the way it must go.  Documents under ``min_words`` words
are too short for a histogram and get no divergence verdict.

References are a table, one row per language.  Up to ``max_broadcast`` rows they are
broadcast, beyond it joined to the documents by language; the result is the
same.  A language with under ``min_docs`` such documents has no reference of its
own: its documents are measured against the ``fallbacks`` languages that have most
documents (without any, against the whole corpus), and the nearest one counts.

Defined results: a null or empty text has no words (all counts 0, fails the
length rule); a null language is a language of its own; repeated rows each get
their own row; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, sheltered, ship, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COMMON_WORDS = 64
# Documents of MIN_WORDS words that a language needs for a reference.
MIN_DOCS = 20
# Languages against which documents of all others are measured.
FALLBACKS = 32
# References (of a few kB each) that are broadcast.
MAX_BROADCAST = 1000
# Far from the reference in the character classes, or odd there and far in words.
MAX_CLASS_DISTANCE = 0.35
ODD_CLASS_DISTANCE = 0.18
# Of the way from the divergence expected by chance to that without common words:
# far for a long text (a text of ``min_words`` words must go all of it), and far
# enough for one with odd characters.
FAR, HALFWAY = 0.8, 0.4

SYMBOLS = b"#*$%&|<>"
CLASSES = ["small", "upper", "digit", "space", "line", "punctuation", "symbol", "other"]
N_CLASSES = len(CLASSES)


def _class_of_byte() -> np.ndarray:
    """Class of each UTF-8 byte; bytes inside a character count as none."""
    kind = np.full(256, CLASSES.index("other"), np.uint8)
    for c in range(128):
        ch = chr(c)
        kind[c] = CLASSES.index("small" if ch.islower() else "digit" if ch.isdigit() else "upper" if ch.isupper() else "line" if ch == "\n"
                                else "space" if ch.isspace() else "symbol" if c in SYMBOLS else "punctuation")
    kind[128:192] = N_CLASSES
    return kind


_KIND = _class_of_byte()


def class_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, (kl[0] + kl[1]) / 2)))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside a 3-word window whose words occur twice or more."""
    if len(ids) < 4:
        return 0
    if n_distinct < 2_000_000:
        codes = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:  # the cube would overflow: number the pairs first
        pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        codes = pairs[:-1] * n_distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(codes) + k] |= again
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[dict, Counter, bytes]:
    """The fixed counts of a text, its distinct words with their counts, and
    its UTF-8 form."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = {
        "n_words": len(words),
        "word_chars": len(text) - (len(raw) - sum(map(len, words))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(ids, max(1, len(number))),
    }
    each = np.bincount(ids, minlength=len(number)) if number else []
    return counts, dict(zip(number, map(int, each), strict=True)), raw


def _corpus_counts(docs: DataFrame, min_words: int, flush_at: int = 200_000) -> DataFrame:
    """``lang, kind, item, n``: how often each alphabetic word (kind w) occurs,
    how many documents have a share of so many thousandths of a character class
    (c), how many words (t) and documents (d) there are; summed in the task first."""

    def count(batches):
        seen: dict = defaultdict(Counter)
        shares: Counter = Counter()
        n_docs: Counter = Counter()
        n_words: Counter = Counter()

        def rows():
            out = [(lang, "w", w.decode(), n) for lang, c in seen.items() for w, n in c.items()
                   if w.decode().isalpha()]
            seen.clear()
            return pd.DataFrame(out, columns=["lang", "kind", "item", "n"])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                raw = (text or "").encode()
                words = raw.lower().split()
                seen[lang].update(words)
                n_words[lang] += len(words)
                n_docs[lang] += 1
                if len(words) >= min_words:
                    hist = class_histogram(raw)
                    shares.update((lang, f"{i} {k}") for i, k in enumerate(hist * 1000 // hist.sum()))
            if sum(map(len, seen.values())) > flush_at:
                yield rows()
        yield rows()
        yield pd.DataFrame([(lang, "c", share, n) for (lang, share), n in shares.items()]
                           + [(lang, "d", "", n) for lang, n in n_docs.items()]
                           + [(lang, "t", "", n) for lang, n in n_words.items()],
                           columns=["lang", "kind", "item", "n"])

    ship(docs.sparkSession)
    found = docs.select("lang", "text").mapInPandas(count, "lang string, kind string, item string, n long")
    return found.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=4096)
def _chance(hist: bytes, n: int) -> float:
    """Expected divergence of ``n`` words drawn from a reference (doubles as
    bytes): a sum over bins, for each over all counts it can have."""
    if n > EXACT_WORDS:  # beyond, it falls with the number of words
        return _chance(hist, EXACT_WORDS) * EXACT_WORDS / n
    q = np.frombuffer(hist)
    q = q[q > 0] / q.sum()
    if len(q) == 1:
        return 0.0
    k = np.arange(n + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    ways = logs[n] - logs[k] - logs[n - k]
    chance = np.exp(ways + np.outer(np.log(q), k) + np.outer(np.log1p(-q), n - k))
    p, q = np.broadcast_arrays(k / n, q[:, None])
    both = p + q
    gain = np.where(p > 0, p * np.log2(np.where(p > 0, 2 * p, 1) / both), 0) + q * np.log2(2 * q / both)
    return float((chance * gain).sum() / 2)


EXACT_WORDS = 512


def word_step(n: int) -> int:
    """Lengths are looked at in steps of a quarter of an octave, downwards."""
    return int(2 ** (math.floor(4 * math.log2(n) + 1e-9) / 4))


class Reference:
    """A language's common words and histograms."""

    def __init__(self, words: list[str], hist: list[int], classes: list[float]) -> None:
        self.number = {w.encode(): k for k, w in enumerate(words)}
        self.hist, self.classes = np.array(hist, float), np.array(classes, float)
        without = np.zeros(len(self.hist))
        without[-1] = 1
        self.raw, self.most = self.hist.tobytes(), js_distance(without, self.hist) ** 2

    def distances(self, words: dict[bytes, int], n: int, classes: np.ndarray) -> tuple[float, float, float]:
        """Distances in characters and words, and how much of the way from chance
        to no common word the words' divergence has gone."""
        own = np.zeros(len(self.hist))
        for w, k in words.items():
            own[self.number.get(w.lower(), -1)] += k
        by_word, chance = js_distance(own, self.hist), _chance(self.raw, word_step(n))
        way = (by_word ** 2 - chance) / (self.most - chance) if self.most > chance else 0.0
        return js_distance(classes.astype(float), self.classes), by_word, way


REFERENCE = "lang string, n_docs long, words array<string>, hist array<long>, classes array<double>"


def language_references(docs: DataFrame, *, common_words: int = COMMON_WORDS, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per language with ``min_docs`` documents of ``min_words`` words,
    from the whole table: its common words, their counts (the last one: all
    other words) and its character classes.  Without such a language, one row
    (null) for the whole corpus."""
    counts = table(_corpus_counts(docs, min_words), "language-counts")
    long = counts.where((F.col("kind") == "c") & F.col("item").startswith("0 ")).groupBy("lang").agg(F.sum("n").alias("n_docs"))
    large = table(long.where(F.col("n_docs") >= min_docs), "languages")
    if large.isEmpty():
        counts = counts.groupBy(F.lit(None).cast("string").alias("lang"), "kind", "item").agg(F.sum("n").alias("n"))
        large = long.agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0").select(F.lit(None).cast("string").alias("lang"), "n_docs")
    large = large.select(F.col("lang").alias("_lang"), "n_docs")
    mine = F.col("lang").eqNullSafe(F.col("_lang"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    common = counts.where("kind = 'w'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= common_words)
    # a list holds at most ``common_words`` words, or 1001 shares a class
    words = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "n"))).alias("words"))
    shares = counts.where("kind = 'c'").select("lang", F.split("item", " ").alias("at"), "n").select(
        "lang", F.col("at")[0].cast("int").alias("class"), F.col("at")[1].cast("int").alias("share"), "n")
    medians = shares.groupBy("lang", "class").agg(F.array_sort(F.collect_list(F.struct("share", "n"))).alias("bins"))
    half = F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + b["n"]) / 2
    below = lambda x: F.aggregate(F.filter("bins", lambda b: b["share"] <= x["share"]), F.lit(0).cast("long"), lambda acc, b: acc + b["n"])
    median = F.get(F.filter("bins", lambda b: below(b) >= half), F.lit(0))["share"]
    classes = medians.select("lang", "class", median.cast("double").alias("median")).groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "median"))), lambda c: c["median"]).alias("classes"))
    total = counts.where("kind = 't'").groupBy("lang").agg(F.sum("n").alias("total"))
    out = large
    for part, name in ((words, "words"), (classes, "classes"), (total, "total")):
        out = out.join(part.withColumnRenamed("lang", f"_{name}"), F.col(f"_{name}").eqNullSafe(F.col("_lang")), "left").drop(f"_{name}")
    known = F.coalesce(F.transform("words", lambda x: x["n"]), F.array().cast("array<long>"))
    rest = F.coalesce("total", F.lit(0)) - F.aggregate(known, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select(F.col("_lang").alias("lang"), "n_docs",
                      F.coalesce(F.transform("words", lambda x: x["item"]), F.array().cast("array<string>")).alias("words"),
                      F.concat(known, F.array_repeat(F.lit(0).cast("long"), F.lit(common_words) - F.size(known)), F.array(rest)).alias("hist"), "classes")


def judge(docs: DataFrame, references: DataFrame | None = None, *, min_words: int = MIN_WORDS,
          max_repeat_percent: float = MAX_REPEAT_PERCENT, max_class_distance: float = MAX_CLASS_DISTANCE,
          odd_class_distance: float = ODD_CLASS_DISTANCE, far: float = FAR, halfway: float = HALFWAY,
          fallbacks: int = FALLBACKS, max_broadcast: int = MAX_BROADCAST, keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns in ``keep`` (default ``doc_id``), the
    fixed counts, ``base_failed``, both distances and the way gone in words (null
    without a verdict) and ``kept``.  ``references`` default to those of ``docs``."""
    ship(docs.sparkSession)
    references = table(language_references(docs) if references is None else references, "references")
    most = references.orderBy(F.desc("n_docs"), "lang").limit(fallbacks).collect()       # ``fallbacks`` rows
    small = references.count() <= max_broadcast
    shared = docs.sparkSession.sparkContext.broadcast(
        ([tuple(r) for r in most], {r.lang: (r.words, r.hist, r.classes) for r in references.collect()} if small else None))

    def verdicts(texts, langs, *given):
        others, known = shared.value
        others, own_refs, out = [Reference(*r[2:]) for r in others], {}, []

        def of(lang, row):
            if lang not in own_refs:
                found = known.get(lang) if known is not None else row if row and row[0] is not None else None
                own_refs[lang] = [Reference(*found)] if found else others
            return own_refs[lang]

        for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            counts, words, raw = base_counts(text)
            n = counts["n_words"]
            failed = n < min_words or 100 * counts["n_repeat_words"] > max_repeat_percent * n
            by_class = by_word = way = None
            bad = False
            if n >= min_words:
                classes = class_histogram(raw)
                measured = [r.distances(words, n, classes) for r in of(lang, [g[k] for g in given])]
                limit = far + (1 - far) * min_words / n
                odd = [c > max_class_distance or w >= limit or (c > odd_class_distance and w > halfway) for c, _, w in measured]
                if measured:  # the nearest one, of those that accept the text if any does
                    bad = all(odd)
                    by_class, by_word, way = min((m for m, o in zip(measured, odd, strict=True) if bad or not o), key=lambda m: (m[2], m[0]))
            out.append((*counts.values(), failed, not (failed or bad), by_class, by_word, way))
        return list(zip(*out, strict=True)) if out else [[]] * 10

    keep = keep or ["doc_id"]
    if small:
        return beside(docs, keep, ["text", "lang"], VERDICT, verdicts)
    # both sides come to the join straight from a shuffle or a scan, so adaptive
    # execution splits the documents of a language that holds most of them
    given = references.select(F.col("lang").alias("_of"), *[F.col(c).alias(f"_ref_{c}") for c in ("words", "hist", "classes")])
    joined = docs.join(given, F.col("lang").eqNullSafe(F.col("_of")), "left")
    return beside(joined, keep, ["text", "lang", "_ref_words", "_ref_hist", "_ref_classes"], VERDICT, verdicts)


VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, class_distance double, word_distance double, word_way double")


def good_documents(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged."""
    rows, back = sheltered(docs, "doc_id", "text", "lang")
    return back(judge(rows, keep=rows.columns, **rules).where("kept"))
