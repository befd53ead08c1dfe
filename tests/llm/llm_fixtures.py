"""Rows that several tests use."""

WORDS = ["the", "of", "and", "to", "in", "alpha", "beta", "gamma", "delta", "Omega", "été", "straße", "日本", "x1", "end."]
# names that the operators use for columns of their own
EXTRA = ["row", "fp", "kept", "base", "spans", "n", "place", "ids", "src", "size", "taken", "cut", "root", "n_words", "_text", "tie"]


def prose(seed, n):
    import random
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) * draw.randint(0, 1) for _ in range(n))


def edge_rows():
    """doc_id, text, lang, source, n_chars: nulls in every column, empty and
    blank texts, one very long text, near and exact copies, repeated rows."""
    long = prose(1, 60_000)
    copied = prose(2, 80)
    texts = [(1, "", "en", "a"), (2, None, None, None), (3, " \n\t ", "en", "a"), (4, "one", "de", "b"), (5, long, "en", "a"),
             (6, copied, "en", "a"), (7, copied, "en", "b"), (8, copied.encode().upper().decode() + " ", "de", None), (None, copied, "en", "a"),
             (None, prose(3, 70), None, "b"), (9, prose(4, 300), "en", "c"), (9, prose(4, 300), "en", "c"), (9, prose(5, 20), "en", "c"),
             (10, 'set token = "abcdef123456" and\n' + prose(6, 60), "en", "c"),
             (2**60 + 1, "a\x0bb\x1cc  d <|endoftext|> é ", "xx", "é")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
