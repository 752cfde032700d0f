"""Small tables with everything that can go wrong, and plain reference versions of the contracts' parts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS_DDL = "doc_id long, text string, lang string, source string, n_chars long, size string, start double, kept string, score string, line string"


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(seed, n):
    import random

    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "ömicron", "pi", "rho", "sigma", "tau"]
    out = []
    for k in range(n):
        out.append(r.choice(vocabulary) + (r.choice([",", ".", ".\n"]) if k % 9 == 8 else ""))
    return " ".join(out)


def documents():
    """Rows of DOCUMENTS_DDL."""
    base = prose(1, 300)
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("alpha", "omega", 2), "en", "b"), (4, "", "en", "b"), (5, None, "de", None),
        (6, "   \n\t ", None, "a"), (7, "one two", "en", "c"), (8, "one two", "fr", "c"), (9, "One TWO", None, None), (10, "x" * 5000, "en", "a"),
        (11, prose(2, 12000), "de", "b"), (12, "12 34 %% ##", "en", "a"), (13, "日本語 テキスト", "fr", "é"), (14, "a b\n\nc  d\n a b \na b c d ́ ' 's don't <|endoftext|>", "fr", "b"),
        (7, "one two", "en", "c"), (15, prose(3, 60), None, "z"), (16, prose(4, 60), "en", "a"), (None, base, "en", "a"), (None, None, None, None), (18, base + " more words here", "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "clash", 0.5, "clash", None, "clash") for i, t, lang, s in texts]
