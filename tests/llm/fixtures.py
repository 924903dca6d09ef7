"""A small corpus with copies, near copies, shared passages, hot lines, odd texts."""

import random

VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi") for b in ("nd", "rt", "sh", "l", "m") for c in ("a", "en", "ing", "ly", "o", "us")]


def prose(rng, n):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    lines, i = [], 0
    while i < n:
        k = rng.randint(4, 14)
        lines.append(" ".join(words[i : i + k]) + ".")
        i += k
    return "\n".join(lines)


def corpus(n=120, seed=0):
    """(doc_id, text, lang, source) rows; ids have gaps."""
    rng = random.Random(seed)
    passage = prose(rng, 70).replace("\n", " ")
    hot = "This very common line stands on nearly every page of all the sites that there are."
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(3, 160))
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.4:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            text = " ".join(words)
        elif kind < 0.55:
            text = prose(rng, 20) + " " + passage + " " + prose(rng, 30)
        elif kind < 0.6:
            text = "\n".join([prose(rng, 30)] * 3)
        if rng.random() < 0.5:
            text = hot + "\n" + text
        rows.append((3 * i + 1, text, "en", f"src{0 if rng.random() < 0.4 else rng.randint(1, 8)}"))
    rows += [(1000, "", "en", "src1"), (1001, None, None, None), (1002, "short text", "en", "src2"), (1003, "\n \t\n", "en", "src2"), (1004, "Ünï cödé " * 80, "de", "src3"), (1005, "Ünï cödé " * 80, "de", "src4")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside, as columns of the input.
CLASHING = ["n", "h", "doc", "sub", "key", "node", "band", "bucket", "score", "start", "count", "line", "src", "tok", "site", "words"]
