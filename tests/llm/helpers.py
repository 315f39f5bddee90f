"""Small tables with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, fp long, block long, payload binary, kept boolean, h string, bucket string, row string, words array<string>, epoch int, domain string"


def prose(r: random.Random, n: int) -> str:
    words = ["the", "and", "of", "with", "harbour", "lantern", "meadow", "quiet", "river", "stone", "copper", "evening", "gather", "slowly", "window", "travel", "market", "letter", "winter", "garden"]
    return " ".join(r.choice(words) + (f"{r.randint(0, 99)}" if r.random() < 0.15 else "") for _ in range(n)) + "."


def rows(seed: int = 3, n: int = 40) -> list[tuple]:
    """Null, empty, one very long, repeated rows and texts, ties, a hot source; clashing further columns."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(5, 120)) for _ in range(n)]
    shared = prose(r, 60)
    texts += [None, "", " \n\t ", texts[0], texts[0], texts[1] + " end", texts[2] + "\n" + shared, shared + "\n" + texts[3], prose(r, 30) + shared, prose(r, 6000), "word", "É" * 300]
    out = [(i, t, None if i == 7 else ("en", "de", "fr")[i % 3], None if i == 8 else "src0" if i % 2 else f"src{i % 5}", len(t) if t is not None else None, 1, 2, 3, b"x", True, "h", "b", "row", ["w"], 9, "dom") for i, t in enumerate(texts)]
    return out + [out[4], (None, texts[5], *out[5][2:])]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def texts_of(data=None):
    return [(x[0], x[1]) for x in (rows() if data is None else data)]


def repeats(docs, length=100):
    """(doc_id, bytes, removed, spans, digest) by remembering every window."""
    top = float("inf")
    order = sorted(((i, (t or "").encode()) for i, t in docs), key=lambda x: (top if x[0] is None else x[0], x[1]))
    seen, out = set(), []
    for i, b in order:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)
