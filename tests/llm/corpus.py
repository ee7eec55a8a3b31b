"""A small corpus with every awkward row, and plain-Python helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(spark, n=60, seed=7):
    """Prose, exact and near copies, shared passages, null, empty, blank and very long texts, repeated rows, a null id,
    and extra columns whose names clash with outputs."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = prose(40)
    texts = [prose(rng.randint(20, 120)) for _ in range(n)]
    texts[5] = texts[1]
    texts[6] = texts[1].upper()
    edited = texts[2].split(" ")
    edited[3] = "changed"
    texts[7] = " ".join(edited)
    texts[8] = texts[9][:80] + " " + passage + " é ß " + texts[9][80:]
    texts[10] = passage + "\n" + texts[10]
    texts[11], texts[12], texts[13] = None, "", " \t\n "
    texts[14], texts[15] = "one two", "one two"
    texts[16] = "ab " * 3000
    texts[17] = prose(4000)
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t or ""), i, 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a text of no id", "en", "s1", 15, 1, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, score double")


def collect(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
