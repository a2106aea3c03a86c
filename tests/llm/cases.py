"""Small hostile document tables and plain-Python readings of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, stats string, quality_stats int, kept_id int, anchor string"


def words(rng, n, vocab=60):
    return [f"w{rng.randrange(vocab)}" + ("é" if rng.random() < 0.05 else "") for _ in range(n)]


def texts(seed=5, n=40):
    """Random texts, copies, near copies and shared passages, then the odd ones."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 30, 900))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            w = rng.choice(out).split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            out.append(" ".join(w))
        else:
            w = words(rng, rng.randrange(3, 120), 900)
            if rng.random() < 0.3:
                w[len(w) // 2:len(w) // 2] = passage.split()
            out.append(rng.choice([" ", "  ", "\t"]).join(w))
    return out


ODD = [None, "", "   \t\n ", "one", "two words", "ONE", "a b c d", "a b c d e", "A B C D E", "tab\x0bsep\x0cform feed\rnl\nlast", "nbsp\xa0stays one", "\x1c\x1d odd gaps \x85 here",
       "same same same same same same same same same same same same", "<|endoftext|> and </s>", "é" * 50, "😀 grin 😀"]


def rows(seed=5, n=40, long=True):
    out = [(i, t) for i, t in enumerate(texts(seed, n) + ODD)]
    if long:
        out.append((len(out), " ".join(words(random.Random(9), 20_000, 4000))))
    out.append((3, out[7][1]))  # an id that occurs twice, with another text
    out.append(out[5])  # a repeated row
    return out


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else "en", f"s{k % 3}", None, "x", "y", 1, 2, "z") for k, (i, t) in enumerate(pairs)], SCHEMA)


def with_null_id(pairs):
    return pairs + [(None, pairs[0][1]), (None, None)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
