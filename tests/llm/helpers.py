"""Small inputs with the awkward cases, and plain versions of the operators."""

import random

VOCAB = ["alpha", "beta", "gamma", "delta", "straße", "niño", "the", "of", "x", "longerword"]


def words(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


def awkward_texts(seed=0):
    """Exact and near copies, shared passages, runs, empties, nulls, odd white space."""
    rng = random.Random(seed)
    passage = words(rng, 80)
    base = [words(rng, rng.randrange(1, 150)) for _ in range(25)]
    out = list(base)
    out += [base[3], base[3], base[4].replace("alpha", "omega", 1), base[5] + " tail"]
    out += [words(rng, 20) + " " + passage + " " + words(rng, 10) for _ in range(4)]
    out += ["same " * 90, "ab " * 200, "z" * 900, "", " \t\n ", None, "one", "two  spaces\n \n and\ttabs \r\n here  ",
            "MiXed CASE Ünïcode 的文字 🙂 emoji", " nbsp em", "long " + words(rng, 3000) + " " + passage]
    return out


def documents(spark, texts, **more):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "b", None][i % 4], 7, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int")


def repeats(sequences, window):
    """Positions of each sequence covered by a window that starts elsewhere too."""
    from collections import Counter
    count = Counter(s[i:i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if count[s[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out
