"""Small documents with the cases every operator has to stand."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row string, "
          "label int, score string, shard string, number int, word string")


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10 ** 6)}"
    return " ".join(w)


def documents(seed=3, very_long=300_000):
    """Rows of (doc_id, text, lang, source): copies, near copies in chains, shared passages and
    lines, nulls in every column, empty, blank, one-word and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "Abdé" for b in "eiouß" for c in ("r", "st", "ñ", "N", "x")]
    passage = words(rng, 130, vocabulary)
    line = "  A line that Stands in many documents "
    out = []
    for k in range(60):
        out.append((words(rng, rng.randrange(1, 260), vocabulary), "en" if k % 2 else "fr"))
    for k in range(12):
        out.append((out[20][0], "en"))
    text = words(rng, 200, vocabulary)
    for k in range(25):                      # a chain: each a little further from the first
        out.append((text, "de"))
        text = edited(rng, text, 3)
    for k in range(12):
        out.append((words(rng, 80, vocabulary) + "\n" + passage + "\n" + words(rng, 30, vocabulary), "es"))
    for k in range(8):
        out.append((words(rng, 20, vocabulary) + "\n" + line + "\nshort\nshort\n" + line.upper(), "fr"))
    out += [(None, "en"), (None, None), ("", "en"), ("", None), (" \t\n\x0b ", "de"), ("One", "de"), ("one", None),
            ("1 2 3", "en"), ("!!! ???", "en"), ("a b c d", "en"), ("A b C d", "en"), ("a" * 900, "en"),
            ("ab" * 600 + "\0" * 500, "en"), ("Müller ÄÖÜ İstanbul   straße", "de"), ("x\0y " * 300, "en")]
    out.append((words(rng, very_long // 5, vocabulary), "en"))
    rows = [(i, t, g, None if i % 11 == 0 else f"src{i % 4}") for i, (t, g) in enumerate(out)]
    rows += [rows[3], rows[3], (None, rows[5][1], "en", "src1"), (None, "no id but a text of some words here", "en", None),
             (None, "no id but a text of some words here", "en", None), (7, rows[9][1], "en", "src0")]
    rng.shuffle(rows)
    return rows


def benchmark(rows):
    """Items cut from documents of more than 30 words, short ones, repeated ones, nulls."""
    long = [r for r in rows if r[1] and len(r[1].split()) > 40]
    out = [(k, " ".join(r[1].split()[5:5 + 12 + k])) for k, r in enumerate(long[:8])]
    out += [(100, out[0][1]), (101, "one"), (102, "a b c"), (103, ""), (104, None), (None, out[1][1]),
            (105, "!!!"), (106, "never occurs in any of these documents at all, not once or twice")]
    return out


def frame(spark, rows):
    """The rows with columns whose names clash with those the operators use inside."""
    return spark.createDataFrame(
        [(i, t, g, s, len(t or ""), "k", None, 1, "s", "x", 5, "w") for i, t, g, s in rows], SCHEMA)
