"""Hard negatives, vector codes and personal data against plain versions, odd rows included."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute_personal  # noqa: E402
import brute_vectors  # noqa: E402
import tables  # noqa: E402
from edgetide.llm import codebooks, hard_negatives, personal_data, queries  # noqa: E402

VECTORS = "vec_id long, label int, embedding array<double>, id string, vec int, row string, dim int, code string"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def vectors(seed=1, large=True):
    """Clusters, copies, ties, repeated and null ids and labels, other lengths, odd and huge values."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, rng.choice([0, 1, 1, 1, 2, None]), [x + rng.gauss(0, .3) for x in centres[i % 6]]) for i in range(260)]
    rows += [(300 + i, i % 3, list(rows[5][2])) for i in range(40)]
    rows += [rows[100], rows[100], (100, 2, rows[7][2]), (None, 1, rows[8][2]), (None, None, rows[9][2])]
    rows += [(400 + i, i % 2, [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)]
    rows += [(500, 1, None), (501, 1, []), (502, 1, [1.0, None] * 8), (503, 1, [float("nan")] * 16),
             (504, 1, [float("inf")] + [0.0] * 15), (600, 1, [0.0] * 16), (601, 2, [1.0, 2.0, 3.0]), (700, 0, [1.0])]
    if large:
        rows += [(800, 1, [3e6] * 16), (801, 1, [1e30] * 16), (802, 2, [5e29] + [1.0] * 15), (900, 2, [-1e30] * 16),
                 (901, 1, [1e300] * 16)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, g, v, "x", 1, "y", 2, "z") for i, g, v in rows], VECTORS).repartition(3)


def got(df):
    return Counter(tuple(r) for r in df.collect())


# --- hard negatives

@pytest.mark.parametrize("large", [False, True])
def test_hard_negatives(spark, large):
    rows = vectors(large=large)
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0)
    assert got(found) == Counter(brute_vectors.hard_negatives(rows, lambda i: i % 50 == 0))


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE", 8)
    monkeypatch.setattr(hard_negatives, "BOXES", 3)
    rows = vectors(seed=4)
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 20 == 0, positives=3, negatives=4)
    assert got(found) == Counter(brute_vectors.hard_negatives(rows, lambda i: i % 20 == 0, 3, 4))


def test_hard_negatives_of_the_query(spark):
    rows = [(i, (g + 1) % 10 if i is not None and g is not None and i % 7 == 0 else g, v) for i, g, v in vectors()]
    assert got(queries.mined_negatives(table(spark, vectors()))) == Counter(
        brute_vectors.hard_negatives(rows, lambda i: i % 100 == 0))


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0] * 16)], [(100, None, [1.0] * 16)], [(100, 1, None)]])
def test_hard_negatives_of_almost_nothing(spark, rows):
    frame = spark.createDataFrame([(i, g, v, "x", 1, "y", 2, "z") for i, g, v in rows], VECTORS)
    assert queries.mined_negatives(frame).count() == 0


def test_segment_bounds_hold_and_rule_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    body = np.floor(1000 * (np.repeat(np.cumsum(centres, axis=1), 100, axis=0) + .1 * rng.normal(size=(2000, 64))))
    exact = body[:50] @ body.T
    for cuts in hard_negatives.levels(64):
        (ma, wa), (mb, wb) = hard_negatives.summary(body[:50], cuts), hard_negatives.summary(body, cuts)
        assert (np.abs(exact - ma @ mb.T) <= wa @ wb.T * (1 + 1e-9) + 1e-3).all()
    pages = [hard_negatives.Page(64, 1, np.arange(k, k + 100).tobytes(), body[k:k + 100].tobytes())
             for k in range(0, 2000, 100)]
    head = np.stack([np.arange(50), np.arange(50), np.zeros(50, np.int64)], axis=1)
    top = exact.max(axis=1).astype(np.int64)
    windows = np.stack([top * 8 // 10, top * 9 // 10], axis=1)[:, None, :]
    _, scored = hard_negatives.search_pages(pages, 64, head, body[:50], windows, False, 10)
    assert scored < .3 * exact.size


# --- vector codes

@pytest.mark.parametrize("large", [False, True])
def test_vector_codes(spark, large):
    rows = vectors(large=large)
    assert got(queries.vector_codes(table(spark, rows))) == Counter(brute_vectors.codes(rows))


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0] * 8)], [(1, 1, [1.0] * 3)], [(None, None, [0.5] * 8)] * 3])
def test_vector_codes_of_almost_nothing(spark, rows):
    frame = spark.createDataFrame([(i, g, v, "x", 1, "y", 2, "z") for i, g, v in rows], VECTORS)
    assert got(queries.vector_codes(frame)) == Counter(brute_vectors.codes(rows))


def test_equal_average_search_is_exact_and_skips():
    rng = np.random.default_rng(3)
    book = rng.integers(-90, 90, (64, 8))
    book[10] = book[40]
    parts = book[rng.integers(0, 64, 3000)] + rng.integers(-9, 9, (3000, 8))
    entry, distance, made = codebooks.search(parts, book)
    every = ((parts[:, None, :] - book) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert made < .4 * every.size
    whole = codebooks.search(parts.astype(object), book.astype(object))
    assert (whole[0] == entry).all() and (whole[1] == distance).all() and whole[2] == made


@pytest.mark.parametrize("value", [0, 1, -1, 1 << 32, -(1 << 70) + 12345, 10 ** 50])
def test_pieces_add_up(value):
    assert sum(piece * codebooks.BASE ** k for k, piece in codebooks.digits(value)) == value


# --- personal data

def card(rng):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return next(body + c for c in "0123456789" if brute_personal.luhn(body + c))


def personal_texts(seed=5):
    """Contexts that hold known identifiers, and others in the same places that no pattern knows."""
    rng = random.Random(seed)
    phone = lambda: "".join(rng.choice("23456789") for _ in range(9))
    out = []
    for k in range(12):
        out += [f"Please write to user{k}@mail{k}.example.com for more", f"Call me at +1 ({rng.randrange(100, 999)}) 555-{1000 + k} now",
                f"host ip: 10.{k}.3.{k + 4} answered", f"pay with card {card(rng)} today"]
    out += ["Please write to boss@localhost for more", "Call me at 555 123 9876 now", f"pay with card {card(rng)[:-1]}x or not",
            "Call me at 020-7946-0000 now\nand write to a@b", "host ip: 300.1.2.3 answered", "pay with card 4111 1111 1111 1112 today",
            f"the number {phone()} is nothing", "Version 1.2.3 of 2024-01-01 and 1.2.3.4.5.6.7.8"]
    out += [None, "", " \n", "@", "a@b@c.d x@y.z-@q.w a@b.c_d@e.f ..a@b..c@d.e", "+1+2 +12345678 90", "1 2-3 4" * 30, "é@é.com ñ +49 30 1234567",
            "𝔘𝔫 a@b.co 𝔘 1.2.3.4 𝔘", "0255.0.0.1 256.1.1.1 1.1.1.1.1 00000000001.2.3.4", "9" * 3000, "1 " * 3000, "a" * 3000 + " x@y.zz",
            "a." * 2000, "(" * 900 + "+(((1" + " " * 900 + "2", "4111-1111-1111-1111 4111 1111 1111 1111  4111111111111111", "x@y.z" * 3]
    out += [out[0]] * 30 + ["Call me at 555 123 9876 now"] * 3
    return [(None if k % 17 == 3 else k % 70, t) for k, t in enumerate(out)]


def personal_frame(spark, rows):
    return tables.frame(spark, [(i, t, None, None) for i, t in rows]).repartition(4)


def test_personal_data(spark):
    rows = personal_texts()
    expected = brute_personal.expected(rows)
    assert got(queries.personal(personal_frame(spark, rows))) == Counter(expected)
    named = {t: r[6] for (_, t), r in zip(rows, expected)}
    assert named["Call me at 555 123 9876 now"] == "phone:11:23"
    assert named["Please write to boss@localhost for more"] == "email:16:30"
    assert named["pay with card 4111 1111 1111 1112 today"] == "card:14:33"
    assert sum(r[6].count(":") for r in expected) > 2 * sum(sum(r[1:5]) for r in expected)


def test_personal_data_of_common_documents(spark):
    rows = [(i, t) for i, t, _, _ in tables.documents()]
    assert got(queries.personal(personal_frame(spark, rows))) == Counter(brute_personal.expected(rows))


def test_very_long_texts(spark):
    """Runs on which a plain search would be quadratic, or a nested group too deep for the stack."""
    runs = ["1 " * 60000, "a" * 200000, "a." * 90000, "9" * 90000, "(" * 90000, "1.2." * 30000, "+1" * 60000]
    rows = [(k, f"x@y.zz {t} x@y.zz 1.2.3.4") for k, t in enumerate(runs)]
    for i, *counts, _, spans in queries.personal(personal_frame(spark, rows)).collect():
        n = len(rows[i][1])
        dotted = runs[i].count("1.2.1.2.")
        assert counts == [2, 1 + dotted, 0, 0], i
        assert spans.startswith(f"email:0:6,email:{n - 14}:{n - 8},ip:") and spans.endswith(f"ip:{n - 7}:{n}")


def test_personal_data_of_nothing(spark):
    assert queries.personal(tables.frame(spark, [])).count() == 0


def test_rare_contexts_find_nothing(spark):
    rows = personal_texts()[:16] + [(900, "Call me at 555 123 9876 now")]
    found = personal_data.find(personal_frame(spark, rows))
    assert found.filter(F.size("added") > 0).count() == 0
