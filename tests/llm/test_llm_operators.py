"""Each operator against a plain version on small tables that hold the odd cases."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import tables  # noqa: E402
from edgetide.llm import decontaminate, flow  # noqa: E402
from edgetide.llm import language, licenses, mixing, quality, queries, sharding, suffix_dedup, topk  # noqa: E402
from edgetide.llm.flow import Tables  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS = tables.documents()
TEXTS = [(i, t) for i, t, _, _ in ROWS]


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def docs(spark):
    return tables.frame(spark, ROWS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return tables.frame(spark, [])


def real(spark, name="documents", sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def same(df, expected):
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter(expected)


# --- sharding

def expected_shards(rows, shards=24):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    out = []
    for number, (i, t, _) in enumerate(sorted(rows, key=key)):
        place = brute.feistel(number, len(rows), sharding.SEED)
        out.append((i, len((t or "").encode()) + 8, brute.crc(t), "rows", place % shards, place // shards, None))
    return out


@pytest.mark.parametrize("source", ["docs", "real"])
def test_sharding(spark, docs, source):
    frame = docs if source == "docs" else real(spark)
    from edgetide.llm import flow
    same(queries.shard_documents(frame), expected_shards(pairs(frame, "doc_id", "text", flow.text_key())))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 257, 1000])
def test_permutation_is_one(spark, n):
    once = spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p")).select(
        sharding.walked(F.col("p"), n).alias("p"))
    assert sorted(r[0] for r in once.collect()) == list(range(n))


def test_shards_keep_columns(docs):
    out = sharding.shard_rows(docs, sharding.document_order(), 7)
    assert sorted(out.columns) == sorted({*docs.columns, "shard", "slot"})
    sizes = Counter(r[0] for r in out.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


# --- decontamination

def test_decontamination(spark, docs):
    items = tables.benchmark(ROWS)
    frame = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    got = queries.contamination(docs, frame)
    same(got, brute.contamination(TEXTS, known))
    assert got.filter("contaminated").count() > 10


def test_decontamination_nothing(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    same(queries.contamination(docs, empty), brute.contamination(TEXTS, []))
    assert queries.contamination(none, empty).count() == 0


def test_decontamination_positions_are_narrow(spark, docs):
    """Nothing between a document's words and the few words around a position is kept as a row."""
    bitmap = decontaminate.bitmap_of(docs.select(F.xxhash64("text").alias("h")), 1 << 22).scalar()
    keyed = docs.select("doc_id", "text", flow.text_key().alias("key"))
    with flow.settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        plan = decontaminate.positions(keyed, [5], bitmap, 1 << 22)._jdf.queryExecution().executedPlan().toString()
    loops = [re.search(rf"\*\((\d+)\) {step}", plan) for step in ("Project", "Filter", r"Generate explode\(CASE")]
    assert all(loops) and len({x[1] for x in loops}) == 1, plan


def test_decontamination_bitmap_grows(spark):
    """Many benchmark shingles don't let most document positions through."""
    keys, bits = 1_000_000, decontaminate.bits_for(1_000_000)
    hashed = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h"))
    bitmap = Tables(spark).stage(decontaminate.bitmap_of(hashed(0, keys), bits), "bitmap").scalar()
    hit = decontaminate.in_bitmap(bitmap, F.col("h"), bits)
    assert hashed(0, keys).filter(~hit).count() == 0
    assert hashed(keys, keys + 100_000).filter(hit).count() < 3_000
    assert decontaminate.bits_for(0) == 1 << 22 and decontaminate.bits_for(1 << 40) == decontaminate.MOST_BITS


def test_rows_without_shuffles_few(spark):
    """Rows that are no hits are not shuffled; null ids, null texts and repeated rows count."""
    docs = tables.frame(spark, ROWS)
    keyed = docs.select(F.col("doc_id").alias("hit_id"), flow.text_key().alias("hit_key"))
    hits = Tables(spark).stage(keyed.filter("hit_id is null or hit_id % 5 = 0").distinct(), "hits")
    with flow.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        got = decontaminate.rows_without(docs, hits, Tables(spark))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert Counter(tuple(r) for r in got.collect()) == Counter(
            tuple(r) for r in docs.collect() if r.doc_id is not None and r.doc_id % 5)
    assert "getbit" in plan[plan.index("SortMergeJoin"):].split("Exchange")[1]


# --- n-gram join

def test_near_duplicates(docs):
    expected = brute.near_duplicates(TEXTS)
    same(queries.near_duplicates(docs), expected)
    assert max(Counter(c for _, _, c in expected).values()) > 15


def test_near_duplicates_real(spark):
    frame = real(spark, sf="/root/testdata/sf0.01")
    same(queries.near_duplicates(frame), brute.near_duplicates(pairs(frame, "doc_id", "text")))


def test_near_duplicates_large_group(spark):
    """Near copies whose links form chains, all behind a few common shingles."""
    import random
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(100))
    rows = [(i, tables.edited(rng, base, rng.randrange(1, 5))) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(queries.near_duplicates(frame), brute.near_duplicates(rows))


# --- lines

@pytest.mark.parametrize("source", ["docs", "real"])
def test_lines(spark, docs, source):
    frame = docs if source == "docs" else real(spark)
    same(queries.repeated_lines(frame), brute.line_dedup(pairs(frame, "doc_id", "text")))


def test_lines_small_filter(docs, monkeypatch):
    from edgetide.llm import line_dedup
    monkeypatch.setattr(line_dedup, "MAX_BITS", 64)
    same(queries.repeated_lines(docs), brute.line_dedup(TEXTS))


# --- suffix array

@pytest.mark.parametrize("source", ["docs", "real"])
def test_repeats(spark, docs, source):
    frame = docs if source == "docs" else real(spark)
    expected = brute.suffix_dedup(pairs(frame, "doc_id", "text"))
    same(queries.repeated_bytes(frame).drop("n_kept", "has_repeats"), expected)
    assert sum(r[2] for r in expected) > 1000


def test_repeats_cut_pieces_and_dealt_groups(docs, monkeypatch):
    """Small limits, set on the driver, for texts in several pieces and picks over several tasks."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    found = queries.repeated_bytes(docs)
    same(found.drop("n_kept", "has_repeats"), brute.suffix_dedup(TEXTS))
    for r in found.collect():
        assert r.n_kept == r.n_bytes - r.n_removed and r.has_repeats == (r.n_removed > 0) == (r.n_spans > 0)


def test_deep_shallow_order():
    import random
    import numpy as np
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    strings += [b"same" * 20 + s for s in strings[:150]] + [b"same" * 20 + s for s in strings[:150]]
    groups = np.array([rng.randrange(3) for _ in strings])
    order, lcp = suffix_dedup.deep_shallow(strings, groups)
    keyed = [(groups[i], strings[i]) for i in order]
    assert keyed == sorted(keyed)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        if groups[order[k - 1]] != groups[order[k]]:
            assert lcp[k] == -1
        else:
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n


# --- language and quality

def test_language(spark, docs, none):
    frame = real(spark, sf="/root/testdata/sf0.01")
    truth = dict(pairs(frame, "doc_id", "lang"))
    held = [r for r in queries.languages(frame).collect() if r.held_out]
    right = sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held)
    assert right > 0.98 and all(0 <= r.score <= 1 for r in held)
    got = queries.languages(docs).collect()
    assert len(got) == len(ROWS)
    letters = Counter(i for i, t in TEXTS if not brute.has_letter(t))
    assert Counter(r.doc_id for r in got if r.lang_pred == "und") == letters
    assert queries.languages(none).count() == 0


def units(langs, counts):
    return language.Units.of([(lang, unit, n) for unit, own in counts.items() for lang, n in own.items()], langs)


def test_language_backs_off_to_ngrams():
    langs = ["a", "b"]
    model = {"langs": langs, "rare": np.zeros(2), "words": units(langs, {}),
             "grams": units(langs, {"xy": {"a": 5}, "z": {"b": 9, "a": 1}})}
    scores = language.word_scores(model, ["qxyq", "z", "q"])
    assert scores[0].argmax() == 0 and scores[1].argmax() == 1 and scores[2].tolist() == [0, 0]


def test_language_equals_brute_force(spark):
    texts = [("hi", "हिन्दी में लिखा हुआ पाठ"), ("hi", "यह हिन्दी है"), ("en", "this is some text, 3 times"), ("en", "e\u0301te this"),
             ("de", "das ist ein Text"), ("de", "ÜBER das"), ("fr", "voilà l'été ½"), ("fr", None), (None, "no language")]
    rows = [(k, *texts[k % len(texts)], "s") for k in range(60)]
    odd = ["²", "½ ½", "Ⅷ", "", None, "123", "\u0301\u0301", "हिन्दी", "das neue", "zzz", "thisword", "İstanbul", "a ²"]
    rows += [(100 + k, None, t, "s") for k, t in enumerate(odd)]
    frame = spark.createDataFrame([(i, t, g, s) for i, g, t, s in rows], "doc_id long, text string, lang string, source string")
    held = {r.doc_id: r.held_out for r in queries.languages(frame).collect()}
    predict = brute.language_model([(g, t) for i, g, t, _ in rows if not held[i]])
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in queries.languages(frame).collect()}
    assert got == {i: (p, round(s, 9)) for i, _, t, _ in rows for p, s in [predict(t)]}
    answers = dict(zip(odd, (got[100 + k][0] for k in range(len(odd)))))
    assert [answers[t] for t in odd[:7]] == ["und"] * 7 and answers["हिन्दी"] == "hi" and answers["a ²"] != "und"


def test_many_languages_take_little_memory():
    langs = [f"l{k:03d}" for k in range(100)]
    words = language.Units.of([(langs[k % 100], f"word{k // 2}", 1 + k % 9) for k in range(400_000)], langs)
    assert sum(a.nbytes for a in (words.hashes, words.starts, words.langs, words.gains)) < 12_000_000
    memo = language.Memo({"langs": langs, "rare": np.zeros(100), "words": words, "grams": units(langs, {})})
    assert memo.scores.nbytes <= language.MEMO_BYTES
    for k in range(0, 300_000, 30_000):
        memo.learn({f"word{n}" for n in range(k, k + 30_000)} | {"word1"})
        assert sorted(np.argsort(memo.scores[memo.place["word1"]])[-2:].tolist()) == [2, 3]
    assert memo.scores.nbytes <= language.MEMO_BYTES


def test_quality(spark, docs, none):
    frame, labels = real(spark, sf="/root/testdata/sf0.01"), real(spark, "labels", "/root/testdata/sf0.01")
    truth = dict(pairs(labels, "doc_id", "quality"))
    got = queries.qualities(frame, labels).collect()
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    few = spark.createDataFrame([(i, i % 2 if i % 5 else None, None) for i in range(60)],
                                "doc_id long, quality int, toxic int")
    assert queries.qualities(docs, few).count() == len(ROWS)
    assert queries.qualities(none, few).count() == 0 and queries.qualities(docs, few.limit(0)).count() == len(ROWS)


def test_network_temperature():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.Network(x, y)
    p = net.scores(x)
    assert np.mean((p > 0.5) == y) > 0.75 and abs(p.mean() - y.mean()) < 0.05


# --- top-k

def expected_neighbours(rows, k=10):
    import math
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v
              and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q % 100 == 0:
            best = sorted((-min(2**63 - 1, max(-2**63, sum(a * b for a, b in zip(v, w)))), i)
                          for n, (i, w) in enumerate(usable) if n != at and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_top_k(spark, monkeypatch):
    frame = real(spark, "embeddings")
    same(queries.neighbours(frame), expected_neighbours(pairs(frame, "vec_id", "embedding")))
    monkeypatch.setattr(topk, "TREE", 90)
    monkeypatch.setattr(topk, "QUERIES", 2)
    same(queries.neighbours(frame), expected_neighbours(pairs(frame, "vec_id", "embedding")))


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (100, [0.1, -0.9]), (200, [0.0, 0.0]), (300, None), (400, []), (500, [nan, 1.0]),
            (600, [inf, 1.0]), (700, [None, 1.0]), (800, [1.0]), (900, [-2.0]), (None, [1.0, 1.0])]
    rows += [(k, [0.25, 0.25]) for k in range(1, 80)] + [(k, [-3.0, 0.001 * k]) for k in range(101, 130)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in queries.neighbours(frame).collect()]
    assert Counter(got) == Counter(expected_neighbours(pairs(frame, "vec_id", "embedding")))
    assert queries.neighbours(frame.limit(0)).count() == 0


def test_top_k_large_components_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE", 20)
    rng = __import__("random").Random(4)
    rows = [(k % 60 * 50, [rng.choice([1.0, 3e6, -5e9, 1e30, -2.5]) * rng.random() for _ in range(3)])
            for k in range(150)] + [(0, [1.0, 2.0, 3.0])] * 3 + [(7, [3e6, 3e6, 3e6])] * 40
    for used in (rows, [(i, [x if abs(x) < 1e8 else 3e6 for x in v]) for i, v in rows], rows[-44:], rows[-43:-41]):
        frame = spark.createDataFrame([(i, v, "x", 1) for i, v in used],
                                      "vec_id long, embedding array<double>, row string, id int").repartition(3)
        got = [tuple(r) for r in queries.neighbours(frame).collect()]
        assert Counter(got) == Counter(expected_neighbours(used))


def test_clustered_queries_go_to_few_cells(spark, monkeypatch):
    """A query crosses into other cells only where they may hold a better row."""
    import numpy as np
    monkeypatch.setattr(topk, "TREE", 100)
    sent, real_drop = [], topk.Tables.drop

    def drop(self, *staged):
        sent.extend(f.count() for f in staged if "block" in f.columns and "known" in f.columns)
        real_drop(self, *staged)
    monkeypatch.setattr(topk.Tables, "drop", drop)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(16, 8)) * 40
    centres /= np.sqrt((centres ** 2).sum(axis=1))[:, None] / 40
    rows = [(k, (centres[k % 16] + rng.normal(size=8) * 0.2).tolist()) for k in range(1601)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in queries.neighbours(frame).collect()]
    assert Counter(got) == Counter(expected_neighbours(rows))
    trees, asked = 17, 17
    assert len(sent) == 2 and sum(sent) < trees * asked / 2


def test_tree_leaves_pages_out():
    import numpy as np
    rng = np.random.default_rng(5)
    whole = np.concatenate([rng.integers(-20, 20, (400, 8)) + c for c in (0, 300, -300, 900)])
    big = float((whole.astype(float) ** 2).sum(axis=1).max())
    points = np.concatenate([whole, np.sqrt(big - (whole ** 2).sum(axis=1))[:, None]], axis=1)
    ids = np.arange(1600)
    best, seen = topk.search(topk.build_pages(points), ids, ids, whole, big, whole[1300], 1300, 10)
    assert len(best) == 10 and seen < 800
    again, fewer = topk.search(topk.build_pages(points), ids, ids, whole, big, whole[1300], 1300, 10, min(best)[0])
    assert sorted(again) == sorted(best) and fewer <= seen


# --- mixing

def near_target(rows):
    """Each source's words within half the largest document and a block of its target."""
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        slack = max(r.size for r in own) * max(r.copies for r in own) + own[0].source_size / mixing.BLOCKS + 1
        taken = sum(r.size * len(r.shards) * r.copies for r in own)
        assert abs(taken - own[0].target) <= slack, (own[0].source, taken, own[0].target, slack)
        assert all(len(r.shards) <= 3 for r in own)


@pytest.mark.parametrize("source", ["docs", "real"])
def test_mixing(spark, docs, none, source):
    frame = docs if source == "docs" else real(spark)
    rows = mixing.mix(frame).collect()
    sizes = Counter()
    for s, t in pairs(frame, "source", "text"):
        sizes[s] += len((t or "").encode().split())
    assert {r.source: (r.source_size, round(r.target, 6)) for r in rows} == {
        s: (sizes[s], round(t, 6)) for s, t in brute.targets(dict(sizes)).items()}
    assert sum(r.copies for r in rows) == frame.count()
    near_target(rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame.repartition(3)).collect()))
    assert mixing.mix(none).count() == 0


def test_mixed_rows(docs):
    plan = {(r.doc_id, r.key, r.source): len(r.shards) * r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.count() == sum(plan.values())
    assert out.select("row.*").columns == docs.columns


def test_result_comes_from_the_tree(spark, docs, monkeypatch):
    first = {(r.doc_id, r.text_key): r.shards for r in _with_key(docs)}
    assert len({n for x in first.values() for n in x.split(",") if n}) > 4
    monkeypatch.setattr(mixing, "drawn", lambda counts, n, node: F.transform(
        counts, lambda c: F.call_function("div", c, F.lit(2))))
    assert first != {(r.doc_id, r.text_key): r.shards for r in _with_key(docs)}


def _with_key(docs):
    return mixing.mix(docs).select("doc_id", F.col("key").alias("text_key"), F.array_join("shards", ",").alias("shards")).collect()


def test_draws_follow_the_hypergeometric_law(spark):
    counts, n, runs = [30, 10, 5], 20, 4000
    got = spark.range(runs).select(mixing.drawn(F.array(*[F.lit(c).cast("long") for c in counts]), F.lit(n), F.col("id")).alias("d"))
    hits = np.array([r.d for r in got.collect()])
    assert (hits.sum(axis=1) == n).all()
    for k, c in enumerate(counts):
        share = c / 45
        spread = n * share * (1 - share) * (45 - n) / 44
        assert abs(hits[:, k].mean() - n * share) < 4 * (spread / runs) ** .5
        assert .9 < hits[:, k].var() / spread < 1.1


def test_shards_are_written_in_their_order(docs):
    rows = mixing.shuffled_rows(docs)
    want = mixing.mixed_rows(docs)
    assert Counter(map(str, rows.collect())) == Counter(str(r[0]) for r in want.collect())
    assert rows.columns == docs.columns


def test_splitting_tree(spark):
    from edgetide.llm.flow import Tables
    quotas = spark.createDataFrame([(0, 700), (1, 0), (2, 41), (3, 1300)], "place long, quota long")
    upto = dict(mixing.shard_quotas(quotas, Tables(spark), 7).collect())
    cells = {p: [b - a for a, b in zip([0, *u], u)] for p, u in upto.items()}
    assert {p: sum(c) for p, c in cells.items()} == {0: 700, 1: 0, 2: 41, 3: 1300}
    totals = [sum(c[k] for c in cells.values()) for k in range(7)]
    assert max(totals) - min(totals) <= 3 and all(x >= 0 for c in cells.values() for x in c)


# --- licences

def test_licences(spark, docs, none):
    notes = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "nothing here", *notes, *(n.upper() + " indeed" for n in notes),
             "a\n\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the\n"
             "GNU General Public License as published by the Free Software Foundation,\neither version 3 of the "
             "License, or (at your option) any later version.\n\nb", *(n + " " + n for n in notes[:4])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licences(frame).collect()}
    import re
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        units = lines + [p for p in re.split(r"\n[ \t\r]*\n", text or "") if "\n" in p] + [text] * (len(lines) > 1)
        found = [(round(brute.dice(u, t), 9), -k, n) for u in units
                 for k, (n, t) in enumerate(licenses.TEMPLATES) if u and brute.dice(u, t) >= licenses.LEAST]
        assert got[i].licences == sorted({n for _, _, n in found}), text
        if found:
            best = max(found)
            assert (got[i].best_licence, round(got[i].best_dice, 9)) == (best[2], best[0])
    assert queries.licence_scan(docs).count() == len(ROWS) and queries.licence_scan(none).count() == 0


@pytest.mark.parametrize("name", ["shard_documents", "near_duplicates", "repeated_lines", "repeated_bytes", "mixture"])
def test_empty_tables(none, name):
    assert getattr(queries, name)(none).count() == 0
