"""The pipeline stage by stage against plain versions, and the registered queries' SQL."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import tables  # noqa: E402
from edgetide.llm import mixing, queries  # noqa: E402
from edgetide.llm.flow import Tables  # noqa: E402
from oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""


def kept(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def check_stages(spark, docs, sf_dir, items):
    for name, stage in corpus_pipeline.STAGES:
        before = kept(docs)
        after = Tables(spark).stage(stage(spark, docs, sf_dir), "test")
        got = Counter(kept(after))
        if name == "language_id":
            assert got == Counter(r for r in before if brute.has_letter(r[1]))
        elif name == "ngram_jaccard_join":
            rows = brute.near_duplicates(before)
            sets = [brute.shingles(t) for _, t in before]
            alone = [r for r, s in zip(before, sets) if not s]
            groups = {c for (_, n, c) in rows if n}
            assert sum(got.values()) - len(alone) >= len(groups)
            assert all(d in groups or not brute.shingles(t) for d, t in got)
            assert max(got.values(), default=0) == 1 or alone
        elif name == "decontamination":
            bad = {r[0] for r in brute.contamination(list(enumerate(t for _, t in before)), items) if r[-1]}
            assert got == Counter(r for k, r in enumerate(before) if k not in bad)
        elif name == "mixing":
            times = {(r.doc_id, r.key, r.source): len(r.shards) for r in mixing.mix(docs).collect()}
            assert set(times.values()) <= {0, 1, 2, 3} and sum(got.values()) >= 1 and set(got) <= set(before)
        if name != "sharding":
            assert after.columns == docs.columns
            docs = after
            continue
        assert got == Counter(before)
        shards = Counter(r.shard for r in after.select("shard").collect())
        assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == min(24, len(before))
        slots = {(r.shard, r.slot) for r in after.select("shard", "slot").collect()}
        assert slots == {(s, k) for s, n in shards.items() for k in range(n)}


def test_stages_real(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF, items)


def test_stages_odd_rows(spark, tmp_path):
    rows = tables.documents()
    items = tables.benchmark(rows)[3:4]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check_stages(spark, tables.frame(spark, rows), str(tmp_path), items)


def test_run_empty(spark, tmp_path):
    tables.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
