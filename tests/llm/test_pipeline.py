"""The pipeline's stages on a small corpus, each judged on its own input, and the queries with SQL."""

import random
import re

import pytest
from oracle import DATA, check

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import common, decontam, queries, simhash, toxicity

from .conftest import prose


def test_queries_with_sql(spark):
    for name, sql in queries.oracle_sql().items():
        check(spark, queries.queries()[name], sql)


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if re.match(r"op[0-9]", n)] == list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11)) and "pipeline" in names


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    data, labels = [], []
    for i in range(300):
        t, toxic = prose(rnd, n=rnd.randint(30, 90)), int(rnd.random() < 0.25)
        if toxic:
            t += " idiot moron idiot"
        data.append((i, t, "en", "s", len(t)))
        labels.append((i, 0, toxic))
    item = "A train of 120 tons leaves the old station and runs for 7 hours to the far coast before it stops."
    data += [(1000, data[0][1], "en", "s", 1), (1001, item, "en", "s", 1), (1002, None, "en", "s", 1), (1003, "", None, None, None), (None, "no id at all", "en", "s", 1), (1004, prose(rnd), "en", "s", 1), (1004, "x", "en", "s", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(8, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.select("doc_id").collect())
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, common.table(spark, folder, "labels")).collect()}
    after = common.save(corpus_pipeline.drop_toxic(spark, docs, folder), "a")
    assert after.columns == columns
    assert ids(after) == sorted(-1 if i is None else i for i in ids(docs) if not verdict.get(None if i == -1 else i))
    lines = common.save(corpus_pipeline.dedup_lines(spark, after, folder), "b")
    assert lines.columns == columns and ids(lines) == ids(after)
    seen = {}
    for r in sorted(lines.where("doc_id is not null").collect(), key=lambda r: r["doc_id"]):
        for line in (r["text"] or "").split("\n"):
            if line.strip():
                assert seen.setdefault(line.strip().lower(), r["doc_id"]) == r["doc_id"]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(lines).collect()}
    near = common.save(corpus_pipeline.drop_near_duplicates(spark, lines, folder), "c")
    assert near.columns == columns and ids(near) == sorted([-1] * (None in found) + [i for i, c in found.items() if i is not None and i == c])
    bad = {r["doc_id"] for r in decontam.contaminations(near, common.table(spark, folder, "benchmark")).collect()}
    clean = common.save(corpus_pipeline.drop_contaminated(spark, near, folder), "d")
    assert bad == {1001} and ids(clean) == [i for i in ids(near) if i not in bad] and clean.columns == columns
    packed = corpus_pipeline.pack_sequences(spark, clean, folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def test_run(spark, folder):
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.save(stage(spark, docs, folder), "stage")
    key = lambda r: (r["doc_id"] or -1, r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, folder).collect())) == sorted(map(key, docs.collect()))


def test_small_tables(spark):
    for name in ("op1_line_dedup", "op4_suffix_dedup", "op9_simhash"):
        assert queries.queries()[name](spark, DATA).count() == common.table(spark, DATA, "documents").count()
