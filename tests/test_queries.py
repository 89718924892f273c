import tempfile
import zlib
from collections import Counter

import pytest
from oracle import DATA, check, connect

from palimpsest.plans import registry


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_agrees_with_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql().get(name))


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_hardlinks_of_every_line(spark):
    n = connect().execute("select count(*) from lineitem").fetchone()[0]
    assert registry.queries()["hardlink_groups_all"](spark, DATA).count() == n


def test_stream_of_every_document(spark):
    texts = [r[0].encode() for r in connect().execute("select text from documents where text <> ''").fetchall()]
    chunks = {t[i : i + 512] for t in texts for i in range(0, len(t), 512)}
    assert any(len(t) != len(t.decode()) for t in texts)
    assert registry.queries()["stream_ingest_all"](spark, DATA).first()["chunks"] == len(chunks)


def test_recompress_every_document(spark):
    texts = [r[0].encode() for r in connect().execute("select text from documents").fetchall()]
    want = Counter("recompressed" if len(zlib.compress(t, 6)) < len(t) else "no gain" for t in texts)
    assert len(want) == 2
    assert {r["outcome"]: r["objects"] for r in registry.queries()["recompress_tally_all"](spark, DATA).collect()} == want


def test_recreate_and_padding_of_every_document(spark):
    n = connect().execute("select count(*) from documents").fetchone()[0]
    assert registry.queries()["recreate_rechunk_all"](spark, DATA).count() == n
    assert registry.queries()["padme_padding_all"](spark, DATA).count() == n


def test_order_of_a_whole_diff(spark):
    queries = registry.queries()
    rows = sorted(queries["diff_order_all"](spark, DATA).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, queries["diff_months"](spark, DATA).count() + 1))
    kinds = [r["kind"] for r in rows]
    assert kinds == sorted(kinds, key=["changed", "added", "removed"].index) and len(set(kinds)) > 1


def test_places_over_many_ranges(spark):
    from palimpsest.operators import diff

    changes = spark.range(5000).selectExpr("cast(id % 3 as int) as order1", "id as order2", "0 as order3")
    folder = tempfile.mkdtemp() + "/placed"
    rows = sorted(diff.placed(changes, folder, 7).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in rows] == list(range(1, 5001))
    assert [tuple(r)[:3] for r in rows] == sorted(tuple(r)[:3] for r in rows)
    assert spark.read.parquet(folder).select("part").distinct().count() > 1


def test_sizes_beyond_gigabytes(spark):
    folder = tempfile.mkdtemp()
    connect().execute(f"copy (select * replace (o_orderkey * 6007 as o_orderkey) from orders) to '{folder}/orders.parquet'")
    check(spark, registry.queries()["human_bytes"], registry.oracle_sql()["human_bytes"], folder)
