"""Chunkers, codecs, packs, tars, trees and the repository commands."""

import hashlib
import io
import os
import random
import stat
import tarfile
from datetime import datetime, timedelta

import pytest

from palimpsest.functions import chunking, codec, template
from palimpsest.operators import patterns
from palimpsest.plans.repository import Repository
from palimpsest.sources import envelope, tar, walk

SPECS = ["fixed,100", "fixed,100,30", "fastcdc,6,10,8,2", "fastcdc,7,12,9,0", "buzhash64,6,10,8,31,1", "buzhash64,6,11,9,64", "buzhash,6,10,8,48"]


def blob(n, seed=0):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("spec", SPECS)
def test_every_byte_is_accounted_for(spec):
    p = chunking.Params.parse(spec)
    for n in (0, 1, 29, 30, 31, 63, 64, 100, 131, 5000):
        data = blob(n, n)
        pieces = list(chunking.split(data, p))
        assert b"".join(x[5] for x in pieces) == data
        if p.algorithm != "fixed":
            assert all(x[2] <= 1 << p.max_exp for x in pieces)
            assert all(x[2] >= 1 << p.min_exp for x in pieces[:-1])
    assert all(x[4] == "zero" and not x[5] for x in chunking.split(bytes(3000), p))


@pytest.mark.parametrize("spec", [s for s in SPECS if not s.startswith("fixed")])
def test_boundaries_come_back_after_an_insertion(spec):
    p = chunking.Params.parse(spec)
    data = blob(40_000, 1)
    a = {x[3] for x in chunking.split(data, p)}
    b = {x[3] for x in chunking.split(data[:9000] + b"inserted" + data[9000:], p)}
    assert len(a - b) < 0.2 * len(a)


def test_rolling_hashes_are_windowed():
    import numpy as np

    data, key = np.frombuffer(blob(600, 2), np.uint8), b"k"
    gear, buz = chunking.table(key, "gear"), chunking.table(key, "buz")
    h = 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(gear[c])) & (2**64 - 1)
        assert chunking.gear_hashes(data, key)[i] == h if i in (0, 63, 64, 599) else True
    rot = lambda x, k: ((x << k % 64) | (x >> (64 - k % 64))) & (2**64 - 1) if k % 64 else x
    for w in (31, 64, 100):
        got = chunking.buz_hashes(data, key, w)
        for i in (w - 1, 300, 599):
            want = 0
            for k in range(w):
                want ^= rot(int(buz[data[i - k]]), k)
            assert int(got[i]) == want


def test_chunker_specs():
    for bad in ("fixed,0", "fastcdc,20,10,15", "fastcdc,a,b,c", "nothing,1", "buzhash,6,10,8,31,1", "fastcdc,6,30,8"):
        with pytest.raises(ValueError):
            chunking.Params.parse(bad)
    with pytest.raises(NotImplementedError):
        chunking.Params.parse("rabin-aes,1,2,3")
    assert chunking.Params.parse(chunking.DEFAULT).max_exp == 23


@pytest.mark.parametrize("spec", ["none", "zstd,1", "zlib,9", "lzma,0", "auto,zstd,3", "auto,lzma,6", "obfuscate,250,zstd,3", "obfuscate,3,none", "obfuscate,112,auto,zlib,6"])
def test_codec_round_trip(spec):
    s = codec.Spec.parse(spec)
    assert codec.Spec.parse(str(s)) == s
    for data in (b"", b"a", blob(5000), b"abc" * 5000, bytes(3000)):
        ctype, _, size, stored = codec.compress(s, data)
        assert codec.decompress(ctype, size, stored) == data
        if s.obfuscate is None:
            assert len(stored) <= len(data)
    assert codec.compress(codec.Spec.parse("zstd"), blob(3000))[0] == "none"


def test_codec_specs():
    for bad in ("zip", "zlib,10", "obfuscate,7,none", "obfuscate,250", "auto", "zstd,x"):
        with pytest.raises(ValueError):
            codec.Spec.parse(bad)
    with pytest.raises(NotImplementedError):
        codec.compress(codec.Spec.parse("lz4"), b"abc")


def test_packs(spark, tmp_path):
    objects = [(hashlib.sha256(bytes([i])).digest(), blob(50 + i, i)) for i in range(5)]
    pack = b"".join(envelope.pack_object(i, b"F", b"m", d, len(d)) for i, d in objects)
    (tmp_path / "p0").write_bytes(pack)
    (tmp_path / "p1").write_bytes(pack[:-3])
    (tmp_path / "p2").write_bytes(b"")
    rows = envelope.scan_headers(envelope.read_packs(spark, str(tmp_path))).collect()
    first = sorted((r for r in rows if r["pack_id"].endswith("p0")), key=lambda r: r["obj_offset"])
    assert [r["chunk_id"] for r in first] == [i.hex() for i, _ in objects]
    assert all(envelope.read_object(pack, r["obj_offset"])[1] == d for r, (_, d) in zip(first, objects, strict=True))
    assert sum(r["pack_id"].endswith("p1") for r in rows) == 4


def test_tar_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    os.makedirs(src / "sub")
    (src / "sub" / "a.txt").write_bytes(b"hello")
    (src / "empty").write_bytes(b"")
    os.symlink("sub/a.txt", src / "link")
    os.link(src / "sub" / "a.txt", src / "zhard")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        t.add(src, "top")
    tar.register(spark)
    rows = {r["path"]: r for r in spark.read.format("tar").option("stripComponents", "1").load(str(tmp_path / "x.tar.gz")).collect()}
    assert set(rows) == {"sub", "sub/a.txt", "empty", "link", "zhard"}
    assert rows["link"]["target"] == "sub/a.txt" and rows["sub"]["type"] == "d"
    out = tmp_path / "out"
    spark.read.format("tar").load(str(tmp_path / "x.tar.gz")).coalesce(1).write.format("tar").mode("append").option("compression", "xz").save(str(out))
    (made,) = [f for f in os.listdir(out) if f.startswith("part-00000")]
    with tarfile.open(out / made) as t:
        assert {m.name for m in t} == {"top", "top/sub", "top/sub/a.txt", "top/empty", "top/link", "top/zhard"}


def test_walk(spark, tmp_path):
    os.makedirs(tmp_path / "d" / "skip")
    (tmp_path / "d" / "f").write_bytes(b"abc")
    (tmp_path / "d" / "skip" / "g").write_bytes(b"x")
    os.symlink("f", tmp_path / "d" / "l")
    walk.register(spark)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in spark.read.format("walk").option("excludeNames", "skip").load(str(tmp_path / "d")).collect()}
    assert set(rows) == {"d", "f", "l"} and rows["f"]["size"] == 3 and rows["l"]["target"] == "f"
    assert {r["path"].rsplit("/", 1)[-1] for r in walk.listed(spark, str(tmp_path / "d")).collect()} >= {"f", "g"}
    (tmp_path / "list").write_text("a;b;;c")
    assert [r["path"] for r in walk.paths_from(spark, str(tmp_path / "list"), ";").collect()] == ["a", "b", "c"]


def test_repository_life(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r")).create_repository()
    with pytest.raises(FileExistsError):
        repo.create_repository()
    files = spark.createDataFrame([("a/x", bytearray(blob(3000, 1))), ("a/y", bytearray(b"")), ("b/z", bytearray(bytes(2000))), ("b/n", None)], "path string, content binary")
    one = repo.create("first", files, "fastcdc,6,10,8,2", time=datetime(2024, 1, 1))
    two = repo.create("first", files.where("path <> 'a/y'"), "fastcdc,6,10,8,2", tags=("t",), time=datetime(2024, 1, 2))
    chunks = repo.info().first()
    assert chunks["archives"] == 2 and repo.table("chunks").count() == repo.index().count()
    got = {r["path"]: bytes(r["content"]) for r in repo.extract(one).collect()}
    assert got == {"a/x": blob(3000, 1), "a/y": b"", "b/z": bytes(2000), "b/n": b""}
    assert repo.check(verify_data=True).count() == 0
    repo.rename(two, "second")
    repo.tag(two, add=("k",), remove=("t",))
    row = repo.archives().where(f"archive_id = '{two}'").first()
    assert (row["name"], row["tags"]) == ("second", ["k"])
    small = repo.recreate(one, [patterns.Rule("-", "pp", "b")])
    assert {r["path"] for r in repo.extract(small).collect()} == {"a/x", "a/y"}
    other = Repository(spark, str(tmp_path / "o")).create_repository()
    assert len(other.transfer(repo)) == 2 and other.transfer(repo) == []
    repo.export_tar(two, str(tmp_path / "tars"))
    names = ",".join(str(tmp_path / "tars" / f) for f in os.listdir(tmp_path / "tars") if f.endswith(".tar"))
    back = other.import_tar("tar", names, chunker="fixed,512")
    assert {r["path"]: bytes(r["content"]) for r in other.extract(back).collect()} == {k: v for k, v in got.items() if k != "a/y"}
    repo.extract_to(two, str(tmp_path / "files"), strip=1)
    assert (tmp_path / "files" / "x").read_bytes() == blob(3000, 1)
    repo.delete(two)
    assert repo.archives().count() == 1
    repo.undelete(two)
    repo.delete(two)
    repo.delete(small)
    stats = repo.compact().first()
    assert stats["packs_dropped"] + stats["packs_rewritten"] > 0 and repo.index().count() == 0
    decided = other.prune({"daily": 1}, now=datetime(2024, 2, 1) + timedelta(0))
    assert decided.count() == 3
    repo.delete_repository()
    with pytest.raises(FileNotFoundError):
        repo.archives()


def test_compact_refuses_missing_chunks(spark, tmp_path):
    import shutil

    repo = Repository(spark, str(tmp_path / "r")).create_repository()
    files = spark.createDataFrame([("a", bytearray(blob(500, 1))), ("b", bytearray(blob(500, 2)))], "path string, content binary")
    one = repo.create("n", files, "fixed,600")
    gone = repo.table("chunk_refs").where("path = 'a'").first()["chunk_id"]
    index = repo.index().where(f"chunk_id <> '{gone}'").selectExpr("chunk_id", "brought_by", "size", "csize", "cast(0 as bigint) as fragment").collect()
    shutil.rmtree(tmp_path / "r" / "index")
    spark.createDataFrame(index, "chunk_id string, brought_by string, size bigint, csize bigint, fragment bigint").write.parquet(str(tmp_path / "r" / "index"))
    assert {r["problem"] for r in repo.check().collect()} == {"missing"}
    with pytest.raises(ValueError):
        repo.compact()
    fixed = repo.repair(one)
    assert {r["path"] for r in repo.extract(fixed).collect()} == {"b"} and repo.check().count() == 0


def test_templates(spark):
    df = spark.createDataFrame([("ab", 7, None), ("abcdefgh", 12345, "x")], "s string, n bigint, z string")
    lines = [r["line"] for r in template.rendered(df, "{s:5}|{s:.3}|{s:>6}|{s:*^7}|{n:3}|{n:<4}|{z}{{}}{NL}").collect()]
    assert lines == ["ab   |ab|    ab|**ab***|  7|7   |{}\n", "abcdefgh|abc|abcdefgh|abcdefgh|12345|12345|x{}\n"]
    assert template.keys("{a:5}{LF}{b}{a}") == ["a", "b"]
    for bad in ("{", "}", "{a!r}", "{}"):
        with pytest.raises(ValueError):
            template.keys(bad)
    with pytest.raises(ValueError):
        template.rendered(df, "{n:.2}")
    assert template.placeholders("{host}-{now:%Y}{{x}}", {"host": "h", "now": datetime(2024, 1, 1)}) == "h-2024{x}"


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from palimpsest.streaming.ingest import deduplicated_stream, stream_chunks

    rows = [(i, bytearray(blob(300, i % 3)), datetime(2024, 1, 1, 0, i % 5)) for i in range(12)]
    schema = "id bigint, data binary, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        stream_chunks(files, out, str(tmp_path / "check"), "id", "data", "fixed,100").awaitTermination()
        spark.createDataFrame([(99, bytearray(blob(300, 1) + blob(100, 9)), datetime(2024, 1, 2))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = [r["chunk_id"] for r in spark.read.parquet(out).collect()]
    want = {hashlib.sha256(blob(300, k)[a : a + 100]).hexdigest() for k in range(3) for a in (0, 100, 200)} | {hashlib.sha256(blob(100, 9)).hexdigest()}
    assert len(got) == len(want) and set(got) == want
    ids = files.select(F.sha2("data", 256).alias("chunk_id"), "ts")
    query = deduplicated_stream(ids, "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == spark.table("once").select("chunk_id").distinct().count() == 4


def test_recompress_report(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r")).create_repository()
    files = spark.createDataFrame([("a", bytearray(b"abc" * 400)), ("b", bytearray(blob(900, 1)))], "path string, content binary")
    repo.create("n", files, "fixed,5000", "none")
    assert {(r["outcome"], r["objects"]) for r in repo.recompress("zlib,9").collect()} == {("recompressed", 1), ("no gain", 1)}
    assert {r["outcome"] for r in repo.recompress("none").collect()} == {"already"}
    assert repo.compact_plan().first()["action"] == "keep"


def test_recompress_in_place(spark, tmp_path):
    repo = Repository(spark, str(tmp_path / "r")).create_repository()
    files = spark.createDataFrame([("a", bytearray(b"abc" * 400)), ("b", bytearray(blob(900, 1))), ("c", bytearray(b"x" * 900))], "path string, content binary")
    one = repo.create("n", files, "fixed,5000", "none")
    two = repo.create("m", files.where("path = 'b'"), "fixed,100", "none")
    before = repo.info().first()
    assert {(r["outcome"], r["objects"]) for r in repo.recompress_in_place("zlib,9").collect()} == {("recompressed", 2), ("no gain", 10)}
    after = repo.info().first()
    assert after["chunks"] == before["chunks"] and after["stored_size"] < before["stored_size"]
    assert repo.table("chunks").count() == repo.index().count() == repo.stored().count()
    assert {r["ctype"] for r in repo.stored().collect()} == {"zlib", "none"}
    want = {"a": b"abc" * 400, "b": blob(900, 1), "c": b"x" * 900}
    assert {r["path"]: bytes(r["content"]) for r in repo.extract(one).collect()} == want
    assert bytes(repo.extract(two).first()["content"]) == want["b"] and repo.check(verify_data=True).count() == 0
    assert {r["outcome"] for r in repo.recompress_in_place("zlib,9").collect()} == {"already", "no gain"}


def test_transfer_copies_only_missing_chunks(spark, tmp_path):
    source, target = (Repository(spark, str(tmp_path / n)).create_repository() for n in "st")
    files = spark.createDataFrame([("a", bytearray(blob(900, 1))), ("b", bytearray(blob(900, 2))), ("e", bytearray(b""))], "path string, content binary")
    target.create("have", files.where("path = 'a'"), "fixed,300", time=datetime(2024, 1, 1))
    source.create("all", files, "fixed,300", "zlib,6", tags=("t",), time=datetime(2024, 1, 2))
    had = target.table("chunks").count()
    (new,) = target.transfer(source)
    assert target.table("chunks").count() - had == 3 and target.transfer(source) == []
    assert {r["path"]: bytes(r["content"]) for r in target.extract(new).collect()} == {"a": blob(900, 1), "b": blob(900, 2), "e": b""}
    row = target.archives().where(f"archive_id = '{new}'").first()
    assert (row["name"], row["tags"], row["nfiles"], row["size"]) == ("all", ["t"], 3, 1800)
    again = Repository(spark, str(tmp_path / "u")).create_repository()
    (copy,) = again.transfer(source, "none")
    assert {r["ctype"] for r in again.stored().collect()} == {"none"} and again.extract(copy).count() == 3


def test_a_run_that_fails_keeps_the_index_whole(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    repo = Repository(spark, str(tmp_path / "r")).create_repository()
    files = spark.createDataFrame([("a", bytearray(b"ab" * 450)), ("b", bytearray(b"cd" * 450))], "path string, content binary")
    both = repo.create("both", files, "fixed,301", "none", time=datetime(2024, 1, 1))
    keep = repo.create("keep", files.where("path = 'a'"), "fixed,301", "none", time=datetime(2024, 1, 2))
    for step in ("_move", "_drop_groups"):
        with monkeypatch.context() as m:
            m.setattr(Repository, step, fail)
            with pytest.raises(OSError):
                repo.recompress_in_place("zlib,6")
        assert repo.check(verify_data=True).count() == 0 and bytes(repo.extract(both).where("path = 'a'").first()["content"]) == b"ab" * 450
    repo.delete(both)
    with monkeypatch.context() as m:
        m.setattr(Repository, "_drop_groups", fail)
        with pytest.raises(OSError):
            repo.compact()
    assert repo.check().count() == 0 and bytes(repo.extract(keep).first()["content"]) == b"ab" * 450
    repo.compact()
    assert bytes(repo.extract(keep).first()["content"]) == b"ab" * 450


@pytest.mark.parametrize("spec", ["fastcdc,6,10,8,2", "buzhash64,6,10,8,48", "buzhash,6,10,8,17"])
def test_chunks_do_not_depend_on_steps(monkeypatch, spec):
    data = blob(20_000, 3)
    params = chunking.Params.parse(spec)
    want = chunking.cuts(data, params, b"k")
    monkeypatch.setattr(chunking, "STEP", 100)
    assert chunking.cuts(data, params, b"k") == want and len(want) > 20


def test_tar_keeps_every_kind(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as t:

        def put(name, kind, data=b"", **more):
            m = tarfile.TarInfo(name)
            m.type, m.size, m.mtime, m.mode = kind, len(data), 1_700_000_000, 0o644
            for k, v in more.items():
                setattr(m, k, v)
            t.addfile(m, io.BytesIO(data))

        put("d", tarfile.DIRTYPE, mode=0o750, uid=7, gid=8, uname="u", gname="g")
        put("d/f", tarfile.REGTYPE, b"first")
        put("d/f", tarfile.REGTYPE, b"hello", mode=0o4640, uid=7)
        put("d/hard", tarfile.LNKTYPE, linkname="d/f")
        put("d/hard2", tarfile.LNKTYPE, linkname="d/hard")
        put("lost", tarfile.LNKTYPE, linkname="nowhere")
        put("soft", tarfile.SYMTYPE, linkname="d/f")
        put("pipe", tarfile.FIFOTYPE)
        put("dev", tarfile.CHRTYPE, devmajor=1, devminor=3)
        put("out", tarfile.SYMTYPE, linkname="/etc")
        put("out/x", tarfile.REGTYPE, b"no link")
    repo, other = (Repository(spark, str(tmp_path / n)).create_repository() for n in "ro")
    one = repo.import_tar("t", str(tmp_path / "x.tar"), chunker="fixed,512")
    items = {r["path"]: r.asDict() for r in repo.table("items").collect()}
    assert set(items) == {"d", "d/f", "d/hard", "d/hard2", "lost", "soft", "pipe", "dev", "out", "out/x"}
    assert (items["d"]["mode"], items["d"]["uid"], items["d"]["group"], items["d/f"]["mode"]) == (0o040750, 7, "g", 0o104640)
    assert {items[p]["hlid"] for p in ("d/f", "d/hard", "d/hard2")} == {"d/f"} and items["out/x"]["hlid"] is None
    assert (items["soft"]["target"], items["dev"]["rdev"], items["d/hard2"]["size"]) == ("d/f", os.makedev(1, 3), 5)
    content = {r["path"]: bytes(r["content"]) for r in repo.extract(one).collect()}
    assert content["d/hard2"] == b"hello" and content["lost"] == b""

    repo.export_tar(one, str(tmp_path / "tars"))
    names = [str(tmp_path / "tars" / f) for f in sorted(os.listdir(tmp_path / "tars")) if f.endswith(".tar")]
    for name in names:
        with tarfile.open(name) as t:
            seen = set()
            for m in t:
                assert not m.islnk() or m.linkname in seen
                seen.add(m.name)
    back = other.import_tar("t", ",".join(names), chunker="fixed,512")
    again = {r["path"]: r.asDict() for r in other.table("items").collect()}
    clean = lambda rows: {p: {k: v for k, v in r.items() if k != "archive_id" and (p, k) != ("lost", "hlid")} for p, r in rows.items()}
    plain = {p: {k: v or None for k, v in r.items()} for p, r in clean(items).items()}
    assert {p: {k: v or None for k, v in r.items()} for p, r in clean(again).items()} == plain
    assert {r["path"]: bytes(r["content"]) for r in other.extract(back).collect()} == content

    for _ in range(2):  # a second run finds what the first made
        repo.extract_to(one, str(tmp_path / "files"))
        at = lambda p: os.lstat(tmp_path / "files" / p)
        assert (at("d").st_mode, at("d").st_mtime, at("d/f").st_mode) == (0o040750, 1_700_000_000, 0o100640)
        assert at("d/f").st_ino == at("d/hard").st_ino == at("d/hard2").st_ino and (tmp_path / "files/d/f").read_bytes() == b"hello"
        assert os.readlink(tmp_path / "files/soft") == "d/f" and stat.S_ISFIFO(at("pipe").st_mode)
        assert (tmp_path / "files/out/x").read_bytes() == b"no link" and not os.path.islink(tmp_path / "files/out")
        assert not os.path.lexists(tmp_path / "files/dev") and not [f for f in os.listdir(tmp_path / "files/d") if f.endswith(".part")]
    repo.extract_to(one, str(tmp_path / "short"), strip=1)
    assert sorted(os.listdir(tmp_path / "short")) == ["f", "hard", "hard2", "x"]
