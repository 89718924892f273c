"""Scalar functions, locations and statistics on hand-written cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import stats
from palimpsest.sources.location import Location, redact


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_paths(spark):
    c = F.lit
    assert one(spark, scalars.dirname(c("a")), scalars.dirname(c("/a")), scalars.dirname(c("a/b/c"))) == (".", "/", "a/b")
    assert one(spark, scalars.strip_components(c("/a//b/c"), 1), scalars.strip_components(c("a"), 1)) == ("b/c", None)
    assert one(spark, scalars.safe_path(c("/a/./b//c")), scalars.safe_path(c("/"))) == ("a/b/c", ".")
    assert one(spark, scalars.archived_path(c("/home/x/./y/z")), scalars.archived_path(c("../../a"))) == ("y/z", "a")
    for bad in ("a/../b", "..", "a\\..\\b"):
        with pytest.raises(Exception, match="unsafe"):
            one(spark, scalars.safe_path(c(bad)))


def test_modes(spark):
    modes = [(0o100644, "-rw-r--r--"), (0o104755, "-rwsr-xr-x"), (0o106644, "-rwSr-Sr--".replace("w", "w")), (0o041777, "drwxrwxrwt"), (0o120777, "lrwxrwxrwx"), (0o644, "?rw-r--r--"), (0o010600, "prw-------")]
    assert one(spark, *[scalars.mode_string(F.lit(m).cast("bigint")) for m, _ in modes]) == tuple(s for _, s in modes)


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 999_994, 999_995, 999_996, 10**9, 123_456_789_012, -1500])
def test_human_bytes(spark, n):
    def plain(v, power, names):
        for i, name in enumerate(names):
            if abs(round(abs(v) + 1e-12, 2)) < power:
                return f"{v:.{2 if i else 0}f} {name}B"
            v /= power

    got = one(spark, scalars.human_bytes(F.lit(n).cast("bigint")), scalars.human_bytes(F.lit(n).cast("bigint"), "raw"))
    assert got == (plain(float(n), 1000, ["", "k", "M", "G"]), f"{n} B")


def test_human_bytes_up_to_a_unit(spark):
    n = F.lit(10**12).cast("bigint")
    got = one(spark, scalars.human_bytes(n), scalars.human_bytes(n, largest="G"), scalars.human_bytes(n, "iec", largest="Ki"), scalars.human_bytes(n, largest=""))
    assert got == ("1.00 TB", "1000.00 GB", "976562500.00 KiB", f"{10**12} B")


def test_times(spark):
    t = F.lit(datetime(2024, 1, 31, 23, 59, 58))
    got = one(spark, scalars.offset(t, "1m"), scalars.offset(t, "1y", back=True), scalars.offset(t, "2d"), scalars.strftime(t, "%F %T %j %U %W %% %e"), scalars.iso_week(F.lit(datetime(2027, 1, 1))))
    when = datetime(2024, 1, 31, 23, 59, 58)
    assert got == (when.replace(month=2, day=29), when.replace(year=2023), when + timedelta(days=2), when.strftime("%F %T %j %U %W %% %e"), "2026-53")
    for bad in ("%x", "%Q"):
        with pytest.raises(ValueError):
            scalars.strftime(t, bad)
    with pytest.raises(ValueError):
        scalars.offset(t, "3q")
    texts = ["2024-01-02", "2024-01-02T03:04", "2024-01-02 03:04:05", "2024-01-02T03:04:05+00:00", "nonsense"]
    assert one(spark, *[scalars.parse_timestamp(F.lit(x)) for x in texts]) == (datetime(2024, 1, 2), datetime(2024, 1, 2, 3, 4), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), None)


def test_ids_and_sizes(spark):
    import hashlib
    import hmac

    data = F.lit(b"abc")
    assert one(spark, scalars.keyed_id(data, b"k"), scalars.keyed_id(data, b"k", "blake2b-256")) == (hmac.new(b"k", b"abc", hashlib.sha256).hexdigest(), hashlib.blake2b(b"abc", key=b"k", digest_size=32).hexdigest())
    assert one(spark, *[scalars.parse_size(F.lit(x)) for x in ("12", "1.5K", "2M", "x", "")]) == (12, 1500, 2_000_000, None, None)
    assert one(spark, scalars.approximate_text(F.lit(b"a\xffb"))) == ("a\ufffdb",)
    assert one(spark, scalars.valid_tag(F.lit("@PROT")), scalars.valid_tag(F.lit("a b")), scalars.valid_name(F.lit(" a")), scalars.valid_name(F.lit("a-1"))) == (True, False, False, True)


def test_locations():
    at = Location.parse("sftp://me:pw@host:22/a/b")
    assert at == Location("sftp", "me", "host", 22, "/a/b") and at.hadoop() == "sftp://me@host:22/a/b"
    assert Location.parse("/tmp/x") == Location("file", None, None, None, "/tmp/x")
    assert Location.parse("s3://bucket/k").hadoop() == "s3a://bucket/k"
    assert redact("https://u:secret@h/p") == "https://u:***@h/p" and redact("/a") == "/a"
    for bad in ("", "foo://x"):
        with pytest.raises(ValueError):
            Location.parse(bad)


def test_observed(spark):
    rows, watch = stats.observed(spark.range(5), "n", "id")
    rows.collect()
    assert watch.get == {"calls": 5, "volume": 10} and stats.hit_ratio(0, 0) == 0 and stats.hit_ratio(3, 1) == 0.75
