"""Operators against direct simulations, and the edge cases of their inputs."""

import random
import tempfile
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import analyze, catalog, diff, maintenance, patterns, retention
from palimpsest.streaming import files_state


def simulate(archives, policy, now=None, since=None):
    """The retention rules, step by step."""
    out, series = {}, defaultdict(list)
    for a in archives:
        if "@PROT" not in a["tags"]:
            series[a["name"]].append(a)
    key = {
        "secondly": lambda t: t.strftime("%Y%m%d%H%M%S"), "minutely": lambda t: t.strftime("%Y%m%d%H%M"), "hourly": lambda t: t.strftime("%Y%m%d%H"),
        "daily": lambda t: t.strftime("%Y%m%d"), "weekly": lambda t: t.strftime("%G-%V"), "monthly": lambda t: t.strftime("%Y%m"),
        "13weekly": lambda t: (t.isocalendar()[0], min((t.isocalendar()[1] - 1) // 13, 3)), "3monthly": lambda t: (t.year, (t.month - 1) // 3), "yearly": lambda t: t.year,
    }
    for name, rows in series.items():
        rows.sort(key=lambda a: (-a["time"].timestamp(), a["archive_id"]))
        kept = {}
        cand = rows
        if since:
            for a in rows:
                if a["time"] >= since:
                    kept[a["archive_id"]] = ("skip", len(kept), False)
            cand = [a for a in rows if a["time"] < since]
        given = [r for r in retention.RULES if r in policy]
        for rule in given:
            value, mine, before = policy[rule], 0, None
            if value == 0 or not cand:
                continue
            def ok(a):
                return a["time"] >= (since or now) - value if isinstance(value, timedelta) else value == -1 or mine < value  # noqa: B023
            for seq, a in enumerate(cand):
                if not ok(a):
                    break
                p = seq if rule == "keep" else key[rule](a["time"])
                if p == before:
                    continue
                before = p
                if a["archive_id"] not in kept:
                    kept[a["archive_id"]] = (rule, mine, False)
                    mine += 1
            last = cand[-1]
            if rule == given[-1] and last["archive_id"] not in kept and ok(last):
                kept[last["archive_id"]] = (rule, mine, True)
        for a in rows:
            out[a["archive_id"]] = kept.get(a["archive_id"])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_prune_is_the_simulation(spark, seed):
    rnd = random.Random(seed)
    start = datetime(2024, 12, 20)
    archives = [
        {"archive_id": f"{i:04d}", "name": rnd.choice("ab"), "time": start + timedelta(hours=rnd.randint(0, 24 * 60), minutes=rnd.choice([0, 0, 7])), "tags": rnd.choice([[], [], ["x"], ["@PROT"]])}
        for i in range(rnd.choice([1, 15, 80]))
    ]
    rules = rnd.sample([r for r in retention.RULES if r != "3monthly"], 3)
    policy = {r: rnd.choice([1, 2, 5, retention.ALL, timedelta(days=20), 0]) for r in rules}
    if not any(policy.values()):
        policy[rules[0]] = 2
    now = start + timedelta(days=61)
    since = rnd.choice([None, start + timedelta(days=50)])
    df = spark.createDataFrame(archives, "archive_id string, name string, time timestamp, tags array<string>")
    got = {r["archive_id"]: (r["keep_rule"], r["keep_index"], r["kept_oldest"]) if r["kept"] else None for r in retention.prune(df, policy, now=now, since=since).collect()}
    assert got == simulate(archives, policy, now, since)


def test_prune_policies_are_checked():
    for bad in ({}, {"daily": 0}, {"13weekly": 1, "3monthly": 1}, {"fortnightly": 1}):
        with pytest.raises(ValueError):
            retention.validate(bad)
    assert retention.parse_value("all") == retention.ALL
    assert retention.parse_value("2m") == timedelta(days=62)
    with pytest.raises(ValueError):
        retention.parse_value("2q")


SUBJECTS = ["home/user/a.txt", "home/user/sub/b.txt", "home/username/c", "etc/passwd", "a", "a/b", "src/[x].c", "srv/a(b)c", "srv/data.tar.gz", "café/ü.txt", "x\ny/z"]


def shell_match(pattern: str, path: str) -> bool:
    """Direct recursive matcher of shell patterns at the start of a path."""
    def go(p, s):
        if not p:
            return True
        if p.startswith("**/"):
            return go(p[3:], s) or ("/" in s and go(p, s[s.index("/") + 1 :]))
        if p[0] == "*":
            return any(go(p[1:], s[k:]) for k in range(len(s) + 1) if "/" not in s[:k])
        if not s:
            return False
        if p[0] == "?":
            return s[0] != "/" and go(p[1:], s[1:])
        return p[0] == s[0] and go(p[1:], s[1:])
    return go(pattern, path)


@pytest.mark.parametrize("pattern", ["home/*", "**/*.txt", "home/user/", "*/user", "a?b", "e??/p*", "home/**/b.txt", "café"])
def test_shell_patterns(spark, pattern):
    df = spark.createDataFrame([(s,) for s in SUBJECTS], "path string")
    got = {r["path"] for r in df.where(patterns.matches(F.col("path"), "sh", pattern)).collect()}
    body = pattern[:-1] + "/**/*/" if pattern.endswith("/") else pattern + "/**/*"
    assert got == {s for s in SUBJECTS if shell_match(body, s + "/")}


def test_other_styles_and_rules(spark):
    df = spark.createDataFrame([(s,) for s in SUBJECTS], "path string")
    hit = lambda style, p: {r["path"] for r in df.where(patterns.matches(F.col("path"), style, p)).collect()}
    assert hit("pp", "/home/user") == {"home/user/a.txt", "home/user/sub/b.txt"}
    assert hit("pf", "/etc//passwd") == {"etc/passwd"}
    assert hit("fm", "*.txt") == {"home/user/a.txt", "home/user/sub/b.txt", "café/ü.txt"}
    assert hit("fm", "src/[[]x].c") == {"src/[x].c"}
    assert hit("fm", "srv/a(b)c") == {"srv/a(b)c"}
    assert hit("sh", "srv/a\\(b\\)c") == {"srv/a(b)c"}
    assert hit("sh", "{etc,srv}/*") == {"etc/passwd", "srv/a(b)c", "srv/data.tar.gz"}
    assert hit("re", r"\.tar\.") == {"srv/data.tar.gz"}
    rules, roots = patterns.read_rules(["# c", "R /home", "P fm", "- *.txt", "+ pf:home/user/a.txt", "! sh:srv/*"])
    kept = {r["path"] for r in df.where(patterns.included(F.col("path"), rules)).collect()}
    assert roots == ["/home"] and "home/user/a.txt" in kept and "home/user/sub/b.txt" not in kept and "srv/a(b)c" not in kept and "a" in kept
    assert {r["path"] for r in df.where(patterns.included(F.col("path"), [], ["home/user"])).collect()} == {"home/user/a.txt", "home/user/sub/b.txt"}
    with pytest.raises(ValueError):
        patterns.matches(F.col("path"), "xx", "a")


ITEM = "path string, ordinal bigint, mode bigint, user string, mtime timestamp, chunks array<struct<id:string,size:bigint>>"


def test_diff_edges(spark):
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([("same", 1, 1, "u", t, [("x", 5)]), ("reordered", 2, 1, "u", t, [("x", 5), ("y", 6)]), ("gone", 3, 1, "u", t, [("z", 7)]), ("null", 4, None, None, None, None), ("repeat", 5, 1, "u", t, [("x", 5)])], ITEM)
    b = spark.createDataFrame([("same", 9, 1, "u", t, [("x", 5)]), ("reordered", 1, 1, "u", t, [("y", 6), ("x", 5)]), ("new", 2, 1, "u", t, []), ("null", 3, 7, "", t, [("q", 1)]), ("repeat", 4, 1, "v", t, [("x", 5), ("x", 5)])], ITEM)
    rows = {r["path"]: r for r in diff.compare(a, b).collect()}
    assert set(rows) == {"reordered", "gone", "new", "repeat"}
    assert (rows["reordered"]["modified"], rows["reordered"]["added"], rows["reordered"]["removed"]) == (True, 0, 0)
    assert (rows["repeat"]["modified"], rows["repeat"]["added"]) == (True, 0) and rows["repeat"]["owner"]["to"] == "v"
    assert rows["gone"]["removed"] == 7 and rows["new"]["added"] == 0
    assert [r["path"] for r in diff.reported(diff.compare(a, b)).collect()] == ["reordered", "repeat", "new", "gone"]
    assert "repeat" in {r["path"] for r in diff.compare(a, b, same_chunker=False).collect()}
    with pytest.raises(ValueError):
        diff.sorted_by(diff.compare(a, b), ["nonsense"])


def test_analysis_adds_up(spark):
    rnd = random.Random(3)
    refs = spark.createDataFrame([(f"a{i % 7}", f"n{i % 7 % 3}", datetime(2024, 1, 1 + i % 7), f"d{rnd.randint(0, 3)}", str(rnd.randint(0, 40)), 10) for i in range(200)], "archive_id string, name string, time timestamp, directory string, chunk_id string, size bigint")
    index = spark.createDataFrame([(str(i), i + 1) for i in range(50)], "chunk_id string, obj_size bigint")
    parts = analyze.by_name(refs, index).collect()
    assert sum(r["chunks"] for r in parts) == 50 and sum(r["stored_size"] for r in parts) == sum(range(1, 51))
    whole = analyze.of_set(refs, index, F.lit(True)).first()
    assert whole["whole_repository"] and whole["exclusive_stored"] is None and whole["missing_references"] == 0
    some = analyze.of_set(refs, index.where("chunk_id <> '5'"), F.col("name") == "n0").first()
    held, missing = defaultdict(set), 0
    for r in refs.collect():
        held[r["chunk_id"]].add(r["name"])
        missing += r["chunk_id"] == "5" and r["name"] == "n0"
    assert some["exclusive_stored"] == sum(int(c) + 1 for c, n in held.items() if n == {"n0"} and c != "5")
    assert some["missing_references"] == missing
    by = {r["name"]: r["stored_size"] for r in parts}
    assert by["n0"] == sum(int(c) + 1 for c, n in held.items() if n == {"n0"})
    sets = defaultdict(lambda: defaultdict(set))
    for r in refs.collect():
        sets[r["archive_id"]][r["directory"]].add(r["chunk_id"])
    churn = defaultdict(int)
    for i in range(6):
        for d in {f"d{k}" for k in range(4)}:
            churn[d] += 10 * len(sets[f"a{i}"][d] ^ sets[f"a{i + 1}"][d])
    assert {r["directory"]: r["size"] for r in analyze.hotspots(refs, None).collect()} == {d: n for d, n in churn.items() if n}
    assert analyze.hotspots(refs.where("archive_id = 'a0'")).count() == 0


def test_empty_tables(spark):
    refs = spark.createDataFrame([], "archive_id string, name string, time timestamp, directory string, path string, chunk_id string, size bigint")
    index = spark.createDataFrame([], "chunk_id string, pack_id string, obj_offset bigint, obj_size bigint")
    packs = spark.createDataFrame([("p", 10)], "pack_id string, size bigint")
    assert analyze.by_name(refs, index).count() == 0
    assert analyze.hotspots(refs).count() == 0
    assert analyze.of_set(refs, index, F.lit(True)).first()["total_chunks"] == 0
    assert maintenance.compact_plan(index, packs, maintenance.live_chunks(refs)).first()["action"] == "keep"
    assert maintenance.missing_report(refs, index).count() == 0


def test_compact_decisions(spark):
    index = spark.createDataFrame([("a", "full", 0, 100), ("b", "dead", 0, 100), ("c", "tail", 0, 90), ("d", "ten", 0, 10), ("e", "ten", 10, 90), ("f", "nine", 0, 9), ("g", "nine", 9, 91), ("h", "unknown", 0, 5)], "chunk_id string, pack_id string, obj_offset bigint, obj_size bigint")
    packs = spark.createDataFrame([(p, 100) for p in ("full", "dead", "tail", "ten", "nine")], "pack_id string, size bigint")
    live = spark.createDataFrame([(c,) for c in "aeg"], "chunk_id string")
    plan = {r["pack_id"]: r["action"] for r in maintenance.compact_plan(index, packs, live).collect()}
    assert plan == {"full": "keep", "dead": "drop", "tail": "rewrite", "ten": "rewrite", "nine": "keep"}


def test_files_state(spark):
    schema = "path_key string, age int, size bigint, inode decimal(20,0), ctime_ns bigint, mtime_ns bigint"
    s = 10**9
    old = spark.createDataFrame([("same", 0, 5, None, 1 * s, 1 * s), ("size", 0, 5, None, 1 * s, 1 * s), ("unseen", 0, 5, None, 1 * s, 1 * s), ("stale", 1, 5, None, 1 * s, 1 * s)], schema)
    now = spark.createDataFrame([("same", 0, 5, None, 1 * s, 1 * s), ("size", 0, 6, None, 1 * s, 1 * s), ("new", 0, 1, None, 2 * s, 2 * s), ("late", 0, 1, None, 9 * s, 9 * s)], schema)
    got = {r["path_key"]: r["status"] for r in files_state.status(now, old, files_state.parse_mode("ctime,size")).collect()}
    assert got == {"same": "U", "size": "M", "new": "A", "late": "A"}
    kept = {r["path_key"]: r["age"] for r in files_state.next_state(now, old, start_ns=11 * s).collect()}
    assert kept == {"same": 0, "size": 0, "new": 0, "unseen": 1}
    assert files_state.parse_mode("disabled") is None
    with pytest.raises(ValueError):
        files_state.parse_mode("ctime,mtime")


def test_listing_errors_and_order(spark):
    a = spark.createDataFrame([(f"{i}", "n", datetime(2024, 1, 1), "h", "u", None) for i in range(5)], "archive_id string, name string, time timestamp, host string, user string, tags array<string>")
    top = catalog.list_archives(a, catalog.ListOptions(first=3, last=2)).collect()
    assert [r["archive_id"] for r in sorted(top, key=lambda r: r["place"])] == ["1", "2"]
    assert catalog.select_archives(a, catalog.ListOptions(match=("tags:x",))).count() == 0
    with pytest.raises(ValueError):
        catalog.list_archives(a, catalog.ListOptions(sort=("size",)))
    with pytest.raises(ValueError):
        catalog.find(a, a, [])
    assert catalog.one_archive(a, "n").first()["archive_id"] == "4"
    assert catalog.one_archive(a, "absent").count() == 0


def test_attributes(spark):
    rows = spark.createDataFrame([(1, {"user.xdg.robots.backup": b"false"}, 0), (2, {}, 1), (3, None, None), (4, {"a": b"b"}, 2)], "id int, xattrs map<string,binary>, flags bigint")
    assert {r["id"] for r in rows.where(patterns.excluded_by_attribute(F.col("xattrs"), F.col("flags"))).collect()} == {1, 2}
    objects = spark.createDataFrame([("x", b"\x0a\xbc\xde"), ("y", b"\xab\xcd")], "chunk_id string, data binary")
    assert [tuple(r)[:2] for r in catalog.search_bytes(objects, b"\xbc").collect()] == [("x", 1)]


def test_search_hits_and_across(spark):
    rnd = random.Random(5)
    data = [bytes(rnd.choice(b"ab") for _ in range(rnd.choice([0, 1, 2, 5, 30]))) for _ in range(60)]
    objects = spark.createDataFrame([(i, f"c{i:02d}", bytearray(x) if x or i % 2 else None) for i, x in enumerate(data)], "n int, chunk_id string, data binary")
    for needle in (b"a", b"ab", b"aba", b"babba"):
        got = {r["chunk_id"]: (r["offset"], r["hits"]) for r in catalog.search_bytes(objects, needle).collect()}
        assert got == {f"c{i:02d}": (x.find(needle), x.count(needle)) for i, x in enumerate(data) if needle in x}
        reach, want = len(needle) - 1, {}
        for i, (a, b) in enumerate(zip(data, data[1:])):
            at = (a[max(len(a) - reach, 0):] + b[:reach]).find(needle)
            if reach and at >= 0:
                at += max(len(a) - reach, 0)
                want[f"c{i:02d}"] = (f"c{i + 1:02d}", at, (a + b[: reach + 3])[max(at - 3, 0) : at + len(needle) + 3].hex().upper())
        for parts in (1, 7):
            folder = f"{tempfile.mkdtemp()}/x"
            found = catalog.search_across(objects, needle, ("n",), folder, context=3, parts=parts).collect()
            assert {r["chunk_id"]: tuple(r)[1:] for r in found} == want
    assert catalog.search_across(objects.where("n < 0"), b"ab", ("n",), f"{tempfile.mkdtemp()}/x").count() == 0
    with pytest.raises(ValueError):
        catalog.search_bytes(objects, b"")


def test_diff_sort_keys(spark):
    schema = "path string, ordinal bigint, mode bigint, user string, `group` string, uid bigint, gid bigint, target string, ctime_ns bigint, mtime timestamp, chunks array<struct<id:string,size:bigint>>"
    rnd = random.Random(2)

    def items(seed):
        rnd.seed(seed)
        kinds = [(0o100644, None), (0o120777, "there"), (0o040755, None)]
        out = []
        for i in range(12):
            mode, target = kinds[i % 3]
            chunks = [(str(rnd.randint(0, 9)), rnd.randint(1, 50)) for _ in range(rnd.randint(0, 3))] if mode == 0o100644 else None
            out.append((f"p{i}", rnd.randint(0, 99), mode, rnd.choice([None, "", "u", "v"]), rnd.choice([None, "g"]), rnd.choice([None, 0, 5]), rnd.choice([None, 1]), target, rnd.choice([None, 0, 7 * 10**9]), datetime(2024, 1, rnd.randint(1, 28)), chunks))
        return out

    x, y = items(1)[:9], items(2)[3:]
    changes = diff.compare(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), sort_values=True)
    rows = [r.asDict() for r in diff.reported(changes).collect()]
    at = schema.replace("`", "").split("chunks")[0].split(",")
    names = [c.split()[0] for c in at if c.strip()] + ["chunks"]
    one, two = ({r[0]: dict(zip(names, r, strict=True)) for r in s} for s in (x, y))

    def ns(item, name):
        if item is None:
            return 0
        return (item["ctime_ns"] or 0) if name == "ctime" else int(item["mtime"].replace(tzinfo=timezone.utc).timestamp()) * 10**9

    def value(key, r):
        a, b = one.get(r["path"]), two.get(r["path"])
        if key in ("size_added", "size_removed"):
            return r[key[5:]]
        size = lambda i: {0o100644: sum(c[1] for c in i["chunks"] or ()), 0o120777: 5}.get(i["mode"], 0)
        return {
            "path": r["path"], "size_diff": r["added"] - r["removed"], "size": size(b) if b else 0,
            "user": (b or {}).get("user") or "", "group": (b or {}).get("group") or "",
            "uid": -1 if not b or b["uid"] is None else b["uid"], "gid": -1 if not b or b["gid"] is None else b["gid"],
            "ctime": ns(b, "ctime"), "mtime": ns(b, "mtime"), "ctime_diff": ns(b, "ctime") - ns(a, "ctime"), "mtime_diff": ns(b, "mtime") - ns(a, "mtime"),
        }[key]

    for key in diff.SORT_KEYS:
        got = [r["path"] for r in diff.sorted_by(changes, [key]).collect()]
        assert got == [r["path"] for r in sorted(rows, key=lambda r: value(key, r))], key
    down = [r["path"] for r in diff.placed(changes, f"{tempfile.mkdtemp()}/x", 3, (">mtime_diff",)).orderBy("place").collect()]
    assert down == [r["path"] for r in sorted(rows, key=lambda r: -value("mtime_diff", r))]


def test_diff_places_of_ties(spark):
    paths = [f"p{i:03}" for i in range(200)]
    rows = [(p, "added", 5, 0, 1, i % 3, 0, ("u",)) for i, p in enumerate(paths)]
    schema = "path string, kind string, added bigint, removed bigint, order1 int, order2 bigint, order3 int, sort_values struct<user string>"
    want = sorted(paths, key=lambda p: (int(p[1:]) % 3, p))
    for turn in (rows, rows[::-1]):
        changes = spark.createDataFrame(turn, schema)
        assert [r["path"] for r in diff.reported(changes).collect()] == want
        assert [r["path"] for r in diff.sorted_by(changes, [">user"]).collect()] == want
        placed = diff.placed(changes, f"{tempfile.mkdtemp()}/x", 3, (">user",)).collect()
        assert [r["path"] for r in sorted(placed, key=lambda r: r["place"])] == want
