import json
import os
import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import derive
from touchline import schemas
from touchline.functions.text import normalized, strip_long, strip_space
from touchline.operators.carry import carry_forward
from touchline.operators.table_pages import collapse_repeats
from touchline.session import shared_dir, staged
from touchline.sources import config, log_records, logs, pages
from tests import brute


def test_config_files(spark, tmp_path):
    leagues_file = tmp_path / "leagues.json"
    leagues_file.write_text(json.dumps([
        {"code": "ENG1", "bbcName": "premier-league", "thefishyId": 1, "isActive": True},
        {"code": "ENG2", "bbcName": None},
        {"code": "ENG3"}, {"code": "ENG4"},
    ]))
    teams = tmp_path / "teams"
    teams.mkdir()
    (teams / "ENG1.json").write_text(json.dumps([
        {"name": "Wolves", "altNames": ["Wolverhampton Wanderers"]},
        {"name": "Nott'm Forest", "altNames": None}, {"name": "Leeds"},
    ]))
    (teams / "ENG2.json").write_text("{ not json")
    (teams / "ENG4.json").write_text("[]")
    (teams / "OTHER.json").write_text('[{"name": "X"}]')
    leagues = config.read_leagues(spark, str(leagues_file))
    assert leagues.columns == schemas.LEAGUES.names
    assert [(r.code, r.league_idx) for r in leagues.collect()] == [
        ("ENG1", 0), ("ENG2", 1), ("ENG3", 2), ("ENG4", 3)
    ]
    aliases = config.read_entities(spark, str(teams), leagues)
    assert aliases.columns == schemas.ENTITY_ALIASES.names
    assert sorted(map(tuple, aliases.collect())) == [
        ("ENG1", 0, 0, "Wolves", "Wolves", "wolves"),
        ("ENG1", 0, 1, "Wolves", "Wolverhampton Wanderers", "wolverhampton wanderers"),
        ("ENG1", 1, 0, "Nott'm Forest", "Nott'm Forest", "nottm forest"),
        ("ENG1", 2, 0, "Leeds", "Leeds", "leeds"),
    ]
    assert {r.league: r.reason for r in
            config.missing_dictionaries(spark, str(teams), leagues).collect()} == {
        "ENG2": "not decodable", "ENG3": "file missing",
    }
    assert config.read_leagues(spark, str(tmp_path / "none.json")).count() == 0
    assert config.read_entities(spark, str(tmp_path / "none"), leagues).count() == 0


def test_crawl_table(spark):
    leagues = spark.createDataFrame(
        [("ENG1", "premier-league", 1, 0), ("ENG2", None, 2, 1)],
        "code string, bbcName string, thefishyId int, league_idx int",
    )
    got = pages.crawl_table(leagues, pages.SOURCES, "2025-03-09", cycles=2)
    assert sorted((r.source, r.league, r.cycle, r.due_ms, r.url) for r in got.collect()) == [
        ("bbc", "ENG1", c, 3000 + 60000 * c,
         "https://www.bbc.co.uk/sport/football/premier-league/scores-fixtures/2025-03?filter=results")
        for c in (0, 1)
    ] + [
        ("fishy", f"ENG{i}", c, 3000 + 10000 * (i - 1) + 60000 * c,
         f"https://thefishy.co.uk/football-results.php?table={i}")
        for i in (1, 2) for c in (0, 1)
    ]
    plain = pages.crawl_table(leagues, [pages.Source("x", "thefishyId", "u")], "2025-03-09")
    assert {(r.due_ms, r.interval_ms) for r in plain.collect()} == {(1000, 60000)}


def test_url_parts(spark):
    cases = {
        "https://a.b/c/d?e=f#g": ("https", "a.b", 443, "/c/d", "e=f", "g", None),
        "http://a.b:81": ("http", "a.b", 81, "/", "", "", None),
        "http://a.b/?q=x?y": ("http", "a.b", 80, "/", "q=x?y", "", None),
        "a.b/c": (None,) * 6 + ("no scheme",),
        "ftp://a.b/c": (None,) * 6 + ("unknown scheme",),
        "ftp://a.b:21/c": ("ftp", "a.b", 21, "/c", "", "", None),
        "http://a.b:x/c": (None,) * 6 + ("bad port",),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r[0]: tuple(r)[1:] for r in pages.url_parts(df, "url").collect()}
    assert got == cases


def test_landing_table(spark, tmp_path):
    row = (1, "bbc", "ENG1", "u", 200, "x", datetime(2025, 1, 2))
    frame = spark.createDataFrame([row], schemas.RAW_PAGES)
    pages.write_pages(frame, str(tmp_path / "p"))
    assert [tuple(r) for r in pages.read_pages(spark, str(tmp_path / "p")).collect()] == [row]


def test_landing_folders_do_not_follow_the_leagues(spark, tmp_path):
    leagues = [*(f"L{i}" for i in range(100)), "", None]
    rows = [
        (i, source, league, "u", 200, "x", datetime(2025, 1, 2))
        for i, league in enumerate(leagues) for source in ("bbc", "fishy")
    ]
    path = str(tmp_path / "p")
    pages.write_pages(spark.createDataFrame(rows, schemas.RAW_PAGES), path)
    read = pages.read_pages(spark, path)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(rows, key=str)
    assert {r.page_id for r in read.filter("league = 'L7'").collect()} == {7}
    assert sum(not folders for _, folders, _ in os.walk(path)) <= 2 * pages.PARTS


def test_log_lines(spark, tmp_path):
    lines = [
        "2025-11-20T10:00:00.1+00:00 [info] scheduler: task for <0.12.0> via bbc_pool",
        "2025-11-20 10:00:00 [ERROR] crash [info] x",
        "  continued",
        "2025 short",
    ]
    path = tmp_path / "app.log"
    path.write_text("\n".join(lines))
    got = {r.value: r for r in logs.parse_log_lines(logs.read_log(spark, str(path))).collect()}
    first = got[lines[0]]
    assert (first.time, first.level, first.pids, first.modules) == (
        "2025-11-20T10:00:00.1+00:00", "info", ["<0.12.0>"], ["bbc_pool", "scheduler"])
    assert first.message == "scheduler: task for <0.12.0> via bbc_pool"
    assert (got[lines[1]].time, got[lines[1]].level) == ("2025-11-20 10:00:00", "info")
    assert got[lines[2]].is_continuation and got[lines[2]].message == lines[2]
    assert got[lines[3]].is_continuation and got[lines[3]].time is None


def test_carry_forward_any_block(spark):
    rng = random.Random(5)
    rows = []
    for group in ("hot", "cold"):
        for i in range(400 if group == "hot" else 20):
            rows.append((group, i, rng.random() < 0.2, rng.choice([None, "a", "b", "c"])))
    expected = []
    for group in ("hot", "cold"):
        held = None
        for g, i, head, value in rows:
            if g == group:
                held = value if head else held
                expected.append((g, i, held))
    df = spark.createDataFrame(rows, "g string, i int, head boolean, v string")
    for block in (F.lit(0), F.col("i"), F.expr("i div 7")):
        got = carry_forward(df, ["g"], ["i"], F.col("head"), F.col("v"), block)
        assert sorted((r.g, r.i, r.carried or "") for r in got.collect()) == sorted(
            (g, i, v or "") for g, i, v in expected
        )


def test_collapse_repeats(spark):
    df = spark.createDataFrame(
        [(1, "a", "2025-01-02"), (1, "a", "2025-01-01"), (2, "a", "2025-01-03")],
        "page int, name string, date string",
    )
    assert sorted(map(tuple, collapse_repeats(df, ["page", "name"]).collect())) == [
        (1, "a", "2025-01-01"), (2, "a", "2025-01-03")
    ]


def test_normalized_equals_python(spark):
    texts = [
        "Real  Madrid 2025 Re-al REAL ²3 O'Neil-F.C. ١٢", "", " x y\u0085z\x1cw", "ÉCOLE (B)",
        "A;B/C:D,E.", "x٣y ٣ ⑤ Ⅷ", "ΟΔΟΣ Σ",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", normalized(F.col("t"))).collect()}
    assert got == {t: brute.norm(t) for t in texts}


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark, "x")
    assert base is None or path.startswith(base)


def test_carry_forward_keeps_null_groups_and_blocks(spark):
    rows = [(None, 1, True, 5), (None, 2, False, 0), ("a", 1, True, 7), ("a", 2, False, 0)]
    df = spark.createDataFrame(rows, "g string, i int, head boolean, v int")
    for block in (F.lit(None).cast("int"), F.col("i")):
        got = carry_forward(df, ["g"], ["i"], F.col("head"), F.col("v"), block)
        assert sorted((str(r.g), r.i, r.carried) for r in got.collect()) == [
            ("None", 1, 5), ("None", 2, 5), ("a", 1, 7), ("a", 2, 7)
        ]


def test_crawl_needs_a_cycle(spark):
    leagues = spark.createDataFrame([("A", "a", 1, 0)], "code string, bbcName string, thefishyId int, league_idx int")
    with pytest.raises(ValueError, match="cycles"):
        pages.crawl_table(leagues, pages.SOURCES, "2025-01-01", cycles=0)


def whole_records(lines):
    """(message, lines, flag) of each record, read line by line."""
    out = []
    for line in lines:
        words = line.split(" ", 2)
        if line.startswith("20") and len(words) == 3:
            start = re.match(r"(?s)^20[^ ]*(?: \d[^ ]*)? ", line).end()
            out.append([re.sub(r"^\[\w+\] ", "", line[start:]), 1, False])
        elif out and not out[-1][2]:
            out[-1][0] += "\n" + line
            out[-1][1] += 1
        else:
            out.append([line, 1, True])
    return sorted(map(tuple, out))


def log_text(rng, count):
    lines = ["orphan", "  at the start"]
    for i in range(count):
        lines.append(f"2025-11-20T10:00:{i % 60:02d} [{rng.choice(['info', 'Error', 'x'])}] message {i} é <0.{i}.0>")
        lines += [rng.choice(["    at line", "2025 short", "", "[error] not a head"])] * rng.choice([0, 0, 1, 2, 30])
    return lines


def test_log_records_over_splits_and_files(spark, tmp_path):
    rng = random.Random(8)
    logs_ = {name: log_text(rng, 150) for name in ("a", "b")}
    logs_["c"] = ["never", "a head"]
    for name, lines in logs_.items():
        (tmp_path / name).mkdir()
        cuts = sorted(rng.sample(range(1, len(lines)), min(5, len(lines) - 1)))
        for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True)):
            (tmp_path / name / f"app-{k:03d}.log").write_text("\n".join(lines[i:j]) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "300b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            lines = log_records.read_lines(spark, f"{tmp_path}/*")
            if size == "300b":
                assert lines.select("file", "block").distinct().count() > 60
            rows = log_records.log_records(lines).collect()
            for name, text in logs_.items():
                own = [(r.message, r.lines, r.is_continuation) for r in rows if r.log.endswith(f"/{name}")]
                assert sorted(own) == whole_records(text)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    first = next(r for r in rows if r.message.startswith("message 0 "))
    assert first.pids == ["<0.0.0>"] and first.time.startswith("2025-11-20T10:00:00")
    assert log_records.log_records(lines.limit(0)).collect() == []


def test_log_records_across_batches(spark, tmp_path):
    rng = random.Random(9)
    text = log_text(rng, 60) + ["2025-11-21 10:00:00 last one", "goes on"]
    (tmp_path / "log").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    cuts = [0, 1, 40, 41, 60, 61, 62, 90, len(text)]
    done = 0
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        path = tmp_path / "log" / f"app-{rng.randrange(10**6)}.log"
        path.write_text("\n".join(text[i:j]) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        if k % 3 == 2 or j == len(text):
            lines = log_records.stream_lines(spark, str(tmp_path / "log"), max_files=1)
            log_records.follow_records(lines, out, state).awaitTermination()
            rows = log_records.read_records(spark, out).collect()
            assert sorted((r.message, r.lines, r.is_continuation) for r in rows) == whole_records(text[:j])
            stored = spark.read.parquet(f"{out}/records").count()
            assert done <= stored == len(rows) - 1
            done = stored
    assert log_records.read_records(spark, str(tmp_path / "nothing")).collect() == []


def test_records_of_one_log_are_joined_in_many_tasks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "app.log").write_text("".join(f"2025-11-21 10:00:00 message {k}\ngoes on\n" for k in range(400)))
    out = str(tmp_path / "out")
    # Small tables are dealt out as large ones are.
    large = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in large}
    try:
        for key, value in large.items():
            spark.conf.set(key, value)
        lines = log_records.stream_lines(spark, str(tmp_path / "log"))
        log_records.follow_records(lines, out, str(tmp_path / "state")).awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    stored = spark.read.parquet(f"{out}/records").selectExpr("lines", "_metadata.file_path as file").collect()
    assert [r.lines for r in stored] == [2] * 399
    assert len({r.file for r in stored}) > 4


def test_derived_rows_are_built_once_and_without_broadcasts(spark, tmp_path):
    part = [(k, f"red ring {k}", "Brand#1", "SMALL", k) for k in range(60)]
    line = [(k, k % 60, k % 7, k % 4, 3.0) for k in range(200)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet"
    )
    spark.createDataFrame(
        line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    ).selectExpr("*", "timestamp_ntz'2025-01-02 00:00:00' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    texts = derive.entity_texts(spark, str(tmp_path))
    assert "Broadcast" not in texts._jdf.queryExecution().sparkPlan().toString()
    rows = derive.fixtures(spark, str(tmp_path))
    assert "Join" not in rows._jdf.queryExecution().sparkPlan().toString()
    assert (texts.count(), rows.count()) == (200, sum(1 for k in range(200) if k % 60 < 50 or (k % 7 + k % 4) % 50 < 10))


def test_shuffle_files_go_when_a_table_is_staged(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle")}

    before = shuffles()
    staged(spark.range(100_000).selectExpr("id % 1000 as k").groupBy("k").count(), "sums")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_long_texts_are_stripped_like_short_ones(spark):
    texts = [None, "", " ", "a", " \u00a0a b\n\u3000", "\x1c\x85", "\n x; \u2028", "x" * 5000 + " \t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", strip_long(F.col("t")).alias("long"), strip_space(F.col("t")).alias("short")).collect():
        assert r.long == r.short == (None if r.t is None else r.t.strip())
