"""Column functions on literal values."""

from datetime import datetime as T

from pyspark.sql import functions as F

from tidekeep.functions import durations, outcomes, progress, schedules, text
from tidekeep.operators.schedules import schedule_due


def test_final_outcome(values):
    cases = [
        ("failed", 0, 0, "logical backup upload failed: s3 unavailable", None, None,
         "logical backup upload failed: s3 unavailable"),
        ("failed", 0, 0, "", "", "s3 unavailable", "logical upload failed: s3 unavailable"),
        ("success", 0, 0, None, "permission denied", None, "backup completed with cleanup issue: permission denied"),
        ("partial", 0, 0, " ", "permission denied", None, "cleanup issue: permission denied"),
        ("partial", 4, 1, None, None, None, "1 of 4 database backups failed"),
        ("partial", 4, 0, None, None, None, "backup completed partially"),
        ("failed", 0, 0, None, None, None, "backup failed before any database finished"),
        ("failed", 2, 0, None, None, None, "backup failed"),
        ("success", 2, 0, None, None, None, ""),
    ]
    got = values([c[:-1] for c in cases], "s string, t int, f int, r string, c string, u string",
                 outcomes.final_outcome("s", "t", "f", "r", "c", "u"))
    assert got == [c[-1] for c in cases]


def test_failure_categories_first_match_counts(values):
    cases = [
        ("Access denied; permission denied", "auth"), ("permission denied: disk full", "permission"),
        ("No space left on device", "disk"), ("error 1356", "view"), ("Can't connect to MySQL", "connect"),
        ("context deadline exceeded", "timeout"), ("ERROR 3024", "timeout"), ("unknown variable x", "config"),
        ("exec: executable file not found", "binary"), ("1449", "definer"), ("/data/1146/x", "schema"),
        ("Got a packet bigger than", "config"), ("exit status 2", "command"), (None, ""),
    ]
    got = values([c[0] for c in cases], "e string", outcomes.classify_failure(F.lit(""), "e"))
    assert got == [c[1] for c in cases]
    assert values([("x", True), ("access denied", True)], "e string, t boolean",
                  outcomes.classify_failure(F.lit(""), "e", "t")) == ["timeout", "timeout"]
    assert values(["x"], "e string", outcomes.classify_failure(F.lit("disk full"), "e")) == ["disk"]
    assert values(["auth", "connect", "timeout", "definer"], "c string", outcomes.is_retryable("c")) == [
        False, True, True, False]


def test_rate_limited(values):
    assert values(["xbcloud: S3 error message: Please reduce your request rate.", "upload failed: Slow Down",
                   "throttling detected", "permission denied", None], "m string",
                  outcomes.is_rate_limited("m")) == [True, True, True, False, False]


def test_retry_delay_doubles_up_to_the_cap(values):
    assert values([1, 2, 3, 4, 5, 60], "a int", outcomes.retry_delay("a")) == [2, 4, 8, 16, 20, 20]


def test_bands_and_labels(values):
    assert values([1.5, 1.0, 0.75, 0.1, 0.2, 0.35, 0.5], "l double", outcomes.load_band("l")) == [
        "very-high-load reduction", "high-load reduction", "moderate-load reduction", "very-low-load boost",
        "low-load boost", "light-load boost", "balanced"]
    assert values([("run_age", 28799.0), ("run_age", 28800.0), ("run_age", 43201.0), ("success_age", 43200.0),
                   ("duration", 900.0), ("size", 11.0 * 2 ** 30), ("other", 1.0)], "m string, v double",
                  outcomes.threshold_band("m", "v")) == ["green", "yellow", "red", "green", "yellow", "red", None]
    assert values([("backup_logical_validation_last_status", -1), ("backup_run_in_progress", 1)],
                  "m string, v int", outcomes.status_label("m", "v")) == ["Not Validated", "Running"]
    assert values([("root", ""), ("x", None), ("x", "tui"), ("x", "api"), ("x", "cron")], "u string, s string",
                  outcomes.scheduler_context("u", "s")) == [
        "root scheduled runner (blocked)", "user-level scheduled runner", "interactive TUI/manual invocation",
        "API-triggered invocation", "cron invocation"]


def test_durations(values):
    parsed = {"1m2.5s": 62.5, "-1.5h": -5400, "0": 0, "1h1h": 7200, "300us": 0.0003, ".5s": 0.5, "5.s": 5,
              "": 0, "x": 0, "1.5": 0, "1h 2m": 0, " 2s ": 2}
    assert values(list(parsed), "s string", durations.parse_duration("s")) == list(parsed.values())
    assert values(["x", "1s"], "s string", durations.duration_seconds("s")) == [None, 1.0]
    written = {230.0: "3m50s", 0.25: "250ms", 0.0: "0s", 3600.0: "1h0m0s", 62.5: "1m2.5s", 0.0004: "0s",
               59.9996: "1m0s", -1.5: "-1.5s"}
    assert values(list(written), "s double", durations.format_duration("s")) == list(written.values())


def test_run_ids(values):
    assert values(["2026-01-02_03-04-05", "2026-13-02_03-04-05", "old", "x2026-01-02_03-04-05"], "s string",
                  durations.parse_run_id("s")) == [T(2026, 1, 2, 3, 4, 5), None, None, None]


def test_staging_name(values):
    names = values(["My DB!", "", "a" * 80, "__", "a" * 80], "s string", text.staging_name("s"))
    assert names[0].startswith("test_restore_my_db_") and names[2] == names[4]
    assert names[1] == "test_restore_db_811c9dc5" and names[3].startswith("test_restore_db_")
    assert all(len(n) <= 64 for n in names)


def fnv(raw):
    h = 2166136261
    for b in raw.encode():
        h = ((h ^ b) * 16777619) % 2 ** 32
    return f"{h:08x}"


def test_fnv(values):
    raw = ["", "a", "foobar", "é ü", "x" * 300]
    assert values(raw, "s string", text.fnv1a_hex("s")) == [fnv(r) for r in raw]


def test_sizes_and_ages(values):
    sizes = {0: "0 B", 9: "9 B", 10: "10 B", 999: "999 B", 1000: "1.0 kB", 1550: "1.6 kB", 12345: "12 kB",
             999950: "1000 kB", 10 ** 9: "1.0 GB", 5 * 10 ** 18: "5.0 EB"}
    assert values(list(sizes), "n bigint", text.human_bytes("n")) == list(sizes.values())
    ages = {0: "0s ago", 59: "59s ago", 60: "1m ago", 3599: "59m ago", 5400: "1.5h ago", 360000: "100.0h ago"}
    assert values(list(ages), "n bigint", text.age_text("n")) == list(ages.values())


def test_labels_and_keys(values):
    assert values([(None, "", " ", ""), ("j", 'a"b', " x ", " eu ")], "a string, b string, c string, d string",
                  text.label_string("a", "b", "c", "d", ("fleet", "mysql", "pilot"))) == [
        'job="fleet",service="mysql",env="pilot"', 'job="j",service="a\\"b",env="x",region="eu"']
    assert values([("/p/", "r 1", "a+b*c/d~e$&:=@!.sql"), (" ", "r", "x")], "p string, r string, s string",
                  text.object_key("p", "r", "s")) == ["p/r%201/a+b%2Ac/d~e$&:=@%21.sql", "r/x"]


def test_scope_and_lists(values):
    scopes = values(["db1:users,orders;db2:events", "a:x; a:y,,z ;b; :q;c:"], "s string",
                    schedules.parse_table_scope("s"))
    assert scopes == [{"db1": ["users", "orders"], "db2": ["events"]}, {"a": ["y", "z"], "c": []}]
    assert values(["b:z,y;a:x;a:w"], "s string", schedules.format_table_scope(schedules.parse_table_scope("s"))) == [
        "a:w;b:y,z"]
    assert values([" a ,,b"], "s string", schedules.parse_list("s")) == [["a", "b"]]


def test_parse_schedule(values):
    rows = values(["daily@10:00,02:00,10:00", "daily", "weekly@Mon,23:59", "interval@90m", " OFF ", None, "daily@24:00",
                   "daily@x", "weekly@foo,1:00", "weekly@sun", "interval@0s", "hourly"], "s string",
                  schedules.parse_schedule("s"))
    assert [r["kind"] for r in rows] == ["daily", "daily", "weekly", "interval", "disabled", "always", "daily", "daily",
                                         "weekly", "weekly", "interval", "invalid"]
    assert [r["minutes"] for r in rows[:3]] == [[120, 600], [0], [1439]]
    assert (rows[2]["weekday"], rows[3]["interval_seconds"]) == (1, 5400)
    assert all(r["error"] is None for r in rows[:6])
    assert [r["error"].split(": ", 1)[1] for r in rows[6:11]] == [
        'invalid hour "24"', "expected HH:MM", 'invalid weekday "foo"', "expected weekly@<weekday>,HH:MM",
        "expected interval@<duration>"]


def test_schedule_due(spark):
    cases = [
        (T(2026, 6, 25, 1), "daily@02:00", T(2026, 6, 23, 2), True, T(2026, 6, 24, 2)),
        (T(2026, 6, 25, 11), "daily@02:00,10:00,18:00", T(2026, 6, 25, 10), False, T(2026, 6, 25, 18)),
        (T(2026, 6, 28, 1), "weekly@sun,02:00", T(2026, 6, 14, 2), True, T(2026, 6, 21, 2)),
        (T(2026, 6, 28, 1), "weekly@sun,02:00", None, False, T(2026, 6, 28, 2)),
        (T(2026, 6, 30, 2), "weekly@sun,02:00", None, True, T(2026, 6, 28, 2)),
        (T(2026, 6, 25, 1), "daily@02:00", None, False, T(2026, 6, 25, 2)),
        (T(2026, 6, 25, 2), "daily@02:00", None, True, T(2026, 6, 25, 2)),
        (T(2026, 6, 25, 3), "interval@6h", T(2026, 6, 25, 1), False, T(2026, 6, 25, 7)),
        (T(2026, 6, 25, 3), "interval@6h", None, True, None),
        (T(2026, 6, 25, 3), "always", T(2026, 6, 25, 1), True, None),
        (T(2026, 6, 25, 3), "never", None, False, None),
        (T(2026, 6, 25, 3), "hourly", None, False, None),
        (T(2026, 6, 25, 3), None, None, True, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)],
                               "i int, now timestamp_ntz, schedule string, last_success timestamp_ntz")
    rows = sorted(schedule_due(df).collect(), key=lambda r: r["i"])
    assert [(r["due"], r["target"]) for r in rows] == [c[3:] for c in cases]
    assert rows[0]["reason"] == "schedule=daily@02:00 due at 2026-06-24T02:00:00Z"
    assert rows[8]["reason"] == "schedule=interval@6h first run" and rows[11]["error"].startswith('invalid schedule "hourly"')


def test_schedule_due_in_a_zone(spark):
    df = spark.createDataFrame([(T(2026, 6, 25, 0, 30), "daily@02:00", None)],
                               "now timestamp, schedule string, last_success timestamp")
    row = schedule_due(df, zone="Europe/Berlin").collect()[0]
    assert row["due"] and row["target"] == T(2026, 6, 25, 2)


def test_progress_events(values):
    rows = values(["2026/05/28 21:56:10.631283 found 4 databases: a, b", "x [1/4] processing a ",
                   "starting dump for database=", "completed dump for database=a output=/x", "found x databases",
                   "s3 upload: go", "deleting old backup folder: /x", "[a/4] processing z", "cleanup: y"],
                  "m string", progress.parse_progress_event("m"))
    assert [tuple(r) for r in rows] == [
        ("found", 4, None, None), ("processing", 4, 1, "a"), ("starting", None, None, ""),
        ("completed", None, None, "a"), (None, None, None, None), ("upload", None, None, None),
        ("cleanup", None, None, None), (None, None, None, None), ("cleanup", None, None, None)]
    assert values([(4, 1, 0), (4, 1, 1), (4, 2, 1), (0, 1, 1), (1000, 1000, 999), (None, 1, 0)],
                  "t bigint, c bigint, d bigint", progress.progress_percent("t", "c", "d")) == [
        0.0875, 0.25, 0.3375, 0.0, 0.99, 0.0]


def test_text_helpers(values):
    assert values(["a=1 b=2 a=3", "none"], "s string", text.extract_kv("s")) == [{"a": "3", "b": "2"}, {}]
    assert values(["config: Schedule", "hcSc"], "s string", text.fuzzy_match("s", "cSch")) == [True, False]
    assert values(["", "a.b"], "s string", text.fuzzy_match("s", "")) == [True, True]
    ends = ["-- Dump completed" + "x" * 239, "-- Dump completed" + "x" * 240, "-- Dump completed" + "é" * 120, "no"]
    assert values(ends, "s string", text.has_end_marker("s")) == [True, False, False, False]
