import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tideline.operators import forecast as fc
from tideline.operators import normalize as nz
from tideline.plans import incremental
from tideline.sources import audit_csv, deliveries, publish
from tideline.streaming import landing

NAMES = (*nz.REQUIRED, "category", "contact_type")
SHA = "ab" * 32


def record(number=1, state="New", updated="1/3/2016 10:00", **changes):
    row = {"number": f"INC{number}", "incident_state": state, "opened_at": "1/3/2016 09:00", "sys_updated_at": updated,
           "sys_mod_count": "0", "priority": "3 - Moderate", "assignment_group": "Group 1", "reopen_count": "0",
           "reassignment_count": "0", "category": "C", "contact_type": "Phone"}
    return {**row, **changes}


def test_csv_ordinals_survive_many_splits_and_a_byte_order_mark(spark, tmp_path):
    header = ",".join(NAMES)
    for name, count in (("a.csv", 3000), ("b.csv", 5)):
        lines = [",".join(record(i)[n] for n in NAMES) for i in range(2, count + 2)]
        (tmp_path / name).write_text("\ufeff" + header + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
        paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
        read = audit_csv.read_audit_csv(spark, paths)
        assert spark.read.csv(paths).rdd.getNumPartitions() > 5
        rows = read.select("source_sha256", "source_row", "number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 3005
    assert all(r["number"] == f"INC{r['source_row']}" for r in rows)
    assert {r["source_sha256"] for r in rows} == {hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.csv", "b.csv")}


def test_csv_files_keep_their_own_headers_quotes_and_line_breaks(spark, tmp_path):
    def line(values):
        return ",".join('"' + v.replace('"', '""') + '"' for v in values)

    names = (*NAMES, "note")
    plain = [{**record(i), "category": 'Say "no", twice', "note": ""} for i in (2, 3)]
    broken = [{**record(i), "note": f'first, "{i}"\nthen more'} for i in (2, 3, 4)]
    for name, order, rows in (("a.csv", NAMES, plain), ("b.csv", names[::-1], broken)):
        (tmp_path / name).write_text("\n".join([line(order), *[line([r[n] for n in order]) for r in rows]]) + "\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    read = {(r["note"] is not None, r["source_row"]): r for r in audit_csv.read_audit_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert sorted(read) == [(False, 2), (False, 3), (True, 2), (True, 3), (True, 4)]
    for (noted, row), found in read.items():
        assert found["number"] == f"INC{row}" and found["sys_updated_at"] == "1/3/2016 10:00"
        assert found["category"] == ("C" if noted else 'Say "no", twice')
        assert found["note"] == (f'first, "{row}"\nthen more' if noted else None)


def test_csv_without_required_columns_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("other\n1\n")
    with pytest.raises(ValueError, match="required names"):
        audit_csv.read_audit_csv(spark, str(tmp_path / "x.csv"))


def test_envelope_integers_must_be_json_integers(spark, tmp_path):
    lines = [{"source_sha256": SHA, "source_row": r, "revision": v, "record": {"b": 1, "a": 2}}
             for r, v in ((2, 1), (1, 1), ("2", 1), (2.5, 1), (2, True), (2, 0), (2, None))]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(line) for line in lines))
    rows = deliveries.read_deliveries(spark, str(tmp_path))
    assert rows.count() == 7
    assert nz.envelope_violations(rows).count() == 6


def test_selection_and_changed_commitments(spark):
    registry = spark.createDataFrame([("b2", "x", "2016-03-08"), ("b1", "y", "2016-03-08"), ("b3", "z", "2016-03-09"), ("b0", "w", "2016-03-01")],
                                     "batch_id string, sha256 string, available_as_of string")
    done = spark.createDataFrame([("b0", "w")], "batch_id string, sha256 string")
    assert [r["batch_id"] for r in deliveries.select_batches(registry, done, "2016-03-08").collect()] == ["b1", "b2"]
    broken = spark.createDataFrame([("b0", "changed"), ("gone", "v")], "batch_id string, sha256 string")
    assert {tuple(r) for r in deliveries.changed_commitments(registry, broken).collect()} == {("b0", "changed"), ("gone", "removed")}


def envelopes(spark, rows):
    """rows: (batch, available, position, source_row, revision, record)."""
    struct = ", ".join(f"{n}: string" for n in NAMES)
    data = [(b, a, p, SHA, r, v, tuple(rec[n] for n in NAMES)) for b, a, p, r, v, rec in rows]
    return spark.createDataFrame(data, "batch_id string, available_as_of string, position long, source_sha256 string, source_row int, "
                                 f"revision int, record struct<{struct}>")


def registry(spark, *entries):
    return spark.createDataFrame([(b, hashlib.sha256(b.encode()).hexdigest(), f"landing/{b}", a) for b, a in entries],
                                 "batch_id string, sha256 string, key string, available_as_of string")


WEEKS = (("b1", "2016-03-06 23:59:59"), ("b2", "2016-03-13 23:59:59"))


def weekly_rows():
    first = [("b1", WEEKS[0][1], i, i, 1, record(i % 20, "New" if i % 2 else "Resolved", f"{1 + i % 5}/3/2016 10:{i % 60:02d}")) for i in range(2, 122)]
    second = [("b2", WEEKS[1][1], 1, 2, 2, record(2, "Closed", "2/3/2016 12:00")), ("b2", WEEKS[1][1], 2, 3, 1, first[1][5]),
              ("b2", WEEKS[1][1], 3, 500, 1, record(99, "New", "8/3/2016 10:00"))]
    return first + second


def test_incremental_runs_publish_one_consistent_attempt(spark, tmp_path):
    root, table, rows = str(tmp_path / "p"), registry(spark, *WEEKS), envelopes(spark, weekly_rows())
    first = incremental.run(spark, root, table, rows, WEEKS[0][1], "d1")
    assert first["sequence"] == 1 and publish.published_table(spark, root, "events").count() == 120
    again = incremental.run(spark, root, table, rows, WEEKS[0][1], "d1")
    assert again["attempt"] == first["attempt"] and again["sequence"] == 1
    second = incremental.run(spark, root, table, rows, WEEKS[1][1], "d1")
    events = publish.published_table(spark, root, "events")
    assert second["sequence"] == 2 and events.count() == 121
    assert events.filter("source_row = 2").first()["state"] == "Closed"
    revisions = publish.published_table(spark, root, "event_revisions")
    assert revisions.count() == 122 and revisions.filter("late_arrival").count() == 1
    assert publish.published_table(spark, root, "processed").count() == 2
    publish.register_views(spark, root, ["fact_incident_snapshot", "dim_priority"], "t_")
    assert spark.table("t_incidents").count() == spark.table("t_fact_incident_snapshot").count() == 21
    publish.create_catalog_tables(spark, root, ["fact_incident_snapshot", "events", "event_revisions"])
    assert spark.table("default.incidents").count() == 21
    assert (spark.table("default.events").count(), spark.table("default.event_revisions").count()) == (121, 122)
    with pytest.raises(ValueError, match="lies before"):
        incremental.run(spark, root, table, rows, WEEKS[0][1], "d1")
    with pytest.raises(ValueError, match="another dataset"):
        incremental.run(spark, root, table, rows, "2016-03-20 23:59:59", "d2")
    assert publish.read_pointer(spark, root)["attempt"] == second["attempt"]


def csv_lines(folder):
    """Header once, then the rows of all parts."""
    parts = [path.read_text().splitlines() for path in sorted(folder.glob("*.csv"))]
    return [next(part[0] for part in parts if part), *[line for part in parts for line in part[1:]]]


def test_csv_exports(spark, tmp_path):
    groups = spark.createDataFrame([("Group, 1", 3, 2, 0, 1)], "group string, incidents int, open int, reopened int, reassigned int")
    publish.export_queue_csv(groups, str(tmp_path / "q"))
    lines = csv_lines(tmp_path / "q")
    assert lines == ['"group","incidents","open","reopened","reassigned"', '"Group, 1","3","2","0","1"']
    forecast = spark.createDataFrame([("s", "2026-01-01", 90, 80, 100)], "series string, target string, forecast int, lower int, upper int")
    publish.export_forecast_csv(fc.capacity_excess(forecast, 85), str(tmp_path / "f"))
    lines = csv_lines(tmp_path / "f")
    assert lines == ["date,series,forecast,lower,upper,daily_capacity,demand_above_capacity", "2026-01-01,s,90,80,100,85,5"]


def test_failed_gate_leaves_the_pointer_alone(spark, tmp_path):
    root, table = str(tmp_path / "p"), registry(spark, *WEEKS)
    bad = [(b, a, p, r, v, {**rec, "incident_state": "nonsense"} if p % 10 == 0 else rec) for b, a, p, r, v, rec in weekly_rows()]
    with pytest.raises(ValueError, match="Quality gate"):
        incremental.run(spark, root, table, envelopes(spark, bad), WEEKS[0][1], "d1")
    assert publish.read_pointer(spark, root) is None


def test_landing_stream_merges_each_file_once_and_keeps_late_rows(spark, tmp_path):
    rows = weekly_rows()
    schema = envelopes(spark, rows[:1]).schema
    land, history, checkpoint = (str(tmp_path / name) for name in ("land", "history", "checkpoint"))
    envelopes(spark, rows[:120]).coalesce(1).write.json(land)
    landing.watch_landing(spark, land, schema, history, checkpoint, "2016-03-06 23:59:59").awaitTermination()
    assert spark.read.parquet(history).count() == 120
    envelopes(spark, rows[120:]).coalesce(1).write.mode("append").json(land)
    for _ in range(2):
        landing.watch_landing(spark, land, schema, history, checkpoint, "2016-03-06 23:59:59").awaitTermination()
    stored = spark.read.parquet(history)
    assert stored.count() == 122
    late = stored.filter((F.col("micro_batch") == 1) & F.col("late_arrival"))
    assert [(r["source_row"], r["revision"]) for r in late.collect()] == [(2, 2)]


def landed_files(spark, root):
    """Two weekly gzip files with a few bad rows, and three files that must be refused; returns the registry."""
    import gzip
    entries = []

    def put(batch, at, lines, sha=None, rows=None, write=True):
        key = f"landing/{batch}.jsonl.gz"
        data = gzip.compress("\n".join(json.dumps(line) for line in lines).encode())
        if write:
            (root / "landing").mkdir(exist_ok=True)
            (root / key).write_bytes(data)
        entries.append((batch, key, sha or hashlib.sha256(data).hexdigest(), len(lines) if rows is None else rows, at))

    rows = {week: [{"source_sha256": SHA, "source_row": r, "revision": v, "record": {**rec, "note": [1, {"x": r}]}} for b, _, p, r, v, rec in weekly_rows() if b == week]
            for week in ("b1", "b2")}
    rows["b1"].append({"source_sha256": SHA, "source_row": 400, "revision": 1, "record": record(5, "Nonsense", sys_mod_count="-1", note="odd")})
    put("b1", WEEKS[0][1], rows["b1"])
    put("b2", WEEKS[1][1], rows["b2"])
    put("c1", WEEKS[1][1], rows["b2"][:1], sha="cd" * 32)
    put("c2", WEEKS[1][1], rows["b2"][:2], rows=5)
    put("c3", WEEKS[1][1], [{"source_sha256": SHA, "source_row": 900, "revision": 1, "record": {k: v for k, v in record(7).items() if k != "priority"}},
                            {"source_sha256": SHA, "source_row": True, "revision": 1, "record": record(8)}])
    put("c4", WEEKS[1][1], rows["b2"][:1], write=False)
    return spark.createDataFrame(entries, "batch_id string, key string, sha256 string, rows long, available_as_of string")


REFUSED = {"c1": ["checksum"], "c2": ["row_count"], "c3": ["envelope", "required_keys"], "c4": ["missing"]}


def test_landed_files_are_admitted_or_refused_and_published(spark, tmp_path):
    table, root = landed_files(spark, tmp_path), str(tmp_path / "p")
    incremental.run_landed(spark, root, str(tmp_path), table, WEEKS[0][1], "d1", width=10)
    pointer = incremental.run_landed(spark, root, str(tmp_path), table, WEEKS[1][1], "d1", width=10)
    assert {r["batch_id"]: r["violations"] for r in publish.published_table(spark, root, "refused_files").collect()} == REFUSED
    assert {r["batch_id"] for r in publish.published_table(spark, root, "processed").collect()} == {"b1", "b2"}
    (bad,) = publish.published_table(spark, root, "quarantine").select("source_row", "errors", F.to_json("record").alias("record")).collect()
    assert bad["source_row"] == 400 and bad["errors"] == ["unknown_state", "negative_sys_mod_count", "invalid_sys_mod_count"] and json.loads(bad["record"])["note"] == "odd"
    stats = publish.published_table(spark, root, "run_statistics").orderBy("as_of").collect()
    assert [(r["input_rows"], r["rejected_rows"], r["inserted"], r["corrected"], r["duplicates"], r["late_arrivals"]) for r in stats] == [(121, 1, 120, 0, 0, 0), (3, 0, 1, 1, 1, 1)]
    assert {(r["reason"], r["rows"]) for r in publish.published_table(spark, root, "reject_reasons").collect()} == {(e, 1) for e in bad["errors"]}
    assert publish.published_table(spark, root, "workflow").first()["processed_batches"] == 2 + 4
    assert json.loads(pointer["quality"])["source_rows"] == 124


def test_landing_stream_admits_files_and_survives_a_replay(spark, tmp_path):
    table = landed_files(spark, tmp_path)
    (tmp_path / "landing/stray.jsonl").write_text(json.dumps({"source_sha256": SHA, "source_row": 7, "revision": 1, "record": record(1)}))
    places = {name: str(tmp_path / name) for name in ("history", "quarantine", "refused")}
    body = landing.merge_micro_batch(places["history"], WEEKS[0][1], places["quarantine"], str(tmp_path), table, places["refused"])
    stream = spark.readStream.schema(deliveries.ENVELOPE).json(str(tmp_path / "landing")).withColumn("file", F.col("_metadata.file_path"))
    stream.writeStream.foreachBatch(body).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    again = spark.read.schema(deliveries.ENVELOPE).json(str(tmp_path / "landing")).withColumn("file", F.col("_metadata.file_path"))
    body(again, 0)
    refused = {r["batch_id"]: r["violations"] for r in spark.read.parquet(places["refused"]).collect()}
    assert refused == {**{k: v for k, v in REFUSED.items() if k != "c4"}, None: ["unregistered"]}
    assert spark.read.parquet(places["history"]).count() == 122 and spark.read.parquet(places["quarantine"]).count() == 1


def test_two_writers_cannot_take_one_sequence(spark, tmp_path):
    root = str(tmp_path)

    def row(attempt):
        return (1, attempt, "r", "2016-03-06", "d", "now", "{}")
    assert publish.take_sequence(spark, root, 1, row("a"))["attempt"] == "a"
    with pytest.raises(publish.PointerTaken):
        publish.take_sequence(spark, root, 1, row("b"))
    assert publish.read_pointer(spark, root)["attempt"] == "a"
    # The other writer passes the check before the first one renames.
    real = publish.exists
    publish.exists = lambda *_: False
    try:
        with pytest.raises(publish.PointerTaken):
            publish.take_sequence(spark, root, 1, row("c"))
    finally:
        publish.exists = real
    assert publish.read_pointer(spark, root)["attempt"] == "a" and publish.latest_sequence(spark, root) == 1
    from concurrent.futures import ThreadPoolExecutor

    def attempt(name):
        try:
            return publish.take_sequence(spark, root, 2, (2, *row(name)[1:]))["attempt"]
        except publish.PointerTaken:
            return None
    with ThreadPoolExecutor(4) as pool:
        won = [name for name in pool.map(attempt, "wxyz") if name]
    assert len(won) == 1 and publish.read_pointer(spark, root)["attempt"] == won[0]


BUILT = ("events", "incident_state", "fact_incident_history", "fact_incident_snapshot", "fact_daily_queue", "dim_assignment_group", "dim_priority", "dim_date",
         "aggregate_queue", "report_summary", "report_groups", "report_profile", "segments")


def test_an_increment_rewrites_its_parts_only_and_equals_a_full_build(spark, tmp_path):
    """One incident in a hundred is touched; what is published equals one run over everything."""
    first = [("b1", WEEKS[0][1], i, i, 1, record(i % 1000, ("New", "Resolved", "Active")[i % 3], f"{1 + i % 5}/3/2016 10:{i % 60:02d}", assignment_group=f"Group {i % 7}"))
             for i in range(2, 3002)]
    later = [("b2", WEEKS[1][1], 1, 12, 2, record(12, "Closed", "3/3/2016 12:00", assignment_group="Group 9")),
             *[("b2", WEEKS[1][1], 10 + i, 5000 + i, 1, record(10 + i, "Resolved", "8/3/2016 10:00")) for i in range(10)]]
    hidden = [("b1", WEEKS[0][1], 9000, 9000, 1, record(505, "Closed", "9/3/2016 10:00"))]
    rows, table = envelopes(spark, first + hidden + later), registry(spark, *WEEKS)
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    one = incremental.run(spark, root, table, rows, WEEKS[0][1], "d", width=20)
    two = incremental.run(spark, root, table, rows, WEEKS[1][1], "d", width=20)
    manifest = publish.read_manifest(spark, root, two)
    fresh = {(r["name"], r["part"]) for r in manifest.filter(F.col("slot").contains(two["attempt"])).collect() if r["part"] != publish.WHOLE}
    assert fresh == {(name, part) for name in publish.BY_PART for part in ("0", "25")}
    assert manifest.filter(F.col("name") == "events").count() == 50
    written = spark.read.parquet(f"{root}/data/attempt={two['attempt']}/table=events").count()
    assert written < 0.05 * spark.read.parquet(f"{root}/data/attempt={one['attempt']}/table=events").count()
    incremental.run(spark, other, table, rows, WEEKS[1][1], "d", width=1000)
    for name in BUILT:
        left, right = publish.published_table(spark, root, name), publish.published_table(spark, other, name)
        names = sorted(set(left.columns) - {"received_at", "part", "late_arrival"})
        assert sorted(map(repr, left.select(names).collect())) == sorted(map(repr, right.select(names).collect())), name
    # A second increment without any delivery changes nothing but the cutoff.
    three = incremental.run(spark, root, table, rows, "2016-03-20 00:00:00", "d", width=20)
    assert not publish.read_manifest(spark, root, three).filter(F.col("name").isin(*publish.BY_PART) & F.col("slot").contains(three["attempt"])).collect()
