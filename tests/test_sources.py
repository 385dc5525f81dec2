from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.operators.identity import content_identity, table_fingerprint
from tallyboard.operators.profile import (
    data_checks, leaf_profile, leaf_types, passport, require_passed, schema_types, source_facts, source_window,
    timezone_check, union_all,
)
from tallyboard.operators.status import data_status, freshness_rollup
from tallyboard.sources.load import (
    ContractError, Freshness, load_source, open_quotes, register, source_files, source_format,
    table_source,
)
from tallyboard.sources.ragged import quarantine
from tallyboard.sources.snapshot import snapshot_sources

BUILT = datetime(2026, 7, 1, tzinfo=timezone.utc)


@pytest.fixture
def csv(tmp_path):
    def write(text, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


ORDERS = (
    "ticket,depot,vehicle,fare,boarded,exported\n"
    "71,North,tram,2.80,2026-06-29T13:10:00Z,2026-06-30T05:15:00Z\n"
    "72,South,bus,3,2026-06-30T09:00:00Z,2026-06-30T05:15:00Z\n"
    "73,,bus,-1.40,2026-06-30T10:00:00+02:00,2026-06-30T05:15:00Z\n"
)


def test_csv_source_is_typed(spark, csv):
    settings = Freshness("boarded", "exported", 168)
    source = load_source(spark, "tickets", csv(ORDERS), freshness=settings)
    assert [f.dataType.simpleString() for f in source.frame.schema] == [
        "bigint", "string", "string", "double", "timestamp", "timestamp"
    ]
    row = passport(source, BUILT).first()
    assert (row.source_format, row.rows, row.columns) == ("csv", 3, 6)
    assert row.inferred_column_types["fare"] == "number"
    assert row.inferred_column_types["boarded"] == "datetime"
    assert (row.data_min_at, row.data_max_at, row.data_time_granularity) == (
        datetime(2026, 6, 29, 13, 10), datetime(2026, 6, 30, 9), "datetime"
    )
    assert row.processed_at == datetime(2026, 6, 30, 5, 15)
    assert row.freshness_status == "passed"
    names = values(data_checks(source, BUILT), "name", "status")
    assert names == [("csv_valid", "passed"), ("data_freshness", "passed")]
    assert source.frame.where("depot is null").count() == 1


def test_csv_shapes(spark, csv):
    bom = load_source(spark, "t", csv(b"\xef\xbb\xbfa,b\n1,x\n"))
    assert bom.frame.columns == ["a", "b"]
    ragged = load_source(spark, "t", csv("a,b,c\n1,2\n3,4,5,6\n\n"))
    assert values(ragged.frame) == [(1, 2, None), (3, 4, 5)]
    quoted = load_source(spark, "t", csv('id,text\n1,"two\nlines, ""q"""\n2,plain\n'))
    assert values(quoted.frame) == [(1, 'two\nlines, "q"'), (2, "plain")]
    inch = load_source(spark, "t", csv('id,size\n1,5" pipe\n2,6\n'))
    assert values(inch.frame) == [(1, '5" pipe'), (2, "6")]
    wide = load_source(spark, "t", csv("n\n99999999999999999999\n1\n"))
    assert values(wide.frame) == [(Decimal("99999999999999999999"),), (Decimal(1),)]
    mixed = load_source(spark, "t", csv("n\n12345678901234567890\n1.5\n"))
    assert values(mixed.frame) == [("12345678901234567890",), ("1.5",)]
    huge = load_source(spark, "t", csv(f"n\n{'9' * 40}\n1\n"))
    assert values(huge.frame) == [("9" * 40,), ("1",)]
    split = load_source(spark, "t", csv("n\n1_000\n2.5\n"))
    assert values(split.frame) == [(1000.0,), (2.5,)]
    names = load_source(spark, "t", csv("a`b,c.d,e f\n1,2,3\n"))
    assert names.frame.columns == ["a`b", "c.d", "e f"] and values(names.frame) == [(1, 2, 3)]
    flags = load_source(spark, "t", csv("f,g\nTRUE,NA\nna,\n"))
    assert values(flags.frame) == [(True, "NA"), (None, None)]


def test_date_columns_are_dates(spark, csv):
    source = load_source(spark, "t", csv("d,t,s\n2026-07-01,2026-07-01,2026-W01-1\n,2026-07-02T10:00:00Z,NA\n"))
    assert [f.dataType.simpleString() for f in source.frame.schema] == ["date", "timestamp", "timestamp"]
    assert values(source.frame) == [
        (date(2026, 7, 1), datetime(2026, 7, 1), datetime(2025, 12, 29)),
        (None, datetime(2026, 7, 2, 10), None),
    ]


def test_csv_folder(spark, csv, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("a,b\n2,y\n")
    assert load_source(spark, "t", str(folder)).frame.count() == 2
    (folder / "3.csv").write_text("a,c\n3,z\n")
    with pytest.raises(Exception, match="header does not conform"):
        load_source(spark, "t", str(folder)).frame.collect()


@pytest.mark.parametrize(
    "text, problem",
    [
        ("", "no header"), ("a,,c\n1,2,3\n", "has no name"), ("a,a\n1,2\n", "named twice: a"),
        (b"a,b\n1,\xff\n", "UTF-8"), ('a,b\n1,"x\n2,y\n', "not closed"),
    ],
)
@pytest.mark.parametrize("multiline", [None, True, False])
def test_csv_contract(spark, csv, text, problem, multiline):
    with pytest.raises(ContractError, match=problem):
        load_source(spark, "t", csv(text), multiline=multiline)


def test_open_quotes_are_found_over_several_splits(spark, csv):
    rows = "".join(f'{i},"line {i}\ngoes ""on"" here",5" pipe\n' for i in range(400))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert not open_quotes(spark, csv("a,b,c\n" + rows))
        assert open_quotes(spark, csv("a,b,c\n" + rows + '9,"never closed,1\n10,x,y\n', "o.csv"))
        with pytest.raises(ContractError, match="not closed"):
            load_source(spark, "t", csv('a,b,c\n9,"open,1\n' + "1,x,y\n" * 900, "p.csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_text_after_a_quote_fails_the_read(spark, csv):
    with pytest.raises(Exception):
        load_source(spark, "t", csv('a,b\n1,"x"y\n'), multiline=False)


def test_other_suffixes_are_refused(spark):
    assert source_format("/x/T.CSV") == "csv" and source_format("a.parquet/") == "parquet"
    with pytest.raises(ContractError):
        source_format("/x/data.xlsx")


def failed(source):
    with pytest.raises(ContractError) as problem:
        require_passed(data_checks(source, BUILT))
    return str(problem.value)


def test_failed_checks(spark, csv):
    assert "is empty" in failed(load_source(spark, "t", csv("a,b\n")))
    missing = load_source(spark, "t", csv("id\n1\n"), freshness=Freshness("missing_at"))
    assert "lacks its freshness columns missing_at" in failed(missing)
    empty = load_source(spark, "t", csv("id,at\n1,\n2, \n"), freshness=Freshness("at"))
    assert "'at' is empty in every row" in failed(empty)
    wrong = load_source(
        spark, "t", csv("id,at\n1,2026-01-01\n2,yesterday\n"), freshness=Freshness(None, "at")
    )
    assert "'at' holds 1 values that are no ISO 8601 times" in failed(wrong)
    null_text = load_source(
        spark, "t", csv("id,at\n1,2026-01-01\n2,NA\n"), freshness=Freshness("at")
    )
    assert "1 values that are no ISO" in failed(null_text)
    numbers = table_source("t", spark.range(2), Freshness("id"))
    assert "2 values that are no ISO" in failed(numbers)


def test_offset_free_times_are_utc_and_warned_about(spark, csv):
    settings = Freshness("created_at", "created_at")
    source = load_source(
        spark, "t", csv("id,created_at\n1,2026-06-30 10:00:00\n"), freshness=settings
    )
    assert source_window(source).first().data_max_at == datetime(2026, 6, 30, 10)
    checks = data_checks(source, BUILT)
    every = checks.unionByName(timezone_check(checks, None))
    warned = every.where("status = 'warning'").select("name", "source")
    assert values(warned) == [("timezone_assumed", "t"), ("report_timezone_defaulted", None)]
    assert timezone_check(checks, "UTC").count() == 0
    require_passed(every)


def test_date_only_times_are_not_warned_about(spark, csv):
    source = load_source(
        spark, "t", csv("id,month_dt\n1,2026-06-01\n2,2026-07-01\n"), freshness=Freshness("month_dt")
    )
    row = source_window(source).first()
    assert (row.data_time_granularity, row.data_max_at) == ("date", datetime(2026, 7, 1))
    assert values(data_checks(source, BUILT), "name") == [("csv_valid",)]
    mixed = load_source(
        spark, "t", csv("m\n2026-06-01\n2026-07-01T00:00:00Z\n"), freshness=Freshness("m")
    )
    assert source_window(mixed).first().data_time_granularity == "datetime"


def test_stale_source_warns(spark, csv):
    source = load_source(
        spark, "t", csv("id,created_at\n1,2026-01-01T00:00:00Z\n"),
        freshness=Freshness("created_at", max_lag_hours=24),
    )
    row = data_checks(source, BUILT).where("name = 'data_freshness'").first()
    assert (row.status, row.message) == ("warning", "newest data is 4344.0 hours back, 24 hours are allowed")
    assert passport(source, BUILT).first().freshness_status == "warning"
    # A lag of exactly the limit is still fresh.
    limit = table_source(
        "t", spark.sql("SELECT timestamp'2026-06-30 00:00:00' at"), Freshness("at", max_lag_hours=24)
    )
    assert passport(limit, BUILT).first().freshness_status == "passed"


def test_two_sources_roll_up(spark, csv):
    sources = [
        load_source(spark, name, csv(f"id,m\n1,{day}\n", f"{name}.csv"), freshness=Freshness("m"))
        for name, day in (("one", "2026-06-01"), ("two", "2026-05-01"))
    ]
    passports = union_all([passport(s, BUILT) for s in sources])
    checks = union_all([data_checks(s, BUILT) for s in sources])
    row = freshness_rollup(passports, checks).first()
    assert (row.status, row.data_through, row.processed_at) == (
        "passed", datetime(2026, 6, 1), None
    )
    warned = freshness_rollup(passports, checks.unionByName(timezone_check(checks, None)))
    assert warned.first().status == "warning"
    status = data_status(passports, "America/New_York").orderBy("name")
    # A date keeps its day in every zone.
    assert values(status, "name", "through", "processed", "rows") == [
        ("one", "Jun 01, 2026", "Not configured", "1"),
        ("two", "May 01, 2026", "Not configured", "1"),
    ]


def test_status_moves_instants_to_the_zone(spark):
    source = table_source("t", spark.sql("SELECT timestamp'2026-06-30 02:05:00' at"), Freshness("at"))
    row = data_status(passport(source, BUILT), "America/New_York").first()
    assert row.through == "Jun 29, 2026, 10:05 PM"


def test_csv_and_parquet_join(spark, csv, tmp_path):
    path = str(tmp_path / "cohorts.parquet")
    spark.createDataFrame(
        [(1, "2026-07-01"), (2, "2026-07-31")], "id long, month_dt string"
    ).write.parquet(path)
    events = load_source(spark, "events", csv("id,value\n1,10\n2,20\n", "events.csv"))
    cohorts = load_source(spark, "cohorts", path, freshness=Freshness("month_dt"))
    assert register([events, cohorts]) == ["events", "cohorts"]
    joined = spark.sql(
        "SELECT e.id, c.month_dt, e.value FROM events e LEFT JOIN cohorts c ON c.id = e.id ORDER BY 1"
    )
    assert values(joined) == [(1, "2026-07-01", 10), (2, "2026-07-31", 20)]
    row = passport(cohorts, BUILT).first()
    assert (row.source_format, row.data_time_granularity) == ("parquet", "date")
    assert (row.data_min_at, row.data_max_at) == (datetime(2026, 7, 1), datetime(2026, 7, 31))
    assert values(data_checks(cohorts, BUILT), "name") == [("parquet_valid",)]


def test_text_and_typed_freshness_columns_together(spark):
    rows = spark.createDataFrame(
        [(date(2026, 6, 1), "2026-06-02T00:00:00Z"), (date(2026, 6, 3), "2026-06-04T00:00:00Z")],
        "day date, seen string",
    )
    row = source_window(table_source("t", rows, Freshness("day", "seen"))).first()
    assert (row.data_max_at, row.data_time_granularity) == (datetime(2026, 6, 3), "date")
    assert (row.processed_at, row.processed_time_granularity) == (datetime(2026, 6, 4), "datetime")


def test_nested_schema_names(spark):
    rows = spark.sql(
        "SELECT 1 a, named_struct('x', 1.5D, 'y', array(date'2026-01-01')) s, cast(1 as decimal(5,2)) d"
    )
    assert leaf_types(rows.schema) == {
        "a": "integer", "s.x": "number", "s.y.list.element": "datetime", "d": "string"
    }
    assert schema_types(table_source("t", rows)).count() == 4
    assert source_facts(table_source("t", rows)).first().columns == 4


def test_leaf_profile(spark):
    rows = spark.sql(
        """SELECT * FROM VALUES
             (1, named_struct('x', 1, 'y', array(1, null)), array(named_struct('z', 1)), map('k', null), array(array(1), null)),
             (null, null, array(named_struct('z', null), null), map('k', 2, 'l', 3), null)
           AS t(a, s, l, m, n)"""
    ).select("a", "s", "l", F.col("m").cast("map<string,int>"), "n")
    found = leaf_profile(table_source("t", rows))
    assert values(found) == [
        ("a", "integer", 1), ("s.x", "integer", 1), ("s.y.list.element", "integer", 1),
        ("l.list.element.z", "integer", 1), ("m.key_value.key", "string", 3),
        ("m.key_value.value", "integer", 2), ("n.list.element.list.element", "integer", 1),
    ]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    first = table_fingerprint(rows).first()
    assert first == table_fingerprint(rows.repartition(4).orderBy("y")).first()
    assert first.rows == 3
    changed = rows.withColumn("x", F.coalesce("x", F.lit("b")))
    assert table_fingerprint(changed).first().fingerprint != first.fingerprint
    # Cells keep apart, and so do NULL and empty text.
    pairs = [[("a|b", "c")], [("a", "b|c")], [(None, "a")], [("a", None)], [("", "a")]]
    prints = {
        table_fingerprint(spark.createDataFrame(p, "x string, y string")).first()[1] for p in pairs
    }
    assert len(prints) == len(pairs)
    assert table_fingerprint(rows.where("false")).first().rows == 0


def test_file_facts(spark, csv):
    found = source_files(spark, csv(ORDERS))
    assert values(found, "file_name", "length") == [("data.csv", len(ORDERS))]


def test_identity(spark):
    hashes = spark.createDataFrame([("b", "2"), ("a", "1")], "name string, sha256 string")
    build = {"slug": "test", "definition_sha256": "d", "tool_version": "1", "runtime_version": "2"}
    first = content_identity(hashes, **build).first()
    assert first == content_identity(hashes.orderBy("name"), **build).first()
    import hashlib

    text = '{"report_source_sha256":"d","runtime_version":"2","sources":{"a":"1","b":"2"},"tool_version":"1"}'
    assert first.content_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert first.artifact_id == f"test__{first.content_sha256[:12]}"
    other = content_identity(hashes.where("name = 'a'"), **build).first()
    assert other.artifact_id != first.artifact_id
    assert content_identity(hashes, **{**build, "tool_version": "9"}).first() != first


def test_snapshot(spark, csv, tmp_path):
    source = load_source(spark, "orders", csv(ORDERS))
    written = snapshot_sources([source], str(tmp_path / "out"))
    assert spark.read.parquet(written["orders"]).count() == 3


def test_ragged_rows_have_their_place(spark, csv, tmp_path):
    lines = ["a,b,c"]
    for i in range(3000):
        lines.append({0: f"{i}", 1: f'{i},"x, ""y"" z"', 2: f'{i},1,2,"3,4"', 3: ""}.get(i % 97, f"{i},1,2"))
    folder = tmp_path / "ragged.csv"
    folder.mkdir()
    (folder / "one.csv").write_text("\n".join(lines) + "\n")
    (folder / "two.csv").write_bytes(b"a,b,c\r\n1,2\r\n\r\n1,2,3\r\n,,,\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = quarantine(spark, str(folder), ["a", "b", "c"]).collect()
        source = load_source(spark, "ragged", str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = {("one.csv", n + 1, "long_rows" if "3,4" in text else "short_rows", text)
                for n, text in enumerate(lines) if n and (n - 1) % 97 in (0, 1, 2)}
    expected |= {("two.csv", 2, "short_rows", "1,2"), ("two.csv", 5, "long_rows", ",,,")}
    assert {(r.file.rsplit("/", 1)[-1], r.line, r.kind, r.record) for r in found} == expected
    counts = {kind: sum(e[2] == kind for e in expected) for kind in ("short_rows", "long_rows")}
    assert source.ragged == counts
    checks = {r.name: (r.status, r.message) for r in data_checks(source, BUILT).collect()}
    assert checks["short_rows"] == (
        "passed", f"rows with fewer cells than the header; missing ones are NULL: {counts['short_rows']}")
    assert checks["long_rows"][0] == "passed" and checks["long_rows"][1].endswith(str(counts["long_rows"]))


def test_ragged_records_of_several_lines(spark, csv):
    path = csv('a,b,c\n1,"two\nlines",3\n4,"five\n5"\n6,7,8,"nine\n9"\n10,11,12\n')
    source = load_source(spark, "spanning", path)
    assert source.ragged == {"short_rows": 1, "long_rows": 1}
    assert sorted(values(source.frame, "a", "c")) == [(1, 3), (4, None), (6, 8), (10, 12)]
    found = sorted((r.kind, r.cells, r.line) for r in quarantine(spark, path, ["a", "b", "c"], spans=True).collect())
    assert found == [("long_rows", 4, None), ("short_rows", 2, None)]
    whole = load_source(spark, "whole", csv("a,b\n1,2\n", "whole.csv"))
    assert whole.ragged == {}
