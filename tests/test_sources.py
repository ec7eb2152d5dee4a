import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packetloom.functions.labels import FLOW_CLASSES
from packetloom.operators.records import MissingFeaturesError, project_records
from packetloom.schemas import CONNECTION_FEATURES, FLOW_COLUMN_NAMES, FLOW_FEATURES, WINDOW_FEATURES
from packetloom.sources import datasets, logs


def daily_csv(rows, order=None):
    """rows: (label, {feature: text}); all other values are 1; names lead with a space except the first."""
    names = order or list(FLOW_COLUMN_NAMES)
    head = ",".join([FLOW_COLUMN_NAMES[names[0]]] + [" " + FLOW_COLUMN_NAMES[n] for n in names[1:]] + [" Label"])
    lines = [",".join([str(v.get(n, 1)) for n in names] + [label]) for label, v in rows]
    return "\n".join([head, *lines]) + "\n"


def write(path: Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("latin1"))


def test_flow_cleaning(spark, tmp_path):
    rows = [
        ("BENIGN", {}),
        (" DoS Hulk ", {"flow_duration": 5}),
        ("BENIGN", {"flow_bytes_per_s": "Infinity"}),
        ("BENIGN", {"flow_duration": -1}),
        ("BENIGN", {"flow_pkts_per_s": "NaN"}),
        ("BENIGN", {"dst_port": "oops"}),
    ]
    write(tmp_path / "monday.csv", daily_csv(rows))
    got = datasets.read_flows(spark, str(tmp_path)).collect()
    assert sorted(r.label for r in got) == ["BENIGN", "DoS Hulk"]
    assert set(FLOW_FEATURES) <= set(got[0].asDict()) and got[0].file == "monday.csv"


def test_days_are_joined_by_name(spark, tmp_path):
    write(tmp_path / "a" / "one.csv", daily_csv([("BENIGN", {"dst_port": 80})]))
    shuffled = list(reversed(FLOW_COLUMN_NAMES))
    rows = [("Web Attack \x96 XSS", {"dst_port": 443}), ("Bot", {"dst_port": 22})]
    write(tmp_path / "b" / "two.csv", daily_csv(rows, shuffled))
    got = datasets.read_flows(spark, str(tmp_path)).orderBy("dst_port").collect()
    assert [(r.dst_port, r.label) for r in got] == [(22.0, "Bot"), (80.0, "BENIGN"), (443.0, "Web Attack \x96 XSS")]
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        datasets.read_flows(spark, str(empty))


def test_headers_of_all_files_take_one_job(spark, tmp_path):
    """Few and many files, large ones, odd names, blank first lines, empty files, a name that occurs twice."""
    reverse = list(reversed(FLOW_COLUMN_NAMES))
    for i in range(24):
        write(tmp_path / "many" / f"day {i}+1%.csv", daily_csv([("BENIGN", {"dst_port": i})], reverse if i % 3 else None))
    write(tmp_path / "many" / "deep" / "blank.csv", "\n \n" + daily_csv([("Bot", {"dst_port": 99})]))
    write(tmp_path / "many" / "empty.csv", "")
    write(tmp_path / "many" / "notes.txt", "no flows")
    twice = daily_csv([("Bot", {"dst_port": 98})]).split("\n")
    write(tmp_path / "many" / "twice.csv", f"{twice[0]}, {FLOW_COLUMN_NAMES['dst_port']}\n{twice[1]},7\n")
    write(tmp_path / "one" / "large.csv", daily_csv([("BENIGN", {})] * 200_000))

    def jobs(folder):
        spark.sparkContext.setJobGroup(f"headers-{folder}", "headers")
        try:
            rows = datasets.read_flows_raw(spark, str(tmp_path / folder))
            return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers-{folder}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    many, many_jobs = jobs("many")
    one, one_jobs = jobs("one")
    assert many_jobs <= one_jobs + 2
    assert sorted(int(r.dst_port) for r in many.collect()) == [*range(24), 98, 99]
    assert many.select("file").distinct().count() == 26 and one.count() == 200_000


def connection_line(label, difficulty=21):
    values = {"protocol_type": "tcp", "service": "http", "flag": "SF"}
    return ",".join([str(values.get(c, 0)) for c in CONNECTION_FEATURES] + [label, str(difficulty)])


def test_connection_files(spark, tmp_path):
    write(tmp_path / "train.txt", "\n".join(connection_line(x) for x in ("normal", "neptune")) + "\n")
    path = str(tmp_path / "train.txt")
    df = datasets.read_connections(spark, path)
    assert df.columns == [*CONNECTION_FEATURES, "label"] and df.count() == 2
    raw = datasets.read_connections(spark, path, drop_difficulty=False)
    assert datasets.shape_check(raw, "train", 2, 43).first().ok
    with pytest.raises(datasets.ShapeError, match="125973"):
        datasets.verify_split(raw, "train")
    with pytest.raises(ValueError, match="none of the splits"):
        datasets.verify_split(raw, "other")


def test_records_need_their_features(spark):
    row = spark.range(1).select(*[F.lit(1.0).alias(c) for c in FLOW_FEATURES], F.lit("x").alias("junk"))
    assert project_records(row, "cic").columns == FLOW_FEATURES
    with pytest.raises(MissingFeaturesError, match="ack_flag_cnt"):
        project_records(row.drop("ack_flag_cnt"), "cic")


def window_line(i):
    row = dict.fromkeys(WINDOW_FEATURES, 1) | {"src_ip": f"10.0.0.{i}", "window_start": 60.0 * i}
    return json.dumps(row)


def test_baseline_log(spark, tmp_path):
    write(tmp_path / "base" / "part.json", "\n\n".join(window_line(i) for i in range(5)) + "\n\n")
    path = str(tmp_path / "base")
    rows = logs.read_baseline(spark, path)
    assert rows.count() == 5 and rows.select("window_id").distinct().count() == 5
    more = rows.select("src_ip", (F.col("window_start") * 1e6).cast("bigint").alias("window_start_us"), *WINDOW_FEATURES)
    logs.append_baseline(more, path)
    assert logs.read_baseline(spark, path).count() == 10


def test_compaction_keeps_the_newest(spark, tmp_path):
    schema = "seq long, what string"
    log = spark.range(1000).select(F.col("id").alias("seq"), F.lit("attack").alias("what"))
    path, target = str(tmp_path / "log"), str(tmp_path / "log-v2")
    logs.append_log(log, path)
    parsed = log.schema
    assert logs.compact_log(spark, path, target, parsed, ["seq"], max_bytes=10**7, keep_rows=10) is None
    assert logs.compact_log(spark, path, target, parsed, ["seq"], max_bytes=100, keep_rows=10) == 990
    assert sorted(r.seq for r in spark.read.schema(schema).json(target).collect()) == list(range(990, 1000))


def test_retention_per_log(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.when(F.col("id") < 90, "big").otherwise("small").alias("log"))
    kept = logs.retain_newest(rows, 20)
    counts = {r.log: (r["count"], r.low) for r in kept.groupBy("log").agg(F.count("*").alias("count"), F.min("seq").alias("low")).collect()}
    assert counts == {"big": (20, 70), "small": (10, 90)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_class_lists():
    assert FLOW_CLASSES == ["benign", "dos", "portscan", "bruteforce", "webattack", "botnet", "other"]


def test_type_suffixes_make_no_number(spark):
    rows = spark.createDataFrame([("5d",), ("5",), ("2.5F",), (" 1e3 ",), ("n/a",), (None,), ("NaN",)], "v string")
    got = [r.n for r in rows.select(datasets.to_number(F.col("v")).alias("n")).collect()]
    assert got[:6] == [None, 5.0, None, 1000.0, None, None] and got[6] != got[6]
