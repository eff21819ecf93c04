"""Loads and tables on disk that survive failures and repeats."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from spendlake.operators import cleaning, star
from spendlake.sources import files, versions
from spendlake.streaming import ingest


def bytes_below(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_star_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "gold")
    with pytest.raises(FileNotFoundError):
        files.load_star(spark, root)
    table = lambda n: {name: spark.range(n + k) for k, name in enumerate(files.STAR)}
    first = files.save_star(table(1), root)
    broken = table(10) | {"dim_supplier": spark.range(3).select((F.assert_true(F.col("id") < 0)).alias("x"))}
    with pytest.raises(Exception, match="(?i)assert|true|USER_RAISED"):
        files.save_star(broken, root)
    assert [files.load_star(spark, root)[n].count() for n in files.STAR] == [1, 2, 3, 4, 5]
    second = files.save_star(table(5), root)
    assert [files.load_star(spark, root)[n].count() for n in files.STAR] == [5, 6, 7, 8, 9]
    assert versions.current(spark, root) == {"folder": second} and os.path.isdir(f"{root}/{first}")
    third = files.save_star(table(2), root)
    assert sorted(n for n in os.listdir(root) if n.startswith("v-")) == sorted([second, third])  # the broken one and the first are gone
    log = spark.read.json(f"{root}/_build_log").collect()
    assert len(log) == 15 and {(r.version, r.table): r.n_rows for r in log}[(second, "fact_purchase")] == 9
    with pytest.raises(ValueError):
        files.save_star({"dim_item": spark.range(1)}, root)


def test_a_batch_killed_and_replayed_loads_each_file_once(spark, tmp_path, monkeypatch):
    source, target, manifest = tmp_path / "drop", str(tmp_path / "bronze"), str(tmp_path / "manifest")
    for day, body in (("2025-01-01", "a,1\nb,2\n"), ("2025-01-02", "c,3\n"), ("2025-01-04", "")):
        (source / "item" / f"dt={day}").mkdir(parents=True)
        (source / "item" / f"dt={day}" / "item.csv").write_text("k,v\n" + body)
    run = lambda: ingest.ingest_daily(spark, str(source), target, str(tmp_path / "cp"), "k string, v int", manifest)
    frame = type(spark.range(1))
    group = frame.groupBy

    def dies(self, *a):
        raise RuntimeError("killed after the rows were written")

    monkeypatch.setattr(frame, "groupBy", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(frame, "groupBy", group)
    assert spark.read.parquet(f"{target}/batch=0").count() == 3 and not os.path.exists(manifest)
    run()
    run()
    rows = ingest.loaded(spark, manifest).collect()
    assert sorted((r.length, r.n_rows, r.batch) for r in rows) == [(8, 1, 0), (12, 2, 0)]
    assert spark.read.parquet(target).count() == 3
    assert sorted(str(r.day) for r in ingest.gaps(spark, manifest, "2025-01-01", "2025-01-04").collect()) == ["2025-01-03", "2025-01-04"]
    assert [r.path for r in ingest.unloaded(spark, str(source), manifest).collect()] == ["item/dt=2025-01-04/item.csv"]
    (source / "item" / "dt=2025-01-03").mkdir()
    (source / "item" / "dt=2025-01-03" / "item.csv").write_text("k,v\nd,4\n")
    run()
    assert {r.batch for r in ingest.loaded(spark, manifest).collect()} == {0, 1} and spark.read.parquet(target).count() == 4


def test_latest_table_equals_one_pass_and_writes_as_much_as_it_gets(spark, tmp_path):
    target, batches = str(tmp_path / "latest"), []
    day = lambda k: datetime.date(2024, 1, 1 + k % 28)
    batches.append([(f"k{k}", day(k), k, "x" * 50) for k in range(20_000)])
    for b in range(6):
        batches.append([(f"k{(7 * k + b) % 25_000}" if k % 50 else None, day(k * (b + 3)), k * b, "y" * 50) for k in range(400)])
    batches.append([("k1", day(1), 1, "x" * 50), ("k1", day(1), 2, "z"), ("k5", day(0), 5, "old")])
    batches.append([("k5", day(5), 9, "same day as the newest, but the key has had two dates")])
    frames = [spark.createDataFrame(b, "k string, d date, v int, s string") for b in batches]
    written = []
    for number, df in enumerate(frames):
        before = versions.current(spark, target)
        for _ in range(2):  # each batch comes twice
            ingest.merge_latest(spark, df, number, target, ["k"], "d")
        compacted = versions.current(spark, target) != before
        written.append((compacted, bytes_below(f"{target}/delta/batch={number}")))
    base = bytes_below(f"{target}/{versions.current(spark, target)['base']}")
    assert written[0][0] and not any(c for c, _ in written[1:3]) and all(n < base / 4 for _, n in written[1:])
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df)
    want = cleaning.resolve_revisions(every.dropDuplicates(), ["k"], "d")
    key = lambda df: sorted(map(str, map(tuple, df.select("k", "d", "v", "s").collect())))
    assert key(ingest.read_latest(spark, target, ["k"], "d")) == key(want)
    ingest.merge_latest(spark, frames[1], 20, target, ["k"], "d", share=0.0)  # compaction of all
    assert key(ingest.read_latest(spark, target, ["k"], "d")) == key(want)
    ingest.merge_latest(spark, frames[2], 20, target, ["k"], "d")  # a batch that was compacted is not merged again
    assert key(ingest.read_latest(spark, target, ["k"], "d")) == key(want)


def test_manifest_of_a_conversion(spark, tmp_path):
    source, out, manifest = tmp_path / "in.csv", str(tmp_path / "out"), str(tmp_path / "manifest")
    convert = lambda: files.csv_to_parquet(spark, str(source), out, "id int, supplier string", 2025, manifest)
    with pytest.raises(FileNotFoundError):
        convert()
    source.write_text("id,supplier\n1,00123\n2,7\nbad,row,extra\n")
    assert convert().count() == 2 and convert().count() == 2
    rows = files.read_manifest(spark, manifest).orderBy("at").collect()
    assert [(r.status, r.length, r.n_rows) for r in rows] == [("not_found", None, None), ("success", 38, 2), ("skipped_existing", None, None)]


def test_files_in_storage_against_the_manifest(spark, tmp_path):
    for dataset, day, body in (("item", "2025-01-01", "a"), ("item", "2025-01-02", "bb"), ("header", "2025-01-01", "ccc")):
        (tmp_path / dataset / f"dt={day}").mkdir(parents=True)
        (tmp_path / dataset / f"dt={day}" / f"{dataset}.csv").write_text(body)
    here = files.stored_files(spark, str(tmp_path))
    assert sorted(map(tuple, here.collect())) == [("header/dt=2025-01-01/header.csv", "header", 3), ("item/dt=2025-01-01/item.csv", "item", 1), ("item/dt=2025-01-02/item.csv", "item", 2)]
    done = spark.createDataFrame([("item/dt=2025-01-01/item.csv", None, 1, "success"), ("item/dt=2025-01-02/item.csv", "item", 1, "success")], "path string, dataset string, length long, status string")
    assert sorted(r.path for r in files.to_load(here, done).collect()) == ["header/dt=2025-01-01/header.csv", "item/dt=2025-01-02/item.csv"]
    gaps = files.missing_days(here, "2025-01-01", "2025-01-03", ("item", "header")).collect()
    assert sorted((r.dataset, r.day.day) for r in gaps) == [("header", 2), ("header", 3), ("item", 3)]


def test_years_of_headers_and_legacy_columns(spark, tmp_path):
    root = str(tmp_path / "headers")
    row = lambda k, day, name: (k, day, name)
    names = star.BUYER
    for year, rows in ((2024, [row("k1", "2024-01-01", "old"), row("k2", "2024-02-01", "only")]), (2025, [row("k1", "2025-03-01", "new"), row("k1", "bad date", "undated")])):
        df = spark.createDataFrame(rows, "k string, data_publicacao_pncp string, n string")
        df.select(F.col("k").alias(names[0]), *(F.col("n").alias(c) for c in names[1:] if c != "data_publicacao_pncp"), "data_publicacao_pncp").write.parquet(f"{root}/ano={year}")
    got = {r[names[0]]: r[names[1]] for r in star.dim_buyer_of_years(spark, root, [2024, 2025]).collect()}
    assert got == {"k1": "new", "k2": "only"}
    counts = {r.year: r.n_rows for r in files.count_years(spark, root, [2023, 2024, 2025]).collect()}
    assert counts == {2023: None, 2024: 2, 2025: 2}
    assert {r.n_rows for r in files.count_years(spark, str(tmp_path / "nothing"), [2023]).collect()} == {None}
    legacy = spark.createDataFrame([(1, 2)], "old int, kept int")
    assert files.rename_legacy(legacy, {"old": "new", "kept": "old", "gone": "x"}).columns == ["new", "kept"]
    assert files.keep_present(legacy, ["kept", "absent"]).columns == ["kept"]


def test_results_are_loaded_all_or_none(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5)], "id string, x double")
    paths = {kind: str(tmp_path / f"r.{kind}") for kind in ("csv", "json", "parquet")}
    for kind, path in paths.items():
        files.save_artifact(df, path, kind)
    out = files.load_artifacts(spark, paths, {"csv": "id string, x double"})
    assert all([tuple(r) for r in t.select("id", "x").collect()] == [("007", 1.5)] for t in out.values())
    with pytest.raises(FileNotFoundError):
        files.load_artifacts(spark, paths | {"gone": str(tmp_path / "gone.csv")})
    first = files.reuse(df, str(tmp_path / "cache"))
    assert first.count() == 1 and files.reuse(df.unionByName(df), str(tmp_path / "cache")).count() == 1


def test_dates_to_keys_and_back(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 29), 20240229), (None, 20240230), (None, None)], "d date, k int")
    got = df.select(cleaning.date_key("d").alias("k"), cleaning.day_of_key(F.col("k")).alias("d")).collect()
    assert [(r.k, r.d) for r in got] == [(20240229, datetime.date(2024, 2, 29)), (None, None), (None, None)]


def test_late_rows_of_a_stream(spark, tmp_path):
    source = tmp_path / "events"
    batches = [["2024-01-01 00:10:00,a,1", "2024-01-01 05:00:00,a,2"], ["2024-01-01 00:20:00,a,100", "2024-01-01 04:30:00,a,3", "2024-01-01 09:00:00,b,1"], ["2024-01-01 12:00:00,b,1"]]
    source.mkdir()
    stream = ingest.hourly_counts(spark.readStream.schema("ts timestamp, event_type string, value double").csv(str(source)))
    for k, lines in enumerate(batches):
        (source / f"{k}.csv").write_text("\n".join(lines))
        stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = {(r.window.start.hour, r.event_type): (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out[(0, "a")] == (1, 1.0) and out[(4, "a")] == (1, 3.0) and out[(5, "a")] == (1, 2.0)  # the row of 0:20 came too late
