"""Readers, sinks, logs and streams on small files."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from hearthline import config, schemas
from hearthline.operators import cleaning, keys, logs, quality
from hearthline.operators.requests import request_table
from hearthline.sources import jsonl, tables
from hearthline.streaming import ingest


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def house(i, **extra):
    base = {"house_id": f"h{i}", "region_slug": "r", "total_price_wan": 100 + i, "area_sqm": 80.5, "room_count": 3, "hall_count": 2, "bath_count": 1, "community_id": "c1", "has_elevator": True, "extracted_at": f"2026-01-{i + 1:02d}T10:00:00", "floor_level": "高层", "house_certificate_years": "满二"}
    return {**base, **extra}


def test_strict_and_tolerant_reads(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", [house(0), "", "   ", house(1, total_price_wan="面议")])
    assert jsonl.read_listings(spark, good).count() == 2
    bad = write(tmp_path / "bad.jsonl", [house(0), "[{\"house_id\": \"x\"}]", "{\"house_id\": ", "plain"])
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_listings(spark, bad).count()
    records, broken = jsonl.read_tolerant(spark, bad, schemas.LISTING_DDL)
    assert records.count() == 1 and broken.count() == 3
    with pytest.raises(jsonl.BadRecords):
        jsonl.read_listings(spark, write(tmp_path / "empty.jsonl", [""]))


def community(i, **poi):
    return {"community_id": f"c{i}", "poi_summary": poi, "poi_details": {"bank": [{"type": "bank", "name": "n", "distance": "5米"}]}, "extracted_at": "2026-01-01T00:00:00"}


def test_communities_and_region_files(spark, tmp_path):
    write(tmp_path / "a" / "east_communities.jsonl", [community(1, bank=2, bus="3", subway="x"), community(2)])
    write(tmp_path / "b" / "west_communities.jsonl", [community(3, school=4)])
    rows = {r["community_id"]: r for r in jsonl.read_region_communities(spark, f"{tmp_path}/*/*_communities.jsonl").collect()}
    assert {k: r["region_slug"] for k, r in rows.items()} == {"c1": "east", "c2": "east", "c3": "west"}
    assert (rows["c1"]["poi_bank_count"], rows["c1"]["poi_bus_count"], rows["c1"]["poi_subway_count"], rows["c3"]["poi_school_count"]) == (2.0, 3.0, 0.0, 4.0)
    raw = jsonl.read_strict(spark, f"{tmp_path}/a/*.jsonl", schemas.COMMUNITY_DDL)
    assert jsonl.explode_facilities(raw).count() == 2


def test_nested_records(spark, tmp_path):
    crawl = write(tmp_path / "c.jsonl", [{"region": "r", "list_page_no": 1, "prop_url": "u", "house": house(1, community_id=None), "community_ref": {"community_id": "c9", "status": "linked_new_fetch"}}])
    row = jsonl.flatten_crawl(jsonl.read_strict(spark, crawl, schemas.CRAWL_DDL)).first()
    assert (row["house_id"], row["community_id"], row["link_status"]) == ("h1", "c9", "linked_new_fetch")
    side = write(tmp_path / "s.jsonl", [{"community_id": "c1", "community": {"community_name": "n"}, "poi": {"summary": {"bank": 4}}}])
    assert jsonl.flatten_sidecar(jsonl.read_strict(spark, side, schemas.SIDECAR_DDL)).first()["poi_bank_count"] == 4.0
    index = write(tmp_path / "i.jsonl", [{"region": "r", "total": 2, "links": [{"house_id": "a", "url": "u"}, {"house_id": "b", "url": "v"}]}])
    assert jsonl.explode_links(jsonl.read_strict(spark, index, schemas.LINK_INDEX_DDL)).count() == 2
    done = write(tmp_path / "p.jsonl", [{"region": "r", "processed_houses": ["a"], "processed_communities": ["x", "y"]}])
    assert jsonl.explode_progress(jsonl.read_strict(spark, done, schemas.PROGRESS_DDL)).count() == 3


def test_csv_contracts(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("﻿house_id,subway,extra\nh1,1,z\nh2,,z\n", encoding="utf-8")
    rows = tables.read_labels(spark, str(path), ["house_id", "subway"]).orderBy("house_id").collect()
    assert [tuple(r) for r in rows] == [("h1", 1), ("h2", None)]
    with pytest.raises(tables.MissingColumns):
        tables.read_labels(spark, str(path), ["house_id", "garage"])
    for seed in (7, 21):
        target = tmp_path / "runs" / f"run_seed{seed}" / "model_metrics.csv"
        target.parent.mkdir(parents=True)
        target.write_text(f"model_name,mae,rmse,r2,mape,cv_mae_mean,cv_mae_std\nm,{seed}.5,1,0.1,0.2,3,4\n")
    got = tables.read_run_metrics(spark, f"{tmp_path}/runs/*/model_metrics.csv").select("seed", "mae").collect()
    assert sorted(map(tuple, got)) == [(7, 7.5), (21, 21.5)]


def test_sinks(spark, tmp_path):
    df = spark.range(12).select(F.col("id").cast("string").alias("house_id"), F.lit("t").alias("title"))
    made = request_table(df, "house_id", "title", {"p": ("s", 'T: "{title}"')}, (0.0, 0.5), "m", 10)
    tables.write_requests(made, str(tmp_path / "req"))
    assert spark.read.text(str(tmp_path / "req")).count() == 24
    doc = json.loads(made.orderBy("config", "custom_id").first()["request"])
    assert doc["custom_id"] == "0" and doc["body"]["messages"][1] == {"role": "user", "content": 'T: "t"'} and doc["body"]["temperature"] == 0.0
    tables.write_jsonl(df.coalesce(1), str(tmp_path / "out"), rows_per_file=5)
    assert len(list((tmp_path / "out").glob("part-*.json"))) == 3
    tables.write_jsonl(df.limit(1), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 13
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "house_id string, title string").count() == 12


def test_clean_and_features(spark, tmp_path):
    rows = [house(i) for i in range(20)]
    rows += [house(3, extracted_at="2025-12-01T00:00:00", total_price_wan=999), house(30, total_price_wan=None), house(31, area_sqm="x"), house(32, community_id=None, bath_count=None), house(33, community_id=None)]
    listings = jsonl.read_listings(spark, write(tmp_path / "h.jsonl", rows))
    communities = jsonl.flatten_communities(jsonl.read_strict(spark, write(tmp_path / "c.jsonl", [community(1, bank=1), community(1, bank=9), {"community_id": None, "poi_summary": {"bus": 5}}]), schemas.COMMUNITY_DDL))
    cleaned = cleaning.clean_listings(listings, communities)
    ids = {r["house_id"]: r for r in cleaned.collect()}
    assert "h30" not in ids and "h31" not in ids and "h32" not in ids
    assert "h3" not in ids, "the earliest record of h3 wins and is an outlier"
    assert ids["h33"]["poi_bus_count"] == 5.0 and ids["h33"]["has_community"], "a null key meets the null-key community"
    features = cleaning.build_features(cleaned)
    assert features.columns == list(config.FEATURE_COLUMNS) and features.count() == len(ids)
    row = features.filter("house_id = 'h5'").first()
    assert (row["house_layout"], row["has_elevator"], row["orientation"], row["house_certificate_years"]) == ("3室2厅1卫", "True", "unknown", 2.0)
    assert row["area_per_room"] == pytest.approx(80.5 / 3)


def test_reference_medians_of_unseen_groups(spark):
    df = spark.createDataFrame([("a", "x", 10.0, 2.0), ("a", "x", 30.0, 4.0), ("zz", "yy", 50.0, 6.0)], "house_layout string, region_slug string, area_sqm double, accessibility_index double")
    out = cleaning.apply_reference_medians(df, df.filter("house_layout = 'a'"), spark.createDataFrame([("x", 4.0), ("w", 8.0)], "region_slug string, region_median double"))
    row = out.filter("house_layout = 'zz'").first()
    assert row["area_layout_efficiency"] == pytest.approx(50 / 20) and row["region_accessibility_interaction"] == pytest.approx(6 / 6)


def test_reference_medians_are_sought_at_the_same_time(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x", 10.0, 2.0), ("a", "x", 30.0, 4.0), ("b", "y", 50.0, 6.0)], "house_layout string, region_slug string, area_sqm double, accessibility_index double")
    together, medians = threading.Barrier(2), cleaning.group_medians

    def met(*args):
        together.wait(60)
        return medians(*args)

    monkeypatch.setattr(cleaning, "group_medians", met)
    got = {r["area_sqm"]: (r["area_layout_efficiency"], r["region_accessibility_interaction"]) for r in cleaning.apply_reference_medians(df, df.filter("house_layout = 'a'")).collect()}
    assert got == {10.0: pytest.approx((0.5, 2 / 3)), 30.0: pytest.approx((1.5, 4 / 3)), 50.0: pytest.approx((2.5, 2.0))}


def test_group_mean_chain_falls_through(spark):
    train = spark.createDataFrame([("c1", "r1", 10.0), ("c2", "r1", 20.0), (None, "r2", 60.0)], "c string, r string, y double")
    test = spark.createDataFrame([(1, "c1", "r1"), (2, "c9", "r1"), (3, None, "r2"), (4, "c9", "r9")], "i int, c string, r string")
    got = {r["i"]: (r["prediction"], r["fallback_level"]) for r in keys.group_mean_baseline(train, test, ["c", "r"], "y").collect()}
    assert got == {1: (10.0, 0), 2: (15.0, 1), 3: (60.0, 1), 4: (30.0, 2)}


def failure(i, at, **extra):
    return {"record_type": "failure", "failure_id": f"f{i}", "target_type": "prop", "target_url": f"u{i}", "failed_at": at, "error_message": "e", "retry_count": 0, **extra}


def update(i, at, ok):
    return {"record_type": "retry_update", "failure_id": f"f{i}", "retried_at": at, "success": ok, "resolved": ok, "retry_count": 1}


LOG = [
    failure(1, "2026-01-01T00:00:00Z"), update(1, "2026-01-02T00:00:00Z", False), update(1, "2026-01-03T00:00:00Z", True),
    failure(2, "2026-01-01T01:00:00Z"), update(2, "2026-01-02T00:00:00Z", False), failure(3, "2026-01-01T02:00:00Z", target_type="community"),
    {"record_type": "failure", "target_url": "legacy", "error_message": "old"}, update(9, "2026-01-01T00:00:00Z", False),
]


def test_open_failures(spark, tmp_path):
    log = jsonl.read_strict(spark, write(tmp_path / "f.jsonl", LOG), schemas.FAILURE_DDL)
    assert {(r["target_url"], r["retry_count"]) for r in logs.open_failures(log, "prop").collect()} == {("u2", 1), ("legacy", 0)}
    assert logs.open_failures(log, limit=1).first()["target_url"] == "legacy"
    row = logs.retry_accounting(log).first()
    assert (row["total"], row["success"], row["failed"], row["distinct_targets"], row["recovered_targets"]) == (4, 1, 3, 3, 1)
    assert logs.last_failed_url(log, "u").first()["target_url"] == "u3"


def test_link_status(spark):
    rows = [(1, "a", True, "c1", False), (2, "b", True, "c1", True), (3, "c", True, "c1", True), (4, "d", True, None, True), (5, "e", False, "c1", True), (6, "f", True, "c2", False)]
    df = spark.createDataFrame(rows, "list_page_no int, prop_url string, is_valid boolean, community_id string, ok boolean")
    got = {r["prop_url"]: r["link_status"] for r in logs.link_status(df, F.col("ok")).collect()}
    assert got == {"a": "community_failed", "b": "linked_new_fetch", "c": "linked_from_cache", "d": "missing", "e": "prop_failed", "f": "community_failed"}


FACILITY_PAGE = """<ul><li title="工商银行"><a>工商银行</a> 300 米 ATM</li><li><a>工商银行</a> 300米</li><li>银行</li>
<li data-address="115.8,28.6">红谷滩中学 学校 1.2公里</li><li>nothing here</li></ul> 公交 公交"""


def test_facilities(spark):
    pages = spark.createDataFrame([("c1", FACILITY_PAGE)], "community_id string, html string")
    rows = quality.facility_rows(pages)
    distinct = {(r["type"], r["name"], r["distance"], r["coordinate"]) for r in quality.distinct_facilities(rows).collect()}
    assert distinct == {("bank", "工商银行", "300米", None), ("school", "红谷滩中学", "1.2公里", None)}
    counts = quality.page_facility_counts(pages).first()
    assert (counts["poi_bank_count"], counts["poi_school_count"], counts["poi_bus_count"], counts["poi_shop_count"]) == (1, 1, 2, 0)


def run_stream(query):
    query.awaitTermination()


def test_incremental_ingest_restart_adds_nothing(spark, tmp_path):
    source, target, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    write(source / "1.jsonl", [house(i) for i in range(5)])
    stream = lambda: ingest.record_stream(spark, str(source), schemas.LISTING_DDL)
    run_stream(ingest.land(stream(), target, progress))
    run_stream(ingest.land(stream(), target, progress))
    assert spark.read.parquet(target).count() == 5
    first, first_progress = str(tmp_path / "first"), str(tmp_path / "first_progress")
    run_stream(ingest.land_first_seen(stream(), first, first_progress, "house_id"))
    write(source / "2.jsonl", [house(4, total_price_wan=1), house(7), house(7, extracted_at="2026-03-01T00:00:00")])
    run_stream(ingest.land_first_seen(stream(), first, first_progress, "house_id"))
    run_stream(ingest.land_first_seen(stream(), first, first_progress, "house_id"))
    got = {r["house_id"]: r["total_price_wan"] for r in spark.read.parquet(first).collect()}
    assert len(got) == 6 and spark.read.parquet(first).count() == 6 and got["h4"] == "104"


def test_stream_keeps_null_columns_and_quarantines_broken_lines(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path)
    write(source / "1.jsonl", [{"title": "no id"}, house(1), {"house_id": None, "title": "null id"}])
    with open(source / "2.jsonl", "w") as f:
        f.write('{"house_id": "h9", "ti\n\n[1]\n{"house_id": "h5"}\n')
    for _ in range(2):
        run_stream(ingest.land_records(ingest.line_stream(spark, str(source), schemas.LISTING_DDL, 1), f"{out}/good", f"{out}/bad", f"{out}/progress"))
    assert spark.read.parquet(f"{out}/good").count() == 4 and spark.read.parquet(f"{out}/bad").count() == 2
    for _ in range(2):
        run_stream(ingest.land_first_seen(ingest.record_stream(spark, str(source), schemas.LISTING_DDL, 1), f"{out}/first", f"{out}/first_progress", "house_id"))
    assert sorted(str(r["house_id"]) for r in spark.read.parquet(f"{out}/first").collect()) == ["None", "h1", "h5"]
    write(source / "3.jsonl", [{"title": "late"}])
    run_stream(ingest.land_first_seen(ingest.record_stream(spark, str(source), schemas.LISTING_DDL, 1), f"{out}/first", f"{out}/first_progress", "house_id"))
    assert spark.read.parquet(f"{out}/first").count() == 3
    assert [(r["line"], r["value"][:3]) for r in jsonl.line_number(spark, str(source), schemas.LISTING_DDL).orderBy("line").collect()] == [(1, '{"h'), (3, "[1]")]


def test_failures_without_id_open_in_the_stream_too(spark, tmp_path):
    source = tmp_path / "log"
    write(source / "1.jsonl", [{"record_type": "failure", "target_url": "u1", "failed_at": "2026-01-01T00:00:00"}, {"record_type": "failure", "failure_id": "f", "target_url": "u2", "failed_at": "2026-01-01T00:00:00"}])
    args = (str(tmp_path / "log_out"), str(tmp_path / "open_out"), str(tmp_path / "progress"))
    run_stream(ingest.fold_failures(ingest.record_stream(spark, str(source), schemas.FAILURE_DDL), *args))
    batch = logs.open_failures(jsonl.read_strict(spark, str(source), schemas.FAILURE_DDL))
    assert {r["failure_id"] for r in ingest.current_open_failures(spark, args[1]).collect()} == {r["failure_id"] for r in batch.collect()} and batch.count() == 2


def test_streamed_failures_equal_the_batch_fold(spark, tmp_path):
    source = tmp_path / "log"
    write(source / "1.jsonl", [x for x in LOG[:2]])
    args = (str(tmp_path / "log_out"), str(tmp_path / "open_out"), str(tmp_path / "progress"))
    run_stream(ingest.fold_failures(ingest.record_stream(spark, str(source), schemas.FAILURE_DDL), *args))
    assert {r["failure_id"] for r in ingest.current_open_failures(spark, args[1]).collect()} == {"f1"}
    write(source / "2.jsonl", [LOG[2], LOG[3], LOG[4], LOG[5]])
    run_stream(ingest.fold_failures(ingest.record_stream(spark, str(source), schemas.FAILURE_DDL), *args))
    batch = logs.open_failures(jsonl.read_strict(spark, str(source), schemas.FAILURE_DDL))
    live = ingest.current_open_failures(spark, args[1])
    assert {(r["failure_id"], r["retry_count"]) for r in live.collect()} == {(r["failure_id"], r["retry_count"]) for r in batch.collect()} == {("f2", 1), ("f3", 0)}


def test_readers_of_open_failures_scan_a_snapshot_and_few_deltas(spark, tmp_path):
    """Nine batches of one file each: failures open and close; the folders that a reader lists, before pruning, stay few."""
    source = tmp_path / "log"
    args = (str(tmp_path / "log_out"), str(tmp_path / "open_out"), str(tmp_path / "progress"), 2)
    files = []
    for k in range(9):
        events = [{"record_type": "failure", "failure_id": f"f{k}", "target_url": f"u{k}", "failed_at": f"2026-01-0{k + 1}T00:00:00"}]
        if k % 2:
            events.append({"record_type": "retry_update", "failure_id": f"f{k - 1}", "retried_at": f"2026-01-0{k + 1}T01:00:00", "resolved": True, "success": True})
        write(source / f"{k}.jsonl", events)
        run_stream(ingest.fold_failures(ingest.record_stream(spark, str(source), schemas.FAILURE_DDL), *args))
        live = ingest.current_open_failures(spark, args[1])
        batch = logs.open_failures(jsonl.read_strict(spark, str(source), schemas.FAILURE_DDL))
        assert {r["failure_id"] for r in live.collect()} == {r["failure_id"] for r in batch.collect()}
        folders = {f.rsplit("/", 2)[1] for f in live.inputFiles()}
        files.append(len(folders))
    assert max(files) <= 4 and ingest._whole_folders(spark, f"{args[1]}/snapshots", "upto") == [5, 7]
    assert min(ingest._whole_folders(spark, f"{args[1]}/deltas", "batch_id")) == 6


def test_running_counters_and_bounded_dedupe(spark, tmp_path):
    source = tmp_path / "events"
    events = [{"event_at": f"2026-01-01T00:0{i}:00Z", "run_id": "r1", "region": "a", "phase": "p", "metrics": {"houses": {"total": i, "success": i - 1, "failed": 1}}} for i in range(1, 5)]
    write(source / "1.jsonl", events)
    stream = ingest.record_stream(spark, str(source), schemas.RUN_EVENT_DDL)
    query = logs.latest_counters(stream).writeStream.outputMode("complete").format("memory").queryName("counters").trigger(availableNow=True).start()
    run_stream(query)
    row = spark.table("counters").first()
    assert (row["metric"], row["total"], row["success"], row["failed"]) == ("houses", 4, 3, 1)
    again = ingest.deduplicate_within(ingest.record_stream(spark, str(source), schemas.RUN_EVENT_DDL), "run_id", "event_at")
    query = again.writeStream.outputMode("append").format("memory").queryName("firsts").trigger(availableNow=True).start()
    run_stream(query)
    assert spark.table("firsts").count() == 1
