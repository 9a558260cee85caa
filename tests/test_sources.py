import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.catalog import decoded_flags
from tessera.sources import catalogs, records, text_lines
from tessera.streaming import queue


def poses(spark, n, start=1):
    rows = [(i, 1.0 * i, 2.0, None, 4.0, 5.0, "é" * 40, "2019-06", None, "gen4", bytes([i % 256]) * 96) for i in range(start, start + n)]
    return spark.createDataFrame(rows, records.POSE_SCHEMA + ", embedding binary")


def test_segments_round_trip_and_fail_closed(spark, tmp_path):
    root = str(tmp_path / "index")
    records.publish_segments(poses(spark, 25), root, "scene", 96, capacity=10)
    records.publish_segments(poses(spark, 5, 100), root, "object", 96)
    read = lambda **o: spark.read.format("sealed_segments").options(path=root, rowsPerPartition="4", **o).load()
    rows = read(lane="scene").collect()
    assert sorted(r.location_id for r in rows) == list(range(1, 26)) and {bytes(r.embedding)[:1] for r in rows if r.location_id == 7} == {b"\x07"}
    assert rows[0].pano_id == "é" * 32 and rows[0].heading == 0 and rows[0].country == "" and len({r.segment_id for r in rows}) >= 3
    assert read().count() == 30
    with pytest.raises(ValueError, match="already published"):
        records.publish_segments(poses(spark, 3, 24), root, "scene", 96)
    with pytest.raises(ValueError, match="repeated"):
        records.publish_segments(poses(spark, 2, 500).union(poses(spark, 1, 500)), root, "scene", 96)
    victim = next((tmp_path / "index").glob("scene-*/embeddings.bin"))
    victim.write_bytes(b"x" + victim.read_bytes()[1:])
    with pytest.raises(Exception, match="checksum"):
        read().count()


def test_flat_shards(spark, tmp_path):
    records.register(spark)
    rows = [r.asDict() for r in poses(spark, 9).collect()]
    placed = poses(spark, 12).withColumn("row_index", F.col("location_id") - 1)
    files = {r.file: r.rows for r in records.write_flat_shards(placed, str(tmp_path / "flat"), 96, capacity=9).collect()}
    assert files == {"shard-000000.bin": 9, "shard-000001.bin": 3}
    data = (tmp_path / "flat" / "shard-000000.bin").read_bytes()
    path = tmp_path / "shard.bin"
    path.write_bytes(data + b"trailing")
    load = lambda: spark.read.format("flat_shard").options(path=str(path), rowsPerPartition="2").load()
    assert sorted((r.location_id, bytes(r.embedding)) for r in load().collect()) == [(r["location_id"], bytes(r["embedding"])) for r in rows]
    path.write_bytes(data[:-1])
    with pytest.raises(Exception, match="cut off"):
        load().count()


def test_four_views_and_their_differences(spark, tmp_path):
    records.register(spark)
    raw = np.random.default_rng(0).integers(0, 255, (6, 4, 770), dtype=np.uint8)
    raw[:, :, :2] = np.frombuffer(np.float16(0.5).tobytes(), np.uint8)
    other = raw.copy()
    other[1, 0, 0] ^= 1
    other[1, 2, 100] ^= 1
    other[4, 3, 769] ^= 1
    bad = raw.copy()
    bad[2, 1, :2] = np.frombuffer(np.float16(-1).tobytes(), np.uint8)
    frames = []
    for name, data in (("a", raw), ("b", other), ("c", bad)):
        (tmp_path / name).write_bytes(data.tobytes())
        frames.append(spark.read.format("four_view").options(path=str(tmp_path / name), rowsPerPartition="2").load())
    assert records.byte_difference(frames[0], frames[1]).first().asDict() == {"locations": 2, "views": 3, "scales": 1, "bytes": 3}
    assert [r.valid for r in frames[2].orderBy("row_index").collect()] == [True, True, False, True, True, True]
    assert frames[0].first().scales == [0.5] * 4


def test_arrow_catalog_with_side_file(spark, tmp_path):
    records.register(spark)
    table = pa.table({"id": [5, 6, 7], "lat": [1.0, 2, 3], "lng": [1.0, 2, 3], "heading": [0.0] * 3, "pitch": [0.0] * 3, "zoom": [0.0] * 3, "pano_id": ["a", " ", "c"], "tags": pa.array([[1], None, [2, 3]], pa.list_(pa.int64()))})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    (tmp_path / "m.bin").write_bytes(bytes([4, 0, 13]))
    rows = spark.read.format("arrow_catalog").options(path=str(tmp_path / "t.arrow"), metadata=str(tmp_path / "m.bin")).load()
    rows = records.street_rows(rows)
    got = rows.select("id", decoded_flags(F.col("flags")).alias("f"), "tags").orderBy("id").collect()
    assert [(r.id, r.f.camera_generation, r.f.road_name_state) for r in got] == [(5, "gen4", "no road name"), (7, "trekker", "has road name")]
    (tmp_path / "m.bin").write_bytes(b"\0")
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("arrow_catalog").options(path=str(tmp_path / "t.arrow"), metadata=str(tmp_path / "m.bin")).load().count()


def test_text_lines(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("pano_id\tlat\tlng\tcapture_year\tcapture_month\np1\t1.5\t2.5\t2019\t6\n\t1\t1\t\t\np2\tbad\t2\t\t\n")
    got = text_lines.read_any(spark, str(tmp_path / "h.tsv"), "scene", "m").orderBy("asset_id").collect()
    assert [(r.asset_id, r.capture, r.lat, r.heading) for r in got] == [("p1", "2019-06", 1.5, 0.0), ("p2", "unknown", 0.0, 0.0)]
    line = "m\t7\t1.5\t2\t3\t4\t5\tpano\tFrance\tgen4\tno road name"
    (tmp_path / "l.tsv").write_text(f"\n{line}\n")
    assert [(r.asset_id, r.lat, r.camera_generation) for r in text_lines.read_any(spark, str(tmp_path / "l.tsv"), "scene", "m").collect()] == [("pano", 1.5, "gen4")]
    rows = text_lines.strict_lines(spark.read.text(str(tmp_path / "l.tsv")))
    assert [r.value for r in text_lines.as_lines(rows).collect()] == [line]
    with pytest.raises(Exception, match="columns"):
        text_lines.strict_lines(spark.createDataFrame([("a\tb",)], "value string")).collect()
    with pytest.raises(Exception, match="control character"):
        text_lines.as_lines(rows.withColumn("country", F.lit("a\nb"))).collect()
    assert text_lines.normal_lines(spark.createDataFrame([("m\t\t1\t2\t3\t4\t5\tp\tc",), ("x",)], "value string")).first().location_id == "m"


def test_json_catalogs_and_maps(spark, tmp_path):
    doc = {"source": "s", "locations": [{"panoId": "pano1", "lat": 1, "lng": 0, "lon": 9, "lane": "scene"}, {"panoId": "pano1", "lat": 5, "lane": "scene"}, {"assetId": "pano2", "capture": "2020", "lane": "object"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    got = {r.asset_id: (r.capture, r.lat, r.lon) for r in catalogs.read_catalog(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"pano1": ("unknown", 1.0, 9.0), "pano2": ("2020", 0.0, 0.0)}
    (tmp_path / "many").mkdir()
    for name, lat in (("b", 7), ("a", 8), ("c", 9)):
        (tmp_path / "many" / f"{name}.json").write_text(json.dumps({"locations": [{"panoId": "other", "lat": 0}] * (3 if name == "a" else 0) + [{"panoId": "pano1", "lat": lat}]}))
    assert {r.asset_id: r.lat for r in catalogs.read_catalog(spark, str(tmp_path / "many")).collect()} == {"pano1": 8.0, "other": 0.0}
    for broken, why in (({"persistImagery": True, "locations": []}, None), ({"locations": [{"panoId": "abc"}]}, "invalid_pano_id"), ({"locations": [{"panoId": "http://x"}]}, "imagery_url"), ({"locations": [{"panoId": "okay", "jpeg": "x"}]}, "imagery_payload")):
        (tmp_path / "c.json").write_text(json.dumps(broken))
        if why:
            with pytest.raises(Exception, match=why):
                catalogs.read_catalog(spark, str(tmp_path / "c.json")).collect()
    docs = [json.dumps({"customCoordinates": [{"lat": 1, "lng": 2, "panoId": "a"}, {"lat": "x", "lng": 2}]}), json.dumps([{"lat": 3, "lon": 4, "pano": "b"}]), json.dumps({"coordinates": []})]
    maps = spark.createDataFrame([(d,) for d in docs], "value string")
    assert sorted((r.pano_id or "", r.lat, r.lon) for r in catalogs.excluded_from_maps(maps).collect()) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]
    exports = [json.dumps([{"results": [{"a": 1}, {"a": 2}]}]), json.dumps({"results": [{"a": 3}]}), json.dumps([{"a": 4}])]
    rows = catalogs.export_rows(spark.createDataFrame([(e,) for e in exports], "value string")).collect()
    assert sorted(json.loads(r.row)["a"] for r in rows) == [1, 2, 3, 4]


def test_streamed_credit_counts_repeats_once(spark, tmp_path):
    events = spark.sql("SELECT id event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) ts, id % 3 user_id, 'purchase' event_type, 1.0D value, '' props FROM range(50)")
    events.union(events).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = queue.drained(queue.credited_once(queue.event_stream(spark, f"{tmp_path}/events*.parquet")), "t")
    assert out.count() == 50


def test_streamed_leases(spark, tmp_path):
    steps = [(1, 0, "view"), (1, 10, "view"), (1, 20, "purchase"), (1, 30, "purchase"), (2, 0, "view"), (2, 4000, "signup"), (3, 0, "view"), (3, 5, "error"), (3, 9, "view"), (4, 0, "purchase"), (5, 0, "view"), (5, 2000, "purchase")]
    rows = spark.createDataFrame([(i, u, s, k) for i, (u, s, k) in enumerate(steps)], "event_id long, user_id long, s long, event_type string")
    rows = rows.selectExpr("event_id", "timestamp_seconds(1704067200 + s) ts", "user_id", "event_type", "0.0D value", "'' props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = queue.drained(queue.lease_states(queue.event_stream(spark, f"{tmp_path}/events*.parquet")), "t", "update")
    assert {r.user_id: (r.state, r.generation, r.units) for r in out.collect()} == {1: ("submitted", 1, 1), 2: ("active", 1, 0), 3: ("active", 2, 0), 4: ("none", 0, 0), 5: ("expired", 1, 0)}


def test_artifacts_and_files(spark, tmp_path):
    from tessera.functions.checks import model_identity
    from tessera.operators import exports

    store = exports.Artifacts(str(tmp_path / "store"))
    store.put("a/b.bin", b"xyz", "text/plain")
    assert store.get("a/b.bin") == b"xyz" and store.exists("a/b.bin") and not store.exists("a/c.bin")
    assert json.loads(store.get("a/b.bin.meta.json")) == {"contentType": "text/plain", "bytes": 3}
    for key in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(ValueError, match="invalid key"):
            store.put(key, b"")
    files = spark.createDataFrame([("x.bin", b"1"), ("sub/y.bin", b"")], "name string, content binary")
    assert sorted((r.name, r.bytes) for r in exports.write_files(files, str(tmp_path / "out")).collect()) == [("sub/y.bin", 0), ("x.bin", 1)]
    with pytest.raises(Exception, match="unsafe name"):
        exports.write_files(spark.createDataFrame([("../z", b"")], files.schema), str(tmp_path / "out"))
    assert model_identity({"b": 1, "a": [2]})["sha256"] == model_identity({"a": [2], "b": 1})["sha256"] != model_identity({"a": 2})["sha256"]


def test_four_view_shards(spark, tmp_path):
    from tessera.operators import exports

    one = b"\x00\x38" + bytes(768)
    rows = spark.createDataFrame([(i, (one * 3) + (b"\x00\x80" if i == 4 else b"\x00\x38") + bytes([i]) * 768) for i in range(7)], "row_index long, record binary")
    path = str(tmp_path / "views")
    assert sorted(map(tuple, exports.write_four_view_shards(rows, path, 3).collect())) == [(0, 3), (1, 3), (2, 1)]
    assert {r.row_index: bytes(r.record)[-1] for r in exports.records_at(spark.createDataFrame([(6,), (0,), (4,)], "row_index long"), path, 3).collect()} == {6: 6, 0: 0, 4: 4}
    assert [tuple(r) for r in exports.mask_problems(spark, path).collect()] == [(1, "incomplete")]
    (tmp_path / "views" / "shard-000002.mask").unlink()
    assert sorted(map(tuple, exports.mask_problems(spark, path).collect())) == [(1, "incomplete"), (2, "missing")]
    with pytest.raises(Exception, match="no such record|No such file|shard-"):
        exports.records_at(spark.createDataFrame([(99,)], "row_index long"), path, 3).collect()


def test_ranges_beyond_the_tasks_share_them():
    from tessera.sources import byte_lines

    ranges = [byte_lines.ByteRange("s", i, i + 1) for i in range(10)]
    assert [len(t.parts) for t in byte_lines.dealt(ranges, 4)] == [3, 3, 3, 1]
    assert [len(t.parts) for t in byte_lines.dealt(ranges[:3], 4)] == [1, 1, 1] and not byte_lines.dealt([], 4)
