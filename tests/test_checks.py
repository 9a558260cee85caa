"""Folding, canonical JSON, file tails, import flags and the recomputing audit on small and odd inputs."""

import json
import math

from pyspark.sql import functions as F

from tessera.functions import canonical, features
from tessera.functions.text import folded
from tessera.functions.vectors import output_digest
from tessera.operators import audit, manifests, spatial
from tessera.sources import byte_lines


def test_folding_is_that_of_unicode(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).casefold() != chr(i)]
    texts = ["ς", "ﬁ x", "ŉ", "Straße", "  A\x85b ", "", None, "İ", "".join(every)]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", folded(F.col("t"))).orderBy("i").collect()]
    assert got == [" ".join((t or "").casefold().split()) for t in texts]
    assert got[:4] == ["σ", "fi x", "ʼn", "strasse"]


def test_nested_keys_are_sorted(spark):
    value = {"b": 1, "a": [{"z": None, "Y": {"k": 2.5, "c": "é\"\n"}}, None], "m": {"y": {"q": 1, "p": 2}, "x": None}, "C": None}
    kind = "struct<b: int, a: array<struct<z: int, Y: struct<k: double, c: string>>>, m: map<string, struct<q: int, p: int>>, C: string>"
    df = spark.createDataFrame([(1, json.dumps(value)), (2, None)], "i int, t string").select("i", F.from_json("t", kind).alias("v"))
    got = [r.j for r in df.select("i", canonical.canonical_json(df, "v").alias("j")).orderBy("i").collect()]
    assert got == [json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None]


def test_a_tail_reads_no_more_than_it_needs(spark, tmp_path):
    path = tmp_path / "f.tsv"
    lines = [f"{k}" * (k % 5 + 1) for k in range(20_000)]
    path.write_text("\n".join(lines) + "\nnot ended")
    text = path.read_text()
    for tail, skip in ((10, 0), (10, 3), (10, 10), (3, 9), (0, 0), (10**6, 5), (20_000, 0)):
        start, stop, read = byte_lines.tail_range(str(path), tail, skip, block=1000)
        whole = lines[max(0, len(lines) - tail) : max(0, len(lines) - skip)] if tail > skip else []
        assert text[start:stop] == "".join(f"{x}\n" for x in whole)
        assert read <= sum(len(x) + 1 for x in lines[-max(tail, 1) :]) + 9 + 2 * 1000
    (tmp_path / "g.tsv").write_text("")
    assert byte_lines.tail_range(str(tmp_path / "g.tsv"), 5) == (0, 0, 0)
    byte_lines.register(spark)
    out = spark.read.format("byte_lines").option("path", str(path)).option("tail", 30).option("skipLast", 10).load()
    assert [r.line for r in out.orderBy("start").collect()] == lines[-30:-10]


def test_import_flags(spark):
    names = "position long, asset_id string, lat double, lon double, lane string, capture string, model string"
    meter = 1 / (6_371_000 * math.radians(1))
    stored = [(0, "s", 10.0, 20.0, "scene", "c", "m"), (0, "t", 50.0, 179.99999, "scene", "c", "m")]
    arrivals = [
        (1, "a", 10.0 + 24.96 * meter, 20.0, "scene", "c", "m"), (2, "b", 10.0 + 24.99 * meter, 20.0, "scene", "c", "m"), (3, "c", 10.0, 20.0, "object", "c", "m"),
        (4, "s", 10.0, 20.0, "scene", "c", "m"), (5, "e", 50.0, -179.99999, "scene", "c", "m"), (6, "f", -30.0, 0.0, "scene", "c", "m"), (7, "f", -30.0, 0.0, "scene", "c", "m"),
        (8, "g", -30.0 + 24.99 * meter, 0.0, "scene", "c", "m"), (9, "h", None, 0.0, "scene", "c", "m"),
    ]
    got = {r.position: r.deferred for r in spatial.import_flags(spark.createDataFrame(arrivals, names), spark.createDataFrame(stored, names)).collect()}
    # 2 lies beside 1, 5 is beyond the box at the date line, 7 repeats its own asset, 8 is near 6 without a box, 4 meets 1 and 2
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: True, 9: False}


def test_planted_wrong_vectors_are_found(spark):
    rows = [(1, 1, "Prototype1"), (1, 2, "street-b"), (1, 3, "street-a"), (2, 4, "street-c"), (2, 5, "Prototype2")]
    table = spark.createDataFrame(rows, "lease_id long, location_id long, asset_id string").withColumns({c: F.lit(v) for c, v in (("capture", "2020-01"), ("lane", "scene"), ("model", "m"))})
    key = F.concat_ws("\n", "asset_id", "capture", "lane", "model")
    true = table.withColumn("embedding", features.vector_of(key, F.col("lane")))
    digest = output_digest(F.lit("m"), F.col("asset_id"), F.col("capture"), F.col("lane"), F.col("model"), F.col("embedding"))
    true = true.withColumn("output_sha256", digest)
    tell = lambda df: {r.location_id: (r.sampled, r.problem) for r in audit.audited(df, "m").collect()}
    assert tell(true) == {1: (True, None), 2: (True, None), 3: (False, None), 4: (True, None), 5: (True, None)}
    # a made-up vector with a digest of its own passes only where nothing is computed anew
    fake = true.withColumn("embedding", F.unhex(F.lit("01" * 96))).withColumn("output_sha256", digest)
    assert tell(fake) == {1: (True, "digest"), 2: (True, "digest"), 3: (False, None), 4: (True, "digest"), 5: (True, "digest")}
    assert tell(true.withColumn("embedding", F.unhex(F.lit("01" * 96))))[1] == (True, "embedding")
    assert tell(true.withColumn("embedding", F.lit(None).cast("binary"))) == {1: (True, None), 2: (True, None), 3: (False, "length"), 4: (True, None), 5: (True, None)}
    assert tell(true.withColumn("output_sha256", F.lit(None).cast("string")))[3] == (False, "digest")
    assert tell(true.withColumn("model", F.lit("other")))[4] == (True, "model")


def test_an_empty_manifest_breaks_every_rule_that_asks_for_a_value(spark):
    table = manifests.rules({n: n for n in manifests.IDENTITY}, "book")
    rows = spark.createDataFrame([("{}",), ("no json",), (None,)], "t string").select(F.from_json("t", manifests.SCHEMA).alias("m"), F.from_json(F.lit('{"total": 0, "files": {"../x.bin": {"bytes": 1}}}'), manifests.FACTS).alias("f"))
    got = [set(r.p) for r in rows.select(manifests.manifest_problems(F.col("m"), F.col("f"), table).alias("p")).collect()]
    assert got == [table.keys() - {"permanentlyInvalidLocations", "viewQuality"}] * 3  # both may be left out
