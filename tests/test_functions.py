import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import features as X
from tessera.functions import geo, text
from tessera.functions import vectors as V
from tessera.functions.constants import GENERATIONS
from tessera.operators.filters import Filters, clamped, normal_filters, overfetch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scene_vector_golden():
    faces = X.render_faces(["PrototypeBerkeleyCA000001\n2019-06\nscene\ncommunity-visual-v1"])
    assert hashlib.sha256(X.scene_vectors(faces)[0].tobytes()).hexdigest() == "184d8147b3d5024f41578daa88e27aba6439e5ba0d371b4921f54602775091df"
    assert X.object_vectors(faces).shape == (1, 128) and np.abs(X.object_vectors(faces).astype(int)).max() <= 127


def scene_by_loops(face):
    out = []
    for qy in (0, 8):
        for qx in (0, 8):
            r = g = b = dx = 0
            for y in range(8):
                for x in range(8):
                    p = face[qy + y, qx + x].astype(int)
                    r, g, b = r + p[0], g + p[1], b + p[2]
                    if x:
                        dx += abs(p[0] - int(face[qy + y, qx + x - 1, 0]))
            out += [max(-127, min(127, v)) for v in (r // 64 - 128, g // 64 - 128, b // 64 - 128, dx // 56 - 128)]
    return out


def test_vectors_equal_plain_loops():
    faces = X.render_faces(["a", "b"])
    vectors = X.scene_vectors(faces)
    for i in range(2):
        assert vectors[i].tolist() == [v for f in faces[i] for v in scene_by_loops(f)]


def test_box_means_and_description(spark):
    image = np.arange(20 * 33 * 3).reshape(20, 33, 3) % 256
    small = X.box_reduced(image.astype(np.uint8))
    assert small.shape == (16, 16, 3) and small[0, 0].tolist() == (image[0:1, 0:2].reshape(-1, 3).sum(axis=0) // 2).tolist()
    same = X.render_faces(["k"])
    assert (X.box_reduced(same[0, 0]) == same[0, 0]).all()
    faces = X.render_faces(["description:zzz\nprompt\nscene\nm"])
    assert X.description_vector(spark, "zzz", "scene", "m") == X.scene_vectors(faces)[0].tobytes() and (X.tinted(faces, (9, 9, 9), 0, 0) == faces).all()
    plain, red = (X.description_vector(spark, p, "scene", "m") for p in ("zzz", "red"))
    assert len(plain) == len(red) == 96 and plain != red and len(X.description_vector(spark, "red", "object", "m")) == 128


def test_prompt_routes(spark):
    prompts = ["car", "bird nest", "clock", "red airplane", "a clock", "car car", "Find me a kitten, or dogs!", "", "hair dryer and toothbrushes"]
    rows = spark.createDataFrame([(p,) for p in prompts], "p string").select("p", text.routed(F.col("p")).alias("r")).collect()
    got = {r.p: (r.r.route, list(r.r.class_ids), r.r.hot_id, r.r.semantic_text) for r in rows}
    assert got["car"] == ("common", [3], None, None) and got["bird nest"] == ("hot", [], 0, None) and got["clock"] == ("hot", [], 1, None)
    assert got["red airplane"] == ("semantic", [], None, "red airplane") and got["a clock"] == ("common", [85], None, None)
    assert got["car car"][0] == "semantic" and got["Find me a kitten, or dogs!"] == ("common", [17, 18], None, None)
    assert got[""] == ("semantic", [], None, "") and got["hair dryer and toothbrushes"] == ("common", [89, 90], None, None)


def test_plurals(spark):
    want = {"person": "people", "bus": "buses", "bench": "benches", "toothbrush": "toothbrushes", "baby": "babies", "key": "keys", "sheep": "sheep", "knife": "knives", "box": "boxes", "y": "ys", "traffic light": "traffic lights"}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", text.plural(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in rows} == want
    phrases = dict(text.class_phrases())
    assert phrases["people"] == 1 and phrases["buses"] == 6 and phrases["skis"] == 35 and phrases["teddy bears"] == 88


def test_weights_filters_and_clamps(spark):
    cases = [("40", True, True, 50), ("12", True, True, 0), ("37.9", True, True, 25), ("62", True, True, 50), ("63", True, True, 75), ("x", True, True, 50), (None, True, True, 50), ("-9", True, True, 0), ("900", True, True, 100), ("80", False, True, 100), ("80", True, False, 0), ("80", False, False, 100)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v string, m boolean, p boolean, want int")
    got = rows.select("i", "want", text.snapped_weight(F.col("v"), F.col("m"), F.col("p")).alias("w"), text.snapped_weight(F.col("v").try_cast("double"), F.lit(True), F.lit(True)).alias("d")).collect()
    assert all(r.w == r.want for r in got), got
    assert [r.d for r in got][:3] == [50, 0, 25]
    refused = spark.createDataFrame([("a" * 400,), ("a  " * 201,), (" " * 500,), ("b" * 401,)], "t string").select(text.prompt_problem(F.col("t")).alias("p")).collect()
    assert [r.p for r in refused] == [None, "invalid_query", None, "invalid_query"]
    assert normal_filters("exclude", []) == Filters() and normal_filters("include", []) == Filters("include")
    assert normal_filters("include", ["United States", " France", "France"]) == Filters("include", ("France", "USA"))
    assert normal_filters("odd", ["x"], list(GENERATIONS)) == Filters() and normal_filters(None, None, ["gen4", "gen4", "?"]).generations == ("gen4",)
    assert normal_filters("include", ["a", "b"], every_country=frozenset("ab")).mode == "all"
    assert clamped("7", 200) == 200 and clamped(True, 200) == 200 and clamped(0, 200) == 1 and clamped(10**6, 200) == 10_000
    assert overfetch(200, 25) == 800 and overfetch(5, 5) == 5 and overfetch(9000, 1) == 10_000


def test_scalars(spark):
    assert one(spark, geo.wrap_heading(F.lit(450.0))) == 90 and one(spark, geo.wrap_heading(F.lit(-90.0))) == 270
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == -1 and one(spark, V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == -1
    assert one(spark, text.number_15g(F.lit(0.1 + 0.2))) == "0.3" and one(spark, text.number_15g(F.lit(-0.0))) == "0"
    assert one(spark, text.capture(F.lit("2019"), F.lit("6"))) == "2019-06" and one(spark, text.capture(F.lit("2019"), F.lit("123"))) == "2019-123" and one(spark, text.capture(F.lit(" "), F.lit("6"))) == "unknown"
    assert one(spark, text.is_street_pano(F.lit("synthetic:1"))) is False and one(spark, text.is_street_pano(F.lit(" ok "))) is True
    assert bytes(one(spark, V.as_bytes(F.array(F.lit(-1), F.lit(127), F.lit(-127), F.lit(0))))) == b"\xff\x7f\x81\x00"
    mixed = one(spark, V.mixed(F.array(F.lit(-7), F.lit(7)), F.array(F.lit(0), F.lit(0)), 50))
    assert list(mixed) == [-3, 3]


def test_global_id_records(spark):
    import zlib

    from tessera.operators import bundles

    record = bytes(one(spark, bundles.global_id_record(F.lit(2**32 + 5))))
    raw = (2**32 + 5).to_bytes(8, "little")
    assert record == raw + zlib.crc32(raw).to_bytes(4, "little")
    assert one(spark, bundles.record_is_sound(F.lit(record))) and not one(spark, bundles.record_is_sound(F.lit(record[:-1] + b"?")))


def test_rounded_goes_by_the_scaled_value(spark):
    from tessera.functions.geo import rounded

    values = [65.0015, -65.0015, 12.3015, 0.0005, 65.2, -70.0, 2.5e-7] + [k * 0.1 - 180.0 + (k * 104729 % 1000) * 0.000003 for k in range(3600)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v"), 3).alias("r")).collect()
    assert [r.r for r in rows] == [math.copysign(math.floor(abs(r.v * 1000.0) + 0.5), r.v) / 1000.0 for r in rows]


def test_faces_are_drawn_as_far_as_they_are_wanted(spark):
    keys = ["a\n1", "b\n2", ""]
    assert np.array_equal(X.render_faces(keys, 1), X.render_faces(keys)[:, :1])


def test_spread_and_rules_that_share_their_facts(spark):
    from tessera.operators import manifests as M
    from tessera.operators.tables import spread

    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    facts = F.struct(F.map_from_entries(F.array(F.struct(F.lit("k"), F.sha2(F.col("id").cast("string"), 256)))).alias("files"))
    table = {f"rule {i}": lambda m, f, i=i: f["files"]["k"] != str(i) for i in range(4)} | {"no": lambda m, f: m["x"] == 1}
    df = spark.range(2).select(M.manifest_problems(F.struct(F.col("id").alias("x")), facts, table).alias("p"))
    assert [r.p for r in df.collect()] == [["no"], []]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
