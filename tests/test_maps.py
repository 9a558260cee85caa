import json

import pytest

from tessera.sources import maps


def docs(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "document int, value string")


def read(spark, *values, **options):
    return maps.query_maps(docs(spark, *values), **options).orderBy("document").collect()


def test_query_maps(spark):
    point = {"panoId": " a ", "lat": "1.5", "lng": 2, "heading": 90, "extra": {"panoDate": "2020-01", "tags": ["France", "x"]}}
    one, = read(spark, {"name": "N", "customCoordinates": [point, {**point, "lat": "bad"}, 7, {"panoId": 5}, {"panoId": 0, "pano": "b", "lon": "3e1", "lng": None}, {"pano_id": "c", "lon": 4, "heading": ""}]})
    assert (one.name, one.problem) == ("N", None)
    assert [tuple(e) for e in one.examples] == [(0, "a", 1.5, 2.0, 90.0, 0.0, 0.0, "2020-01", "France"), (4, "b", 0.0, 0.0, 0.0, 0.0, 0.0, "unknown", ""), (5, "c", 0.0, 4.0, 0.0, 0.0, 0.0, "unknown", "")]


def test_refused_maps(spark):
    url = {"panoId": "http://x"}
    got = read(spark, None, "{", [], {}, {"locations": [{"panoId": ""}]}, [url], [{"panoId": "a", "zoom": "wide"}, url], [url, {"panoId": "a", "zoom": "wide"}], [{"panoId": "a", "lat": True}], [{"panoId": "a", "lat": "1d"}], {"name": " ", "coordinates": [{"pano": "a"}]})
    assert [r.problem for r in got] == ["invalid_map"] * 4 + ["empty_map", "imagery_url_forbidden", "invalid_number", "imagery_url_forbidden", "invalid_number", "invalid_number", None]
    assert all(r.examples is None for r in got[:-1]) and got[-1].name == "Map"
    with pytest.raises(Exception, match="imagery_url_forbidden"):
        maps.accepted_maps(maps.query_maps(docs(spark, [url]))).collect()


@pytest.mark.parametrize("limit", [1, 2, 4, 7])
def test_examples_are_evenly_spaced(spark, limit):
    n = 11
    one, = read(spark, [{"pano": f"p{i}", "heading": i} for i in range(n)] * 2, limit=limit)
    want = [round(i / (limit - 1) * (n - 1)) for i in range(limit)] if limit > 1 else [0]
    assert [e.position for e in one.examples] == want


def test_exclude_maps(spark):
    url = {"panoId": "https://maps.googleapis.com/x", "lat": 1, "lng": 1}
    points = [{"lat": 1, "lng": None, "lon": 2}, {"lat": "x", "lng": 2}, 5, {"lat": None, "lng": 3, "panoId": 7}]
    got = maps.exclude_maps(docs(spark, None, "5", {}, points, [*points, url], [*points, url]), limit=3).orderBy("document").collect()
    assert [r.problem for r in got] == [None, "invalid_map", None, None, "imagery_url_forbidden", "imagery_url_forbidden"]
    assert [tuple(p) for p in got[3].points] == [(0, "", 1.0, 2.0), (3, "", 0.0, 3.0)] and got[0].points == []
    capped = maps.exclude_maps(docs(spark, [*points, url]), limit=2).first()
    assert capped.problem is None and [p.position for p in capped.points] == [0, 3]


def test_tag_names(spark):
    got = maps.tag_names(docs(spark, {"1": {"name": " France "}, "2": {"name": ""}, "3": "x", "4": {"name": 5}}, {"7": {"name": "Chad"}}, None, {}))
    assert sorted(map(tuple, got.collect())) == [(1, "France"), (7, "Chad")]


def test_empty_tables(spark):
    none = docs(spark, "[]").where("false")
    assert maps.query_maps(none).count() == maps.exclude_maps(none).count() == maps.tag_names(none).count() == 0


def test_backup_and_restore(spark, tmp_path):
    from tessera.operators import exports

    tables = {"a": spark.range(5), "b": spark.range(3)}
    audits = {"ids": lambda t: t["b"].join(t["a"], "id", "left_anti")}
    path = str(tmp_path / "backup")
    assert exports.backed_up(tables, path, audits) == {"a": 5, "b": 3}
    with pytest.raises(ValueError, match="something at"):
        exports.backed_up(tables, path, audits)
    back = exports.restored(spark, path, ["a", "b"], str(tmp_path / "new"), audits)
    assert {n: t.count() for n, t in back.items()} == {"a": 5, "b": 3}
    with pytest.raises(ValueError, match="fails its audit: ids"):
        exports.backed_up({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "bad"), audits)
    assert not (tmp_path / "bad").exists() and (tmp_path / "backup").exists()


def test_first_rows_of_a_catalogue(spark):
    from tessera.sources.records import street_rows

    rows = spark.createDataFrame([(0, " "), (1, "a"), (2, None), (3, "http://x"), (4, "b"), (5, "c")], "row_index long, pano_id string")
    assert [r.row_index for r in street_rows(rows, limit=2).orderBy("row_index").collect()] == [1, 4]
    assert street_rows(rows).count() == 3 and street_rows(rows, limit=0).count() == 0
