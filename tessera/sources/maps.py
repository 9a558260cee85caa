"""Strict readers of map documents: the examples that a search is asked with, and the points that it leaves out.

A document is a bare list of points or an object with the list under one of three names. Values are read as variants, so
a number is told from a text, and a null from an absent field. What a reader refuses is a column, problem; `accepted_maps`
makes it an error. All work is per document but for the first-wins of equal examples, which is a map-side-combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.constants import MAX_EXCLUDED

#: Names of the list of points, and of a point's panorama; the first that counts is taken.
LISTS = ("customCoordinates", "locations", "coordinates")
PANOS = ("panoId", "pano_id", "pano")
#: Fixed value: examples of one map that a search is asked with at most.
MAX_EXAMPLES = 100

_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _points(value: Column) -> Column:
    """The list of points as variants, or null."""
    doc = F.try_parse_json(value)
    return F.coalesce(*[_get(doc, n, "array<variant>") for n in LISTS], F.try_variant_get(doc, "$", "array<variant>"))


def _pano(point: Column) -> Column:
    """The point's panorama (text, is_text): the first of its names that is neither null, empty, zero nor false."""
    tried = []
    for n in PANOS:
        v, text = _get(point, n), _get(point, n, "string")
        plain = _kind(v) == "STRING"
        counts = F.when(plain, text != "").otherwise(~text.isin("0", "0.0", "false"))
        tried.append(F.when(text.isNotNull() & counts, F.struct(text.alias("text"), plain.alias("is_text"))))
    return F.coalesce(*tried)


def is_url(pano: Column) -> Column:
    return pano.startswith("http") | pano.contains("maps.googleapis.com")


def _number(text: Column) -> Column:
    """A finite number from a number or a text of one, 0 for none; null for anything else."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(text.rlike(_NUMBER), text.try_cast("double"))


def _lng(point: Column, null_is_absent: bool) -> Column:
    """lng, or lon if there is no lng; whether a null lng is one is the reader's choice."""
    v = _get(point, "lng")
    there = v.isNotNull() & ~F.is_variant_null(v) if null_is_absent else v.isNotNull()
    return F.when(there, _get(point, "lng", "string")).otherwise(_get(point, "lon", "string"))


def query_maps(docs: DataFrame, key: str = "document", column: str = "value", limit: int = MAX_EXAMPLES, untitled: str = "Map") -> DataFrame:
    """(key, name, problem, examples) per document; keys are distinct.

    Points without a panorama text and rows that are no objects are passed over. Of points with equal panorama, heading,
    pitch and zoom the first stays; at most limit examples, evenly spaced. problem is that of the first point with one: an
    address for a panorama, or a number that is none (lat and lng only where the point is the first of its like).
    A document without points is an invalid map, one without examples an empty one. Refused documents have no examples.
    """
    listed = docs.select(F.col(key), F.col(column).alias("_value"), _points(F.col(column)).alias("_points"))
    rows = listed.select(key, F.posexplode("_points").alias("position", "p")).where(_kind(F.col("p")).startswith("OBJECT")).withColumn("_pano", _pano(F.col("p"))).where("_pano.is_text AND trim(_pano.text) <> ''")
    p, date = F.col("p"), _get(F.col("p"), "extra.panoDate")
    rows = rows.select(
        key, "position", F.trim("_pano.text").alias("pano_id"), *[_number(_get(p, n, "string")).alias(n) for n in ("heading", "pitch", "zoom")],
        F.struct(
            "position", F.trim("_pano.text").alias("pano_id"), _number(_get(p, "lat", "string")).alias("lat"), _number(_lng(p, False)).alias("lng"),
            F.coalesce(F.when((_kind(date) == "STRING") & (_get(p, "extra.panoDate", "string") != ""), _get(p, "extra.panoDate", "string")), F.lit("unknown")).alias("capture"),
            F.coalesce(F.try_element_at(_get(p, "extra.tags", "array<string>"), F.lit(1)), F.lit("")).alias("country"),
        ).alias("rest"),
    )
    first = rows.groupBy(key, "pano_id", "heading", "pitch", "zoom").agg(F.min_by("rest", "position").alias("r"))
    bad = F.when(is_url(F.col("pano_id")), "imagery_url_forbidden").when(F.col("heading").isNull() | F.col("pitch").isNull() | F.col("zoom").isNull() | F.col("r.lat").isNull() | F.col("r.lng").isNull(), "invalid_number")
    ex = F.struct("r.position", "pano_id", "r.lat", "r.lng", "heading", "pitch", "zoom", "r.capture", "r.country")
    one = first.groupBy(key).agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("r.position"))).alias("_bad"), F.array_sort(F.collect_list(ex)).alias("_all"))
    last = F.size("_all") - 1
    spaced = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get("_all", F.bround(i / F.lit(float(max(1, limit - 1))) * last, 0).cast("int")))
    name = _get(F.try_parse_json("_value"), "name")
    title = F.when((_kind(name) == "STRING") & (F.trim(_get(F.try_parse_json("_value"), "name", "string")) != ""), _get(F.try_parse_json("_value"), "name", "string"))
    out = listed.select(key, F.coalesce(title, F.lit(untitled)).alias("name"), F.coalesce(F.size("_points"), F.lit(0)).alias("_n")).join(one, key, "left")
    problem = F.when(F.col("_n") <= 0, "invalid_map").when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_all").isNull(), "empty_map")
    return out.select(key, "name", problem.alias("problem"), F.when(problem.isNull(), F.when(F.size("_all") <= limit, F.col("_all")).otherwise(spaced)).alias("examples"))


def exclude_maps(docs: DataFrame, key: str = "document", column: str = "value", limit: int = MAX_EXCLUDED) -> DataFrame:
    """(key, problem, points) per document: of its points the first limit with numeric coordinates (absent ones count as 0).

    An address for a panorama before the limit is reached is a problem, and so is a document that is neither list nor
    object. Null documents leave nothing out.
    """

    def point(e, i):
        pano, lat, lng = _pano(e), _get(e, "lat", "string"), _lng(e, True)
        number = lambda t: F.when(t.isNull(), 0.0).when(t.rlike(_NUMBER), t.try_cast("double"))
        text = F.when(pano["is_text"], pano["text"])
        return F.struct(i.alias("position"), (_kind(e).startswith("OBJECT")).alias("ok"), F.coalesce(is_url(text), F.lit(False)).alias("url"), F.coalesce(text, F.lit("")).alias("pano_id"), number(lat).alias("lat"), number(lng).alias("lng"))

    doc = F.try_parse_json(column)
    rows = docs.select(key, F.col(column).isNull().alias("_none"), _kind(doc).alias("_kind"), F.transform(F.coalesce(_points(F.col(column)), F.array().cast("array<variant>")), point).alias("_all"))
    sound = F.filter("_all", lambda x: x["ok"] & ~x["url"] & x["lat"].isNotNull() & x["lng"].isNotNull())
    rows = rows.withColumn("_points", F.slice(sound, 1, limit))
    end = F.when(F.size("_points") >= limit, F.element_at("_points", -1)["position"])
    url = F.exists("_all", lambda x: x["ok"] & x["url"] & F.coalesce(x["position"] < end, F.lit(True)))
    fit = F.coalesce(F.col("_kind").startswith("OBJECT") | F.col("_kind").startswith("ARRAY"), F.lit(False))
    problem = F.when(F.col("_none"), None).when(~fit, "invalid_map").when(url, "imagery_url_forbidden")
    kept = F.transform("_points", lambda x: F.struct(x["position"].alias("position"), x["pano_id"].alias("pano_id"), x["lat"].alias("lat"), x["lng"].alias("lng")))
    return rows.select(key, problem.alias("problem"), F.when(problem.isNull(), kept).alias("points"))


def accepted_maps(maps: DataFrame) -> DataFrame:
    """maps without problem; a refused document is an error that names its problem."""
    return maps.where(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean"))).drop("problem")


def tag_names(docs: DataFrame, column: str = "value") -> DataFrame:
    """(tag, name) from documents {tag: {name}}: canonical names; entries that are no objects with a name text are left out."""
    from tessera.functions.text import canonical_country

    each = docs.select(F.explode(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")).alias("tag", "v"))
    name = _get(F.col("v"), "name")
    named = each.where((_kind(F.col("v")).startswith("OBJECT")) & (_kind(name) == "STRING")).select(F.col("tag").cast("int").alias("tag"), F.trim(_get(F.col("v"), "name", "string")).alias("name"))
    return named.where("name <> ''").withColumn("name", canonical_country(F.col("name")))
