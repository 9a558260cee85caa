"""Rules of a finished object index's manifest, as a table of named conditions that one expression checks.

A rule is a name and a condition over the parsed manifest m and what is known of the lease (facts): total items, the first
global id, size and digest of the source lines, the source's name, the countries of the lines, and the files that came with
it. Each rule is a column; a manifest's problems are the names of all that don't hold, in the order of the table. A missing
value doesn't hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.checks import class_file, near, safe_file
from tessera.functions.constants import CLASSES, HOT_PHRASES
from tessera.functions.text import storage_floor

#: Versions of the parts, whole numbers, numbers with a tolerance, and the strategy of the views.
VERSIONS = {"manifest": 4, "checkpoint": 4, "commonRecord": 3, "hotRecord": 1, "semanticRecord": 1, "metadataRecord": 1, "offsets": 1, "globalIds": 1}
NUMBERS = {"version": 4, "imageSize": 640, "tileGrid": 2, "viewCount": 6, "faceSize": 640, "bandsPerFace": 3, "bandWidth": 600, "bandHeight": 280, "recordBytes": 32}
ABOUT = {"tileOverlap": 0.2, "minimumRelativeClassScore": 0.25, "smallObjectRelativeClassScore": 0.0, "fullTileArtifactThreshold": 0.98, "faceFov": 90.0, "bandOffset": 24.0, "bandFov": 90.0}
VIEW_STRATEGY = "six-face-cube"
#: Files of a record per location (name, record bytes), bytes of an object's record, floors of the hot concepts, and the semantic file.
PER_LOCATION = {"offsets": ("location-offsets.bin", 8), "metadata": ("location-metadata.bin", 8), "globalIds": ("global-location-ids.bin", 12)}
RECORD_BYTES, QUALITY_BYTES = 32, 8
HOT_FLOORS = (0.01, 0.03)
SEMANTIC = {"codec": "PQ128", "embeddingDimensions": 512, "proposalsPerLocation": 16}
SEMANTIC_FILE, SEMANTIC_BYTES = "semantic-pq128.bin", 144
#: Texts that name a model, a runtime or a policy; the caller says what they have to be.
IDENTITY = ("feature", "architecture", "modelSha256", "runtimeIdentity", "rankingStrategy", "coverage", "positionPolicy", "globalIdMode")

_FILE = "file: string, records: bigint, recordBytes: bigint, bytes: bigint, sha256: string"
_CLASS = f"array<struct<id: int, name: string, storageFloor: double, {_FILE}>>"
SCHEMA = (
    f"contractVersions map<string, bigint>, {', '.join(f'{n} bigint' for n in NUMBERS)}, {', '.join(f'{n} double' for n in ABOUT)}, {', '.join(f'{n} string' for n in IDENTITY)}, completed boolean, viewStrategy string, sourceId string, "
    "totalLocations bigint, indexedLocations bigint, globalStart bigint, minimumGlobalLocation bigint, maximumGlobalLocation bigint, sourceBytes bigint, sourceSha256 string, permanentlyInvalidLocations bigint, countries array<string>, "
    f"{', '.join(f'{n} struct<{_FILE}>' for n in PER_LOCATION)}, classes {_CLASS}, hotConcepts {_CLASS}, semantic struct<codec: string, codebookSha256: string, embeddingDimensions: bigint, proposalsPerLocation: bigint, {_FILE}>, viewQuality struct<{_FILE}>"
)
FACTS = "total bigint, global_start bigint, source_bytes bigint, source_sha256 string, source_id string, countries array<string>, files map<string, struct<bytes: bigint, sha256: string>>"

Rule = Callable[[Column, Column], Column]


def entry_holds(entry: Column, facts: Column, name: Column, records: Column, size: int, stated: bool = True) -> Column:
    """Whether an entry names its file, has so many records of that size, and agrees with the file that came."""
    width = entry["recordBytes"] == size
    file = F.try_element_at(facts["files"], name)
    whole = records * size
    agrees = (entry["bytes"] == whole) & (file["bytes"] == whole) & (entry["sha256"] == file["sha256"])
    return (entry["file"] == name) & (entry["records"] == records) & (width if stated else entry["recordBytes"].isNull() | width) & agrees


def _listed(entries: Column, facts: Column, kind: str, numbered: list[tuple[int, str]], floors: list[Column]) -> Column:
    checks = [F.size(entries) == len(numbered)]
    for k, ((number, name), floor) in enumerate(zip(numbered, floors, strict=True)):
        e = F.get(entries, F.lit(k))
        file = class_file(kind, F.lit(number), F.lit(name))
        checks.append((e["id"] == number) & (e["name"] == name) & near(e["storageFloor"], floor) & (e["records"] >= 0) & entry_holds(e, facts, file, e["records"], RECORD_BYTES, stated=False))
    return F.forall(F.array(*[F.coalesce(c, F.lit(False)) for c in checks]), lambda c: c)


def file_names(m: Column) -> Column:
    """The files that a manifest names."""
    listed = lambda c: F.coalesce(F.transform(m[c], lambda e: e["file"]), F.array().cast("array<string>"))
    ones = F.array(*[m[n]["file"] for n in (*PER_LOCATION, "semantic", "viewQuality")])
    return F.array_sort(F.array_distinct(F.filter(F.concat(ones, listed("classes"), listed("hotConcepts")), lambda n: n.isNotNull())))


def rules(identity: dict[str, str], codebook: str) -> dict[str, Rule]:
    """The table: name of each rule and its condition."""
    out: dict[str, Rule] = {f"contractVersions.{n}": lambda m, f, n=n, v=v: F.try_element_at(m["contractVersions"], F.lit(n)) == v for n, v in VERSIONS.items()}
    out |= {n: lambda m, f, n=n, v=v: m[n] == v for n, v in NUMBERS.items()}
    out |= {n: lambda m, f, n=n, v=v: near(m[n], F.lit(v)) for n, v in ABOUT.items()}
    out |= {n: lambda m, f, n=n: m[n] == identity[n] for n in IDENTITY}
    out |= {
        "completed": lambda m, f: m["completed"],
        "viewStrategy": lambda m, f: m["viewStrategy"] == VIEW_STRATEGY,
        "sourceId": lambda m, f: m["sourceId"] == f["source_id"],
        "totalLocations": lambda m, f: (m["totalLocations"] == f["total"]) & (f["total"] > 0),
        "indexedLocations": lambda m, f: m["indexedLocations"] == f["total"],
        "globalStart": lambda m, f: m["globalStart"] == f["global_start"],
        "minimumGlobalLocation": lambda m, f: m["minimumGlobalLocation"] == f["global_start"],
        "maximumGlobalLocation": lambda m, f: m["maximumGlobalLocation"] == f["global_start"] + f["total"] - 1,
        "sourceBytes": lambda m, f: m["sourceBytes"] == f["source_bytes"],
        "sourceSha256": lambda m, f: m["sourceSha256"] == f["source_sha256"],
        "permanentlyInvalidLocations": lambda m, f: m["viewQuality"].isNotNull() | (F.coalesce(m["permanentlyInvalidLocations"], F.lit(0)) == 0),
        "countries": lambda m, f: (F.size(m["countries"]) > 0) & (F.size(F.array_distinct(m["countries"])) == F.size(m["countries"])) & (F.array_sort(m["countries"]) == F.array_sort(F.when(F.size(f["countries"]) > 0, F.array_distinct(f["countries"])).otherwise(F.array(F.lit(""))))),
        "file names": lambda m, f: F.forall(F.map_keys(f["files"]), lambda n: safe_file(n)) & (F.array_sort(F.map_keys(f["files"])) == file_names(m)),
    }
    out |= {n: lambda m, f, n=n, name=name, size=size: entry_holds(m[n], f, F.lit(name), f["total"], size) for n, (name, size) in PER_LOCATION.items()}
    out["classes"] = lambda m, f: _listed(m["classes"], f, "class", list(CLASSES), [storage_floor(F.lit(number)) for number, _ in CLASSES])
    out["hotConcepts"] = lambda m, f: _listed(m["hotConcepts"], f, "hot", [(k, p[0]) for k, p in enumerate(HOT_PHRASES)], list(map(F.lit, HOT_FLOORS)))
    out |= {f"semantic.{n}": lambda m, f, n=n, v=v: m["semantic"][n] == v for n, v in SEMANTIC.items()}
    out["semantic.codebookSha256"] = lambda m, f: m["semantic"]["codebookSha256"] == codebook
    out["semantic"] = lambda m, f: entry_holds(m["semantic"], f, F.lit(SEMANTIC_FILE), f["total"] * SEMANTIC["proposalsPerLocation"], SEMANTIC_BYTES)
    out["viewQuality"] = lambda m, f: m["viewQuality"].isNull() | entry_holds(m["viewQuality"], f, m["viewQuality"]["file"], f["total"], QUALITY_BYTES)
    return out


def manifest_problems(m: Column, facts: Column, table: dict[str, Rule]) -> Column:
    """Names of the rules that a parsed manifest (SCHEMA) breaks, given the facts (FACTS).

    Both are bound by a lambda, so that they are computed once per row and not once for each rule that looks at them.
    """

    def told(x: Column) -> Column:
        names = [F.when(~F.coalesce(rule(x["m"], x["facts"]), F.lit(False)), name) for name, rule in table.items()]
        return F.filter(F.array(*names), lambda n: n.isNotNull())

    return F.get(F.transform(F.array(F.struct(m.alias("m"), facts.alias("facts"))), told), F.lit(0))
