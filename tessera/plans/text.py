"""Queries on prompts and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.constants import CLASSES, PALETTE, PLURALS
from tessera.plans import views as W

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("prompt_normalize", r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS prompt FROM documents")
def prompt_normalize(spark, d):
    return W.table(spark, d, "documents").select("doc_id", X.normal_prompt(F.col("text")).alias("prompt"))


@query("bare_words", r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM benchmark")
def bare_words(spark, d):
    return W.table(spark, d, "benchmark").select("item_id", X.bare_words(F.col("text")).alias("words"))


_ODD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLURALS.items())
_NAMED = f"named AS (SELECT c_custkey, {[n for _, n in CLASSES]}[c_custkey % {len(CLASSES)} + 1] AS name, {[i for i, _ in CLASSES]}[c_custkey % {len(CLASSES)} + 1] AS class_id FROM customer)"


def _named(spark, d):
    """A class per customer."""
    at = (F.col("c_custkey") % len(CLASSES) + 1).cast("int")
    pick = lambda j: F.element_at(F.array(*[F.lit(c[j]) for c in CLASSES]), at)
    return W.table(spark, d, "customer").select("c_custkey", pick(0).alias("class_id"), pick(1).alias("name"))


@query("plural_phrases", f"WITH {_NAMED} SELECT c_custkey, name, CASE name {_ODD} ELSE CASE WHEN regexp_matches(name, '(ch|sh|s|x|z)$') THEN name || 'es' WHEN regexp_matches(name, '[^aeiou]y$') THEN regexp_replace(name, 'y$', 'ies') ELSE name || 's' END END AS plural FROM named")
def plural_phrases(spark, d):
    return _named(spark, d).select("c_custkey", "name", X.plural(F.col("name")).alias("plural"))


_SHORT = {i: n for i, n in CLASSES if i in (3, 16, 18, 63, 85)}


def _prompts(spark, d):
    """Prompts made of class names, glue and other words, one per part."""
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("find me a ", "", "Show the ", "red "))), (k % 4 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(n) for n in (*_SHORT.values(), "bird nest", "lighthouse")]), (k % 7 + 1).cast("int"))
    return W.table(spark, d, "part").select("p_partkey", F.concat(head, name, F.when(k % 3 == 0, " and a clock!").otherwise("")).alias("prompt"))


_PROMPTS = f"prompts AS (SELECT p_partkey, ['find me a ', '', 'Show the ', 'red '][p_partkey % 4 + 1] || {[*_SHORT.values(), 'bird nest', 'lighthouse']}[p_partkey % 7 + 1] || CASE WHEN p_partkey % 3 = 0 THEN ' and a clock!' ELSE '' END AS prompt FROM part)"
_ID = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_SHORT)) + " WHEN 5 THEN 16 END"


@query(
    "prompt_route",
    f"""WITH {_PROMPTS}, r AS (SELECT p_partkey, prompt, p_partkey % 4 AS h, p_partkey % 7 AS n, p_partkey % 3 = 0 AS tail, {_ID} AS id FROM prompts),
    t AS (SELECT *, CASE WHEN h = 1 AND NOT tail AND n = 5 THEN 0 WHEN h = 1 AND NOT tail AND n = 4 THEN 1 END AS hot FROM r)
    SELECT p_partkey, CASE WHEN hot IS NOT NULL THEN 'hot' WHEN h = 3 OR n IN (5, 6) THEN 'semantic' ELSE 'common' END AS route, hot AS hot_id,
    CASE WHEN hot IS NOT NULL OR h = 3 OR n IN (5, 6) THEN '' ELSE array_to_string(list_sort(list_distinct(CASE WHEN tail THEN [id, 85] ELSE [id] END)), ',') END AS class_ids FROM t""",
)
def prompt_route(spark, d):
    out = X.with_routes(_prompts(spark, d))
    return out.select("p_partkey", "route.route", "route.hot_id", F.array_join(F.col("route.class_ids").cast("array<string>"), ",").alias("class_ids"))


_TOKENS = ", ".join(f"'{p[0]}'" for p in PALETTE)
_SUBJECTS = ["bright red sky", "dark forest road", "snow", "nothing here", "white night"]


@query(
    "palette_tokens",
    f"""WITH s AS (SELECT p_partkey, {_SUBJECTS}[p_partkey % 5 + 1] AS prompt FROM part), w AS (SELECT p_partkey, prompt, string_split(prompt, ' ') AS words FROM s),
    f AS (SELECT *, list_filter([{_TOKENS}], lambda t: list_contains(words, t)) AS found FROM w)
    SELECT p_partkey, array_to_string(list_sort(found), ',') AS tokens, CAST(CASE WHEN len(found) > 0 THEN least(70, 25 + 15 * least(4, len(found))) ELSE 0 END AS INTEGER) AS strength,
    CAST(18 * (len(list_filter(['bright', 'sunny', 'white', 'snow', 'daylight'], lambda x: list_contains(words, x))) - len(list_filter(['dark', 'night', 'black', 'shadow'], lambda x: list_contains(words, x)))) AS INTEGER) AS shift FROM f""",
)
def palette_tokens(spark, d):
    prompt = F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    out = W.table(spark, d, "part").select("p_partkey", X.palette(prompt).alias("p"))
    return out.select("p_partkey", F.array_join(F.array_sort("p.tokens"), ",").alias("tokens"), "p.strength", "p.shift")


@query("label_search_instr", "SELECT conv_id, turn FROM conversations WHERE instr(lower(text), 'th') > 0 AND role = 'user'")
def label_search_instr(spark, d):
    return W.table(spark, d, "conversations").where((F.instr(F.lower("text"), "th") > 0) & (F.col("role") == "user")).select("conv_id", "turn")


@query("prefix_filter", "SELECT page_id FROM pages WHERE NOT starts_with(url, 'https://') AND url NOT LIKE '%#%'")
def prefix_filter(spark, d):
    return W.table(spark, d, "pages").where(~F.col("url").startswith("https://") & ~F.col("url").contains("#")).select("page_id")


@query("storage_floors", f"WITH {_NAMED} SELECT c_custkey, CASE WHEN class_id IN (5, 16, 17) THEN CAST(0.01 AS DOUBLE) WHEN class_id IN (2, 10, 11, 13, 14, 18, 27, 28, 64) OR class_id BETWEEN 31 AND 61 OR class_id BETWEEN 73 AND 77 OR class_id BETWEEN 84 AND 90 THEN CAST(0.03 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS floor FROM named")
def storage_floors(spark, d):
    return _named(spark, d).select("c_custkey", X.storage_floor(F.col("class_id")).alias("floor"))


_BYTES = "array_to_string(list_transform(embedding, lambda x: printf('%02X', (CAST(round(CAST(x AS DOUBLE) * 127) AS INTEGER) + 256) % 256)), '')"


@query("hex_base64_round_trip", f"SELECT vec_id, {_BYTES} AS hexed, to_base64(unhex({_BYTES})) AS based FROM embeddings")
def hex_base64_round_trip(spark, d):
    raw = V.as_bytes(V.quantized(F.col("embedding")))
    return W.table(spark, d, "embeddings").select("vec_id", F.hex(F.unhex(F.hex(raw))).alias("hexed"), X.based64(F.unbase64(X.based64(raw))).alias("based"))


@query("json_alternative_keys", "SELECT event_id, CAST(coalesce(json_extract(props, '$.key'), json_extract(props, '$.k')) AS BIGINT) AS k FROM events")
def json_alternative_keys(spark, d):
    return W.table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).cast("long").alias("k"))


@query("number_format", "SELECT s_suppkey, CASE WHEN s_acctbal = 0 THEN '0' ELSE printf('%.15g', s_acctbal / CAST(7 AS DOUBLE)) END AS text FROM supplier")
def number_format(spark, d):
    return W.table(spark, d, "supplier").select("s_suppkey", X.number_15g(F.col("s_acctbal") / 7).alias("text"))
