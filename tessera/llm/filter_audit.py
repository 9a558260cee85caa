"""Interaction of document filters: what each of five filters removes, in every order of applying them, per part.

A filter is one letter and a failure flag per document. The documents are first counted by part and flags (at most 32 rows
a part), so all that follows is small. CUBE over the five flags and part gives the subset survivors: the grouping-set rows
whose selected flags are all false count the documents that pass that subset of filters. A step of an order takes the
survivors of one subset to those of the next larger one, so the 80 pairs (subset, filter) of a part give every figure of
its 600 steps: removed is the difference of two survivor counts, and the share of an order-free attribution (Shapley sum)
is that difference weighted by the number of orders that pass through the pair.

Whether a text repeats an earlier one (filter E) is decided on narrow rows of digests. Copies of one text agree in every
other flag, so they are counted by text, part and labels before the shuffle, and the smallest id of a text is a minimum over
these few rows: a text with very many copies moves one row per task.

Cases: a null text is empty, a null source is the part ''. A row without an id neither fails E nor makes others fail. Rows
that repeat an id count one by one, and none of those with the smallest id of their text fails E. A document counts as good
(toxic) if any row of labels with its id says so; null labels and null ids say nothing. No documents give no rows. Columns
beyond the named ones are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pin, read_table

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"

_BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
_ALL = (1 << len(FILTERS)) - 1


def text_flags(text: Column) -> dict[str, Column]:
    """Failure flags of the four filters that look at one text: short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"), "C": 100 * capitals.cast("long") > UPPER_PERCENT * F.length(text).cast("long"), "D": text.rlike(SYMBOLS)}


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with good and toxic. Rows without an id are spread by their text, as they meet no label."""
    of = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = of.select(F.col("doc_id").alias("at"), F.lit(True).alias("named"), "good", "toxic")
    keyed = docs.withColumns({"at": F.coalesce("doc_id", F.xxhash64("digest")), "named": F.col("doc_id").isNotNull()})
    return keyed.join(of, ["at", "named"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, n, good, toxic): documents by part and failure flags."""
    text = F.coalesce("text", F.lit(""))
    rows = pin(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")), "doc_id", "part", digest=F.unhex(F.sha2("text", 256)), **text_flags(F.col("text")))
    group = ["digest", "part", *"ABCD", "good", "toxic"]
    by_id = labelled(rows, labels).groupBy("at", "named", "doc_id", *group).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("named"), F.struct("doc_id", "n")))
    copies = by_id.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.when(~F.col("named"), F.col("n")).otherwise(0)).alias("unnamed"), first.alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))  # four rows a part and text at most
    passing = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    counted = copies.withColumn("smallest", smallest).select("part", *"ABCD", "good", "toxic", F.inline(F.array(F.struct(F.lit(False).alias("E"), passing.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passing).alias("n")))))
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return counted.where("n > 0").groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), only("good"), only("toxic"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents of a part that pass every filter of the subset, a bit mask; no row where none does."""
    cube = counts.cube("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"), F.grouping("part").alias("of_all"), *[F.grouping(c).alias(f"no_{c}") for c in FILTERS])
    for c in FILTERS:  # a flag that the grouping set leaves out, or one that is false
        cube = cube.where((F.col(f"no_{c}") == 1) | ~F.col(c))
    subset = sum(((1 - F.col(f"no_{c}")) * _BIT[c] for c in FILTERS), F.lit(0))
    return cube.where("of_all = 0").select("part", subset.cast("int").alias("subset"), "n", "good", "toxic")


def pair_figures(alive: DataFrame) -> DataFrame:
    """(part, subset, letter, kept, removed, good_lost, toxic_lost, unique_fails, fails, shapley) of the 80 pairs of a part."""
    pairs = [(s, c, s | _BIT[c]) for s in range(_ALL + 1) for c in FILTERS if not s & _BIT[c]]
    weight = {k: factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))}
    literal = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(c).alias("letter"), F.lit(t).alias("next"), F.lit(weight[s.bit_count()]).alias("weight")) for s, c, t in pairs])
    steps = alive.select("part").distinct().select("part", F.inline(literal))
    named = lambda p: alive.select("part", F.col("subset").alias("next" if p == "after" else "subset"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "good", "toxic")])
    both = steps.join(named("before"), ["part", "subset"], "left").join(named("after"), ["part", "next"], "left").na.fill(0)
    lost = {name: F.col(f"before_{c}") - F.col(f"after_{c}") for name, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))}
    rows = both.select("part", "subset", "letter", "next", "weight", F.col("after_n").alias("kept"), *[v.alias(k) for k, v in lost.items()])
    where = lambda s: F.sum(F.when(s, F.col("removed")).otherwise(0))
    totals = rows.groupBy("part", "letter").agg(where(F.col("next") == _ALL).alias("unique_fails"), where(F.col("subset") == 0).alias("fails"), F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    return rows.drop("next", "weight").join(totals, ["part", "letter"])


def order_steps(spark) -> DataFrame:
    """(filter_order, step, letter, subset) of the 600 steps."""
    rows = [(order, k + 1, order[k], sum(_BIT[c] for c in order[:k])) for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, step int, letter string, subset int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    pairs = pair_figures(survivors(flag_counts(docs, labels)))
    out = pairs.join(F.broadcast(order_steps(docs.sparkSession)), ["subset", "letter"])  # 600 rows
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark, sf_dir):
    return audit(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), read_table(spark, sf_dir, "labels"))


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flagged AS (
    SELECT part,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS fails,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = texts.doc_id AND l.quality = 1) AS good,
        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = texts.doc_id AND l.toxic = 1) AS toxic
    FROM texts),
counts AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[:k - 1]), 0) AS INTEGER) AS earlier FROM orders, range(1, 6) r(k)),
told AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
        sum(CASE WHEN fails & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & earlier <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN fails & earlier = 0 AND fails & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""
