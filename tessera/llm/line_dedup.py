"""Removal of line passages that repeat across a corpus, with DataFrame functions only.

A text is a list of lines. A rolling hash runs over the hashes of two neighbouring non-blank lines (and the blank ones
between). It makes a boundary wherever it is not above both of its neighbours, so of any two neighbouring places one at least
is a boundary, and an insertion moves no boundary beyond the next two lines. The chunk of a boundary is the two lines about
it; a line of more than half of ``min_words`` words is a chunk of its own besides. Three repeated lines in a row therefore
hold the same chunk in all texts, and so does any passage of over ``min_words`` words, whatever stands about them. Two short
lines that repeat without their neighbours are found only where their boundary stands in both texts.

Of chunks with the same key the first, by (id, line number), stays. Every other one is grown by the non-blank line before and
the one after it where these equal those of the first; more isn't needed, as a line further on is in the next chunk. Grown
chunks that continue each other beside the same first text are one region. It goes if each of its chunks has two lines or
more, or over ``min_words`` words, and it is, byte by byte, what stands in the first text. Every removed line equals a
line at a smaller position, so one copy of everything stays.

Null texts stay null, an empty text is one empty line, blank lines go only between removed ones. Rows without an id lose
nothing and rows that share an id count as one place: equal chunks at the same line of them all stay, and each text of a
shared id is compared by itself. Other columns pass through unchanged; n_lines and removed replace columns of the same name,
and names that begin with an underscore are kept for the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import others, pin, stored

MIN_WORDS = 50
#: A line with anything but white space.
FILLED = r"[^\x20\x09-\x0D]"
#: Keys with more than this share of all chunks are at most so many; their first copies are broadcast.
HOT_KEYS = 1000
#: So many repeats of one chunk at most meet the kept text in one key.
COPIES = 1000


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " ", "")) + 1


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start, end, begin, finish, key, before, after, single, words) for each chunk of the texts.

    Lines [start, end), or [begin, finish) with the non-blank line on both sides (null at an end). key, before and after are
    hashes of the chunk and of what it may grow by; single says that it is one line, of so many words.
    """
    d = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.split(text_col, "\n", -1).alias("lines"))
    filled = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(FILLED))
    d = pin(d, "_id", h=F.transform("lines", lambda x: F.md5(x)), words=F.transform("lines", _words), full=filled)

    def part(start, end):
        return F.slice("h", start + 1, end - start)

    rolled = F.transform(F.slice("full", 2, F.size("full")), lambda j, k: F.md5(F.array_join(part(F.get("full", k), j + 1), "")))
    d = pin(d, "_id", "h", "words", "full", rolled=rolled)

    def boundary(c):
        left, right = F.get("rolled", c["at"] - 1), F.get("rolled", c["at"] + 1)
        return F.coalesce(c["key"] <= left, F.lit(False)) | F.coalesce(c["key"] <= right, F.lit(False)) | (left.isNull() & right.isNull())

    pairs = F.filter(F.transform("rolled", lambda r, k: F.struct(k.alias("at"), (k + 1).alias("last"), r.alias("key"))), boundary)
    lines = F.filter(F.transform("full", lambda i, k: F.struct(k.alias("at"), k.alias("last"), F.get("h", i).alias("key"))), lambda c: F.get("words", F.get("full", c["at"])) > min_words // 2)
    spans = F.transform(
        F.concat(pairs, lines),
        lambda c: F.struct(
            F.get("full", c["at"]).alias("start"), (F.get("full", c["last"]) + 1).alias("end"), F.get("full", c["at"] - 1).alias("begin"),
            (F.get("full", c["last"] + 1) + 1).alias("finish"), F.unhex(c["key"]).alias("key"), (c["at"] == c["last"]).alias("single"),
        ),
    )
    d = pin(d, "_id", "h", "words", spans=spans)
    before = lambda c: F.when(c["begin"].isNotNull(), F.xxhash64(part(c["begin"], c["start"])))
    after = lambda c: F.when(c["finish"].isNotNull(), F.xxhash64(part(c["end"], c["finish"])))
    names = ("start", "end", "begin", "finish", "key", "single")
    return d.select("_id", F.inline(F.transform("spans", lambda c: F.struct(*[c[k].alias(k) for k in names], before(c).alias("before"), after(c).alias("after"), F.get("words", c["start"]).alias("words")))))


def _with_first(chunks: DataFrame) -> DataFrame:
    """Each chunk of a key that stands more than once, with the number and the first of its kind.

    A key with over a HOT_KEYS-th of all chunks is one of less than HOT_KEYS, so the first copies of those are broadcast
    and their chunks aren't shuffled; the other keys are joined by an exchange.
    """
    place = F.struct("_id", "start", "end", "begin", "finish", "before", "after")
    first = stored(chunks.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "line-firsts")
    bound = chunks.count() / HOT_KEYS
    hot = F.broadcast(first.where(F.col("n") > bound))
    return chunks.join(hot, "key").unionByName(chunks.join(hot, "key", "left_anti").join(first.where(F.col("n") <= bound), "key"))


def _regions(chunks: DataFrame, min_words: int) -> DataFrame:
    """(id, from_id, shift, lo, hi, salts): lines [lo, hi) of a text should equal the lines at lo - shift of from_id's text."""
    back = F.coalesce(F.col("before") == F.col("first.before"), F.lit(False))
    on = F.coalesce(F.col("after") == F.col("first.after"), F.lit(False))
    again = _with_first(chunks).where((F.col("_id") != F.col("first._id")) | (F.col("start") != F.col("first.start")))
    again = again.where(~F.col("single") | back | on | (F.col("words") > min_words))
    span = F.struct(F.when(back, F.col("begin")).otherwise(F.col("start")).alias("lo"), F.when(on, F.col("finish")).otherwise(F.col("end")).alias("hi"))
    again = again.groupBy("_id", F.col("first._id").alias("from_id"), (F.col("start") - F.col("first.start")).alias("shift"))
    again = again.agg(F.collect_set(span).alias("spans"), F.ceil(F.max("n") / COPIES).cast("int").alias("salts"))
    keys = ("_id", "from_id", "shift", "salts")
    again = pin(again, *keys, at=F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda c: F.sequence(c["lo"], c["hi"] - 1))))))
    lows = F.filter("at", lambda x, k: F.coalesce(F.get("at", k - 1) != x - 1, F.lit(True)))
    highs = F.filter("at", lambda x, k: F.coalesce(F.get("at", k + 1) != x + 1, F.lit(True)))
    again = pin(again, *keys, lows=lows, highs=highs)
    return again.select(*keys, F.inline(F.transform("lows", lambda x, k: F.struct(x.alias("lo"), (F.get("highs", k) + 1).alias("hi")))))


def removed_regions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, regions): for each text the lines [lo, hi) that should go, each with the kept copy's bytes to compare with.

    The candidates come from narrow rows of hashes; only the text of kept copies moves, once per removed region. A copy that
    very many regions ask for is dealt out under several salts.
    """
    regions = stored(_regions(stored(line_chunks(docs, id_col, text_col, min_words), "line-chunks"), min_words), "line-regions")
    regions = regions.select("_id", "from_id", "lo", "hi", (F.col("lo") - F.col("shift")).alias("from"), (F.col("hi") - F.col("shift")).alias("to"), "salts")
    wanted = regions.groupBy("from_id", "from", "to").agg(F.max("salts").alias("salts"))
    wanted = wanted.groupBy("from_id").agg(F.collect_list(F.struct("from", "to", "salts")).alias("wanted"))
    # the same rows and columns that line_dedup joins later, so that one exchange of the texts serves both
    kept = pin(docs.select(id_col, text_col).join(wanted, F.col(id_col) == F.col("from_id")), "from_id", "wanted", _lines=F.split(text_col, "\n", -1))
    piece = lambda c: F.struct(c["from"].alias("from"), c["to"].alias("to"), c["salts"].alias("salts"), F.array_join(F.slice("_lines", c["from"] + 1, c["to"] - c["from"]), "\n").alias("copy"))
    kept = kept.select("from_id", F.inline(F.transform(F.filter("wanted", lambda c: c["to"] <= F.size("_lines")), piece)))
    # equal rows of an id give one copy
    kept = kept.groupBy("from_id", "from", "to", F.md5("copy")).agg(F.first("copy").alias("copy"), F.first("salts").alias("salts"))
    kept = kept.select("from_id", "from", "to", "copy", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salt = F.pmod(F.xxhash64("_id", "lo"), F.col("salts")).cast("int")
    found = regions.withColumn("salt", salt).join(kept, ["from_id", "from", "to", "salt"])
    return found.groupBy("_id").agg(F.collect_list(F.struct("lo", "hi", "copy")).alias("regions"))


def _without(docs: DataFrame, out: DataFrame, text_col: str, gone: Column) -> DataFrame:
    """out, which has _lines, with the lines numbered in gone taken out of text_col, and n_lines and removed."""
    out = pin(out, *docs.columns, "_lines", _removed=F.coalesce(gone, F.array().cast("array<int>")))
    out = pin(out, _kept=F.when(F.size("_removed") > 0, F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")))
    text = F.when(F.col("_kept").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    rest = [text.alias(c) if c == text_col else F.col(c) for c in others(docs, "n_lines", "removed")]
    return out.select(*rest, F.coalesce(F.when(F.col(text_col).isNotNull(), F.size("_lines")), F.lit(0)).alias("n_lines"), F.col("_removed").alias("removed"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated passages taken out of text_col, and the columns n_lines and removed (their numbers).

    n_lines is 0 for a null text. Removing nothing leaves a text byte for byte as it was.
    """
    named = docs.where(F.col(id_col).isNotNull())
    gone = removed_regions(named, id_col, text_col, min_words).withColumnsRenamed({"_id": "_gone_id", "regions": "_regions"})
    out = named.join(gone, F.col(id_col) == F.col("_gone_id"), "left")
    out = out.unionByName(docs.where(F.col(id_col).isNull()), allowMissingColumns=True)
    out = pin(out, _lines=F.split(text_col, "\n", -1))
    same = F.filter("_regions", lambda r: F.array_join(F.slice("_lines", r["lo"] + 1, r["hi"] - r["lo"]), "\n") == r["copy"])
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda r: F.sequence(r["lo"], r["hi"] - 1)))))
    return _without(docs, out, text_col, gone)


def op1_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, lines, list_filter(range(0, len(lines)), lambda i: regexp_matches(lines[i + 1], '{FILLED}')) AS f FROM d),
g AS (SELECT *, list_transform(range(1, len(f)), lambda k: md5(array_to_string(list_transform(lines[f[k] + 1:f[k + 1] + 1], lambda x: md5(x)), ''))) AS r FROM e),
c AS (SELECT doc_id, lines, f, unnest(list_filter(range(1, len(r) + 1), lambda k: coalesce(r[k] <= CASE WHEN k > 1 THEN r[k - 1] END, false)
        OR coalesce(r[k] <= r[k + 1], false) OR len(r) = 1)) AS a, a + 1 AS z FROM g
    UNION ALL SELECT doc_id, lines, f, unnest(list_filter(range(1, len(f) + 1), lambda k: length(lines[f[k] + 1]) - length(replace(lines[f[k] + 1], ' ', '')) + 1 > {MIN_WORDS // 2})) AS a, a AS z FROM g),
k AS (SELECT doc_id, a = z AS single, f[a] AS s, f[z] + 1 AS e, CASE WHEN a > 1 THEN f[a - 1] END AS lo, f[z + 1] + 1 AS hi, array_to_string(lines[f[a] + 1:f[z] + 1], chr(10)) AS chunk,
        CASE WHEN a > 1 THEN array_to_string(lines[f[a - 1] + 1:f[a]], chr(10)) END AS b, CASE WHEN z < len(f) THEN array_to_string(lines[f[z] + 2:f[z + 1] + 1], chr(10)) END AS n FROM c),
o AS (SELECT *, first_value({{'d': doc_id, 's': s, 'b': b, 'n': n}}) OVER (PARTITION BY single, chunk ORDER BY doc_id, s) AS head FROM k),
q AS (SELECT doc_id, single, coalesce(b = head.b, false) AS back, coalesce(n = head.n, false) AS onward, s, e, lo, hi, length(chunk) - length(replace(chunk, ' ', '')) + 1 AS w
    FROM o WHERE doc_id <> head.d OR s <> head.s),
p AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(CASE WHEN back THEN lo ELSE s END, CASE WHEN onward THEN hi ELSE e END))))) AS gone
    FROM q WHERE NOT single OR back OR onward OR w > {MIN_WORDS} GROUP BY doc_id),
t AS (SELECT x.doc_id, coalesce(len(d.lines), 0) AS n_lines, coalesce(gone, []) AS gone, d.lines, x.text FROM documents x LEFT JOIN d USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed, array_to_string(gone, ',') AS removed_lines,
    sha256(CASE WHEN len(gone) = 0 THEN coalesce(text, '')
        ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_contains(gone, i)), lambda i: lines[i + 1]), chr(10)), '') END) AS text_sha256
FROM t
"""  # noqa: S608
