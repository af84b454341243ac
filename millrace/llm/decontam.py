"""Benchmark decontamination: hash set of normalised test n-grams, scanned over training windows.

The benchmark's windows of 13 words (a shorter item is one window) are hashed to 64 bits, and
the hashes packed into two tables of bits that go with the tasks: 16 bits a window, up to a
bound of ``MOST_BITS``.  Documents' windows are looked up in them inside each row - first by the
window's first and last word, then by all its words - and hits are verified against the
windows themselves by a join.  The tables never decide: fuller ones only let more windows
through to the join, so the way is the same whatever the benchmark's size.  No document is
shuffled; only hits and counts are.

Native: DataFrame functions only.  Defined results: a null text has no words and is not
contaminated; a null item text has no windows; windows of an item with a null item_id hit
but are not listed; repeated items count once; repeated documents, and those with a null
doc_id, give a row each; texts of any length are scanned whole; empty tables give no rows or
no hits; other columns are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

N = 13
#: Share of a document's words inside benchmark windows, as 1 / SHARE, from which it is contaminated.
SHARE = 20
#: A table has 16 bits a window or more, from 2 ** 10 up to 2 ** 24 bits (2 MB).
LEAST_BITS, MOST_BITS = 10, 24
#: The windows' texts go to every task up to this size; larger ones are joined by shuffle, a frequent window's hits by so many tasks.
BROADCAST_BYTES, SALTS = 64_000_000, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text column: A-Z lower-cased, split at ASCII characters that are neither digits nor letters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _all(h, i, n):
    return F.xxhash64(*[F.get(h, i + j) for j in range(n)])


def _bit(table, word, bit):
    """Whether a bit is set in a table of 64-bit words."""
    return F.getbit(F.get(table, word.cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def _looked_up(n, ends, wholes, bits):
    def hit(i):
        whole = _all(F.col("h"), i, n)
        # The first test needs no further hash: the first word's chooses a word of the table, the last word's a bit.
        return _bit(ends, F.get("h", i).bitwiseAND(F.lit((1 << bits - 6) - 1)), F.get("h", i + (n - 1))) & _bit(wholes, F.shiftright(whole.bitwiseAND(F.lit((1 << bits) - 1)), 6), whole)

    return hit


def _cut_out(n):
    return lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("w", i + 1, n), " ").alias("window"))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id (string), size, window (its words, space-joined), and hashes: of the first and the last word, and of all."""
    own = S.pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    own = own.withColumn("size", F.least(F.size("w"), F.lit(n)))
    each = own.select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("w"))
    h = F.transform("w", lambda x: F.xxhash64(x))
    each = each.withColumn("h", h).withColumn("window", F.array_join("w", " "))
    whole = F.lit(None).cast("long")
    for k in range(n, 0, -1):
        whole = F.when(F.col("size") == k, _all(F.col("h"), F.lit(0), k)).otherwise(whole)
    return each.select("item_id", "size", "window", F.get("h", F.lit(0)).alias("first"), F.element_at("h", -1).alias("last"), whole.alias("whole")).distinct()


def packed(found: DataFrame) -> tuple[list[int], list[int], int]:
    """The tables of the windows' ends and of their hashes, as signed 64-bit words, and a table's number of bits as a power of two.

    At most 2 ** (MOST_BITS - 6) rows of two numbers a table reach the driver.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * S.row_count(found)).bit_length()))
    places = {
        "ends": (F.col("first").bitwiseAND(F.lit((1 << bits - 6) - 1)), F.col("last")),
        "wholes": (F.shiftright(F.col("whole").bitwiseAND(F.lit((1 << bits) - 1)), 6), F.col("whole")),
    }
    tables = []
    for word, bit in places.values():
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
        table = [0] * (1 << (bits - 6))
        for r in found.groupBy(word.cast("int").alias("word")).agg(F.bit_or(one).alias("v")).collect():
            table[r["word"]] = r["v"]
        tables.append(table)
    return *tables, bits


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (row, doc_id, w) with n_words and ``c``, the places and texts of the windows that the table lets through, for w."""
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # at most n numbers
    *tables, bits = packed(found)
    # One literal a table, folded by the optimiser; not a Python call for each number.
    ends, wholes = (F.split(F.lit(",".join(map(str, t))), ",").cast("array<bigint>") for t in tables)
    hashed = docs.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    lists = []
    for k in sizes:
        starts = F.when(F.size("h") >= k, F.sequence(F.lit(0), F.size("h") - k)).otherwise(F.array().cast("array<int>"))
        lists.append(F.transform(F.filter(starts, _looked_up(k, ends, wholes, bits)), _cut_out(k)))
    hits = F.concat(*lists) if lists else F.array().cast("array<struct<at:int,size:int,window:string>>")
    return hashed.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), hits.alias("c"))


def verified(hits: DataFrame, found: DataFrame) -> DataFrame:
    """Of ``hits`` (row, at, size, window) those whose window is the benchmark's, with its item_id."""
    named = found.select("window", "item_id").distinct()
    size = named.agg(F.sum(F.length("window") + 64).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        return hits.join(F.broadcast(named), "window")
    salted = hits.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return salted.join(named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["window", "_salt"]).drop("_salt")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """A row for each document: doc_id, row, n_words, hit (places of hit words, ascending), items (sorted strings)."""
    own = S.pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    return scan_words(own, benchmark, n)


def _contaminated():
    n_hit = F.size("hit").cast("long")
    return (n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, how: str = "documents", n: int = N) -> DataFrame:
    """``docs`` without contaminated documents, or (``how="spans"``) with the hit words' spans cut out of the texts.

    Spans are cut from a contaminated document's normalised words, which are then space-joined.
    """
    uri = S.shared_dir(docs.sparkSession)
    inner, back = S.aside(docs, "doc_id", "text")
    # What is found depends on the text alone, so two hashes of it (128 bits) name it: neither texts nor numbers of rows are kept.
    key = {"_h": F.xxhash64("text"), "_g": F.xxhash64(F.lit(1), "text")}
    own = inner.select(F.monotonically_increasing_id().alias("row"), F.struct(*[v.alias(k) for k, v in key.items()]).alias("doc_id"), words(F.col("text")).alias("w"))
    found = scan_words(own, benchmark, n, f"{uri}/scan").filter(_contaminated()).groupBy("doc_id._h", "doc_id._g")
    found = S.written(found.agg(F.any_value("hit").alias("hit"), F.count(F.lit(1)).alias("n")), f"{uri}/found")
    S.drop(f"{uri}/scan")
    rows = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    if how == "documents":
        marked = S.join_keys(inner.withColumns(key), found.select("_h", "_g", F.lit(True).alias("gone"), "n"), ["_h", "_g"], "n", rows, keep=True)
        return back(marked.filter("gone IS NULL"))
    marked = S.join_keys(inner.withColumns(key), found, ["_h", "_g"], "n", rows, keep=True, few=10_000)

    def without(own):
        left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("hit"))
        return F.array_join(F.transform(left, lambda i: F.get(own, i)), " ")

    cut = F.transform(F.array(words(F.col("text"))), without)[0]
    return back(marked.withColumn("text", F.when(F.col("hit").isNotNull(), cut).otherwise(F.col("text"))))


def scan_words(own: DataFrame, benchmark: DataFrame, n: int = N, uri: str | None = None) -> DataFrame:
    """As ``scan``, for rows (row, doc_id, w) that have their numbers and words; its tables are below ``uri``."""
    uri = uri or S.shared_dir(own.sparkSession)
    found = S.written(windows(benchmark, n), f"{uri}/windows")
    each = S.written(candidates(own, found), f"{uri}/scanned")
    # Rows with hits go their own way; those without only give their counts.
    hits = verified(each.filter(F.size("c") > 0).select("row", F.explode("c").alias("c")).select("row", "c.*"), found)
    joined = hits.groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("spans"), F.collect_set("item_id").alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))
    joined = joined.select("row", places.alias("hit"), F.array_sort("items").alias("items"))
    out = each.select("row", "doc_id", "n_words").join(joined, "row", "left")
    return out.select("row", "doc_id", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"),
    )


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    return clean(docs, S.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), {N}) AS size, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM b WHERE len(w) > 0)
), hits AS (
  SELECT x.doc_id, x.i, bw.size, bw.item_id FROM (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
  ) x JOIN bw ON bw.win = x.win
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""
