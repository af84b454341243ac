"""Cross-site boilerplate lines: HyperLogLog spread per line hash, exact counts near the threshold.

A line (split at line feeds, trimmed of ASCII white space, not empty) that stands on at least
``min_sites`` distinct sites is boilerplate; a line of fewer than ``SHORT_WORDS`` words needs
``SHORT_FACTOR`` times as many, since short lines are equal by chance, too.  Its first
occurrence (smallest doc_id, then place) stays, so a group of copies keeps one whole text;
every other occurrence is removed.

Lines are counted per line hash (two 64-bit hashes) first; those with fewer occurrences than
sites asked for are out.  The others' distinct sites are sketched with HyperLogLog sketches
that merge by aggregation; only lines whose estimate lies within ``BAND`` times the
threshold, either way, are counted exactly, from (line, site) pairs of just those lines.

Defined results: a null text has no lines and stays null; a null site counts as one site of
its own; a null doc_id comes before all others; of repeated rows with the same doc_id and
text each keeps what the first keeps; of equal lines in one document the upper comes first;
texts and lines of any length are taken whole; empty tables give no rows; other columns are
kept, whatever their names (new ones get underscores if theirs are taken).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

MIN_SITES = 5
SHORT_WORDS, SHORT_FACTOR = 4, 2
#: log2 of a sketch's buckets: a relative error of about 2.3 % (counts below some dozens are exact).
LG_K = 11
#: Estimates from threshold / band to threshold * band are counted exactly.
BAND = 1.5


def _line(c):
    return F.regexp_replace(c, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", "")


def _numbered(docs: DataFrame) -> DataFrame:
    """A row for each line that counts of docs (_id, _text, _site): its document's id and hash, its place and two hashes."""
    lines = F.transform(F.split("_text", "\n"), lambda x, i: F.struct(i.alias("at"), _line(x).alias("line")))
    lines = F.filter(lines, lambda x: x["line"] != "")
    return docs.select("_id", F.xxhash64("_text").alias("_own"), F.coalesce("_site", F.lit("\x00none")).alias("_site"), F.explode(lines).alias("x")).select(
        "_id", "_own", "_site", F.col("x.at").alias("_at"), F.xxhash64("x.line").alias("_h"), F.xxhash64(F.lit(1), "x.line").alias("_g"),
        (F.size(F.split("x.line", r"[ \t\x0B\f\r]+", SHORT_WORDS)) < SHORT_WORDS).alias("_short"),
    )


def near_sites(lines: DataFrame, near: DataFrame, total: int) -> DataFrame:
    """The exact number of distinct sites of the lines in ``near`` (_h, _g, n): pairs are made of their occurrences alone."""
    own = S.join_keys(lines.select("_h", "_g", "_site"), near, ["_h", "_g"], "n", total)
    return own.distinct().groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("sites"))


def boilerplate(lines: DataFrame, uri: str, min_sites: int = MIN_SITES) -> tuple[DataFrame, int]:
    """The boilerplate among the hashed lines with its number of rows; and the number of lines."""
    many = lines.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("_short"), SHORT_FACTOR * min_sites).otherwise(min_sites)).alias("need"))
    many = S.written(many.filter(F.col("n") >= F.col("need")), f"{uri}/many")  # fewer occurrences can't stand on that many sites
    total = S.row_count(lines)
    sketched = S.join_keys(lines.select("_h", "_g", "_site"), many.select("_h", "_g", "n"), ["_h", "_g"], "n", total).groupBy("_h", "_g")
    sketched = sketched.agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("about"))
    spread = S.written(sketched.join(many, ["_h", "_g"]).filter(F.col("about") >= F.floor(F.col("need") / BAND)), f"{uri}/spread")
    near = S.written(spread.filter(F.col("about") <= F.col("need") * BAND).select("_h", "_g", "n"), f"{uri}/near")
    exact = near_sites(lines, near, total)
    found = spread.join(exact, ["_h", "_g"], "left").withColumn("n_sites", F.coalesce("sites", "about")).filter(F.col("n_sites") >= F.col("need"))
    return S.written(found.select("_h", "_g", "n_sites", "n"), f"{uri}/found"), total


def remove_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``removed`` (places of removed lines, ascending) and ``clean_text``."""
    uri = S.shared_dir(docs.sparkSession)
    docs, back = S.aside(docs, id_col, text_col, site_col)
    lines = S.written(_numbered(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{site_col}`").alias("_site"))), f"{uri}/lines")
    found, total = boilerplate(lines, uri, min_sites)
    # All occurrences of boilerplate, and of each line the first.
    hits = S.written(S.join_keys(lines.drop("_site", "_short"), found.select("_h", "_g", "n"), ["_h", "_g"], "n", total), f"{uri}/hits")
    first = hits.groupBy("_h", "_g").agg(F.min(F.struct("_id", "_own", "_at")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = S.written(first, f"{uri}/first")
    is_first = (F.col("first._id").eqNullSafe(F.col("_id"))) & (F.col("first._own").eqNullSafe(F.col("_own"))) & (F.col("first._at") == F.col("_at"))
    gone = S.join_keys(hits, first, ["_h", "_g"], "n", total).filter(~is_first).groupBy("_id", "_own").agg(F.sort_array(F.collect_set("_at")).alias("removed"), F.count(F.lit(1)).alias("n"))
    # A document's key is its id and its text's hash; rows that repeat both lose the same lines, and may be many.
    gone = gone.select(F.col("_id").isNull().alias("_k0"), F.coalesce("_id", F.lit(0)).alias("_k1"), F.col("_own").alias("_k2"), "removed", (F.col("n") / F.size("removed")).cast("long").alias("n"))
    gone = S.written(gone, f"{uri}/gone")
    S.drop(*[f"{uri}/{t}" for t in ("lines", "many", "spread", "near", "found", "hits", "first")])
    own = F.col(f"`{id_col}`")
    keyed = docs.withColumns({"_k0": own.isNull(), "_k1": F.coalesce(own, F.lit(0)), "_k2": F.xxhash64(F.col(f"`{text_col}`"))})
    out = S.join_keys(keyed, gone, ["_k0", "_k1", "_k2"], "n", total, keep=True, few=0).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))

    def without(own):
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("removed")), lambda i: F.get(own, i)), "\n")

    # The lines are bound once: inside the inner lambda the text would be split for every line.
    cut = F.transform(F.array(F.split(F.col(f"`{text_col}`"), "\n")), without)[0]
    return back(out.withColumn("clean_text", F.when(F.size("removed") == 0, F.col(f"`{text_col}`")).otherwise(cut)), "removed", "clean_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.pick(S.table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    out = remove_lines(docs)
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.md5("clean_text").alias("text_md5"), F.length("clean_text").cast("long").alias("n_chars"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boilerplate goes from the texts; a document of nothing else goes too."""
    inner, back = S.aside(docs, "doc_id", "text", "source")
    out = remove_lines(inner)
    gone = (F.size("removed") > 0) & (F.regexp_replace("clean_text", r"[ \t\n\x0B\f\r]+", "") == "")
    return back(out.filter(~gone | F.col("text").isNull()).withColumn("text", F.when(F.size("removed") > 0, F.col("clean_text")).otherwise(F.col("text"))))


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, source, u.pos AS pos, regexp_replace(u.line, '^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$', '', 'g') AS line
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos) u
), long_lines AS (
  SELECT *, CASE WHEN len(regexp_split_to_array(line, '[ \t\x0B\f\r]+')) < {SHORT_WORDS} THEN {SHORT_FACTOR * MIN_SITES} ELSE {MIN_SITES} END AS need FROM lines WHERE line <> ''
), found AS (
  SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM long_lines
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= any_value(need)
), gone AS (
  SELECT l.doc_id, l.pos FROM long_lines l JOIN found f ON l.line = f.line WHERE NOT (f.first.doc_id = l.doc_id AND f.first.pos = l.pos)
), left_over AS (
  SELECT l.doc_id, string_agg(u.line, chr(10) ORDER BY u.pos) AS clean
  FROM documents l, LATERAL (SELECT unnest(string_split(l.text, chr(10))) AS line, generate_subscripts(string_split(l.text, chr(10)), 1) - 1 AS pos) u
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = u.pos WHERE g.doc_id IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
  md5(CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(o.clean, '') END) AS text_md5,
  CAST(length(CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(o.clean, '') END) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) n ON n.doc_id = d.doc_id LEFT JOIN left_over o ON o.doc_id = d.doc_id
"""
