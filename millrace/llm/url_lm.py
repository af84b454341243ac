"""URL filter: rules by host and path, then a character language-model ratio.

Two variable-order Markov models (contexts of 0 to 3 characters) are estimated from the URLs
that a rule accepts and those that a rule rejects.  Each order is smoothed by the one below,
which weighs as many characters as different ones have followed the context (Witten and
Bell): much after a rare context, little after a frequent one.  A URL without a rule is judged
by the mean over its characters of the log ratio of the two models, against a threshold of
least balanced error.  That is calibrated on a share of the rule-judged URLs (by a digest of
the URL, so copies stay together) that the models haven't seen.

Native: DataFrame functions only.  Characters are folded to an alphabet of 41 symbols, so
the model has at most 41^4 rows (2.8 million) of a 4-gram and a number whatever the corpus;
that bound, some 130 MB at worst, is why it may be broadcast.  Log ratios are whole multiples
of 2^-20, so sums don't depend on the order of rows.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is
judged by the model on its characters (none: its end mark); URLs of any length are scored
whole; a score that equals the threshold is allowed; repeated rows give a row each; a class
without any URL to learn from: all URLs without a rule are allowed; a class without any to
calibrate on: the threshold is 0; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); the longest host and path that fits wins.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 3
SYMBOLS = 41
#: First hexadecimal digits of the URLs' MD5 whose rule-judged URLs calibrate and don't train: a quarter of them.
HELD_OUT = "0123"
SCALE = 1 << 20
#: Scores are counted in bins of a hundredth from -10 to 10 for the calibration.
BINS, EDGE = 100, 1000


def parts(url, rules=RULES):
    """Columns host, path, rule and its verdict of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ordered)], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ordered)], F.lit(None).cast("string"))
    return host, path, rule, verdict


def grams(url):
    """The array of a URL's 4-grams over the folded alphabet, one for each character and the end mark."""
    folded = F.translate(F.coalesce(url, F.lit("")), UPPER + "123456789", LOWER + "0" * 9)
    folded = F.regexp_replace(folded, r"[^a-z0./\-_?=&%#:+~]", "*")
    padded = F.concat(F.lit("^" * ORDER), folded, F.lit("$"))

    def cut(chars):  # by place in an array: a substring would be looked for from the URL's start each time
        return F.transform(F.sequence(F.lit(0), F.size(chars) - ORDER - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(ORDER + 1)]))

    # Bound by a lambda, so that the URL is folded and split once.
    return F.transform(F.array(F.split(padded, "")), cut)[0]


def model(judged: DataFrame) -> DataFrame:
    """gram, ratio: the scaled log ratio of each 4-gram's last character given the three before it.

    ``judged`` has columns url and label (allow, block or null).
    """
    each = judged.select("label", F.explode(grams(F.col("url"))).alias("gram"))
    counts = each.groupBy("gram").agg(F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("b"))
    counts = S.written(counts, f"{S.shared_dir(judged.sparkSession)}/grams")
    out, pa, pb = counts.select("gram"), F.lit(1.0 / SYMBOLS), F.lit(1.0 / SYMBOLS)
    for k in range(ORDER + 1):
        # Every table here has at most SYMBOLS ** (ORDER + 1) rows.
        own = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias(f"g{k}")).agg(F.sum("a").alias(f"a{k}"), F.sum("b").alias(f"b{k}"))
        # A context's occurrences, and how many different characters have followed it (at least 1).
        seen = [F.greatest(F.sum((F.col(f"{c}{k}") > 0).cast("long")), F.lit(1)).alias(f"t{c}{k}") for c in "ab"]
        context = own.groupBy(F.substring(f"g{k}", 1, k).alias(f"c{k}")).agg(F.sum(f"a{k}").alias(f"ca{k}"), F.sum(f"b{k}").alias(f"cb{k}"), *seen)
        out = out.withColumn(f"g{k}", F.substring("gram", ORDER + 1 - k, k + 1)).withColumn(f"c{k}", F.substring("gram", ORDER + 1 - k, k))
        out = out.join(F.broadcast(own), f"g{k}").join(F.broadcast(context), f"c{k}")
        pa = (F.col(f"a{k}") + F.col(f"ta{k}") * pa) / (F.col(f"ca{k}") + F.col(f"ta{k}"))
        pb = (F.col(f"b{k}") + F.col(f"tb{k}") * pb) / (F.col(f"cb{k}") + F.col(f"tb{k}"))
    return out.select("gram", F.round((F.log(pa) - F.log(pb)) * SCALE).cast("long").alias("ratio"))


def calibrate(scored: DataFrame) -> float | None:
    """The threshold of least balanced error on held-out rule-judged rows; None if a class has none to learn from.

    ``scored`` has columns score, label and held (whether it didn't train).  At most
    2 * EDGE + 1 bins for each class reach the driver.
    """
    bin_ = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.floor(F.col("score") * BINS)))
    rows = scored.filter("label IS NOT NULL").groupBy("held", "label", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    if {r["label"] for r in rows if not r["held"]} != {"allow", "block"}:
        return None
    below, allow, block = {}, 0, 0
    for r in (r for r in rows if r["held"]):
        below.setdefault(r["bin"], {"allow": 0, "block": 0})[r["label"]] += r["n"]
        allow, block = allow + r["n"] * (r["label"] == "allow"), block + r["n"] * (r["label"] == "block")
    if not allow or not block:
        return 0.0
    best, low_allow, low_block = None, 0, 0
    for b in range(-EDGE, EDGE + 1):  # allowed from bin b on
        error = low_allow * block + (block - low_block) * allow
        if best is None or (error, abs(b), b) < best:
            best = (error, abs(b), b)
        n = below.get(b, {"allow": 0, "block": 0})
        low_allow, low_block = low_allow + n["allow"], low_block + n["block"]
    return best[2] / BINS


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score (mean log ratio) and verdict of every row."""
    host, path, rule, verdict = parts(F.col("url"), rules)
    rows = S.pick(pages, "page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("label"))
    rows = rows.withColumn("held", F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(*HELD_OUT))
    ratios = model(rows.select("url", F.when(~F.col("held"), F.col("label")).alias("label")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    each = numbered.select("row", "page_id", "host", "path", "rule", "label", "held", F.explode(grams(F.col("url"))).alias("gram"))
    # All of a row's grams are in one partition: its sum is complete before the shuffle.
    summed = each.join(F.broadcast(ratios), "gram").groupBy("row", "page_id", "host", "path", "rule", "label", "held").agg(F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("n"))
    scored = summed.withColumn("score", F.col("total") / F.col("n") / SCALE).drop("row", "total", "n")
    scored = S.written(scored, f"{S.shared_dir(pages.sparkSession)}/scored")
    threshold = calibrate(scored)
    free = F.lit("allow") if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("label", free)).drop("label", "held")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(S.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for h, p, _ in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(fits, ordered))
    label = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered))
    tables, joins, pa, pb = [], [], f"(1.0::DOUBLE / {SYMBOLS})", f"(1.0::DOUBLE / {SYMBOLS})"
    for k in range(ORDER + 1):
        tables.append(f"o{k} AS (SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1)")
        tables.append(f"c{k} AS (SELECT substr(g, 1, {k}) AS c, sum(a) AS a, sum(b) AS b, greatest(count(*) FILTER (a > 0), 1) AS ta, greatest(count(*) FILTER (b > 0), 1) AS tb FROM o{k} GROUP BY 1)")
        joins.append(f"JOIN o{k} ON o{k}.g = substr(x.gram, {ORDER + 1 - k}, {k + 1}) JOIN c{k} ON c{k}.c = substr(x.gram, {ORDER + 1 - k}, {k})")
        pa = f"((o{k}.a + c{k}.ta * {pa}) / (c{k}.a + c{k}.ta))"
        pb = f"((o{k}.b + c{k}.tb * {pb}) / (c{k}.b + c{k}.tb))"
    return rf"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT row_number() OVER () AS id, *, CASE {rule} END AS rule, CASE {label} END AS label, contains('{HELD_OUT}', substr(md5(coalesce(url, '')), 1, 1)) AS held,
    regexp_replace(translate(coalesce(url, ''), '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./\-_?=&%#:+~]', '*', 'g') AS folded FROM split
), each AS (
  SELECT id, CASE WHEN NOT held THEN label END AS label, substr('{"^" * ORDER}' || folded || '$', u.i::BIGINT, {ORDER + 1}) AS gram FROM judged, LATERAL (SELECT unnest(range(1, length(folded) + 2)) AS i) u
), counts AS (
  SELECT gram, sum(CASE WHEN label = 'allow' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN label = 'block' THEN 1 ELSE 0 END)::DOUBLE AS b FROM each GROUP BY 1
), {", ".join(tables)}, ratios AS (
  SELECT x.gram, round((ln({pa}) - ln({pb})) * {SCALE})::BIGINT AS ratio FROM counts x {" ".join(joins)}
), scores AS (
  SELECT id, sum(ratio)::DOUBLE / count(*) / {SCALE} AS score FROM each JOIN ratios USING (gram) GROUP BY id
), scored AS (SELECT j.*, score FROM judged j JOIN scores USING (id)
), bins AS (
  SELECT greatest(-{EDGE}, least({EDGE}, floor(score * {BINS})))::INT AS bin, sum((label = 'allow')::INT) AS a, sum((label = 'block')::INT) AS b FROM scored WHERE label IS NOT NULL AND held GROUP BY 1
), total AS (SELECT sum(a) AS a, sum(b) AS b FROM bins
), learnt AS (SELECT count(DISTINCT label) = 2 AS both_classes FROM judged WHERE NOT held
), tries AS (
  SELECT t.bin, (SELECT coalesce(sum(a), 0) FROM bins WHERE bins.bin < t.bin) * total.b + (total.b - (SELECT coalesce(sum(b), 0) FROM bins WHERE bins.bin < t.bin)) * total.a AS error
  FROM (SELECT unnest(range(-{EDGE}, {EDGE + 1})) AS bin) t, total WHERE total.a > 0 AND total.b > 0
), best AS (SELECT bin::DOUBLE / {BINS} AS threshold FROM tries ORDER BY error, abs(bin), bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= CASE WHEN NOT (SELECT both_classes FROM learnt) THEN -1e300 ELSE coalesce((SELECT threshold FROM best), 0) END THEN 'allow' ELSE 'block' END) AS verdict FROM scored
"""


ORACLE_SQL = _oracle()
