"""Quality rules with repetition coverage.

For each text the characters inside duplicated n-grams of words (several lengths n) and
inside duplicated lines are measured with rolling 64-bit hashes in numpy; a text whose
share of such characters is over the limit of any length is rejected (``repetition_failed``),
at any length of text alike.  Beside it stand the base rules and a limit of symbols to a word,
each with a column of its own.

Defined results: a null or empty text has no words and fails the base rules; texts of any
length are measured whole (a long one by itself); a share that equals its limit passes;
repeated rows are judged each; an empty table gives no rows; other columns are kept by
``judge``, whatever their names,.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _shared as S

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = 3
#: Largest share of a text's word characters inside duplicated n-grams (published limits for web text).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20
#: Most symbols to a word (a published limit for web text).
SYMBOL_LIMIT = 0.1
MIN_WORDS = 50
#: Words that are hashed at once; a longer text is hashed by itself.
BATCH_WORDS = 250_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a well-spread 64-bit value for each number."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(codes: np.ndarray, doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-word windows that occur twice or more in their own text.

    Equal hashes are held against the words themselves, so a collision never counts.
    """
    m = len(hashes)
    inside = doc[:m] == doc[n - 1 : n - 1 + m]
    own = hashes[inside]
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, hashes)
    at[at == len(twice)] = 0
    starts = np.flatnonzero(inside & (twice[at] == hashes))
    starts = starts[np.argsort(hashes[starts], kind="stable")]
    a, b = starts[:-1], starts[1:]
    same = hashes[a] == hashes[b]
    differ = same & (doc[a] != doc[b])
    for j in range(n):
        differ |= same & (codes[a + j] != codes[b + j])
    if differ.any():  # two windows share a hash: count these few exactly
        seen: dict[tuple, list[int]] = {}
        for i in np.sort(starts).tolist():
            seen.setdefault((int(doc[i]), *codes[i : i + n].tolist()), []).append(i)
        return np.array([i for own in seen.values() if len(own) > 1 for i in own], np.int64)
    return starts


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places of the words inside any of the n-word windows."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def coverage(texts: Sequence[str | None], lengths: Sequence[int] = (BASE, *NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts for each text; for each n-gram length n ``repeat_words_n``, the words inside
    windows found twice or more (first included), and ``repeat_chars_n``, the characters
    inside later occurrences of such windows."""
    k = len(texts)
    out = {name: np.zeros(k, np.int64) for name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars")}
    for n in lengths:
        out[f"repeat_words_{n}"], out[f"repeat_chars_{n}"] = np.zeros(k, np.int64), np.zeros(k, np.int64)
    vocabulary: dict[bytes, int] = {}
    codes, counts = [], []
    for i, text in enumerate(texts):
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        codes += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        counts.append(len(words))
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, SEPARATORS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        seen: set[str] = set()
        for line in text.split("\n"):
            if line.strip(SEPARATORS):
                out["n_lines"][i] += 1
                out["line_chars"][i] += len(line)
                if line in seen:
                    out["n_dup_lines"][i] += 1
                    out["dup_line_chars"][i] += len(line)
                seen.add(line)
    code = np.array(codes, np.int64)
    if not len(code):
        return out
    chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in vocabulary], np.int64)[code]
    doc = np.repeat(np.arange(k), counts)
    value, salt = _mix(code), _mix(doc + (1 << 40))
    hashes, have = value.copy(), 1
    with np.errstate(over="ignore"):
        for n in sorted(lengths):
            if n > len(code):
                break
            while have < n:  # roll on to the next length
                hashes = hashes[:-1] * _STEP + value[have:]
                have += 1
            starts = _repeated(code, doc, hashes + salt[: len(hashes)], n)
            if len(starts):
                inside = _covered(starts, n, len(code))
                out[f"repeat_words_{n}"] = np.bincount(doc[inside], minlength=k)
                # starts come by window, then by place: the first of each window is no repeat
                key = hashes[starts] + salt[starts]
                later = _covered(starts[1:][key[1:] == key[:-1]], n, len(code))
                out[f"repeat_chars_{n}"] = np.bincount(doc[later], weights=chars[later], minlength=k).astype(np.int64)
    return out


def verdicts(c: dict[str, np.ndarray], limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT, min_words: int = MIN_WORDS, symbol_limit: float = SYMBOL_LIMIT) -> dict[str, np.ndarray]:
    """base_failed; repetition_failed (a share of repeated characters is over its limit); symbols_failed; kept (none of them)."""
    base = (c["n_words"] < min_words) | (100 * c[f"repeat_words_{BASE}"] > 50 * c["n_words"])
    repeated = c["dup_line_chars"] > line_limit * c["line_chars"]
    for n, limit in limits.items():
        repeated |= c[f"repeat_chars_{n}"] > limit * c["word_chars"]
    symbols = c["n_symbols"] > symbol_limit * c["n_words"]
    return {"base_failed": base, "repetition_failed": repeated, "symbols_failed": symbols, "kept": ~(base | repeated | symbols)}


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"repeat_chars_{n} long" for n in NGRAM_LIMITS) + ", base_failed boolean, repetition_failed boolean, symbols_failed boolean, kept boolean"


def _groups(texts: list[str | None]):
    """Slices of about BATCH_WORDS words (by characters, six to a word)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > 6 * BATCH_WORDS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, ``quality`` (``quality_`` if there is one): a struct of the counts and verdicts. No shuffle."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def measured(column):
        import pandas as pd

        S.forget()
        texts, parts = [t if isinstance(t, str) else None for t in column], []
        for a, b in _groups(texts):
            c = coverage(texts[a:b])
            c |= {"n_repeat_words": c[f"repeat_words_{BASE}"], **verdicts(c)}
            parts.append(pd.DataFrame({n: c[n] for n in names}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: [] for n in names})

    inner, back = S.aside(docs, text_col)
    return back(inner.withColumn("quality", measured(F.col(f"`{text_col}`"))), "quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.pick(S.table(spark, sf_dir, "documents"), "doc_id", "text")
    return judge(docs).select("doc_id", "quality.*")


def keep_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go; the others' columns stay as they are."""
    inner, back = S.aside(docs, "text")
    return back(judge(inner).filter("quality.kept"))


def _oracle() -> str:
    word = r"[^\x20\x09-\x0D]+"
    parts, joins, counts, bad = [], [], [], []
    for n in (BASE, *NGRAM_LIMITS):
        parts.append(f"""
w{n} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n}))),
p{n} AS (SELECT doc_id, p, max((k > 1)::INT) AS later FROM (SELECT doc_id, k, unnest(range(i, i + {n})) AS p FROM w{n} WHERE c > 1) GROUP BY ALL),
s{n} AS (SELECT p{n}.doc_id, count(*) AS words, sum(CASE WHEN later = 1 THEN length(d.w[p]) ELSE 0 END) AS chars FROM p{n} JOIN d ON d.doc_id = p{n}.doc_id GROUP BY 1)""")
        joins.append(f"LEFT JOIN s{n} ON s{n}.doc_id = d.doc_id")
        if n != BASE:
            counts.append(f"coalesce(s{n}.chars, 0)::BIGINT AS repeat_chars_{n}")
            bad.append(f"repeat_chars_{n} > {NGRAM_LIMITS[n]!r}::DOUBLE * word_chars")
    return rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents), {", ".join(parts)},
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE regexp_matches(line, '{word}')),
ls AS (SELECT doc_id, count(*) FILTER (k > 1) AS n, coalesce(sum(length(line)) FILTER (k > 1), 0) AS chars, sum(length(line)) AS total FROM l GROUP BY 1),
r AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(ls.n, 0)::BIGINT AS n_dup_lines, coalesce(s{BASE}.words, 0)::BIGINT AS n_repeat_words, coalesce(ls.chars, 0)::BIGINT AS dup_line_chars, coalesce(ls.total, 0) AS line_chars, {", ".join(counts)}
  FROM d LEFT JOIN ls ON ls.doc_id = d.doc_id {" ".join(joins)}),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  dup_line_chars > {LINE_LIMIT!r}::DOUBLE * line_chars OR {" OR ".join(bad)} AS repetition_failed, n_symbols > {SYMBOL_LIMIT!r}::DOUBLE * n_words AS symbols_failed FROM r)
SELECT * EXCLUDE (line_chars), NOT (base_failed OR repetition_failed OR symbols_failed) AS kept FROM v
"""


ORACLE_SQL = _oracle()
