"""Operator 10: quality rules.

A threshold table (:data:`RULES`) is compiled into one projection: every rule is a ratio of the text's
statistics with a lower and an upper bound.  Only built-in expressions run, so the whole operator is one
scan without a shuffle.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged
alike, row by row; columns of the input are never read besides the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import fresh, q, read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# (rule, numerator, denominator, lower bound, upper bound); a null bound is open.
RULES = [
    ("mean_word_length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    ("shouting_ratio", "n_upper", "word_chars", None, 0.5),
    ("digit_ratio", "n_digits", "word_chars", None, 0.3),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.3),
]

# Frequent function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
          "which one you were her all she there would their we him been has when who will more no if out so",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er "
          "hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou "
          "son aux ses mais comme on sa été cette elle ont nous vous leur deux être tout",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si "
          "sin sobre este ya entre cuando todo esta ser son dos también fue había era muy",
}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the sorted ``starts``."""
    pairs = F.transform(starts, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - p, F.lit(width))))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, v: acc + v)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def text_statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with helper columns, and the statistics named in :data:`RULES` as expressions over it.

    Repeated windows of three words are found by hash: most texts have none and stop at the distinct
    count; the others sort (hash, position) once and look at the neighbours.  Each step is a column of
    its own, so sorts and distinct counts run as generated code instead of inside lambdas.
    """
    names = ["body", "words", "hashes", "lines", "windows", "order", "sorted_h", "sorted_i", "again"]
    body, words, hashes, lines, windows, order, sorted_h, sorted_i, again = fresh(df, *names)
    staged = df.withColumn(body, F.coalesce(q(text), F.lit("")))
    staged = staged.withColumn(words, F.array_remove(F.split(q(body), "[\\x20\\x09-\\x0D]+"), ""))
    staged = staged.withColumn(lines, F.filter(F.split(q(body), "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")))
    t, w, ln = q(body), q(words), q(lines)
    staged = staged.withColumn(hashes, F.transform(w, lambda x: F.xxhash64(x)))
    hw = q(hashes)
    triples = F.transform(hw, lambda h, i: F.xxhash64(h, F.get(hw, i + 1), F.get(hw, i + 2)))
    staged = staged.withColumn(windows, F.when(F.size(w) < 3, _empty("bigint")).otherwise(
        F.slice(triples, F.lit(1), F.size(w) - 2)))
    placed = F.transform(q(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    staged = staged.withColumn(order, F.when(
        F.size(F.array_distinct(q(windows))) < F.size(q(windows)), F.sort_array(placed)).otherwise(
        _empty("struct<h:bigint,i:int>")))
    staged = staged.withColumn(sorted_h, F.transform(q(order), lambda x: x["h"])).withColumn(
        sorted_i, F.transform(q(order), lambda x: x["i"]))
    hs = q(sorted_h)
    staged = staged.withColumn(again, F.sort_array(F.array_compact(F.transform(hs, lambda h, i: F.when(
        (h == F.get(hs, i - 1)) | (h == F.get(hs, i + 1)), F.get(q(sorted_i), i))))))
    size = lambda c: F.size(c).cast("long")
    stop = sorted({s for v in STOP_WORDS.values() for s in v.split()})
    return staged, {
        "n_words": size(w),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": _count(t, "[#*$%&|<>]"),
        "n_dup_lines": size(ln) - size(F.array_distinct(ln)),
        "n_repeat_words": _covered(q(again), 3),
        "n_lines": size(ln),
        "n_stop_words": size(F.filter(w, lambda x: F.lower(x).isin(stop))),
        "n_upper": _count(t, "[A-ZÀ-ÖØ-Þ]"),
        "n_digits": _count(t, "[0-9]"),
        "n_bullet_lines": size(F.filter(ln, lambda s: F.ltrim(s).substr(1, 1).isin("-", "*", "•"))),
        "n_ellipsis_lines": size(F.filter(ln, lambda s: F.endswith(F.rtrim(s), F.lit("...")) | F.endswith(F.rtrim(s), F.lit("…")))),
    }


def quality(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Every row of ``df`` with its statistics, ``base_failed`` and ``kept``, as one struct column
    ``quality`` (``_quality`` if that name is taken)."""
    staged, stats = text_statistics(df, text)
    measured, out = fresh(staged, "measured", "quality")
    staged = staged.withColumn(measured, F.struct(*[v.alias(k) for k, v in stats.items()]))
    m = q(measured)
    ok = F.lit(True)
    for _, top, bottom, low, high in rules:
        # Compared by products, so a text without words or lines divides nothing by zero.
        if low is not None:
            ok = ok & (m[top] >= m[bottom] * F.lit(low))
        if high is not None:
            ok = ok & (m[top] <= m[bottom] * F.lit(high))
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    verdict = F.struct(*[m[k].alias(k) for k in stats], failed.alias("base_failed"), (~failed & ok).alias("kept"))
    # The generator keeps a later filter on the verdict above this projection; pushed below it, the filter would
    # repeat the statistics inside their own lambdas.
    return staged.select(*[q(c) for c in df.columns], F.explode(F.array(verdict)).alias(out))


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *[F.col("quality")[f].alias(f) for f in FIELDS])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their own columns."""
    judged = quality(docs)
    verdict = next(c for c in judged.columns if c not in docs.columns)
    return judged.where(q(verdict)["kept"]).select(*[q(c) for c in docs.columns])


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle_sql() -> str:
    stop = _sql_list(sorted({s for v in STOP_WORDS.values() for s in v.split()}))
    checks = []
    for _, top, bottom, low, high in RULES:
        if low is not None:
            checks.append(f"{top} >= {bottom} * {low!r}::DOUBLE")
        if high is not None:
            checks.append(f"{top} <= {bottom} * {high!r}::DOUBLE")
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
     a AS (SELECT doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
     p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM a WHERE len(w) >= 3),
     g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
     r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (
             SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c >= 2) GROUP BY doc_id),
     m AS (SELECT a.doc_id, len(w)::BIGINT AS n_words,
                  length(regexp_replace(x, '{blank}', '', 'g'))::BIGINT AS word_chars,
                  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
                  len(list_filter(w, lambda s: list_contains({stop}, lower(s))))::BIGINT AS n_stop_words,
                  length(regexp_replace(x, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper,
                  length(regexp_replace(x, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
                  len(list_filter(l, lambda s: regexp_matches(s, '^\\x20*[-*•]')))::BIGINT AS n_bullet_lines,
                  len(list_filter(l, lambda s: regexp_matches(s, '(\\.\\.\\.|…)\\x20*$')))::BIGINT AS n_ellipsis_lines
           FROM a LEFT JOIN r ON a.doc_id = r.doc_id),
     v AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(checks)} AS kept FROM v"""
