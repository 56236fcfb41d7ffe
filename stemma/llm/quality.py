"""Host-level quality rules, with DataFrame functions only.

Each document gets counts from its whole text; rules on the counts fail or pass it. Failures are summed by host (one row
for each host, combined before the shuffle), each host's failure rate is shrunk towards the corpus rate by a beta prior
fitted to all hosts by the method of moments, and hosts whose shrunk rate is over a limit lose their documents.

Defined cases: a null text has no words (and so fails the rule on word counts); a null host gets no host verdict; equal
rows are counted and returned each; an empty table gives no rows; other columns are ignored or, by keep_documents(), kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import SPACE, materialize, small_side

#: Rule name -> SQL predicate on the counts that says that a document fails. The first two make base_failed.
BASE_RULES = {
    "few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
}
HOST_RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Hosts whose shrunk failure rate is higher are rejected.
MAX_HOST_RATE = 0.8
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 10_000.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words() -> Column:
    """Words in three-word windows that occur twice or more: sort the windows' hashes with their places, keep the places
    with an equal neighbour, and add up what each window covers beyond the one before."""
    windows = F.sort_array(F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    return windows


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the counts of each whole text (COUNTS and n_lines)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("_w", F.array_remove(F.split(t, SPACE + "+"), ""))
        .withColumn("_l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_g", _repeat_words())
        .withColumn("_p", F.sort_array(F.array_compact(F.transform("_g", lambda z, k: F.when((z["h"] == F.get("_g", k - 1)["h"]) | (z["h"] == F.get("_g", k + 1)["h"]), z["i"])))))
        .withColumns(
            {
                "n_words": F.size("_w").cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
                "n_lines": F.size("_l").cast("long"),
                "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
                "n_repeat_words": F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x).cast("long"),
            }
        )
        .drop("_w", "_l", "_g", "_p")
    )


def host_rates(counted: DataFrame, host: str = "source", rules: dict[str, str] | None = None) -> DataFrame:
    """host, n, failed, rate: failures by host and the rate shrunk by the corpus-wide beta prior."""
    fails = F.expr(" OR ".join(f"({x})" for x in (rules or HOST_RULES).values()))
    hosts = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(fails.cast("long")).alias("failed"))
    hosts = materialize(hosts, "hosts")
    mean = hosts.agg(F.sum("failed") / F.sum("n")).scalar()
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, F.lit(2))) / F.sum("n")).scalar()
    # Rates of hosts with few documents vary by chance alone: of the spread, that share is taken off before the moments give the prior.
    chance = hosts.agg(F.count("*") / F.sum("n")).scalar()
    between = F.try_divide(spread - mean * (1 - mean) * chance, 1 - chance)
    strength = F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.when(between > 1e-12, mean * (1 - mean) / F.nullif(between, F.lit(0.0)) - 1).otherwise(F.lit(STRENGTH[1]))))
    return hosts.withColumn("rate", (F.col("failed") + strength * mean) / (F.col("n") + strength))


def judge(counted: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """counted with base_failed and kept. counted is read twice: give a written table."""
    rejected = materialize(host_rates(counted, host).where(F.col("rate") > max_host_rate).select("host"), "rejected")
    base = F.expr(" OR ".join(f"({x})" for x in BASE_RULES.values()))
    joined = counted.withColumn("base_failed", base).join(small_side(rejected.withColumn("_bad", F.lit(True))), F.col(host) == F.col("host"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("host", "_bad")


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of docs (doc_id, text, source)."""
    counted = materialize(with_counts(docs.select("doc_id", "text", "source")).drop("text"), "counts")
    return judge(counted).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules and their host's verdict keep, with the columns of docs."""
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"), F.col("source").alias("_source"))
    counted = materialize(with_counts(renamed, "_text").drop("_text"), "counted")
    return judge(counted, "_source").where("kept").select("_doc.*")


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
pos AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM words),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i + 1], ws[i + 2], ws[i + 3]) AS c FROM pos WHERE i + 3 <= len(ws)),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS j FROM tri WHERE c > 1) GROUP BY r),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines AS other FROM m),
h AS (SELECT source AS host, count(*) AS n, sum((base_failed OR other)::INT) AS failed FROM f WHERE source IS NOT NULL GROUP BY 1),
p AS (SELECT sum(failed) / sum(n) AS mu FROM h),
u AS (SELECT any_value(mu) AS mu, sum(n * (failed / n - mu) * (failed / n - mu)) / sum(n) AS var, count(*) / sum(n) AS c FROM h, p),
v AS (SELECT mu, (var - mu * (1 - mu) * c) / nullif(1 - c, 0) AS var FROM u),
s AS (SELECT mu, least(10000.0, greatest(1.0, CASE WHEN var > 1e-12 THEN mu * (1 - mu) / var - 1 ELSE 10000.0 END)) AS k FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((SELECT (failed + k * mu) / (n + k) <= 0.8 FROM h, s WHERE host = f.source), true) AS kept
FROM f
"""
