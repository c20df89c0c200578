"""Host-level quality rules, from built-in functions only.

Each text's measures come from array functions within its row, without a shuffle. Rule failures are then summed by host
(the rows that are shuffled hold no text), each host's failure rate is shrunk with a beta prior that is fitted to all
hosts' rates by moments, and hosts with a shrunk rate over a limit fail as a whole. Host verdicts come back to the
documents through a join in which hosts of many documents stay in place.

Equality of three-word windows is equality of their 64-bit hashes.

Defined cases: a null text has no words and fails the base rules. A null host has no verdict. Equal rows are judged each.
With no document there is no host and no prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE_CLASS, join_hot, materialize

SYMBOLS = "[#*$%&|<>]"
#: Strength of the prior, in documents, if the hosts' rates differ by no more than chance.
MOST_STRENGTH = 1000.0

#: Rules over the measures; a host is judged by each.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "odd_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), "")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long) to ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "_w": words(F.col(text)),
        "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": (F.size(F.split(body, SYMBOLS, -1)) - 1).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_tri": F.when(F.size("_w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))),
    })
    # only where a window repeats: windows sorted by hash, those equal to a neighbour, their places in order
    again = F.size(F.array_distinct("_tri")) < F.size("_tri")
    out = out.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"]) | (x["h"] == F.get("_sorted", k + 1)["h"])
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])))
    # a window covers its three words, or those before the next window's first
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_lines", "_tri", "_sorted", "_at")


def host_verdicts(measured: DataFrame, host: str, rules: dict[str, str], limit: float) -> DataFrame:
    """A row per host: ``host``, _n (documents), a shrunk rate per rule and host_failed."""
    counts = materialize(
        measured.filter(F.col(host).isNotNull()).groupBy(host)
        .agg(F.count("*").alias("_n"), *[F.count_if(F.expr(sql)).alias(f"_f_{name}") for name, sql in rules.items()])
    )
    # the prior's moments over all hosts, in one pass; a host's rate has a variance of its own, which isn't the hosts'
    rate = {name: F.col(f"_f_{name}") / F.col("_n") for name in rules}
    moments = counts.agg(
        F.avg(1 / F.col("_n")).alias("inverse"),
        *[F.avg(x).alias(f"m_{n}") for n, x in rate.items()], *[F.var_pop(x).alias(f"v_{n}") for n, x in rate.items()],
    ).first()
    shrunk = {}
    for name in rules:
        mean, variance = moments[f"m_{name}"] or 0.0, moments[f"v_{name}"] or 0.0
        own = mean * (1 - mean)
        between = variance - own * (moments["inverse"] or 0.0)
        strength = min(MOST_STRENGTH, max(1.0, own / between - 1)) if between > 0 else MOST_STRENGTH
        shrunk[name] = (F.col(f"_f_{name}") + mean * strength) / (F.col("_n") + strength)
    out = counts.select(host, "_n", *[x.alias(f"rate_{n}") for n, x in shrunk.items()])
    return out.withColumn("host_failed", F.greatest(*[F.col(f"rate_{n}") for n in rules], F.lit(0.0)) > limit)


def judge(docs: DataFrame, host: str = "source", id_column: str = "doc_id", text: str = "text",
          rules: dict[str, str] | None = None, limit: float = 0.5) -> DataFrame:
    """Per document: its id and host, the measures, base_failed, its host's shrunk rates, host_failed and kept."""
    rules = rules or RULES
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text"))
    measured = materialize(with_measures(own, "_text").drop("_text"))
    hosts = host_verdicts(measured, "host", rules, limit)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        join_hot(measured, materialize(hosts), "host", "_n")
        .withColumn("base_failed", base)
        .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )
