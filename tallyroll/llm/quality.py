"""Quality rules judged by host, with DataFrame functions only.

1. Each document gets base measures and ``base_failed``.
2. The failures are counted per host (here: ``source``); the counts are pre-aggregated before
   they are shuffled, so a host with a third of all rows costs no more than any other.
3. The hosts' failure rates are shrunk by a beta prior whose two parameters are fitted to all
   hosts by moments: a host with three documents is judged mostly by the prior.
4. The verdicts of the hosts are joined back: a document is kept if it did not fail itself and
   its host's shrunk rate is at most ``max_host_rate``.

Nulls: a null text has no words (and fails); a null host belongs to no host and is judged alone.
Empty tables give empty results.  Repeated rows are judged, and counted for their host, one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
#: The prior never weighs more than this many documents.
MAX_PRIOR_DOCS = 100.0


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    keep = [c for c in docs.columns if c not in names]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = F.btrim(t, F.lit(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+")).alias("_w"),
    )
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)])
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_g": F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), window)),
        }
    ).drop("_w", "_lines")
    # Only texts with some window twice go on; their windows are sorted so that equal ones are neighbours.
    twice = F.size(F.array_distinct("_g")) < F.size("_g")
    out = out.withColumn("_s", F.when(twice, F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))).drop("_g")
    same = lambda p, k: F.coalesce(F.get("_s", k)["h"] == p["h"], F.lit(False))
    out = out.withColumn(
        "_at", F.sort_array(F.transform(F.filter("_s", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
    ).drop("_s")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).select(*[F.col(f"`{c}`") for c in keep], *names)


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """host, n, failed, rate: the rate shrunk towards all hosts' by an empirical beta prior."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed")
    )
    raw = F.col("failed") / F.col("n")
    m = hosts.agg(
        F.avg(raw).alias("mean"),
        F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("var"),
        F.coalesce(F.avg(F.lit(1.0) / F.col("n")), F.lit(0.0)).alias("per"),
    ).first()
    mean = min(max(m["mean"] or 0.0, 1e-6), 1 - 1e-6)
    # What the hosts differ beyond the chance of their counts is the prior's own variance.
    spread = max((m["var"] or 0.0) - mean * (1 - mean) * m["per"], 1e-9)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), MAX_PRIOR_DOCS)
    a, b = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", (F.col("failed") + a) / (F.col("n") + a + b))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without the text, with the measures, host_rate and kept.

    The measures are written once to the shared folder and used for both the host counts and
    the join, so no text is measured twice and no text is shuffled.
    """
    clash = [c for c in ("host_rate", "kept", "_host") if c in docs.columns]
    measured = written(measure(docs.drop(*clash), text).drop(text), "quality")
    return _with_verdict(measured, measured, host, max_host_rate)


def keep(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; the texts are written along with their measures."""
    names = {c: f"_q_{c}" for c in docs.columns}
    renamed = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()])
    measured = written(measure(renamed, names[text]), "quality")
    judged = _with_verdict(measured, measured, names[host], max_host_rate)
    return judged.where("kept").select(*[F.col(x).alias(c) for c, x in names.items()])


def _with_verdict(measured: DataFrame, counted: DataFrame, host: str, max_host_rate: float) -> DataFrame:
    """Joins the hosts' verdicts; written first, they are small enough for Spark to broadcast or are not."""
    rates = written(host_rates(counted, host).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "quality-hosts")
    joined = measured.join(rates, measured[host] == rates["_host"], "left").drop("_host")
    bad_host = F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad_host)
