"""Operator 7, quality rules at host level. DataFrame functions only.

Each text is measured and tested by simple rules. The failures are then counted by host; an empirical beta prior,
fitted by moments over all hosts, shrinks each host's failure rate towards the corpus mean, so that a host of three
documents isn't condemned on two failures. By its shrunk rate a host is rejected (above ``max_host_rate``: all its
documents go), trusted (up to ``max_trusted_rate``: a failure of other than the base rules is forgiven) or suspect
(between: its documents that fail a rule themselves go).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, join_by_weight, scratch, words_of

WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. The first two are the base rules; what a failure of the others means is for the host to say."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10  # symbols per 100 words
    max_dup_line_percent: int = 50
    min_mean_word_chars: int = 2
    max_mean_word_chars: int = 20
    #: A host is rejected above this shrunk failure rate ...
    max_host_rate: float = 0.6
    #: ... and trusted up to this one.
    max_trusted_rate: float = 0.05
    #: Documents that the prior counts as, at most: where the hosts' rates differ no more than by chance.
    max_prior_docs: float = 1e6


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to the rows of ``docs``.

    A null or empty text has no words and zeros throughout. n_repeat_words counts the words that lie in an 8-word
    window found at least twice in the text. Windows are compared by a 64-bit hash of the hashes of their words, within one text only.
    Work and memory per row are O(n log n) and O(n) in its words.
    """
    w, h, s, p, lines = fresh(docs, "w_", "h_", "s_", "p_", "l_")
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(w, words_of(F.col(text))).withColumn(
        lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    )
    # Hashes of the words, then of every run of two, four and eight.
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):
        later = F.slice(F.col(h), F.lit(step + 1), F.greatest(F.size(h) - step, F.lit(0)))
        out = out.withColumn(h, F.zip_with(F.col(h), later, lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn(s, F.when(F.size(w) > WINDOW, F.slice(F.col(h), F.lit(1), F.greatest(F.size(w) - WINDOW + 1, F.lit(0)))))
    # Sorted by hash, equal windows are neighbours. Only texts with a repeat come so far.
    out = out.withColumn(
        h,
        F.when(
            F.size(F.array_distinct(s)) < F.size(s),
            F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    at = lambda j: F.get(F.col(h), j)["x"]
    out = out.withColumn(
        p,
        F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(h) - 1),
                    lambda j: F.coalesce(at(j) == at(j - 1), F.lit(False)) | F.coalesce(at(j) == at(j + 1), F.lit(False)),
                ),
                lambda j: F.get(F.col(h), j)["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(p) - 1),
        F.lit(0).cast("long"),
        lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(p), k + 1) - F.get(F.col(p), k), F.lit(WINDOW))),
    )
    chars = F.char_length(F.array_join(w, ""))
    return out.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(p) > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def any_failed(rules: Rules) -> Column:
    """Whether a measured text fails any rule."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > rules.max_symbol_percent * n)
        | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.greatest(F.lit(1), F.col("n_lines")))
        | (F.col("word_chars") < rules.min_mean_word_chars * F.col("n_words"))
        | (F.col("word_chars") > rules.max_mean_word_chars * n)
    )


def host_verdicts(measured: DataFrame, host: str, rules: Rules) -> DataFrame:
    """measured (host, failed, ...) -> one row for each host: host, n_docs, n_failed, shrunk_rate, host_rejected, host_trusted.

    The prior is fitted by moments: its mean is that of all hosts' rates, and its variance theirs less the mean of what
    chance alone would give hosts of their sizes (one aggregate row). A variance of nothing or less makes the prior
    as strong as it may be; with a single host it is one document at that host's rate, which changes nothing. An
    empty table has no verdicts.
    """
    by_host = scratch(measured.groupBy(host).agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    m, v, by_chance, k = by_host.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs")), F.count("*")).first()
    m = m or 0.0
    room = m * (1 - m)
    size = 1.0
    if k and k > 1 and room > 0:
        between = v - room * by_chance
        size = min(max(room / between - 1, 1.0), rules.max_prior_docs) if between > 0 else rules.max_prior_docs
    shrunk = (F.col("n_failed") + F.lit(m * size)) / (F.col("n_docs") + F.lit(size))
    return by_host.withColumn("shrunk_rate", shrunk).withColumns(
        {"host_rejected": F.col("shrunk_rate") > rules.max_host_rate, "host_trusted": F.col("shrunk_rate") <= rules.max_trusted_rate}
    )


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Measure, test and judge every row of ``docs``.

    Returns the columns ``keep`` (default: all but the text and those named like a result) and the five measures, base_failed, failed (any rule),
    host_rejected, host_trusted and kept. Cases: null text = no words = base_failed; a null host is a host of its own; repeated rows are measured
    and counted one by one; an empty table gives an empty result; columns of ``docs`` named like a result must
    not be named in ``keep``. The measures are written once to the shared folder and read twice.
    """
    results = {*MEASURES, "base_failed", "failed", "host_rejected", "host_trusted", "kept"}
    keep = [c for c in docs.columns if c != text and c.lower() not in results] if keep is None else keep
    if taken := {c.lower() for c in keep} & results:
        raise ValueError(f"columns named like results must not be in keep: {sorted(taken)}")
    names = {c: f"in_{i}" for i, c in enumerate(keep)}
    src = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()], F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0null")).alias("host_"), F.col(f"`{text}`").alias("text_"))
    measured = text_measures(src, "text_")
    measured = measured.withColumn(
        "n_lines", F.size(F.split(F.coalesce("text_", F.lit("")), "\n"))
    ).drop("text_")
    measured = measured.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    )
    measured = scratch(measured.withColumn("failed", any_failed(rules)), "measures")
    verdicts = host_verdicts(measured, "host_", rules)
    total = verdicts.agg(F.sum("n_docs")).first()[0] or 0
    joined = join_by_weight(
        measured, verdicts.select("host_", "host_rejected", "host_trusted", F.col("n_docs").alias("weight_")), ["host_"], "weight_", total
    )
    gone = F.col("base_failed") | F.col("host_rejected") | (F.col("failed") & ~F.col("host_trusted"))
    return joined.select(
        *[F.col(a).alias(c) for c, a in names.items()],
        *MEASURES, "base_failed", "failed", "host_rejected", "host_trusted", (~gone).alias("kept"),
    )


def filter_quality(docs: DataFrame, host: str = "source", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged.

    The whole row goes along as one struct column, so no name in it can clash with the measures.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(f"`{host}`").alias("host_in"), F.col(f"`{text}`").alias("text_in"))
    judged = quality_rules(row, "host_in", "text_in", rules, keep=["row_"])
    return judged.filter("kept").select("row_.*")
