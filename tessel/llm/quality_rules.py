"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches, stage, table

SYMBOLS = set("#*$%&|<>")  # fixed values
WINDOW = 5
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"
NAMES = [x.split()[0] for x in FEATURES.split(", ")]
#: A rule's statistic is a share in thousandths, so a stratum has at most 1001 candidate cutoffs.
STEPS = 1000
#: Rules reject a document whose statistic lies above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_words"),
}
BASE_WORDS, BASE_REPEAT_PERCENT = 10, 20

_KEEP = str.maketrans("", "", "".join(map(chr, (*range(9, 14), 32))))
_TO_BLANK = str.maketrans({c: " " for c in "\t\x0b\x0c\r"})


def repeated_words(words: list[str]) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text, the first one included.

    Windows are compared by the numbers of their words, not by hashes: each round numbers pairs of what the round before
    numbered (spans of 1, 2, 4 words, then 4 and 1), so equal numbers mean equal words.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    one = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) > len(words) - WINDOW:  # a window found twice needs at least as many words again
        return 0
    pair = lambda a, b: np.unique(a * (1 << 31) + b, return_inverse=True)[1]
    two = pair(one[:-1], one[1:])
    four = pair(two[:-2], two[2:])
    _, which, counts = np.unique(four[:n] * (1 << 31) + one[4:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks of a whole text."""
    # str.split() also parts at other white space; only blanks and U+0009 to U+000D part words here
    plain = text.translate(_TO_BLANK) if any(c in text for c in "\t\x0b\x0c\r") else text
    words = [w for line in plain.split("\n") for w in line.split(" ") if w]
    bare = "".join(words)
    lines = [line for line in text.split("\n") if line.translate(_KEEP)]
    upper = sum(map(str.isupper, bare))
    return len(words), len(bare), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), upper, text.count("!") + text.count("?")


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep of docs and the counts of column text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t) for t in batch.column(0).to_pylist()]
            counts = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, pa.int64()) for c in counts)], [*[f"k{i}" for i in range(len(keep))], *NAMES])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"k{i} {kinds[c]}" for i, c in enumerate(keep)], FEATURES])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *NAMES)


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def statistic(rule: str) -> Column:
    over, under = RULES[rule]
    return F.least(F.lit(STEPS), F.floor(STEPS * F.col(over) / F.greatest(F.lit(1), F.col(under)))).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly from its terms."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def best_cutoff(rows: list[tuple[int, int, int]]) -> int:
    """The cutoff that parts bad from good best, STEPS (nothing rejected) if none does.

    rows has (statistic, quality, documents). What counts is the share of bad documents above the cutoff, less five times
    the share of good ones; of equal cutoffs the middle of the highest run is taken.
    """
    counts = {(v, q): n for v, q, n in rows}
    total = [max(1, sum(n for _, q, n in rows if q == k)) for k in (0, 1)]
    above, best, found = [0, 0], 1e-9, []
    for cutoff in range(STEPS - 1, -1, -1):
        for q in (0, 1):
            above[q] += counts.get((cutoff + 1, q), 0)
        gain = above[0] / total[0] - 5 * above[1] / total[1]
        if gain > best + 1e-12:
            best, found = gain, [cutoff]
        elif found and abs(gain - best) <= 1e-12 and found[-1] == cutoff + 1:
            found.append(cutoff)
    return found[len(found) // 2] if found else STEPS


#: Factors by which a stratum's cutoffs may be loosened, the tightest first; beyond the last, nothing is rejected.
LOOSER = (1.0, 1.25, 1.5, 2.0, 3.0, 5.0)


def certify(counts: dict[int, int], alpha: float, level: float) -> int:
    """The tightest step of LOOSER whose false rejection is bounded by alpha at the given level, or len(LOOSER).

    counts has, for good holdout documents, the first step that spares them. Steps are tested from the loosest on and
    testing ends at the first that fails: a fixed sequence, which needs no further correction. A step passes if, were its
    true rate of rejected good documents alpha or more, so few would be seen with at most the probability level.
    """
    n = sum(counts.values())
    chosen = len(LOOSER)
    for step in reversed(range(len(LOOSER))):
        rejected = sum(k for spared, k in counts.items() if spared > step)
        if not n or binomial_tail(rejected, n, alpha) > level:
            break
        chosen = step
    return chosen


def loosened(cutoff: Column, factor: Column) -> Column:
    return F.least(F.lit(STEPS), F.floor(cutoff * factor)).cast("int")


def fit_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Rows (_s, cutoffs): for each stratum a cutoff for each rule, certified on labelled holdouts.

    One half of the labelled documents (by hash) proposes each rule's cutoff; the other half, never seen by that choice,
    certifies all rules of a stratum together by an exact binomial bound, loosening them step by step if need be. delta,
    the chance that any stratum's bound is broken, is divided by the number of strata. Documents are counted by stratum,
    rule and statistic before anything is gathered, so one group holds 2 * 1001 rows at most.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("rule"), statistic(r).alias("value")) for r in RULES]))
    seen = counted.where(~base_failed()).join(marked, "doc_id").select("_stratum", "quality", shares.alias("shares"), (F.xxhash64("doc_id") % 2 == 0).alias("proposes"))
    seen = stage(seen, "labelled")
    long = seen.where("proposes").select("_stratum", "quality", F.explode("shares").alias("rule", "value"))
    bins = long.groupBy("_stratum", "rule", "value", "quality").agg(F.count("*").alias("n"))

    def propose(key, rows):
        import pandas as pd

        return pd.DataFrame({"_s": [key[0]], "rule": [key[1]], "cutoff": [best_cutoff(list(zip(rows["value"], rows["quality"], rows["n"], strict=True)))]})

    found = bins.groupBy("_stratum", "rule").applyInPandas(propose, "_s string, rule string, cutoff int")
    proposed = stage(found.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("proposed")), "proposed")
    holdout = seen.where("not proposes and quality = 1").join(proposed, F.col("_stratum").eqNullSafe(F.col("_s")))
    cutoff = lambda r: F.coalesce(F.element_at("proposed", F.lit(r)), F.lit(STEPS))
    rejected = lambda f: F.greatest(*[(F.element_at("shares", F.lit(r)) > loosened(cutoff(r), F.lit(f))).cast("int") for r in RULES])
    spared = F.coalesce(*[F.when(rejected(f) == 0, F.lit(k)) for k, f in enumerate(LOOSER)], F.lit(len(LOOSER)))
    steps = holdout.groupBy("_s", spared.alias("spared")).agg(F.count("*").alias("n"))
    level = delta / max(1, proposed.count())

    def test(key, rows):
        import pandas as pd

        step = certify(dict(zip(rows["spared"], rows["n"], strict=True)), alpha, level)
        return pd.DataFrame({"_t": [key[0]], "factor": [float(LOOSER[step]) if step < len(LOOSER) else -1.0]})

    factors = steps.groupBy("_s").applyInPandas(test, "_t string, factor double").where("factor > 0")
    rows = proposed.join(factors, F.col("_s").eqNullSafe(F.col("_t")))
    return rows.select("_s", F.transform_values("proposed", lambda _, c: loosened(c, F.col("factor"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, whole: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, stratum column): the counts, base_failed, rejected_by (rules) and kept.

    A document is kept if it passes the base rules and no rule of its stratum has it above the cutoff. With probability
    1 - delta at least, the rules reject no more than alpha of the good documents of any stratum. Strata without enough
    labelled good documents have no cutoffs and reject nothing. Null text has no words and fails the base rules; a null
    stratum is a stratum, and so is the whole table if it has no such column; labels that are null, or for other documents, are not used; repeated rows are judged one by
    one; other columns may have any name and are ignored; an empty table gives no rows. With whole, _row has all columns of
    the row that is judged; rows are then counted once more for the verdicts rather than written with their counts.
    """
    own = ["_row"] if whole else []
    of = F.col(f"`{stratum}`") if stratum in docs.columns else F.lit(None)
    docs = docs.select("doc_id", "text", of.cast("string").alias("_stratum"), *[F.struct("*").alias(c) for c in own])
    counted = stage(with_counts(docs, ["doc_id", "_stratum"]), "counts")
    cutoffs = stage(fit_cutoffs(counted, labels, alpha, delta), "cutoffs")
    judged = with_counts(docs, ["doc_id", "_stratum", *own]) if whole else counted
    rows = judged.join(cutoffs, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    hit = [F.when(statistic(r) > F.coalesce(F.element_at("cutoffs", F.lit(r)), F.lit(STEPS)), F.lit(r)) for r in RULES]
    rows = rows.withColumn("rejected_by", F.array_compact(F.array(*hit))).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *NAMES, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), *own)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")
