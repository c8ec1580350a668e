"""Quality rules as a ledger of bits: each rule is evaluated once per document, its failure becomes one bit and its
measurements are kept; policies are masks over the bits, so a new version of a policy, or what a rule alone rejects,
is read from the ledger without looking at a text again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 5


class QualityRule(NamedTuple):
    """``fails`` is a SQL condition over the measurements; null counts as passed."""

    name: str
    fails: str


#: Bit k is rule k. New rules go to the end, so that ledgers stay readable.
RULES = (
    QualityRule("too_few_words", "n_words < 10"),
    QualityRule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    QualityRule("symbols", "10 * n_symbols > 3 * n_words"),
    QualityRule("short_words", "word_chars < 2 * n_words"),
    QualityRule("long_words", "word_chars > 25 * n_words"),
    QualityRule("repeated_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
)
#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "short_words", "long_words", "repeated_lines"),
}


def policy_mask(policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> int:
    names = policies[policy] if isinstance(policy, str) else policy
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Words are runs between blanks and controls 9-13; n_symbols counts ``#*$%&|<>``; n_lines lines with a word;
    n_dup_lines those equal to an earlier line; n_repeat_words the places of words that lie in a WINDOW-word window found
    twice or more in the text, each place once. Null and empty texts measure 0 throughout. Columns of ``docs`` with the
    names of measurements are replaced, all others kept; every row stays.

    Windows are compared by 64-bit hashes: sorted (hash, place) pairs bring equal ones together, and of the sorted
    places with an equal neighbour each adds what the one before it doesn't cover."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gap = r"[\x20\x09-\x0D]+"
    step = docs.select(F.struct(*[c for c in docs.columns if c not in MEASURES]).alias("_row"), text.alias("_t"))
    step = step.withColumn("_w", F.filter(F.split("_t", gap), lambda w: w != ""))
    step = step.withColumn("_n", F.size("_w"))
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])
    none = "cast(array() as array<{}>)".format
    windows = F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), window)
    step = step.withColumn("_g", F.when(F.col("_n") > WINDOW, windows).otherwise(F.expr(none("bigint"))))
    # most texts repeat no window: they are known by counting distinct hashes, and only the others are sorted
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_p", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs).otherwise(F.expr(none("struct<h:bigint,i:int>"))))
    same = lambda k: F.coalesce(F.get("_p", k)["h"], F.lit(None))
    step = step.withColumn("_r", F.sort_array(F.transform(F.filter("_p", lambda p, k: (p["h"] == same(k - 1)) | (p["h"] == same(k + 1))), lambda p: p["i"])))
    added = F.transform("_r", lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), i - F.get("_r", k - 1))))
    long = lambda c: c.cast("long")
    measured = F.struct(
        long(F.col("_n")).alias("n_words"),
        long(F.length("_t") - F.length(F.regexp_replace("_t", r"[^\x20\x09-\x0D]", ""))).alias("word_chars"),
        long(F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )
    # a generator of one row: filters on measurements then stay above it, else they would be worked out once more there
    return step.select("_row", F.inline(F.array(measured))).select("_row.*", *MEASURES)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, rules: Sequence[QualityRule] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``failures`` (long): bit k is set if rule k fails. At most 63 rules."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules")
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failures", total)


def passes(policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy, rules)).cast("long")) == 0


def ablations(book: DataFrame, policy: str | Sequence[str], rules: Sequence[QualityRule] = RULES) -> DataFrame:
    """Per rule of the policy: ``failed`` documents, ``alone`` those that no other rule of it rejects, and ``kept_without``
    what the policy keeps without the rule. The ledger is first counted by its bits, so at most 2**rules rows move."""
    mask = policy_mask(policy, rules)
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(rules) if mask >> k & 1])
    each = counts.select("bits", "n", F.explode(listed).alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = each["bits"].bitwiseAND(each["bit"]) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )
