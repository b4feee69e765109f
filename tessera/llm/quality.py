"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps a bit per failed rule and the
measurements behind it; a versioned policy is a mask of rules that count, so that applying another
policy, or asking what a rule alone removes, needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


@dataclass(frozen=True)
class Rule:
    """A rule's bit, its name, and an SQL condition over the measurements that holds where it fails."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


#: The first two are the base rules; all are ratios of whole-number counts, compared without division.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "exclamations", "2 * n_bangs > n_words"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
)
BASE_MASK = 0b11

#: Policies by version; a later version never changes an earlier one.
POLICIES: Mapping[str, int] = {"v1": BASE_MASK, "v2": sum(r.mask for r in RULES)}


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word counted once.

    Windows are compared by a 64-bit hash. Equal ones are neighbours once sorted by (hash, place), so
    the cost is n log n whatever repeats; each repeated window then covers up to three new words.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(z: Column) -> Column:
            n = F.size(z)
            twin = F.filter(
                z,
                lambda s, k: F.coalesce(F.get(z, k - 1)["h"] == s["h"], F.lit(False))
                | F.coalesce(F.get(z, k + 1)["h"] == s["h"], F.lit(False)),
            )
            return F.when(n > 0, F.sort_array(F.transform(twin, lambda s: s["i"])))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(ordered, places), total)

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        )

    return let(
        let(words, windows),
        lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(t)),
    )


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``m`` of :data:`MEASURES`.

    A null text counts as one without words. Nothing is shuffled: each row is measured where it is read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _removed(t, "#*$%&|<>").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            _removed(t, "!").alias("n_bangs"),
        )

    return docs.withColumn("m", let(words_of(F.col(text)), of_words))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: key, measurements and ``failed_mask`` with a bit for each failed rule.

    Only key and text of ``docs`` are read, so other columns may have any name. Repeated rows give
    repeated results, an empty table an empty ledger, and a null key stays null.
    """
    m = measure(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", "m.*")
    return m.withColumn("failed_mask", failed_mask(rules)).withColumnRenamed("key", key)


def apply_policy(led: DataFrame, policy: str | int = "v2") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return led.withColumn("kept", F.col("failed_mask").bitwiseAND(F.lit(mask)) == 0)


def failed_mask(rules: tuple[Rule, ...] = RULES) -> Column:
    """The ledger's mask, over columns of :data:`MEASURES`."""
    mask = F.lit(0).cast("long")
    for rule in rules:
        mask = mask + F.when(F.expr(rule.fails), F.lit(rule.mask)).otherwise(F.lit(0)).cast("long")
    return mask


def passing(docs: DataFrame, policy: str | int = "v2", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose ledger entry passes ``policy``.

    The entry (measurements and mask) is made beside the row, so nothing is shuffled or joined. A null text is one
    without words; repeated rows are decided alike; columns may have any names; an empty table stays empty.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    rows = measure(docs.toDF(*inner), inner[docs.columns.index(text)]).select("*", "m.*")
    led = apply_policy(rows.withColumn("failed_mask", failed_mask(rules)), policy)
    return led.where("kept").select(*(F.col(i).alias(c) for c, i in zip(docs.columns, inner, strict=True)))


def ablations(led: DataFrame, policy: str | int = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule: documents that fail it, that fail only it under the policy, and that the policy keeps without it.

    The ledger is first summed by mask, which has at most 2**len(rules) values.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    by_mask = led.groupBy(F.col("failed_mask").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("n"))
    aggs = []
    for r in rules:
        hit = F.col("b").bitwiseAND(F.lit(r.mask)) != 0
        rest = F.col("b").bitwiseAND(F.lit(mask & ~r.mask)) == 0
        none = F.lit(0).cast("long")
        aggs.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.coalesce(F.sum(F.when(hit, F.col("n"))), none).alias("fails"),
                F.coalesce(F.sum(F.when(hit & rest, F.col("n"))), none).alias("fails_alone"),
                F.coalesce(F.sum(F.when(rest, F.col("n"))), none).alias("kept_without"),
            )
        )
    return by_mask.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")
