"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit; the measurements it was made from stay beside
the mask. Policies are named, versioned sets of bits, so another policy, or an ablation of a rule, is bit
arithmetic over the ledger and never reads a text again. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window that is looked for again in the same text.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A failing condition over measurement columns; its bit is 2^index."""

    index: int
    name: str
    fails: str

    @property
    def bit(self) -> int:
        return 1 << self.index


#: Conditions are integer arithmetic over the measurements, so that every engine agrees on them.
RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "short_words", "10 * word_chars < 15 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "shouting", "2 * n_upper > n_letters"),
    Rule(7, "few_letters", "2 * n_letters < word_chars"),
)


def mask_of(*names: str) -> int:
    return sum(r.bit for r in RULES if r.name in names)


BASE_MASK = mask_of("too_few_words", "repeated_windows")

#: Versioned policies: a document is kept where no bit of the policy is set.
POLICIES = {
    "base-1": BASE_MASK,
    "strict-1": BASE_MASK | mask_of("symbols", "repeated_lines", "shouting", "few_letters"),
    "all-1": sum(r.bit for r in RULES),
}


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words occurring at least twice, the first occurrence included.

    The windows are hashed; only where two are equal are hash and position sorted together, the positions
    with an equal neighbour kept, and the union of their windows measured in one pass.
    """
    count = F.size(words)
    hashes = F.when(count >= width, F.transform(F.sequence(F.lit(1), F.greatest(count - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hits = F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        def union(acc: Column, p: Column) -> Column:
            return F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).cast("long").alias("n"), p.cast("int").alias("last"))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("int").alias("last"))
        return F.aggregate(let(tagged, positions), start, union)["n"]

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the measurements of every whole text.

    A null text counts as empty: all measurements are 0. Rows are neither joined nor moved, so ties, repeated
    rows and null ids simply stay; columns outside `keep` and `text` are not read, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*[F.col(c) for c in keep], t.alias("_t"))
    with_words = base.withColumn("_w", words_of(F.col("_t")))
    t, w = F.col("_t"), F.col("_w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    letters = lambda kind: F.length(F.regexp_replace(t, kind, ""))
    without_symbols = t
    for ch in SYMBOLS:
        without_symbols = F.replace(without_symbols, F.lit(ch), F.lit(""))
    return with_words.select(
        *[F.col(c) for c in keep],
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without_symbols)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_l"),
        repeated_window_words(w).alias("n_repeat_words"),
        letters("[^A-Z]+").cast("long").alias("n_upper"),
        letters("[^\\p{L}]+").cast("long").alias("n_letters"),
    ).select(
        *[F.col(c) for c in keep], "n_words", "word_chars", "n_symbols", F.col("_l.d").cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.col("_l.n").cast("long").alias("n_lines"), "n_upper", "n_letters",
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and `fail_bits`, the sum of the bits of the rules a document fails."""
    measured = measure(docs, text, keep)
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(rule.bit)).otherwise(F.lit(0)).cast("long")
    return measured.withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str | int, column: str = "kept") -> DataFrame:
    """Adds the verdict of a policy, by name or mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(entries: DataFrame, policy: str | int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents failing it, failing it alone, and kept if it were left out. One pass, one small row.

    An empty ledger gives zeros.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    used = [r for r in rules if r.bit & mask]
    aggs = [F.count_if(hit == 0).alias("kept_all"), F.coalesce(F.bit_or(hit), F.lit(0).cast("long")).alias("seen_bits")]
    for r in used:
        aggs += [F.count_if(hit.bitwiseAND(F.lit(r.bit).cast("long")) != 0).alias(f"f{r.index}"), F.count_if(hit == r.bit).alias(f"o{r.index}")]
    one = entries.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.index}").alias("failed"), F.col(f"o{r.index}").alias("failed_alone"), (F.col("kept_all") + F.col(f"o{r.index}")).alias("kept_without")) for r in used])
    return one.select(F.inline(rows))
