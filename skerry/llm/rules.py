"""Quality rules: a ledger of failure bits and measurements, and policies over it. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.native import SPACES

#: Words in a window of the repetition measure.
SPAN = 5
#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of SPAN words found twice or more in the array.

    A window is known by a 64-bit hash of its words. Most texts repeat none: the set of hashes then is
    as large as the array, and nothing more is done. Else positions are sorted by hash, so that equal
    windows meet as neighbours, and the union of the repeated windows is measured in one ordered pass.
    """
    n = F.size(words)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(SPAN)])

    hashes = F.transform(F.sequence(F.lit(0), n - SPAN), window)

    def union(at: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            last, follow = F.get(at, k - 1)["h"], F.get(at, k + 1)["h"]
            return F.when((x["h"] == last) | (x["h"] == follow), x["i"])

        starts = F.array_sort(F.filter(F.transform(at, repeated), lambda i: i.isNotNull()))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-SPAN).alias("last"))
        return F.aggregate(
            starts, zero,
            lambda s, i: F.struct((s["n"] + F.least(F.lit(SPAN), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    def of(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(by_hash, union))

    return F.when(n <= SPAN, F.lit(0)).otherwise(_let(hashes, of))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is evaluated at its binding, not at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measurements of each whole text; null counts as empty, and measures 0.

    One row per row, repeated rows included; other columns of docs are left aside.
    """
    given = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = given.select(
        "doc_id", "t",
        F.array_remove(F.split("t", f"[{SPACES}]+", -1), "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
    )
    return parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(f"[{SPACES}]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """A named test of measurements; `fails` is SQL over the columns of measure()."""

    name: str
    fails: str


#: Bit k of the ledger belongs to rule k. Append rules, never reorder them: policies name bits.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)

#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"),
}


def mask(policy: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(name) for name in policy)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """measure() and `failed`: a long whose bit k is set where rule k fails. Each rule is evaluated once."""
    failed = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failed", failed)


def verdict(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the policy fails, read from the ledger's bits."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("failed").bitwiseAND(F.lit(mask(names, rules)).cast("long")) == 0


def ablations(book: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy, what rejecting with it and without it does; one pass over the ledger.

    Columns rule, n_failed (rows that fail the rule), n_only (rows that fail no other rule of the policy: what
    dropping the rule would bring back), n_rejected (rows the whole policy rejects). An empty ledger gives zeros.
    """
    names = POLICIES[policy]
    full = mask(names, rules)
    hit = F.col("failed").bitwiseAND(F.lit(full).cast("long"))
    sums = [F.count_if(hit != 0).alias("rejected")]
    for name in names:
        bit = F.lit(mask((name,), rules)).cast("long")
        sums += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"f_{name}"), F.count_if(hit == bit).alias(f"o_{name}")]
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), F.col("rejected").alias("n_rejected")) for n in names]
    return book.agg(*sums).select(F.inline(F.array(*rows)))


def filtered(docs: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs, with docs' own columns, that the policy keeps."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.lit(0).alias("doc_id"), F.col(text).alias("text"))
    whole = own.withColumn("doc_id", F.col("own"))  # the whole row rides along as the id
    return ledger(whole, rules, "text").where(verdict(policy, rules)).select("doc_id.*")
