"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: a row holds the
measurements and ``failed_bits``, in which bit k is 1 if rule k fails. Policies are
versioned masks over the same bits; applying one, or asking what it would drop without one
of its rules, reads the bits and never the texts. The ledger is a written table: verdicts,
filters and ablations come from it, and no measurement is made twice.

A word is a run of characters other than ASCII white space; a null text has none and is
measured as empty. Rows are independent: repeated rows are measured row by row, other
columns pass through ``apply_policy`` untouched, and no row is shuffled. A text's repeated
windows are found through 64-bit hashes of eight words, sorted within the row only where
two are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import WORD_SPLIT, written

#: Words in a window whose repetition counts.
WINDOW = 8
#: Characters that count as symbols (fixed values).
SYMBOLS = r"[#*$%&|<>]"
#: White space other than \n, trimmed from a line to see whether it has a word.
BLANKS = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition holds; the condition reads the ledger's measurements."""

    name: str
    fails: str


#: The position of a rule is its bit. Add rules at the end; never reuse a position.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("upper_case", "10 * n_upper > 6 * n_letters"),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {r.name: k for k, r in enumerate(RULES)}
        return sum(1 << at[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(r.name for r in RULES))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more, from the hashes of all windows in order."""
    n = F.size(hashes)
    numbered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # after sorting, a window is repeated if the one before or after it has its hash
    left = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(numbered, 1, n - 1))
    right = F.concat(F.slice(numbered, 2, n - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    near = F.zip_with(left, right, lambda a, b: F.struct(a.getField("h").alias("a"), b.getField("h").alias("b")))
    places = F.array_compact(F.zip_with(numbered, near, lambda x, y: F.when((x.getField("h") == y.getField("a")) | (x.getField("h") == y.getField("b")), x.getField("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
    # each repeated window adds those of its words that the one before did not cover
    covered = F.aggregate(
        F.array_sort(places), start,
        lambda acc, i: F.struct((acc.getField("n") + F.least(F.lit(WINDOW), i - acc.getField("end"))).alias("n"), i.alias("end")),
        lambda acc: acc.getField("n"),
    )
    return covered


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements) of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.trim(line, F.lit(BLANKS))) > 0)
    words = F.array_remove(F.split(t, WORD_SPLIT, -1), "")
    parts = docs.select(F.col(key), t.alias("t"), words.alias("words"), lines.alias("lines"))
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    hashed = parts.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^A-Za-z]+", "")).cast("long").alias("n_letters"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), repeated_words(F.col("windows"))).otherwise(0)
    return hashed.select("*", repeats.cast("long").alias("n_repeat_words")).drop("windows")


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, failed_bits): each rule evaluated once for each row."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, key, text).withColumn("failed_bits", bits)


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) != 0


def patterns(rows: DataFrame) -> DataFrame:
    """(failed_bits, n): rows by the set of rules they fail. At most two to the number of rules; all ablations follow from it."""
    return rows.groupBy("failed_bits").agg(F.count("*").alias("n"))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """(policy, version, rule, failed, failed_alone, kept_without) for each rule of a policy.

    ``failed_alone`` is what only this rule drops, ``kept_without`` what the policy would keep without it.
    """
    counts = patterns(rows)
    at = {r.name: k for k, r in enumerate(RULES)}
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << at[r]).cast("long").alias("bit")) for r in policy.rules]))
    each = counts.select("failed_bits", "n", rules.alias("r")).select("n", "r.rule", "r.bit", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits"))
    some = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        some(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        some(F.col("bits") == F.col("bit")).alias("failed_alone"),
        some(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"),
    ).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "*")


def quality_verdicts(docs: DataFrame, policy: Policy = DEFAULT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measurements, base_failed, kept, failed_bits, policy, alone, alike) of each row, from a written ledger.

    ``alone`` is the policy's rule without which the row would be kept (null: none, or more than one), ``alike`` the number
    of rows that fail the same rules.
    """
    rows = written(ledger(docs, key, text), "quality-ledger")
    names = {1 << k: r.name for k, r in enumerate(RULES)}
    own = F.col("failed_bits").bitwiseAND(F.lit(BASE.mask | policy.mask))
    alone = F.coalesce(*[F.when(own == bit, F.lit(name)) for bit, name in names.items()])
    alike = F.broadcast(patterns(rows).withColumnRenamed("n", "alike"))  # two to the number of rules, at most
    judged = rows.join(alike, "failed_bits")
    measures = [c for c in rows.columns if c not in (key, "failed_bits")]
    return judged.select(key, *measures, fails(BASE).alias("base_failed"), (~fails(BASE) & ~fails(policy)).alias("kept"), "failed_bits", F.lit(f"{policy.name}-{policy.version}").alias("policy"), alone.alias("alone"), "alike")


def apply_policy(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the policy, with all their columns, whatever their names.

    The ledger is written beside the rows as they are, since rows may lack a key or repeat one; the policy reads its bits.
    """
    whole = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    rows = written(ledger(whole, "__row", "__text").select("__row", "failed_bits"), "quality-ledger")
    return rows.where(~fails(BASE) & ~fails(policy)).select("__row.*")
