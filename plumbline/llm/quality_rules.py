"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read its bits.

``ledger`` adds the measurements and one long ``failures`` whose bit k is set when rule k fails. A policy is a named,
versioned set of rules; applying one is a single bitwise test, and an ablation (what would a policy keep without one of
its rules?) needs only the counts per distinct mask. No row is shuffled.

Defined cases: a null text has no words; a null in any other column passes through; repeated rows are judged alike; extra
columns are kept, and columns that carry a name of the ledger are replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_of, words_of

WINDOW = 8

# Rule of each bit, by position: name and condition on the measurements under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "10 * n_upper > 5 * word_chars"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

# Versioned policies: the rules that reject. A version never changes once used; add a new one instead.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "short_words", "long_words"),
    "v2": (*BASE, "symbols", "shouting", "repeated_lines", "short_words", "long_words", "exclamations", "few_letters"),
}
CURRENT = "v2"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_exclamations",
)
_WORK = ("words", "lines", "windows", "sorted_windows")


def mask(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of every whole text."""
    taken = {c.lower() for c in (*MEASURES, *_WORK, "failures", "ledger_text")}
    body = docs.select(text_of(text).alias("ledger_text"), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    body = body.withColumns({"words": words_of(F.col("ledger_text")), "lines": _lines(F.col("ledger_text"))})
    n, hashed = F.size("words"), F.col("words")
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)))
    ).otherwise(F.array().cast("array<long>"))
    body = body.withColumn("windows", windows)
    # Only texts with a repeated window pay for sorting (hash, place) pairs.
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    body = body.withColumn("sorted_windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs))
    body = body.withColumn("places", _repeated_places(F.col("sorted_windows")))
    source = F.col("ledger_text")
    joined = F.array_join("words", "")
    return body.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.regexp_count(source, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": _covered(F.col("places")),
            "n_lines": F.size("lines").cast("long"),
            "n_upper": F.regexp_count(source, F.lit("\\p{Lu}")).cast("long"),
            "n_letters": (F.length(joined) - F.regexp_count(joined, F.lit("[^\\p{L}\\p{M}]"))).cast("long"),
            "n_exclamations": F.regexp_count(source, F.lit("!")).cast("long"),
        }
    ).drop(*_WORK, "places", "ledger_text")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def _repeated_places(pairs: Column) -> Column:
    """Sorted starts of the windows whose hash is also that of a neighbour in hash order."""
    last = F.size(pairs) - 1
    same = lambda x, j: F.get(pairs, j)["h"] == x["h"]
    found = F.filter(pairs, lambda x, j: ((j > 0) & same(x, j - 1)) | ((j < last) & same(x, j + 1)))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Number of words in windows that start at these places."""
    steps = F.transform(places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s), F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failures``: bit k is set when rule k fails."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(0).cast("long") for k, (_, condition) in enumerate(RULES)]
    return measured(docs, text).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: str = CURRENT) -> Column:
    """Verdict of a policy on a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of a ledger that the policy keeps.

    The partition number does not change the verdict; it keeps the optimizer from moving the filter below the steps that
    measure, where every step would be written out again inside the condition.
    """
    marked = rows.withColumn("ledger_partition", F.spark_partition_id())
    return marked.filter(passes(policy) & (F.col("ledger_partition") >= 0)).drop("ledger_partition")


def ablation(rows: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that the policy keeps, and that it would keep without the rule.

    One pass: the rows are first counted per mask (at most ``2 ** len(RULES)`` groups, summed before the shuffle).
    """
    masks = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("all"), F.lit(1 << BIT[r]).cast("long").alias("bit"))
        for p, names in POLICIES.items()
        for r in names
    ]
    case = masks.select("failures", "n", F.explode(F.array(*cases)).alias("c"))
    fails, one = F.col("failures").bitwiseAND(F.col("c.all")), F.col("c.bit")
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return case.groupBy("c.policy", "c.rule").agg(
        count(F.col("failures").bitwiseAND(one) != 0).alias("failed"),
        count(fails == 0).alias("kept"),
        count(fails.bitwiseAND(F.bitwise_not(one)) == 0).alias("kept_without"),
        F.bit_or(fails).alias("failing_rules"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op10: the ledger of all documents and the verdict of the current policy."""
    from plumbline.llm.common import table

    base = F.col("failures").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", *MEASURES, "failures", base.alias("base_failed"), passes().alias("kept"), *[passes(p).alias(f"kept_{p}") for p in POLICIES]
    )
