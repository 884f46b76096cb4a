"""Line-first quality rules, in SQL functions only.

Every line is judged by itself (punctuation, navigation, boilerplate). Failing lines are removed,
then a document is rejected when its base statistics fail or when too little of it is left.

Defined results: null and empty texts have no words and are rejected; blank lines never fail and
stay; repeated rows are judged row by row; extra columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, words

# The words of lines that belong to a site, not to a text.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie", "terms of use", "terms of service", "javascript",
    "subscribe to", "sign up", "sign in", "log in", "click here", "read more", "licensed under", "copyright", "©",
)
#: Low bits of a sorted window key that hold its position.
INDEX_BITS = 24
#: A longer line is prose that mentions one of them.
BOILERPLATE_LINE = 120
SEPARATORS = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
HEAVY = r"[!?#*$%&|<>{}~^=_\\]"
TERMINAL = r"[.!?:;…。！？][\"'”’»)\]]*$"
SHORT = f"^[{SPACE}]*[^{SPACE}]+(?:[{SPACE}]+[^{SPACE}]+)?[{SPACE}]*$"


def line_fails(line: Column, marks: Column) -> Column:
    """True if a line with words is navigation, boilerplate, symbol noise or an unended fragment.

    `marks` tells which kinds can occur at all in the document, so clean texts skip their tests.
    """
    trimmed = F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return (line.rlike(SHORT) & ~trimmed.rlike(TERMINAL)
            | marks["navigation"] & _navigation(trimmed)
            | (F.length(line) <= BOILERPLATE_LINE) & _boilerplate(line)
            | marks["heavy"] & (F.length(trimmed) > 0) & (10 * _count(trimmed, HEAVY) > F.length(trimmed)))


def _marks(text: Column) -> Column:
    return F.struct(text.rlike(SEPARATORS).alias("navigation"), text.rlike(HEAVY).alias("heavy"), text.rlike(SYMBOLS).alias("symbols"))


def _boilerplate(text: Column) -> Column:
    return let(F.lower(text), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE]))


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _navigation(text: Column) -> Column:
    found = _count(text, SEPARATORS)
    return (found >= 2) & (4 * found >= F.size(words(text)))


def _repeated_words(tokens: Column, width: int) -> Column:
    """Words inside `width`-word windows that occur twice or more in the text.

    Distinct 64-bit window hashes prove that no window repeats; only other texts compare the
    windows themselves.
    """
    starts = F.sequence(F.lit(1), F.size(tokens) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + (k - 1)) for k in range(width)]))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), " "))

    def ordered(grams: Column) -> Column:
        return F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def twins(rows: Column) -> Column:
        found = F.filter(rows, lambda r, j: (
            F.coalesce(F.get(rows, j - 1)["g"] == r["g"], F.lit(False))
            | F.coalesce(F.get(rows, j + 1)["g"] == r["g"], F.lit(False))))
        return F.array_sort(F.transform(found, lambda r: r["i"]))

    def union(at: Column) -> Column:
        steps = F.transform(at, lambda s, j: F.least(
            F.lit(width), F.coalesce((s - F.get(at, j - 1)).cast("int"), F.lit(width))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def head(key: Column) -> Column:
        return F.shiftrightunsigned(key, INDEX_BITS)

    def start(key: Column) -> Column:
        return key.bitwiseAND(F.lit((1 << INDEX_BITS) - 1))

    def window(key: Column) -> Column:
        return F.slice(tokens, start(key).cast("int") + 1, width)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(head(a) == head(b), F.lit(False))

    def by_hash(keys: Column) -> Column:
        """Neighbours in hash order; any two that differ as words send the text to the plain path."""
        found = F.filter(keys, lambda k, j: same(F.get(keys, j - 1), k) | same(F.get(keys, j + 1), k))
        return let(found, lambda f: F.when(
            F.forall(F.sequence(F.lit(1), F.size(f)), lambda j: ~same(F.get(f, j - 1), F.get(f, j)) | (
                window(F.get(f, j - 1)) == window(F.get(f, j)))),
            let(F.sort_array(F.transform(f, start)), union)).otherwise(plain))

    none = F.lit(0).cast("long")
    plain = let(ordered(windows), lambda rows: let(twins(rows), union))

    def repeats(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(
            F.lit(-1 << INDEX_BITS)).bitwiseOR(i.cast("long"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), none).when(
            F.size(h) < (1 << INDEX_BITS), let(keys, by_hash)).otherwise(plain)

    return F.when(F.size(tokens) <= width, none).otherwise(let(hashes, repeats))


def judge(docs: DataFrame, window: int = 5, least_words: int = 10, most_repeat_pct: int = 20,
          most_lost_pct: int = 50) -> DataFrame:
    """docs plus `quality`: the base statistics, the cleaned text, words left, and the verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    with_word = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
    stats = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated_words(w, window).alias("n_repeat_words")))
    dup = let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    cleaned = let(_marks(text), lambda m: F.struct(
        m["symbols"].alias("symbols"),
        F.array_join(F.filter(lines, lambda x: ~line_fails(x, m)), "\n").alias("text")))
    base = let(F.struct(stats.alias("s"), cleaned.alias("c")), lambda x: F.struct(
        x["s"]["n_words"].alias("n_words"), x["s"]["word_chars"].alias("word_chars"),
        F.when(x["c"]["symbols"], _count(text, SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"), x["s"]["n_repeat_words"].alias("n_repeat_words"),
        ((x["s"]["n_words"] < least_words)
         | (100 * x["s"]["n_repeat_words"] > most_repeat_pct * x["s"]["n_words"])).alias("base_failed"),
        x["c"]["text"].alias("clean_text"),
        F.when(x["c"]["text"] == text, x["s"]["n_words"]).otherwise(
            F.size(words(x["c"]["text"])).cast("long")).alias("words_left")))
    kept = let(base, lambda q: q.withField("kept", ~q["base_failed"] & (
        100 * (q["n_words"] - q["words_left"]) <= most_lost_pct * q["n_words"])))
    return docs.withColumn("quality", kept)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: base statistics and the verdict."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", *[F.col(f"quality.{c}") for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")])


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their failing lines; `n_chars` follows the text."""
    judged = judge(docs.withColumnRenamed("quality", "__own_quality") if "quality" in docs.columns else docs)
    # behind a generator the filter can't be pushed below: each text is judged once, not twice
    once = judged.withColumn("quality", F.explode(F.array("quality")))
    kept = once.where("quality.kept").withColumn("text", F.col("quality.clean_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    kept = kept.drop("quality")
    return kept.withColumnRenamed("__own_quality", "quality") if "quality" in docs.columns else kept
