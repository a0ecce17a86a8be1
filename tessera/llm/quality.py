"""Quality rules: a threshold table compiled into one native projection.

Every rule compares one metric of the text with a bound; ``compile_rules``
turns the table into Spark columns, so a corpus is filtered by a narrow
projection (no shuffle, no user function).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import private, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with by at from this be or an a",
    "fr": "le la les de des du un une et en que qui dans pour par sur est avec au",
    "de": "der die das und in zu den von mit ist des für im dem nicht ein eine auf als auch",
    "es": "el la los las de que y en un una por con para del se su al es como no",
}

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``metric op bound`` must hold; op is one of >=, <=."""

    name: str
    metric: str
    op: str
    bound: float


#: The base rules every document has to meet.
BASE_RULES = (
    Rule("enough_words", "n_words", ">=", 20),
    Rule("few_repeated_words", "repeat_percent_excess", "<=", 0),
)

#: The method's own thresholds (production values).
RULES = (
    Rule("word_length_low", "mean_word_chars", ">=", 2.0),
    Rule("word_length_high", "mean_word_chars", "<=", 15.0),
    Rule("symbols", "symbols_per_word", "<=", 0.2),
    Rule("exclamations", "exclamations_per_word", "<=", 0.5),
    Rule("duplicate_lines", "dup_line_ratio", "<=", 0.5),
    Rule("stop_words", "stop_word_ratio", ">=", 0.02),
)


def stop_forms() -> list[str]:
    words = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    return [f for w in words for f in dict.fromkeys((w, w.capitalize(), w.upper()))]


def _from(values: Column, k: int) -> Column:
    """The array without its first ``k`` elements."""
    return F.slice(values, k + 1, F.greatest(F.size(values) - k, F.lit(0)))


def metrics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Add the metrics under private names; returns the frame and metric -> column.

    Null text counts as empty: all counts are zero.
    """
    c = {k: private(k) for k in ("text", "words", "pairs", "fours", "windows", "ordered", "lines", "n_words", "word_chars",
                                 "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_exclaim")}
    col = {k: F.col(f"`{v}`") for k, v in c.items()}
    df = df.withColumn(c["text"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.withColumn(c["words"], words_of(col["text"]))
    df = df.withColumns({
        c["lines"]: F.filter(F.split(col["text"], "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
    })
    # hash of every 8-word window by doubling: pairs, then fours, then eights
    n = F.greatest(F.size(col["words"]) - (WINDOW - 1), F.lit(0))

    def pair(a, b):
        return F.xxhash64(a, b)

    df = df.withColumn(c["pairs"], F.zip_with(col["words"], _from(col["words"], 1), pair))
    df = df.withColumn(c["fours"], F.zip_with(col["pairs"], _from(col["pairs"], 2), pair))
    df = df.withColumn(c["windows"], F.zip_with(F.slice(col["fours"], 1, n), F.slice(col["fours"], 5, n), pair))
    some = F.size(F.array_distinct(col["windows"])) < F.size(col["windows"])
    df = df.withColumn(c["ordered"], F.when(some, F.sort_array(
        F.transform(col["windows"], lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    df = df.withColumns({
        # the row id (times zero) keeps a later filter on the verdict above this projection: pushed
        # below it, the filter would repeat the whole tower of array expressions for every rule
        c["n_words"]: F.size(col["words"]) + F.monotonically_increasing_id() * 0,
        c["word_chars"]: F.length(F.array_join(col["words"], "")).cast("long"),
        c["n_symbols"]: F.regexp_count(col["text"], F.lit(SYMBOLS)).cast("long"),
        c["n_exclaim"]: F.regexp_count(col["text"], F.lit("!")).cast("long"),
        c["n_lines"]: F.size(col["lines"]).cast("long"),
        c["n_dup_lines"]: (F.size(col["lines"]) - F.size(F.array_distinct(col["lines"]))).cast("long"),
        c["n_stop"]: F.size(F.filter(col["words"], lambda w: w.isin(*stop_forms()))).cast("long"),
        c["n_repeat_words"]: F.when(col["ordered"].isNull(), F.lit(0).cast("long")).otherwise(
            _covered(col["words"], col["ordered"])),
    })
    df = df.drop(*[c[k] for k in ("text", "words", "pairs", "fours", "windows", "ordered", "lines")])
    return df, {k: c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                                  "n_stop", "n_exclaim")}


def _covered(words: Column, ordered: Column) -> Column:
    """Words inside windows found twice or more: sorted (hash, place) pairs put equal
    windows side by side, equal hashes are confirmed on the words, and the
    union of [p, p + 8) is measured over the sorted places."""
    def same(a: Column, b: Column) -> Column:
        return F.when(a["h"] == b["h"], F.slice(words, a["p"] + 1, WINDOW) == F.slice(words, b["p"] + 1, WINDOW)).otherwise(False)

    hits = F.filter(ordered, lambda x, i: (F.when(i > 0, same(x, F.get(ordered, i - 1))).otherwise(False))
                    | F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False)))
    starts = F.sort_array(F.transform(hits, lambda x: x["p"]))
    # fold over the sorted places: (last place, words covered so far)
    zero = F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero,
                       lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(p - a["p"], F.lit(WINDOW))).alias("n")),
                       lambda a: a["n"]).cast("long")


def compile_rules(rules, col: dict[str, Column]) -> list[tuple[str, Column]]:
    """The threshold table as (rule name, boolean column that holds when the rule is met)."""
    n = F.greatest(col["n_words"], F.lit(1))
    derived = dict(col)
    derived |= {
        "mean_word_chars": col["word_chars"] / n,
        "symbols_per_word": col["n_symbols"] / n,
        "exclamations_per_word": col["n_exclaim"] / n,
        "dup_line_ratio": col["n_dup_lines"] / F.greatest(col["n_lines"], F.lit(1)),
        "stop_word_ratio": col["n_stop"] / n,
        "repeat_percent_excess": 100 * col["n_repeat_words"] - 30 * col["n_words"],
    }
    ops = {">=": lambda m, b: m >= b, "<=": lambda m, b: m <= b}
    return [(r.name, ops[r.op](derived[r.metric], F.lit(r.bound))) for r in rules]


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per input row: the metrics, ``base_failed``, ``kept`` and ``failed_rules``.

    Null or empty text: zero counts, base_failed.  Null ids and repeated rows
    are passed through (one output row per input row); other columns of the
    input are not returned.  An empty table gives an empty result.
    """
    key = private("id")
    src = df.select(F.col(f"`{id_col}`").alias(key), F.col(f"`{text_col}`").alias("text"))
    m, names = metrics(src, "text")
    col = {k: F.col(f"`{v}`") for k, v in names.items()}
    base = [ok for _, ok in compile_rules(BASE_RULES, col)]
    own = compile_rules(rules, col)
    base_ok = base[0] & base[1]
    own_ok = F.lit(True)
    for _, ok in own:
        own_ok = own_ok & ok
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in own])) if own else F.array().cast("array<string>")
    return m.select(F.col(key).alias("doc_id"), *[col[k].alias(k) for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_exclaim")],
        (~base_ok).alias("base_failed"), (base_ok & own_ok).alias("kept"), failed.alias("failed_rules"))


def filter_quality(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows whose text meets the base rules and the threshold table, all columns unchanged."""
    m, names = metrics(df, text_col)
    col = {k: F.col(f"`{v}`") for k, v in names.items()}
    ok = F.lit(True)
    for _, x in [*compile_rules(BASE_RULES, col), *compile_rules(rules, col)]:
        ok = ok & x
    return m.where(ok).select(*[F.col(f"`{c}`") for c in df.columns])
