"""Quality rules (6): a threshold table compiled into one Spark projection, without user functions.

Measures of a text (null: no words): ``n_words``, ``word_chars`` (code points in words), ``n_symbols``
(characters of ``[#*$%&|<>]``), ``n_dup_lines`` (lines with a word, equal to an earlier line), ``n_lines``
(lines with a word), ``n_stop`` (stop words), ``n_repeat_words`` (words covered by a 3-word window that
the text holds twice or more). Windows are compared by a 64-bit hash of their three words.
A null, empty or blank text has zero words and fails the base rule; ratios over nothing are null and never reject.
Repeated rows are judged alike; columns other than the text are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, let, table, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for with as on are be this was it by from at or an "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un une du que est pour qui dans par sur au pas plus "
    "el los las y del se por con una para como su al es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text while low <= numerator / denominator <= high; None leaves that side open."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def holds(self, m: Column) -> Column:
        value = m[self.numerator].cast("double")
        if self.denominator:
            value = F.try_divide(value, m[self.denominator].cast("double"))
        out = F.lit(True)
        if self.low is not None:
            out = out & (value >= self.low)
        if self.high is not None:
            out = out & (value <= self.high)
        return F.coalesce(out, F.lit(True))


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("stop_words", "n_stop", low=2),
    Rule("stop_word_share", "n_stop", "n_words", low=0.02),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by a window that occurs at least twice."""
    windows = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1),
        F.greatest(F.size(words) - 2, F.lit(0)),
    )

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(ranked: Column) -> Column:
            same = F.filter(
                ranked,
                lambda x, k: F.coalesce(F.get(ranked, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False)),
            )
            spots = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(spots))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, count))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, covered))


def measures(text: Column) -> Column:
    """Struct of the measures as longs."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, f"[{SYMBOLS}]", ""))

    def build(words: Column, rows: Column) -> Column:
        parts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": symbols,
            "n_lines": F.size(rows),
            "n_dup_lines": F.size(rows) - F.size(F.array_distinct(rows)),
            "n_stop": F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*(c.cast("long").alias(k) for k, c in parts.items()))

    return let(words_of(text), lambda w: let(lines, lambda rows: build(w, rows)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def kept(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules hold, and the base rule doesn't fail."""
    verdict = ~base_failed(m)
    for rule in rules:
        verdict = verdict & rule.holds(m)
    return verdict


def failed_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules of the table that reject the text."""
    return F.array_compact(F.array(*(F.when(~r.holds(m), F.lit(r.name)) for r in rules)))


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns unchanged."""
    return docs.where(let(measures(docs[text]), lambda m: kept(m, rules)))  # bound once: a filter on a column of measures would repeat them


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their measures and the verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", measures(F.col("text")).alias("m"))
    m = F.col("m")
    return docs.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        base_failed(m).alias("base_failed"),
        kept(m).alias("kept"),
    )


_STOP_SQL = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))

ORACLE_MEASURES = rf"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'a': words[i], 'b': words[i + 1], 'c': words[i + 2]}}), recursive := true)
  FROM w WHERE len(words) >= 3),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(words, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars::DOUBLE / n_words BETWEEN 2.0 AND 15.0 AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stop >= 2
      AND n_stop::DOUBLE / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5) AS rules
  FROM m)
"""

ORACLE = f"""
WITH {ORACLE_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(rules, true) AS kept
FROM v
"""
