"""Text Columns (X1-X10, X16-X31): slugs, cleaning, lenient numbers, name normalization, keyword scores, mentions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINELS = ("", "nan", "none", "null")
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens; 'unknown' if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^-+|-+$", ""), F.lit("")), F.lit("unknown"))


def clean_text(c: Column, fallback: str = "") -> Column:
    """Trimmed text; null, blank and the words nan, none, null give the fallback."""
    return bind(F.trim(c), lambda bare: F.when(bare.isNull() | F.lower(bare).isin(*SENTINELS), F.lit(fallback)).otherwise(bare))


def clean_label(parts: Column) -> Column:
    """An array's cleaned parts joined by ', '."""
    return F.array_join(F.filter(F.transform(parts, clean_text), lambda x: x != ""), ", ")


def safe_float(c: Column) -> Column:
    """Number of a text without its commas, else the first number in it; null for sentinels."""

    def number(bare: Column) -> Column:
        first = F.regexp_extract(bare, NUMBER, 0)
        return F.coalesce(F.when(bare != "", bare.try_cast("double")), F.when(bare != "", first.try_cast("double")))

    return bind(clean_text(F.replace(c, F.lit(","), F.lit(""))), lambda bare: bind(number(bare), lambda x: F.when(~F.isnan(x), x)))


def price_per_million(c: Column) -> Column:
    """Unit price times a million; negative or missing gives null."""
    return bind(safe_float(c), lambda value: F.when(value >= 0, value * 1_000_000))


def code_prefix(c: Column, pattern: str = r"\d{2}-\d{4}", length: int = 7) -> Column:
    """First match of the pattern, else the first characters."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")), F.substring(text, 1, length))


def sentence_join(parts: Column, limit: int = 4) -> Column:
    """The first non-blank parts joined by '; '."""
    return F.array_join(F.slice(F.filter(parts, lambda x: F.trim(x) != ""), 1, limit), "; ")


def after_first(c: Column, mark: str) -> Column:
    """Text after the first ``mark``, or all of it."""

    def rest(x: Column) -> Column:
        at = F.locate(mark, x)
        return F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise(x)

    return bind(c, rest)


def normalize_name(c: Column, noise: tuple[str, ...], prefixes: tuple[str, ...]) -> Column:
    """Comparable form of a name: no vendor prefix, brackets, dates or noise words; letters and digits alone."""
    bare = lambda x: F.when(F.contains(x, F.lit("/")) & F.substring_index(x, "/", 1).isin(*prefixes), after_first(x, "/")).otherwise(x)
    text = bind(after_first(F.lower(clean_text(c)), ":"), bare)
    for pattern in (
        r"\([^)]*\)",
        r"\b20\d{2}[-_ ]?(?:0[1-9]|1[0-2])[-_ ]?(?:0[1-9]|[12]\d|3[01])\b",
        r"\b20\d{6}\b",
        r"\b20\d{2}\b",
    ):
        text = F.regexp_replace(text, pattern, " ")
    words = F.filter(F.split(text, "[^a-z0-9.]+"), lambda t: (t != "") & ~t.isin(*noise))
    return F.replace(F.array_join(words, ""), F.lit("."), F.lit(""))


def keyword_score(c: Column, words: list[str]) -> Column:
    """Substring hits over max(2, 0.35 * words), at most 1."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(1.0), hits / F.lit(max(2.0, 0.35 * len(words))))


def best_by_keywords(c: Column, groups: dict[str, list[str]], default: str) -> Column:
    """The group with most substring hits, the first among equals, the default without hits."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return _most_hits(lambda w: F.contains(low, F.lit(w)), groups, default)


def _most_hits(hit: Callable[[str], Column], groups: dict[str, list[str]], default: str) -> Column:
    rows = [
        F.struct(sum((hit(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("o"), F.lit(name).alias("g"))
        for k, (name, words) in enumerate(groups.items())
    ]
    best = F.array_max(F.array(*rows))
    return F.when(best["n"] > 0, best["g"]).otherwise(F.lit(default))


def _bits(groups: dict[str, list[str]]) -> dict[str, int]:
    """A bit for each of at most 63 different keywords."""
    return {w: 1 << k for k, w in enumerate(dict.fromkeys(w for words in groups.values() for w in words))}


def keyword_bits(c: Column, groups: dict[str, list[str]]) -> Column:
    """Which keywords a text holds, as a long: what best_by_keyword_bits() needs instead of the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((F.when(F.contains(low, F.lit(w)), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for w, bit in _bits(groups).items()), F.lit(0).cast("long"))


def best_by_keyword_bits(c: Column, bits: Column, groups: dict[str, list[str]], default: str) -> Column:
    """best_by_keywords() over a text ``c`` and texts known by their keyword_bits()."""
    low, own = F.lower(F.coalesce(c, F.lit(""))), _bits(groups)
    return _most_hits(lambda w: F.contains(low, F.lit(w)) | (bits.bitwiseAND(F.lit(own[w]).cast("long")) != 0), groups, default)


def mentions(c: Column, pattern: str) -> Column:
    """Distinct matches, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)(" + pattern + ")"), F.lit(1))))


def inferred_parameters(c: Column) -> Column:
    """The last size such as 7B, 1.5T or 350M in a name, as a number."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9])(\d+(?:\.\d+)?[bBmMtT])(?:\b|[-_])"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    unit = F.lower(F.right(last, F.lit(1)))
    scale = F.when(unit == "m", F.lit(1e6)).when(unit == "b", F.lit(1e9)).when(unit == "t", F.lit(1e12))
    return F.substring(last, F.lit(1), F.length(last) - 1).try_cast("double") * scale


def active_parameters(c: Column) -> Column:
    """X18: '13B active' as a number."""
    return F.nullif(F.regexp_extract(c, r"(?i)(\d+(?:\.\d+)?)\s*B\s*active", 1), F.lit("")).try_cast("double") * 1e9


def title_key(c: Column) -> Column:
    """Lower-case words with single separators; a trailing 'occupations' goes."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return F.regexp_replace(bare, r"\s+occupations?$", "")


def tagged_value(tags: Column, prefix: str) -> Column:
    """The first tag with the prefix, without it."""
    found = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), F.lit(0))
    return F.substring(found, F.lit(len(prefix) + 1), F.length(found))


def escape_html(c: Column) -> Column:
    """X27."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_share(c: Column) -> Column:
    """A share as a percentage with one digit; 'n/a' if missing."""
    return F.coalesce(F.format_string("%.1f%%", F.round(c * 100, 1)), F.lit("n/a"))


def format_number(c: Column, digits: int = 2) -> Column:
    """Thousands separated; scientific from 1e15 on; 'n/a' for missing and not finite."""

    def shown(x: Column) -> Column:
        known = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(known & (F.abs(x) >= 1e15), F.format_string("%.2e", x)).when(known, F.format_number(x, digits)).otherwise(F.lit("n/a"))

    return bind(c.cast("double"), shown)


def file_timestamp(path: Column) -> Column:
    """What stands between 'results_' and '.json' in a file's name."""
    return F.nullif(F.regexp_extract(path, r"results_(.*?)\.json$", 1), F.lit(""))


def title_case(c: Column) -> Column:
    """Underscores as spaces, words capitalized."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def wrapped(c: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, cut between words; a longer word has its own line."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(state: Column, w: Column) -> Column:
        fits = F.length(state["line"]) + 1 + F.length(w) <= width
        line = F.when(state["line"] == "", w).when(fits, F.concat(state["line"], F.lit(" "), w)).otherwise(w)
        done = F.when((state["line"] != "") & ~fits, F.concat(state["done"], state["line"], F.lit("\n"))).otherwise(state["done"])
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(words, start, add, lambda s: F.concat(s["done"], s["line"]))


def inline_markdown(c: Column) -> Column:
    """Escaped text with links, bold and code as HTML."""
    out = escape_html(c)
    for pattern, made in ((r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"`([^`]+)`", "<code>$1</code>")):
        out = F.regexp_replace(out, pattern, made)
    return out


def unique_ids(df: DataFrame, title: str, order: str, name: str = "html_id") -> DataFrame:
    """Slugs of titles; the second and later ones of a slug get -2, -3 and so on, in the given order."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(order))
    base = df.withColumn(name, slug(F.col(title))).withColumn("__n", place)
    return base.withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("-", name, F.col("__n"))).otherwise(F.col(name))).drop("__n")


def url_quoted(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def composite_key(a: Column, b: Column, c: Column) -> Column:
    """Parts joined by '::', the middle one as a slug; missing parts are empty."""
    return F.concat_ws("::", F.coalesce(a, F.lit("")), slug(b), F.coalesce(c, F.lit("")))


def hub_license(tags: Column, card: Column) -> Column:
    """The first license tag, else the card's licenses joined by commas."""
    return F.coalesce(tagged_value(tags, "license:"), F.nullif(F.array_join(card, ","), F.lit("")))
