"""Ordered-rule classification (X11-X15): data-driven tables compiled into CASE expressions, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, normalize_name

# Rule tables, word lists and patterns that results depend on.
VENDOR_RULES = (
    ("OpenAI", ("openai",)),
    ("Anthropic", ("anthropic",)),
    ("Google", ("google", "deepmind")),
    ("Meta", ("meta", "facebook")),
    ("Mistral", ("mistral",)),
    ("DeepSeek", ("deepseek",)),
    ("Alibaba", ("qwen", "alibaba", "tongyi")),
    ("xAI", ("x-ai", "xai", "grok")),
    ("Microsoft", ("microsoft",)),
)
FAMILY_PATTERNS = (
    ("Claude", (r"\bclaude\b",)),
    ("Gemini", (r"\bgemini\b", r"\bpalm\b")),
    ("Gemma", (r"\bgemma\b",)),
    ("GPT", (r"\bgpt(?:[-\s.]?\d|[-\s]?oss|[-\s]?latest|$)", r"\bo[1345](?:\b|-)", r"\bcodex\b")),
    ("Llama", (r"\bllama\b", r"\bmeta-llama\b")),
    ("DeepSeek", (r"\bdeepseek\b",)),
    ("Qwen", (r"\bqwen(?:\d|\b)", r"\btongyi\b")),
    ("Mistral", (r"\bmistral\b", r"\bmixtral\b")),
    ("Grok", (r"\bgrok\b", r"\bx-ai\b")),
    ("Phi", (r"\bphi[-\s]?\d", r"\bphi\b")),
    ("Command", (r"\bcommand[-\s]?r", r"\bcommand\b")),
    ("Yi", (r"\byi[-\s]?\d",)),
)
FAMILY_WORDS = (
    ("DeepSeek", ("deepseek",)),
    ("Claude", ("claude", "anthropic")),
    ("Gemma", ("gemma",)),
    ("Gemini", ("gemini",)),
    ("Grok", ("grok", "x-ai", "xai")),
    ("Qwen", ("qwen", "qwq", "alibaba")),
    ("Llama", ("llama", "sao10k", "meta-llama")),
    ("Mistral", ("mistral", "mixtral", "codestral", "ministral", "pixtral", "devstral", "voxtral")),
    ("Phi", ("phi-", "phi ", "microsoft/phi")),
    ("Command", ("command-r",)),
    ("GPT", ("gpt", "openai", " o1", " o3", " o4")),
)
OPEN_WEIGHT_HINTS = (
    "meta-llama", "llama", "mistral", "mixtral", "qwen", "deepseek", "yi-", "gemma", "phi-", "command-r", "olmo",
    "falcon", "baichuan", "nous", "openchat",
)
CLOSED_VENDOR_HINTS = ("openai", "anthropic", "google", "x-ai", "perplexity", "amazon", "ai21", "microsoft")
NOISE_TOKENS = (
    "api", "beta", "chat", "experimental", "fast", "free", "instruct", "latest", "lite", "mini", "preview", "pro",
    "thinking", "turbo",
)
PROVIDER_PREFIXES = (
    "ai21", "alibaba", "anthropic", "deepseek", "google", "meta", "meta-llama", "microsoft", "mistral", "openai",
    "qwen", "x-ai",
)
FAMILY_ALIASES = {
    "GPT": ("gpt", "chatgpt", "o1", "o3", "o4", "o5"),
    "Claude": ("claude", "opus", "sonnet", "haiku"),
    "Gemini": ("gemini", "palm"),
    "Gemma": ("gemma",),
    "Qwen": ("qwen", "qwq", "tongyi"),
    "Llama": ("llama", "meta-llama"),
    "Mistral": ("mistral", "mixtral", "codestral", "ministral", "pixtral", "devstral"),
    "DeepSeek": ("deepseek",),
    "Grok": ("grok", "xai", "x-ai"),
    "Phi": ("phi",),
    "Command": ("command", "command-r"),
}
#: Family to (pattern, its groups).
VERSION_PATTERNS = {
    "GPT": ((r"\bgpt[-_ ]?([0-9]+(?:\.[0-9]+)?)", 1), (r"\b(o[0-9])\b", 1)),
    "Claude": ((r"\bclaude[-_ ]?(opus|sonnet|haiku)?[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 2),),
    "Gemini": ((r"\bgemini[-_ ]?([0-9]+(?:\.[0-9]+)?)?[-_ ]?(pro|flash)?", 2),),
    "Gemma": ((r"\bgemma[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 1),),
    "Qwen": ((r"\bqwen[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 1),),
    "Llama": ((r"\bllama[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 1),),
    "Mistral": ((r"\b(mistral|mixtral|codestral|ministral|pixtral|devstral)[-_ ]?([a-z0-9.]+)?", 2),),
    "DeepSeek": ((r"\bdeepseek[-_ ]?([a-z0-9.]+)?", 1),),
    "Grok": ((r"\bgrok[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 1),),
    "Phi": ((r"\bphi[-_ ]?([0-9]+(?:\.[0-9]+)?)?", 1),),
    "Command": ((r"\bcommand[-_ ]?r?[-_ ]?([a-z0-9.]+)?", 1),),
}
FAMILY_VENDOR = {
    "GPT": "OpenAI", "Claude": "Anthropic", "Gemini": "Google", "Gemma": "Google", "Qwen": "Alibaba", "Llama": "Meta",
    "Mistral": "Mistral", "DeepSeek": "DeepSeek", "Grok": "xAI", "Phi": "Microsoft", "Command": "Command",
}


def any_substring(c: Column, words: tuple[str, ...]) -> Column:
    """F6."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def first_rule(c: Column, rules, test, default: Column) -> Column:
    """Name of the first rule whose test holds; the engine of all tables here."""
    case = None
    for name, needles in rules:
        case = (F if case is None else case).when(test(c, tuple(needles)), F.lit(name))
    return case.otherwise(default)


def canonical_vendor(organization: Column, name: Column) -> Column:
    """X11."""
    org, model = clean_text(organization), clean_text(name)
    text = F.lower(F.concat_ws(" ", F.coalesce(organization, F.lit("")), F.coalesce(name, F.lit(""))))
    default = (
        F.when((org != "") & ~F.contains(org, F.lit(",")), org)
        .when(F.contains(model, F.lit(":")), F.substring_index(model, ":", 1))
        .otherwise(F.lit("Unknown"))
    )
    return first_rule(text, VENDOR_RULES, any_substring, default)


def classify_family(name: Column, organization: Column) -> Column:
    """X12."""
    text = F.lower(F.concat(F.lit(" "), clean_text(name), F.lit(" "), clean_text(organization), F.lit(" ")))
    return first_rule(text, FAMILY_PATTERNS, any_pattern, F.lit("Other"))


def classify_entity(name: Column, organization: Column) -> Column:
    """Struct of vendor, model_family and product_line."""
    family = classify_family(name, organization)
    return F.struct(
        canonical_vendor(clean_text(organization), clean_text(name)).alias("vendor"),
        family.alias("model_family"),
        family.alias("product_line"),
    )


def family_of_model(name: Column, model_id: Column, vendor: Column) -> Column:
    """Substring rules first, then X15."""
    parts = [clean_text(c) for c in (name, model_id, vendor)]
    text = F.lower(F.concat_ws(" ", *parts))
    return first_rule(text, FAMILY_WORDS, any_substring, classify_family(F.concat_ws(" ", *parts), F.lit("")))


def classify_access(name: Column, organization: Column, accessibility: Column, open_weights: Column) -> Column:
    """X13."""
    parts = [F.coalesce(c, F.lit("")) for c in (name, organization, accessibility, open_weights)]
    text = F.lower(F.concat_ws(" ", *parts))
    return (
        F.when(any_substring(text, ("not released", "unreleased")), F.lit("not_released"))
        .when(any_substring(text, ("open weights", "open-weight")) | (F.lower(parts[3]) == "yes"), F.lit("open_weight"))
        .when(any_substring(text, ("gpt-oss",)), F.lit("open_weight"))
        .when(any_substring(text, OPEN_WEIGHT_HINTS), F.lit("likely_open_weight"))
        .when(any_substring(text, ("api", "closed", *CLOSED_VENDOR_HINTS)), F.lit("closed_or_api"))
        .otherwise(F.lit("unknown"))
    )


def excluded(columns: list[Column], patterns: tuple[str, ...]) -> Column:
    """whether any of the patterns occurs in the lower-case columns joined by spaces."""
    return F.lower(F.concat_ws(" ", *columns)).rlike("|".join(patterns))


def normalized_model(c: Column) -> Column:
    return normalize_name(c, NOISE_TOKENS, PROVIDER_PREFIXES)


def _version_aliases(text: Column, family: str) -> Column:
    """Forms of the family with the versions found in the text, and of the family itself if any was found."""
    out = F.array().cast("array<string>")
    for pattern, groups in VERSION_PATTERNS.get(family, ()):
        each = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        joined = F.transform(
            F.arrays_zip(*(e.alias(f"g{k}") for k, e in enumerate(each))),
            lambda z: F.concat_ws(" ", *(F.nullif(z[f"g{k}"], F.lit("")) for k in range(groups))),  # noqa: B023
        )
        named = F.transform(F.filter(joined, lambda j: j != ""), lambda j: normalized_model(F.concat(F.lit(family + " "), j)))
        own = F.when(F.size(joined) > 0, F.array(normalized_model(F.lit(family)))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, named, own)
    return out


def alias_set(name: Column, model_id: Column, family: Column, families: tuple[str, ...] = tuple(FAMILY_ALIASES)) -> Column:
    """Sorted distinct normalized forms by which two records of one model may meet."""
    a, b = clean_text(name), clean_text(model_id)
    text = F.lower(F.concat_ws(" ", a, b))
    base = F.array(normalized_model(a), normalized_model(b))
    case = None
    for f in families:
        words = F.concat(
            *(F.when(F.contains(text, F.lit(w)), F.array(normalized_model(F.lit(w)))).otherwise(F.array().cast("array<string>")) for w in FAMILY_ALIASES[f])
        )
        case = (F if case is None else case).when(family == f, F.concat(words, _version_aliases(text, f)))
    every = F.concat(base, case.otherwise(F.array().cast("array<string>"))) if case is not None else base
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))))
