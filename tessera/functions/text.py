"""Text rules as column expressions; all but the JSON parser stay in the JVM.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose meaning results depend on.
ID_PATTERN = r"(?i)\bNCT\d{8}\b"
TOKEN_PATTERN = r"[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
_BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"

# Category codes and the words that name them.
TAXONOMY_ALIASES: dict[str, tuple[str, ...]] = {
    "AREA": ("area", "domain", "landscape"),
    "FRAME": ("frame", "framework"),
    "COND": ("cond", "condition", "disease"),
    "INTR": ("intr", "intervention", "treatment"),
    "OUTC": ("outc", "outcome", "endpoint", "measure"),
    "SPON": ("spon", "sponsor"),
    "PHASE": ("phase", "trial phase"),
    "STATUS": ("status", "recruitment status"),
    "TRIAL": ("trial", "study"),
}

# Price of a prompt token and of a completion token.
PROMPT_PRICE, COMPLETION_PRICE = 1.0 / 1_000_000, 5.0 / 1_000_000


# Fixed value: the white space of Unicode, as the inside of a character class.
BLANKS = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(s: Column) -> Column:
    """Runs of white space, that of Unicode too, become one blank; none at the ends."""
    return F.trim(F.regexp_replace(s, f"[{BLANKS}]+", " "))


def squeeze_long(name: str) -> Column:
    """``squeeze`` of a column of long texts: most ASCII texts have single blanks only, which byte searches tell without a pattern."""
    s = F.col(name)
    odd = F.octet_length(s) != F.char_length(s)
    for blank in ("  ", *"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"):
        odd = odd | F.contains(s, F.lit(blank))
    return F.when(odd, squeeze(s)).otherwise(F.trim(s))


def canonical(s: Column) -> Column:
    """Lower case, punctuation but the underscore a blank, blanks squeezed."""
    # all white space is outside the class, so one pattern does both steps
    return F.trim(F.regexp_replace(F.lower(s), _BETWEEN_WORDS, " "))


def canonical_words(s: Column) -> Column:
    """The words of the canonical form, read off the text at once; empty ones at an end that is no word."""
    return F.split(F.lower(s), _BETWEEN_WORDS)


def canonical_label(s: Column) -> Column:
    """A registry number in the label stands for it, else its canonical form."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(F.upper(s), r"\bNCT\d{8}\b", 0)), F.lit("")), canonical(s))


def normalize(s: Column) -> Column:
    """Like canonical, but emphasis marks, underscores and heading marks go too."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(s), r"[*_`]+", " "), r"#+\s*", " ")
    return squeeze(F.regexp_replace(plain, NOT_WORD, " "))


def _chain(s: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, by in steps:
        s = F.regexp_replace(s, pattern, by)
    return F.btrim(s, F.lit(" \t\n\r\f\x0b"))


# What each markup filter takes out, in this order.
LOSSY_MARKUP = ((r"(?s)<details>.*?</details>", ""), (r"<[^>]+>", ""), (r"(?m)^!!!.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"https?://[^\s)]+", ""), (r"\n{3,}", "\n\n"))
CAREFUL_MARKUP = ((r"(?is)<details\b[^>]*>.*?</details>", ""), (r"(?s)<!--.*?-->", ""), (r"(?m)^!!!.*$", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"https?://[^\s)]+", ""), (r"\n{3,}", "\n\n"))


def strip_markup(s: Column) -> Column:
    """Drops whatever looks like a tag, clinical ``<26 ... >`` spans included."""
    return _chain(s, LOSSY_MARKUP)


def strip_markup_carefully(s: Column) -> Column:
    """Drops comments, details blocks, images and addresses; keeps ``<`` in prose."""
    return _chain(s, CAREFUL_MARKUP)


def tokens(s: Column) -> Column:
    """Lower-case ASCII tokens, joined parts kept together."""
    return F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), F.lower)


def registry_ids(*texts: Column) -> Column:
    """Sorted distinct registry numbers of some texts."""
    s = F.concat_ws(" ", *texts)
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(ID_PATTERN), F.lit(0)), F.upper)))


def taxonomy_value(s: Column) -> Column:
    """The code an alias or a code names, else the canonical form in capitals."""
    plain, out = canonical(s), None
    for code, names in TAXONOMY_ALIASES.items():
        hit = plain.isin(code.lower(), *names)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(F.upper(plain))


def holds_term(context: Column, target: Column) -> Column:
    """Whether the canonical target stands in the canonical context between word borders.

    Canonical texts hold words and single blanks only, so a padded substring
    test says the same as a pattern with borders.
    """
    t = canonical(target)
    return (t != "") & F.contains(F.concat(F.lit(" "), canonical(context), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" ")))


def holds_substring(context: Column, target: Column) -> Column:
    """The older, looser test: a plain substring."""
    return F.contains(canonical(context), canonical(target))


def clean_text(s: Column) -> Column:
    """Squeezed; null gives an empty text."""
    return squeeze(F.coalesce(s.cast("string"), F.lit("")))


def clean_label(s: Column, limit: int = 120) -> Column:
    """Squeezed, without bullet and outer punctuation, cut to ``limit`` with dots."""
    bare = F.btrim(F.regexp_replace(clean_text(s), r"^[*-]\s+", ""), F.lit(" .;:,"))
    return F.when(F.length(bare) > limit, F.concat(F.rtrim(F.substring(bare, 1, limit - 3), F.lit(" .;:,")), F.lit("..."))).otherwise(bare)


def slugify(s: Column) -> Column:
    """Lower-case letters and digits joined by hyphens; ``item`` if none."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.when(bare == "", "item").otherwise(bare)


def truncate(s: Column, limit: int = 2200) -> Column:
    """Cut to ``limit`` characters with dots."""
    return cut(clean_text(s), limit)


def cut(text: Column, limit: int = 2200) -> Column:
    """``truncate`` of a text that is clean already."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def first_sentence(s: Column, limit: int = 140) -> Column:
    """Up to the first full stop, exclamation or question mark before a blank, cleaned like a label."""
    text = clean_text(s)
    found = F.regexp_extract(text, r"^(.*?[.!?]) ", 1)
    return clean_label(F.when(found == "", text).otherwise(found), limit)


def n_blank_tokens(s: Column) -> Column:
    """The number of white-space separated tokens; 0 for null."""
    bare = squeeze(F.coalesce(s, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def preview(s: Column, limit: int = 200) -> Column:
    return F.concat(F.substring(s, 1, limit), F.lit("..."))


def cost(prompt_tokens: Column, completion_tokens: Column, digits: int = 8) -> Column:
    """Price of a call."""
    return F.round(prompt_tokens * F.lit(PROMPT_PRICE) + completion_tokens * F.lit(COMPLETION_PRICE), digits)


def yield_per_token(f1: Column, total_tokens: Column) -> Column:
    """Score per token spent; 0 where none was."""
    return F.when(total_tokens > 0, F.round(f1 / total_tokens, 8)).otherwise(F.lit(0.0))


def dense_query(s: Column, model: Column | str, instruction: str) -> Column:
    """Queries of models of one family get an instruction before them."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.when(F.contains(F.lower(name), F.lit("bge-")), F.concat(F.lit(instruction), s)).otherwise(s)


def _object_parser(strict: bool):
    """A vectorised function from answers to the JSON text of their object.

    It holds all it needs, so that Python workers need not have this package.
    """

    def parse(answers: pd.Series) -> pd.Series:
        import json
        import re

        broken = object()

        def loaded(text: str) -> object:
            try:
                return json.loads(text)
            except ValueError:
                return broken

        def object_in(answer: str | None) -> str | None:
            bare = (answer or "").strip()
            if bare.startswith("```") and strict:
                inside = re.fullmatch(r"```(?:json)?\s*(\{.*\})\s*```", bare, re.I | re.S)
                bare = inside[1] if inside else ""
            elif bare.startswith("```"):
                bare = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", bare, flags=re.I))
            said = loaded(bare)
            if said is broken and not strict and (at := bare.find("{")) >= 0:
                said = loaded(bare[at : bare.rfind("}") + 1])
            return json.dumps(said) if isinstance(said, dict) else None

        return pd.Series([object_in(x) for x in answers], dtype=object)

    parse.__annotations__ = {"answers": pd.Series, "return": pd.Series}
    return parse


def json_object(s: Column | str) -> Column:
    """The JSON object in an answer: the whole of it, the body of a code fence,
    or the span from the first to the last brace; null if that is no object.

    Exact parsing is beyond the JVM functions, which read single quotes and stop
    at the end of the first object; this runs over Arrow batches.
    """
    return F.pandas_udf(_object_parser(False), "string")(s)


def strict_json_object(s: Column | str) -> Column:
    """Like json_object, but the whole answer, or one fence around it, must be the object."""
    return F.pandas_udf(_object_parser(True), "string")(s)


def json_labels(obj: Column) -> Column:
    """The labels of a parsed answer as strings; none if they are no list."""
    listed = F.get_json_object(obj, "$.labels")
    return F.when(F.startswith(listed, F.lit("[")), F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
