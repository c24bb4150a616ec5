"""Text normalisation, predicates, lengths and formatting.

White space means what Python's ``str.strip`` removes: Unicode white space and the four
information separators. Line starts and ends are those at a line feed only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class body, to be used with the flag (?U).
WS = r"\s\x1c-\x1f"
#: The same characters one by one, for built-in trimming.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The token that stands for a protected region, and the mark of a code fence.
TOKEN = r"\{\{PH_[A-Z_0-9]+\}\}"
FENCE = "```"


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def strip_bom(text: Column) -> Column:
    return sub(text, "\\A\ufeff+", "")


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_segment(text: Column) -> Column:
    """LF line ends, runs of blanks and tabs as one blank, no white space at the ends."""
    return strip(sub(newlines(text), r"[ \t]{2,}|\t", " "))


def canonical(text: Column) -> Column:
    """The form in which two versions of a segment are compared."""
    return strip(newlines(text))


# predicates on single lines


def is_heading(line: Column) -> Column:
    return line.rlike(rf"(?U)\A[{WS}]{{0,3}}#{{1,6}}[{WS}]+[^{WS}]")


def is_unordered_item(line: Column) -> Column:
    return line.rlike(rf"(?U)\A[{WS}]{{0,3}}[-*+][{WS}]+[^{WS}]")


def is_ordered_item(line: Column) -> Column:
    return line.rlike(rf"(?U)\A[{WS}]{{0,3}}\d+\.[{WS}]+[^{WS}]")


def is_table_row(line: Column) -> Column:
    """A pipe at either end; a lone pipe is both."""
    return line.rlike(rf"(?Us)\A[{WS}]*\|(?:.*\|)?[{WS}]*\z")


def is_fence(line: Column) -> Column:
    return line.rlike(rf"(?U)\A[{WS}]*```")


def is_blank(line: Column) -> Column:
    return line.rlike(rf"(?U)\A[{WS}]*\z")


# predicates on whole texts


def fence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?dm)^```"))


def looks_translatable(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_token(text: Column) -> Column:
    return text.rlike(TOKEN)


def contains_term(text: Column, term: Column, low: Column | None = None) -> Column:
    """A term with ASCII letters or digits must stand alone, in any case; any other must occur as it is.

    The first place where the term occurs is looked at without a pattern, as one made from a column is compiled
    for every row; only if that place is inside a word, a pattern looks for others. ``low`` is the text in lower
    case where a caller has it at hand.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit("(?iu)(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])"))
    low, low_term = F.lower(text) if low is None else low, F.lower(term)
    at = F.instr(low, low_term)
    around = F.concat(
        F.when(at > 1, F.substring(low, at - 1, F.lit(1))).otherwise(""), F.substring(low, at + F.length(low_term), F.lit(1))
    )
    alone = (
        F.when(at == 0, False).when((F.length(low) == F.length(text)) & ~around.rlike("[a-z0-9_]"), True)
        .otherwise(F.regexp(text, pattern))
    )
    hit = F.when(term.rlike("[A-Za-z0-9]"), alone).otherwise(F.contains(text, term))
    return F.when((text == "") | (term == ""), False).otherwise(hit)


def strip_fenced_code(text: Column) -> Column:
    return sub(text, r"(?msd)^```.*?^```[ \t]*\n?", "")


def unbalanced_backticks(text: Column) -> Column:
    """An odd number of lone backticks outside fences and double-backtick spans."""
    rest = sub(strip_fenced_code(text), "``[^`]*``", "")
    return F.regexp_count(rest, F.lit("(?<!`)`(?!`)")) % 2 != 0


def leftover_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))))


def malformed_links(text: Column) -> Column:
    """More link openings than well-formed links."""
    rest = strip_fenced_code(text)
    return F.regexp_count(rest, F.lit(r"\]\(")) > F.regexp_count(rest, F.lit(r"\[[^\]\n]+\]\([^)]+\)"))


# lengths


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return F.regexp_count(text, F.lit(rf"(?U)[^{WS}]+"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3).cast("int")


def route(text: Column, max_length: int = 5000) -> Column:
    return F.when(F.length(text) > max_length, "SPLIT").otherwise("OK")


# languages


def lang_prefix(lang: Column) -> Column:
    return F.split_part(F.lower(strip(F.coalesce(lang, F.lit("")))), F.lit("-"), F.lit(1))


def reversed_direction(source_lang: Column, target_lang: Column) -> Column:
    """Chinese into English, against the direction that terminologies are kept in."""
    return F.startswith(lang_prefix(source_lang), F.lit("zh")) & F.startswith(lang_prefix(target_lang), F.lit("en"))


# formatting


def escape_markup(text: Column) -> Column:
    """For XML and HTML, in text and in attribute values."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def format_seconds(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds.cast("long"))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(
        F.format_string("%dm%02ds", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))
    )


def progress_line(current: Column, total: Column, stage: Column, status: Column, detail: Column) -> Column:
    """Null unless current is between 1 and total; the detail may be null or empty."""
    head = F.format_string("[PROGRESS] %d/%d %s | %s", current, total, stage, status)
    whole = F.when(F.coalesce(detail, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" | "), detail))
    return F.when((current >= 1) & (current <= total), whole)


def eta_detail(elapsed: Column, expected: Column) -> Column:
    """Null where elapsed is below 0 or expected isn't above 0."""
    percent = F.floor(F.least(F.lit(1.0), elapsed / expected) * 100)
    return F.when((elapsed >= 0) & (expected > 0), F.concat(
        F.lit("elapsed="), format_seconds(elapsed),
        F.lit(" eta="), format_seconds(F.greatest(F.lit(0), expected - elapsed)),
        F.lit(" progress="), percent.cast("string"), F.lit("%"),
    ))
