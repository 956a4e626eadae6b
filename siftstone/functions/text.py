"""Text functions over columns, all built from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the patterns below must match as the original rules do.
INJECTION = [r"ignore\s+previous\s+instructions", r"disregard\s+all\s+prior", r"forget\s+everything", r"system\s*:\s*", r"<\s*script", r"javascript\s*:", r"on\w+\s*="]
MARKDOWN_INJECTION = [r"(?i)!\[.*\]\(javascript:", r"(?i)\[.*\]\(data:", r"(?is)```.*?<script"]
EXECUTABLE_FENCES = ["```python", "```bash", "```sh"]
PII = {"email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "credit_card": r"\b\d{16}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b"}
REDACTIONS = [(PII["email"], "[EMAIL]"), (PII["ssn"], "[SSN]"), (PII["credit_card"], "[CARD]"), (r"discord_user_id:\s*\d+", "discord_user_id: [REDACTED]"), (r"user_id:\s*\d+", "user_id: [REDACTED]")]
ELLIPSES = ["[...]", "…", "..."]
TOKEN = r"(?U)\b[\w-]+\b"


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_all(text: Column, parts: list[str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), parts, text)


def normal_for_matching(text: Column) -> Column:
    """The form in which ground truths and texts are compared."""
    return drop_all(F.lower(squeeze(text)), ["*", *ELLIPSES])


def normal_quote(text: Column) -> Column:
    """The form in which quotes are compared: paired marks, code ticks and ellipses dropped."""
    for pattern in (r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"`([^`]+)`"):
        text = F.regexp_replace(text, pattern, "$1")
    return squeeze(F.lower(drop_all(text, ELLIPSES)))


def tokens(text: Column) -> Column:
    """Lower-case words with inner hyphens, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def sentences(text: Column) -> Column:
    """Lines cut after . ? ! and white space; trimmed, without empty ones."""
    broken = F.split(F.regexp_replace(text, r"([.?!])[^\S\n]+", "$1\n"), "\n")
    return F.filter(F.transform(broken, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def numbered(parts: Column) -> Column:
    return F.transform(parts, lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), s))


def verbatim(parts: Column, wanted: Column) -> Column:
    """The wanted sentences (1-based, any order): runs joined by a blank, gaps by ' [...] '."""
    known = F.array_sort(F.array_distinct(F.filter(wanted, lambda i: (i >= 1) & (i <= F.size(parts)))))
    joined = F.aggregate(
        known,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("last")),
        lambda acc, i: F.struct(F.concat(acc["text"], F.when(acc["last"] == 0, "").when(i == acc["last"] + 1, " ").otherwise(" [...] "), F.get(parts, i - 1)).alias("text"), i.cast("int").alias("last")),
        lambda acc: acc["text"],
    )
    return joined


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5), without a UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    return uuid5_of_digest(h)


def uuid5_in(namespace: Column, name: Column) -> Column:
    """As uuid5, with the namespace in a column."""
    return uuid5_of_digest(F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8"))))


def uuid5_of_digest(h: Column) -> Column:
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def injection_found(text: Column) -> Column:
    """Whether one of the patterns is met as they are blocked in turn."""
    found, text = F.lit(False), trim_all(text)
    for p in INJECTION:
        found = found | text.rlike(f"(?i){p}")
        text = F.regexp_replace(text, f"(?i){p}", "[BLOCKED]")
    return found


def blocked(text: Column) -> Column:
    """Trimmed, injections blocked, runs of three and more newlines cut to two, 2000 characters."""
    text = reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", "[BLOCKED]"), INJECTION, trim_all(text))
    return F.substring(F.regexp_replace(text, r"\n{3,}", "\n\n"), 1, 2000)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def markdown_fault(text: Column) -> Column:
    """Why a markdown text is refused, or null."""
    fault = F.lit(None).cast("string")
    fault = F.when(F.contains(F.lower(text), F.lit("<script")), "script").otherwise(fault)
    fences = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in EXECUTABLE_FENCES])
    fault = F.when(fences, "code").otherwise(fault)
    patterns = reduce(lambda a, b: a | b, [text.rlike(p) for p in MARKDOWN_INJECTION])
    return F.when(patterns, "injection").otherwise(fault)


def pii_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in PII.items())))


def redacted(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), REDACTIONS, text)


def for_model(text: Column) -> Column:
    """Control characters dropped, white space collapsed, 16000 characters."""
    return F.trim(F.substring(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", ""), r"\s+", " "), 1, 16000))


def safe_filename(name: Column) -> Column:
    name = F.regexp_replace(drop_all(name, ["..", "/", "\\"]), r"[^a-zA-Z0-9._-]", "")
    return F.when(F.endswith(name, F.lit(".md")), name).otherwise(F.concat(name, F.lit(".md")))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"<@!?(\d+)>"), 1)


def snippet(text: Column, size: int = 150) -> Column:
    """At most `size` characters, cut after the last full stop beyond the half, else with dots."""
    flat = squeeze(text)
    head = F.substring(flat, 1, size)
    stop = size + 1 - F.instr(F.reverse(head), ".")
    return F.when(F.length(flat) <= size, flat).when(F.contains(head, F.lit(".")) & (stop - 1 > size // 2), F.substring(head, F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))


def slug(text: Column, words: int = 3) -> Column:
    """The first words in lower case without punctuation, joined by hyphens."""
    bare = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")
    return F.array_join(F.slice(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), 1, words), "-")


def truncated(text: Column, size: int) -> Column:
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, size - 3), F.lit("...")))


def base_model(name: Column) -> Column:
    return F.split_part(name, F.lit("#"), F.lit(1))


def effort(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("#")), F.split_part(name, F.lit("#"), F.lit(2)))


def token_windows(parts: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens, each `overlap` before the end of the last."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    n = F.size(parts)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(parts, s + 1, size))
