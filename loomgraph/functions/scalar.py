"""Scalar functions on columns, all of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning"}


def occurrences(text: Column, needle: str) -> Column:
    """How often a needle occurs in a text, without overlaps; 0 for null."""
    return F.coalesce(((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int"), F.lit(0))


def keyword_count(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """The sum of the occurrences of all needles in the lower-case text."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (occurrences(low, n) for n in needles))


def any_of(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    """Whether a text has one of the needles."""
    return reduce(lambda a, b: a | b, (F.coalesce(text.contains(n), F.lit(False)) for n in needles))


def entropy(text: Column) -> Column:
    """Shannon entropy of the text's UTF-8 bytes in bits a byte; 0 for an empty or null text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    n = F.size(pairs).cast("double")
    # Counts come from the lengths between the sorted array's steps.
    kinds = F.array_distinct(pairs)
    total = F.aggregate(kinds, F.lit(0.0), lambda acc, k: acc - (F.size(F.filter(pairs, lambda x: x == k)) / n) * F.log2(F.size(F.filter(pairs, lambda x: x == k)) / n))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(total)


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of at least two bytes, in order."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 2)


def severity_rank(severity: Column) -> Column:
    """1 (LOW) to 4 (CRITICAL), 0 for anything else."""
    out = F.lit(0)
    for rank, name in enumerate(SEVERITIES, 1):
        out = F.when(F.upper(severity) == name, rank).otherwise(out)
    return out


def sarif_level(severity: Column) -> Column:
    out = F.lit("note")
    for name, level in SARIF_LEVELS.items():
        out = F.when(F.upper(severity) == name, level).otherwise(out)
    return out


def weakness(value: Column) -> Column:
    """`CWE-n` of any spelling, null where no number is given."""
    n = F.regexp_extract(F.upper(F.regexp_replace(value, r"[\s_]", "")), r"^(?:CWE)?-?0*(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def fingerprint(*parts: Column) -> Column:
    """Parts joined by `|`; a null part is empty."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def location(path: Column, line: Column, column: Column | None = None) -> Column:
    """`path:line:column`, without the parts that are null."""
    return F.concat_ws(":", path, line.cast("string"), *([] if column is None else [column.cast("string")]))


def module_stem(path: Column) -> Column:
    """A path's file name without its extension."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def language_of(path: Column, content: Column | None = None) -> Column:
    """`python` or `java` by extension; else by the content's signs, python where there are none; `unknown` without content."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    other = F.lit("unknown")
    if content is not None:
        other = F.when(any_of(content, ("public class ", "import java.", ";\n")) | content.startswith("package "), "java").otherwise("python")
    return F.when(extension == "py", "python").when(extension == "java", "java").otherwise(other)


# Access paths: arrays of segments behind a root.


def path_append(path: Column, segment: Column) -> Column:
    return F.concat(path, F.array(segment))


def path_truncate(path: Column, k: int) -> Column:
    """The first k segments, and a wildcard where there were more."""
    return F.when(F.size(path) > k, F.concat(F.slice(path, 1, k), F.array(F.lit("*")))).otherwise(path)


def path_normalise(path: Column) -> Column:
    return F.transform(path, lambda s: F.trim(s))


def path_key(root: Column, path: Column) -> Column:
    return F.concat_ws(".", root, F.array_join(F.filter(path, lambda s: s != ""), "."))


def last_k(context: Column, item: Column, k: int) -> Column:
    """A k-limited context after an item is pushed: its last k items."""
    pushed = F.concat(context, F.array(item))
    return F.slice(pushed, F.greatest(F.size(pushed) - k + 1, F.lit(1)), k)
