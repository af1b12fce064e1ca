"""One consistent form of texts that look alike but differ in characters.

DuckDB runs inside each Arrow partition, on one thread, with the mapping as
embedded SQL: full-width and joined forms, invisible characters, kinds of spaces
and hyphens and letters of other alphabets that look like Latin ones are mapped by
`translate` and `replace`, and accents are composed by `nfc_normalize`.  Composed
letters of other alphabets follow after that.  Texts of ASCII alone stay as they
are.  Case, digits, accents, words and the number of spaces are kept: what a
reader sees as different stays different.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, parallel

# Letters of other alphabets and the Latin letters they look like.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "\u1fbe": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I", "ѵ": "v",
    # Armenian and phonetic letters
    "օ": "o", "ս": "u", "ɡ": "g", "ɑ": "a",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Signs that are letters by another code
    "K": "K", "Å": "Å",
}
#: The same with an accent, after composition.
COMPOSED = {"Ѐ": "È", "Ё": "Ë", "Ї": "Ï", "ѐ": "è", "ё": "ë", "ї": "ï", "ӑ": "ă", "Ӑ": "Ă", "ӓ": "ä", "Ӓ": "Ä", "ӗ": "ĕ", "Ӗ": "Ĕ", "ӧ": "ö", "Ӧ": "Ö", "ӱ": "ÿ", "ό": "ó", "Ά": "Á", "Έ": "É", "Ή": "H́", "Ί": "Í", "Ό": "Ó", "Ύ": "Ý", "Ϊ": "Ï", "Ϋ": "Ÿ"}
_BMP_AND_STYLES = (*range(0x00A0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F250))


def _compatible() -> dict[str, str]:
    """Compatibility forms that look like what they decompose to, by the Unicode data of the interpreter.

    Full-width and half-width forms, letters in another style, joined letters and
    Roman numerals, and dots of leaders.  Forms that a reader tells apart, such as
    superscripts, fractions and characters in circles, aren't among them.
    """
    out = {}
    for c in map(chr, _BMP_AND_STYLES):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        name = unicodedata.name(c, "")
        alike = kind in ("<wide>", "<narrow>", "<font>") or (kind == "<compat>" and (any(x in name for x in ("LIGATURE", "DIGRAPH", "ROMAN NUMERAL", " DOT LEADER", "HORIZONTAL ELLIPSIS")) or name.startswith("LATIN") and len(rest.split(" ")) > 1))
        if alike and "ARABIC" not in name and "HEBREW" not in name:
            out[c] = unicodedata.normalize("NFKC", c)
    return out


#: Kinds of spaces and of hyphens; dashes of another length are none.
SPACES = "".join(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs" and c != "\u1680")
HYPHENS = "‐‑‒⁃−﹣－"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))

_FORMS = _compatible()
#: Letters in another style or width may look like letters of the Latin alphabet in turn.
_SINGLE = {c: LOOKALIKES.get(x, x) for c, x in _FORMS.items() if len(x) == 1 and c not in HYPHENS}
JOINED = {c: x for c, x in _FORMS.items() if len(x) > 1}
FIRST = _SINGLE | {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | LOOKALIKES

#: Letters that a Cyrillic word shares with Latin ones by look, for words that have a letter no Latin word has.
CYRILLIC = {x: c for c, x in LOOKALIKES.items() if c in "АВЕКМНОРСТХУаеорсухіјѕІЈЅ"} | {"Ë": "Ё", "ë": "ё", "Ï": "Ї", "ï": "ї", "ă": "ӑ", "ä": "ӓ", "ö": "ӧ", "ÿ": "ӱ"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expression(column: str) -> str:
    """DuckDB SQL for the consistent form of a text column; null stays null."""
    first = {k: v for k, v in FIRST.items() if len(v) == 1}
    # translate drops characters without a partner: the invisible ones come last.
    inner = f"translate({column}, {_quoted(''.join(first) + INVISIBLE)}, {_quoted(''.join(first.values()))})"
    for joined, parts in JOINED.items():
        inner = f"replace({inner}, {_quoted(joined)}, {_quoted(parts)})"
    single = {k: v for k, v in COMPOSED.items() if len(v) == 1}
    inner = f"translate(nfc_normalize({inner}), {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for joined, parts in COMPOSED.items():
        if len(parts) > 1:
            inner = f"replace({inner}, {_quoted(joined)}, {_quoted(parts)})"
    return rf"CASE WHEN regexp_matches({column}, '[^\x00-\x7F]') THEN {inner} ELSE {column} END"


#: Latin letters that no Cyrillic letter looks like.
_LATIN_ONLY = "".join(c for c in map(chr, range(0x41, 0x7B)) if c.isalpha() and c not in CYRILLIC)


def _text_of(table: str) -> str:
    """DuckDB SQL for the rest of a SELECT of `text` in the consistent form from a table with doc_id and text.

    It is that of `expression`, but Cyrillic words keep their alphabet: words with a letter that
    only Cyrillic has are written in Cyrillic throughout, and in texts with more such letters than
    Latin ones that Cyrillic lacks, so are words without either.  As texts that look the same have
    the same such letters, they still have one form.
    """
    word = f"CASE WHEN regexp_matches(w, '[Ѐ-ӿ]') OR (cyrillic > latin AND NOT regexp_matches(w, '[{_LATIN_ONLY}]')) THEN translate(w, {_quoted(''.join(CYRILLIC))}, {_quoted(''.join(CYRILLIC.values()))}) ELSE w END"
    # Words and what stands between them by turns.
    parts = r"regexp_extract_all(form, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+')"
    counted = f"SELECT *, length(regexp_replace(form, '[^Ѐ-ӿ]', '', 'g')) AS cyrillic, length(regexp_replace(form, '[^{_LATIN_ONLY}]', '', 'g')) AS latin FROM (SELECT doc_id, {expression('text')} AS form FROM {table})"
    return f"CASE WHEN cyrillic > 0 THEN array_to_string(list_transform({parts}, lambda w: {word}), '') ELSE form END AS text FROM ({counted})"


def _in_duckdb(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """`sql` over the table `batch`, run on every Arrow batch of `df`."""

    def run(batches):
        import duckdb

        connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            if not batch.num_rows:
                continue
            connection.register("batch", pa.Table.from_batches([batch]))
            out = connection.sql(sql).to_arrow_table()
            connection.unregister("batch")
            yield from out.to_batches()
        connection.close()

    return df.mapInArrow(run, schema)


def consistent(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every document's text in the consistent form."""
    return _in_duckdb(parallel(documents.select("doc_id", "text")), f"SELECT doc_id, {_text_of('batch')}", "doc_id bigint, text string")


def found(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b): pairs of documents of one consistent form whose characters differ.

    Null texts pair with nothing, nor do rows without an id.  Only digests of forms
    and texts are shuffled, and only forms that occur in several spellings are joined.
    """
    sql = f"SELECT doc_id, md5({expression('text')}) AS form, md5(text) AS exact FROM batch"
    keys = checkpointed(_in_duckdb(parallel(documents.select("doc_id", "text").where("doc_id is not null and text is not null")), sql, "doc_id bigint, form string, exact string").select("doc_id", F.unhex("form").alias("form"), F.unhex("exact").alias("exact")))
    several = keys.groupBy("form").agg(F.min("exact").alias("low"), F.max("exact").alias("high")).where("low != high").select("form")
    live = keys.join(several, "form")
    # Spellings are paired, not documents: copies of one text never meet each other.
    spellings = live.select("form", "exact").distinct()
    pairs = spellings.select("form", F.col("exact").alias("one")).join(spellings.select("form", F.col("exact").alias("two")), "form").where("one < two").select("one", "two")
    owners = live.select("exact", "doc_id")
    both = pairs.join(owners.select(F.col("exact").alias("one"), F.col("doc_id").alias("x")), "one").join(owners.select(F.col("exact").alias("two"), F.col("doc_id").alias("y")), "two")
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


FOUND_SQL = f"""
WITH forms AS (SELECT doc_id, text, {expression('text')} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b
FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
"""
CONSISTENT_SQL = f"SELECT doc_id, {_text_of('documents')}"
