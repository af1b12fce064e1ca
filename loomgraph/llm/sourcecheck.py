"""Source files that do not parse.

A file's tokens rank the languages it may be in; it is then parsed whole against
every supported grammar in that order: Python 3 by this interpreter's own parser,
Java 17 by `javasyntax`.  A file that fails in its named language is flagged; one
that another grammar accepts has a wrong language or extension, one that none
accepts is corrupt.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parallel
from . import javasyntax
from .groupsplit import repository

#: Tokens that tell the languages, counted as they stand.
_HINTS = {
    "python": (":\n", "def ", "self", "None", "elif ", "except", "import ", " not ", "#"),
    "java": (";\n", "{\n", "}\n", "public ", "private ", "static ", "final ", "void ", "new ", "//"),
}
#: Spellings of the languages.
_NAMES = {"python": ("python", "py", "python3", "py3"), "java": ("java", "java17")}


def parses_python(code: str) -> bool:
    """Whether a text is a whole file of Python 3 as far as syntax goes; nesting beyond the parser's depth is not."""
    try:
        compile(code.removeprefix("﻿"), "<file>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


GRAMMARS: dict[str, Callable[[str], bool]] = {"python": parses_python, "java": javasyntax.parses}


def ranked(code: str) -> list[str]:
    """The supported languages, the likeliest by its tokens first; ties in order of name."""
    scores = {name: sum(map(code.count, hints)) for name, hints in _HINTS.items()}
    return sorted(scores, key=lambda name: (-scores[name], name))


def language(value: Column) -> Column:
    """A supported language by its usual spellings, else the value in lower case."""
    text = F.lower(F.regexp_replace(value, r"\s+", ""))
    out = text
    for name, spellings in _NAMES.items():
        out = F.when(text.isin(*spellings), name).otherwise(out)
    return out


def checked(files: DataFrame) -> DataFrame:
    """(code_id, language, repo, likeliest, parsed_as, verdict) of every file.

    `verdict` is `ok`, `foreign` (another grammar accepts the file), `corrupt` (none
    does) or `unsupported` (no grammar for the named language, or none named).  A
    null code counts as an empty file, which parses in every language.
    """
    source = files.select("code_id", language(F.col("language")).alias("language"), F.coalesce(repository(F.col("repo")), F.lit("")).alias("repo"), "code")
    schema = "code_id bigint, language string, repo string, likeliest string, parsed_as string, verdict string"

    def run(batches):
        warnings.simplefilter("ignore")
        for batch in batches:
            likeliest, parsed, verdicts = [], [], []
            for code, named in zip(batch.column("code").to_pylist(), batch.column("language").to_pylist(), strict=True):
                code = code or ""
                order = ranked(code)
                good = [name for name in order if GRAMMARS[name](code)]
                likeliest.append(order[0])
                parsed.append(",".join(good))
                verdicts.append("unsupported" if named not in GRAMMARS else "ok" if named in good else "foreign" if good else "corrupt")
            yield pa.RecordBatch.from_arrays([batch.column("code_id").cast(pa.int64()), batch.column("language"), batch.column("repo"), pa.array(likeliest, pa.string()), pa.array(parsed, pa.string()), pa.array(verdicts, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return parallel(source).mapInArrow(run, schema)


def found(samples: DataFrame) -> DataFrame:
    """(code_id) of the files that do not parse in their language."""
    return checked(samples).where(F.col("verdict").isin("foreign", "corrupt")).select("code_id")


def rates(samples: DataFrame) -> DataFrame:
    """Per repository and language: files, those that fail, foreign and corrupt ones, and the rate of failures."""
    return (
        checked(samples)
        .groupBy("repo", F.coalesce("language", F.lit("")).alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("verdict").isin("foreign", "corrupt")).alias("failing"), F.count_if(F.col("verdict") == "foreign").alias("foreign_files"), F.count_if(F.col("verdict") == "corrupt").alias("corrupt_files"))
        .withColumn("rate", F.round(F.col("failing") / F.col("files"), 6))
    )
