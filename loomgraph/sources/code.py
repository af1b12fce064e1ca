"""Source files and what is read from their text: lines, calls, assignments, imports, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import language_of, module_stem, weakness

# Folders that are never read.
IGNORED = (".git", "target", "node_modules", "venv", "__pycache__", "dist", "build")

FILES = "file_id bigint, path string, language string, code string"


def named_language(value: Column) -> Column:
    """`python` or `java` of the usual spellings, else the lower-case value."""
    text = F.lower(F.trim(value))
    return F.when(text.startswith("py"), "python").when(text.startswith("java"), "java").otherwise(text)


def files(samples: DataFrame, owasp: DataFrame) -> DataFrame:
    """(file_id, path, language, vulnerable, cwe, code) of both code tables; a file without a path is named by its id."""
    path = F.coalesce("file_path", F.concat(F.lit("code/"), F.col("code_id").cast("string"), F.when(named_language(F.col("language")) == "java", ".java").otherwise(".py")))
    one = samples.select(F.col("code_id").alias("file_id"), path.alias("path"), named_language(F.col("language")).alias("language"), "vulnerable", weakness(F.col("cwe")).alias("cwe"), "code")
    two = owasp.withColumn("file_path", F.lit(None).cast("string"))
    return one.unionByName(two.select(F.col("code_id").alias("file_id"), path.alias("path"), named_language(F.col("language")).alias("language"), "vulnerable", weakness(F.col("cwe")).alias("cwe"), "code"))


def discover(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED, tests: bool = True) -> DataFrame:
    """(path, language, size_bytes, mtime, code) of the Python and Java files under a folder, in order of path.

    Files in ignored or hidden folders are left out, and those in `test` or `tests` unless wanted.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,java}").load(root)
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    folders = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    names = [*ignored, *([] if tests else ["test", "tests"])]
    kept = found.where(~F.arrays_overlap(folders, F.array(*map(F.lit, names))) & ~F.exists(folders, lambda x: x.startswith(".")))
    return kept.select("path", language_of(F.col("path")).alias("language"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("code")).orderBy("path")


def ignore_list(spark: SparkSession, path: str, defaults: tuple[str, ...] = IGNORED) -> list[str]:
    """Folder names of an ignore file, one a line, `#` for comments, after the defaults."""
    own = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).where("v != ''")
    return [*defaults, *(r["v"].rstrip("/") for r in own.collect())]


def lines(code_files: DataFrame) -> DataFrame:
    """(file_id, language, line_no, n_lines, line) of every physical line, numbered from 1, with the number of its file's lines."""
    cut = code_files.select("file_id", "language", F.split("code", "\n", -1).alias("parts"))
    return cut.select("file_id", "language", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("pos", "line")).select("file_id", "language", (F.col("pos") + 1).alias("line_no"), "n_lines", "line")


def calls(source_lines: DataFrame) -> DataFrame:
    """(file_id, language, line_no, callee) of every `name(` on a line, keywords aside."""
    found = source_lines.select("file_id", "language", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\("), F.lit(1))).alias("callee"))
    return found.where(~F.col("callee").isin("if", "for", "while", "switch", "catch", "return", "def", "class", "synchronized"))


_ASSIGNMENT = r"(?s)^\s*(?:[A-Za-z_][A-Za-z0-9_<>]* +)?([A-Za-z_][A-Za-z0-9_]*) = ([^=].*)\z"


def assigned_name(line: Column) -> Column:
    """The plain name that a line assigns, '' where it assigns none."""
    return F.regexp_extract(line, _ASSIGNMENT, 1)


def assigned_value(line: Column) -> Column:
    return F.regexp_extract(line, _ASSIGNMENT, 2)


def assignments(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, name, value) of the lines that assign one plain name."""
    line = F.col("line")
    return source_lines.select("file_id", "language", "line_no", assigned_name(line).alias("name"), assigned_value(line).alias("value")).where("name != ''")


def imports(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, module): modules of Python's import and from lines and of Java's imports; aliases and further names are ignored."""
    python = F.regexp_extract("line", r"^(?:import|from) +([A-Za-z_][A-Za-z0-9_.]*)", 1)
    java = F.regexp_extract("line", r"^import +([A-Za-z_][A-Za-z0-9_.]*(?:\.\*)?);", 1)
    module = F.when(F.col("language") == "java", java).otherwise(python)
    return source_lines.select("file_id", "line_no", module.alias("module")).where("module != ''")


def exports(code_files: DataFrame) -> DataFrame:
    """(module, file_id): what a file is imported by: a Java file's package and class, a Python file's stem."""
    package = F.regexp_extract("code", r"(?:^|\n)package ([A-Za-z0-9_.]+);", 1)
    own = F.regexp_extract("code", r"\b(?:class|interface|enum|record) ([A-Za-z0-9_]+)", 1)
    java = F.when((package != "") & (own != ""), F.concat(package, F.lit("."), own)).otherwise(own)
    module = F.when(F.col("language") == "java", java).otherwise(module_stem(F.col("path")))
    return code_files.select(module.alias("module"), "file_id").where("module != ''")


def resolved_imports(code_files: DataFrame) -> DataFrame:
    """(file_id, module, target): each import with the least file that its name, or else its last part, names; null where none does."""
    wanted = imports(lines(code_files)).select("file_id", "module").distinct()
    known = exports(code_files).groupBy("module").agg(F.min("file_id").alias("target"))
    last = wanted.withColumn("last", F.element_at(F.split("module", r"\."), -1))
    whole = last.join(known.select("module", F.col("target").alias("whole")), "module", "left")
    part = whole.join(known.select(F.col("module").alias("last"), F.col("target").alias("part")), "last", "left")
    return part.select("file_id", "module", F.coalesce("whole", "part").alias("target"))


def import_stubs(code_files: DataFrame) -> DataFrame:
    """(module, method, parameter, importers): a method that hands its one argument on, for each module that Python files import and no file is.

    With these rows beside a program's own, data passes through calls into code that isn't there.
    """
    python = code_files.where("language = 'python'").select("file_id")
    missing = resolved_imports(code_files).where("target is null").join(python, "file_id", "left_semi")
    return missing.groupBy("module").agg(F.countDistinct("file_id").alias("importers")).select("module", F.concat("module", F.lit(".value")).alias("method"), F.lit("value").alias("parameter"), "importers")


# Labels.


def truth_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """(test_key, vulnerable, cwe) of a label file with a header: key, category, verdict, weakness."""
    rows = spark.read.csv(path, schema="test_key string, category string, verdict string, cwe string", header=True)
    return rows.select(F.trim(F.regexp_replace("test_key", '"', "")).alias("test_key"), F.lower(F.trim("verdict")).isin("true", "vulnerable").alias("vulnerable"), weakness(F.col("cwe")).alias("cwe"))


def truth_from_comments(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, vulnerable, cwe) of lines marked VULNERABLE, else SAFE."""
    bad = F.col("line").contains("VULNERABLE")
    return source_lines.where(bad | F.col("line").contains("SAFE")).select("file_id", "line_no", bad.alias("vulnerable"), weakness(F.regexp_extract("line", r"(CWE-\d+)", 1)).alias("cwe"))


def pairs_to_samples(pairs: DataFrame) -> DataFrame:
    """(pair_id, vulnerable, code): a fix's code ahead of it counts as vulnerable, that behind it as safe; empty codes are left out."""
    both = F.array(F.struct(F.lit(True).alias("vulnerable"), F.col("before").alias("code")), F.struct(F.lit(False).alias("vulnerable"), F.col("after").alias("code")))
    return pairs.select(F.col("entry_id").alias("pair_id"), F.explode(both).alias("x")).select("pair_id", "x.vulnerable", "x.code").where("code is not null and code != ''")


def merged_config(*layers: dict) -> dict:
    """Settings of several layers: the first layer that sets a field wins."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if out.get(key) is None and value is not None:
                out[key] = value
    return out
