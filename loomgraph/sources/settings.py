"""Settings and rule catalogs from JSON, TOML and YAML text.

The YAML read here is the part that catalogs use: block and one-line lists and
mappings, quoted and plain scalars, comments.  Anchors, tags and block scalars
raise an error rather than being misread.
"""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PLAIN = {"": None, "~": None, "null": None, "true": True, "false": False}
_KEY = re.compile(r"(\"(?:\\.|[^\"\\])*\"|'(?:''|[^'])*'|[^\s\"'\[{#&*!|>-][^:#]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$")


def _uncommented(line: str) -> str:
    """The line without a comment; `#` inside quotes or words is none."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] in "[{" and text:
        return _inline(text)
    if text[:1] in "&*!|>" and text:
        raise ValueError(f"not read here: {text}")
    if text.lower() in _PLAIN:
        return _PLAIN[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _inline(text: str) -> object:
    """A list or mapping on one line."""
    if text[-1:] != {"[": "]", "{": "}"}[text[0]]:
        raise ValueError(f"not closed: {text}")
    items, depth, quote, start = [], 0, "", 1
    for i in range(1, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif (c == "," and not depth) or i == len(text) - 1:
            items.append(text[start:i].strip())
            start = i + 1
        elif c in "]}":
            depth -= 1
    items = [x for x in items if x]
    if text[0] == "[":
        return [_scalar(x) for x in items]
    return {str(_scalar(k)): _scalar(v) for k, _, v in (x.partition(":") for x in items)}


def from_yaml(text: str) -> object:
    """The value of a YAML document; an empty one is None."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in map(_uncommented, text.split("\n")) if x.strip() and x.strip() != "---"]

    def block(at: int, indent: int) -> tuple[object, int]:
        out: list | dict = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if isinstance(out, list):
                if not (line.startswith("- ") or line == "-"):
                    break
                rest = line[1:].strip()
                if rest and _KEY.match(rest) and rest[0] not in "[{":
                    # A mapping that begins on the list's own line.
                    lines[at] = (indent + len(line) - len(rest), rest)
                    value, at = block(at, lines[at][0])
                elif rest:
                    value, at = _scalar(rest), at + 1
                elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                    value, at = block(at + 1, lines[at + 1][0])
                else:
                    value, at = None, at + 1
                out.append(value)
                continue
            m = _KEY.match(line)
            if m is None:
                raise ValueError(f"neither key nor item: {line}")
            key, rest = str(_scalar(m[1])), m[2]
            at += 1
            if rest:
                out[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        return out, at

    if not lines:
        return None
    if len(lines) == 1 and not _KEY.match(lines[0][1]) and not lines[0][1].startswith("-"):
        return _scalar(lines[0][1])
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"wrong indentation: {lines[end][1]}")
    return value


def read(path: str) -> dict:
    """The settings of a file by its extension: json, toml, yaml or yml."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    value = json.loads(text) if kind == ".json" else tomllib.loads(text) if kind == ".toml" else from_yaml(text) if kind in (".yaml", ".yml") else None
    if value is None and kind not in (".yaml", ".yml"):
        raise ValueError(f"settings of an unknown kind: {path}")
    return value or {}


def catalog(spark: SparkSession, text: str, kind: str) -> DataFrame:
    """(kind, language, name, cwe, pattern, arg_index) of a YAML catalog: languages, each with a list of rules with a pattern or a list of them.

    What a rule doesn't state is null.
    """
    rows = []
    for language, rules in (from_yaml(text) or {}).items():
        for rule in rules or []:
            nested = next((v for v in rule.values() if isinstance(v, list)), [rule])
            for one in nested:
                one = one if isinstance(one, dict) else {"pattern": one}
                index = one.get("arg_index", rule.get("arg_index"))
                rows.append((kind, language, rule.get("name"), rule.get("cwe"), one.get("pattern"), index))
    return spark.createDataFrame(rows, "kind string, language string, name string, cwe string, pattern string, arg_index int")
