import pytest

from loomgraph.sources import frontends, settings

YAML = """
# sinks
python:
  - cwe: CWE-89
    name: "SQL: raw"
    sinks:
      - pattern: execute   # a call
        arg_index: 0
      - {pattern: 'it''s', arg_index: 1}
  - name: eval
    pattern: eval
java:
- cwe: CWE-78
  patterns: [exec, "start"]
empty:
"""


def test_yaml():
    got = settings.from_yaml(YAML)
    assert got["python"][0] == {"cwe": "CWE-89", "name": "SQL: raw", "sinks": [{"pattern": "execute", "arg_index": 0}, {"pattern": "it's", "arg_index": 1}]}
    assert got["java"] == [{"cwe": "CWE-78", "patterns": ["exec", "start"]}] and got["empty"] is None
    assert settings.from_yaml("") is None and settings.from_yaml("a: 1.5\nb: true\nc: [x, {y: 2}]\n") == {"a": 1.5, "b": True, "c": ["x", {"y": 2}]}
    for bad in ("a: &x 1", "a: |\n  text", "a:\n    b: 1\n  c: 2", "a: [1"):
        with pytest.raises(ValueError):
            settings.from_yaml(bad)


def test_catalog_and_files(spark, tmp_path):
    rows = [tuple(r) for r in settings.catalog(spark, YAML, "Sink").collect()]
    assert rows[0] == ("Sink", "python", "SQL: raw", "CWE-89", "execute", 0) and ("Sink", "python", "eval", None, "eval", None) in rows and rows[-1] == ("Sink", "java", None, "CWE-78", "start", None) and len(rows) == 5
    for name, text in (("a.json", '{"x": 1}'), ("a.toml", "x = 1"), ("a.yml", "x: 1")):
        (tmp_path / name).write_text(text)
        assert settings.read(str(tmp_path / name)) == {"x": 1}
    (tmp_path / "a.ini").write_text("x")
    with pytest.raises(ValueError):
        settings.read(str(tmp_path / "a.ini"))


def test_code_with_too_much_indentation():
    code = "        import os\n        X = 1\nclass A:\n            stray(1)\n            )\n    def f(self):\n        return os.name\n"
    assert frontends.unindented(code) == "import os\nX = 1\nclass A:\n    pass\n# stripped: )\n    def f(self):\n        return os.name\n"
    assert frontends.unindented("    x = 1\n") == "    x = 1\n"
    rows, _ = frontends.lower(code, "python")
    assert rows and rows[0][2] != "Error"
