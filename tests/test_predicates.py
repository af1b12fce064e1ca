from pyspark.sql import functions as F

from loomgraph.operators import findings, metrics, predicates
from loomgraph.sources import code


def true_of(spark, values, test):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [values[r["i"]] for r in rows.where(test(F.col("v"))).orderBy("i").collect()]


def test_calls_and_paths(spark):
    assert true_of(spark, ["requests.get", "client.get", "RestTemplate.exchange", None, ""], predicates.http_client) == ["requests.get", "RestTemplate.exchange"]
    assert true_of(spark, ["System.out.println", "response.getWriter", "print", "fileWriter.write", "writer.write", "log.print", "x.print", None], predicates.web_writer) == ["response.getWriter", "print", "writer.write"]
    assert true_of(spark, ["a/tests/b.py", "a/test_x.py", "test_cwe_89.py", "benchmark/test/a.py", "src/Foo_test.java", "src/foo.py", None], predicates.test_file) == ["a/tests/b.py", "a/test_x.py", "src/Foo_test.java"]


def test_unsafe_deserializers(spark):
    names = ["pickle.loads", "yaml.safe_load", "yaml.load", "json.loads", "pickle.dump", "ois.readObject", "struct.unpack", "x509.load", "model.load", "toml.load", None]
    assert true_of(spark, names, predicates.unsafe_deserializer) == ["pickle.loads", "yaml.load", "ois.readObject", "model.load"]
    rows = spark.createDataFrame([("yaml.load", None, "s, Loader=yaml.SafeLoader"), ("r.readObject", "a.SafeObjectInputStream", ""), ("m.decode", "jsonpickle", ""), ("m.load", "tomllib.Toml", "")], "c string, t string, a string")
    assert [r["c"] for r in rows.where(predicates.unsafe_deserializer(F.col("c"), F.col("t"), F.col("a"))).collect()] == ["m.decode"]


def test_guards(spark):
    rows = spark.createDataFrame([("is_safe_path(p)",), ("allowed(HOST)",), ("x > 3",), (None,)], "c string")
    assert [r[0] for r in rows.select(predicates.guarded_weaknesses(F.col("c"))).collect()] == [["CWE-22"], ["CWE-918"], ["CWE-22", "CWE-89"], ["CWE-22", "CWE-89"]]


def test_paths_that_may_alias(spark):
    left = spark.createDataFrame([(1, "a", ["f"]), (1, "c", [])], "file_id int, root string, path array<string>")
    right = spark.createDataFrame([(1, "b", ["f"]), (1, "a", ["f"]), (1, "b", ["g"]), (2, "a", ["f"])], "file_id int, root string, path array<string>")
    aliases = spark.createDataFrame([(1, "b", "a")], "file_id int, a string, b string")
    assert sorted(tuple(r)[:3] for r in predicates.paths_may_alias(left, right, aliases).collect()) == [(1, "a", "a"), (1, "a", "b")]


def test_good_and_bad_cases(spark):
    found = spark.createDataFrame([("CWE1_x", "bad"), ("CWE1_x", "good1"), ("CWE2_y", "__module__")], "stem string, method string")
    stems = spark.createDataFrame([("CWE1_x",), ("CWE2_y",), ("CWE3_z",)], "stem string")
    r = predicates.good_and_bad(found, stems).collect()[0]
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2)


def test_cases_stubs_and_phases(spark):
    files = spark.createDataFrame([(1, "a.py", "python", "import gone.lib\nimport b", True), (2, "b.py", "python", "import gone.lib", False), (3, "c.py", "python", None, None), (4, "D.java", "java", "import x.Y;", False)], "file_id long, path string, language string, code string, vulnerable boolean")
    found = spark.createDataFrame([(2, 1), (2, 3), (3, 1)], "file_id long, line_no int")
    assert {(r["file_id"], r["outcome"]) for r in findings.regression_cases(files, found).collect()} == {(1, "missed"), (2, "false alarm")}
    assert [tuple(r) for r in code.import_stubs(files).collect()] == [("gone.lib", "gone.lib.value", "value", 2)]
    phases = metrics.Phases()
    for name in ("read", "solve", "read"):
        with phases.phase(name):
            pass
    rows = phases.summary(spark).collect()
    assert [r["phase"] for r in rows] == ["read", "solve"] and abs(sum(r["share"] for r in rows) - 1) < 1e-9
