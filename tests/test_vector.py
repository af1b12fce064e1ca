from loomgraph.operators import features

PYTHON = """import os
from flask import request
def run(n):
    x = request.args.get('q')
    try:
        for i in range(3):
            os.system(x)
    except OSError:
        return None
"""


def test_vector(spark):
    rows = [(1, "python", PYTHON), (2, "python", None), (3, "java", ""), (4, "python", "def (")]
    got = {r["file_id"]: r.asDict() for r in features.vector(spark.createDataFrame(rows, "file_id bigint, language string, code string")).collect()}
    assert len(got) == 4 and all(list(r) == ["file_id", *(f"f{i}" for i in range(55))] for r in got.values())
    one = got[1]
    assert one["f2"] == 1 and one["f30"] == 2 and one["f21"] == 1 and one["f22"] == 1 and one["f32"] == 1 and one["f46"] == 1 and one["f10"] > 0
    assert one["f0"] == 1 and one["f15"] >= 1 and one["f6"] == 1 and one["f53"] > 0
    assert all(v == 0 for k, v in got[2].items() if k not in ("file_id", "f25", "f31"))
    assert all(got[i][f"f{k}"] is not None for i in got for k in range(55))
