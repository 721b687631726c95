"""Code rules, lookups and picks on small cases."""

from pyspark.sql import functions as F

from provark.operators import lookups
from provark.sources import code_rules


def test_each_rule_fires_and_has_a_twin_that_does_not(spark):
    bad = """import os, subprocess, pickle, yaml, requests
def f(x, cur, app):
    os.system(x)
    subprocess.run(x, shell=True)
    eval(x)
    cur.execute(f"select {x}")
    pickle.loads(x)
    yaml.load(x)
    requests.get(x, verify=False)
    app.run(debug=True, host="0.0.0.0")
    password = "hunter2hunter2"
    render_template_string(x)

def g(root, name, a, xs):
    i = 0
    for x in xs:
        a[i] = root / name
        i += 1
"""
    good = """import os, subprocess, yaml, requests
def f(x, cur, app):
    os.system("ls")
    subprocess.run(["ls", x])
    eval("1")
    cur.execute("select ?", (x,))
    yaml.load(x, Loader=yaml.SafeLoader)
    requests.get(x)
    app.run(host="127.0.0.1")
    password = "changeme-now"
    render_template_string("x")

def g(root, name, speed, a, xs):
    i = 0
    while i < 9:
        a[i] = (root / name).resolve()
        i += 1

def h(speed, time):
    return speed / time
"""
    c_bad = "\n".join(["int n = len;", "memcpy(a, b, n);", "// gets(a);", *[""] * 12, "int m = MIN(n, 8);", "memcpy(a, b, m);", "strcat(a, b);"])
    files = spark.createDataFrame([("bad.py", bad), ("good.py", good), ("broken.py", "def ("), ("none.py", None), ("bad.c", c_bad), ("none.h", None), ("good.c", "memcpy(a, b, sizeof a);"), ("tests/bad.py", bad), ("a/tests/bad.c", c_bad)], "path string, text string")
    rows = code_rules.scan(files).collect()
    assert {r.file for r in rows} == {"bad.py", "bad.c"}
    assert {r.rule for r in rows} == set(code_rules.RULES)
    assert sorted(r.line for r in rows if r.file == "bad.c") == [2, 18]
    assert {r.rule: r.line for r in rows if r.rule in ("index_write", "path_join")} == {"index_write": 17, "path_join": 17}
    assert code_rules.scan(files, skip_tests=False).count() == 2 * len(rows)


def test_entrypoint_rollup(spark):
    edges = spark.createDataFrame([("main", "f"), ("f", "g")], "src string, dst string")
    roles = spark.createDataFrame([("s1", "g", "sink"), ("c1", "f", "control"), ("s2", "h", "sink")], "ref string, owner string, category string")
    flows = spark.createDataFrame([("main",)], "entry string")
    entry = spark.createDataFrame([("main",), ("lonely",)], "uid string")
    got = {r.uid: (r.controls, r.sinks, r.flows) for r in lookups.entrypoint_rollup(entry, edges, roles, flows).collect()}
    assert got == {"main": (1, 1, 1), "lonely": (0, 0, 0)}


def test_sensitivity_and_withheld_columns(spark):
    rows = spark.createDataFrame([("@scope/Requests", 1)], "name string, pay int")
    assert rows.select(lookups.sensitivity(F.col("name"), {"requests": "network"})).head()[0] == "network"
    seen = lookups.visible_columns(rows, "viewer", {"pay": ("owner",)})
    assert seen.columns == rows.columns and seen.head().pay is None
    assert lookups.visible_columns(rows, "owner", {"pay": ("owner",)}).head().pay == 1
