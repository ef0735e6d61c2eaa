"""Copied functions and texts."""


from codequarry.operators import duplicates
from codequarry.sources import pynodes

# walks a list backwards with a counter and stops early; the second has other names for everything
BODY = (
    "def {0}({1}, {2}):\n    {3} = len({1})\n    while {3} > 0:\n        {3} -= 1\n"
    "        if {1}[{3}] % {2} == 0:\n            break\n        print({3}, {1}[{3}])\n    return {3}, {2}\n")
A = BODY.format("last_multiple", "numbers", "step", "at")
B = BODY.format("sum_b", "prices", "lot", "k")
OTHER = ("def greet(names, loud=False):\n    with open('log') as out:\n        for n in sorted(names):\n"
         "            out.write(n.upper() if loud else n)\n")


def functions(spark, files, scope="repo"):
    rows = [(repo, i, path, text) for i, (repo, path, text) in enumerate(files)]
    df = spark.createDataFrame(rows, "repo_id STRING, file_id BIGINT, path STRING, content STRING")
    return duplicates.functions(pynodes.py_nodes(df.repartition(3)), scope)


def places(df):
    return sorted((r.repo_id, r.file, r.line) for r in df.collect())


def test_two_files_and_renamed_variables(spark):
    found = duplicates.duplicate_functions_capped(
        functions(spark, [("r", "a.py", A), ("r", "b.py", "\n" + B), ("r", "c.py", OTHER)]))
    rows = {r.file: r for r in found.collect()}
    assert {(r.file, r.line) for r in rows.values()} == {("a.py", 1), ("b.py", 2)}
    assert rows["b.py"].message == (
        "Function 'sum_b' has the same body shape as 1 other location(s): b.py:2 (sum_b). "
        "Likely copy-pasted code; consider extracting a shared helper.")


def test_distinct_and_short_bodies(spark):
    getter = "class Box:\n    def {0}(self):\n        return self._{0}\n"  # equal shapes of few tokens
    files = [("r", "a.py", A), ("r", "b.py", OTHER),
             *[("r", f"{side}.py", getter.format(side)) for side in ("height", "depth", "width")]]
    assert duplicates.duplicate_functions(functions(spark, files)).count() == 0


def test_scope_and_ignored_folders(spark):
    files = [("r", "a.py", A), ("s", "b.py", B), ("r", "tests/c.py", B), ("r", "d.pyi", B)]
    assert places(duplicates.duplicate_functions(functions(spark, files))) == []
    assert places(duplicates.duplicate_functions(functions(spark, files, "corpus"))) == [
        ("r", "a.py", 1), ("s", "b.py", 1)]


def test_hot_group_is_whole_and_caps_are_exact(spark):
    files = [("r", f"f{i:04}.py", A if i % 2 else B) for i in range(300)] + [("r", "x.py", OTHER)]
    fns = functions(spark, files).persist()
    everything = duplicates.duplicate_functions(fns)
    assert everything.count() == 300
    hot = duplicates.duplicate_functions(fns, hot_rows=1)
    assert places(hot) == places(everything)
    capped = duplicates.duplicate_functions_capped(fns)
    assert [r[1] for r in places(capped)] == [f"f{i:04}.py" for i in range(4)]
    assert capped.first().message.count("f0") == 4  # members 2 to 5


def test_first_groups_by_appearance(spark):
    files = [("r", "b.py", A), ("r", "c.py", B), ("r", "a.py", OTHER), ("r", "z.py", OTHER)]
    found = duplicates.duplicate_functions_capped(functions(spark, files), max_groups=1)
    assert places(found) == [("r", "a.py", 1), ("r", "z.py", 1)]


def test_source_text(spark):
    text = "class C:\n    def f(self, xs):\n        return [x.a + x.b * x.c for x in xs if x]  # é\nz = 1\n"
    files = spark.createDataFrame([("r", 1, "a.py", text), ("r", 2, "b.py", text)],
                                  "repo_id STRING, file_id BIGINT, path STRING, content STRING")
    found = duplicates.duplicate_functions_capped(duplicates.functions(pynodes.py_nodes(files)))
    got = duplicates.with_source(found, files).first().evidence.snippet
    assert got == "def f(self, xs):\n        return [x.a + x.b * x.c for x in xs if x]"


def test_duplicate_texts_of_a_hot_copy(spark):
    rows = [(i, " Same\ttext " if i % 3 == 0 else f"text {i}") for i in range(300)] + [(999, "same TEXT")]
    df = spark.createDataFrame(rows, "id INT, text STRING")
    for hot_rows in (1, None):
        got = duplicates.duplicate_texts(df, "id", "text", hot_rows).collect()
        assert len(got) == 101
        assert {(r.copies, r.first) for r in got} == {(101, 0)}


def test_shuffle_carries_digests_only(spark):
    df = spark.createDataFrame([(1, "a")], "id INT, text STRING")
    plan = duplicates.duplicate_texts(df, "id", "text")._jdf.queryExecution().executedPlan()
    exchanges = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("text" in line for line in exchanges)
