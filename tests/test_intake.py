"""Corpus scan, archives, intake checks and profile on small hand-made inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import guards, profile
from codequarry.sources import archives, corpus

FILE = "repo_id STRING, file_id BIGINT, path STRING, size BIGINT, content STRING"


@pytest.mark.parametrize("text,lines", [
    ("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\r", 2), ("\n", 1), ("\n\n", 2), ("a\r", 1),
    ("a\r\r\nb", 3), ("\x0c ", 1)])
def test_line_count(spark, text, lines):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(t.line_count(F.col("t"))).first()[0] == lines


def test_suffix_and_stem(spark):
    names = {"a.PY": ".py", ".bashrc": "", "x.": "", "a.b.tsx": ".tsx", "noext": "", ".a.js": ".js"}
    df = spark.createDataFrame(list(names.items()), "n STRING, want STRING")
    rows = df.select("n", "want", t.suffix(F.col("n")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_repo_urls(spark):
    bad, short, name = (t.fv.URL_NOT_SUPPORTED, t.fv.URL_TOO_SHORT, t.fv.URL_BAD_NAME)
    cases = {
        "https://github.com/a/b": ("a", "b", None), "HTTP://GitHub.com/a/b.git": ("a", "b", None),
        "https://github.com/a/b/tree/main?x=1#y": ("a", "b", None),
        "https://github.com:443/a/b": (None, None, bad), "ftp://github.com/a/b": (None, None, bad),
        "https://www.github.com/a/b": (None, None, bad), "github.com/a/b": (None, None, bad),
        "https://u@github.com/a/b": (None, None, bad), "https://github.com/a": (None, None, short),
        "https://github.com//a//": (None, None, short), "https://github.com/a b/c": (None, None, name),
        "https://github.com/a/.git": (None, None, name), "https://github.com//a//b": ("a", "b", None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u STRING")
    for r in df.select("u", t.repo_url(F.col("u")).alias("p")).collect():
        assert tuple(r.p) == cases[r.u], r.u


def test_names(spark):
    rows = [("a", "b", None, "a-b"), (None, None, "my pro:ject.v2.zip", "my-pro-ject.v2"),
            (None, None, "x" * 90 + ".zip", "x" * 80), (None, None, None, "repository"),
            (None, None, "", "repository")]
    df = spark.createDataFrame(rows, "o STRING, r STRING, f STRING, want STRING")
    got = df.select("want", t.display_name(F.col("o"), F.col("r"), F.col("f")).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def make_zip(entries) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for info, body in entries:
            z.writestr(info, body)
    return data.getvalue()


def test_archives_from_files(spark, tmp_path):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    packs = {
        "good.zip": make_zip([("src/", b""), ("src/a.py", b"x = 1\n")]),
        "Slip.ZIP": make_zip([("ok.txt", b"x"), ("../evil", b"x")]),
        "link.zip": make_zip([(link, b"/etc/passwd")]),
        "bomb.zip": make_zip([("zeros", b"\0" * 1_000_000)]),
        "broken.zip": make_zip([("a", b"x")])[:20],
    }
    for name, data in packs.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    found = archives.entries(archives.read_archives(spark, str(tmp_path)), with_content=True)
    found = found.withColumn("archive", t.base_name(F.col("archive"))).persist()
    rows = {(r.archive, r.entry): r for r in found.collect()}
    assert bytes(rows["good.zip", "src/a.py"].content) == b"x = 1\n"
    assert rows["good.zip", "src/"].is_dir and not rows["good.zip", "src/a.py"].is_dir
    assert rows["broken.zip", None].error == "Uploaded file is not a valid ZIP archive"
    verdicts = {r.archive: r.reason for r in guards.verdicts(found).collect()}
    assert verdicts == {"good.zip": None, "broken.zip": "Uploaded file is not a valid ZIP archive", "Slip.ZIP": "unsafe path", "link.zip": "symlink",
                        "bomb.zip": "suspicious ratio"}
    kept = guards.accepted_entries(found).collect()
    assert {r.archive for r in kept} == {"good.zip"}
    files = corpus.from_archives(guards.accepted_entries(found)).collect()
    assert [(r.repo_id, r.path, r.content) for r in files] == [("good", "src/a.py", "x = 1\n")]


ENTRY = ("archive STRING, entry_no BIGINT, entry STRING, is_dir BOOLEAN, file_size BIGINT, "
         "compress_size BIGINT, external_attr BIGINT")


def test_verdict_order(spark):
    mb = 1024 * 1024
    rows = [
        ("count", 0, "../x", False, 1, 1, 0), ("count", 1, "a", False, 1, 1, 0), ("count", 2, "b", True, 0, 0, 0),
        ("bytes", 0, "../x", False, 3 * mb, mb, 0), ("dirs", 0, "../d/", True, 9 * mb, 1, 0),
        ("first", 0, "ok", False, 1, 0, 0), ("first", 1, "/abs", False, 200, 1, 0),
        ("zero", 0, "a", False, 500, 0, 0), ("dots", 0, "a/..b/c", False, 1, 1, 0),
    ]
    df = spark.createDataFrame(rows, ENTRY)
    got = {r.archive: (r.reason, r.entry)
           for r in guards.verdicts(df, max_count=2, max_expanded_mb=2).collect()}
    assert got == {"count": ("too many entries", None), "bytes": ("expands too far", None),
                   "dirs": (None, None), "first": ("unsafe path", "/abs"), "zero": (None, None),
                   "dots": (None, None)}


def test_tree(spark, tmp_path):
    for path, body in {"r1/src/a.py": b"import flask\nx = '\xff'\n", "r1/node_modules/b.js": b"",
                       "r2/package.json": b'{"dependencies": {"Next-x": "1"}}', "r2/yarn.lock": b"",
                       "r2/docs/.keep": b"", "r2/docs/_a/__init__.pyx": b""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    files = corpus.read_tree(spark, str(tmp_path), max_file_mb=10).persist()
    assert {(r.repo_id, r.path) for r in profile.scan(files).collect()} == {
        ("r1", "src/a.py"), ("r2", "package.json"), ("r2", "docs/.keep"),
        ("r2", "docs/_a/__init__.pyx")}
    text = files.where("path = 'src/a.py'").first().content
    assert text == "import flask\nx = ''\n"
    found = {(r.repo_id, r.framework) for r in profile.frameworks(files).collect()}
    assert found == {("r1", "Flask"), ("r2", "Next.js")}
    repos = files.select("repo_id").distinct()
    rows = {r.repo_id: r for r in profile.repo_profile(repos, files).collect()}
    assert rows["r1"].supported_languages == ["python"] and rows["r1"].loc == 2
    assert rows["r2"].manifest_kinds == ["npm"] and rows["r2"].top_level_dirs == ["docs"]


def test_tree_walk(spark, tmp_path, monkeypatch):
    """Every level, hidden names, empty folders, large files in batches of their own, and files above the limit."""
    bodies = {"beside.txt": b"x", "r1/a.py": b"1", "r1/x/y/z/_deep.py": b"deep", "r1/x/.hidden/b.py": b"", "r2/big.js": b"b" * (2 << 20),
              "r2/more.js": b"m" * 700}
    for path, body in bodies.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body)
    (tmp_path / "r3" / "empty").mkdir(parents=True)
    (tmp_path / "r1" / "link").symlink_to(tmp_path)
    monkeypatch.setattr(corpus, "BATCH_BYTES", 512)
    listed = {r.path: r.size for r in corpus.list_tree(spark, str(tmp_path)).collect()}
    assert listed == {p: len(b) for p, b in bodies.items()}
    got = {f"{r.repo_id}/{r.path}": r for r in corpus.read_tree(spark, f"file:{tmp_path}", max_file_mb=1).collect()}
    assert set(got) == set(bodies) - {"beside.txt"}
    assert {p for p, r in got.items() if r.content is None} == {"r2/big.js"} and got["r2/big.js"].size == 2 << 20
    assert all(r.content == bodies[p].decode() for p, r in got.items() if r.content is not None)
    assert corpus.read_tree(spark, str(tmp_path / "nowhere")).count() == 0


def test_ignored_part_may_be_the_file_itself(spark):
    df = spark.createDataFrame([("r", 1, "a/out", 1, ""), ("r", 2, "outer/x", 1, ""),
                                ("r", 3, "x/uv.lock", 1, ""), ("r", 4, "build/x", 1, "")], FILE)
    assert [r.path for r in profile.scan(df).collect()] == ["outer/x"]


def test_profile_reads_the_files_once(spark, tmp_path):
    files = spark.createDataFrame(
        [("r", 1, "a.py", 1, "import flask\n"), ("r", 2, "package.json", 1, '{"dependencies": {"react-dom": "1"}}'),
         ("r", 3, "node_modules/x.js", 1, "x"), ("r", 4, "src/.git/y.py", 1, "import django"), ("r", 5, "w/b.ts", 1, None),
         ("only", 6, "dist/z.js", 1, "z"), ("r", 7, None, 1, "import vue"), ("r", 8, "package.json", 1, "broken")],
        "repo_id STRING, file_id BIGINT, path STRING, size BIGINT, content STRING")
    files.write.parquet(str(tmp_path / "files"))
    repos = spark.createDataFrame([("r",), ("only",), ("none",)], "repo_id STRING")
    out = profile.repo_profile(repos, spark.read.parquet(str(tmp_path / "files")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    got = {r.repo_id: r for r in out.collect()}
    assert [(x.language, x.files, x.loc) for x in got["r"].languages if x.language.endswith(("python", "script"))] == [
        ("python", 1, 1), ("typescript", 1, None)]
    assert got["r"].frameworks == ["Flask", "React"] and got["r"].top_level_dirs == ["src", "w"]
    assert (got["r"].manifests, got["r"].manifest_kinds) == (2, ["npm"])
    for empty in ("only", "none"):
        assert (got[empty].files, got[empty].languages, got[empty].frameworks, got[empty].top_level_dirs) == (0, None, [], [])


def test_tree_keeps_bytes_and_null_contents(spark, tmp_path):
    """Contents go into files as UTF-8 and come back in batches of bounded bytes."""
    texts = [None, "", "a\r\nb", "é中\U0001f600", "x" * 3_000_000, "y" * 9_000_000, "z" * 3_000_000]
    files = spark.createDataFrame([("r", f"_d/.{i}.txt", t) for i, t in enumerate(texts)], "repo_id STRING, path STRING, content STRING")
    corpus.write_tree(files.coalesce(1), str(tmp_path))
    got = {r.path: (r.size, r.content) for r in corpus.read_tree(spark, str(tmp_path)).collect()}
    assert got == {f"_d/.{i}.txt": (len((t or "").encode()), t or "") for i, t in enumerate(texts)}
    plan = corpus.read_tree(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
