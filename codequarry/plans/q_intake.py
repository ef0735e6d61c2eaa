"""Registered queries on corpus scans, intake checks and repository profiles."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from codequarry.functions import text as t
from codequarry.operators import guards, profile
from codequarry.plans import views as v
from codequarry.plans.registry import register
from codequarry.plans.view_sql import LANGUAGE_CASE, V_ENTRIES, V_FILES, with_views
from codequarry.session import scratch_path
from codequarry.sources import archives, corpus

SCAN = with_views(V_FILES)
ENTRIES = with_views(V_ENTRIES)
MIB = "1024 * 1024"


@register("corpus_scan", SCAN + "SELECT repo_id, file_id, path, size FROM v_scan")
def corpus_scan(spark, d):
    return profile.scan(v.files(spark, d)).select("repo_id", "file_id", "path", "size")


@register("tree_scan", """
SELECT coalesce(source, 'none') AS repo_id, 's' || (doc_id % 3) || '/_d' || (doc_id % 5) || '/.' || doc_id || '.txt' AS path,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, sha256(coalesce(text, '')) AS content_sha256
FROM documents""")
def tree_scan(spark, d):
    """All documents written as a tree of files with hidden names, then walked and read back."""
    docs = v.wide_table(spark, d, "documents", "doc_id", "source", "text")
    root, no = scratch_path(spark, "tree"), F.col("doc_id")
    place = F.concat(F.lit("s"), no % 3, F.lit("/_d"), no % 5, F.lit("/."), no, F.lit(".txt"))
    corpus.write_tree(docs.select(F.coalesce("source", F.lit("none")).alias("repo_id"), place.alias("path"), F.col("text").alias("content")), root)
    return corpus.read_tree(spark, root).select("repo_id", "path", "size", F.sha2("content", 256).alias("content_sha256"))


@register("file_loc", SCAN + "SELECT file_id, path, CAST(loc AS INTEGER) AS loc FROM v_scan")
def file_loc(spark, d):
    return profile.with_loc(profile.scan(v.files(spark, d))).select("file_id", "path", "loc")


LANGUAGES = f"""SELECT repo_id, {LANGUAGE_CASE} AS language, count(*) AS files,
  CAST(sum(loc) AS BIGINT) AS loc FROM v_scan GROUP BY ALL"""


@register("lang_profile", SCAN + f"""
SELECT repo_id, language, CASE language WHEN 'typescript' THEN 'TypeScript' WHEN 'javascript' THEN 'JavaScript'
         WHEN 'json' THEN 'JSON' ELSE upper(language[1]) || language[2:] END AS label,
       language IN ('python', 'javascript', 'typescript') AS supported, files, loc FROM ({LANGUAGES})""")
def lang_profile(spark, d):
    return profile.language_profile(v.files(spark, d))


@register("manifests", SCAN + "SELECT repo_id, file_id, path, 'npm' AS kind FROM v_scan WHERE name = 'package.json'")
def manifests(spark, d):
    return profile.manifests(v.files(spark, d))


NPM = """SELECT DISTINCT repo_id, CASE WHEN contains(content, '"Preact-dom"') THEN 'React'
    WHEN contains(content, '"express"') THEN 'Express' ELSE 'Vue' END AS framework
  FROM v_scan WHERE path = 'package.json' AND content NOT LIKE '%": , %'"""
PY = """SELECT DISTINCT repo_id, label AS framework FROM v_scan
  JOIN (VALUES ('fastapi', 'FastAPI'), ('flask', 'Flask'), ('django', 'Django'), ('tornado', 'Tornado'),
    ('express', 'Express'), ('react', 'React'), ('next', 'Next.js'), ('vue', 'Vue'), ('svelte', 'Svelte')) m(marker, label)
  ON contains(content, 'import ' || marker) OR contains(content, 'from ' || marker)
  WHERE ext = '.py'"""


@register("frameworks_npm", SCAN + NPM)
def frameworks_npm(spark, d):
    return profile.npm_frameworks(v.files(spark, d))


@register("frameworks_py", SCAN + PY)
def frameworks_py(spark, d):
    return profile.python_frameworks(v.files(spark, d))


@register("frameworks", SCAN + f"({NPM}) UNION ({PY})")
def frameworks(spark, d):
    return profile.frameworks(v.files(spark, d))


DIRS = """SELECT DISTINCT repo_id, split_part(path, '/', 1) AS directory FROM v_files
  WHERE contains(path, '/') AND split_part(path, '/', 1) NOT IN ('node_modules', '.git', '.hidden')"""


@register("top_level_dirs", SCAN + DIRS)
def top_level_dirs(spark, d):
    return profile.top_level_dirs(v.files(spark, d))


@register("repo_profile", SCAN + f""", l AS ({LANGUAGES}), ll AS (
  SELECT repo_id, string_agg(language || ':' || files || ':' || loc, ',' ORDER BY language) AS languages,
    CAST(sum(files) AS BIGINT) AS files, CAST(sum(loc) AS BIGINT) AS loc,
    string_agg(language, ',' ORDER BY language) FILTER (WHERE language IN ('python', 'javascript', 'typescript'))
      AS supported_languages FROM l GROUP BY repo_id),
m AS (SELECT repo_id, count(*) AS manifests FROM v_scan WHERE name = 'package.json' GROUP BY repo_id),
f AS (SELECT repo_id, string_agg(framework, ',' ORDER BY framework) AS frameworks
      FROM (({NPM}) UNION ({PY})) GROUP BY repo_id),
t AS (SELECT repo_id, string_agg(directory, ',' ORDER BY directory) AS top_level_dirs FROM ({DIRS}) GROUP BY repo_id)
SELECT r.repo_id, coalesce(languages, '') AS languages, coalesce(files, 0) AS files, coalesce(loc, 0) AS loc,
  coalesce(supported_languages, '') AS supported_languages, coalesce(manifests, 0) AS manifests,
  CASE WHEN manifests > 0 THEN 'npm' ELSE '' END AS manifest_kinds,
  coalesce(frameworks, '') AS frameworks, coalesce(top_level_dirs, '') AS top_level_dirs
FROM (SELECT DISTINCT repo_id FROM v_files UNION ALL SELECT 'empty') r LEFT JOIN ll USING (repo_id)
LEFT JOIN m USING (repo_id) LEFT JOIN f USING (repo_id) LEFT JOIN t USING (repo_id)""")
def repo_profile(spark, d):
    files = v.files(spark, d)
    known = files.select("repo_id").distinct().unionByName(
        spark.range(1).select(F.lit("empty").alias("repo_id")))
    lists = ("supported_languages", "manifest_kinds", "frameworks", "top_level_dirs")
    spelled = F.array_join(F.transform("languages", lambda x: F.concat_ws(
        ":", x["language"], x["files"].cast("string"), x["loc"].cast("string"))), ",")
    return profile.repo_profile(known, files).withColumns({
        **{c: F.array_join(c, ",") for c in lists}, "languages": F.coalesce(spelled, F.lit(""))})


@register("guard_entries", ENTRIES + "SELECT archive, entry_no, entry, reason FROM v_checked")
def guard_entries(spark, d):
    return guards.check_entries(v.archive_entries(spark, d)).select(
        "archive", "entry_no", "entry", "reason")


@register("guard_archive_totals", ENTRIES + f"""
SELECT archive, entries, expanded, CASE WHEN entries > 20000 THEN 'too many entries'
       WHEN expanded > 200 * {MIB} THEN 'expands too far' END AS reason
FROM (SELECT archive, count(*) AS entries,
        CAST(coalesce(sum(file_size) FILTER (WHERE NOT is_dir), 0) AS BIGINT) AS expanded
      FROM v_entries GROUP BY archive)""")
def guard_archive_totals(spark, d):
    return guards.archive_totals(v.archive_entries(spark, d))


@register("guard_repo_totals", SCAN + f"""
SELECT repo_id, files, bytes, CASE WHEN files > 20000 THEN 'too many files'
       WHEN bytes > 300 * {MIB} THEN 'repository too large' END AS reason
FROM (SELECT repo_id, count(*) AS files, CAST(sum(size * 2500) AS BIGINT) AS bytes FROM v_files GROUP BY repo_id)""")
def guard_repo_totals(spark, d):
    return guards.repo_totals(v.files(spark, d).withColumn("size", F.col("size") * 2500))


@register("guard_upload", f"""
WITH u AS (SELECT page_id, 'up' || page_id || CASE page_id % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' ELSE '.tar' END AS path,
                  len(html) * 12000 AS length FROM pages)
SELECT page_id, path, length, CASE WHEN page_id % 3 = 2 THEN 'Only .zip files are accepted'
       WHEN length > 50 * {MIB} THEN 'Upload exceeds 50 MB limit' END AS reason FROM u""")
def guard_upload(spark, d):
    uploads = v.table(spark, d, "pages").select(
        "page_id",
        F.concat(F.lit("up"), F.col("page_id").cast("string"),
                 v.pick(F.col("page_id") % 3, (".zip", ".ZIP", ".tar"))).alias("path"),
        (F.length("html") * 12000).cast("bigint").alias("length"))
    return guards.check_uploads(uploads)


@register("guard_verdict", ENTRIES + f""", sums AS (
  SELECT archive, coalesce(sum(file_size) FILTER (WHERE NOT is_dir), 0) AS bytes,
         min(entry_no) FILTER (WHERE reason IS NOT NULL) AS first_bad
  FROM v_checked GROUP BY archive)
SELECT s.archive, CASE WHEN bytes > 200 * {MIB} THEN 'expands too far' ELSE c.reason END AS reason,
       CASE WHEN bytes <= 200 * {MIB} THEN c.entry END AS entry
FROM sums s LEFT JOIN v_checked c ON c.entry_no = s.first_bad""")
def guard_verdict(spark, d):
    return guards.verdicts(v.archive_entries(spark, d))


@register("guard_accepted", ENTRIES + f"""
SELECT archive, entry_no, entry FROM v_entries WHERE archive NOT IN (
  SELECT archive FROM v_checked GROUP BY archive
  HAVING coalesce(sum(file_size) FILTER (WHERE NOT is_dir), 0) > 200 * {MIB} OR count(reason) > 0)""")
def guard_accepted(spark, d):
    return guards.accepted_entries(v.archive_entries(spark, d)).select("archive", "entry_no",
                                                                       "entry")


def zipped_documents(spark, d):
    """One small archive per document: a directory, the text, and its length; every 31st is cut."""

    def pack(batches):
        for batch in batches:
            out = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("docs/", b"")
                    z.writestr(f"docs/d{i}.txt", text.encode())
                    z.writestr("n_chars", str(len(text)))
                whole = data.getvalue()
                out.append((f"d{i}.zip", whole[: len(whole) // 2] if i % 31 == 0 else whole))
            yield pd.DataFrame(out, columns=["archive", "content"])

    docs = v.wide_table(spark, d, "documents", "doc_id", "text")
    return docs.mapInPandas(pack, "archive STRING, content BINARY")


@register("archive_entries", """
SELECT 'd' || doc_id || '.zip' AS archive, e.no AS entry_no,
       CASE e.no WHEN 0 THEN 'docs/' WHEN 1 THEN 'docs/d' || doc_id || '.txt' ELSE 'n_chars' END AS entry,
       e.no = 0 AS is_dir, CAST(CASE e.no WHEN 0 THEN 0 WHEN 1 THEN octet_length(encode(text))
         ELSE len(CAST(n_chars AS VARCHAR)) END AS BIGINT) AS file_size, NULL::VARCHAR AS error
FROM documents, (SELECT unnest([0, 1, 2])::BIGINT AS no) e WHERE doc_id % 31 <> 0
UNION ALL SELECT 'd' || doc_id || '.zip', -1, NULL, false, NULL, 'Uploaded file is not a valid ZIP archive'
FROM documents WHERE doc_id % 31 = 0""")
def archive_entries(spark, d):
    return archives.entries(zipped_documents(spark, d)).select(
        "archive", "entry_no", "entry", "is_dir", "file_size", "error")


V_URLS = r"""v_urls AS (
  SELECT page_id, CASE WHEN page_id % 7 = 1 THEN replace(url, 'http', 'ftp')
                       WHEN page_id % 7 = 2 THEN regexp_replace(url, '^(https?://[^/]+/[^/]+).*$', '\1//')
                       WHEN page_id % 7 = 3 THEN regexp_replace(url, '^(https?://[^/]+/[^/?#]+/[^/?#]+).*$', '\1.git')
                       WHEN page_id % 7 = 4 THEN regexp_replace(url, '^(https?://[^/]+)/', '\1/a b/')
                       WHEN page_id % 7 = 5 THEN upper(regexp_replace(url, '^(https?://[^/]+)/', '\1:443/'))
                       ELSE url END AS url,
         CASE WHEN page_id % 7 = 5 OR page_id % 5 = 0 THEN 'github.com'
              ELSE split_part(url, '/', 3) END AS host
  FROM pages),
v_owned AS (
  SELECT *, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS o,
         regexp_extract(url, '^https?://[^/]+/[^/?#]+/+([^/?#]*)', 1) AS r0 FROM v_urls),
v_named AS (
  SELECT *, CASE WHEN suffix(r0, '.git') THEN r0[:-5] ELSE r0 END AS r,
         CASE WHEN page_id % 7 IN (1, 5) OR page_id % 5 = 0
                THEN 'Only GitHub repository URLs are supported (github.com/owner/repo)'
              WHEN r0 = '' THEN 'GitHub URL must look like https://github.com/owner/repo'
              WHEN contains(o, ' ') THEN 'Invalid GitHub owner/repo in URL' END AS reason
  FROM v_owned)"""


def urls(spark, d):
    url, rest = F.col("url"), F.col("page_id") % 7
    changed = (
        F.when(rest == 1, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(rest == 2, F.regexp_replace(url, "^(https?://[^/]+/[^/]+).*$", "$1//"))
        .when(rest == 3, F.regexp_replace(url, "^(https?://[^/]+/[^/?#]+/[^/?#]+).*$", "$1.git"))
        .when(rest == 4, F.regexp_replace(url, "^(https?://[^/]+)/", "$1/a b/"))
        .when(rest == 5, F.upper(F.regexp_replace(url, "^(https?://[^/]+)/", "$1:443/")))
        .otherwise(url)
    )
    host = F.when((rest == 5) | (F.col("page_id") % 5 == 0), "github.com").otherwise(
        F.split(url, "/")[2])
    return v.table(spark, d, "pages").select("page_id", changed.alias("url"), host.alias("host"))


@register("repo_url_parse", with_views(V_URLS) + """
SELECT page_id, CASE WHEN reason IS NULL THEN o END AS owner, CASE WHEN reason IS NULL THEN r END AS repo, reason
FROM v_named""")
def repo_url_parse(spark, d):
    parsed = t.repo_url(F.col("url"), F.col("host"))
    return urls(spark, d).select("page_id", parsed.alias("p")).select("page_id", "p.*")


@register("repo_name", with_views(V_URLS) + r"""
SELECT page_id, CASE WHEN reason IS NULL THEN o || '-' || r
  WHEN page_id % 4 = 0 THEN 'repository' WHEN page_id % 4 = 1 THEN 'uploaded-project'
  ELSE left(regexp_replace(regexp_replace(split_part(url, '/', -1), '^(.+)\.[^.]+$', '\1')
              || ' v' || page_id || repeat('x', 70), '[^A-Za-z0-9_.-]+', '-', 'g'), 80) END AS name
FROM v_named""")
def repo_name(spark, d):
    n, url = F.col("page_id").cast("string"), F.col("url")
    filename = (
        F.when(F.col("page_id") % 4 == 1, F.lit(""))
        .when(F.col("page_id") % 4 > 1, F.concat(
            t.stem(F.element_at(F.split(url, "/"), -1)), F.lit(" v"), n,
            F.repeat(F.lit("x"), F.lit(70)), F.lit(".zip")))
    )
    filename = F.when(F.col("page_id") % 4 == 1, F.lit("/.zip/")).otherwise(filename)
    parsed = t.repo_url(url, F.col("host"))
    return urls(spark, d).select("page_id", parsed.alias("p"), filename.alias("f")).select(
        "page_id", t.display_name(F.col("p.owner"), F.col("p.repo"), F.col("f")).alias("name"))
