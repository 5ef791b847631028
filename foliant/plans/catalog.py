"""Queries over the driver tables, each with the SQL that must give the same rows.

Plain documents hold little of what cleaning acts on, so several queries seed their input: a text before each document
that its number decides, by one SQL expression for both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import kinds, names, tables, text, thai, tokens
from foliant.operators import chunking, layout, manifest, profiles, readings
from foliant.sources import files, office, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What stands before documents, by number modulo six; the last stands alone.
_SEEDS = (
    "# Head\r\n\r\n\r\n\r\nA  b\t\tc   \nA  b\t\tc\n  - item  one\n",
    "| a | b |\n| - | - |\n| 0 | 0 |\n| 0 | 0 |\n\nafter\nafter\n",
    "```py\nx    =  1\n\n\n\nx    =  1\n```\nsame\nsame\n\nsame\n\n\n\n\n",
    '<style>p{}</style><!-- c --><span class="x">Keep</span> p { color: red; }\n{"a": 1}\n{name}\n',
    "ok\u200b\ufeffay\rnext\n| only | row |\n~~~\nunterminated   x\n",
)
SEEDED = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}' || text" for i, s in enumerate(_SEEDS)) + " ELSE text END"
#: DuckDB's CTE of the lines of a text column t (n from 1).
_LINES = "SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM s"


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(SEEDED).alias("t"))


_NL = "replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_INVISIBLE = "regexp_replace({}, '[\\x{{feff}}\\x{{200b}}\\x{{200e}}\\x{{200f}}]', '', 'g')"
_CLEAN = _INVISIBLE.format(_NL)


# -- text -------------------------------------------------------------------


@query(f"WITH s AS (SELECT doc_id, {SEEDED} AS t FROM documents) SELECT doc_id, {_CLEAN} AS cleaned FROM s")
def clean_newlines_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", text.without_invisible(text.newlines(F.col("t"))).alias("cleaned"))


_COMPRESSED = "regexp_replace(regexp_extract(line, '^[ \\t]*') || regexp_replace(regexp_replace(line, '^[ \\t]*', ''), '[ \\t]{2,}', ' ', 'g'), '[ \\t]+$', '')"


@query(f"WITH s AS (SELECT doc_id, {SEEDED} AS t FROM documents), l AS ({_LINES}) SELECT doc_id, string_agg({_COMPRESSED}, chr(10) ORDER BY n) AS cleaned FROM l GROUP BY doc_id")
def clean_space_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("t", "\n"), lambda x: text.without_trailing_spaces(text.single_spaces(x)))
    return seeded(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("cleaned"))


@query("""
WITH s AS (SELECT doc_id, text AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM s),
     k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM l WHERE trim(line, ' ' || chr(9)) <> ''),
     kept AS (SELECT doc_id, line, n FROM k WHERE before IS NULL OR before <> line UNION ALL SELECT doc_id, line, n FROM l WHERE trim(line, ' ' || chr(9)) = '')
SELECT s.doc_id, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS cleaned, count(n) AS n_lines FROM s LEFT JOIN kept ON s.doc_id = kept.doc_id GROUP BY s.doc_id""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.without_repeats(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("cleaned")).withColumn("n_lines", F.size(F.split("cleaned", "\n")).cast("long"))


_BLOCKS = f"""
WITH s AS (SELECT doc_id, {_CLEAN} AS t FROM (SELECT doc_id, {SEEDED} AS t FROM documents)), l AS ({_LINES}),
     f AS (SELECT *, regexp_matches(line, '^\\s*(```|~~~)') AS fence FROM l),
     p AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM f),
     k AS (SELECT *, CASE WHEN fences % 2 = 1 OR fence THEN 'code' WHEN regexp_matches(line, '^\\s*\\|.*\\|\\s*$') THEN 'table' ELSE 'prose' END AS kind FROM p),
     m AS (SELECT *, CASE WHEN kind <> lag(kind) OVER w OR (kind = 'code' AND fence AND fences % 2 = 1) OR lag(kind) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
     i AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS block_no FROM m),
     b AS (SELECT doc_id, block_no, kind, string_agg(line, chr(10) ORDER BY n) AS text FROM i GROUP BY ALL)"""


@query(_BLOCKS + " SELECT doc_id, block_no::INT AS block_no, kind, text FROM b")
def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.without_invisible(text.newlines(F.col("t")))
    found = seeded(spark, sf_dir).select("doc_id", F.posexplode(text.blocks(clean)).alias("block_no", "b"))
    return found.select("doc_id", "block_no", "b.kind", "b.text")


_RESIDUE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)\\s+(?:style|class|id)=\"[^\"]*\"', '', 'g'), '\\{{\\s*[a-zA-Z-][a-zA-Z0-9-]*\\s*:[^{{}}\"'']*\\}}', '', 'g'), '(?i)</?(?:span|div|font|o:p|w:[a-z]+)\\b[^>]*>', '', 'g')"


@query(f"SELECT page_id, {_RESIDUE.format('html')} AS cleaned FROM pages")
def strip_style_script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_residue(F.col("html")).alias("cleaned"))


@query(f"WITH s AS (SELECT doc_id, {SEEDED} AS t FROM documents) SELECT doc_id, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS cleaned FROM s")
def blank_run_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", text.capped_blank_lines(F.col("t")).alias("cleaned"))


_OPTIMIZED = f"""{_BLOCKS},
     c AS (SELECT doc_id, block_no, kind, CASE kind WHEN 'code' THEN regexp_replace(text, '\\n+$', '') WHEN 'prose' THEN {_RESIDUE.format('text')} ELSE text END AS t FROM b),
     x AS (SELECT doc_id, block_no, kind, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM c),
     y AS (SELECT doc_id, block_no, kind, n, CASE kind WHEN 'prose' THEN {_COMPRESSED} WHEN 'table' THEN trim(line, ' ' || chr(9)) ELSE line END AS line FROM x),
     z AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, block_no, trim(line) = '' ORDER BY n) AS before FROM y),
     kept AS (SELECT * FROM z WHERE kind <> 'prose' OR trim(line) = '' OR before IS NULL OR before <> line),
     one AS (SELECT doc_id, block_no, CASE kind WHEN 'prose' THEN regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE t END AS t FROM (SELECT doc_id, block_no, kind, string_agg(line, chr(10) ORDER BY n) AS t FROM kept GROUP BY doc_id, block_no, kind)),
     whole AS (SELECT doc_id, trim(regexp_replace(string_agg(t, chr(10) ORDER BY block_no), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) || chr(10) AS markdown FROM one GROUP BY doc_id)"""


@query(_OPTIMIZED + " SELECT doc_id, markdown FROM whole")
def optimize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(spark, sf_dir).select("doc_id", text.optimized(F.col("t")).alias("markdown"))


_SAVED = "CASE WHEN chars_in <= 0 THEN 0.0 ELSE greatest(0.0, least(100.0, (1 - chars_out / chars_in) * 100)) END"


@query(f"{_OPTIMIZED}, sizes AS (SELECT w.doc_id, length(d.t) AS chars_in, length(markdown) AS chars_out, markdown FROM whole w JOIN (SELECT doc_id, {SEEDED} AS t FROM documents) d ON w.doc_id = d.doc_id) SELECT doc_id, chars_in, chars_out, {tokens.estimated_sql('markdown')} AS tokens, round({_SAVED}, 4) AS saved_pct FROM sizes")
def document_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: sanitize, estimate, compare."""
    rows = seeded(spark, sf_dir).withColumn("markdown", text.optimized(F.col("t"))).withColumns({"chars_in": F.length("t").cast("long"), "chars_out": F.length("markdown").cast("long")})
    return rows.select("doc_id", "chars_in", "chars_out", tokens.estimated(F.col("markdown")).alias("tokens"), F.round(tokens.saved_percent(F.col("chars_in"), F.col("chars_out")), 4).alias("saved_pct"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))) AS INT) AS n_rows FROM documents")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), text.is_table_line)).alias("n_rows"))


# -- tokens, sizes, names ---------------------------------------------------


@query(f"SELECT doc_id, {tokens.estimated_sql('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.estimated(F.col("text")).alias("tokens"))


@query(f"SELECT lang, count(*) AS documents, sum({tokens.estimated_sql('text')})::BIGINT AS tokens FROM documents GROUP BY lang")
def token_totals_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(tokens.estimated(F.col("text"))).alias("tokens"))


@query(f"SELECT role, count(*) AS turns, sum({tokens.estimated_sql('text')})::BIGINT AS tokens FROM conversations GROUP BY role")
def token_totals_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(tokens.estimated(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' ELSE printf('%.1f', b / 1024.0) || ' KB' END AS size FROM (SELECT doc_id, strlen(text) * (1 + doc_id % 3) AS b FROM documents)")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.human_size(F.octet_length("text") * (1 + F.col("doc_id") % 3)).alias("size"))


@query("SELECT doc_id, strlen(text)::BIGINT AS original, length(text)::BIGINT AS optimized, greatest(0.0, least(100.0, (1 - length(text) / strlen(text)) * 100)) AS saved FROM documents WHERE text <> ''")
def size_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.octet_length("text").cast("long").alias("original"), F.length("text").cast("long").alias("optimized"))
    return rows.withColumn("saved", tokens.saved_percent(F.col("original"), F.col("optimized")))


@query(f"SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS chars, {tokens.estimated_sql('text')} AS tokens FROM documents")
def sha256_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"), tokens.estimated(F.col("text")).alias("tokens"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as results: some failed, some with warnings."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/in/"), "source", F.lit(".txt")).alias("source"), F.lit(None).cast("string").alias("output"), F.lit("text").alias("kind"), F.lit("text").alias("engine"),
        (F.col("doc_id") % 10 != 0).alias("success"), F.when(F.col("doc_id") % 10 == 0, F.lit("broken")).alias("error"), F.when(F.col("doc_id") % 7 == 0, F.lit("unsure")).alias("warning"),
        (F.col("doc_id") / 3).alias("duration_s"), F.col("text").alias("markdown"), F.octet_length("text").cast("long").alias("original_size"),
    )


@query(f"SELECT count(*) AS document_count, sum({tokens.estimated_sql('text')})::BIGINT AS total_tokens FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND regexp_matches(text, '\\S')")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.deliverable(_results(spark, sf_dir)).agg(F.count("*").alias("document_count"), F.sum(tokens.estimated(F.col("markdown"))).alias("total_tokens"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'Error' WHEN doc_id % 7 = 0 THEN 'Warning' ELSE 'Success' END AS status FROM documents) GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(_results(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (doc_id % 10 <> 0) AS converted, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 = 0) AS warned, count(*) FILTER (doc_id % 10 = 0) AS failed, (sum({tokens.estimated_sql('text')}) FILTER (doc_id % 10 <> 0))::BIGINT AS tokens FROM documents")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.summary(_results(spark, sf_dir))


@query(f"SELECT doc_id, '/in/' || source || '.txt' AS source, CASE WHEN doc_id % 10 = 0 THEN 'Error' WHEN doc_id % 7 = 0 THEN 'Warning' ELSE 'Success' END AS status, CASE WHEN doc_id % 10 <> 0 THEN {tokens.estimated_sql('text')} END AS token_estimate FROM documents")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir)
    return rows.select("doc_id", "source", tokens.status(F.col("success"), F.col("warning")).alias("status"), F.when(F.col("success"), tokens.estimated(F.col("markdown"))).alias("token_estimate"))


@query("SELECT doc_id, CASE k WHEN 1 THEN source ELSE source || '-' || (k - 1) END || '.md' AS file FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", names.safe_stem(F.col("source")).alias("stem"))
    return names.unique_names(rows, "stem", "doc_id").select("doc_id", "file")


@query("SELECT page_id, substr(CASE WHEN c = '' THEN 'document' ELSE c END, 1, 120) AS stem FROM (SELECT page_id, regexp_replace(trim(regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g')), '[. ]+$', '') AS c FROM pages)")
def safe_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.safe_stem(F.col("url")).alias("stem"))


# -- detection --------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'json' WHEN page_id % 4 = 1 THEN 'html' WHEN regexp_matches(lower(url), '\\.html$') THEN 'html' ELSE 'unknown' END AS kind,
CASE WHEN page_id % 4 <= 1 THEN 'heuristic' WHEN regexp_matches(lower(url), '\\.html$') THEN 'extension' ELSE 'fallback' END AS confidence FROM pages""")
def detect_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.expr("CASE page_id % 4 WHEN 0 THEN '{\"a\": [1, 2]}' WHEN 1 THEN html ELSE 'plain words' END")
    found = table(spark, sf_dir, "pages").select("page_id", kinds.detected(F.col("url"), F.encode(head, "UTF-8")).alias("d"))
    return found.select("page_id", "d.kind", "d.confidence")


@query("SELECT doc_id, doc_id % 3 = 0 AS is_mail FROM documents")
def eml_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE doc_id % 3 WHEN 0 THEN 'Subject: x\nX-A: y\nFROM: a@b\n\n' || text WHEN 1 THEN 'To: only one\n' || text ELSE text END")
    return table(spark, sf_dir, "documents").select("doc_id", (kinds.mail_headers(body) >= 2).alias("is_mail"))


@query("SELECT min(CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END) AS path, count(*) AS n FROM documents GROUP BY lower(source)")
def target_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select(F.expr("CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END").alias("path"))
    counts = paths.groupBy(F.lower("path").alias("k")).agg(F.count("*").alias("n"))
    return files.without_repeats(paths).join(counts, F.lower("path") == F.col("k")).select("path", "n")


# -- chunks -----------------------------------------------------------------


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     g AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS blanks FROM l),
     b AS (SELECT doc_id, blanks, string_agg(line, chr(10) ORDER BY n) AS block FROM g WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY blanks) - 1)::INT AS block_no, block FROM b""")
def logical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have neither fences nor headers; blocks are what blank lines part."""
    blocks = F.arrow_udf(lambda texts: pa.array([chunking.logical_blocks(t.as_py() or "") for t in texts], pa.list_(pa.string())), "array<string>")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks("text")).alias("block_no", "block"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     c AS (SELECT doc_id, list(length(line) ORDER BY n) AS costs FROM l GROUP BY doc_id),
     r AS (SELECT doc_id, costs, 1 AS i, 0::BIGINT AS filled, 0 AS chunks FROM c UNION ALL
           SELECT doc_id, costs, i + 1, CASE WHEN chunks > 0 AND filled + costs[i] <= 400 THEN filled + costs[i] ELSE costs[i] END, chunks + (chunks = 0 OR filled + costs[i] > 400)::INT FROM r WHERE i <= len(costs))
SELECT doc_id, chunks AS n_chunks FROM r WHERE i = len(costs) + 1""")
def pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily, cost by length, budget 400."""
    costs = F.transform(F.split("text", "\n"), F.length)
    start = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("chunks"))

    def step(a, x):
        fits = (a["chunks"] > 0) & (a["filled"] + x <= 400)
        return F.struct(F.when(fits, a["filled"] + x).otherwise(x).alias("filled"), F.when(fits, a["chunks"]).otherwise(a["chunks"] + 1).alias("chunks"))

    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(costs, start, step)["chunks"].alias("n_chunks"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_chunks(seeded(spark, sf_dir), 300, "t")


# -- web pages --------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS raw_title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("raw_title"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(pages):
        return pages.map(web.html_to_markdown, na_action="ignore")

    return table(spark, sf_dir, "pages").select("page_id", run("html").alias("markdown"))


# -- tables -----------------------------------------------------------------


@query("""SELECT r_name, '| nation | key |' || chr(10) || '| --- | ---: |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def render_nation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    grids = rows.groupBy("r_name").agg(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), cells).alias("grid"))
    return grids.select("r_name", tables.rendered(F.col("grid"), alignments=[None, "right"]).alias("markdown"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), '<br>') AS cell FROM documents""")
def escape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tables.escaped(F.col("text")).alias("cell"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
     c AS (SELECT doc_id, n, list_transform(string_split(line, '|'), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS cells FROM l),
     k AS (SELECT * FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0), w AS (SELECT doc_id, max(len(cells)) AS width, count(*) AS n_rows FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(width, 0)::INT AS width, coalesce(n_rows, 0)::INT AS n_rows FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id""")
def pad_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tables.normalized(F.transform(F.split("text", "\n"), lambda x: F.split(x, "[|]")))
    rows = table(spark, sf_dir, "documents").select("doc_id", grid.alias("grid"))
    return rows.select("doc_id", F.when(F.size("grid") > 0, F.size(F.get("grid", F.lit(0)))).otherwise(0).alias("width"), F.size("grid").alias("n_rows"))


@query("""SELECT l_orderkey, l_linenumber, total > 5 AS truncated FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
WHERE k <= CASE WHEN total > 5 THEN 3 ELSE 5 END""")
def truncate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders with over five rows three are shown, of others all."""
    whole = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(whole.orderBy("l_linenumber")).alias("k"), F.count("*").over(whole).alias("total"))
    return rows.filter(F.col("k") <= F.when(F.col("total") > 5, 3).otherwise(5)).select("l_orderkey", "l_linenumber", (F.col("total") > 5).alias("truncated"))


@query("""SELECT doc_id, coalesce(max(n) FILTER (trim(line) <> ''), 0)::INT AS n_rows FROM (SELECT doc_id, unnest(string_split(text || chr(10) || chr(10), chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || chr(10), chr(10)), 1) AS n FROM documents) GROUP BY doc_id""")
def last_nonblank_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.arrow_udf(lambda texts: pa.array([office.scanned(([x] for x in t.as_py().split("\n")), 1)[1] for t in texts], pa.int32()), "int")
    return table(spark, sf_dir, "documents").select("doc_id", count(F.concat("text", F.lit("\n\n"))).alias("n_rows"))


@query("""SELECT event_id AS id, CASE WHEN strftime(ts, '%H:%M:%S.%f') = '00:00:00.000000' THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events
UNION ALL SELECT -1 - o_orderkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders""")
def format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tables.shown_time(F.col("ts")).alias("shown"))
    return events.unionByName(table(spark, sf_dir, "orders").select((-1 - F.col("o_orderkey")).alias("id"), tables.shown_time(F.col("o_orderdate")).alias("shown")))


@query("SELECT l_orderkey, l_linenumber, printf('%d%%', round(l_discount * 100)::INT) AS discount FROM lineitem")
def format_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tables.shown_percent(F.col("l_discount"), 0).alias("discount"))


@query("SELECT event_id, event_id % 5 <> 0 AS valid FROM events")
def json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("CASE WHEN event_id % 5 = 0 THEN '{' || props ELSE props END")
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).isNotNull().alias("valid"))


# -- pages and boxes --------------------------------------------------------


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS doc, l_partkey % 60 + 1 AS n FROM lineitem), i AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM p),
     r AS (SELECT doc, min(n) AS a, max(n) AS b FROM i GROUP BY doc, g), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY a) AS k, count(*) OVER (PARTITION BY doc) AS c FROM r)
SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (k <= 10) || CASE WHEN max(c) > 10 THEN '...' ELSE '' END AS ranges FROM k GROUP BY doc""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 60).alias("page"))
    return layout.page_ranges(pages, ["doc"], "page")


_WORDS = 'SELECT event_id AS word_no, user_id % 7 AS page, (event_id * 37) % 1000 AS "left", (event_id * 91) % 700 AS top, 10 + event_id % 30 AS width, 8 + event_id % 5 AS height FROM events'
_CELLS = "SELECT p.i AS page, r.i AS r, c.i AS c, c.i * 240 - 20 * (r.i % 2) AS x0, r.i * 170 - 5 AS y0, c.i * 240 + 230 AS x1, r.i * 170 + 165 AS y1 FROM (SELECT unnest(range(7)) AS i) p, (SELECT unnest(range(4)) AS i) r, (SELECT unnest(range(4)) AS i) c"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS word_no", "user_id % 7 AS page", "(event_id * 37) % 1000 AS left", "(event_id * 91) % 700 AS top", "10 + event_id % 30 AS width", "8 + event_id % 5 AS height")


def _cells(spark: SparkSession) -> DataFrame:
    grid = spark.range(7 * 16).selectExpr("id DIV 16 AS page", "(id DIV 4) % 4 AS r", "id % 4 AS c")
    return grid.selectExpr("page", "r", "c", "c * 240 - 20 * (r % 2) AS x0", "r * 170 - 5 AS y0", "c * 240 + 230 AS x1", "r * 170 + 165 AS y1")


@query(f"""WITH w AS ({_WORDS}), k AS ({_CELLS}), j AS (SELECT word_no, w.page, r, c, row_number() OVER (PARTITION BY word_no ORDER BY r, c) AS first FROM w JOIN k ON w.page = k.page
AND "left" + width / 2.0 >= x0 AND "left" + width / 2.0 < x1 AND top + height / 2.0 >= y0 AND top + height / 2.0 < y1) SELECT word_no, page, r, c FROM j WHERE first = 1""")
def word_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_to_cells(_words(spark, sf_dir), _cells(spark), ["page"], "word_no").select("word_no", "page", "r", "c")


@query(f"""WITH w AS ({_WORDS}), k AS ({_CELLS}) SELECT word_no, page FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE w.page = k.page AND "left" BETWEEN x0 AND x1 AND top BETWEEN y0 AND y1)""")
def chars_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _words(spark, sf_dir).selectExpr("word_no", "page", "left AS x", "top AS y")
    return layout.outside_boxes(chars, _cells(spark), ["page"]).select("word_no", "page")


_TABLES = "SELECT user_id AS page, event_id AS table_no, (event_id * 13) % 90 AS x0, (event_id * 7) % 90 AS y0, (event_id * 13) % 90 + 10 + (event_id * 31) % 200 AS x1, (event_id * 7) % 90 + 10 + (event_id * 17) % 200 AS y1, event_id % 9 AS cells FROM events"


@query(f"""WITH t AS ({_TABLES}) SELECT page, table_no FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.page = b.page AND a.table_no <> b.table_no AND a.cells <= 4 AND (a.x1 - a.x0) * (a.y1 - a.y0) > (b.x1 - b.x0) * (b.y1 - b.y0)
AND a.x0 <= b.x0 + 2 AND a.y0 <= b.y0 + 2 AND a.x1 >= b.x1 - 2 AND a.y1 >= b.y1 - 2)""")
def frame_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "events").selectExpr(*_TABLES.removeprefix("SELECT ").removesuffix(" FROM events").split(", "))
    return layout.without_frames(boxes, ["page"]).select("page", "table_no")


@query("""WITH w AS (SELECT user_id AS page, event_id % 3 AS line, event_id, event_type, (event_id * 29) % 101 - 1 AS conf FROM events)
SELECT page, line, string_agg(event_type, ' ' ORDER BY event_id) AS text, round(coalesce(avg(conf) FILTER (conf >= 0), 0.0), 6) AS mean_conf FROM w GROUP BY page, line""")
def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "events").selectExpr("user_id AS page", "event_id % 3 AS line_no", "event_id AS word_no", "event_type AS text", "(event_id * 29) % 101 - 1 AS conf")
    return layout.line_confidences(words, ["page", "line_no"], "word_no").select("page", F.col("line_no").alias("line"), F.col("line").alias("text"), F.round("mean_conf", 6).alias("mean_conf"))


@query(f"""WITH w AS ({_WORDS}) SELECT page, min("left") AS x0, min(top) AS y0, max("left" + width) AS x1, max(top + height) AS y1 FROM w GROUP BY page""")
def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_boxes(_words(spark, sf_dir), ["page"])


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS r FROM c)
SELECT user_id, event_type, n AS n_votes, votes::BIGINT AS votes FROM k WHERE r = 1 AND n >= 2 AND n >= 0.3 * votes""")
def vote_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.votes(table(spark, sf_dir, "events"), ["user_id"], "event_type", share=0.3, order="event_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS start, o_orderkey + 40 AS stop, o_orderstatus AS state FROM orders), e AS (SELECT event_id, user_id % 100 + 1 AS k, event_id * 3 AS pos FROM events)
SELECT event_id, CASE WHEN pos < stop THEN state END AS state FROM (SELECT event_id, pos, stop, state, row_number() OVER (PARTITION BY event_id ORDER BY start DESC) AS n FROM e LEFT JOIN r ON k = o_custkey AND start <= pos) WHERE n = 1""")
def as_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey AS start", "o_orderkey + 40 AS stop", "o_orderstatus AS state")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 100 + 1 AS k", "event_id * 3 AS at")
    return layout.as_of(rows, runs, ["k"], "at", "start", "stop", "state").select("event_id", "state")


@query(f"""WITH w AS ({_WORDS}), g AS (SELECT *, "left" - (lag("left") OVER o + lag(width) OVER o) AS gap, lag("left") OVER o IS NULL AS first FROM w WINDOW o AS (PARTITION BY page, top ORDER BY "left", word_no::VARCHAR))
SELECT page, top, string_agg(CASE WHEN first THEN '' WHEN gap > 1.5 * height THEN '   ' ELSE ' ' END || word_no, '' ORDER BY "left", word_no::VARCHAR) AS line FROM g GROUP BY page, top""")
def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir).withColumn("text", F.col("word_no").cast("string"))
    return layout.joined_words(words, ["page", "top"])


# -- Thai -------------------------------------------------------------------

#: Samples of Thai, clean and mis-encoded.
_THAI = ("\u0e19\u0e49\u0e4d\u0e32", "\u0e0b\u0e49\u0e49\u0e32", "\u0e01\u0e34\u0e34\u0e19", "\u0e01\u00e9\u0e02\u00e8\u0e04\u00ea\u0e07", "\u0e08\u0e33\u0e01\u0e31\u0e14", "a\x01b\x02c\x03")
_THAI_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{s}' || text" for i, s in enumerate(_THAI[:5])) + f" ELSE '{_THAI[5]}' || text END"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\x{{0e49}}\\x{{0e49}}\\x{{0e32}}', '\u0e49\u0e33', 'g'), '\\x{{0e34}}+', '\u0e34', 'g'), '([\\x{{0e48}}-\\x{{0e4b}}]?)\\x{{0e4d}}([\\x{{0e48}}-\\x{{0e4b}}]?)\\x{{0e32}}', '\\1\\2\u0e33', 'g') AS spelled FROM (SELECT doc_id, {_THAI_SQL} AS t FROM documents)""")
def thai_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", thai.normalized(F.expr(_THAI_SQL)).alias("spelled"))


@query("SELECT doc_id, doc_id % 6 = 3 AS swapped, doc_id % 6 = 5 AS lost FROM documents")
def mojibake_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr(_THAI_SQL)
    return table(spark, sf_dir, "documents").select("doc_id", thai.has_swapped_letters(body).alias("swapped"), thai.has_lost_marks(body).alias("lost"))


# -- profiles and lines -----------------------------------------------------

#: Orders as pages, their lines as columns of a page, quantities as ink.
_PROFILE = "SELECT l_orderkey AS page, l_linenumber AS x, max(l_quantity) AS ink FROM lineitem GROUP BY ALL"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("x")).agg(F.max("l_quantity").alias("ink"))


@query(f"""WITH p AS ({_PROFILE}), e AS (SELECT page, min(x) AS a, max(x) AS z FROM p WHERE ink > 25 GROUP BY page),
     q AS (SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS island FROM p JOIN e USING (page) WHERE x BETWEEN a AND z AND ink <= 25)
SELECT page, min(x)::BIGINT AS start, max(x)::BIGINT + 1 AS stop FROM q GROUP BY page, island HAVING count(*) >= 2""")
def gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.gutters(profile(spark, sf_dir), ["page"], "x", "ink", F.lit(2), 25)


@query(f"""WITH q AS (SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS island FROM ({_PROFILE}) WHERE ink < 30)
SELECT page, min(x)::BIGINT AS start, max(x)::BIGINT + 1 AS stop FROM q GROUP BY page, island HAVING count(*) >= 3""")
def dark_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.dark_bands(profile(spark, sf_dir), ["page"], "x", "ink", 30, 3)


@query("""SELECT doc_id, CASE WHEN bare = '' THEN 0 ELSE length(regexp_replace(bare, '[^\\p{L}\\p{N}\\p{M}]', '', 'g')) / length(bare) END::DOUBLE AS share
FROM (SELECT doc_id, regexp_replace(text, '[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]', '', 'g') AS bare FROM documents)""")
def wordlike_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", profiles.wordlike(F.col("text")).alias("share"))


@query("""SELECT doc_id, CASE WHEN place > 0 AND key <> '' THEN array_to_string(list_transform(lines, lambda x, i: CASE WHEN i = place THEN 'changed' ELSE x END), chr(10)) ELSE text END AS text
FROM (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_replace(x, '\\s+', '', 'g')), key), 0) AS place
      FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_replace(string_split(text, chr(10))[-1], '\\s+', '', 'g') AS key FROM documents))""")
def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that reads like the last one, changed."""
    last = F.element_at(F.split("text", "\n"), -1)
    return table(spark, sf_dir, "documents").select("doc_id", profiles.with_line(F.col("text"), last, F.lit("changed")).alias("text"))


# -- regression -------------------------------------------------------------


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'error' WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'worse' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS outcome FROM documents""")
def golden_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("markdown"))
    golden = docs.filter("path % 9 = 0 OR path % 11 <> 0").withColumn("status", F.lit("Success"))
    now = docs.filter("path % 9 <> 0").withColumn("markdown", F.expr("CASE WHEN path % 5 = 0 THEN markdown || '!' ELSE markdown END"))
    now = now.withColumn("status", F.expr("CASE WHEN path % 10 = 0 THEN 'Error' WHEN path % 7 = 0 THEN 'Warning' ELSE 'Success' END"))
    return manifest.regression(golden, now).select("path", "outcome")


@query("SELECT doc_id AS path, phrase FROM (SELECT doc_id, text, unnest(['the the', 'of and', substr(text, 3, 30)]) AS phrase FROM documents) WHERE NOT contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(phrase, '\\s+', '', 'g'))")
def missing_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("markdown"))
    phrases = docs.select("path", F.explode(F.array(F.lit("the the"), F.lit("of and"), F.substring("markdown", 3, 30))).alias("phrase"))
    return manifest.missing_phrases(docs, phrases)


# -- readings and pages -----------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_discount")))
    return lines.selectExpr("l_orderkey AS doc", "l_linenumber AS page", "CASE WHEN l_partkey % 3 = 0 THEN 'words enough for a whole page' ELSE ' x ' END AS text", "l_discount * 10 AS image_share", "l_suppkey % 11 = 0 AS corrupt")


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey % 3 <> 0 AND l_discount * 10 >= 0.25 AS image, l_suppkey % 11 = 0 AS corrupt FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)),
     n AS (SELECT *, row_number() OVER (PARTITION BY doc, image ORDER BY page) AS n FROM p)
SELECT doc, page, CASE WHEN corrupt THEN 'read' WHEN image THEN CASE WHEN n <= 2 THEN 'read' ELSE 'skipped' END ELSE 'text' END AS route FROM n""")
def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.pages_to_read(_pages(spark, sf_dir), most=2).select("doc", "page", "route")


@query("""SELECT l_orderkey AS doc, string_agg('## Page ' || (l_linenumber + 1) || CASE WHEN l_suppkey % 11 = 0 THEN ' (OCR)' ELSE '' END || chr(10) || chr(10) || CASE WHEN l_partkey % 3 = 0 THEN 'words enough for a whole page' ELSE 'x' END, chr(10) || chr(10) ORDER BY l_linenumber) AS markdown
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings.rendered_pages(_pages(spark, sf_dir).withColumnRenamed("corrupt", "ocr"))


@query("""WITH l AS (SELECT event_id, (event_id * 29) % 101 AS conf, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '~ a | *' WHEN 2 THEN 'no' ELSE 'two words' END AS line FROM events)
SELECT event_id, CASE WHEN conf < CASE WHEN length(replace(line, ' ', '')) <= 3 THEN 60 ELSE 40 END THEN 'dropped' WHEN line = '~ a | *' AND conf < 75 THEN 'noise' WHEN conf < 70 THEN 'review' ELSE 'kept' END AS outcome FROM l""")
def line_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").selectExpr("event_id", "CAST((event_id * 29) % 101 AS DOUBLE) AS mean_conf", "CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '~ a | *' WHEN 2 THEN 'no' ELSE 'two words' END AS line")
    return readings.judged_lines(lines).select("event_id", "outcome")


@query(f"""WITH w AS (SELECT page, "left", top, width, height FROM ({_WORDS}) WHERE word_no % 3 = 0), i AS (SELECT DISTINCT page, "left" // 16 AS gx, top // 16 AS gy FROM ({_WORDS}))
SELECT page, gx, gy FROM i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.page = i.page AND gx BETWEEN "left" // 16 AND ("left" + width - 1) // 16 AND gy BETWEEN top // 16 AND (top + height - 1) // 16)""")
def uncovered_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    ink = words.selectExpr("page", "left DIV 16 AS gx", "top DIV 16 AS gy").distinct()
    return readings.uncovered(ink, words.withColumn("conf", F.when(F.col("word_no") % 3 == 0, 90).otherwise(10)), ["page"])


@query("""WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS r, l_partkey % 4 + 1 AS c, min(l_suppkey) AS v FROM lineitem GROUP BY ALL), m AS (SELECT o_orderkey AS sheet, 1 + o_custkey % 3 AS r1, 1 + o_custkey % 2 AS c1, 2 + o_custkey % 3 AS r2, 3 + o_custkey % 2 AS c2 FROM orders)
SELECT c.sheet, c.r, c.c, CASE WHEN m.sheet IS NULL THEN c.v ELSE t.v END::VARCHAR AS value FROM c LEFT JOIN m ON c.sheet = m.sheet AND c.r BETWEEN r1 AND r2 AND c.c BETWEEN c1 AND c2 LEFT JOIN c t ON t.sheet = m.sheet AND t.r = r1 AND t.c = c1""")
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("r"), (F.col("l_partkey") % 4 + 1).alias("c")).agg(F.min("l_suppkey").cast("string").alias("value"))
    merges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sheet", "0 AS n", "1 + o_custkey % 3 AS r1", "1 + o_custkey % 2 AS c1", "2 + o_custkey % 3 AS r2", "3 + o_custkey % 2 AS c2")
    return readings.filled_merges(cells, merges, ["sheet"])


_SIZE = "lpad(CASE WHEN {0} < 1024 THEN {0} || ' B' ELSE printf('%.1f KB', round_even({0} / 1024, 1)) END, 12, ' ')"


@query(f"""SELECT doc_id, rpad(source || '.txt', 28, ' ') || {_SIZE.format("o")} || {_SIZE.format("m")} || lpad('~' || format('{{:,}}', n), 10, ' ')
|| lpad(printf('%.1f%%', CASE WHEN o <= 0 THEN 0.0 ELSE greatest(0.0, least(100.0, (1 - m::DOUBLE / o::DOUBLE) * 100)) END), 8, ' ') AS line
FROM (SELECT doc_id, source, strlen(text) AS m, strlen(text) + doc_id % 7 * 100 AS o, {tokens.estimated_sql('text')} AS n FROM documents)""")
def savings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"), size.alias("markdown_size"), (size + F.col("doc_id") % 7 * 100).alias("original_size"), tokens.estimated(F.col("text")).alias("tokens"))
    shown = docs.withColumn("saved_ratio", tokens.saved_percent(F.col("original_size"), F.col("markdown_size")))
    return manifest.savings_lines(shown, "doc_id").select("doc_id", "line")


@query("""SELECT doc_id, CASE WHEN suffix IN ('mp3', 'mp4') THEN 'audio and video are not read' WHEN suffix = 'md' THEN 'a result' WHEN suffix = 'zzz' THEN 'unsupported kind' END AS reject_reason
FROM (SELECT doc_id, (['mp3', 'md', 'pdf', 'zzz', 'HTML', 'mp4', 'py'])[doc_id % 7 + 1] AS suffix FROM documents)""")
def intake_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ("mp3", "md", "pdf", "zzz", "HTML", "mp4", "py"))), (F.col("doc_id") % 7 + 1).cast("int"))
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"))
    return files.intake(paths).select(F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("doc_id"), "reject_reason")


@query("SELECT doc_id, length(text)::INT + 2 * (doc_id % 5)::INT AS width FROM documents")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat("text", F.repeat(F.lit("日"), (F.col("doc_id") % 5).cast("int")), F.lit("ั"))
    return table(spark, sf_dir, "documents").select("doc_id", tables.display_width(shown).alias("width"))
