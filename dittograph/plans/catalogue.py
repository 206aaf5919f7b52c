"""Queries of the duplicate and similarity operators over the driver's tables, and their SQL.

The tables hold no file tree, so adapters give them the shape of one: ``part`` is
files (name and size), ``documents`` contents, ``embeddings`` images of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dittograph.functions import formatting as fmt
from dittograph.functions import paths
from dittograph.functions.fingerprints import quick_hash
from dittograph.operators import exact, policy, similar, view
from dittograph.plans.similar_images import similar_images
from dittograph.sources.images import write_gray_rows
from dittograph.storage import fresh

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
GROUP = ["size", "name"]
#: SSIM bound for the embeddings, whose most similar pair is below 0.5.
EDGE = 0.3


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit(""), "p_brand", "p_type", F.col("p_partkey").cast("string"), "p_name")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.encode("text", "UTF-8").alias("content"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similar.gradient_hash(F.col("embedding")).alias("hash"))


def scored(spark: SparkSession, sf_dir: str, **only) -> DataFrame:
    values = F.col("embedding")
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similar.gradient_hash(values).alias("hash"), values.alias("values"))
    return similar.scored_pairs(rows, **only)


_FILES = "files AS (SELECT p_partkey AS id, '/' || p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) || '/' || p_name AS path, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part)"
_GROUPS = _FILES + ", grouped AS (SELECT name || '_' || CAST(size AS VARCHAR) AS group_key, name, size, count(*) AS n_files, CAST((count(*) - 1) * size AS BIGINT) AS wasted, min(path) AS representative FROM files GROUP BY name, size HAVING count(*) > 1)"
_MEMBERS = _FILES + (
    ", members AS (SELECT * FROM (SELECT path, name, size, count(*) OVER w AS n_files, (count(*) OVER w - 1) * size AS wasted,"
    " CAST(row_number() OVER (PARTITION BY size, name ORDER BY path) AS INTEGER) AS rank_in_group FROM files WINDOW w AS (PARTITION BY size, name)) WHERE n_files > 1)"
)
_LIMITS = _GROUPS + (
    ", limits AS (SELECT group_key, name, size, n_files, wasted, representative, CAST(least(n_files, 500 - coalesce(before, 0)) AS BIGINT) AS taken FROM"
    " (SELECT *, sum(n_files) OVER (ORDER BY size, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM grouped) WHERE 500 - coalesce(before, 0) > 0)"
)
_HASHES = (
    "hashes AS (SELECT vec_id AS id, CAST(list_sum(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i] < embedding[i + 1] THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) AS hash FROM embeddings)"
)
_PAIRS = _HASHES + ", pairs AS (SELECT a.id AS i, b.id AS j, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS hd FROM hashes a JOIN hashes b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 25)"
_SSIM = _PAIRS + (
    ", v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),"
    " o AS (SELECT id, v, list_sum(v) / len(v) AS m, list_sum(list_transform(v, lambda x: x * x)) / len(v) AS s FROM v),"
    " raw AS (SELECT i, j, hd, a.m AS ma, b.m AS mb, a.s AS sa, b.s AS sb, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) / len(a.v) - a.m * b.m AS p FROM pairs JOIN o a ON a.id = i JOIN o b ON b.id = j),"
    " scored AS (SELECT i, j, hd, round(greatest(0.0, least(1.0, (2 * ma * mb + 1e-4) * (2 * p + 9e-4) / ((ma * ma + mb * mb + 1e-4) * ((sa - ma * ma) + (sb - mb * mb) + 9e-4)))), 6) AS ssim FROM raw)"
)
_COMPONENTS = "WITH RECURSIVE " + _SSIM + (
    ", e AS (SELECT i, j, hd, ssim FROM scored WHERE ssim >= 0.3), u AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e),"
    " r AS (SELECT a AS id, a AS seen FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen), comp AS (SELECT id, min(seen) AS component FROM r GROUP BY id)"
)
_SIZE_TEXT = "rtrim(rtrim(CAST(CAST({x} AS DECIMAL(38, 2)) AS VARCHAR), '0'), '.')"


def _sql_size(x: str) -> str:
    parts = " ".join(f"WHEN {x} < {1024 ** (k + 1)} THEN {_SIZE_TEXT.format(x=f'({x} / {float(1024**k)})')} || ' {u}'" for k, u in ((1, "KB"), (2, "MB"), (3, "GB")))
    return f"CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || ' B' {parts} ELSE {_SIZE_TEXT.format(x=f'({x} / {float(1024**4)})')} || ' TB' END"


# -- groups -------------------------------------------------------------------


@_query(f"WITH {_GROUPS} SELECT * FROM grouped")
def dup_name_size(spark, sf_dir):
    return exact.name_size_groups(files(spark, sf_dir))


@_query(f"WITH {_MEMBERS} SELECT * FROM members")
def dup_members(spark, sf_dir):
    return exact.members(files(spark, sf_dir))


@_query(f"WITH {_LIMITS} SELECT * FROM limits")
def dup_limit_cumulative(spark, sf_dir):
    return exact.group_limits(exact.name_size_groups(files(spark, sf_dir)), 500)


@_query(f"WITH {_LIMITS}, {_MEMBERS[len(_FILES) + 2:]} SELECT m.* FROM members m JOIN limits l ON l.size = m.size AND l.name = m.name WHERE rank_in_group <= taken")
def dup_limit_members(spark, sf_dir):
    return exact.limited_members(files(spark, sf_dir), 500)


@_query(
    f"WITH {_FILES}, k AS (SELECT size, count(*) AS n FROM files GROUP BY size, name) SELECT CAST(sum(n) AS BIGINT) AS files_scanned, count(*) AS distinct_keys,"
    " count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_files, CAST(coalesce(sum((n - 1) * size) FILTER (n > 1), 0) AS BIGINT) AS wasted FROM k"
)
def footer_totals(spark, sf_dir):
    return exact.totals(files(spark, sf_dir))


@_query(f"WITH {_FILES} SELECT count(*) AS n_keys FROM (SELECT DISTINCT size, name FROM files)")
def distinct_key_count(spark, sf_dir):
    return files(spark, sf_dir).select(*GROUP).distinct().agg(F.count(F.lit(1)).alias("n_keys"))


@_query("SELECT count(*) AS files_scanned FROM part")
def files_scanned(spark, sf_dir):
    return files(spark, sf_dir).agg(F.count(F.lit(1)).alias("files_scanned"))


# -- fingerprints ---------------------------------------------------------------

_CONTENT = "c AS (SELECT doc_id, '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size, encode(text) AS content FROM documents)"
_CONTENT_GROUPS = "SELECT {h} AS digest, count(*) AS n_files, min(size) AS size, min(path) AS representative FROM c WHERE content IS NOT NULL {w} GROUP BY 1 HAVING count(*) > 1"


@_query(f"WITH {_CONTENT} " + _CONTENT_GROUPS.format(h="upper(sha256(content))", w=""))
def sha256_groups(spark, sf_dir):
    return exact.content_groups(contents(spark, sf_dir))


@_query(f"WITH {_CONTENT} " + _CONTENT_GROUPS.format(h="upper(sha256(content[1:65536]))", w=""))
def quick_hash_groups(spark, sf_dir):
    return exact.content_groups(contents(spark, sf_dir), quick=True)


@_query(f"WITH {_CONTENT} SELECT doc_id, upper(sha256(content[1:65536])) AS quick FROM c")
def quick_hashes(spark, sf_dir):
    return contents(spark, sf_dir).select("doc_id", quick_hash(F.col("content")).alias("quick"))


@_query(f"WITH {_CONTENT} " + _CONTENT_GROUPS.format(h="upper(sha256(content))", w="AND size IN (SELECT size FROM c GROUP BY size HAVING count(*) > 1)"))
def size_then_hash_funnel(spark, sf_dir):
    return exact.size_then_content(contents(spark, sf_dir))


# -- texts of numbers, paths ------------------------------------------------------

_BYTES = "CAST(round(l_extendedprice * 100) AS BIGINT) * l_linenumber * l_linenumber"


@_query(f"SELECT l_orderkey, l_linenumber, {_sql_size(f'({_BYTES})')} AS size_text FROM lineitem")
def size_format_auto(spark, sf_dir):
    size = F.round(F.col("l_extendedprice") * 100).cast("long") * F.col("l_linenumber") * F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fmt.format_size(size).alias("size_text"))


@_query(
    "SELECT p_partkey, CAST(b AS VARCHAR) || ' B' AS as_bytes, "
    + ", ".join(f"{_SIZE_TEXT.format(x=f'(b / {float(1024**k)})')} || ' {u}' AS as_{u.lower()}" for k, u in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")))
    + " FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 1048576 * p_partkey AS b FROM part)"
)
def size_format_units(spark, sf_dir):
    b = F.col("p_size").cast("long") * 1048576 * F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", *[fmt.format_size(b, u).alias(f"as_{u.value.lower()}") for u in fmt.SizeUnit if u is not fmt.SizeUnit.AUTO])


@_query("SELECT s_suppkey, CASE WHEN u < 0.75 THEN 'normal' WHEN u < 0.9 THEN 'warning' ELSE 'critical' END AS band FROM (SELECT s_suppkey, (s_acctbal + 1000) / 11000 AS u FROM supplier)")
def usage_band(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select("s_suppkey", fmt.usage_band((F.col("s_acctbal") + 1000) / 11000).alias("band"))


@_query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '\\.([^./]*)$', 1)) AS ext FROM pages")
def path_text(spark, sf_dir):
    name = paths.file_name(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", name.alias("name"), paths.extension(name).alias("ext"))


_EXTS = "CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'tif' WHEN 3 THEN 'txt' ELSE 'webp' END"


@_query(f"SELECT doc_id, name, lower(regexp_extract(name, '[^.]*$')) IN ('bmp', 'tiff', 'tif', 'png') AS uncompressed FROM (SELECT doc_id, source || '.' || {_EXTS} AS name FROM documents) WHERE lower(regexp_extract(name, '[^.]*$')) IN ('jpg', 'jpeg', 'png', 'bmp', 'gif', 'webp', 'tiff', 'ico')")
def ext_filter(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "tif", "txt", "webp"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("."), ext).alias("name"))
    return rows.filter(paths.is_image(F.col("name"))).select("doc_id", "name", paths.is_uncompressed(F.col("name")).alias("uncompressed"))


@_query(f"WITH {_FILES} SELECT id, name, path, size FROM (SELECT id, name, path, size * 1048576 AS size FROM files) WHERE size >= 10485760 AND size <= 20971520")
def size_range_filter(spark, sf_dir):
    return exact.size_between(files(spark, sf_dir).withColumn("size", F.col("size") * 1048576), 10, 20)


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_text(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", fmt.format_date(F.col("o_orderdate")).alias("day"))


@_query(f"WITH {_GROUPS} SELECT group_key, CAST(n_files AS VARCHAR) || ' file' || CASE WHEN n_files = 1 THEN '' ELSE 's' END AS n_text, CAST(CAST(floor(100.0 / n_files + 0.5) AS BIGINT) AS VARCHAR) || '%' AS share FROM grouped")
def status_text(spark, sf_dir):
    return dup_name_size(spark, sf_dir).select("group_key", fmt.counted(F.col("n_files"), "file").alias("n_text"), fmt.format_percent(F.lit(1.0) / F.col("n_files")).alias("share"))


@_query(f"WITH {_FILES} SELECT id, name || ' - ' || {_sql_size('size')} || ' - ' || path AS line FROM files")
def row_text(spark, sf_dir):
    return files(spark, sf_dir).select("id", paths.described(F.col("name"), fmt.format_size(F.col("size")), F.col("path")).alias("line"))


# -- views ------------------------------------------------------------------------


@_query(f"WITH {_FILES} SELECT * FROM files WHERE contains(upper(name), 'RE') OR contains(upper(path), 'RE')")
def search_name_or_path(spark, sf_dir):
    return view.searched(files(spark, sf_dir), " re ")


@_query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def sort_modified(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("modified"))
    return view.ranked(rows, "Modified", ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "rank")


@_query(f"WITH {_MEMBERS} SELECT path, name, size, CAST(row_number() OVER (PARTITION BY size, name ORDER BY path) AS INTEGER) AS rank FROM members")
def sort_path(spark, sf_dir):
    return view.ranked(dup_members(spark, sf_dir), "Path", GROUP).select("path", "name", "size", "rank")


@_query("SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS INTEGER) AS by_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS INTEGER) AS by_size FROM part")
def sort_name_size(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    by_name = view.ranked(rows, "Name", ["p_brand"], "p_partkey").withColumnRenamed("rank", "by_name")
    return view.ranked(by_name, "Size", ["p_brand"], "p_partkey").select("p_partkey", "p_brand", "by_name", F.col("rank").alias("by_size"))


_TWICE = _MEMBERS + ", twice AS (SELECT row_number() OVER (ORDER BY size, name, path, again) AS ord, path, name, size FROM (SELECT path, name, size, 0 AS again FROM members UNION ALL SELECT upper(path), name, size, 1 FROM members))"
_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY upper(path) ORDER BY ord) AS f FROM {t}) WHERE f = 1)"


def _twice(spark, sf_dir) -> DataFrame:
    """Duplicate members as nested roots give them: each path again, in other case."""
    rows = dup_members(spark, sf_dir).select("path", "name", "size")
    both = rows.withColumn("again", F.lit(0)).unionByName(rows.withColumn("path", F.upper("path")).withColumn("again", F.lit(1)))
    return both.select("path", "name", "size", "again")


_ORDER = ["size", "name", "path", "again"]


@_query(f"WITH {_TWICE} SELECT path, name, size FROM (SELECT * FROM {_FIRST.format(t='twice')} ORDER BY ord LIMIT 300) WHERE contains(upper(name), 'RE') OR contains(upper(path), 'RE')")
def view_list_chain(spark, sf_dir):
    return view.list_view(_twice(spark, sf_dir), [F.col(c) for c in _ORDER], 300, "re").select("path", "name", "size")


@_query(f"WITH {_TWICE}, l AS (SELECT * FROM twice ORDER BY ord LIMIT 300), s AS (SELECT * FROM l WHERE contains(upper(name), 'RE') OR contains(upper(path), 'RE')) SELECT path, name, size FROM {_FIRST.format(t='s')}")
def view_grid_chain(spark, sf_dir):
    return view.grid_view(_twice(spark, sf_dir), [F.col(c) for c in _ORDER], 300, "re").select("path", "name", "size")


@_query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY upper(url) ORDER BY page_id) AS f FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, upper(url) FROM pages)) WHERE f = 1")
def path_distinct_ci(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", "url")
    both = rows.unionByName(rows.select((F.col("page_id") + 1000000).alias("page_id"), F.upper("url").alias("url")))
    return view.path_distinct(both, [F.col("page_id")], "url")


@_query(f"WITH {_FILES} SELECT * FROM files ORDER BY path LIMIT 54 OFFSET 48")
def viewport_page(spark, sf_dir):
    return view.page(files(spark, sf_dir), [F.col("path")], 10, 5, 6)


@_query(f"WITH {_FILES} SELECT id, path, name, size FROM (SELECT *, row_number() OVER (ORDER BY path) AS r FROM files) WHERE r BETWEEN (SELECT min(r) FROM (SELECT id, row_number() OVER (ORDER BY path) AS r FROM files) WHERE id IN (150, 20)) AND (SELECT max(r) FROM (SELECT id, row_number() OVER (ORDER BY path) AS r FROM files) WHERE id IN (150, 20))")
def range_select(spark, sf_dir):
    return view.range_selected(files(spark, sf_dir), [("path", False)], "id", 150, 20)


_RANKED = _FILES + ", ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, path DESC) AS r FROM files)"


@_query(f"WITH {_RANKED} SELECT id, path, name, size FROM ranked WHERE r BETWEEN (SELECT min(r) FROM ranked WHERE id IN (150, 20)) AND (SELECT max(r) FROM ranked WHERE id IN (150, 20))")
def range_select_desc(spark, sf_dir):
    return view.range_selected(files(spark, sf_dir), [("size", True), ("path", True)], "id", 150, 20)


@_query(f"WITH {_FILES}, b AS (SELECT id, size * 1024 * id AS size FROM files) SELECT id, CAST(row_number() OVER (ORDER BY {_sql_size('size')} DESC, id) AS INTEGER) AS place FROM b")
def sort_size_text(spark, sf_dir):
    rows = view.sorted_by(files(spark, sf_dir).withColumn("size", F.col("size") * 1024 * F.col("id")), "size", True, True, ("id",))
    return rows.select("id", F.row_number().over(Window.orderBy(fmt.format_size(F.col("size")).desc(), "id")).alias("place"))


# -- similarity -------------------------------------------------------------------


@_query(f"WITH {_HASHES} SELECT id, hash FROM hashes")
def gradient_hash(spark, sf_dir):
    return hashes(spark, sf_dir)


@_query(f"WITH {_PAIRS} SELECT * FROM pairs")
def hamming_pairs(spark, sf_dir):
    return similar.hamming_pairs(hashes(spark, sf_dir))


@_query(f"WITH {_SSIM} SELECT i, j, hd, ssim FROM scored")
def ssim_pairs(spark, sf_dir):
    return scored(spark, sf_dir)


@_query(f"WITH {_SSIM} SELECT 'pair_' || CAST(row_number() OVER (ORDER BY ssim DESC, i, j) - 1 AS VARCHAR) AS group_id, i, j, ssim FROM scored ORDER BY ssim DESC, i, j LIMIT 20")
def closest_pairs_20(spark, sf_dir):
    return similar.closest_pairs(scored(spark, sf_dir, top=20))


@_query(f"WITH {_SSIM} SELECT i, j, ssim FROM scored ORDER BY ssim DESC, i, j LIMIT 50")
def score_top50(spark, sf_dir):
    return scored(spark, sf_dir, top=50).orderBy(F.desc("ssim"), "i", "j").limit(50).select("i", "j", "ssim")


@_query(f"WITH {_PAIRS} SELECT i, j, hd FROM pairs JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j WHERE NOT (a.label = b.label AND i % 3 = j % 3)")
def exclude_exact_pairs(spark, sf_dir):
    values = F.col("embedding")
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similar.gradient_hash(values).alias("hash"), F.col("label").alias("name"), (F.col("vec_id") % 3).alias("size"))
    return similar.unlike_pairs(rows)


@_query(f"{_COMPONENTS} SELECT id, component FROM comp")
def similar_components(spark, sf_dir):
    return similar.similar_components(scored(spark, sf_dir, bound=EDGE))


@_query(f"{_COMPONENTS} SELECT component, arg_min(ssim, (hd, i, j)) AS score FROM e JOIN comp ON comp.id = e.i GROUP BY component")
def component_scores(spark, sf_dir):
    edges = scored(spark, sf_dir, bound=EDGE)
    return similar.component_scores(edges, similar.similar_components(edges))


_GREEDY = "WITH RECURSIVE " + _SSIM + (
    ", e AS (SELECT i, j, hd, ssim, row_number() OVER (ORDER BY hd, i, j) AS k FROM scored WHERE ssim >= 0.3),"
    " g AS (SELECT CAST(0 AS BIGINT) AS k, MAP {CAST(-1 AS BIGINT): CAST(-1 AS BIGINT)} AS m, MAP {CAST(-1 AS BIGINT): CAST(0 AS DOUBLE)} AS s UNION ALL"
    " SELECT e.k, CASE WHEN g.m[e.i] IS NULL AND g.m[e.j] IS NULL THEN map_concat(g.m, MAP {e.i: e.i, e.j: e.i}) WHEN g.m[e.i] IS NULL THEN map_concat(g.m, MAP {e.i: g.m[e.j]})"
    " WHEN g.m[e.j] IS NULL THEN map_concat(g.m, MAP {e.j: g.m[e.i]}) ELSE g.m END,"
    " CASE WHEN g.m[e.i] IS NULL AND g.m[e.j] IS NULL THEN map_concat(g.s, MAP {e.i: e.ssim}) ELSE g.s END FROM g JOIN e ON e.k = g.k + 1),"
    " last AS (SELECT m, s FROM g ORDER BY k DESC LIMIT 1), u AS (SELECT unnest(map_keys(m)) AS id, unnest(map_values(m)) AS group_id, s FROM last)"
)


@_query(f"{_GREEDY} SELECT id, group_id, s[group_id] AS score FROM u WHERE id >= 0")
def similar_greedy(spark, sf_dir):
    return similar.greedy_groups(scored(spark, sf_dir, bound=EDGE))


_PIXELS = "px AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(least(255.0, greatest(0.0, floor(127.5 + 40 * x))) AS INTEGER)) AS q FROM embeddings)"
_IMAGE_RUN = "WITH RECURSIVE " + _PIXELS + (
    ", h AS (SELECT id, list_transform(q, lambda x: x / 255.0) AS v, CAST(list_sum(list_transform(range(1, 64), lambda k: CASE WHEN q[k] < q[k + 1] THEN CAST(1 AS BIGINT) << (k - 1) ELSE 0 END)) AS BIGINT)"
    " + CASE WHEN q[1] < q[2] THEN CAST(-9223372036854775808 AS BIGINT) ELSE 0 END AS hash FROM px),"
    " o AS (SELECT id, v, hash, list_sum(v) / 64 AS m, list_sum(list_transform(v, lambda x: x * x)) / 64 AS s FROM h),"
    " p AS (SELECT a.id AS i, b.id AS j, bit_count(xor(a.hash, b.hash)) AS hd, a.m AS ma, b.m AS mb, a.s AS sa, b.s AS sb, list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k])) / 64 - a.m * b.m AS c"
    " FROM o a JOIN o b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 25),"
    " e AS (SELECT i, j FROM p WHERE (2 * ma * mb + 1e-4) * (2 * c + 9e-4) / ((ma * ma + mb * mb + 1e-4) * ((sa - ma * ma) + (sb - mb * mb) + 9e-4)) >= 0.4),"
    " u AS (SELECT i AS a, j AS b FROM e UNION SELECT j, i FROM e), r AS (SELECT a AS id, a AS seen FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen),"
    " f AS (SELECT id, seen, lpad(CAST(seen AS VARCHAR), 8, '0') || '.png' AS name FROM r)"
)


def rendered_images(spark, sf_dir) -> str:
    """Every embedding as an image of 64 equal rows, a PNG below the shared folder; returns the folder."""
    root = fresh(spark, "png")
    q = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(127.5 + 40 * x.cast("double")).cast("double"))).cast("int"))
    rows = _table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("name"), q.alias("q"))
    rows.mapInArrow(write_gray_rows(root, 64), "file string").write.format("noop").mode("overwrite").save()
    return root


@_query(f"{_IMAGE_RUN} SELECT lpad(CAST(id AS VARCHAR), 8, '0') || '.png' AS image, min(name) AS group_name FROM f GROUP BY id")
def similar_images_run(spark, sf_dir):
    found = similar_images(spark, [rendered_images(spark, sf_dir)], bound=0.4)
    return found.select(paths.file_name(F.col("path")).alias("image"), paths.file_name(F.col("group_id")).alias("group_name"))


# -- policies ---------------------------------------------------------------------

_IMAGES = (
    "img AS (SELECT p_partkey AS id, p_brand AS grp, '/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, p_name || CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '.BMP' END AS name,"
    " CAST(p_size AS BIGINT) AS size, CAST(p_partkey % 7 + 1 AS INTEGER) AS width, CAST(p_partkey % 5 + 1 AS INTEGER) AS height FROM part),"
    " f AS (SELECT *, CAST(lower(regexp_extract(name, '[^.]*$')) NOT IN ('bmp', 'tiff', 'tif', 'png') AS INTEGER) + CAST(width * height < max(width * height) OVER w AS INTEGER) + CAST(size < max(size) OVER w AS INTEGER) AS failed,"
    " count(*) OVER w AS n, row_number() OVER (PARTITION BY grp ORDER BY path) AS r FROM img WINDOW w AS (PARTITION BY grp))"
)
_SAFE = _IMAGES + ", safe AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY grp ORDER BY failed, path) <> 1 AS selected FROM f)"
_ALL = policy.Keep(uncompressed=True, higher_resolution=True, larger=True)


def images(spark, sf_dir) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".BMP"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    path = F.concat_ws("/", F.lit(""), "p_brand", F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), path.alias("path"), F.concat("p_name", ext).alias("name"), F.col("p_size").cast("long").alias("size"),
        (F.col("p_partkey") % 7 + 1).cast("int").alias("width"), (F.col("p_partkey") % 5 + 1).cast("int").alias("height"),
    )


@_query(f"WITH {_IMAGES} SELECT id, grp, n > 1 AND NOT (r = 1 AND failed = 0) AS selected FROM f")
def auto_select_reference(spark, sf_dir):
    return policy.auto_select(images(spark, sf_dir), ["grp"], ["path"], _ALL).select("id", "grp", "selected")


@_query(f"WITH {_SAFE} SELECT id, grp, selected FROM safe")
def auto_select_safe(spark, sf_dir):
    return policy.auto_select(images(spark, sf_dir), ["grp"], ["path"], _ALL, "safe").select("id", "grp", "selected")


@_query(f"WITH {_SAFE} SELECT path, name, size FROM safe WHERE selected")
def deletion_plan(spark, sf_dir):
    return policy.deletion_plan(policy.auto_select(images(spark, sf_dir), ["grp"], ["path"], _ALL, "safe"))


@_query(f"WITH {_SAFE} SELECT count(*) FILTER (CASE WHEN grp = 'Brand#11' THEN NOT selected ELSE selected END) AS n_selected FROM safe")
def toggle_and_count(spark, sf_dir):
    chosen = policy.auto_select(images(spark, sf_dir), ["grp"], ["path"], _ALL, "safe")
    return policy.selected_count(policy.toggled(chosen, F.col("grp") == "Brand#11"))


_GONE = _MEMBERS + ", gone AS (SELECT path, size FROM members WHERE rank_in_group > 2)"


def _gone(spark, sf_dir) -> DataFrame:
    return dup_members(spark, sf_dir).filter("rank_in_group > 2")


@_query(f"WITH {_GONE} SELECT path, name, size FROM (SELECT path, name, size, count(*) OVER (PARTITION BY size, name) AS n FROM members WHERE path NOT IN (SELECT path FROM gone)) WHERE n > 1")
def after_delete_groups(spark, sf_dir):
    return policy.after_deletion(dup_members(spark, sf_dir).select("path", "name", "size"), _gone(spark, sf_dir), GROUP)


@_query(f"WITH {_GONE} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS saved, count(*) AS n_files FROM gone")
def saved_bytes(spark, sf_dir):
    return policy.saved_bytes(_gone(spark, sf_dir))


@_query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 30")
def recent_30(spark, sf_dir):
    return policy.recent(_table(spark, sf_dir, "events").select("event_id", "ts", "value"), "ts", "event_id")


@_query("SELECT event_id FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 <> 0)")
def restore_failures_stay(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("path"))
    tried = log.filter("event_id % 2 = 0").select("path", (F.col("event_id") % 3 != 0).alias("ok"), F.lit("missing").alias("error"))
    return policy.restored(log, tried).select("event_id")


@_query("SELECT event_id, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN 'second' END AS error FROM events WHERE NOT (event_id % 2 = 0 AND event_id % 3 <> 0) AND NOT (event_id % 5 = 0 AND event_id % 7 = 0)")
def restore_twice(spark, sf_dir):
    """Two restores after each other; in the second, paths have several results, of which one that is ok counts."""
    log = _table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("path"))
    first = log.filter("event_id % 2 = 0").select("path", (F.col("event_id") % 3 != 0).alias("ok"), F.lit("first").alias("error"))
    again = log.filter("event_id % 5 = 0 or event_id % 2 = 0")
    failed = again.select("path", F.lit(False).alias("ok"), F.lit("second").alias("error"))
    then = again.filter("event_id % 5 = 0").select("path", (F.col("event_id") % 7 == 0).alias("ok"), F.lit("third").alias("error"))
    return policy.restored(policy.restored(log, first), failed.unionByName(then)).select("event_id", "error")


@_query(f"WITH {_GONE}, bin AS (SELECT path, name FROM members WHERE rank_in_group > 2) SELECT f.path, f.name, g.path AS bin_path FROM bin f JOIN bin g ON upper(f.name) = upper(g.name)")
def restore_matches(spark, sf_dir):
    """The bin holds what a plan deleted, names in other case."""
    gone = _gone(spark, sf_dir)
    return policy.restore_matches(gone, gone.withColumn("name", F.upper("name")))


_LOGGED = "l AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS path, event_type AS name, CAST(event_id AS BIGINT) AS size, CAST(ts AS TIMESTAMP) AS deleted_at FROM events)"


@_query(f"WITH {_GONE}, {_LOGGED}, a AS (SELECT path, name, size, deleted_at FROM l UNION ALL SELECT path, name, size, TIMESTAMP '2024-01-15 00:00:00' FROM members WHERE rank_in_group > 2) SELECT path, name, size, epoch(deleted_at) AS deleted_at FROM a ORDER BY a.deleted_at DESC, path LIMIT 30")
def log_append(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("path"), F.col("event_type").alias("name"), F.col("event_id").cast("long").alias("size"), F.col("ts").cast("timestamp").alias("deleted_at"))
    return policy.logged(log, _gone(spark, sf_dir), F.to_timestamp(F.lit("2024-01-15 00:00:00"))).withColumn("deleted_at", F.unix_micros("deleted_at") / 1e6)


@_query(f"{_COMPONENTS}, s AS (SELECT id, component, lpad(CAST(id AS VARCHAR), 8, '0') AS path, CAST(id % 7 AS BIGINT) AS size FROM comp), t AS (SELECT *, max(size) OVER (PARTITION BY component) AS top FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY CAST(size < top AS INTEGER), path) AS r FROM t),"
    " left_ AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM k WHERE NOT (r > 1 AND id % 2 = 0)) SELECT path, component FROM left_ WHERE n > 1")
def after_delete_similar(spark, sf_dir):
    """Deletion inside groups of similar images: of those that a policy selects the even ids are deleted."""
    groups = similar.similar_components(scored(spark, sf_dir, bound=EDGE))
    rows = groups.select("id", "component", F.lpad(F.col("id").cast("string"), 8, "0").alias("path"), F.col("id").cast("string").alias("name"), (F.col("id") % 7).alias("size"))
    chosen = policy.auto_select(rows, ["component"], ["path"], policy.Keep(False, False, True), "safe")
    gone = policy.deletion_plan(policy.toggled(chosen, F.col("id") % 2 != 0, False))
    return policy.after_deletion(rows, gone, ["component"]).select("path", "component")
