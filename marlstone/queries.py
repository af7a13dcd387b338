"""The engine's operators on the driver's tables, and the same in DuckDB SQL.

Orders stand in for mentions: customer = target, priority = institution, status
= rating, price banded to 200,000 = target price.  Documents stand in for notes
and conversations for blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import report as R
from .functions.markup import highlight_terms, marker_count, report_link
from .functions.text import tidy
from .operators import analytics as A
from .operators import nodes as N
from .operators import reports as P
from .operators import search as S
from .plans import index as I
from .streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ORDER = ("o_orderkey",)
RATING = "CASE o_orderstatus WHEN 'F' THEN '买入' WHEN 'O' THEN '持有' ELSE '卖出' END"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.expr(RATING).alias("rating"),
        F.floor(F.col("o_totalprice") / 200000).cast("string").alias("price"), F.when(F.col("o_orderkey") % 7 == 0, "维持").alias("action"),
    )


_MENTIONS_SQL = f"""
m AS (SELECT o_orderkey, o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, {RATING} AS rating,
             CAST(CAST(floor(o_totalprice / 200000) AS BIGINT) AS VARCHAR) AS price,
             CASE WHEN o_orderkey % 7 = 0 THEN '维持' END AS action FROM orders)"""

_CHANGES_SQL = """
l AS (SELECT *, row_number() OVER w AS n, lag(rating) OVER w AS pr, lag(price) OVER w AS pp FROM {src}
      WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY day, o_orderkey)),
c AS (SELECT o_orderkey, o_custkey, o_orderpriority, day, pr AS previous_rating, rating AS current_rating,
             pp AS previous_target_price, price AS current_target_price,
             CASE WHEN action IS NOT NULL THEN action WHEN n = 1 THEN '首次覆盖' WHEN pp IS DISTINCT FROM price THEN '目标价变化' ELSE '评级变化' END AS change_type
      FROM l WHERE n = 1 OR pr IS DISTINCT FROM rating OR pp IS DISTINCT FROM price OR action IS NOT NULL)"""


def _changes(rows: DataFrame) -> DataFrame:
    return A.detect_changes(rows, "o_custkey", "o_orderpriority", "day", "rating", "price", "action", ORDER, keep=())


@query(f"WITH {_MENTIONS_SQL}, {_CHANGES_SQL.format(src='m')} SELECT * FROM c")
def detect_changes(spark, sf_dir):
    return _changes(_mentions(spark, sf_dir))


@query(f"WITH {_MENTIONS_SQL}, r AS (SELECT * FROM m WHERE day >= '1996-01-01' AND day <= '1998-12-31'), {_CHANGES_SQL.format(src='r')} SELECT * FROM c")
def changes_in_window(spark, sf_dir):
    rows = _mentions(spark, sf_dir)
    return _changes(rows.where(S.between_dates(F.col("day"), "1996-01-01", "1998-12-31")))


@query(f"WITH {_MENTIONS_SQL}, {_CHANGES_SQL.format(src='m')} SELECT change_type AS name, count(*) AS count FROM c GROUP BY 1")
def change_type_counts(spark, sf_dir):
    return A.count_by(_changes(_mentions(spark, sf_dir)), F.col("change_type"))


@query(f"WITH {_MENTIONS_SQL}, {_CHANGES_SQL.format(src='m')} SELECT * FROM c ORDER BY day DESC, o_custkey, o_orderpriority, o_orderkey LIMIT 60")
def radar_changes(spark, sf_dir):
    return _changes(_mentions(spark, sf_dir)).orderBy(*A.change_order("o_custkey", "o_orderpriority", "day", ORDER, named=F.col)).limit(60)


@query(f"""WITH {_MENTIONS_SQL}, {_CHANGES_SQL.format(src='m')}, t AS (SELECT * FROM c ORDER BY day DESC, o_custkey, o_orderpriority, o_orderkey LIMIT 60)
SELECT * FROM t WHERE contains(change_type, '目标价') ORDER BY day DESC, o_custkey, o_orderpriority, o_orderkey LIMIT 24""")
def radar_price_changes(spark, sf_dir):
    order = A.change_order("o_custkey", "o_orderpriority", "day", ORDER, named=F.col)
    cut = _changes(_mentions(spark, sf_dir)).orderBy(*order).limit(60)
    return cut.where(F.contains("change_type", F.lit("目标价"))).orderBy(*order).limit(24)


_LATEST_SQL = """
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY day DESC, o_orderkey DESC) AS k,
             min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first_key FROM m),
latest AS (SELECT * FROM f WHERE k = 1)"""


@query(f"WITH {_MENTIONS_SQL}, {_LATEST_SQL} SELECT o_custkey, o_orderpriority, o_orderkey, day, rating, price, action, first_key FROM latest")
def latest_per_key(spark, sf_dir):
    out = A.latest_per_key(_mentions(spark, sf_dir), "o_custkey", "o_orderpriority", "day", ORDER)
    return out.withColumn("first_key", F.col("first_seq.o_orderkey")).drop("first_seq")


def _nation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are nations, so a name holds several keys."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = _mentions(spark, sf_dir).join(c, "o_custkey").join(F.broadcast(n), "c_nationkey")
    return A.institution_matrix(rows, "o_custkey", "n_name", "o_orderpriority", "day", "rating", "price", ORDER)


_MATRIX_SQL = f"""WITH {_MENTIONS_SQL}, {_LATEST_SQL},
named AS (SELECT l.*, n_name FROM latest l JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT n_name, count(*) AS n_items, min(first_key) AS row_key, count(DISTINCT rating) AS n_ratings, count(DISTINCT price) AS n_prices FROM named GROUP BY 1)"""


@query(_MATRIX_SQL + """ SELECT n_name, o_custkey, o_orderpriority, o_orderkey, day, rating, price, n_items, n_ratings, n_prices, row_key,
n_items > 1 AND (n_ratings > 1 OR n_prices > 1) AS diverges FROM named JOIN g USING (n_name)""")
def institution_matrix(spark, sf_dir):
    m = _nation_matrix(spark, sf_dir).withColumn("row_key", F.col("row_seq.o_orderkey"))
    return m.select("n_name", "o_custkey", "o_orderpriority", "o_orderkey", "day", "rating", "price", "n_items", "n_ratings", "n_prices", "row_key", "diverges")


@query(_MATRIX_SQL + " SELECT n_name, n_items, n_ratings, n_prices FROM g WHERE n_items > 1 AND (n_ratings > 1 OR n_prices > 1) ORDER BY n_items DESC, row_key LIMIT 30")
def divergence(spark, sf_dir):
    return A.diverging_names(_nation_matrix(spark, sf_dir), "n_name").drop("row_seq")


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS name, count(*) AS count FROM orders GROUP BY 1")
def count_by_year(spark, sf_dir):
    return A.count_by(_table(spark, sf_dir, "orders"), F.year("o_orderdate").cast("string"))


@query("SELECT o_orderpriority AS name, count(*) AS count FROM orders GROUP BY 1")
def coverage(spark, sf_dir):
    return A.count_by(_table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def target_coverage(spark, sf_dir):
    return A.count_by(_table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"), 30)


@query("SELECT tag AS name, count(*) AS count FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tag FROM part) WHERE tag <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def themes(spark, sf_dir):
    tags = _table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ", -1)).alias("tag"))
    return A.count_by(tags, F.col("tag"), 30)


_BEFORE, _AFTER = "c_custkey % 10 <> 0", "c_custkey % 10 <> 1"
_CHANGED = "CASE WHEN c_custkey % 10 = 2 THEN c_acctbal + 1 ELSE c_acctbal END"


@query(f"""WITH b AS (SELECT c_custkey, c_acctbal AS v FROM customer WHERE {_BEFORE}), a AS (SELECT c_custkey, {_CHANGED} AS v FROM customer WHERE {_AFTER})
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
b.v AS previous, a.v AS next FROM b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE a.v IS DISTINCT FROM b.v""")
def diff_reports(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    before, after = c.where(_BEFORE).select("c_custkey", F.col("c_acctbal").alias("v")), c.where(_AFTER).select("c_custkey", F.expr(_CHANGED).alias("v"))
    return A.diff_snapshots(before, after, "c_custkey", "v")


@query(f"""WITH {_MENTIONS_SQL} SELECT o_orderkey, day, rating FROM m JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND rating = '买入' ORDER BY day DESC, o_orderkey DESC LIMIT 500""")
def rating_search(spark, sf_dir):
    kept = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = _mentions(spark, sf_dir).where(R.rating_matches(F.col("rating"), R.parse_rating_query("buy"))).join(kept, "o_custkey", "left_semi")
    return rows.orderBy(F.desc("day"), F.desc("o_orderkey")).limit(500).select("o_orderkey", "day", "rating")


# A watch list.
WATCH = [("w1", "green", ["green", "blue"]), ("w2", "almond", ["almond"]), ("w3", "nothing", ["no such name"])]
_WATCH_SQL = """w AS (SELECT * FROM (VALUES ('w1', 'green', 'green'), ('w1', 'green', 'blue'), ('w2', 'almond', 'almond'), ('w3', 'nothing', 'no such name')) t(watch_id, name, alias)),
hit AS (SELECT DISTINCT watch_id, p_partkey, p_size FROM part, w WHERE contains(lower(p_name), alias))"""


@query(f"""WITH {_WATCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY p_size DESC, p_partkey) AS k, count(*) OVER (PARTITION BY watch_id) AS n FROM hit)
SELECT i.watch_id, i.name, coalesce(n, 0) AS mention_count, p_size AS latest_p_size_1, p_partkey AS latest_p_partkey
FROM (SELECT DISTINCT watch_id, name FROM w) i LEFT JOIN r ON r.watch_id = i.watch_id AND k = 1""")
def watchlist_view(spark, sf_dir):
    watch = spark.createDataFrame(WATCH, "watch_id string, name string, norm_aliases array<string>")
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array(F.lower("p_name")).alias("fields"))
    met = A.match_watchlist(rows, F.col("fields"), watch, ("p_partkey",))
    out = A.watch_summary(met, watch, "p_size", ("p_partkey",), ("p_partkey",))
    return out.withColumnRenamed("latest_date", "latest_p_size_1")


# documents as notes: one line each, source as institution

_LINES_SQL = r"""raw AS (SELECT doc_id, source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM raw),
norm AS (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS norm_line FROM lines)"""
_NEAR_SQL = r"""near AS (SELECT *, trim(regexp_replace(concat_ws(' ', nullif(trim(lag(line) OVER w, chr(9) || ' '), ''), nullif(trim(line, chr(9) || ' '), ''), nullif(trim(lead(line) OVER w, chr(9) || ' '), '')), '^$', ''))[:520] AS snippet
FROM norm WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    # the source travels in the id, so no second read of the notes is needed
    named = F.concat_ws("\t", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("file_path"), named.alias("report_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("date"), F.col("text").alias("markdown"))


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.build_lines(_notes(spark, sf_dir)).withColumns({"institution": F.nullif(F.substring_index("report_id", "\t", 1), F.lit("")), "report_id": F.col("file_path")})


@query(f"""WITH {_LINES_SQL}, {_NEAR_SQL} SELECT doc_id AS report_id, source AS institution, line_no AS line_number, snippet, 'The  W' AS matched_text
FROM near WHERE contains(norm_line, 'the w') ORDER BY doc_id DESC, line_no LIMIT 500""")
def exact_search(spark, sf_dir):
    found = S.search_notes(_notes(spark, sf_dir), "The  W", institution=F.nullif(F.substring_index("report_id", "\t", 1), F.lit("")))
    return found.withColumns({"report_id": F.substring_index("report_id", "\t", -1).cast("bigint"), "line_number": F.col("line_number").cast("bigint")}).drop("date")


@query(f"""WITH {_LINES_SQL}, {_NEAR_SQL} SELECT doc_id AS report_id, source AS institution, line_no AS line_number, snippet, 'the' AS matched_text
FROM near WHERE contains(norm_line, 'the') AND regexp_matches(snippet, '(?i)目标价|tp|pt|target price|港元|美元|人民币|新台币') ORDER BY doc_id DESC, line_no LIMIT 500""")
def search_mode(spark, sf_dir):
    return S.search_lines(_doc_lines(spark, sf_dir), "the", "target").drop("date").withColumn("line_number", F.col("line_number").cast("bigint"))


@query(rf"WITH {_LINES_SQL} SELECT doc_id, count(*) AS n_lines, CAST(sum(length(norm_line)) AS BIGINT) AS n_chars FROM norm GROUP BY 1")
def normalize_text(spark, sf_dir):
    return _doc_lines(spark, sf_dir).groupBy(F.col("file_path").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.length("norm_line")).cast("bigint").alias("n_chars"))


@query("""WITH k AS (SELECT CASE WHEN contains(l, 'catalyst') THEN 'catalyst' WHEN contains(l, 'risk') THEN 'risk' WHEN contains(l, 'valuation') THEN 'valuation' ELSE NULL END AS type
FROM (SELECT lower(event_type || ' ' || coalesce(props, '') || CASE event_id % 4 WHEN 0 THEN ' Catalyst' WHEN 1 THEN ' RISK risk' WHEN 2 THEN ' valuation' ELSE '' END) AS l FROM events))
SELECT type AS name, count(*) AS count FROM k WHERE type IS NOT NULL GROUP BY 1""")
def signals_by_type(spark, sf_dir):
    said = F.expr("event_type || ' ' || coalesce(props, '') || CASE event_id % 4 WHEN 0 THEN ' Catalyst' WHEN 1 THEN ' RISK risk' WHEN 2 THEN ' valuation' ELSE '' END")
    return A.count_by(_table(spark, sf_dir, "events").select(R.signal_type(tidy(said)).alias("t")), F.col("t"))


@query("SELECT min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS first_mention, max(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS latest_mention, max_by(event_type, (ts, event_id)) AS latest_rating FROM events")
def first_last_mention(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"), F.lit("").alias("file_path"), F.col("event_id").alias("line_number"), F.lit(0).alias("match_no"),
        F.col("event_type").alias("rating"), F.lit(None).cast("string").alias("target_price"), F.lit("").alias("excerpt"),
    )
    return I.profile_summary(e).select("first_mention", "latest_mention", "latest_rating")


@query(f"""WITH {_MENTIONS_SQL}, s AS (SELECT o_custkey, count(*) FILTER (rating IN ('买入')) AS positive, count(*) FILTER (rating IN ('卖出')) AS negative FROM m GROUP BY 1)
SELECT *, CASE WHEN positive >= negative THEN '偏积极或建设性' ELSE '风险提示较多' END AS hint FROM s""")
def sentiment(spark, sf_dir):
    good, bad = R.sentiment_counts(F.col("rating"))
    out = _mentions(spark, sf_dir).groupBy("o_custkey").agg(good.alias("positive"), bad.alias("negative"))
    return out.withColumn("hint", R.sentiment_hint(F.col("positive"), F.col("negative")))


@query(f"WITH {_MENTIONS_SQL} SELECT rating AS name, count(*) AS count FROM m GROUP BY 1")
def rating_distribution(spark, sf_dir):
    return A.count_by(_mentions(spark, sf_dir), F.col("rating"))


@query(r"""SELECT page_id, '/reports?id=' || regexp_replace(url, '[^A-Za-z0-9]', '', 'g') || '&line=' || (page_id + 1) AS link FROM pages""")
def report_links(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", report_link(F.regexp_replace("url", "[^A-Za-z0-9]", ""), F.col("page_id") + 1).alias("link"))


@query(r"SELECT doc_id, regexp_replace(text, '(and the|the)', '[[\1]]', 'gi') AS marked, CAST(len(string_split(text, '==')) - 1 AS INTEGER) AS markers FROM documents")
def highlight(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", highlight_terms(F.col("text"), ["the", "and the"]).alias("marked"), marker_count(F.col("text")).alias("markers"))


@query("""SELECT o_orderkey, CASE WHEN regexp_matches(v, '[,"\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ', "x"' WHEN 1 THEN NULL ELSE o_orderpriority END AS w, coalesce(w, '') AS v FROM orders)""")
def csv_cells(spark, sf_dir):
    from .sources.export import csv_cell

    v = F.expr("CASE pmod(o_orderkey, 3) WHEN 0 THEN o_orderpriority || ', \"x\"' WHEN 1 THEN NULL ELSE o_orderpriority END")
    return _table(spark, sf_dir, "orders").select("o_orderkey", csv_cell(v).alias("cell"))


# notes rendered from orders and parsed back: what is found must be what was written

_RENDER = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per order day, one block per nation, one target per order."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    code: Column = F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    action = F.when(F.col("o_orderkey") % 5 == 0, "维持").otherwise("给予")
    body = F.concat(
        F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" ("), code, F.lit(".HK)\n"), action, F.lit("“"), F.expr(RATING), F.lit("”评级，目标价 "),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("港元。\n主要风险：需求。"),
    )
    # a day's orders meet once, so its blocks are not shuffled again
    rows = rows.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "n_name", "o_orderkey", body.alias("body")).repartition("day")
    blocks = rows.groupBy("day", "n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "body"))), lambda x: x["body"]), "\n").alias("b"))
    blocks = blocks.select("day", "n_name", F.concat(F.lit("# "), "n_name", F.lit("\n"), "b", F.lit("\n#"), "n_name", F.lit(" #notes\n")).alias("block"))
    notes = blocks.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", "block"))), lambda x: x["block"]), "\n").alias("markdown"))
    return notes.select(F.concat(F.lit("/notes/"), "day", F.lit(".md")).alias("file_path"), "markdown", F.lit(None).cast("timestamp").alias("updated_at"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes' lines, written once: what is asked of them reads them several times."""
    lines, path = P.build_lines(P.build_reports(_rendered(spark, sf_dir), "/notes")), f"{_shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, n_name AS institution, 'Order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS target_name,
lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.HK' AS code, {RATING} AS rating, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || '港元' AS target_price,
CASE WHEN o_orderkey % 5 = 0 THEN '维持' END AS action FROM {_RENDER}""")
def extract_mentions(spark, sf_dir):
    return P.extract_mentions(_parsed(spark, sf_dir)).select("date", "institution", "target_name", "code", "rating", "target_price", "action")


@query(f"SELECT n_name AS institution, 'risk' AS type, '主要风险：需求。' AS title, count(*) AS count FROM {_RENDER} GROUP BY 1")
def extract_signals(spark, sf_dir):
    lines = _parsed(spark, sf_dir)
    return P.extract_signals(P.extract_mentions(lines), lines).groupBy("institution", "type", "title").agg(F.count("*").alias("count"))


@query(f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, n_name AS institution, 3 * count(*) + 3 AS n_lines, n_name || '|notes' AS tags FROM {_RENDER} GROUP BY 1, 2""")
def extract_blocks(spark, sf_dir):
    blocks = P.build_blocks(_parsed(spark, sf_dir))
    return blocks.select("date", "institution", (F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("n_lines"), F.array_join("tags", "|").alias("tags"))


# the rendered notes built into a stored index, and the questions asked of it


def _index(spark: SparkSession, sf_dir: str) -> I.Index:
    """An index of all rendered notes in the shared folder, built once for each session and state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = I.build(spark, _rendered(spark, sf_dir), "/notes", f"{_shared_dir(spark)}/index-{uuid.uuid4().hex}").path
    return I.Index(spark, _BUILT[key])


def _shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or spark._jvm.System.getProperty("java.io.tmpdir")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the tables that the notes are rendered from."""
    def of(name: str) -> tuple[int, int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return store.getContentSummary(path).getLength(), store.getFileStatus(path).getModificationTime()

    return tuple(map(of, ("orders", "customer", "nation")))


_BUILT: dict[tuple, str] = {}
_NOTES = f"""o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, n_name AS institution, 'Order ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS target_name,
lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '.HK' AS code, o_custkey, o_orderkey, {RATING} AS rating, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) || '港元' AS target_price,
CASE WHEN o_orderkey % 5 = 0 THEN '维持' END AS action FROM {_RENDER}),
p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY institution, o_orderkey) AS k, dense_rank() OVER (PARTITION BY date ORDER BY institution) AS b FROM o),
m AS (SELECT *, CAST(3 * k + 3 * b - 4 AS BIGINT) AS line_number FROM p)"""


@query(f"WITH {_NOTES} SELECT count(DISTINCT date) AS report_count, count(*) AS mention_count, count(DISTINCT code) AS target_count FROM m")
def summary(spark, sf_dir):
    said = _index(spark, sf_dir).summary()
    return spark.createDataFrame([tuple(said[k] for k in ("report_count", "mention_count", "target_count"))], "report_count bigint, mention_count bigint, target_count bigint")


@query(f"WITH {_NOTES} SELECT institution AS name, count(*) AS count FROM (SELECT DISTINCT date, institution FROM m) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 18")
def summary_institutions(spark, sf_dir):
    return _index(spark, sf_dir).summary()["institutions"]


@query(f"WITH {_NOTES} SELECT '/notes/' || date || '.md' AS file_path, count(*) AS target_count, array_to_string(list_sort(list(DISTINCT institution)), '|') AS institutions FROM m GROUP BY date ORDER BY date DESC LIMIT 8")
def summary_reports(spark, sf_dir):
    return _index(spark, sf_dir).summary()["latest_reports"].select("file_path", "target_count", F.array_join("institutions", "|").alias("institutions"))


@query(f"""WITH {_NOTES} SELECT date, institution, target_name, CAST(line_number + 2 AS INTEGER) AS line_number FROM m WHERE date <= '1999-12-31' ORDER BY date DESC, line_number DESC LIMIT 24""")
def radar_risks(spark, sf_dir):
    return _index(spark, sf_dir).radar(end="1999-12-31")["risks"].select("date", "institution", "target_name", "line_number")


@query(f"""WITH {_NOTES}, n AS (SELECT * FROM m WHERE (contains(code, '00001') OR contains(target_name, '00001')) ORDER BY date DESC, line_number DESC LIMIT 1000)
SELECT institution, count(*) AS mentions, min(date) AS first_mention, max(date) AS latest_mention FROM n GROUP BY 1""")
def profile_sets(spark, sf_dir):
    """The working set of a target's profile, by institution."""
    found = _index(spark, sf_dir).profile("00001")
    rows = found["mentions"].groupBy("institution").agg(F.count("*").alias("mentions"), F.min("date").alias("first_mention"), F.max("date").alias("latest_mention"))
    return rows.join(found["institutions"], "institution", "left_semi")


@query(f"""WITH {_NOTES} SELECT target_name, date, target_price FROM m WHERE (contains(code, '00001') OR contains(target_name, '00001')) ORDER BY date DESC, line_number DESC LIMIT 1000""")
def profile_prices(spark, sf_dir):
    return _index(spark, sf_dir).profile("00001")["mentions"].select("target_name", "date", "target_price")


@query(f"""WITH {_NOTES}, t AS (SELECT date, institution, rating, row_number() OVER (PARTITION BY code, institution ORDER BY date DESC, line_number DESC) AS n, code FROM m)
SELECT code, institution, date, rating FROM t WHERE n = 1""")
def latest_per_institution(spark, sf_dir):
    return _index(spark, sf_dir).institutions()["matrix"].select("code", "institution", "date", "rating")


@query(f"WITH {_NOTES} SELECT date, institution, CAST(min(line_number) - 1 AS INTEGER) AS start_line, institution || '|notes' AS tags FROM m WHERE date >= '1995-03' AND date <= '1996-04' GROUP BY 1, 2")
def institution_blocks(spark, sf_dir):
    blocks = _index(spark, sf_dir).blocks
    return blocks.where(S.in_period("1995-03", "1996-04")).select("date", "institution", "start_line", F.array_join("tags", "|").alias("tags"))


@query(f"""WITH {_NOTES}, h AS (SELECT * FROM m WHERE rating = '买入' AND date >= '1995-02' AND date IN (SELECT date FROM m WHERE institution = 'NATION_3')
ORDER BY date DESC, line_number DESC LIMIT 500) SELECT date, institution, target_name, CAST(line_number AS INTEGER) AS line_number FROM h""")
def index_rating_search(spark, sf_dir):
    """Ratings in the reports in which the institution has a block, its own and others'."""
    hits = _index(spark, sf_dir).search("买入评级", start="1995-02", institution="NATION_3")
    return hits.select("date", "institution", F.substring_index("snippet", "｜", 1).alias("target_name"), "line_number")


@query(f"""WITH {_NOTES} SELECT date, institution, CAST(line_number AS INTEGER) AS line_number FROM m
WHERE contains(lower(target_name || ' (' || code || ')'), '12 (0001') ORDER BY date DESC, line_number LIMIT 500""")
def index_text_search(spark, sf_dir):
    """A substring, by the positional index of character pairs."""
    return _index(spark, sf_dir).with_text_index().search("12 (0001").select("date", "institution", "line_number")


@query(f"WITH {_NOTES} SELECT institution AS name, count(*) AS count FROM m GROUP BY 1")
def index_coverage(spark, sf_dir):
    """Mentions of each institution, from the counts kept with the index."""
    return _index(spark, sf_dir).institutions()["coverage"]


@query(f"WITH {_NOTES} SELECT left(date, 4) AS name, count(DISTINCT date) AS count FROM m GROUP BY 1")
def index_years(spark, sf_dir):
    return _index(spark, sf_dir).summary()["years"]


@query(f"WITH {_NOTES} SELECT date, institution, CAST(line_number AS INTEGER) AS line_number FROM m WHERE date >= '1995-02' ORDER BY date DESC, line_number LIMIT 500")
def index_newest_hits(spark, sf_dir):
    """A word of every target's line: the cap is filled from the newest years."""
    return _index(spark, sf_dir).search("order ", start="1995-02").select("date", "institution", "line_number")


@query(f"""WITH {_NOTES}, b AS (SELECT date, institution, min(line_number) - 1 AS head, count(*) AS targets FROM m GROUP BY 1, 2)
SELECT date, CAST(line AS INTEGER) AS line_no, CAST(node AS BIGINT) AS node FROM (
SELECT date, head AS line, row_number() OVER (PARTITION BY date ORDER BY head) * 2 - 1 AS node FROM b
UNION ALL SELECT date, head + 1, row_number() OVER (PARTITION BY date ORDER BY head) * 2 FROM b)""")
def markdown_nodes(spark, sf_dir):
    """The Markdown block that shows each institution's heading and the line below it."""
    lines = _index(spark, sf_dir).lines
    shown = lines.where("line_no = block_start OR line_no = block_start + 1").select("file_path", "date", "line_no")
    return N.line_nodes(shown, N.markdown_nodes(lines)).select("date", "line_no", F.col("node").cast("bigint").alias("node"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders),
j AS (SELECT l.o_orderkey AS asked, l.s + 20 AS line, n.o_orderkey AS node, n.s, n.s + n.o_orderkey % 40 AS e FROM n l JOIN n USING (o_custkey) WHERE n.s <= l.s + 20),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY line > e, CASE WHEN line > e THEN -s ELSE s END, node) AS k FROM j)
SELECT asked, CAST(line AS BIGINT) AS line, node FROM r WHERE k = 1""")
def line_nodes(spark, sf_dir):
    """Orders as overlapping intervals of days: the one that holds a day of their customer, else the last before it."""
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("bigint")
    held = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("s"))
    nodes = held.select("o_custkey", F.col("o_orderkey").alias("node"), "s", (F.col("s") + F.col("o_orderkey") % 40).alias("e"))
    asked = held.select("o_custkey", F.col("o_orderkey").alias("asked"), (F.col("s") + 20).alias("line"))
    return N.line_nodes(asked, nodes, "o_custkey", "line", "s", "e").drop("o_custkey")


_PATTERNS_SQL = "a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS watch_id, CAST(c_custkey AS VARCHAR) || ' ' AS alias FROM customer)"


@query(f"""WITH {_PATTERNS_SQL}, h AS (SELECT DISTINCT watch_id, o_orderkey FROM orders JOIN a ON contains(CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_custkey AS VARCHAR) || ' ', alias))
SELECT watch_id, count(*) AS mention_count FROM h GROUP BY 1""")
def watchlist_many(spark, sf_dir):
    """A watch list of all customers, compiled into one automaton."""
    watch = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("watch_id"), F.array(F.concat(F.col("c_custkey").cast("string"), F.lit(" "))).alias("norm_aliases")).distinct()
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit(""))).alias("fields"))
    return A.match_watchlist(rows, F.col("fields"), watch, ("o_orderkey",)).groupBy("watch_id").agg(F.count("*").alias("mention_count"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2, 3")
def windows_tumbling(spark, sf_dir):
    return W.tumbling(_table(spark, sf_dir, "events"), "6 hours", by=("event_type",), measures={"users": F.count_distinct("user_id")})


@query("""SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS events
FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS s FROM events, range(4) r(k)) GROUP BY 1, 2, 3""")
def windows_sliding(spark, sf_dir):
    return W.sliding(_table(spark, sf_dir, "events"), "2 hours", "30 minutes", by=("event_type",))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 4 HOUR, true) AS new FROM events),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, user_id, count(*) AS events FROM s GROUP BY user_id, n""")
def windows_sessions(spark, sf_dir):
    return W.sessions(_table(spark, sf_dir, "events"), "4 hours", by=("user_id",))


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 200000) AS BIGINT) AS price FROM orders),
w AS (SELECT *, CAST(price <> lag(price) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY day, price) AS BIGINT) AS other FROM v)
SELECT o_orderkey, count(price) OVER k AS views, min(price) OVER k AS least, max(price) OVER k AS greatest, CAST(sum(price) OVER k AS BIGINT) AS total,
count(DISTINCT o_orderpriority) OVER k AS voices, CAST(coalesce(sum(other) OVER p, 0) AS BIGINT) AS revisions FROM w
WINDOW k AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW),
p AS (PARTITION BY o_custkey, o_orderpriority ORDER BY day RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)""")
def trailing_consensus(spark, sf_dir):
    views = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 200000).alias("price"))
    out = A.trailing_consensus(views, F.col("day"), "o_custkey", "o_orderpriority", "price", 90)
    return out.select("o_orderkey", "views", "least", "greatest", "total", "voices", "revisions")
