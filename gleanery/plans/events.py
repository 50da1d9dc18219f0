"""Queries of the event log: errors are issues, purchases dispositions, sign-ups declines; user and bucket of k are the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import events as E
from gleanery.operators import topics
from gleanery.plans.registry import query
from gleanery.session import shared_dir
from gleanery.sources.tables import latest, table

NOW = "2024-07-05 12:00:00"
KEYS = ["user_id", "kind"]

_LOG = """log AS (SELECT event_id AS seq, ts, user_id, CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) % 4 AS kind, value,
  event_type = 'error' AS is_issue, event_type = 'purchase' AS is_disposition, CASE WHEN value > 20 THEN 'large' END AS note FROM events),
closed AS (SELECT user_id, kind, max(seq) AS c FROM log WHERE is_disposition GROUP BY ALL),
since AS (SELECT l.* FROM log l LEFT JOIN closed USING (user_id, kind) WHERE is_issue AND (c IS NULL OR seq > c))"""


def log(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value", "props"))


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("event_id").alias("seq"), "ts", "user_id", (F.get_json_object("props", "$.k").cast("int") % 4).alias("kind"), "value",
        (F.col("event_type") == "error").alias("is_issue"), (F.col("event_type") == "purchase").alias("is_disposition"), F.when(F.col("value") > 20, "large").alias("note"),
    )


@query(
    f"""WITH {_LOG} SELECT user_id, kind, arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen, count(*) AS occurrences, arg_max(value, seq) AS value,
  arg_max(note, seq) FILTER (WHERE note IS NOT NULL) AS note FROM since GROUP BY ALL"""
)
def ev_open_issues(spark: SparkSession, d: str) -> DataFrame:
    return E.open_issues(log(spark, d), KEYS, "ts", ["value"], ["note"])


@query(f"WITH {_LOG} SELECT user_id, kind FROM log WHERE is_issue OR is_disposition GROUP BY ALL HAVING arg_max(is_disposition, seq)")
def ev_settled(spark: SparkSession, d: str) -> DataFrame:
    return E.settled(log(spark, d), KEYS)


@query(f"WITH {_LOG} SELECT user_id, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(ts, seq) AS ts FROM log WHERE is_disposition AND kind IN (0, 1) GROUP BY user_id")
def ev_latest_disposition(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_disposition(log(spark, d).filter("kind in (0, 1)"), ["user_id"], ["value", "ts"])


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup' AND date_diff('day', CAST(ts AS DATE), DATE '2024-07-05') <= 180")
def ev_decline_ttl(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "ts", "event_type").filter("event_type = 'signup'").select("event_id", F.to_date("ts").alias("day"))
    return E.unexpired(rows, "day", "2024-07-05")


@query(
    f"""WITH s AS (SELECT event_id, CAST(ceil(((epoch_us(ts) - epoch_us(TIMESTAMP '{NOW}')) / 1e6 + 15552000.0) / 86400.0) AS BIGINT) AS days_left FROM events WHERE event_type = 'signup')
SELECT * FROM s WHERE days_left BETWEEN 0 AND 30"""
)
def ev_nearing_expiry(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "ts", "event_type").filter("event_type = 'signup'").select("event_id", "ts")
    return E.nearing_expiry(rows, "ts", NOW).select("event_id", "days_left")


@query(
    f"""WITH {_LOG}, open AS (SELECT DISTINCT user_id, kind FROM since), settled AS (SELECT user_id, kind FROM log WHERE is_issue OR is_disposition GROUP BY ALL HAVING arg_max(is_disposition, seq))
SELECT DISTINCT user_id, kind FROM log l WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.user_id = l.user_id AND o.kind = l.kind)
  AND NOT EXISTS (SELECT 1 FROM settled s WHERE s.user_id = l.user_id AND s.kind = l.kind)"""
)
def ev_unsettled_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return E.without_settled(rows.select(*KEYS).distinct(), E.open_issues(rows, KEYS, "ts", [], []), E.settled(rows, KEYS), KEYS)


@query(f"WITH {_LOG} SELECT user_id, kind, arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen, count(*) AS occurrences FROM since GROUP BY ALL")
def st_open_issues_stream(spark: SparkSession, d: str) -> DataFrame:
    """The open issues kept by the stream, after all events were read."""
    import uuid

    from gleanery.streaming import issues

    folder = f"{shared_dir(spark)}/issues-{uuid.uuid4().hex}"
    source = spark.read.parquet(f"{d}/events.parquet")
    name = "events.parquet"
    stream = _parsed(spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name[:-8]}*"))
    issues.run(stream, KEYS, "ts", folder)
    last = _last_state(folder, spark)
    return spark.read.parquet(last).filter("occurrences > 0").select(*KEYS, "first_seen", "last_seen", "occurrences")


def _last_state(folder: str, spark: SparkSession) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [f.getPath().getName() for f in found]
    return f"{folder}/state-{max(int(n[6:]) for n in names if n.startswith('state-'))}"


_TOPIC = r"nullif(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '')"


@query(
    f"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) AS nth FROM wiki_pages) WHERE nth = 1),
t AS (SELECT lower({_TOPIC.replace('{0}', 'topic')}) AS k, arg_min({_TOPIC.replace('{0}', 'topic')}, path) AS label, count(*) AS n FROM p GROUP BY 1)
SELECT coalesce(k, '') AS topic_key, coalesce(label, 'Unattributed') AS label, n, CAST(row_number() OVER (ORDER BY k IS NULL, n DESC, k) AS INTEGER) AS place FROM t"""
)
def ev_topic_groups(spark: SparkSession, d: str) -> DataFrame:
    return topics.topic_groups(latest(table(spark, d, "wiki_pages", "page_id", "path", "topic", "loaded_at"), "page_id"), "topic", "path")


_URL_KEY = r"lower(CASE WHEN regexp_extract(trim({0}), 'U', 2) = '' THEN {0} ELSE {1} END)"


def _attribution_sql() -> str:
    from gleanery.plans.text import sql_url

    topic = _TOPIC.replace("{0}", "topic")
    return f"""WITH c AS (SELECT DISTINCT path, source, topic FROM clippings), kt AS (SELECT path, source, {topic} AS topic FROM c WHERE {topic} IS NOT NULL),
byu AS (SELECT lower({sql_url('source')}) AS k, arg_max(topic, path) AS t FROM kt WHERE source IS NOT NULL GROUP BY 1),
byp AS (SELECT lower(trim(path)) AS k, arg_max(topic, path) AS t FROM kt GROUP BY 1),
i AS (SELECT DISTINCT e.from_path AS path, e.topic, (SELECT min(source) FROM c WHERE c.path = e.from_path) AS url FROM purge_entries e)
SELECT i.path, i.topic, i.url, coalesce({topic.replace('topic', 'i.topic')}, byu.t, byp.t) AS attributed FROM i LEFT JOIN byu ON byu.k = lower({sql_url('i.url')}) LEFT JOIN byp ON byp.k = lower(trim(i.path))"""


@query(_attribution_sql())
def ev_topic_attribution(spark: SparkSession, d: str) -> DataFrame:
    clips = table(spark, d, "clippings", "path", "source", "topic").distinct()
    urls = clips.groupBy("path").agg(F.min("source").alias("url"))
    items = table(spark, d, "purge_entries", F.col("from_path").alias("path"), "topic").distinct().join(urls, "path", "left")
    return topics.attribute(items, clips).select("path", "topic", "url", "attributed")
