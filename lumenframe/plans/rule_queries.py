"""Queries of the model, rule, queue, catalog and graph operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import names as N
from lumenframe.functions.numeric import micro
from lumenframe.operators import jobs as J
from lumenframe.operators import models as O
from lumenframe.plans import sql as Q
from lumenframe.plans.registry import query
from lumenframe.sources import bindings as B

c = F.col
KEY = ["l_orderkey", "l_linenumber"]
K = "l_orderkey, l_linenumber"


# --- rules ------------------------------------------------------------------


@query("SELECT page_id, page_id % 7 = 0 OR page_id % 7 = 6 AS ok FROM pages")
def f10_manifest_guard(spark, sf_dir):
    """Manifests of which six in seven lack something: a size, a digest, all parts, a part's digest, the input's width; the last has only optional fields missing."""
    part = F.struct(F.lit("a").alias("file"), c("page_id").alias("size"), F.when(c("k") != 4, "y").alias("sha256"))
    m = F.struct(
        c("name").alias("id"),
        F.when(c("k") != 1, c("page_id")).alias("size"),
        F.when(c("k") != 2, "x").alias("sha256"),
        F.when(c("k") == 3, F.array().cast("array<struct<file:string,size:bigint,sha256:string>>")).otherwise(F.array(part)).alias("parts"),
        F.struct(F.lit("i").alias("name"), F.when(c("k") != 5, 4).alias("width"), F.lit(4).alias("height")).alias("input"),
        F.struct(F.lit("o").alias("name")).alias("output"),
    )
    text = B.files(spark, sf_dir).withColumn("k", c("page_id") % 7).select("page_id", F.to_json(m).alias("text"))
    return text.select("page_id", O.valid_manifest(F.from_json("text", O.MANIFEST)).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'a' WHEN event_id % 3 = 1 THEN 'b' WHEN event_id % 5 = 1 THEN 'c' END AS missing FROM events")
def f17_missing_capability(spark, sf_dir):
    has = {"a": c("job") % 2 != 1, "b": F.when(c("job") % 3 != 1, True), "c": c("job") % 5 != 1}
    return B.jobs(spark, sf_dir).select(c("job").alias("event_id"), O.missing_capability(has).alias("missing"))


_AGENT = "CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 (iPad; CPU OS)' WHEN 1 THEN 'Mozilla/5.0 (Linux; Android 14) Mobile' WHEN 2 THEN 'Mozilla/5.0 (X11; Linux) ' || event_type ELSE 'iPhone' END"


@query(f"SELECT event_id, regexp_matches(agent, '(?i)iphone|ipad|ipod') AS ios, regexp_matches(agent, '(?i)iphone|ipad|ipod|android|mobile') AS mobile FROM (SELECT event_id, {_AGENT} AS agent FROM events)")
def x15_platform(spark, sf_dir):
    k = c("job") % 4
    agent = F.when(k == 0, "Mozilla/5.0 (iPad; CPU OS)").when(k == 1, "Mozilla/5.0 (Linux; Android 14) Mobile").when(k == 2, F.concat(F.lit("Mozilla/5.0 (X11; Linux) "), "stage")).otherwise("iPhone")
    return B.jobs(spark, sf_dir).select(c("job").alias("event_id"), O.platform(agent).alias("p")).select("event_id", "p.*")


@query(f"WITH {Q.SIZES} SELECT {K}, least(4096, ceil(greatest(width, height, 1280) * least(2.0, l_linenumber / 2.0)))::INT AS side FROM sizes")
def d06_preview_side(spark, sf_dir):
    return B.sizes(spark, sf_dir).select(*KEY, O.preview_side(c("width"), c("height"), c("l_linenumber") / 2.0).alias("side"))


@query(f"SELECT {K}, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE greatest(1, least(8, l_quantity::INT % 20 - 1)) END::INT AS threads FROM lineitem")
def d07_threads(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(*KEY, O.threads(c("l_quantity").cast("int") % 20, c("l_partkey") % 3 != 0).alias("threads"))


@query(f"SELECT {K}, {Q.micro('CASE WHEN side > 0 THEN least(0.5, 32.0::DOUBLE / side) ELSE 0.05 END')} AS least FROM (SELECT {K}, l_quantity::INT * 7 - 70 AS side FROM lineitem)")
def g10_least_crop(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").select(*KEY, micro(O.least_crop(c("l_quantity").cast("int") * 7 - 70)).alias("least"))


@query(f"WITH {Q.SIZES} SELECT {K}, {Q.micro('1.5::DOUBLE / (width / height::DOUBLE)')} AS ratio FROM sizes")
def g11_unit_ratio(spark, sf_dir):
    """A ratio of 3 to 2 in pixels, in shares of each image's sides."""
    return B.sizes(spark, sf_dir).select(*KEY, micro(F.lit(1.5) / (c("width") / c("height"))).alias("ratio"))


# --- messages ---------------------------------------------------------------

CATALOG = [(locale, key, text) for key, en, de in (("load", "Loading {done} of {total}", "{done} von {total} geladen"), ("title", "Cut out", "Freistellen"), ("close", "Close", "Schliessen")) for locale, text in (("en", en), ("de", de))]
_CATALOG = "catalog(locale, key, text) AS (VALUES " + ", ".join(str(x) for x in CATALOG) + ")"


def catalog(spark) -> DataFrame:
    return spark.createDataFrame(CATALOG, "locale string, key string, text string")


@query(f"WITH {_CATALOG}, e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'en' ELSE 'de' END AS locale, CASE event_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'title' WHEN 2 THEN 'close' ELSE 'none' END AS key FROM events) SELECT event_id, key, text FROM e LEFT JOIN catalog USING (locale, key)")
def j09_translated(spark, sf_dir):
    k = c("job") % 4
    keyed = B.jobs(spark, sf_dir).select(c("job").alias("event_id"), F.when(c("job") % 2 == 0, "en").otherwise("de").alias("locale"), F.when(k == 0, "load").when(k == 1, "title").when(k == 2, "close").otherwise("none").alias("key"))
    return O.translated(keyed, catalog(spark)).select("event_id", "key", "text")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Loading ' || (event_id % 50) || ' of ' || event_type ELSE (event_id % 50) || ' von ' || event_type || ' geladen' END AS text FROM events")
def x05_filled(spark, sf_dir):
    keyed = B.jobs(spark, sf_dir).select("job", "stage", F.when(c("job") % 2 == 0, "en").otherwise("de").alias("locale"), F.lit("load").alias("key"))
    text = N.filled(c("text"), {"done": c("job") % 50, "total": c("stage")})
    return O.translated(keyed, catalog(spark)).select(c("job").alias("event_id"), text.alias("text"))


@query(f"WITH {_CATALOG}, e AS (SELECT page_id, unnest(['aria-label', 'title', 'alt']) AS attribute, unnest(['close', CASE WHEN page_id % 2 = 0 THEN 'title' ELSE 'missing' END, 'load']) AS key FROM pages) SELECT page_id, attribute, text FROM e JOIN catalog USING (key) WHERE locale = 'de'")
def x17_attributes(spark, sf_dir):
    pairs = F.concat(F.lit("aria-label: close;title:"), F.when(c("page_id") % 2 == 0, "title").otherwise("missing"), F.lit(" ; alt:load;broken; :title"))
    rows = B.files(spark, sf_dir).select("page_id", F.lit("de").alias("locale"), pairs.alias("pairs"))
    return O.applied_attributes(rows, "pairs", catalog(spark)).select("page_id", "attribute", "text")


# --- stores and downloads ---------------------------------------------------


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cached ' || url ELSE url END AS manifest, page_id % 3 = 0 AS from_cache FROM pages")
def s08_manifest_or_cached(spark, sf_dir):
    rows = B.files(spark, sf_dir).select("page_id", c("name").alias("manifest"))
    cached = rows.where("page_id % 2 = 0 or page_id % 3 = 0").withColumn("manifest", F.concat(F.lit("cached "), "manifest"))
    return O.with_cached(rows.where("page_id % 3 <> 0"), cached, "page_id", "manifest")


@query("SELECT 'there' AS store, count(*) AS n FROM events UNION ALL SELECT 'missing', 0")
def s15_open_store(spark, sf_dir):
    there, missing = (O.open_store(spark, f"{sf_dir}/{name}.parquet", "event_id long") for name in ("events", "no_such_store"))
    return there.agg(F.count("*").alias("n")).select(F.lit("there").alias("store"), "n").union(missing.agg(F.count("*")).select(F.lit("missing"), "count(1)"))


_PARTS = "parts AS (SELECT page_id, url, i::INT AS idx, (encode(html))[i * 1000 + 1 : i * 1000 + 1000] AS part FROM (SELECT page_id, url, html, unnest(range(0, greatest(1, ceil(octet_length(encode(html)) / 1000.0))::BIGINT)) AS i FROM pages)), sized AS (SELECT page_id, url, idx, octet_length(part)::INT AS size, sha256(part) AS sha256 FROM parts)"


@query(f"WITH {_PARTS} SELECT DISTINCT sha256, size FROM sized WHERE sha256 NOT IN (SELECT sha256 FROM sized WHERE url LIKE 'https://%')")
def k09_to_cache(spark, sf_dir):
    """The cache holds the parts of secure pages; of all parts it lacks these."""
    files = B.files(spark, sf_dir)
    have = J.parts(files.where(c("name").startswith("https://")), "page_id", 1000)
    return O.to_cache(J.parts(files, "page_id", 1000), have).select("sha256", "size")


@query(f"WITH {_PARTS}, p AS (SELECT page_id, idx, sum(size) OVER (PARTITION BY page_id ORDER BY idx)::BIGINT AS loaded, sum(size) OVER (PARTITION BY page_id) AS total FROM sized), q AS (SELECT page_id, idx, loaded, CASE WHEN total > 0 THEN (loaded * 100 // total) END::INT AS percent FROM p), r AS (SELECT *, lag(percent) OVER (PARTITION BY page_id ORDER BY idx) AS before FROM q) SELECT page_id, idx, loaded, percent FROM r WHERE percent IS DISTINCT FROM before")
def r10_download_progress(spark, sf_dir):
    return J.download_progress(J.parts(B.files(spark, sf_dir), "page_id", 1000), "page_id")


_TRIES = 'tries AS (SELECT user_id AS part, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_id % 5 = 0 AS ok, event_id AS "at" FROM events)'


@query(f"WITH {_TRIES}, made AS (SELECT * FROM tries WHERE attempt <= 3), g AS (SELECT part, min(attempt) FILTER (WHERE ok) AS good, max(attempt) AS last FROM made GROUP BY part) SELECT g.part, coalesce(good, last)::INT AS attempts, good IS NOT NULL AS ok, m.\"at\" FROM g JOIN made m ON m.part = g.part AND m.attempt = coalesce(good, last)")
def r08_attempted(spark, sf_dir):
    """Each session's events as attempts at one part, of which every fifth works."""
    from pyspark.sql import Window

    attempt = F.row_number().over(Window.partitionBy("session").orderBy("job"))
    tries = B.jobs(spark, sf_dir).select(c("session").alias("part"), attempt.alias("attempt"), (c("job") % 5 == 0).alias("ok"), c("job").alias("at"))
    return O.attempted(tries)


# --- queues -----------------------------------------------------------------

_ARRIVAL = "epoch_ms(ts) // 60000"


@query(f"""WITH RECURSIVE j AS (SELECT user_id AS session, event_id AS job, {_ARRIVAL} AS arrival, event_id % 600 + 1 AS work FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY arrival, job) AS k FROM j),
    q AS (SELECT session, job, k, arrival AS started, arrival + work AS finished FROM o WHERE k = 1
        UNION ALL SELECT o.session, o.job, o.k, greatest(o.arrival, q.finished), greatest(o.arrival, q.finished) + o.work FROM q JOIN o ON o.session = q.session AND o.k = q.k + 1)
    SELECT session, job, started::BIGINT AS started, finished::BIGINT AS finished FROM q""")
def r02_serial_queue(spark, sf_dir):
    """Minutes at which each job starts and ends; the oracle goes from job to job."""
    rows = B.jobs(spark, sf_dir)
    jobs = rows.select("session", "job", F.floor(B.millis(rows, "ts") / 60000).alias("arrival"), (c("job") % 600 + 1).cast("long").alias("work"))
    return J.serial(jobs).select("session", "job", "started", "finished")


# --- models and graphs ------------------------------------------------------


def _mean_runner():
    """The mean of 32-bit floats in doubles: a 32-bit sum is off by more than what the fourth digit's rounding leaves open."""
    return lambda values: values.mean(axis=1, keepdims=True, dtype=np.float64)


def _broken_runner():
    raise RuntimeError("no device")


@query(f"WITH {Q.PLANES} SELECT vec_id, {Q.micro('round(avg(v::FLOAT), 4)')} // 1000 AS mean, 'cpu' AS backend FROM planes GROUP BY vec_id")
def c09_r09_inference(spark, sf_dir):
    """A model that gives each plane's mean, on the second backend, since the first has no device. Thousandths, as inputs are 32-bit floats."""
    got = O.infer(B.planes(spark, sf_dir).select("vec_id", c("plane").alias("input")), {"gpu": _broken_runner, "cpu": lambda: _mean_runner()})
    return got.select("vec_id", F.floor(micro(F.round(c("output")[0], 4)) / 1000).alias("mean"), "backend")


_EDGES = "edges AS (SELECT 'o' || l_orderkey AS node, 't' || l_partkey AS tensor, CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END AS direction FROM lineitem)"


def _edges(spark, sf_dir) -> DataFrame:
    direction = F.when(c("l_linenumber") % 2 == 0, "in").otherwise("out")
    return B.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("node"), F.concat(F.lit("t"), "l_partkey").alias("tensor"), direction.alias("direction"))


@query(f"WITH {_EDGES} SELECT node, count(*) AS buffers FROM edges GROUP BY node HAVING count(*) > 5")
def f18_over_buffers(spark, sf_dir):
    return O.over_buffers(_edges(spark, sf_dir), 5)


@query(f"WITH {_EDGES}, p AS (SELECT a.node AS producer, b.node AS consumer, a.tensor FROM edges a JOIN edges b USING (tensor) WHERE a.direction = 'out' AND b.direction = 'in') SELECT tensor, count(*) AS pairs, count(DISTINCT producer) AS producers FROM p GROUP BY tensor")
def j10_producers(spark, sf_dir):
    return O.producers(_edges(spark, sf_dir)).groupBy("tensor").agg(F.count("*").alias("pairs"), F.countDistinct("producer").alias("producers"))


@query("WITH i AS (SELECT n_name AS node, n_nationkey AS k, 1 AS after FROM nation UNION ALL SELECT r_name, min(n_nationkey), 0 FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name) SELECT node, (row_number() OVER (ORDER BY k, after) - 1)::INT AS place FROM i")
def t03_execution_order(spark, sf_dir):
    """Nations as nodes that need their region. A model's graph is as small: its nodes go to the driver, which orders them."""
    nation, region = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "region")
    edges = nation.join(region, c("n_regionkey") == c("r_regionkey")).select("r_name", "n_name")
    nodes = [r[0] for r in nation.orderBy("n_nationkey").select("n_name").collect()]
    found = [(r[0], r[1]) for r in edges.collect()]
    order = O.execution_order(found, nodes + sorted({a for a, _ in found}))
    return spark.createDataFrame([(n, k) for k, n in enumerate(order)], "node string, place int")


_SHIFT = "(v - 0.5) * 6"


@query(f"""WITH {Q.PLANES}, s AS (SELECT vec_id, x, y, v AS mask, x + {_SHIFT} AS ax, y - {_SHIFT} AS ay FROM planes),
    f AS (SELECT s.*, floor(ax) + i AS nx, floor(ay) + j AS ny FROM s, range(2) a(i), range(2) b(j)),
    g AS (SELECT f.vec_id, f.x, f.y, mask, coalesce(p.v, 0) * (1 - abs(ax - nx)) * (1 - abs(ay - ny)) AS part FROM f LEFT JOIN planes p ON p.vec_id = f.vec_id AND p.x = nx AND p.y = ny)
    SELECT vec_id, x, y, {Q.micro('sum(part) * any_value(mask)')} AS v FROM g GROUP BY vec_id, x, y""")
def n03_deformed(spark, sf_dir):
    """Planes read at places that their own values shift, times their values."""
    shift = lambda sign: F.transform("plane", lambda v: (v - 0.5) * 6 * sign)
    rows = B.planes(spark, sf_dir).withColumn("dx", shift(1)).withColumn("dy", shift(-1))
    out = rows.select("vec_id", O.deformed_plane(c("plane"), 8, 8, c("dx"), c("dy"), c("plane")).alias("out"))
    return B.pixels(out, "out", 8, "vec_id").withColumn("v", micro(c("v")))
