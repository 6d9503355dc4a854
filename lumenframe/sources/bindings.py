"""The tables as images, rectangles, files, jobs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from lumenframe.functions.numeric import clamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, plane: 8 x 8 values in [0, 1], one row for each image."""
    share = F.transform("embedding", lambda e: clamp(e.cast("double") + 0.5, 0.0, 1.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", share.alias("plane"))


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, r, g, b, a: 4 x 4 images as byte planes (int)."""
    byte = F.transform("plane", lambda v: F.floor(v * 255 + 0.5).cast("int"))
    df = planes(spark, sf_dir).withColumn("bytes", byte)
    channel = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.col("bytes")[p * 4 + k])
    return df.select("vec_id", "label", *[channel(k).alias(c) for k, c in enumerate("rgba")])


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, y, plane: images 64 wide with one row of pixels for each vector of a label."""
    from pyspark.sql import Window

    return planes(spark, sf_dir).select("label", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "plane")


def pixels(df: DataFrame, plane: str, width: int, *keys: str) -> DataFrame:
    """One row for each pixel: keys, x, y, v."""
    at = df.select(*keys, F.posexplode(plane).alias("pos", "v"))
    return at.select(*keys, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), "v")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, r: rectangles; not all lie in the unit square."""
    from lumenframe.functions.geometry import rect

    c = F.col
    r = rect(c("l_discount") * 5, c("l_tax") * 5, c("l_quantity") / 100, (c("l_partkey") % 50 + 1) / 100.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, width, height."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity").cast("int") * 400).cast("long").alias("width"), ((c("l_partkey") % 100 + 1) * 200).cast("long").alias("height"))


def _little(v: Column, n: int) -> Column:
    text = F.lpad(F.hex(v), 2 * n, "0")
    return F.concat(*[F.substring(text, 2 * (n - k) - 1, 2) for k in range(n)])


def _big(v: Column, n: int) -> Column:
    return F.lpad(F.hex(v), 2 * n, "0")


def headers(df: DataFrame) -> DataFrame:
    """width, height -> also kind and content: header bytes of nine kinds that tell that size, by width + height modulo 9.

    Sizes of plain WebP, lossy or not, have 14 bits, those of GIF and JPEG 16.
    """
    w, h = F.col("width"), F.col("height")
    text = lambda s: F.lit(s.encode().hex())
    zero = lambda n: F.lit("00" * n)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), text("IHDR"), _big(w, 4), _big(h, 4), F.lit("0806000000"))
    gif = F.concat(text("GIF89a"), _little(w, 2), _little(h, 2), zero(4))
    bmp = F.concat(text("BM"), zero(16), _little(w, 4), _little(F.lit(1 << 32) - h, 4), zero(4))
    vp8x = F.concat(text("RIFF"), zero(4), text("WEBPVP8X"), zero(8), _little(w - 1, 3), _little(h - 1, 3))
    vp8 = F.concat(text("RIFF"), zero(4), text("WEBPVP8 "), zero(10), _little(w.bitwiseAND(F.lit(0x3FFF).cast("long")), 2), _little(h.bitwiseAND(F.lit(0x3FFF).cast("long")), 2))
    avif = F.concat(_big(F.lit(20), 4), text("ftypmif1"), zero(4), text("avif"), _big(F.lit(20), 4), text("ispe"), zero(4), _big(w, 4), _big(h, 4))
    heic = F.concat(_big(F.lit(24), 4), text("ftypmif1"), zero(4), text("miafheic"), _big(F.lit(20), 4), text("ispe"), zero(4), _big(F.lit(160), 4), _big(F.lit(120), 4), _big(F.lit(20), 4), text("ispe"), zero(4), _big(w, 4), _big(h, 4))
    # a fill byte, a restart marker, a comment that holds a frame's bytes, then the frame
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFFD0FFFE000BFFC000110800010001"), F.lit("FFC2001108"), _big(h, 2), _big(w, 2), F.lit("03012200021101031101"), zero(4))
    low = lambda v: (v - 1).bitwiseAND(F.lit(0x3FFF).cast("long"))
    vp8l = F.concat(text("RIFF"), zero(4), text("WEBPVP8L"), zero(4), F.lit("2F"), _little(low(w) + F.shiftleft(low(h), 14), 4))
    kinds = ["png", "gif", "bmp", "webp", "webp", "avif", "jpeg", "heic", "webp"]
    which = (w + h) / 200 % 9
    df = df.withColumn("_which", which.cast("int"))
    pick = lambda values: F.element_at(F.array(*values), F.col("_which") + 1)
    return df.withColumn("kind", pick([F.lit(k) for k in kinds])).withColumn("content", F.unhex(pick([png, gif, bmp, vp8x, vp8, avif, jpeg, heic, vp8l]))).drop("_which")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, name, content."""
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("name"), F.encode("html", "UTF-8").alias("content"))


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds of a time since 1970. Times without a zone are taken as UTC, whatever zone the session has: a cast would read them in that."""
    if df.schema[name].dataType != TimestampNTZType():
        return F.unix_millis(name)
    minutes = (F.unix_date(F.to_date(name)).cast("long") * 24 + F.hour(name)) * 60 + F.minute(name)
    return minutes * 60000 + F.floor(F.date_part(F.lit("second"), name) * 1000)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, job, stage, progress, ts, props."""
    c = F.col
    return table(spark, sf_dir, "events").select(c("user_id").alias("session"), c("event_id").alias("job"), c("event_type").alias("stage"), c("value").alias("progress"), "ts", "props")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, id, created."""
    c = F.col
    return table(spark, sf_dir, "events").select(c("user_id").alias("owner"), c("event_id").alias("id"), c("ts").alias("created"))
