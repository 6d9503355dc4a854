"""One query for each operator of the engine, on the tables as bound in lumenframe.sources.bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions.numeric import byte_floor, half_up, micro, sigmoid
from lumenframe.functions.planes import blurred, matmul, resampled
from lumenframe.operators import matting as M
from lumenframe.operators import resample as R
from lumenframe.operators.images import cut_images, pixel_rows
from lumenframe.plans import sql as Q
from lumenframe.plans.registry import query
from lumenframe.sources import bindings as B
from lumenframe.sources import png

c = F.col

# --- planes -----------------------------------------------------------------


def _values(df: DataFrame, plane: str, width: int, key: str = "vec_id") -> DataFrame:
    return B.pixels(df, plane, width, key).withColumn("v", micro(c("v")))


def _plane_query(name: str, to: int, kind: str):
    def run(spark, sf_dir):
        return _values(resampled(B.planes(spark, sf_dir), "plane", 8, 8, to, to, kind, "out").withColumn("out", F.transform("out", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))), "out", to)

    run.__name__ = name
    query(f"WITH {Q.PLANES}, {Q.resample('planes', 'vec_id', (8, 8), (to, to), kind)} SELECT vec_id, x, y, {Q.micro(Q.clamp('v', '0.0', '1.0'))} AS v FROM res")(run)


for _name, _to, _kind in (("c05_resample_box", 4, "box"), ("c05_resample_triangle", 5, "triangle"), ("c05_resample_bicubic", 16, "bicubic"), ("n05_resize_linear", 16, "triangle")):
    _plane_query(_name, _to, _kind)


def _byte_query(name: str, to: int, kind: str):
    def run(spark, sf_dir):
        df = resampled(B.planes(spark, sf_dir), "plane", 8, 8, to, to, kind, "out")
        return B.pixels(df.withColumn("out", F.transform("out", byte_floor)), "out", to, "vec_id")

    run.__name__ = name
    query(f"WITH {Q.PLANES}, {Q.resample('planes', 'vec_id', (8, 8), (to, to), kind)} SELECT vec_id, x, y, {Q.clamp('floor(v * 255.0 + 0.5)', '0', '255')}::INT AS v FROM res")(run)


_byte_query("c06_resample_to_bytes", 4, "triangle")
_byte_query("c12_matte_upsample", 16, "bicubic")


@query("SELECT x, " + Q.micro(Q.kernel("box", "x")) + " AS box, " + Q.micro(Q.kernel("triangle", "x")) + " AS triangle, " + Q.micro(Q.kernel("bicubic", "x")) + " AS bicubic FROM (SELECT (i - 100) / 32.0::DOUBLE AS x FROM range(201) t(i))")
def c01_kernels(spark, sf_dir):
    df = spark.range(201).select(((c("id") - 100) / 32.0).alias("x"))
    return df.select("x", *[micro(R.kernel(k, c("x"))).alias(k) for k in ("box", "triangle", "bicubic")])


_SHAPES = [(48, 13, "box"), (13, 48, "bicubic"), (10, 10, "triangle"), (7, 3, "bicubic"), (7, 3, "triangle")]


@query("WITH " + ", ".join(Q.taps(f"t{k}", *s) for k, s in enumerate(_SHAPES)) + " " + " UNION ALL ".join(f"SELECT {k} AS shape, o, i, {Q.micro('w')} AS w FROM t{k}" for k in range(len(_SHAPES))))
def c02_coefficients(spark, sf_dir):
    out = None
    for k, shape in enumerate(_SHAPES):
        one = R.coefficients(spark, *shape).select(F.lit(k).alias("shape"), "o", "i", micro(c("w")).alias("w"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {Q.RGBA}, ch AS (SELECT vec_id, ch, p % 4 AS x, p // 4 AS y, b::DOUBLE AS v FROM bytes WHERE ch < 3), {Q.resample('ch', 'vec_id ch', (4, 4), (3, 3), 'bicubic')} SELECT vec_id, ch, x, y, {Q.micro('v')} AS v FROM res")
def c03_resample_interleaved(spark, sf_dir):
    df = B.rgba(spark, sf_dir)
    stacked = df.select("vec_id", F.posexplode(F.array("r", "g", "b")).alias("ch", "plane")).withColumn("plane", F.transform("plane", lambda v: v.cast("double")))
    return B.pixels(resampled(stacked, "plane", 4, 4, 3, 3, "bicubic", "out"), "out", 3, "vec_id", "ch").withColumn("v", micro(c("v")))


@query(f"WITH {Q.PLANES}, {Q.taps('cx', 8, 3, 'triangle')} SELECT vec_id, o AS x, y, {Q.micro('sum(v * w)')} AS v FROM planes JOIN cx ON x = i GROUP BY vec_id, o, y")
def c04_horizontal_pass(spark, sf_dir):
    from lumenframe.functions.planes import across, coefficients

    return _values(B.planes(spark, sf_dir).withColumn("out", across(c("plane"), 8, 8, coefficients(8, 3, "triangle"))), "out", 3)


@query(f"WITH {Q.PLANES}, {Q.resample('planes', 'vec_id', (8, 8), (5, 3), 'bicubic')} SELECT vec_id, x, y, {Q.micro('v')} AS v FROM res")
def j06_pixels_with_coefficients(spark, sf_dir):
    px = B.pixels(B.planes(spark, sf_dir), "plane", 8, "vec_id")
    return R.resample_pixels(px, ["vec_id"], (8, 8), (5, 3), "bicubic").select("vec_id", "x", "y", micro(c("v")).alias("v"))


@query(f"WITH {Q.PLANES}, {Q.taps('cx', 8, 2, 'box')} SELECT vec_id, o, {Q.micro('sum(v * w)')} AS v, {Q.micro('sum(w)')} AS w FROM planes JOIN cx ON x = i GROUP BY vec_id, o")
def a01_weighted_sum(spark, sf_dir):
    px = B.pixels(B.planes(spark, sf_dir), "plane", 8, "vec_id")
    taps = F.broadcast(R.coefficients(spark, 8, 2, "box"))
    return px.join(taps, c("x") == c("i")).groupBy("vec_id", "o").agg(micro(F.sum(c("v") * c("w"))).alias("v"), micro(F.sum("w")).alias("w"))


@query(f"WITH {Q.taps('t', 100, 7, 'bicubic')} SELECT o, count(*) AS n, {Q.micro('sum(w)')} AS total, min(i) AS low, max(i) AS high FROM t GROUP BY o")
def a02_weight_totals(spark, sf_dir):
    return R.coefficients(spark, 100, 7, "bicubic").groupBy("o").agg(F.count("*").alias("n"), micro(F.sum("w")).alias("total"), F.min("i").alias("low"), F.max("i").alias("high"))


@query(f"WITH {Q.PLANES}, {Q.blur('planes', 'vec_id', 2)} SELECT vec_id, x, y, {Q.micro('v')} AS v FROM blurred")
def c14_box_blur(spark, sf_dir):
    return _values(blurred(B.planes(spark, sf_dir), "plane", 8, 8, 2, "out"), "out", 8)


@query(f"WITH {Q.TALL}, {Q.blur('tall', 'label', 6)} SELECT label, x, y, {Q.micro('v')} AS v FROM blurred")
def w01_moving_average(spark, sf_dir):
    return R.blur_pixels(_tall_pixels(spark, sf_dir), ["label"], 6).select("label", "x", "y", micro(c("v")).alias("v"))


def _tall_pixels(spark, sf_dir):
    return B.tall(spark, sf_dir).select("label", "y", F.posexplode("plane").alias("x", "v"))


@query(f"WITH {Q.TALL}, {Q.blur('tall', 'label', 20)} SELECT label, x, y, {Q.micro('v')} AS v FROM blurred")
def a03_sliding_mean_wide(spark, sf_dir):
    return R.blur_pixels(_tall_pixels(spark, sf_dir), ["label"], 20).select("label", "x", "y", micro(c("v")).alias("v"))


@query(f"WITH {Q.PLANES} SELECT vec_id, x, y, {Q.micro('1/(1+exp(-v))')} AS s, {Q.micro('(v - 0.485) / 0.229')} AS z FROM planes")
def x13_sigmoid_normalise(spark, sf_dir):
    px = B.pixels(B.planes(spark, sf_dir), "plane", 8, "vec_id")
    return px.select("vec_id", "x", "y", micro(sigmoid(c("v"))).alias("s"), micro((c("v") - 0.485) / 0.229).alias("z"))


@query(f"WITH {Q.PLANES}, s AS (SELECT pos, CASE WHEN max(abs(v - 0.5)) = 0 THEN 1.0 ELSE max(abs(v - 0.5)) / 127.0 END AS scale FROM planes GROUP BY pos) SELECT vec_id, pos, {Q.clamp('round_even((v - 0.5) / scale, 0)', '-127', '127')}::INT AS q, {Q.micro('scale')} AS scale FROM planes JOIN s USING (pos)")
def x16_int8_quantise(spark, sf_dir):
    px = B.planes(spark, sf_dir).select("vec_id", F.posexplode("plane").alias("pos", "v")).withColumn("v", c("v") - 0.5)
    top = F.max(F.abs("v"))
    scale = px.groupBy("pos").agg(F.when(top == 0, 1.0).otherwise(top / 127.0).alias("scale"))
    q = F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(c("v") / c("scale")))).cast("int")
    return px.join(F.broadcast(scale), "pos").select("vec_id", "pos", q.alias("q"), micro(c("scale")).alias("scale"))  # 64 channels


@query(f"WITH {Q.PLANES} SELECT pos, {Q.micro('max(abs(v - 0.5))')} AS top FROM planes GROUP BY pos")
def a07_channel_max_abs(spark, sf_dir):
    return B.planes(spark, sf_dir).select(F.posexplode("plane").alias("pos", "v")).groupBy("pos").agg(micro(F.max(F.abs(c("v") - 0.5))).alias("top"))


@query(f"WITH {Q.PLANES} SELECT v > 0.5 AS compressed, count(*) AS n FROM planes GROUP BY 1")
def a10_counts_by_flag(spark, sf_dir):
    return B.planes(spark, sf_dir).select(F.explode("plane").alias("v")).groupBy((c("v") > 0.5).alias("compressed")).agg(F.count("*").alias("n"))


# --- tensors ----------------------------------------------------------------


@query(f"WITH {Q.PLANES} SELECT a.vec_id, a.y AS row, b.x AS col, {Q.micro('sum(a.v * b.v)')} AS v FROM planes a JOIN planes b ON a.vec_id = b.vec_id AND a.x = b.y GROUP BY ALL")
def n01_matmul(spark, sf_dir):
    df = B.planes(spark, sf_dir).withColumn("out", matmul(c("plane"), c("plane"), 8))
    return df.select("vec_id", F.posexplode("out").alias("p", "v")).select("vec_id", F.floor(c("p") / 8).cast("int").alias("row"), (c("p") % 8).alias("col"), micro(c("v")).alias("v"))


_MIX = {"luma": (0.299, 0.587, 0.114), "even": (1 / 3, 1 / 3, 1 / 3)}


@query(f"WITH {Q.RGBA} SELECT vec_id, p, {Q.micro('r*0.299 + g*0.587 + b*0.114')} AS luma, {Q.micro(f'r*{1/3!r} + g*{1/3!r} + b*{1/3!r}')} AS even FROM rgba")
def n02_channel_mix(spark, sf_dir):
    df = B.rgba(spark, sf_dir)
    mixed = df.select("vec_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "s"))
    return mixed.select("vec_id", "p", *[micro(c("s.r") * w[0] + c("s.g") * w[1] + c("s.b") * w[2]).alias(k) for k, w in _MIX.items()])


@query(f"WITH {Q.PLANES} SELECT vec_id, (x // 4) * 2 + y // 4 AS patch, y % 4 AS y, x % 4 AS x, {Q.micro('v')} AS v FROM planes")
def n04_patch_rearrange(spark, sf_dir):
    px = B.pixels(B.planes(spark, sf_dir), "plane", 8, "vec_id")
    half = lambda v: F.floor(c(v) / 4).cast("int")
    return px.select("vec_id", (half("x") * 2 + half("y")).alias("patch"), (c("y") % 4).alias("y"), (c("x") % 4).alias("x"), micro(c("v")).alias("v"))


@query(f"WITH {Q.PLANES} SELECT vec_id, ox AS x, oy AS y, coalesce({Q.micro('v')}, 0) AS v FROM (SELECT DISTINCT vec_id FROM planes), range(10) a(ox), range(10) b(oy) LEFT JOIN planes p ON p.vec_id = vec_id AND p.x = ox - 1 AND p.y = oy - 1".replace("p.vec_id = vec_id", "p.vec_id = i.vec_id").replace("SELECT vec_id, ox", "SELECT i.vec_id, ox").replace("FROM planes), range", "FROM planes) i, range").replace("range(10) b(oy) LEFT", "range(10) b(oy) LEFT"))
def n06_pad(spark, sf_dir):
    inside = lambda p: (p % 10).between(1, 8) & F.floor(p / 10).between(1, 8)
    at = lambda p: ((F.floor(p / 10) - 1) * 8 + p % 10 - 1).cast("int")
    out = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda p: F.when(inside(p), c("plane")[F.greatest(F.lit(0), F.least(F.lit(63), at(p)))]).otherwise(0.0))
    return _values(B.planes(spark, sf_dir).withColumn("out", out), "out", 10)


@query(f"WITH {Q.PLANES} SELECT vec_id, pos, {Q.micro('v')} AS v FROM (SELECT vec_id, 63 - pos AS pos, v FROM planes WHERE pos % 3 = 0)")
def n06_gather(spark, sf_dir):
    index = F.sequence(F.lit(0), F.lit(63), F.lit(3))
    got = F.transform(index, lambda i: F.struct((63 - i).alias("pos"), c("plane")[i].alias("v")))
    return B.planes(spark, sf_dir).select("vec_id", F.explode(got).alias("s")).select("vec_id", "s.pos", micro(c("s.v")).alias("v"))


@query(f"WITH {Q.PLANES} SELECT vec_id, {Q.micro('1/(1+exp(-4*sum(v)/64))')} AS v FROM planes GROUP BY vec_id")
def n07_sigmoid_output(spark, sf_dir):
    total = F.aggregate("plane", F.lit(0.0), lambda s, v: s + v)
    return B.planes(spark, sf_dir).select("vec_id", micro(sigmoid(4 * total / 64)).alias("v"))


@query(f"WITH {Q.PLANES} SELECT vec_id, x, {Q.micro('sum(v)')} AS v FROM planes GROUP BY vec_id, x")
def n08_sum_of_parts(spark, sf_dir):
    px = B.pixels(B.planes(spark, sf_dir), "plane", 8, "vec_id")
    return px.where("y < 3").union(px.where("y >= 3")).groupBy("vec_id", "x").agg(micro(F.sum("v")).alias("v"))


@query(f"WITH {Q.PLANES} SELECT vec_id, pos % 32 AS pos, pos // 32 AS channel, {Q.micro('v')} AS v FROM planes")
def u03_split_concat(spark, sf_dir):
    df = B.planes(spark, sf_dir)
    part = lambda k: df.select("vec_id", F.posexplode(F.slice("plane", 32 * k + 1, 32)).alias("pos", "v")).withColumn("channel", F.lit(k))
    return part(0).unionByName(part(1)).select("vec_id", "pos", "channel", micro(c("v")).alias("v"))


# --- matting ----------------------------------------------------------------

_FLAT = {k: Q.byte_even(f"{k} * (a / 255.0::DOUBLE) + 255.0 * (1 - a / 255.0::DOUBLE)") for k in "rgb"}


def _bytes(df: DataFrame, columns: str = "rgba") -> DataFrame:
    return df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("p", "s")).select("vec_id", "p", *[c(f"s.{k}").alias(k) for k in columns])


@query(f"WITH {Q.RGBA} SELECT vec_id, p, {_FLAT['r']} AS r, {_FLAT['g']} AS g, {_FLAT['b']} AS b FROM rgba")
def c07_flatten(spark, sf_dir):
    return _bytes(M.flatten(B.rgba(spark, sf_dir)), "rgb")


_FLAT_LONG = ", flat AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS ch, x, y, {_FLAT[n]}::DOUBLE AS v FROM rgba" for k, n in enumerate("rgb")) + ")"
_INPUT = f"{Q.RGBA}{_FLAT_LONG}, {Q.resample('flat', 'vec_id ch', (4, 4), (8, 8), 'triangle', 'inp')}, norm AS (SELECT vec_id, ch, x, y, (v / 255.0 - CASE ch WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END) / CASE ch WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END AS v FROM inp)"


@query(f"WITH {_INPUT} SELECT vec_id, ch, x, y, {Q.micro('v')} AS v FROM norm")
def c08_model_input(spark, sf_dir):
    made = M.model_input(B.rgba(spark, sf_dir), (4, 4), (8, 8))
    return B.pixels(made.select("vec_id", F.posexplode(F.array("in_r", "in_g", "in_b")).alias("ch", "plane")), "plane", 8, "vec_id", "ch").withColumn("v", micro(c("v")))


_MATTE = _INPUT + ", matte AS (SELECT vec_id, x, y, 1 / (1 + exp(-4 * avg(v))) AS v FROM norm GROUP BY vec_id, x, y)"


@query(f"WITH {_MATTE} SELECT vec_id, x, y, {Q.micro('v')} AS v FROM matte")
def c10_mock_model(spark, sf_dir):
    return _values(M.mock_matte(M.model_input(B.rgba(spark, sf_dir), (4, 4), (8, 8))), "matte", 8)


@query(f"WITH {_INPUT} SELECT vec_id, x, y, {Q.micro('1 / (1 + exp(-4 * avg(v) * (1 + floor(x * 4 / 8.0::DOUBLE) * 1e-6)))')} AS v FROM norm GROUP BY vec_id, x, y")
def c11_strip_model(spark, sf_dir):
    return _values(M.mock_matte(M.model_input(B.rgba(spark, sf_dir), (4, 4), (8, 8)), strips=4, width=8), "matte", 8)


@query(f"WITH {_INPUT} SELECT vec_id, x, y, {Q.micro('avg(v)')} AS v FROM norm GROUP BY vec_id, x, y")
def a12_channel_mean(spark, sf_dir):
    made = M.model_input(B.rgba(spark, sf_dir), (4, 4), (8, 8))
    return _values(made.withColumn("out", M.each(lambda r, g, b: (r + g + b) / 3.0, "in_r", "in_g", "in_b")), "out", 8)


_ALPHA = f"{_MATTE}, {Q.resample('matte', 'vec_id', (8, 8), (4, 4), 'bicubic', 'fine')}, alpha AS (SELECT c.vec_id, c.p, c.x, c.y, c.r, c.g, c.b, floor(({Q.clamp('floor(f.v * 255.0 + 0.5)', '0', '255')} * c.a + 127) / 255)::INT AS a FROM rgba c JOIN fine f USING (vec_id, x, y))"


@query(f"WITH {_ALPHA} SELECT vec_id, p, a FROM alpha")
def c13_alpha_limit(spark, sf_dir):
    made = M.alpha_from(M.mock_matte(M.model_input_columns(B.rgba(spark, sf_dir), (4, 4), (8, 8))), (8, 8), (4, 4))
    return made.select("vec_id", F.posexplode("alpha").alias("p", "a"))


def _foreground_sql(source: str, r1: int, r2: int) -> str:
    """CTEs from source(vec_id, p, x, y, r, g, b, a) to done(vec_id, p, r, g, b, a)."""
    work = " UNION ALL ".join(f"SELECT vec_id, {k} AS ch, x, y, {n} / 255.0::DOUBLE AS i, a / 255.0::DOUBLE AS a FROM {source}" for k, n in enumerate("rgb"))
    e = "1e-5::DOUBLE"
    return (
        f"work AS (SELECT *, i * a AS ia, i * (1 - a) AS ib FROM ({work})), "
        f"{Q.blur('work', 'vec_id ch', r1, 'a', 'a1')}, {Q.blur('work', 'vec_id ch', r2, 'a', 'a2')}, {Q.blur('work', 'vec_id ch', r1, 'ia', 'f1')}, {Q.blur('work', 'vec_id ch', r1, 'ib', 'b1')}, "
        f"one AS (SELECT w.vec_id, w.ch, w.x, w.y, w.i, w.a, f1.v / (a1.v + {e}) AS f, b1.v / (1 - a1.v + {e}) AS b FROM work w JOIN a1 USING (vec_id, ch, x, y) JOIN f1 USING (vec_id, ch, x, y) JOIN b1 USING (vec_id, ch, x, y)), "
        f"two AS (SELECT vec_id, ch, x, y, i, a, {Q.clamp('f + a * (i - a * f - (1 - a) * b)', '0.0', '1.0')} * a AS fa, b * (1 - a) AS ba FROM one), "
        f"{Q.blur('two', 'vec_id ch', r2, 'fa', 'f2')}, {Q.blur('two', 'vec_id ch', r2, 'ba', 'b2')}, "
        f"est AS (SELECT t.vec_id, t.ch, t.x, t.y, t.i, t.a, f2.v / (a2.v + {e}) AS f, b2.v / (1 - a2.v + {e}) AS b FROM two t JOIN a2 USING (vec_id, ch, x, y) JOIN f2 USING (vec_id, ch, x, y) JOIN b2 USING (vec_id, ch, x, y))"
    )


def _fixed_sql(source: str, r1: int, r2: int) -> str:
    soft = Q.byte_even("(f + e.a * (i - e.a * f - (1 - e.a) * e.b)) * 255.0")
    one = f"fix AS (SELECT s.vec_id, s.p, e.ch, CASE WHEN s.a = 255 THEN round_even(i * 255.0, 0)::INT WHEN s.a = 0 THEN 0 ELSE {soft} END AS v, s.a FROM {source} s JOIN est e USING (vec_id, x, y))"
    return f"{_foreground_sql(source, r1, r2)}, {one}, done AS (SELECT vec_id, p, max(v) FILTER (WHERE ch = 0) AS r, max(v) FILTER (WHERE ch = 1) AS g, max(v) FILTER (WHERE ch = 2) AS b, max(a) AS a FROM fix GROUP BY vec_id, p)"


def _with_alpha(spark, sf_dir) -> DataFrame:
    return B.rgba(spark, sf_dir).withColumn("alpha", c("a"))


@query(f"WITH {Q.RGBA}, {_foreground_sql('rgba', 2, 1)} SELECT vec_id, x, y, {Q.micro('max(f) FILTER (WHERE ch = 0)')} AS f, {Q.micro('max(b) FILTER (WHERE ch = 0)')} AS b FROM est GROUP BY vec_id, x, y")
def c15_c16_blur_fusion(spark, sf_dir):
    df = B.rgba(spark, sf_dir).withColumns({f"p_{k}": F.transform(k, lambda v: v / 255.0) for k in "rgba"})
    got = M.estimates(df, 4, 4, 2, 1).select("vec_id", F.posexplode(F.arrays_zip("fg_r", "bg_r")).alias("p", "s"))
    return got.select("vec_id", (c("p") % 4).alias("x"), F.floor(c("p") / 4).cast("int").alias("y"), micro(c("s.fg_r")).alias("f"), micro(c("s.bg_r")).alias("b"))


@query(f"WITH {Q.RGBA}, ch AS (SELECT vec_id, ch, p % 4 AS x, p // 4 AS y, b::DOUBLE AS v FROM bytes), {Q.resample('ch', 'vec_id ch', (4, 4), (2, 2), 'box')} SELECT vec_id, ch, x, y, {Q.micro('v / 255.0')} AS v FROM res")
def c17_working_planes(spark, sf_dir):
    df = B.rgba(spark, sf_dir).select("vec_id", F.posexplode(F.array(*"rgba")).alias("ch", "plane")).withColumn("plane", F.transform("plane", lambda v: v / 255.0))
    return B.pixels(resampled(df, "plane", 4, 4, 2, 2, "box", "out"), "out", 2, "vec_id", "ch").withColumn("v", micro(c("v")))


@query(f"WITH {Q.RGBA}, {_fixed_sql('rgba', 1, 1)} SELECT * FROM done")
def c22_foreground(spark, sf_dir):
    return _bytes(M.foreground(_with_alpha(spark, sf_dir), 4, 4, (1, 1)))


@query(f"WITH {Q.RGBA}, {_fixed_sql('rgba', 90, 6)} SELECT * FROM done")
def c21_foreground_wide(spark, sf_dir):
    return _bytes(M.foreground(_with_alpha(spark, sf_dir), 4, 4))


_BILINEAR = "look AS (SELECT o, i, sum(w) AS w FROM (SELECT o, floor(g)::INT AS i, 1 - (g - floor(g)) AS w FROM pos UNION ALL SELECT o, least(floor(g)::INT + 1, 1) AS i, g - floor(g) AS w FROM pos) GROUP BY o, i)"


@query(f"WITH {Q.RGBA}, ch AS (SELECT vec_id, p % 4 AS x, p // 4 AS y, b / 255.0::DOUBLE AS v FROM bytes WHERE ch = 0), {Q.resample('ch', 'vec_id', (4, 4), (2, 2), 'box')}, pos AS (SELECT o, least(1.0, greatest(0.0, (o + 0.5)::DOUBLE * 0.5 - 0.5)) AS g FROM range(4) t(o)), {_BILINEAR} SELECT vec_id, lx.o AS x, ly.o AS y, {Q.micro('sum(v * lx.w * ly.w)')} AS v FROM res JOIN look lx ON x = lx.i JOIN look ly ON y = ly.i GROUP BY vec_id, lx.o, ly.o")
def c20_j07_bilinear_lookup(spark, sf_dir):
    from lumenframe.functions.planes import across, down

    df = B.rgba(spark, sf_dir).withColumn("plane", F.transform("r", lambda v: v / 255.0))
    df = resampled(df, "plane", 4, 4, 2, 2, "box", "small")
    df = df.withColumn("row", across(c("small"), 2, 2, M.bilinear(4, 2).dense()))
    return _values(df.withColumn("out", down(c("row"), 4, 2, M.bilinear(4, 2).dense())), "out", 4)


@query(f"WITH {Q.RGBA} SELECT vec_id, count(*) FILTER (WHERE a NOT IN (0, 255)) AS soft, count(*) FILTER (WHERE a NOT IN (0, 255)) = 0 AS fast FROM rgba GROUP BY vec_id")
def c19_soft_pixels(spark, sf_dir):
    soft = F.size(F.filter("a", lambda v: ~v.isin(0, 255))).cast("long")
    return B.rgba(spark, sf_dir).select("vec_id", soft.alias("soft"), (soft == 0).alias("fast"))


@query(f"WITH {Q.RGBA} SELECT vec_id, count(DISTINCT a) AS alphas, bool_or(a <> 255) AS has_alpha, count(*) FILTER (WHERE a NOT IN (0, 255)) AS soft FROM rgba GROUP BY vec_id")
def a04_a05_a11_alpha_counts(spark, sf_dir):
    px = _bytes(B.rgba(spark, sf_dir))
    return px.groupBy("vec_id").agg(F.count_distinct("a").alias("alphas"), F.bool_or(c("a") != 255).alias("has_alpha"), F.count_if(~c("a").isin(0, 255)).alias("soft"))


@query(f"WITH {Q.RGBA} SELECT vec_id, bool_or(a <> 255) AS has_alpha FROM rgba GROUP BY vec_id")
def f16_alpha_present(spark, sf_dir):
    return B.rgba(spark, sf_dir).select("vec_id", F.exists("a", lambda v: v != 255).alias("has_alpha"))


_ON = lambda k, bg: Q.byte_even(f"{k} * (a / 255.0::DOUBLE) + {bg} * (1 - a / 255.0::DOUBLE)")


@query(f"WITH {Q.RGBA} SELECT vec_id, p, {_ON('r', 30)} AS r, {_ON('g', 200)} AS g, {_ON('b', 90)} AS b, 255 AS a FROM rgba")
def c24_composite(spark, sf_dir):
    return _bytes(M.composed(B.rgba(spark, sf_dir), (30, 200, 90)))


@query(f"WITH {_ALPHA}, {_fixed_sql('alpha', 1, 1)} SELECT * FROM done")
def c26_whole_job(spark, sf_dir):
    return _bytes(M.cut_out(B.rgba(spark, sf_dir), 4, 4, (8, 8)))


@query(f"WITH {Q.TALL} SELECT label, x - 10 AS x, y - 3 AS y, {Q.micro('v')} AS v FROM tall WHERE x BETWEEN 10 AND 29 AND y BETWEEN 3 AND 22")
def c23_crop_rows(spark, sf_dir):
    rows = B.tall(spark, sf_dir).where("y between 3 and 22").select("label", (c("y") - 3).alias("y"), F.posexplode(F.slice("plane", 11, 20)).alias("x", "v"))
    return rows.select("label", "x", "y", micro(c("v")).alias("v"))


_TALL_RGBA = (
    Q.TALL
    + ", shot AS (SELECT label AS vec_id, y * 64 + x AS p, x, y, floor(v * 255 + 0.5)::INT AS r, 255 - floor(v * 255 + 0.5)::INT AS g, floor(v * 255 + 0.5)::INT * 7 % 256 AS b, least(255, greatest(0, x * 8 + y % 32 - 120))::INT AS a FROM tall)"
)


def tall_images(spark, sf_dir) -> DataFrame:
    """label, width, height, rgba, alpha: each label's image as bytes; its matte rises from left to right."""
    hexed = lambda v: F.lpad(F.hex(v), 2, "0")
    rows = B.tall(spark, sf_dir).withColumn("v", F.transform("plane", lambda v: F.floor(v * 255 + 0.5).cast("int")))
    pixel = lambda v: F.concat(hexed(v), hexed(255 - v), hexed(v * 7 % 256), F.lit("FF"))
    matte = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: hexed(F.least(F.lit(255), F.greatest(F.lit(0), x * 8 + c("y") % 32 - 120))))
    rows = rows.select("label", "y", F.array_join(F.transform("v", pixel), "").alias("line"), F.array_join(matte, "").alias("cover"))
    image = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("y", "line", "cover"))).alias("rows"))
    joined = lambda k: F.unhex(F.array_join(c(f"rows.{k}"), ""))
    return image.select("label", F.lit(64).alias("width"), F.size("rows").alias("height"), joined("line").alias("rgba"), joined("cover").alias("alpha"))


@query(f"WITH {_TALL_RGBA}, {_fixed_sql('shot', 20, 3)} SELECT vec_id AS label, p, r, g, b, a FROM done")
def c22_cut_images(spark, sf_dir):
    """On the grid of full size, whatever the images' size, as the SQL has no other."""
    return pixel_rows(cut_images(tall_images(spark, sf_dir), "label", (20, 3), work_pixels=1 << 62), "label")


_DONE, _TARGET = (0.125, 0.1, 0.75, 0.8), (0.25, 0.3, 0.5, 0.4)


@query(f"""WITH {Q.TALL}, s AS (SELECT label, 64 AS w, max(y) + 1 AS h FROM tall GROUP BY label),
    d AS (SELECT label, floor({_DONE[0]} * w + 0.5) AS dx, floor({_DONE[1]}::DOUBLE * h + 0.5) AS dy, floor({_DONE[0] + _DONE[2]} * w + 0.5) - floor({_DONE[0]} * w + 0.5) AS dw, floor({_DONE[1] + _DONE[3]}::DOUBLE * h + 0.5) - floor({_DONE[1]}::DOUBLE * h + 0.5) AS dh FROM s),
    r AS (SELECT ({_TARGET[0]}::DOUBLE - {_DONE[0]}::DOUBLE) / {_DONE[2]}::DOUBLE AS x, ({_TARGET[1]}::DOUBLE - {_DONE[1]}::DOUBLE) / {_DONE[3]}::DOUBLE AS y, {_TARGET[2]}::DOUBLE / {_DONE[2]}::DOUBLE AS w, {_TARGET[3]}::DOUBLE / {_DONE[3]}::DOUBLE AS h),
    c AS (SELECT d.*, floor(x * dw + 0.5) AS x0, floor(y * dh + 0.5) AS y0, floor((x + w) * dw + 0.5) AS x1, floor((y + h) * dh + 0.5) AS y1 FROM d, r)
    SELECT label, (x - dx - x0)::INT AS x, (y - dy - y0)::INT AS y, {Q.micro('v')} AS v, 0 AS inference_ms FROM tall JOIN c USING (label) WHERE x >= dx + x0 AND x < dx + x1 AND y >= dy + y0 AND y < dy + y1""")
def c27_crop_finished(spark, sf_dir):
    """A finished result of one part of the image is cropped to a smaller part, without the model."""
    done, target = G.rect(*map(F.lit, _DONE)), G.rect(*map(F.lit, _TARGET))
    tall = B.tall(spark, sf_dir)
    sizes = tall.groupBy("label").agg((F.max("y") + 1).alias("height"))
    part = G.pixels(done, F.lit(64), c("height"))
    sizes = sizes.withColumn("d", part).withColumn("t", G.pixels(G.relative(done, target), c("d.w"), c("d.h")))
    rows = tall.join(sizes, "label").where(G.contains(done, target))
    rows = rows.withColumn("y", c("y") - c("d.y") - c("t.y")).where((c("y") >= 0) & (c("y") < c("t.h")))
    cut = rows.select("label", c("y").cast("int").alias("y"), F.posexplode(F.slice("plane", (c("d.x") + c("t.x") + 1).cast("int"), c("t.w").cast("int"))).alias("x", "v"))
    return cut.select("label", "x", "y", micro(c("v")).alias("v"), F.lit(0).alias("inference_ms"))


@query(f"WITH {Q.TALL} SELECT label, {Q.micro('avg(v)')} AS mean, count(*) FILTER (WHERE v > 0.5) AS n FROM tall WHERE x BETWEEN 8 AND 40 AND y BETWEEN 2 AND 20 GROUP BY label")
def c25_box_mean(spark, sf_dir):
    return _tall_pixels(spark, sf_dir).where("x between 8 and 40 and y between 2 and 20").groupBy("label").agg(micro(F.avg("v")).alias("mean"), F.count_if(c("v") > 0.5).alias("n"))


@query(f"WITH {Q.RGBA} SELECT r.vec_id, CASE WHEN q.vec_id IS NULL THEN 'no-longer-available' END AS error, sum(CASE WHEN q.vec_id IS NULL THEN 0 ELSE {_ON('r', 255)} END)::BIGINT AS total FROM rgba r LEFT JOIN (SELECT DISTINCT vec_id FROM rgba WHERE label <> 3) q USING (vec_id) GROUP BY ALL".replace("SELECT r.vec_id", "SELECT r.vec_id AS vec_id"))
def c28_render_finished(spark, sf_dir):
    asked = B.planes(spark, sf_dir).select("vec_id")
    finished = M.composed(B.rgba(spark, sf_dir).where("label <> 3"), (255, 255, 255)).select("vec_id", "r")
    total = F.coalesce(F.aggregate("r", F.lit(0).cast("long"), lambda s, v: s + v), F.lit(0))
    return asked.join(finished, "vec_id", "left").select("vec_id", F.when(c("r").isNull(), "no-longer-available").alias("error"), total.alias("total"))


@query(f"WITH {Q.RGBA}, n AS (SELECT vec_id, x, y, r AS v, coalesce(lag(r) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS l, coalesce(lag(r) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS u FROM rgba), d AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE coalesce(lag(l) OVER (PARTITION BY vec_id, x ORDER BY y), 0) END AS c FROM n), e AS (SELECT *, abs(l + u - c - l) AS pa, abs(l + u - c - u) AS pb, abs(l + u - c - c) AS pc FROM d) SELECT vec_id, x, y, ((v - CASE WHEN pa <= pb AND pa <= pc THEN l WHEN pb <= pc THEN u ELSE c END) & 255)::INT AS f FROM e")
def w02_paeth(spark, sf_dir):
    at = lambda x, y: F.when((x >= 0) & (y >= 0), c("r")[F.greatest(F.lit(0), y) * 4 + F.greatest(F.lit(0), x)]).otherwise(0)
    px = B.rgba(spark, sf_dir).select("vec_id", "r", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")).withColumn("x", c("p") % 4).withColumn("y", F.floor(c("p") / 4).cast("int"))
    px = px.select("vec_id", "x", "y", c("r")[c("p")].alias("v"), at(c("x") - 1, c("y")).alias("l"), at(c("x"), c("y") - 1).alias("u"), at(c("x") - 1, c("y") - 1).alias("k"))
    pa, pb, pc = F.abs(c("u") - c("k")), F.abs(c("l") - c("k")), F.abs(c("l") + c("u") - 2 * c("k"))
    guess = F.when((pa <= pb) & (pa <= pc), c("l")).when(pb <= pc, c("u")).otherwise(c("k"))
    return px.select("vec_id", "x", "y", (c("v") - guess).bitwiseAND(F.lit(255)).alias("f"))


@query()
def k01_png(spark, sf_dir):
    return png.to_png(B.rgba(spark, sf_dir), "vec_id", 4, 4)


@query()
def k04_png_on_colour(spark, sf_dir):
    return png.to_png(M.composed(B.rgba(spark, sf_dir), (255, 255, 255)), "vec_id", 4, 4)


@query()
def k05_thumbnail(spark, sf_dir):
    """Thumbnails of the images: resampled with premultiplied colours, then PNG."""
    return png.to_png(_smaller(B.rgba(spark, sf_dir), 4, 2), "vec_id", 2, 2)


@query()
def k06_preview(spark, sf_dir):
    return png.to_png(_smaller(B.rgba(spark, sf_dir), 4, 3), "vec_id", 3, 3)


def _smaller(df: DataFrame, n: int, to: int) -> DataFrame:
    df = df.withColumn("_a", F.transform("a", lambda v: v.cast("double")))
    df = resampled(df, "_a", n, n, to, to, "triangle", "_a2")
    for k in "rgb":
        df = df.withColumn(f"_{k}", M.each(lambda v, a: v * a / 255.0, k, "a"))
        df = resampled(df, f"_{k}", n, n, to, to, "triangle", f"_{k}2")
        df = df.withColumn(k, M.each(lambda v, a: F.when(a == 0, 0).otherwise(F.least(F.lit(255), half_up(v * 255.0 / a))).cast("int"), f"_{k}2", "_a2"))
    return df.withColumn("a", F.transform("_a2", lambda v: half_up(v).cast("int"))).select("vec_id", *"rgba")


@query()
def k13_png_chunks(spark, sf_dir):
    return B.files(spark, sf_dir).select("page_id", png.frame_column("IDAT", c("content")).alias("chunk"))


@query()
def x07_crc32(spark, sf_dir):
    return B.files(spark, sf_dir).select("page_id", F.crc32("content").alias("crc"))
