"""The engine's operators: invariants, closed forms, and all oracle statements."""

import datetime
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.functions import headers as H
from lumenframe.functions import names as N
from lumenframe.functions import planes as P
from lumenframe.functions import sizing as S
from lumenframe.operators import images as I
from lumenframe.operators import jobs as J
from lumenframe.operators import matting as M
from lumenframe.operators import resample as R
from lumenframe.operators.images import cut
from lumenframe.plans import ORACLE_SQL, QUERIES
from lumenframe.sources import png
from lumenframe.streaming import jobs as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not isinstance(v, (list, bytes, bytearray)) and pd.isna(v)):
            return None
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v) if isinstance(v, str) else int(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("size", [(4032, 1024), (1024, 4032), (10, 10), (7, 3)])
@pytest.mark.parametrize("kind", ["box", "triangle", "bicubic"])
def test_weights_sum_to_one(size, kind):
    w = P.coefficients(*size, kind)
    assert w.sum(axis=1) == pytest.approx(1)
    if size[0] == size[1]:
        assert w == pytest.approx(np.eye(10))


def plane(spark, values):
    return spark.createDataFrame([(1, [float(v) for v in np.ravel(values)])], "id int, v array<double>")


@pytest.mark.parametrize("kind", ["box", "triangle", "bicubic"])
def test_constant_stays_constant(spark, kind):
    df = P.resampled(plane(spark, np.full((10, 20), 0.25)), "v", 20, 10, 7, 13, kind, "o")
    assert df.first().o == pytest.approx([0.25] * 91)


def test_literal_and_arrow_forms_agree(spark, monkeypatch):
    v = np.random.default_rng(0).random((6, 5))
    df = plane(spark, v)
    monkeypatch.setattr(P, "LITERAL_TERMS", 10_000)
    a = P.resampled(df, "v", 5, 6, 3, 8, "bicubic", "o").first().o
    monkeypatch.setattr(P, "LITERAL_TERMS", 0)
    b = P.resampled(df, "v", 5, 6, 3, 8, "bicubic", "o").first().o
    px = df.select("id", F.posexplode("v").alias("p", "v")).select("id", (F.col("p") % 5).alias("x"), F.floor(F.col("p") / 5).cast("int").alias("y"), "v")
    c = [r.v for r in R.resample_pixels(px, ["id"], (5, 6), (3, 8), "bicubic").orderBy("y", "x").collect()]
    want = (P.coefficients(6, 8, "bicubic") @ v @ P.coefficients(5, 3, "bicubic").T).ravel()
    assert a == pytest.approx(want) and b == pytest.approx(want) and c == pytest.approx(want)


def test_stripes_halve(spark):
    stripes = np.tile([0.0, 255.0], (2, 2))
    assert P.resampled(plane(spark, stripes), "v", 4, 2, 2, 1, "box", "o").first().o == pytest.approx([127.5, 127.5])


def test_blur_impulse(spark):
    v = np.zeros((5, 9))
    v[2, 4] = 25
    out = np.array(P.blurred(plane(spark, v), "v", 9, 5, 2, "o").first().o).reshape(5, 9)
    assert out[2, 4] == pytest.approx(1) and out[0, 0] == 0
    flat = P.blurred(plane(spark, np.full((5, 9), 3.0)), "v", 9, 5, 2, "o").first().o
    assert flat == pytest.approx([3.0] * 45)


def test_wide_blur_equals_narrow_form(spark):
    v = np.random.default_rng(2).random((3, 70))
    px = plane(spark, v).select("id", F.posexplode("v").alias("p", "v")).select("id", (F.col("p") % 70).alias("x"), F.floor(F.col("p") / 70).cast("int").alias("y"), "v")
    got = [r.v for r in R.blur_pixels(px, ["id"], 20).orderBy("y", "x").collect()]
    assert got == pytest.approx((P.box(3, 20) @ v @ P.box(70, 20).T).ravel())


def scene(spark, w=24, h=8):
    """A soft edge between two colours, as an image and its matte."""
    a = np.clip((np.arange(w) - 6) / 12, 0, 1)
    alpha = np.rint(np.tile(a, (h, 1)) * 255).astype(int)
    fg, bg = (230, 120, 40), (20, 200, 60)
    mix = [np.rint(f * alpha / 255 + b * (1 - alpha / 255)).astype(int) for f, b in zip(fg, bg, strict=True)]
    row = [1, *[m.ravel().tolist() for m in mix], [255] * (w * h), alpha.ravel().tolist()]
    return spark.createDataFrame([row], "vec_id int, r array<int>, g array<int>, b array<int>, a array<int>, alpha array<int>"), fg, mix, alpha


@pytest.mark.parametrize("work", [2_000_000, 60])
def test_foreground_halves_the_error(spark, work):
    df, fg, mix, alpha = scene(spark)
    out = M.foreground(df, 24, 8, (12, 3), work).first()
    soft = (alpha > 20) & (alpha < 235)
    for k, c in enumerate("rgb"):
        got = np.array(out[c]).reshape(alpha.shape)
        assert np.abs(got - fg[k])[soft].mean() < 0.6 * np.abs(mix[k] - fg[k])[soft].mean() + 1
        assert (got[alpha == 0] == 0).all() and (got[alpha == 255] == mix[k][alpha == 255]).all()
    assert out["a"] == alpha.ravel().tolist()


def test_png_round_trip(spark, tmp_path):
    i = np.arange(37 * 23 * 4)
    image = ((i * 7919 + (i >> 3) * 31) & 255).astype(np.uint8).reshape(23, 37, 4)
    data = png.encode(image)
    assert (png.decode(data) == image).all()
    kinds, at = [], 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4])
        kinds.append(data[at + 4 : at + 8])
        at += 12 + n
    assert kinds == [b"IHDR", b"IDAT", b"IEND"]
    with pytest.raises(ValueError):
        png.encode(image[..., :3])
    (tmp_path / "a.png").write_bytes(data)
    (tmp_path / "b.png").write_bytes(b"no image")
    read = {r.path.rsplit("/", 1)[1]: r for r in png.decoded(png.read_images(spark, str(tmp_path), "*.png")).collect()}
    assert read["a.png"].rgba == image.tobytes() and read["a.png"].error is None
    assert read["b.png"].error and read["b.png"].rgba is None


def test_png_frames(spark):
    assert zlib.crc32(b"123456789") == 0xCBF43926
    got = spark.range(1).select(png.frame_column("IDAT", F.lit(bytearray(b"123456789"))).alias("c")).first().c
    assert bytes(got) == png.framed(b"IDAT", b"123456789")


@pytest.mark.parametrize(("name", "want"), [("portrait.jpg", "portrait"), ("C:\\pics\\a b.png", "a-b"), ("../x/..", "image"), ("con.txt", "image-con"), ("a" * 100, "a" * 80), ("  --..x?y<z>.jpeg", "x-y-z"), (None, "image"), ("e\u0301.png", "\u00e9"), ("tab\there", "tab-here")])
def test_base_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(N.base_name(N.nfc("n")).alias("b")).first().b == want


def test_plan_gives_up_pixels(spark):
    df = spark.createDataFrame([(10, 10, 99, 100), (3, 3, 8, 100), (100, 50, 10**9, 60), (7, 5, 35, 100), (1, 1, 1, 1)], "w long, h long, m long, s long")
    got = df.select(S.plan(F.col("w"), F.col("h"), F.col("m"), F.col("s")).alias("p"), "m", "s").collect()
    assert all(r.p.width * r.p.height <= r.m and max(r.p.width, r.p.height) <= r.s for r in got)
    assert [tuple(r.p) for r in got] == [(9, 9, True), (2, 2, True), (60, 30, True), (7, 5, False), (1, 1, False)]


def test_jpeg_frames(spark):
    head = bytes.fromhex("FFD8FFFFE000104A46494600010100000100010000FFD0FFC0001108012C02010301220002110103110100000000")
    bad = bytes.fromhex("FFD8FFDA0000000000000000000000")
    df = spark.createDataFrame([(bytearray(head),), (bytearray(bad),), (None,)], "b binary")
    assert [tuple(r.s) for r in df.select(H.jpeg_size("b").alias("s")).collect()] == [(513, 300), (None, None), (None, None)]


def test_formats_of_short_and_odd_files(spark):
    cases = {b"": None, b"\xff\xd8\xff": None, b"\xff\xd8\xff" + bytes(9): "jpeg", b"BM" + bytes(20): None, b"BM" + bytes(24): "bmp", bytes(4) + b"ftypheic": "heic", (24).to_bytes(4) + b"ftypmif1" + bytes(4) + b"zzzzavif": "avif", (20).to_bytes(4) + b"ftypmif1" + bytes(4) + b"zzzz": "heic"}
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "k int, b binary")
    assert [r.f for r in df.orderBy("k").select(H.image_format(F.col("b")).alias("f")).collect()] == list(cases.values())


def test_rect_pixels_are_never_empty(spark):
    r = G.rect(F.lit(0.999), F.lit(0.0), F.lit(1e-6), F.lit(1e-6))
    assert tuple(spark.range(1).select(G.pixels(r, F.lit(10), F.lit(10)).alias("p")).first().p) == (9, 0, 1, 1)


def test_locale_texts(spark):
    row = spark.range(1).select(N.megabytes(F.lit(4_200_000)).alias("a"), N.megabytes(F.lit(1_234_000_000), "de").alias("b"), N.filled(F.lit("{n} of {m}"), {"n": F.lit(1), "m": F.lit("x")}).alias("c")).first()
    assert tuple(row) == ("4.2 MB", "1.234 MB", "1 of x")


def state_of(spark, events):
    df = spark.createDataFrame([(1, k, *e) for k, e in enumerate(events)], "log int, k int, type string, job long, stage string")
    return J.folded(df, "log", "k").first().state


def test_reducer_logs(spark):
    happy = [("select", 1, None), ("stage", 1, "decoding"), ("stage", 1, "inference"), ("preview", 1, None), ("png", 1, None)]
    assert tuple(state_of(spark, happy))[:4] == ("complete", 1, None, True)
    assert state_of(spark, [("select", 1, None), ("select", 2, None), ("preview", 1, None)]).job == 2
    assert state_of(spark, [*happy, ("stage", 1, "decoding")]).view == "complete"
    assert state_of(spark, [("select", 1, None), ("cancel", 1, None), ("preview", 1, None)]).view == "cancelled"
    failed = state_of(spark, [("select", 1, None), ("model-error", None, None)])
    assert (failed.view, failed.model) == ("error", "error")
    ready = state_of(spark, [("model-ready", None, None), ("model-progress", None, None), ("fallback", None, None)])
    assert (ready.model, ready.fell_back, ready.view) == ("ready", True, "idle")


def test_retention(spark):
    now = datetime.datetime(2024, 3, 1)
    ages = [29, 31, *[k / 100 for k in range(15)], 30]
    df = spark.createDataFrame([(1, k, now - datetime.timedelta(days=a)) for k, a in enumerate(ages)], "owner int, id int, created timestamp_ntz")
    kept = J.newest(df, F.lit(now).cast("timestamp_ntz"))
    assert sorted(r.id for r in kept.collect()) == list(range(2, 14))
    few = J.newest(df.where("id in (0, 1, 17)"), F.lit(now).cast("timestamp_ntz"))
    assert sorted(r.id for r in few.collect()) == [0, 17]


def test_parts_round_trip_and_damage(spark):
    df = spark.createDataFrame([(1, bytearray(range(250))), (2, bytearray(b""))], "id int, content binary")
    pieces = J.parts(df, "id", 100)
    assert {(r.id, bytes(r.content)) for r in J.joined_parts(pieces, "id").collect()} == {(1, bytes(range(250))), (2, b"")}
    cache = pieces.select("sha256", F.when(F.col("idx") == 1, 99).otherwise(F.col("size")).alias("size"))
    assert sorted((r.id, r.idx, r.hit) for r in J.cached_parts(pieces, cache).collect()) == [(1, 0, True), (1, 1, False), (1, 2, True), (2, 0, True)]


def test_stream_supersession_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS session", "event_id AS job", "event_type AS stage", "event_id AS at", "ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.supersede(stream.drop("ts")).writeStream.format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("latest").groupBy("session").agg(F.max_by("job", F.col("job")).alias("job"))
    want = events.groupBy("session").agg(F.max("job").alias("job"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.table("latest").count() == events.count()


def test_stream_into_history(spark, sf_dir, tmp_path):
    history = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS owner", "event_id AS id", "ts AS created")
    history.write.parquet(str(tmp_path / "in"))
    now = F.expr("TIMESTAMP_NTZ '2024-02-25 00:00:00'")
    stream = spark.readStream.schema(history.schema).parquet(str(tmp_path / "in"))
    streaming.keep_history(stream, str(tmp_path / "h"), str(tmp_path / "c"), now).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "h" / "v0")).select("owner", "id")
    want = J.newest(history, now).select("owner", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def photo(width, height):
    """A disc with a soft edge on a pattern, and its matte."""
    y, x = np.mgrid[:height, :width]
    alpha = np.clip((0.4 - np.hypot(x - width / 2, y - height / 2) / min(width, height)) * 20 * 255, 0, 255).astype(np.uint8)
    return np.dstack([x * 255 // width, y * 255 // height, (x + y) % 256, np.full_like(x, 255)]).astype(np.uint8), alpha


@pytest.mark.parametrize("work", [2_000_000, 60])
def test_image_pass_equals_planes(spark, work):
    df, _, mix, alpha = scene(spark)
    rgba = np.dstack([*mix, np.full_like(alpha, 255)]).astype(np.uint8)
    got, want = cut(rgba, alpha.astype(np.uint8), (12, 3), work), M.foreground(df, 24, 8, (12, 3), work).first()
    for k, c in enumerate("rgba"):
        assert got[..., k].ravel().tolist() == want[c]


def test_image_pass_in_strips(monkeypatch):
    rgba, alpha = photo(70, 41)
    whole = cut(rgba, alpha, (9, 2), 500)
    monkeypatch.setattr(I, "STRIP", 140)
    assert (cut(rgba, alpha, (9, 2), 500) == whole).all()
    monkeypatch.setattr(png, "ROWS", 300)
    assert (png.decode(png.encode(whole)) == whole).all()


def test_image_rows(spark):
    rgba, alpha = photo(30, 20)
    rows = [(1, 30, 20, rgba.tobytes(), alpha.tobytes()), (2, 30, 21, rgba.tobytes(), alpha.tobytes()), (None, None, 20, None, None), (4, 0, 0, b"", b""), (1, 30, 20, rgba.tobytes(), bytes(600))]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id int, width int, height int, rgba binary, alpha binary, error string, _key int")
    made = I.cut_images(df, "id", packed=True).collect()
    assert sorted(((r.id, r.error) for r in made), key=repr) == sorted([(1, None), (1, None), (2, "size and bytes differ"), (None, "no image"), (4, "no image")], key=repr)
    images = [png.decode(bytes(r.png)) for r in made if r.png]
    assert (images[0] == cut(rgba, alpha)).all() and not images[1].any()
    assert I.cut_images(df.limit(0), "id").count() == 0


def test_passes_equal_their_matrices():
    v = np.random.default_rng(3).random((7, 11))
    for p in (P.Sliding(11, 3), P.Sliding(11, 50), P.Sliding(11, 0), P.taps(11, 4, "box"), P.taps(11, 29, "bicubic"), M.bilinear(30, 11)):
        assert p.along(v, 1) == pytest.approx(v @ p.dense().T)
    assert P.Sliding(7, 2).along(v, 0) == pytest.approx(P.box(7, 2) @ v)
    assert P.Sliding(1, 4).along(v[:1], 0) == pytest.approx(v[:1])


def differences(spark, duck_at, name: str) -> int:
    """Rows that a query and its SQL do not share on the tables of a folder."""
    con = duckdb.connect()
    for path in duck_at.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, str(duck_at)).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    return len(Counter(rows(got)) - Counter(rows(want))) + len(Counter(rows(want)) - Counter(rows(got)))


def test_megabytes_halves_go_away_from_zero(spark, tmp_path):
    df = spark.createDataFrame([(49_999 * 1_500_000,), (2_250_000,), (150_000,), (9_950_000,), (10_500_000,), (12_500_000,)], "n long")
    assert [r[0] for r in df.select(N.megabytes(F.col("n"))).collect()] == ["74,999 MB", "2.3 MB", "0.2 MB", "10 MB", "11 MB", "13 MB"]
    pd.DataFrame({"event_id": [500_000, 1_500_000, 3_500_000]}).to_parquet(tmp_path / "events.parquet")
    assert differences(spark, tmp_path, "x04_megabytes") == 0


def test_inference_means_are_not_summed_in_32_bits(spark, tmp_path):
    v = np.random.default_rng(5).uniform(-0.5, 0.5, (400_000, 64)).astype(np.float32)
    share = (v.astype(np.float64) + 0.5).astype(np.float32)
    thousandths = lambda m: np.floor(np.floor(np.round(m.astype(np.float64), 4) * 1e6 + 0.5) / 1000)
    odd = np.flatnonzero(thousandths(share.mean(axis=1)) != thousandths(share.mean(axis=1, dtype=np.float64)))
    assert len(odd)  # rows that a 32-bit sum takes over a rounding's edge
    pd.DataFrame({"vec_id": np.arange(len(odd)), "embedding": list(v[odd]), "label": 0}).to_parquet(tmp_path / "embeddings.parquet")
    assert differences(spark, tmp_path, "c09_r09_inference") == 0


@pytest.mark.parametrize("name", ["r02_serial_queue", "w06_r07_throttle"])
def test_times_do_not_follow_the_session_zone(spark, tmp_path, name):
    n = 400  # every twenty minutes, over both changes of the clock in that zone
    at = np.concatenate([pd.date_range(day, periods=n // 2, freq="20min").to_numpy() for day in ("2024-03-09", "2024-11-02")]).astype("datetime64[us]")
    events = pd.DataFrame({"event_id": np.arange(n), "ts": at, "user_id": np.arange(n) % 3, "event_type": np.where(np.arange(n) % 5, "view", "click"), "value": np.arange(n) * 7 % 100 + 0.25, "props": "{}"})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert differences(spark, tmp_path, name) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_pixel_rows_in_strips(spark, monkeypatch):
    monkeypatch.setattr(I, "STRIP", 7)
    data = np.random.default_rng(2).integers(0, 256, (20, 4)).astype(np.uint8)
    df = spark.createDataFrame([(3, bytearray(data.tobytes())), (4, None)], "k int, rgba binary")
    got = I.pixel_rows(df, "k").orderBy("p").collect()
    assert [tuple(r) for r in got] == [(3, p, *map(int, v)) for p, v in enumerate(data)]
