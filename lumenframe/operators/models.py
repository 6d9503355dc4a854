"""Model files, model runs and graphs: manifests, chunk caches, inference, capability rules, order of nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.jobs import parts

MANIFEST = (
    "id string, version string, name string, input struct<name:string,width:int,height:int,mean:array<double>,std:array<double>>, output struct<name:string,width:int,height:int>, weights string, "
    "size long, sha256 string, parts array<struct<file:string,size:bigint,sha256:string>>, source struct<url:string,sha256:string,license:string,homepage:string>"
)


def valid_manifest(m: Column) -> Column:
    """All that a loader needs is there: id, size, digest, complete parts, input name and size, output name."""
    needed = [m["id"], m["size"], m["sha256"], m["input"]["name"], m["input"]["width"], m["input"]["height"], m["output"]["name"]]
    there = F.lit(True)
    for column in needed:
        there = there & column.isNotNull()
    each = F.forall(m["parts"], lambda p: p["file"].isNotNull() & p["size"].isNotNull() & p["sha256"].isNotNull())
    return F.coalesce(there & (F.size(m["parts"]) > 0) & each, F.lit(False))


def read_manifest(spark: SparkSession, path: str, cached: DataFrame | None = None) -> DataFrame:
    """The manifest at path, or the cached one where that cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).json(path, multiLine=True)
    except AnalysisException:
        if cached is None:
            raise
        return cached


def split_model(files: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Parts of at most `size` bytes, and one manifest row (JSON) for each file."""
    pieces = parts(files, key, size)
    file = F.concat(F.lit("part-"), F.lpad(F.col("idx").cast("string"), 3, "0"), F.lit(".bin"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("idx", file.alias("file"), F.col("size").cast("long").alias("size"), "sha256"))), lambda p: F.struct(p["file"].alias("file"), p["size"].alias("size"), p["sha256"].alias("sha256")))
    whole = files.select(key, F.sha2("content", 256).alias("sha256"))
    lists = pieces.groupBy(key).agg(listed.alias("parts"), F.sum(F.col("size").cast("long")).alias("size"))
    manifest = F.to_json(F.struct(F.col(key).cast("string").alias("id"), "size", "sha256", "parts"))
    return pieces, lists.join(whole, key).select(key, manifest.alias("manifest"))


def fill_cache(pieces: DataFrame, path: str) -> None:
    """Write parts that the cache at path lacks; a part that is there stays."""
    spark = pieces.sparkSession
    have = open_store(spark, path, "sha256 string, part binary, size int")
    to_cache(pieces, have).write.mode("append").parquet(path)


def open_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored at path, or an empty table of that schema where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clear_store(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def tried(run, attempts: int = 3):
    """run() up to `attempts` times; the last error goes on."""
    for k in range(attempts):
        try:
            return run()
        except OSError:
            if k + 1 == attempts:
                raise
    return None


def infer(inputs: DataFrame, runners: dict, key: str = "vec_id") -> DataFrame:
    """(key, input array<double>) -> key, output, backend, error.

    runners: backend name -> function that makes a runner of a batch (n x values ->
    n x values). They are tried in order; one that fails is not tried again in that
    task, and a batch that all refuse has an error and no output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = {name: make for name, make in runners.items()}
        ready: dict = {}
        for batch in batches:
            values, output, used, error = np.array(batch.column(1).to_pylist(), np.float32), None, None, "inference-failed"
            while left and output is None and batch.num_rows:
                used = next(iter(left))
                try:
                    ready.setdefault(used, None)
                    ready[used] = ready[used] or left[used]()
                    output = ready[used](values)
                except Exception as e:  # noqa: BLE001 - any backend error means the next backend
                    error = f"inference-failed: {e}"
                    del left[used]
            n = batch.num_rows
            out = pa.array([list(map(float, o)) for o in output] if output is not None else [None] * n, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array([used if output is not None else None] * n, pa.string()), pa.array([None if output is not None else error] * n, pa.string())], names=[key, "output", "backend", "error"])

    kind = inputs.schema[key].dataType.simpleString()
    return inputs.select(key, "input").mapInArrow(run, f"{key} {kind}, output array<double>, backend string, error string")


def onnx_runner(content: bytes, input_name: str):
    """A maker of runners of an ONNX model, one thread for each task."""

    def make():
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        session = ort.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        return lambda values: session.run(None, {input_name: values})[0].reshape(len(values), -1)

    return make


def with_cached(fresh: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, from_cache: what was read afresh, else what the cache holds."""
    both = fresh.select(key, F.col(value).alias("_fresh")).join(cached.select(key, F.col(value).alias("_cached")), key, "full")
    return both.select(key, F.coalesce("_fresh", "_cached").alias(value), F.col("_fresh").isNull().alias("from_cache"))


def to_cache(pieces: DataFrame, have: DataFrame) -> DataFrame:
    """Parts (sha256, part, size) that the cache lacks, each once."""
    return pieces.select("sha256", "part", "size").dropDuplicates(["sha256"]).join(have.select("sha256").distinct(), "sha256", "left_anti")


def attempted(tries: DataFrame, most: int = 3) -> DataFrame:
    """Of (part, attempt, ok, at): each part's outcome after at most `most` attempts: part, attempts, ok, at of the last one that was made.

    One aggregate for each part, so attempts are added up before they move.
    """
    made = tries.where(F.col("attempt") <= most)
    first = made.groupBy("part").agg(F.min(F.when(F.col("ok"), F.struct("attempt", "at"))).alias("good"), F.max(F.struct("attempt", "at")).alias("last"))
    end = F.coalesce("good", "last")
    return first.select("part", end["attempt"].alias("attempts"), F.col("good").isNotNull().alias("ok"), end["at"].alias("at"))


def missing_capability(has: dict[str, Column]) -> Column:
    """The first capability that is not there, in the given order; null if all are."""
    out = F.lit(None).cast("string")
    for name, there in reversed(list(has.items())):
        out = F.when(~F.coalesce(there, F.lit(False)), name).otherwise(out)
    return out


def platform(agent: Column) -> Column:
    """struct<ios, mobile> from a user agent text."""
    ios = agent.rlike("(?i)iphone|ipad|ipod")
    return F.struct(ios.alias("ios"), (ios | agent.rlike("(?i)android|mobile")).alias("mobile"))


def preview_side(width: Column, height: Column, ratio: Column) -> Column:
    """Longest side of a preview: the screen's, taken as 1280 at least, in device pixels of at most two a point, and 4096 at most."""
    return F.least(F.lit(4096), F.ceil(F.greatest(width, height, F.lit(1280)) * F.least(ratio, F.lit(2.0)))).cast("int")


def least_crop(side: Column) -> Column:
    """Smallest side of a crop as a share of the shown side: 32 points, half of it at most; 0.05 where nothing is shown."""
    return F.when(side > 0, F.least(F.lit(0.5), 32.0 / side)).otherwise(0.05)


def threads(cores: Column, isolated: Column) -> Column:
    """Threads for a model: all cores but one, from one to eight; one without isolation."""
    return F.when(isolated, F.greatest(F.lit(1), F.least(F.lit(8), cores - 1))).otherwise(1).cast("int")


def translated(keyed: DataFrame, catalog: DataFrame) -> DataFrame:
    """keyed (locale, key, and others) with text from catalog (locale, key, text); a key that the catalog lacks has none.

    A catalog has some hundred entries, so the planner broadcasts it.
    """
    return keyed.join(catalog.select("locale", "key", "text"), ["locale", "key"], "left")


def applied_attributes(rows: DataFrame, pairs: str, catalog: DataFrame) -> DataFrame:
    """rows with locale and `pairs` (attr:key;attr:key) -> one row for each attribute whose key the catalog has: all columns, attribute, key, text."""
    split = F.transform(F.split(pairs, ";"), lambda x: F.transform(F.split(x, ":"), lambda y: F.trim(y)))
    whole = F.filter(split, lambda x: (F.size(x) >= 2) & (F.get(x, F.lit(0)) != "") & (F.get(x, F.lit(1)) != ""))
    each = rows.withColumn("_pair", F.explode(whole)).withColumn("attribute", F.get("_pair", F.lit(0))).withColumn("key", F.get("_pair", F.lit(1))).drop("_pair")
    return translated(each, catalog).where("text is not null")


def attribute_keys(text: Column) -> Column:
    """attr:key;attr:key -> map."""
    return F.str_to_map(text, F.lit(";"), F.lit(":"))


def over_buffers(edges: DataFrame, most: int = 8) -> DataFrame:
    """Nodes of (node, tensor, direction) with more than `most` inputs and outputs."""
    return edges.groupBy("node").agg(F.count("*").alias("buffers")).where(F.col("buffers") > most)


def producers(edges: DataFrame) -> DataFrame:
    """(producer, consumer, tensor): outputs joined with the inputs that read them."""
    made = edges.where("direction = 'out'").select(F.col("node").alias("producer"), "tensor")
    used = edges.where("direction = 'in'").select(F.col("node").alias("consumer"), "tensor")
    return made.join(used, "tensor").select("producer", "consumer", "tensor")


def execution_order(edges: list[tuple[str, str]], nodes: list[str]) -> list[str]:
    """Depth-first order in which every node follows its producers. A model's graph is small; raises on a cycle."""
    before: dict[str, list[str]] = {n: [] for n in nodes}
    for producer, consumer in edges:
        before[consumer].append(producer)
    out: list[str] = []
    mark: dict[str, int] = {}
    for start in nodes:
        stack = [(start, iter(before[start]))] if start not in mark else []
        mark.setdefault(start, 1) if stack else None
        while stack:
            node, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                mark[node] = 2
                out.append(node)
            elif mark.get(step) == 1:
                raise ValueError(f"cycle at {step}")
            elif step not in mark:
                mark[step] = 1
                stack.append((step, iter(before[step])))
    return out


def deformed(plane: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bilinear samples of a plane at shifted places times a mask; outside is zero."""
    h, w = plane.shape
    x0, y0 = np.floor(at_x).astype(int), np.floor(at_y).astype(int)
    out = np.zeros(at_x.shape)
    for dy in (0, 1):
        for dx in (0, 1):
            x, y = x0 + dx, y0 + dy
            inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            weight = (1 - np.abs(at_x - x)) * (1 - np.abs(at_y - y))
            out += np.where(inside, plane[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] * weight, 0.0)
    return out * mask


def deformed_plane(plane: Column, width: int, height: int, dx: Column, dy: Column, mask: Column) -> Column:
    """The same for planes as array columns: each pixel is read at its place plus (dx, dy), between its four neighbours, times mask."""

    def one(p: Column) -> Column:
        at_x, at_y = p % width + F.get(dx, p), F.floor(p / width) + F.get(dy, p)
        x0, y0 = F.floor(at_x), F.floor(at_y)
        total = F.lit(0.0)
        for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
            x, y = x0 + i, y0 + j
            inside = x.between(0, width - 1) & y.between(0, height - 1)
            total = total + F.when(inside, F.get(plane, (y * width + x).cast("int")) * (1 - F.abs(at_x - x)) * (1 - F.abs(at_y - y))).otherwise(0.0)
        return total * F.get(mask, p)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), one)


def half_floats(values: np.ndarray) -> np.ndarray:
    """As 16-bit floats; larger than 60000 does not fit well and is refused."""
    if np.abs(values).max(initial=0) > 60000:
        raise ValueError("out of the range of 16-bit floats")
    return values.astype(np.float16)


def manifest_of(text: str) -> dict:
    return json.loads(text)
