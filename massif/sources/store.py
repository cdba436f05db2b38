"""Snapshots of datasets: immutable once published, written to attempts beside the final name and moved there whole."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.errors import AlreadyExists, CorruptData, NotFound

ATTRIBUTION = "idx INT, spatial_resolution DOUBLE, acquisition_date STRING, ingestion_date STRING, copyright STRING, copyright_link STRING, license STRING"
FIELDS = ("spatial_resolution", "acquisition_date", "ingestion_date", "copyright", "copyright_link", "license")


InvalidData = CorruptData


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def attempts(spark: SparkSession, final: str) -> list[str]:
    """Unpublished attempts at a snapshot, the oldest first."""
    fs, p = _fs(spark, final)
    if not fs.exists(p.getParent()):
        return []
    found = [str(s.getPath().toString()) for s in fs.listStatus(p.getParent())]
    return sorted(x for x in found if re.search(re.escape(f"/{p.getName()}.") + r"\d{8}T\d{12}\.part$", x))


def create_attempt(final: str) -> str:
    return f"{final}.{datetime.now(UTC):%Y%m%dT%H%M%S%f}.part"


def publish(spark: SparkSession, attempt: str, final: str) -> None:
    """Rename an attempt to the final name, which must not exist, and delete the other attempts. A lock file that only one
    writer can create keeps two from publishing at once; a writer that died holding it leaves a lock to be deleted by
    hand."""
    fs, p = _fs(spark, final)
    lock = _fs(spark, f"{final}.lock")[1]
    try:
        fs.create(lock, False).close()
    except Exception as held:
        raise AlreadyExists(f"{final}.lock") from held
    try:
        if fs.exists(p) or not fs.rename(_fs(spark, attempt)[1], p):
            raise AlreadyExists(final)
        for other in attempts(spark, final):
            fs.delete(_fs(spark, other)[1], True)
    finally:
        fs.delete(lock, False)


def save_nodes(nodes: DataFrame, attempt: str, *, stored: DataFrame | None = None) -> None:
    """Write nodes (level, index, ...) once each: duplicates, or keys already stored, are an error. Rows are sorted by key
    within ranges of keys, so that readers skip files and row groups by their statistics."""
    keys = nodes.select("level", "index")
    if keys.groupBy("level", "index").count().filter("count > 1").limit(1).count():
        raise AlreadyExists("a key is written twice")
    if stored is not None and keys.join(stored, ["level", "index"], "left_semi").limit(1).count():
        raise AlreadyExists("a key is stored already")
    nodes.repartitionByRange("level", "index").sortWithinPartitions("level", "index").write.mode("error").parquet(f"{attempt}/nodes")


def input_record(source: DataFrame, **parameters) -> dict:
    """What a snapshot is made from: the rows of its source, as their number and a sum of their hashes, whatever their
    order, the source's columns and the parameters."""
    cells = [F.col(f"`{c}`") for c in source.columns]
    found = source.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.xxhash64(*cells, F.lit(k)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"h{k}") for k in (0, 1)]).first()
    return {"rows": found["n"], "hashes": [found["h0"], found["h1"]], "columns": source.dtypes, "parameters": {k: v if isinstance(v, int | float | str | None) else repr(v) for k, v in parameters.items()}}


def write_record(spark: SparkSession, attempt: str, record: dict) -> None:
    """Store the inputs that a snapshot depends on."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "record string").coalesce(1).write.mode("overwrite").text(f"{attempt}/inputs")


def matches_record(spark: SparkSession, snapshot: str, record: dict) -> bool:
    """Whether a snapshot was made from equal inputs, so that its nodes can be used again."""
    return exists(spark, f"{snapshot}/inputs/_SUCCESS") and spark.read.text(f"{snapshot}/inputs").first()[0] == json.dumps(record, sort_keys=True)


def unfinished(work: DataFrame, done: DataFrame) -> DataFrame:
    """Keys of a work list without a finished one."""
    return work.join(done.select("level", "index"), ["level", "index"], "left_anti")


def link_unchanged(source: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the keys, content hash included, as they are."""
    return source.join(keys.select("level", "index"), ["level", "index"], "left_semi")


def link_hashed(source: DataFrame, keys: DataFrame, *cells: str) -> DataFrame:
    """Rows of `source` (level, index, hash, ...) for the keys, their hashes with them. Content that no longer has its
    recorded hash is an error, raised by the tasks that meet it; a key that the source lacks is left out."""
    same = F.col("hash") == content_hash(*[F.col(c) for c in cells])
    broken = F.raise_error(F.concat(F.lit("CorruptData: node "), F.col("level").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit(" does not have its hash"))).cast("long")
    return link_unchanged(source, keys).withColumn("hash", F.when(same, F.col("hash")).otherwise(broken))


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """`keys` (level, index) with their status, Missing if the index lacks them, and whether something is stored there."""
    found = keys.join(index.select("level", "index", "status"), ["level", "index"], "left").withColumn("status", F.coalesce("status", F.lit("Missing")))
    return found.withColumn("present", F.col("status").isin("Leaf", "Inner"))


def set_status(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the statuses of `changed` (level, index, status) set as they are, without a look at other keys; a
    Missing one goes."""
    kept = index.join(changed.select("level", "index"), ["level", "index"], "left_anti")
    return kept.unionByName(changed.filter("status <> 'Missing'").select("level", "index", "status"))


def link_subtree(source: DataFrame, level: int, index: int) -> DataFrame:
    """Rows of a node and all below it: on each level a range of indices."""
    below = F.call_function("shiftright", F.col("index"), (3 * F.greatest(F.col("level") - level, F.lit(0))).cast("int")) == index
    return source.filter((F.col("level") >= level) & below)


def content_hash(*cells: Column) -> Column:
    """Identity of content; the algorithm is this engine's own."""
    return F.xxhash64(*cells)


def changed(nodes: DataFrame, recorded: DataFrame, *cells: str) -> DataFrame:
    """Keys whose content isn't what was recorded for them."""
    now = nodes.select("level", "index", content_hash(*[F.col(c) for c in cells]).alias("now"))
    return now.join(recorded.select("level", "index", "hash"), ["level", "index"]).filter("now <> hash").select("level", "index")


def upgrade(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """A table of an older schema with the columns that newer ones have, filled with defaults."""
    return df.withColumns({c: d for c, d in added.items() if c not in df.columns})


def parse_attribution(spark: SparkSession, text: str) -> DataFrame:
    """The attribution table of a JSON array: one to 65535 objects, a numeric resolution and five texts each, by position.
    A small dimension by that bound, so it is parsed on the driver."""
    rows = json.loads(text)
    if not isinstance(rows, list) or not 1 <= len(rows) <= 65535:
        raise InvalidData("an attribution table has 1 to 65535 entries")
    for r in rows:
        number = isinstance(r.get("spatial_resolution"), int | float) and not isinstance(r["spatial_resolution"], bool)
        if not number or any(not isinstance(r.get(f), str) for f in FIELDS[1:]):
            raise InvalidData("an attribution entry lacks a field or has one of another type")
    return spark.createDataFrame([(i, float(r["spatial_resolution"]), *[r[f] for f in FIELDS[1:]]) for i, r in enumerate(rows)], ATTRIBUTION)


def read_attribution(spark: SparkSession, index_path: str) -> DataFrame:
    """The nearest source_attribution_table.json: beside an index file or up to two folders above."""
    folder = index_path.rsplit("/", 1)[0]
    for _ in range(3):
        path = f"{folder}/source_attribution_table.json"
        if exists(spark, path):
            return parse_attribution(spark, spark.read.text(path, wholetext=True).first()[0])
        folder = folder.rsplit("/", 1)[0]
    raise NotFound("source_attribution_table.json")


def read_subtiles(tiles: DataFrame, zoom: int, x: int, y: int, sx: tuple[int, int], sy: tuple[int, int]) -> DataFrame:
    """Rows of the subtiles of one tile that a half-open region meets; the filters reach the scan."""
    c = (F.col("zoom") == zoom) & (F.col("tx") == x) & (F.col("ty") == y)
    return tiles.filter(c & F.col("sx").between(sx[0], sx[1] - 1) & F.col("sy").between(sy[0], sy[1] - 1))


def subtiles(pixels: DataFrame, side: int) -> DataFrame:
    """Pixels grouped as subtiles (sx, sy, data), row-major."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("py", "px", "v"))), lambda s: s["v"])
    return pixels.groupBy(F.floor(F.col("px") / side).cast("long").alias("sx"), F.floor(F.col("py") / side).cast("long").alias("sy")).agg(rows.alias("data"))
