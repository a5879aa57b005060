"""Scan tables derived from the driver's tables, and the same ones as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SIDE, CLASSES = 32, 4
#: Voxels that a task makes of a table's rows.
MADE = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str, cells: int) -> DataFrame:
    """Rows of a small table, each of which becomes so many cells, dealt out by their key: the table's few splits would be as few tasks.

    Whatever is grouped, joined or ordered by the key and more columns later finds its rows in place.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * cells // MADE))
    return rows.repartition(tasks, key)


def blob_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32 x 32 label map and its prediction for every part: ring 1, core 2, and a corner square 3 for some."""
    p = read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS uid", "cast(8 + p_partkey % 17 AS int) AS cx", "cast(8 + (p_partkey * 7) % 17 AS int) AS cy", "2 + p_size % 6 AS r",
        "cast(p_partkey % 3 - 1 AS int) AS sx", "p_size % 3 - 1 AS sy", "cast(p_partkey % 2 AS int) AS dr", "p_size",
    )
    grid = spread(p, "uid", SIDE * SIDE).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return grid.selectExpr(
        "uid", "x", "y", "0 AS z", "p_size",
        "CASE WHEN (x-cx)*(x-cx)+(y-cy)*(y-cy) <= (r*r) div 4 THEN 2 WHEN (x-cx)*(x-cx)+(y-cy)*(y-cy) <= r*r THEN 1 WHEN uid % 3 = 0 AND x < 2 AND y < 2 THEN 3 ELSE 0 END AS label_true",
        "CASE WHEN uid % 10 = 7 THEN 0 WHEN (x-cx-sx)*(x-cx-sx)+(y-cy-sy)*(y-cy-sy) <= ((r+dr)*(r+dr)) div 4 THEN 2 WHEN (x-cx-sx)*(x-cx-sx)+(y-cy-sy)*(y-cy-sy) <= (r+dr)*(r+dr) THEN 1 WHEN uid % 4 = 0 AND x < 2 AND y < 3 THEN 3 ELSE 0 END AS label_pred",
    )


BLOB = """p AS (SELECT p_partkey AS uid, cast(8 + p_partkey % 17 AS int) AS cx, cast(8 + (p_partkey * 7) % 17 AS int) AS cy, 2 + p_size % 6 AS r,
  cast(p_partkey % 3 - 1 AS int) AS sx, p_size % 3 - 1 AS sy, cast(p_partkey % 2 AS int) AS dr, p_size FROM part),
blob AS (SELECT uid, x, y, 0 AS z, p_size,
  CASE WHEN (x-cx)*(x-cx)+(y-cy)*(y-cy) <= (r*r) // 4 THEN 2 WHEN (x-cx)*(x-cx)+(y-cy)*(y-cy) <= r*r THEN 1 WHEN uid % 3 = 0 AND x < 2 AND y < 2 THEN 3 ELSE 0 END AS label_true,
  CASE WHEN uid % 10 = 7 THEN 0 WHEN (x-cx-sx)*(x-cx-sx)+(y-cy-sy)*(y-cy-sy) <= ((r+dr)*(r+dr)) // 4 THEN 2 WHEN (x-cx-sx)*(x-cx-sx)+(y-cy-sy)*(y-cy-sy) <= (r+dr)*(r+dr) THEN 1
    WHEN uid % 4 = 0 AND x < 2 AND y < 3 THEN 3 ELSE 0 END AS label_pred
  FROM p CROSS JOIN (SELECT unnest(range(0, 32))::INT AS x) CROSS JOIN (SELECT unnest(range(0, 32))::INT AS y))"""


def blob_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS uid", f"array({SIDE}, {SIDE}, 1) AS shape", "array(1.0D, 0.5D + 0.25D * (p_size % 3), 1.0D) AS spacing")


BLOB_HEADERS = "heads AS (SELECT p_partkey AS uid, 1.0::DOUBLE AS s1, 0.5::DOUBLE + 0.25::DOUBLE * (p_size % 3) AS s2, 1.0::DOUBLE AS s3 FROM part)"


#: Voxels of a noise image; order keys that one group of lines spans.
VOXELS, SPAN = 480, 1 << 20
_LABEL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_NOISE = [
    f"l_suppkey * 1000000 + l_orderkey {{div}} {SPAN} * 10000 + rn {{div}} {VOXELS} AS uid", "CAST(rn % 24 AS INT) AS x", f"CAST(rn % {VOXELS} {{div}} 24 AS INT) AS y", "0 AS z", f"{_LABEL} AS label_true",
    f"CASE WHEN l_quantity % 4 = 0 THEN CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END ELSE {_LABEL} END AS label_pred", "l_discount * 10 AS p_soft", "l_extendedprice AS value",
]
_FILL = [f"l_suppkey * 1000000 + span * 10000 + rn {{div}} {VOXELS} AS uid", *_NOISE[1:4], "0 AS label_true", "0 AS label_pred", "CAST(0 AS DOUBLE) AS p_soft", "CAST(0 AS DOUBLE) AS value"]


def noise_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many 24 x 20 images as a supplier's lines fill, the last one filled up with zeros.

    Lines are numbered within a supplier and a span of order keys, so that a supplier with most of the lines is many groups.
    """
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows, span = read(spark, sf_dir, "lineitem"), F.expr(f"l_orderkey div {SPAN}")
    lines = rows.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey", span).orderBy(*order)) - 1)
    fill = rows.groupBy("l_suppkey", span.alias("span")).agg(F.count("*").alias("n")).where(f"n % {VOXELS} > 0")
    fill = fill.withColumn("rn", F.explode(F.sequence("n", F.expr(f"(n div {VOXELS} + 1) * {VOXELS} - 1"))))
    return lines.selectExpr(*[c.format(div="div") for c in _NOISE]).unionByName(fill.selectExpr(*[c.format(div="div") for c in _FILL]))


NOISE = f"""lines AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey // {SPAN} ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS rn FROM lineitem),
fill AS (SELECT l_suppkey, span, unnest(range(n, (n // {VOXELS} + 1) * {VOXELS})) AS rn FROM (SELECT l_suppkey, l_orderkey // {SPAN} AS span, count(*) AS n FROM lineitem GROUP BY ALL) WHERE n % {VOXELS} > 0),
noise AS (SELECT {", ".join(_NOISE).format(div="//")} FROM lines UNION ALL SELECT {", ".join(_FILL).format(div="//")} FROM fill)"""


def emb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images from vectors of length 64."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), F.posexplode("embedding").alias("pos", "value")).selectExpr("uid", "cast(pos div 8 AS int) AS x", "pos % 8 AS y", "0 AS z", "0 AS channel", "cast(value AS double) AS value")


EMB = "e AS (SELECT vec_id AS uid, label, unnest(embedding)::DOUBLE AS value, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings), emb AS (SELECT uid, pos // 8 AS x, pos % 8 AS y, 0 AS z, 0 AS channel, value FROM e)"


def emb_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four class scores for 16 voxels of each vector, and a true label."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "label", F.posexplode("embedding").alias("pos", "value"))
    return e.selectExpr("uid", "cast(pos div 4 AS int) AS v", "pos % 4 AS cls", "10 * cast(value AS double) AS logit", "cast((label + pos div 4) % 4 AS int) AS label_true")


LOGITS = "e AS (SELECT vec_id AS uid, label, unnest(embedding)::DOUBLE AS value, unnest(range(0, len(embedding)))::INT AS pos FROM embeddings), logits AS (SELECT uid, pos // 4 AS v, pos % 4 AS cls, 10 * value AS logit, (label + pos // 4) % 4 AS label_true FROM e)"


def loss_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of timesteps 0 to 49 in batches of 64."""
    return read(spark, sf_dir, "events").selectExpr("event_id div 64 AS batch_id", "cast(event_id % 64 AS int) AS pos", "cast(user_id % 50 AS int) AS t_index", "value / 100 AS loss", "ts")


STEPS = 50
LOSSES = "losses AS (SELECT event_id // 64 AS batch_id, (event_id % 64)::INT AS pos, (user_id % 50)::INT AS t_index, value / 100 AS loss, ts FROM events)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def uniform_sql(seed: int, name: str, key: str = "uid") -> str:
    """The keyed uniform draw in DuckDB's words."""
    return f"(('0x' || substr(md5('{seed}|{name}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def around_sql(most: float, p: float, neutral: float, seed: int, name: str, key: str = "uid") -> str:
    return f"CASE WHEN {uniform_sql(seed, name + '/on', key)} < {p} THEN {neutral} + (2 * {uniform_sql(seed, name, key)} - 1) * {most!r}::DOUBLE ELSE {neutral}::DOUBLE END"


#: Ultrasound-like masks: width and height.
US_SHAPE = (64, 48)
_US_FAR = "(x-20-uid%9)*(x-20-uid%9)*(12+uid%3)*(12+uid%3) + (y-16-uid%7)*(y-16-uid%7)*(13+uid%4)*(13+uid%4) <= (12+uid%3)*(12+uid%3)*(13+uid%4)*(13+uid%4)"
_US = [
    f"CAST(CASE WHEN {_US_FAR} THEN 1 ELSE 0 END AS INT) AS label_true",
    f"""CAST(CASE WHEN (x*5+y*11+uid*3)%53 = 0 OR (x-20-uid%9)*(x-20-uid%9)+(y-16-uid%7)*(y-16-uid%7) <= uid%4*2 THEN 0 WHEN {_US_FAR} THEN 1
  WHEN (x-49)*(x-49)*(11+uid%2)*(11+uid%2) + (y-30-uid%5)*(y-30-uid%5)*(9+uid%6)*(9+uid%6) <= (11+uid%2)*(11+uid%2)*(9+uid%6)*(9+uid%6) THEN 1 WHEN (x*7+y*13+uid)%31 = 0 THEN 1 ELSE 0 END AS INT) AS label_pred""",
]


def us_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 x 48 mask for every supplier: an ellipse, and as its prediction that one with holes, another one, and specks."""
    grid = spread(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("uid")), "uid", US_SHAPE[0] * US_SHAPE[1]).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(US_SHAPE[0] - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(US_SHAPE[1] - 1))))
    return grid.selectExpr("uid", "x", "y", "0 AS z", *_US)


US = f"us AS (SELECT s_suppkey AS uid, x, y, {', '.join(_US).replace('uid', 's_suppkey')} FROM supplier CROSS JOIN (SELECT unnest(range(0, {US_SHAPE[0]}))::INT AS x) CROSS JOIN (SELECT unnest(range(0, {US_SHAPE[1]}))::INT AS y))"


def noise_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse voxels of volumes: eight noise images stacked, of which those with label 2 and a low score are foreground."""
    return noise_voxels(spark, sf_dir).where("label_true = 2 AND p_soft < 0.25").selectExpr("uid div 8 AS uid", "x", "y", "CAST(uid % 8 AS INT) AS z")
