"""Queries of morphology and components."""

from pyspark.sql import functions as F

from voxloom.catalog import query
from voxloom.operators import morphology
from voxloom.plans.fixtures import BLOB, NOISE, US, US_SHAPE, blob_labels, noise_voxels, noise_volumes, us_masks, with_

SHAPE = (32, 32)
_DISK2 = "(SELECT i, j FROM (SELECT unnest(range(-2, 3))::INT AS i) CROSS JOIN (SELECT unnest(range(-2, 3))::INT AS j) WHERE i * i + j * j <= 4)"
MORPH = with_(BLOB) + f""", f AS (SELECT uid, x, y FROM blob WHERE label_pred > 0), o AS {_DISK2},
full_ AS (SELECT uid, x, y FROM blob), dil AS (SELECT DISTINCT f.uid, f.x + i AS x, f.y + j AS y FROM f CROSS JOIN o WHERE f.x + i BETWEEN 0 AND 31 AND f.y + j BETWEEN 0 AND 31),
bad AS (SELECT DISTINCT g.uid, g.x - i AS x, g.y - j AS y FROM (SELECT uid, x, y FROM blob WHERE label_pred = 0) g CROSS JOIN o), ero AS (SELECT f.* FROM f ANTI JOIN bad USING (uid, x, y))
"""
_COUNT = "SELECT uid, count(*) AS n, sum(x)::BIGINT AS sx, sum(x * y)::BIGINT AS sxy FROM {} GROUP BY uid"


def foreground(spark, sf_dir):
    return blob_labels(spark, sf_dir).where("label_pred > 0").select("uid", "x", "y")


def counted(df):
    return df.groupBy("uid").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("sx"), F.sum(F.col("x") * F.col("y")).cast("long").alias("sxy"))


@query("I01_dilate", MORPH + _COUNT.format("dil"))
def dilate(spark, sf_dir):
    return counted(morphology.dilate(foreground(spark, sf_dir), morphology.disk(2), SHAPE))


@query("I01_erode", MORPH + _COUNT.format("ero"))
def erode(spark, sf_dir):
    return counted(morphology.erode(foreground(spark, sf_dir), morphology.disk(2), SHAPE))


@query("I01_open", MORPH + ", op AS (SELECT DISTINCT ero.uid, ero.x + i AS x, ero.y + j AS y FROM ero CROSS JOIN o WHERE ero.x + i BETWEEN 0 AND 31 AND ero.y + j BETWEEN 0 AND 31) " + _COUNT.format("op"))
def opening(spark, sf_dir):
    return counted(morphology.opening(foreground(spark, sf_dir), morphology.disk(2), SHAPE))


def ragged(spark, sf_dir):
    """Foreground of many small components: a label of the noise images."""
    return noise_voxels(spark, sf_dir).where("label_true = 1").select("uid", "x", "y")


RAGGED = with_(NOISE).replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT uid, x, y, x * 100 + y AS id FROM noise WHERE label_true = 1),
e AS (SELECT a.uid, a.id AS a, b.id AS b FROM f a JOIN f b ON a.uid = b.uid AND a.id <> b.id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
t AS (SELECT uid, id, id AS root FROM f UNION SELECT e.uid, e.b, t.root FROM t JOIN e ON e.uid = t.uid AND e.a = t.id),
c AS (SELECT uid, id, min(root) AS component FROM t GROUP BY uid, id)
"""


@query("I04_components", RAGGED + "SELECT uid, component AS first, count(*) AS n FROM c GROUP BY uid, component")
def components(spark, sf_dir):
    """Sizes of 8-connected components, named by their first voxel."""
    found = morphology.components(ragged(spark, sf_dir))
    return found.groupBy("uid", "component").agg(F.min(F.col("x") * 100 + F.col("y")).alias("first"), F.count("*").alias("n")).drop("component")


#: Background that a path of 4-neighbours leads to from the border stays; the rest is filled.
HOLES = with_(NOISE).replace("WITH ", "WITH RECURSIVE ", 1) + """, back AS (SELECT uid, x, y FROM noise WHERE label_true <> 1),
open_ AS (SELECT uid, x, y FROM back WHERE x IN (0, 23) OR y IN (0, 19)
  UNION SELECT b.uid, b.x, b.y FROM (SELECT uid, x, y, unnest([[0, 1], [0, -1], [1, 0], [-1, 0]]) AS d FROM open_) o JOIN back b ON b.uid = o.uid AND b.x = o.x + d[1] AND b.y = o.y + d[2]),
filled AS (SELECT uid, x, y FROM noise WHERE label_true = 1 UNION ALL SELECT uid, x, y FROM back ANTI JOIN open_ USING (uid, x, y))
"""


@query("I02_fill_holes", HOLES + _COUNT.format("filled"))
def fill_holes(spark, sf_dir):
    return counted(morphology.fill_holes(ragged(spark, sf_dir), (24, 20)))


_SELECTED = """, sz AS (SELECT uid, component, count(*) AS n, min(id % 100) AS l FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, component) AS r FROM sz),
p AS (SELECT a.uid, CASE WHEN b.n IS NULL OR b.n <= 0.75 * a.n OR a.l < b.l THEN a.component ELSE b.component END AS component FROM k a LEFT JOIN k b ON b.uid = a.uid AND b.r = 2 WHERE a.r = 1),
chosen AS (SELECT uid, id // 100 AS x, id % 100 AS y FROM c JOIN p USING (uid, component))
"""


@query("I03_select_component", RAGGED + _SELECTED + _COUNT.format("chosen"))
def select_component(spark, sf_dir):
    return counted(morphology.select_component(ragged(spark, sf_dir)))


_STACKED = with_(NOISE).replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT uid // 8 AS uid, x, y, uid % 8 AS z, x * 10000 + y * 100 + uid % 8 AS id FROM noise WHERE label_true = 2 AND p_soft < 0.25),
e AS (SELECT a.uid, a.id AS a, b.id AS b FROM f a JOIN f b ON a.uid = b.uid AND a.id <> b.id AND {0}),
t AS (SELECT uid, id, id AS root FROM f UNION SELECT e.uid, e.b, t.root FROM t JOIN e ON e.uid = t.uid AND e.a = t.id),
c AS (SELECT uid, id, min(root) AS component FROM t GROUP BY uid, id) SELECT uid, component AS first, count(*) AS n FROM c GROUP BY uid, component"""


def _stacked(spark, sf_dir, diagonal):
    found = morphology.components(noise_volumes(spark, sf_dir), axes=["x", "y", "z"], diagonal=diagonal)
    return found.groupBy("uid", "component").agg(F.min(F.col("x") * 10000 + F.col("y") * 100 + F.col("z")).cast("long").alias("first"), F.count("*").alias("n")).drop("component")


@query("I04b_components_of_26_neighbours", _STACKED.format("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"))
def components_26(spark, sf_dir):
    return _stacked(spark, sf_dir, True)


@query("I04c_components_of_6_neighbours", _STACKED.format("abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"))
def components_6(spark, sf_dir):
    return _stacked(spark, sf_dir, False)


@query("F02_largest_components", RAGGED + ", sz AS (SELECT uid, component, count(*) AS n, min(id % 100) AS l FROM c GROUP BY ALL) SELECT uid, (row_number() OVER w)::INT AS place, n, l AS left FROM sz WINDOW w AS (PARTITION BY uid ORDER BY n DESC, component) QUALIFY place <= 2".replace(" AS left", ' AS "left"'))
def largest(spark, sf_dir):
    """The two largest components of every image, with where they begin."""
    labelled = morphology.run_components(morphology.to_runs(ragged(spark, sf_dir)))
    return morphology.ranked_components(labelled).select("uid", "place", F.col("n").cast("long").alias("n"), F.col("left").cast("long").alias("left"))


def _flooded(name, mask):
    """Background that a path of 4-neighbours leads to from the border stays; the rest is filled: common table expressions ending in ``name``."""
    return f"""{name}_back AS (SELECT uid, x, y FROM us ANTI JOIN {mask} USING (uid, x, y)),
{name}_open AS (SELECT uid, x, y FROM {name}_back WHERE x IN (0, {US_SHAPE[0] - 1}) OR y IN (0, {US_SHAPE[1] - 1})
  UNION SELECT b.uid, b.x, b.y FROM (SELECT uid, x, y, unnest([[0, 1], [0, -1], [1, 0], [-1, 0]]) AS d FROM {name}_open) o JOIN {name}_back b ON b.uid = o.uid AND b.x = o.x + d[1] AND b.y = o.y + d[2]),
{name} AS (SELECT uid, x, y FROM us WHERE (uid, x, y) NOT IN (SELECT (uid, x, y) FROM {name}_open) AND uid IN (SELECT uid FROM {mask}))"""


def _element(name, half, reach):
    return f"{name} AS (SELECT i, j FROM (SELECT unnest(range(-{half}, {half} + 1))::INT AS i) CROSS JOIN (SELECT unnest(range(-{half}, {half} + 1))::INT AS j) WHERE abs(i) + abs(j) <= {reach})"


def _wider(name, mask, element):
    return f"{name} AS (SELECT DISTINCT uid, x + i AS x, y + j AS y FROM {mask} CROSS JOIN {element} WHERE x + i BETWEEN 0 AND {US_SHAPE[0] - 1} AND y + j BETWEEN 0 AND {US_SHAPE[1] - 1})"


def _narrower(name, mask, element):
    return f"""{name}_held AS (SELECT x, y, count(*) AS n FROM (SELECT unnest(range(0, {US_SHAPE[0]}))::INT AS x) CROSS JOIN (SELECT unnest(range(0, {US_SHAPE[1]}))::INT AS y) CROSS JOIN {element} WHERE x + i BETWEEN 0 AND {US_SHAPE[0] - 1} AND y + j BETWEEN 0 AND {US_SHAPE[1] - 1} GROUP BY x, y),
{name} AS (SELECT uid, x, y FROM (SELECT uid, x - i AS x, y - j AS y, count(*) AS n FROM {mask} CROSS JOIN {element} GROUP BY ALL) JOIN {name}_held USING (x, y, n))"""


#: The clean-up of ultrasound masks, ending in ``final``; components are found over runs of a line.
CLEANED = ",\n".join([
    US, "mask AS (SELECT uid, x, y FROM us WHERE label_pred > 0)", _element("e2", 2, 4), _element("e4", 4, 6), _element("e9", 9, 14), _flooded("full1", "mask"), _narrower("thin", "full1", "e2"), _wider("wide", "thin", "e4"),
    _narrower("core", "wide", "e9"), _wider("plain", "core", "e9"),
    "lines AS (SELECT uid, x, min(y) AS lo, max(y) AS hi FROM (SELECT *, y - row_number() OVER (PARTITION BY uid, x ORDER BY y) AS g FROM plain) GROUP BY uid, x, g)",
    "joins AS (SELECT a.uid, a.x * 1000 + a.lo AS a, b.x * 1000 + b.lo AS b FROM lines a JOIN lines b ON a.uid = b.uid AND abs(a.x - b.x) = 1 AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1)",
    "roots AS (SELECT uid, x * 1000 + lo AS id, x * 1000 + lo AS root FROM lines UNION SELECT j.uid, j.b, r.root FROM roots r JOIN joins j ON j.uid = r.uid AND j.a = r.id)",
    "named AS (SELECT l.uid, l.x, l.lo, l.hi, min(root) AS part FROM lines l JOIN roots r ON r.uid = l.uid AND r.id = l.x * 1000 + l.lo GROUP BY ALL)",
    "sizes AS (SELECT uid, part, sum(hi - lo + 1) AS n, min(lo) AS l FROM named GROUP BY uid, part)", "placed AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, part) AS r FROM sizes)",
    "best AS (SELECT a.uid, CASE WHEN b.n IS NULL OR b.n <= 0.75 * a.n OR a.l < b.l THEN a.part ELSE b.part END AS part FROM placed a LEFT JOIN placed b ON b.uid = a.uid AND b.r = 2 WHERE a.r = 1)",
    "one AS (SELECT uid, x, unnest(range(lo, hi + 1))::INT AS y FROM named JOIN best USING (uid, part))", _flooded("final", "one"),
])


@query("I05_clean_mask", "WITH RECURSIVE " + CLEANED + " " + _COUNT.format("final"))
def clean_mask(spark, sf_dir):
    """The whole clean-up with the elements of the ultrasound data."""
    mask = us_masks(spark, sf_dir).where("label_pred > 0").select("uid", "x", "y")
    return counted(morphology.clean_mask(mask, US_SHAPE, *morphology.ULTRASOUND))
