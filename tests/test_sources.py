import gzip
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import grids, overlap
from voxloom.sources import files, stores, volumes


def png(path, pixels):
    """A small grey image."""
    h, w = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def volume(path, data, spacing, slope=0.0, inter=0.0, quaternion=None, matrix=None):
    head = bytearray(352)
    head[0:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", data.ndim, *data.shape, *[1] * (7 - data.ndim))
    head[70:72] = struct.pack("<h", 16)
    head[76:108] = struct.pack("<8f", 1, *spacing, *[0] * (7 - len(spacing)))
    head[108:112] = struct.pack("<f", 352)
    head[112:120] = struct.pack("<2f", slope, inter)
    head[252:256] = struct.pack("<2h", quaternion is not None, matrix is not None)
    head[256:280] = struct.pack("<6f", *(quaternion or [0] * 6))
    head[280:328] = struct.pack("<12f", *(matrix or [0] * 12))
    with gzip.open(path, "wb") as f:
        f.write(bytes(head) + data.astype("<f4").tobytes(order="F"))


def test_grey_images(spark, tmp_path):
    pixels = np.array([[0, 255, 254], [128, 1, 255]], np.uint8)
    png(tmp_path / "one.png", pixels)
    got = {(r.x, r.y): r.value for r in files.read_grey_images(spark, str(tmp_path)).collect()}
    assert got == {(x, y): pixels[y, x] / 255 for x in range(3) for y in range(2)}
    labels = files.read_grey_images(spark, str(tmp_path), as_label=True)
    assert {(r.x, r.y) for r in labels.where("value = 1").collect()} == {(1, 0), (2, 1)}  # only full white
    assert labels.first().uid == "one"


def test_volumes(spark, tmp_path):
    data = np.arange(5 * 4 * 3, dtype=np.float32).reshape(5, 4, 3)
    volume(tmp_path / "scan.nii.gz", data, (1.0, 2.0, 0.5))
    tiles = volumes.read_volumes(spark, str(tmp_path), (2, 3, 2))
    back = grids.from_tiles(tiles, ["x", "y", "z"])
    assert {(r.x, r.y, r.z): r.value for r in back.collect()} == {i: float(v) for i, v in np.ndenumerate(data)}
    head = tiles.first()
    assert head.uid == "scan" and list(head["shape"]) == [5, 4, 3] and list(head.spacing) == [1.0, 2.0, 0.5]


def test_volume_frames(spark, tmp_path):
    """Every frame of a 4-D and a 5-D file is read, each with its own values."""
    rng = np.random.default_rng(1)
    for name, shape in (("four", (3, 2, 2, 4)), ("five", (2, 3, 2, 2, 3)), ("flat", (4, 3))):
        data = rng.integers(0, 99, shape).astype("f4")
        volume(tmp_path / f"{name}.nii", data, (1.0, 1.0, 1.0))
        tiles = volumes.read_volumes(spark, str(tmp_path), (2, 2, 2), f"{name}.nii")
        back = {(r.x, r.y, r.z, r.frame): r.value for r in grids.from_tiles(tiles, ["x", "y", "z"], ["uid", "frame"]).collect()}
        spread = data.reshape([*(list(shape) + [1])[:3], -1], order="F")
        assert back == {i: float(v) for i, v in np.ndenumerate(spread)}


def test_volume_scaling_and_pose(spark, tmp_path):
    data = np.array([[[1.0]], [[2.0]]], "f4")
    volume(tmp_path / "plain.nii", data, (1, 1, 1), slope=0.0, inter=5.0)
    volume(tmp_path / "scaled.nii", data, (1, 1, 1), slope=2.0, inter=5.0, quaternion=[0, 0, 1, 7, 8, 9])
    volume(tmp_path / "matrix.nii", data, (2, 3, 4), slope=1.0, inter=-1.0, quaternion=[0, 0, 0, 1, 1, 1], matrix=[2, 0, 0, 10, 0, 0, -4, 20, 0, 3, 0, 30])
    got = {r.uid: r for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    assert {k: list(r.data) for k, r in got.items()} == {"plain": [1, 2], "scaled": [7, 9], "matrix": [0, 1]}  # a slope of 0 scales nothing
    assert list(got["plain"].origin) == [0, 0, 0] and list(got["plain"].direction) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert list(got["scaled"].origin) == [7, 8, 9] and np.allclose(got["scaled"].direction, [-1, 0, 0, 0, -1, 0, 0, 0, 1])
    assert list(got["matrix"].origin) == [10, 20, 30] and np.allclose(got["matrix"].direction, [1, 0, 0, 0, 0, -1, 0, 1, 0])


def test_manifests_and_mean_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(k, "train" if k % 3 else "test") for k in range(40)], "uid long, split string").repartition(5)
    files.write_split_manifests(rows, f"{tmp_path}/splits")
    for split in ("train", "test"):
        (one,) = [f for f in os.listdir(f"{tmp_path}/splits/split={split}") if f.startswith("part-")]
        lines = open(f"{tmp_path}/splits/split={split}/{one}").read().split()
        assert lines == ["uid", *[str(k) for k in range(40) if (k % 3 > 0) == (split == "train")]]
    found = [(10, "ddpm", "dice", 0.5), (10, "ddpm", "num_samp", 3.0), (20, "ddim", "num_samp", 4.0), (20, "ddim", "dice", None)]
    files.write_mean_metrics(spark.createDataFrame(found, "step int, sampler string, metric string, value double"), f"{tmp_path}/means")
    back = files.read_checkpoint_metrics(spark, f"{tmp_path}/means")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(found, key=str)
    texts = [open(os.path.join(d, f)).read() for d, _, names in os.walk(f"{tmp_path}/means") for f in names if f.startswith("part-")]
    assert '{"dice":0.5,"num_samp":3.0}\n' in texts  # keys in order
    assert {(r.step, r.value) for r in files.metric_of_checkpoints(back, "num_samp").collect()} == {(10, 3.0), (20, 4.0)}
    with pytest.raises(Exception, match="no loss in checkpoint"):
        files.metric_of_checkpoints(back, "loss").collect()


def test_fields_are_scaled_by_spacing(spark, tmp_path):
    heads = spark.createDataFrame([("a", [2, 2], [0.5, 3.0])], "uid string, shape array<int>, spacing array<double>")
    field = spark.createDataFrame([("a", 0, 1, 4.0, 5.0, 7)], "uid string, x int, y int, dx double, dy double, step int")
    files.write_fields(field, heads, f"{tmp_path}/f", ["x", "y"], by_step=True)
    r = spark.read.parquet(f"{tmp_path}/f").first()
    assert (r.dx, r.dy, r.step, list(r.spacing)) == (2.0, 15.0, 7, [0.5, 3.0])


def test_listings_and_text(spark, tmp_path):
    for d in ("a", "b"):
        os.makedirs(tmp_path / d)
        (tmp_path / d / f"{d}_flair.nii.gz").write_bytes(b"scan")
    assert sorted(r.uid for r in files.list_uids(spark, str(tmp_path), "*_flair.nii.gz", parent=True).collect()) == ["a", "b"]
    (tmp_path / "meta.txt").write_text("p1 north\np2 south\n")
    assert [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "meta.txt")).collect()] == [("p1", "north"), ("p2", "south")]
    (tmp_path / "set.json").write_text(json.dumps({"training": [{"image": "i1", "label": "l1"}, {"image": "i2", "label": "l2"}], "validation": []}))
    assert [r.image for r in files.read_manifest(spark, str(tmp_path / "set.json"), "training").collect()] == ["i1", "i2"]


def test_checkpoint_metrics(spark, tmp_path):
    for step, sampler, value in ((10, "", 0.5), (20, "ddim", 0.7)):
        at = tmp_path / f"checkpoint_{step}" / sampler
        os.makedirs(at)
        (at / "mean_metrics.json").write_text(json.dumps({"dice": value, "num_samples": 3}))
    os.makedirs(tmp_path / "checkpoint_30")
    got = {(r.step, r.sampler, r.metric): r.value for r in files.read_checkpoint_metrics(spark, str(tmp_path)).collect()}
    assert got == {(10, None, "dice"): 0.5, (10, None, "num_samples"): 3.0, (20, "ddim", "dice"): 0.7, (20, "ddim", "num_samples"): 3.0}


def test_predictions(spark, tmp_path):
    rows = spark.createDataFrame([(u, x, y, (x + y) % 2) for u in (1, 2) for x in range(4) for y in range(4)], "uid long, x int, y int, p int")
    heads = spark.createDataFrame([(u, [4, 4], [1.0, 1.0]) for u in (1, 2)], "uid long, shape array<int>, spacing array<double>")
    tiles = grids.to_tiles(rows, (2, 2), ["x", "y"], value="p")
    files.write_predictions(tiles, heads, f"{tmp_path}/p", two_dimensional=True)
    back = grids.from_tiles(spark.read.parquet(f"{tmp_path}/p"), ["x", "y"], value="p")
    assert {(r.uid, r.x, r.y, int(r.p)) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    bad = grids.to_tiles(rows.withColumn("p", F.lit(2)), (2, 2), ["x", "y"], value="p")
    with pytest.raises(Exception, match="above 1"):
        files.write_predictions(bad, heads, f"{tmp_path}/q", two_dimensional=True)
    rows.select("uid").distinct().withColumn("split", F.lit("test")).transform(lambda d: files.write_split_manifests(d, f"{tmp_path}/s") or d)
    assert spark.read.csv(f"{tmp_path}/s", header=True).count() == 2


def tiles_of(spark, data, uid="v", block=(2, 3, 2), **more):
    """Rows of one volume: a tile a place, with its geometry."""
    full = data.reshape([*data.shape, *[1] * (4 - data.ndim)])
    rows = []
    for k in range(full.shape[3]):
        for o in np.ndindex(*[-(-n // b) for n, b in zip(full.shape, block)]):
            at = [i * b for i, b in zip(o, block)]
            part = full[tuple(slice(a, a + b) for a, b in zip(at, block)) + (k,)]
            rows.append((uid, list(full.shape[:3]), [1.5, 0.5, 2.0], k, *at, *part.shape, [float(v) for v in part.ravel()]))
    return spark.createDataFrame(rows, "uid string, shape array<int>, spacing array<double>, frame int, ox int, oy int, oz int, sx int, sy int, sz int, data array<float>").withColumns(more)


def voxels(df):
    return {(r.uid, r.frame, r.x, r.y, r.z): r.value for r in grids.from_tiles(df, ["x", "y", "z"], ["uid", "frame"]).collect()}


def test_volumes_written_and_read(spark, tmp_path):
    """Frames, geometry and voxels survive, whatever the tiles, for packed and for plain files cut over partitions."""
    rng, at = np.random.default_rng(5), str(tmp_path / "v")
    data = {"a": rng.integers(0, 99, (5, 4, 7, 3)).astype("f4"), "b": rng.integers(0, 99, (2, 2, 3, 3)).astype("f4")}
    turn = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 1)])
    df = tiles_of(spark, data["a"], "a").unionByName(tiles_of(spark, data["b"], "b", (1, 2, 3)))
    df = df.withColumns({"origin": F.array(F.lit(-3.0), F.lit(4.0), F.lit(5.5)), "direction": turn})
    volumes.write_volumes(df.repartition(3), at, frames=3, code=4)
    assert sorted(os.listdir(at)) == ["a.nii.gz", "b.nii.gz"]
    want = {(n, k, x, y, z): float(v) for n, d in data.items() for (x, y, z, k), v in np.ndenumerate(d)}
    read = volumes.read_volumes(spark, at, (3, 3, 2))
    assert voxels(read) == want
    head = read.where("uid = 'a'").first()
    assert (list(head["shape"]), list(head.spacing), list(head.origin)) == ([5, 4, 7], [1.5, 0.5, 2.0], [-3.0, 4.0, 5.5]) and np.allclose(head.direction, [0, -1, 0, 1, 0, 0, 0, 0, 1])
    with gzip.open(f"{at}/a.nii.gz") as packed, open(tmp_path / "plain.nii", "wb") as plain:
        plain.write(packed.read())
    cut = spark.read.format("volumes").option("block", "3,3,2").option("groupBytes", 100).load(str(tmp_path / "plain.nii"))
    assert cut.rdd.getNumPartitions() > 4
    assert voxels(cut) == {("plain", *k[1:]): v for k, v in want.items() if k[0] == "a"}


def test_conditions_reach_the_source(spark, tmp_path):
    at = str(tmp_path)
    for name in ("a", "b", "c"):
        volume(tmp_path / f"{name}.nii", np.arange(24, dtype="f4").reshape(2, 3, 4) + ord(name), (1, 1, 1))
    (tmp_path / "bad.nii").write_bytes(b"no volume")
    with pytest.raises(Exception, match="not a volume|unpack"):
        volumes.read_volumes(spark, at).collect()
    got = volumes.read_volumes(spark, at).where("uid = 'b' AND frame IN (0, 4) AND ox = 0")
    assert {r.uid for r in got.collect()} == {"b"}  # the other files are not opened
    assert volumes.read_volumes(spark, at).where("uid = 'b' AND uid = 'c'").collect() == []
    assert volumes.read_volumes(spark, at).where("uid = 'a' AND frame = 1").count() == 0
    assert volumes.read_volumes(spark, at, glob="none*").count() == 0
    (tmp_path / "a.nii").write_bytes((tmp_path / "b.nii").read_bytes())
    whole = gzip.decompress((tmp_path / "b.nii").read_bytes()) if (tmp_path / "b.nii").read_bytes()[:2] == b"\x1f\x8b" else (tmp_path / "b.nii").read_bytes()
    (tmp_path / "c.nii").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends within"):
        volumes.read_volumes(spark, at).where("uid = 'c'").collect()


def test_nothing_is_left_of_a_failed_write(spark, tmp_path):
    at, data = str(tmp_path / "v"), np.ones((4, 3, 4), "f4")
    good = tiles_of(spark, data, "good")
    gap = tiles_of(spark, data, "gap").where("NOT (ox = 2 AND oz = 2)")
    twice = tiles_of(spark, data, "twice").unionByName(tiles_of(spark, data, "twice").where("oz = 2"))
    flat = tiles_of(spark, data, "flat").withColumn("shape", F.array(F.lit(4), F.lit(3)))
    for bad, told in ((gap, "voxels from plane"), (twice, "voxels from plane|repeated"), (flat, "three dimensions"), (tiles_of(spark, data, "../x"), "name a file")):
        with pytest.raises(Exception, match=told):
            volumes.write_volumes(good.unionByName(bad), at)
        assert os.listdir(at) == []
    volumes.write_volumes(good, at)
    with pytest.raises(Exception, match="written twice"):
        volumes.write_volumes(good, at)
    volumes.write_volumes(tiles_of(spark, data * 2, "new"), at)
    assert sorted(os.listdir(at)) == ["good.nii.gz", "new.nii.gz"]
    volumes.write_volumes(tiles_of(spark, data * 3, "good"), at, mode="overwrite")
    assert os.listdir(at) == ["good.nii.gz"] and set(voxels(volumes.read_volumes(spark, at)).values()) == {3.0}


def test_grey_images_written_and_read(spark, tmp_path):
    at = str(tmp_path / "i")
    rng = np.random.default_rng(2)
    images = {"p": rng.random((5, 7)), "q": np.array([[-1.0, 2.0, 0.5]])}
    rows = [(n, x, y, float(v)) for n, d in images.items() for (y, x), v in np.ndenumerate(d)]
    volumes.write_grey_images(spark.createDataFrame(rows, "uid string, x int, y int, value double").repartition(3), at)
    got = {(r.uid, r.x, r.y): r.value for r in files.read_grey_images(spark, at).collect()}
    assert got == {(n, x, y): np.floor(min(max(v, 0), 1) * 255) / 255 for n, x, y, v in rows}
    with pytest.raises(Exception, match="pixels long|missing"):
        volumes.write_grey_images(spark.createDataFrame([("g", 0, 0, 1.0), ("g", 0, 2, 1.0)], "uid string, x int, y int, value double"), at)
    assert sorted(os.listdir(at)) == ["p.png", "q.png"]


def test_sinks_reject_other_dimensions(spark, tmp_path):
    heads = spark.createDataFrame([("u", [4], [1.0])], "uid string, shape array<int>, spacing array<double>")
    tile = spark.createDataFrame([("u", [1.0])], "uid string, data array<double>")
    with pytest.raises(Exception, match="2 or 3 dimensions"):
        files.write_predictions(tile, heads, str(tmp_path / "p"))
    with pytest.raises(Exception, match="has 3 dimensions"):
        files.write_fields(spark.createDataFrame([("u", 0, 0, 0, 1.0, 1.0, 1.0)], "uid string, x int, y int, z int, dx double, dy double, dz double"), heads, str(tmp_path / "f"))


def test_bucketed_tables_align_without_a_shuffle(spark, tmp_path):
    rows = [(u, x, y, (u + x) % 3, (u + y) % 3) for u in range(6) for x in range(5) for y in range(4)]
    df = spark.createDataFrame(rows, "uid long, x int, y int, label_true int, label_pred int")
    found = [stores.write_bucketed(df.where(f"{c} > 0").select("uid", "x", "y", c), f"bucketed_{c}", f"file://{tmp_path}/{c}", 4, order=["uid", "x", "y"]) for c in ("label_true", "label_pred")]
    out = overlap.stored_overlap(*found)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(u, c): tuple(sum(f(t, p) for v, _, _, t, p in rows if v == u) for f in (lambda t, p: t == p == c, lambda t, p: p == c, lambda t, p: t == c)) for u in range(6) for c in (1, 2)}  # noqa: B023
    assert {(r.uid, r.cls): (r.inter, r.n_pred, r.n_true) for r in out.collect()} == want
    assert len([f for f in os.listdir(tmp_path / "label_true") if f.endswith(".parquet")]) <= 4


def test_long_splits_are_many_files(spark, tmp_path):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("uid"), F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"))
    files.write_split_manifests(rows, str(tmp_path / "s"), per_file=100)
    names = sorted(f for f in os.listdir(tmp_path / "s" / "split=train") if f.endswith(".csv"))
    read = [line for f in names for line in (tmp_path / "s" / "split=train" / f).read_text().split()[1:]]
    assert len(names) > 8 and read == sorted(read) and len(read) == 900
