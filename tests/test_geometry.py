import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import grids, intensity, morphology, ranks, resample, stencils, surface

XY = ["x", "y"]


def image(spark, table, uid=1, kind="double"):
    return spark.createDataFrame([(uid, x, y, v) for x, line in enumerate(table) for y, v in enumerate(line)], f"uid long, x int, y int, v {kind}")


def table(df, n, m, column):
    found = {(r.x, r.y): r[column] for r in df.collect()}
    return [[found.get((x, y)) for y in range(m)] for x in range(n)]


def test_central_difference_keeps_borders(spark):
    df = image(spark, [[2.0, 1.0, 0.0], [0.0, -1.0, -2.0], [0.0, -1.0, -2.0]])
    g = stencils.gradient(df, ["v"], XY)
    assert table(g, 3, 3, "v_dy") == [[-0.5, -1.0, -0.5]] * 3
    assert table(g, 3, 3, "v_dx")[2] == [0.0, 0.0, 0.0]


def test_a_still_field_has_determinant_one(spark):
    df = image(spark, [[0.0] * 4] * 3).withColumn("w", F.lit(0.0))
    assert {r.det for r in stencils.jacobian_determinant(df, ["v", "w"], XY).collect()} == {1.0}
    loss = stencils.deformation_losses(df, ["v", "w"], XY).first()
    assert (loss.gradient_l1, loss.bending, loss.folding) == (0.0, 0.0, 0.0)


def test_convolution_borders(spark):
    df = image(spark, [[1.0] * 5] * 5)
    padded = table(stencils.convolve(df, ["v"], stencils.uniform(3), XY), 5, 5, "v")
    assert math.isclose(padded[2][2], 1) and math.isclose(padded[0][0], 4 / 9) and math.isclose(padded[0][2], 6 / 9)
    assert stencils.convolve(df, ["v"], stencils.uniform(3), XY, "drop").count() == 9
    assert stencils.convolve(df, ["v"], stencils.uniform(4), XY).count() == 25  # even kernels pass unless asked otherwise
    with pytest.raises(ValueError):
        stencils.convolve(df, ["v"], stencils.uniform(4), XY, odd_only=True)
    assert math.isclose(sum(stencils.gaussian(1.5, 11)), 1)


def test_an_image_is_like_itself(spark):
    df = image(spark, [[float((x * 7 + y * 3) % 5) for y in range(6)] for x in range(6)]).select("uid", "x", "y", F.lit(0).alias("channel"), F.col("v").alias("a"), F.col("v").alias("b"))
    assert math.isclose(stencils.ssim(df, XY, 5.0, size=3).first().ssim, 1, abs_tol=1e-9)


DIAMONDS = (["00100", "01110", "00100", "00000", "00000"], ["00100", "01110", "11111", "01110", "00100"])


def test_surface_distances_of_diamonds(spark):
    """Edges of two diamonds at spacing (1, 2)."""
    rows = [(1, x, y, int(DIAMONDS[0][x][y]), int(DIAMONDS[1][x][y])) for x in range(5) for y in range(5)]
    df = spark.createDataFrame(rows, "uid long, x int, y int, label_true int, label_pred int")
    heads = spark.createDataFrame([(1, [1.0, 2.0])], "uid long, spacing array<double>")
    for method in (surface.nearest, surface.nearest_by_pairs):
        d = surface.surface_distances(df, heads, XY, method=method)
        got = {s: sorted(round(r.distance, 6) for r in d.where(F.col("direction") == s).collect()) for s in ("pred", "true")}
        edges = {}
        for s, t in zip(("true", "pred"), DIAMONDS, strict=True):
            inside = {(x, y) for x in range(5) for y in range(5) if t[x][y] == "1"}
            edges[s] = {(x, y) for x, y in inside if not {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} <= inside}
        for s, o in (("pred", "true"), ("true", "pred")):
            assert got[s] == sorted(round(min(math.hypot(x - a, 2 * (y - b)) for a, b in edges[o]), 6) for x, y in edges[s])
    found = surface.aggregate_distances(d, {"mean": surface.mean_distance()}, {"score": surface.surface_dice(2.0)}).first()
    assert math.isclose(found.mean, max(sum(got["pred"]) / len(got["pred"]), sum(got["true"]) / len(got["true"])), abs_tol=1e-5)
    one = surface.aggregate_distances(d, {"mean": surface.mean_distance()}, {}, symmetric=False).first()
    assert math.isclose(one.mean, sum(got["pred"]) / len(got["pred"]), abs_tol=1e-5)


def test_edges_of_masks_at_the_border(spark):
    df = image(spark, [[1] * 4] * 4, kind="int").withColumn("cls", F.lit(1))
    assert stencils.mask_edges(df, "", XY).count() == 12  # outside of the image is background


def test_surface_passes_in_three_dimensions(spark):
    rng = random.Random(6)
    axes, rows = ["x", "y", "z"], {"a": [], "b": []}
    for key in range(9):
        for side in rows:
            n = rng.choice((0, 1, 3, 40)) if key else 60
            size = 30 if key == 1 else 9
            rows[side] += [(f"v{key % 3}", key, *[rng.randrange(-2, size) for _ in axes], [1.0, 0.5, 2.0 + key]) for _ in range(n)]
    a, b = (spark.createDataFrame(r + r[:5], "uid string, cls int, x int, y int, z int, spacing array<double>").repartition(3) for r in rows.values())
    want = {(u, c, *p): min((math.sqrt(sum((s * (i - j)) ** 2 for s, i, j in zip(sp, p, q))) for v, d, *q, _ in rows["b"] if (v, d) == (u, c)), default=None) for u, c, *p, sp in rows["a"]}
    near = lambda v: None if v is None else round(v, 9)
    for cells in (1 << 22, 500, 0):  # keys whole, in part by lines, all by lines
        got = surface.distances(a, b, axes, cells=cells).collect()
        assert len(got) == len(want) and {(r.uid, r.cls, r.x, r.y, r.z): near(r.distance) for r in got} == {k: near(v) for k, v in want.items()}
    assert surface.nearest(a, b, axes).count() == a.count()
    assert surface.distances(a.limit(0), b, axes).count() == 0 and {r.distance for r in surface.distances(a, b.limit(0), axes, cells=500).collect()} == {None}


def test_lower_envelopes_of_random_lines():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 7, 50)
    at = np.sort(np.array([rng.choice(20, 7, replace=False) for _ in n]), axis=1)
    at[np.arange(7) >= n[:, None]] = 0
    g, s, start = rng.choice([0.0, 1.0, 2.25, 30.0], (50, 7)), rng.choice([0.5, 1.0, 3.0], 50), rng.integers(-5, 15, 50)
    got = surface.lower_envelopes(at, g, n, s, start, 12)
    for k in range(50):
        assert np.allclose(got[k], [min((g[k, t] + (s[k] * (q - at[k, t])) ** 2 for t in range(n[k])), default=np.inf) for q in range(start[k], start[k] + 12)])


def test_quantiles_of_large_groups(spark):
    """Counting around splitters gives what sorting gives: ties, far apart scales, negative values, few and many splitters."""
    rng = np.random.default_rng(7)
    groups = {"normal": rng.normal(0, 1, 900), "ties": rng.integers(0, 3, 700).astype(float), "same": np.full(500, 2.5), "wide": np.concatenate([rng.normal(0, 1e-300, 300), rng.normal(0, 1e300, 300), [1.7e308, -1.7e308]]), "few": np.array([1.0, 4.0])}
    rows = [(n, k % 2, float(v)) for n, d in groups.items() for k, v in enumerate(d)] + [("normal", 0, None), ("normal", 1, float("nan")), ("none", 0, None)]
    df = spark.createDataFrame(rows, "uid string, step int, value double").repartition(5)
    shares = [0.0, 0.0095, 0.5, 0.995, 1.0]
    for small, splits in ((100_000, 128), (10, 8), (0, 128)):
        got = {(r.uid, r.step): [r[f"p{k}"] for k in range(5)] for r in ranks.quantiles(df, ["uid", "step"], shares, small=small, splits=splits).collect()}
        assert len(got) == 11 and got["none", 0] == [None] * 5
        for n, d in groups.items():
            for s in (0, 1):
                with np.errstate(over="ignore"):
                    v = np.sort(d[s::2])
                    at = [p * (len(v) - 1) for p in shares]
                    want = [v[int(a)] if a == int(a) or v[int(a)] == v[int(a) + 1] else (int(a) + 1 - a) * v[int(a)] + (a - int(a)) * v[int(a) + 1] for a in at]
                assert np.allclose(got[n, s], want, rtol=1e-12, atol=0), (n, s, small, splits)


def test_interpolation_across_tiles(spark, monkeypatch):
    """Two and three axes, tiles of every size, both border rules, far, absent and undefined coordinates, batches that cut tiles."""
    rng = random.Random(21)
    for axes, shape in ((["x", "y"], (9, 7)), (["x", "y", "z"], (5, 4, 6))):
        image = {(u, *p): rng.uniform(-5, 5) for u in (1, 2) for p in np.ndindex(*shape) if rng.random() < 0.9}
        place = lambda n: rng.choice([rng.uniform(-2, n + 1), float(rng.randrange(-1, n + 1)), n - 1.0])
        asked = {(u, k, *[0] * (len(axes) - 1)): [place(n) for n in shape] for u in (1, 2, 3) for k in range(80)}
        asked |= {(1, 900, *[0] * (len(axes) - 1)): [None] + [0.0] * (len(axes) - 1), (1, 901, *[0] * (len(axes) - 1)): [float("nan")] * len(axes), (1, 902, *[0] * (len(axes) - 1)): [1e300] + [0.0] * (len(axes) - 1)}
        names = ", ".join(f"{a} int" for a in axes)
        source = spark.createDataFrame([(*map(int, k), v) for k, v in image.items()] + [(1, *[0 if k else shape[0] for k in range(len(axes))], None)], f"uid int, {names}, v double").repartition(4)
        targets = spark.createDataFrame([(*k, *s, list(shape)) for k, s in asked.items()], f"uid int, {names}, " + ", ".join(f"s{a} double" for a in axes) + ", shape array<int>")
        for border in ("blend", "clamp"):
            want = {}
            for k, s in asked.items():
                total = 0.0 if all(v is not None and abs(v) < 1e9 for v in s) else None
                if border == "clamp" and total is not None:
                    total = total if all(-0.5 <= v < n - 0.5 for v, n in zip(s, shape)) else None
                    s = [max(0.0, min(v, n - 1.0)) for v, n in zip(s, shape)]
                if total is not None:
                    for step in np.ndindex(*[2] * len(axes)):
                        low = [math.floor(v) for v in s]
                        w = math.prod(v - b if c else 1 - (v - b) for v, b, c in zip(s, low, step))
                        total += w * image.get((k[0], *[b + c for b, c in zip(low, step)]), 7.0) if w else 0.0
                want[k] = 7.0 if total is None else total
            for tile, rows in ((32, 1 << 16), (3, 1 << 16), (2, 10)):
                monkeypatch.setattr(resample, "TILE", tile)
                monkeypatch.setattr(resample, "ROWS", rows)
                got = {(r.uid, *[r[a] for a in axes]): r.v for r in resample.multilinear(targets, source, axes, "v", 7.0, ["uid"], border, "shape").collect()}
                assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), (axes, border, tile)
        assert resample.multilinear(targets, source.limit(0), axes, "v", 7.0).select("v").distinct().collect()[0].v == 7.0


def test_convolution_across_tiles(spark, monkeypatch):
    """Even and odd kernels, two and three axes, gaps, negative places, other columns, tiles smaller and larger than the kernel."""
    rng = random.Random(31)
    for axes, side in ((["x", "y"], 11), (["x", "y", "z"], 5)):
        cells = {(u, *[c - 2 for c in p]): rng.uniform(-1, 1) for u in (1, 2) for p in np.ndindex(*[side] * len(axes)) if u == 1 or rng.random() < 0.8}
        df = spark.createDataFrame([(*map(int, k), v, 2 * v, "kept") for k, v in cells.items()], "uid int, " + ", ".join(f"{a} int" for a in axes) + ", v double, w double, note string").repartition(3)
        for weights in ([0.5, 0.25, 0.25], [0.1, 0.2, 0.3, 0.4]):
            before = (len(weights) - 1) // 2
            want = {}
            for k in cells:
                want[k] = sum(math.prod(weights[i] for i in s) * cells.get((k[0], *[c + i - before for c, i in zip(k[1:], s)]), 0.0) for s in np.ndindex(*[len(weights)] * len(axes)))
            for tile, cut in ((64, 1 << 21), (4, 1), (2, 500)):
                monkeypatch.setattr(stencils, "TILE", tile)
                monkeypatch.setattr(stencils, "CELLS", cut)
                rows = stencils.convolve(df, ["v", "w"], weights, axes).collect()
                got = {(r.uid, *[r[a] for a in axes]): r for r in rows}
                assert len(rows) == len(want) and all(math.isclose(got[k].v, want[k], abs_tol=1e-12) and math.isclose(got[k].w, 2 * want[k], abs_tol=1e-12) and got[k].note == "kept" for k in want)


def test_patch_grid_and_stitching(spark):
    assert grids.patch_grid((6, 11), (3, 5), (1, 3)) == [(x, y) for x in (0, 2, 3) for y in (0, 2, 4, 6)]
    df = image(spark, [[float(x * 11 + y) for y in range(11)] for x in range(6)])
    patches = grids.extract_patches(df, (6, 11), (3, 5), (1, 3), XY)
    assert patches.count() == 12 * 15 and patches.select("patch_id").distinct().count() == 12
    assert sorted(grids.stitch(patches, ["v"], XY).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        grids.patch_grid((4,), (5,), (1,))


def test_pads_and_crops(spark):
    def both(f, a, b):
        return tuple(spark.range(1).select(*[c.alias(n) for n, c in zip("ab", f(F.lit(a), F.lit(b)), strict=True)]).first())

    assert [both(grids.center_pad, a, b) for a, b in ((63, 64), (43, 64), (39, 40))] == [(0, 1), (10, 11), (0, 1)]
    assert both(grids.center_crop, 10, 7) == (1, 2) and both(grids.center_crop, 7, 10) == (0, 0)

    def label(lo, hi, n, t):
        return tuple(spark.range(1).select(*[c.alias(x) for x, c in zip("ab", grids.label_crop(F.lit(lo), F.lit(hi), n, t), strict=True)]).first())

    assert [label(0, 5, 6, 4), label(1, 5, 6, 4), label(5, 7, 7, 4)] == [(0, 2), (1, 1), (3, 0)]
    assert label(-1, -1, 7, 4) == (None, None)
    assert spark.range(200).select(grids.random_patch_corner(F.col("id"), 7, 4, "x", 1).alias("c")).distinct().count() == 3  # the last place is never drawn


def test_tiles_round_trip(spark):
    df = image(spark, [[float(x * 10 + y) for y in range(7)] for x in range(5)]).where("x + y <> 4")
    back = grids.from_tiles(grids.to_tiles(df, (2, 3), XY, value="v"), XY, value="v")
    assert sorted((r.uid, r.x, r.y, r.v) for r in back.collect()) == sorted((r.uid, r.x, r.y, r.v) for r in df.collect())


def test_lookups(spark):
    df = image(spark, [[0.0, 1.0], [2.0, 3.0]])
    at = spark.createDataFrame([(1, 0, 0, 0.5, 0.5), (1, 0, 1, -0.5, 0.0), (1, 1, 0, 1.5, 1.0), (1, 1, 1, 5.0, 5.0)], "uid long, x int, y int, sx double, sy double")
    assert table(resample.multilinear(at, df, XY, "v"), 2, 2, "v") == [[1.5, 0.0], [1.5, 0.0]]
    sized = at.withColumn("shape", F.array(F.lit(2), F.lit(2)))
    assert table(resample.multilinear(sized, df, XY, "v", border="clamp", shape="shape"), 2, 2, "v") == [[1.5, 0.0], [0.0, 0.0]]
    assert table(resample.nearest(at, df, XY, "v", -1), 2, 2, "v") == [[3.0, -1.0], [-1.0, -1.0]]
    assert table(resample.nearest(at, df, XY, "v", -1, half_up=True), 2, 2, "v") == [[3.0, 0.0], [-1.0, -1.0]]


def test_resampling_sizes_round_half_to_even(spark):
    sizes = spark.createDataFrame([(5, 0.5), (7, 0.5), (3, 1.0)], "n int, old double").select(resample.resampled_size(F.col("n"), F.col("old"), 1.0).alias("s"))
    assert [r.s for r in sizes.collect()] == [2, 4, 3]


def test_resampling_at_the_same_spacing_changes_nothing(spark):
    df = image(spark, [[float(x * 3 + y) for y in range(3)] for x in range(4)])
    heads = spark.createDataFrame([(1, [4, 3], [1.0, 2.0])], "uid long, shape array<int>, spacing array<double>")
    out, new = resample.resample(df, heads, (1.0, 2.0), XY, "v", False)
    assert sorted((r.x, r.y, r.v) for r in out.collect()) == sorted((r.x, r.y, r.v) for r in df.collect()) and list(new.first()["shape"]) == [4, 3]


def test_affine(spark):
    zero, one = F.lit(0.0), F.lit(1.0)
    m = resample.affine_matrix(2, [one, F.lit(2.0)], [zero], [one, one], [zero, zero], [F.lit(3.0), zero])
    assert list(spark.range(1).select(F.array(*[c for r in m for c in r]).alias("m")).first().m) == [1, 0, 3, 0, 1, 0, 0, 0, 1]
    m = resample.affine_matrix(3, [one] * 3, [F.lit(math.pi / 2), zero, zero], [one] * 3, [zero] * 6, [zero] * 3)
    got = spark.range(1).select(F.array(*[c for r in m for c in r]).alias("m")).first().m
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, [1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1], strict=True))
    with pytest.raises(ValueError):
        resample.affine_matrix(4, [], [], [], [], [])


def test_percentiles_and_rescaling(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(101)] + [(2, 5.0), (2, 5.0)], "uid long, value double")
    p = {r.uid: r for r in intensity.percentiles(df).collect()}
    assert math.isclose(p[1].p0, 0.95) and math.isclose(p[1].p1, 99.5)  # the lower one is 0.95 percent
    out = intensity.clip_and_normalise(df)
    assert out.where("uid = 1").agg(F.min("value"), F.max("value")).first() == (0.0, 1.0)
    assert {r.value for r in out.where("uid = 2").collect()} == {None}


def grid(spark, lines, uid=1):
    return spark.createDataFrame([(uid, x, y) for x, line in enumerate(lines) for y, c in enumerate(line) if c == "#"], "uid long, x int, y int")


def drawn(df, n, m):
    got = {(r.x, r.y) for r in df.collect()}
    return ["".join("#" if (x, y) in got else "." for y in range(m)) for x in range(n)]


def test_chords_against_brute_force(spark):
    """Convex, broken and off-centre elements at the border of small images."""
    rng = random.Random(11)
    elements = [morphology.box(3), morphology.octagon(2, 3), morphology.disk(2), [(0, -1), (0, 1)], [(0, 0), (2, 1), (-1, -2)], [(1, 2)], [(0, 3), (0, 4), (-1, 0)], [(2, -3), (2, 3)]]
    for n, offsets in enumerate(elements):
        nx, ny = rng.choice([(5, 6), (7, 4), (3, 9)])
        masks = {u: {(x, y) for x in range(nx) for y in range(ny) if rng.random() < (0.9, 0.6, 1.0)[u % 3]} for u in range(4)}
        df = spark.createDataFrame([(f"u{u}", u, x, y) for u, m in masks.items() for x, y in m], "uid string, step int, x int, y int")
        where = lambda x, y: 0 <= x < nx and 0 <= y < ny  # noqa: B023,E731
        for f in (morphology.dilate, morphology.erode):
            got = {(r.step, r.x, r.y) for r in f(df, offsets, (nx, ny), ["uid", "step"]).collect()}
            want = set()
            for u, m in masks.items():
                for x, y in np.ndindex(nx, ny):
                    if f is morphology.dilate:
                        keep = any((x - i, y - j) in m for i, j in offsets)
                    else:
                        reached = [(x + i, y + j) for i, j in offsets if where(x + i, y + j)]
                        keep = bool(reached) and all(p in m for p in reached)
                    want |= {(u, x, y)} if keep else set()
            assert got == want, (n, f.__doc__)
    sizes = [len(morphology.box(5)), *map(len, morphology.ULTRASOUND)]
    assert sizes == [25, 25, 69, 321] and {i: b for i, _, b in morphology.chords(morphology.ULTRASOUND[2])} == {i: min(9, 14 - abs(i)) for i in range(-9, 10)}


def test_components_over_many_tiles(spark, monkeypatch):
    """Tiles of every size give the components of a search, in two and three dimensions and for negative places."""
    rng = random.Random(13)
    for axes, side, share in ((["x", "y"], 16, 0.45), (["x", "y", "z"], 7, 0.2)):
        rows = {(u, *[c - 3 for c in p]) for u in range(2) for p in np.ndindex(*[side] * len(axes)) if rng.random() < share}
        df = spark.createDataFrame([tuple(map(int, r)) for r in rows], "uid int, " + ", ".join(f"{a} int" for a in axes))
        for diagonal in (True, False):
            steps = [s for s in np.ndindex(*[3] * len(axes)) if diagonal or sum(abs(v - 1) for v in s) == 1]
            left, want = set(rows), set()
            while left:
                part, todo = set(), [left.pop()]
                while todo:
                    p = todo.pop()
                    part.add(p)
                    near = {(p[0], *[a + s - 1 for a, s in zip(p[1:], step)]) for step in steps} & left
                    left -= near
                    todo += near
                want.add(frozenset(part))
            for tile in (2, 64):
                monkeypatch.setattr(morphology, "TILE", tile)
                found = {}
                for r in morphology.components(df, axes=axes, diagonal=diagonal).collect():
                    found.setdefault(r.component, set()).add((r.uid, *[r[a] for a in axes]))
                assert {frozenset(v) for v in found.values()} == want, (axes, diagonal, tile)


def test_clean_up_by_step(spark):
    """Steps are cleaned apart; a mask thinner than the first element is gone."""
    rows = [(1, s, x, y) for s, keep in ((0, range(0, 30)), (1, range(12, 14))) for x in range(30) for y in keep]
    df = spark.createDataFrame(rows, "uid long, step int, x int, y int")
    got = morphology.clean_mask(df, (40, 34), *morphology.ULTRASOUND, keys=["uid", "step"])
    assert {r.step for r in got.select("step").distinct().collect()} == {0} and got.count() > 850
    labels = df.withColumns({"label_pred": F.lit(2), "label_true": F.lit(1)})
    kept = morphology.clean_predictions(labels, (40, 34), keys=["uid", "step"])
    assert {(r.step, r.label_pred) for r in kept.select("step", "label_pred").distinct().collect()} >= {(0, 1), (1, 0)} and kept.count() == df.count()


def test_morphology_at_the_border(spark):
    full = grid(spark, ["####"] * 4)
    assert drawn(morphology.erode(full, morphology.box(3), (4, 4)), 4, 4) == ["####"] * 4  # places outside take no part
    dot = grid(spark, ["#...", "....", "....", "...."])
    assert drawn(morphology.dilate(dot, morphology.box(3), (4, 4)), 4, 4) == ["##..", "##..", "....", "...."]
    assert morphology.opening(dot, morphology.box(3), (4, 4)).count() == 0


def test_components(spark):
    snake = ["######", ".....#", "######", "#.....", "######"]
    c = morphology.components(grid(spark, snake), diagonal=False)
    assert c.count() == 20 and c.select("component").distinct().count() == 1
    diagonal = ["#.", ".#"]
    for flag, n in ((True, 1), (False, 2)):
        assert morphology.components(grid(spark, diagonal), diagonal=flag).select("component").distinct().count() == n


def test_holes(spark):
    ring = ["#####", "#...#", "#.#.#", "#...#", "#####"]
    assert drawn(morphology.fill_holes(grid(spark, ring), (5, 5)), 5, 5) == ["#####"] * 5
    cup = ["#.###", "#...#", "#####"]
    assert drawn(morphology.fill_holes(grid(spark, cup), (3, 5)), 3, 5) == cup


def test_component_choice(spark):
    two = ["##....", "##..##", "##..##", "....##", "....##", "....##"]  # 6 on the left, 10 on the right
    keep = lambda t, axis="y": morphology.select_component(grid(spark, two), t, axis).count()
    assert keep(0.75) == 10 and keep(0.6) == 10 and keep(0.5) == 6
    assert morphology.select_component(grid(spark, ["##", "##"])).count() == 4
    assert morphology.select_component(grid(spark, [])).count() == 0
