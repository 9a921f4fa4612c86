"""One query for each operator over the test tables, and the same in SQL for DuckDB.

embeddings rows are 8 x 8 images; four consecutive ids are one 4 x 8 x 8 volume, so that all rows are in one. Results are voxel rows. The SQL says
each operator's formula on a table of voxels, with the draws written out, and shares no code with the kernels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import operators as o
from lumenframe.functions import volumes as vol
from lumenframe.plans.apply import augment, plan_steps
from lumenframe.plans.node import Compose, Guard, OneOf, SomeOf, Transform
from lumenframe.plans.presets import PRESETS
from lumenframe.plans.validate import VolumeValidator

SEED, DEPTH = 42, 4
SIZES = {"z": DEPTH, "y": 8, "x": 8}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


# --- the tables as volumes -------------------------------------------------------------------------------------------


def _mask(image: Column) -> Column:
    return F.transform(image, lambda v: F.when(v > 0.2, 2).when(v > 0.1, 1).otherwise(0))


def _with_targets(df: DataFrame, ndim: int) -> DataFrame:
    """mask, spacing, modality, metadata; the brightest voxel as a keypoint, the foreground's bounds as a box."""
    sizes = (8, 8) if ndim == 2 else (DEPTH, 8, 8)
    coord = lambda i: F.array(*((F.floor(i / 8**k) % sizes[-1 - k]).cast("double") for k in range(ndim - 1, -1, -1)))
    df = df.withColumn("mask", _mask(F.col("image")))
    at = F.filter(F.transform("mask", lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
    places = F.transform(at, lambda i: coord(i))
    element = lambda k: lambda c: c[k]
    bound = lambda pick: F.array(*(pick(F.transform(places, element(k))) for k in range(ndim)))
    brightest = F.array_position("image", F.array_max("image")) - 1
    modality = F.element_at(F.array(*map(F.lit, ("MR", "CT", "DX", "DBT"))), (F.col("tag") % 4 + 1).cast("int"))
    return df.select(
        "volume_id", F.array(*map(F.lit, sizes)).alias("shape"), "image", "mask", F.array(*[F.lit(1.0)] * ndim).alias("spacing"), modality.alias("modality"),
        F.when(modality == "CT", F.create_map(F.lit("window_center"), F.lit("0.05"), F.lit("window_width"), F.lit("0.3"))).alias("metadata"),
        F.array(F.struct(coord(brightest).alias("coord"), F.lit("peak").alias("label"))).alias("keypoints"),
        F.when(F.size(at) > 0, F.array(F.struct(bound(F.array_min).alias("lo"), bound(F.array_max).alias("hi"), F.lit("foreground").alias("label")))).otherwise(F.array().cast(vol.BOXES)).alias("bboxes"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _with_targets(df.select(F.col("vec_id").alias("volume_id"), F.col("embedding").cast("array<double>").alias("image"), F.col("label").alias("tag")), 2)


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / DEPTH).alias("volume_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    df = df.groupBy("volume_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "e"))).alias("rows"), F.min("label").alias("tag")).where(F.size("rows") == DEPTH)
    return _with_targets(df.select("volume_id", F.flatten(F.transform("rows", lambda r: r["e"])).alias("image"), "tag"), 3)


def six(x: Column | str) -> Column:
    r = F.round(x, 6)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def voxel_rows(df: DataFrame) -> DataFrame:
    return vol.to_voxels(df).select(F.col("volume_id").cast("long").alias("volume_id"), "z", "y", "x", six("v").alias("v"), "label")


# --- building blocks of the SQL --------------------------------------------------------------------------------------

V2 = "v AS MATERIALIZED (SELECT vec_id AS volume_id, 0 AS z, i // 8 AS y, i % 8 AS x, i, e AS v, CASE WHEN e > 0.2 THEN 2 WHEN e > 0.1 THEN 1 ELSE 0 END AS m, tag FROM (SELECT vec_id, label AS tag, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings))"
V3 = f"v AS MATERIALIZED (SELECT vec_id // {DEPTH} AS volume_id, vec_id % {DEPTH} AS z, i // 8 AS y, i % 8 AS x, (vec_id % {DEPTH}) * 64 + i AS i, e AS v, CASE WHEN e > 0.2 THEN 2 WHEN e > 0.1 THEN 1 ELSE 0 END AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings WHERE vec_id // {DEPTH} IN (SELECT vec_id // {DEPTH} FROM embeddings GROUP BY 1 HAVING count(*) = {DEPTH})))"


def word(name: str, path: str = "0") -> str:
    return f"('0x' || substr(md5('{SEED}|0|{path}|' || volume_id || '|{name}'), 1, 8))::BIGINT"


def unit(name: str, path: str = "0") -> str:
    return f"(({word(name, path)} + 0.5) / 4294967296.0)"


def uniform(name: str, lo: float, hi: float, path: str = "0") -> str:
    return f"({lo!r}::DOUBLE + ({hi!r}::DOUBLE - {lo!r}::DOUBLE) * {unit(name, path)})"


def integer(name: str, lo: str | int, hi: str | int, path: str = "0") -> str:
    return f"({lo} + floor({unit(name, path)} * ({hi} - ({lo}) + 1))::BIGINT)"


def field(out: str, source: str, name: str, i: str = "i", path: str = "0") -> str:
    """A CTE: source with the column out, units by the counter i."""
    m = 4294967296
    return (
        f"{out} AS MATERIALIZED (SELECT * EXCLUDE (h0, h1, h2), ((xor(h2, h2 >> 16))::DOUBLE + 0.5) / 4294967296.0 AS {out} FROM (SELECT *, (xor(h1, h1 >> 13)::UBIGINT * 3266489909::UBIGINT) % {m} AS h2 FROM "
        f"(SELECT *, (xor(h0, h0 >> 16)::UBIGINT * 2246822507::UBIGINT) % {m} AS h1 FROM (SELECT *, (({word(name, path)} + {i} * 2654435769) % {m})::UBIGINT AS h0 FROM {source}))))"
    )


def shown(value: str) -> str:
    return f"CASE WHEN round({value}, 6) = 0 THEN 0.0::DOUBLE ELSE round({value}, 6) END"


def rows(source: str, value: str = "o", label: str = "m", z: str = "z", y: str = "y", x: str = "x", where: str = "") -> str:
    return f"SELECT volume_id::BIGINT AS volume_id, ({z})::INTEGER AS z, ({y})::INTEGER AS y, ({x})::INTEGER AS x, {shown(value)} AS v, ({label})::INTEGER AS label FROM {source} {where}"


STATS = "s AS MATERIALIZED (SELECT volume_id, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd FROM v GROUP BY volume_id)"


def fold_reflect(i: str, n: str = "8") -> str:
    return f"(CASE WHEN (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) >= {n} THEN 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) ELSE (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}) END)"


def bring_reflect(c: str, n: int = 8) -> str:
    return f"(CASE WHEN (({c}) + 0.5) - {2 * n} * floor((({c}) + 0.5) / {2 * n}) > {n} THEN {2 * n} - ((({c}) + 0.5) - {2 * n} * floor((({c}) + 0.5) / {2 * n})) ELSE (({c}) + 0.5) - {2 * n} * floor((({c}) + 0.5) / {2 * n}) END - 0.5)"


def gather(out: str, coords: str, values: str, axes: str, fold=fold_reflect, column: str = "v") -> str:
    """A CTE: the rows of coords (with c_<axis> in range) with the linear interpolation o of the values, over all axes named."""
    corners = " CROSS JOIN ".join(f"(VALUES (0), (1)) t_{a}(d_{a})" for a in axes)
    at = " AND ".join(f"w.{a} = {fold(f'(floor(c_{a})::BIGINT + d_{a})', str(SIZES[a]))}" for a in axes)
    other = " AND ".join(f"w.{a} = c.{a}" for a in "zyx" if a not in axes)
    weight = " * ".join(f"(CASE WHEN d_{a} = 1 THEN c_{a} - floor(c_{a}) ELSE 1 - (c_{a} - floor(c_{a})) END)" for a in axes)
    return f"{out} AS MATERIALIZED (SELECT c.volume_id, c.z, c.y, c.x, sum({weight} * w.{column}) AS o FROM {coords} c CROSS JOIN {corners} JOIN {values} w ON w.volume_id = c.volume_id AND {at}{' AND ' + other if other else ''} GROUP BY ALL)"


def blur(out: str, source: str, axes: str, sigma: str, most: int, column: str = "v") -> str:
    """CTEs: source blurred by a Gaussian of the rows' sigma along the axes; the last has column o."""
    parts, at, name = [], source, column
    for k, a in enumerate(axes):
        new = out if k + 1 == len(axes) else f"{out}_{k}"
        others = ", ".join(f"c.{b}" for b in "zyx" if b != a)
        parts.append(
            f"{new} AS MATERIALIZED (SELECT c.volume_id, {others}, t AS {a}, sum(g * c.{name}) / max(total) AS o FROM (SELECT *, sum(CASE WHEN first THEN g END) OVER (PARTITION BY volume_id) AS total FROM "
            f"(SELECT volume_id, t, k, exp(-0.5 * (k / s) * (k / s)) AS g, t = 0 AS first FROM (SELECT DISTINCT volume_id, {sigma} AS s FROM v) CROSS JOIN range({SIZES[a]}) r(t) CROSS JOIN range({-most}, {most + 1}) q(k) WHERE abs(k) <= floor(4 * s + 0.5))) f "
            f"JOIN {at} c ON c.volume_id = f.volume_id AND c.{a} = {fold_reflect('f.t + f.k', str(SIZES[a]))} GROUP BY c.volume_id, {others}, t)"
        )
        at, name = new, "o"
    return ", ".join(parts)


def leaf(name: str, plan: Transform, ctes: list[str] | None, final: str | None, dims: int = 2) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return voxel_rows(augment((images if dims == 2 else stacks)(spark, sf_dir), plan, SEED))

    QUERIES[name] = run
    if ctes is not None:
        ORACLE_SQL[name] = f"WITH {', '.join([V2 if dims == 2 else V3, *ctes])} {final}"


# --- spatial ---------------------------------------------------------------------------------------------------------

leaf("random_flip", o.RandomFlip(axes=("x", "y")), [], rows("v", "v", y=f"CASE WHEN {unit('flip0')} < 0.5 THEN 7 - y ELSE y END", x=f"CASE WHEN {unit('flip1')} < 0.5 THEN 7 - x ELSE x END"))

_affine = [
    f"p AS MATERIALIZED (SELECT DISTINCT volume_id, radians({uniform('angle', -10.0, 10.0)}) AS a, {uniform('scale0', 0.9, 1.1)} AS s0, {uniform('scale1', 0.9, 1.1)} AS s1, 8 * {uniform('shift0', -0.05, 0.05)} AS t0, 8 * {uniform('shift1', -0.05, 0.05)} AS t1 FROM v)",
    "c AS MATERIALIZED (SELECT volume_id, z, y, x, m, (cos(a) * (y - 3.5 - t0) + sin(a) * (x - 3.5 - t1)) / s0 + 3.5 AS c_y, (-sin(a) * (y - 3.5 - t0) + cos(a) * (x - 3.5 - t1)) / s1 + 3.5 AS c_x FROM v JOIN p USING (volume_id))",
    "inside AS (SELECT * FROM c WHERE c_y BETWEEN 0 AND 7 AND c_x BETWEEN 0 AND 7)",
    gather("g", "inside", "v", "yx"),
    "k AS (SELECT c.volume_id, c.z, c.y, c.x, w.m FROM inside c JOIN v w ON w.volume_id = c.volume_id AND w.y = floor(c_y + 0.5) AND w.x = floor(c_x + 0.5))",
]
leaf("random_affine", o.RandomAffine(rotation=10.0, scale=(0.9, 1.1), translation=0.05), _affine, rows("(SELECT v.volume_id, v.z, v.y, v.x, coalesce(g.o, 0) AS o, coalesce(k.m, 0) AS m FROM v LEFT JOIN g USING (volume_id, z, y, x) LEFT JOIN k USING (volume_id, z, y, x))"))

_crop = [
    "f AS (SELECT volume_id, y, x, row_number() OVER (PARTITION BY volume_id ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY volume_id) AS n FROM v WHERE m > 0)",
    f"a AS (SELECT volume_id, y AS ay, x AS ax FROM f WHERE r = {integer('anchor', 0, 'n - 1')} AND {unit('foreground')} < 0.7)",
    "b AS (SELECT d.volume_id, CASE WHEN ay IS NULL THEN 0 ELSE greatest(0, ay - 3) END AS y0, CASE WHEN ay IS NULL THEN 4 ELSE least(4, ay) END AS y1, CASE WHEN ax IS NULL THEN 0 ELSE greatest(0, ax - 4) END AS x0, CASE WHEN ax IS NULL THEN 3 ELSE least(3, ax) END AS x1 FROM (SELECT DISTINCT volume_id FROM v) d LEFT JOIN a USING (volume_id))",
    f"w AS (SELECT volume_id, {integer('origin0', 'y0', 'y1')} AS oy, {integer('origin1', 'x0', 'x1')} AS ox FROM b)",
]
leaf("anatomic_crop", o.AnatomicCrop(size=(4, 5), foreground_prob=0.7), _crop, rows("v JOIN w USING (volume_id)", "v", y="y - oy", x="x - ox", where="WHERE y BETWEEN oy AND oy + 3 AND x BETWEEN ox AND ox + 4"))
leaf("center_crop", o.CenterCrop(size=(5, 20)), [], rows("v", "v", y="y - 1", where="WHERE y BETWEEN 1 AND 5"))
leaf("pad", o.Pad(size=(11, 6), cval=-1.0), [], rows("(SELECT d.volume_id, 0 AS z, q.y, r.x, coalesce(v.v, -1) AS o, coalesce(v.m, 0) AS m FROM (SELECT DISTINCT volume_id FROM v) d CROSS JOIN range(11) q(y) CROSS JOIN range(8) r(x) LEFT JOIN v ON v.volume_id = d.volume_id AND v.y = q.y - 1 AND v.x = r.x)"))
_resize = [
    "c AS MATERIALIZED (SELECT volume_id, 0 AS z, q.y, r.x, least(q.y * (7.0::DOUBLE / 11.0::DOUBLE), 7) AS c_y, least(r.x * (7.0::DOUBLE / 4.0::DOUBLE), 7) AS c_x FROM (SELECT DISTINCT volume_id FROM v) CROSS JOIN range(12) q(y) CROSS JOIN range(5) r(x))",
    gather("g", "c", "v", "yx"),
    "k AS (SELECT c.volume_id, c.z, c.y, c.x, w.m FROM c JOIN v w ON w.volume_id = c.volume_id AND w.y = floor(c_y + 0.5) AND w.x = floor(c_x + 0.5))",
]
leaf("resize", o.Resize(size=(12, 5)), _resize, rows("g JOIN k USING (volume_id, z, y, x)"))


def _elastic(axes: str, alphas: list[float], sigmas: list[float]) -> tuple[list[str], str]:
    ctes, joins = [], "v"
    for k, (a, alpha, sigma) in enumerate(zip(axes, alphas, sigmas)):
        ctes += [field(f"f{k}", "v", f"field{k}"), f"n{k} AS MATERIALIZED (SELECT volume_id, z, y, x, 2 * f{k} - 1 AS v FROM f{k})", blur(f"b{k}", f"n{k}", axes, f"{sigma!r}::DOUBLE", int(4 * sigma + 0.5)), f"e{k} AS (SELECT volume_id, z, y, x, {alpha!r}::DOUBLE * o AS d_{a} FROM b{k})"]
        joins += f" JOIN e{k} USING (volume_id, z, y, x)"
    ctes.append(f"raw AS MATERIALIZED (SELECT volume_id, z, y, x, {', '.join(f'{a} + d_{a} AS r_{a}' for a in axes)} FROM {joins})")
    ctes.append(f"c AS MATERIALIZED (SELECT *, {', '.join(f'{bring_reflect(f"r_{a}", SIZES[a])} AS c_{a}' for a in axes)} FROM raw)")
    ctes.append(gather("g", "c", "v", axes))
    ctes.append(f"k AS (SELECT c.volume_id, c.z, c.y, c.x, w.m FROM c JOIN v w ON w.volume_id = c.volume_id AND {' AND '.join(f'r_{a} BETWEEN 0 AND {SIZES[a] - 1} AND w.{a} = floor(r_{a} + 0.5)' for a in axes)}{'' if 'z' in axes else ' AND w.z = c.z'})")
    return ctes, rows("(SELECT g.*, coalesce(k.m, 0) AS m FROM g LEFT JOIN k USING (volume_id, z, y, x))")


leaf("elastic_deform", o.ElasticDeform(alpha=6.0, sigma=1.0), *_elastic("yx", [6.0, 6.0], [1.0, 1.0]))
leaf("anisotropic_elastic", o.AnisotropicElastic(alpha=(6.0, 6.0, 2.0), sigma=(1.0, 1.0, 0.5)), *_elastic("zyx", [6.0, 6.0, 2.0], [1.0, 1.0, 0.5]), dims=3)

_holes = ", ".join(
    f"h{k} AS (SELECT volume_id, y0, y0 + sy AS y1, x0, x0 + sx AS x1 FROM (SELECT volume_id, sy, sx, {integer(f'origin{k}.0', 0, '8 - sy')} AS y0, {integer(f'origin{k}.1', 0, '8 - sx')} AS x0 FROM (SELECT DISTINCT volume_id, "
    f"least(8, greatest(1, round_even({uniform(f'size{k}.0', 0.2, 0.5)} * 8, 0)))::BIGINT AS sy, least(8, greatest(1, round_even({uniform(f'size{k}.1', 0.2, 0.5)} * 8, 0)))::BIGINT AS sx FROM v WHERE {integer('holes', 1, 3)} > {k})))"
    for k in range(3)
)
leaf("coarse_dropout", o.CoarseDropout(num_holes=(1, 3), hole_size=(0.2, 0.5), fill_value=-1.0, fill_mask=True), [_holes, "h AS (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2)"],
     rows("(SELECT v.*, EXISTS (SELECT 1 FROM h WHERE h.volume_id = v.volume_id AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1) AS gone FROM v)", "CASE WHEN gone THEN -1 ELSE v END", "CASE WHEN gone THEN 0 ELSE m END"))

# --- intensity -------------------------------------------------------------------------------------------------------


def _normal(name: str, source: str, out: str) -> list[str]:
    return [field(f"{out}r", source, f"{name}.r"), field(f"{out}a", f"{out}r", f"{name}.a"), f"{out} AS MATERIALIZED (SELECT *, sqrt(-2 * ln({out}r)) * cos(2 * pi() * {out}a) AS {out} FROM {out}a)"]


leaf("gaussian_noise", o.GaussianNoise(std=(0.05, 0.1), relative=True), [STATS, *_normal("noise", "v", "n")], rows("n JOIN s USING (volume_id)", f"v + n * {uniform('std', 0.05, 0.1)} * (sd + 1e-8)"))
leaf("rician_noise", o.RicianNoise(std=(0.01, 0.05), clip=(0.0, 0.4)), [*_normal("real", "v", "n"), *_normal("imaginary", "n", "q")], rows("(SELECT *, " + uniform("std", 0.01, 0.05) + " AS t FROM q)", "least(0.4, greatest(0.0, sqrt((v + t * n) * (v + t * n) + t * q * t * q)))"))
_gamma = f"pow((v - lo) / (hi - lo), {uniform('gamma', 0.7, 1.4)}) * (hi - lo) + lo"
leaf("gamma_correction", o.GammaCorrection(gamma=(0.7, 1.4)), [STATS], rows("v JOIN s USING (volume_id)", _gamma))
leaf("gamma_invert", o.GammaCorrection(gamma=(0.7, 1.4), invert=True), [STATS], rows("v JOIN s USING (volume_id)", f"(1 - pow(1 - (v - lo) / (hi - lo), {uniform('gamma', 0.7, 1.4)})) * (hi - lo) + lo"))
_bias = [
    "grid AS (SELECT volume_id, 0 AS z, q.y, r.x, q.y * 4 + r.x AS i FROM (SELECT DISTINCT volume_id FROM v) CROSS JOIN range(4) q(y) CROSS JOIN range(4) r(x))",
    field("f", "grid", "coarse"),
    "w AS (SELECT volume_id, z, y, x, 0.3 * (2 * f - 1) AS v FROM f)",
    "c AS MATERIALIZED (SELECT volume_id, z, y, x, least(y * (3.0::DOUBLE / 7.0::DOUBLE), 3) AS c_y, least(x * (3.0::DOUBLE / 7.0::DOUBLE), 3) AS c_x FROM v)",
    gather("g", "c", "w", "yx", lambda i, _: f"least({i}, 3)"),
]
leaf("bias_field", o.BiasField(alpha=0.3, coarse_shape=4, order=1), _bias, rows("v JOIN g USING (volume_id, z, y, x)", "v * exp(o)"))
leaf("bias_field_cubic", o.BiasField(alpha=0.3, coarse_shape=4, order=3), None, None)
_window = [
    STATS,
    f"p AS (SELECT volume_id, c + {uniform('shift', -0.1, 0.1)} * w AS c, greatest(w * {uniform('width', 0.8, 1.2)}, 1e-8) AS w FROM (SELECT DISTINCT volume_id, CASE WHEN tag % 4 = 1 THEN 0.05 ELSE (lo + hi) / 2 END AS c, CASE WHEN tag % 4 = 1 THEN 0.3 ELSE greatest(hi - lo, 1e-8) END AS w FROM v JOIN s USING (volume_id)))",
]
leaf("window_level", o.WindowLevel(), _window, rows("v JOIN p USING (volume_id)", "(least(c + w / 2, greatest(c - w / 2, v)) - (c - w / 2)) / w"))
leaf("brightness_contrast", o.BrightnessContrast(brightness=0.1, clip=(-0.2, 0.2)), [], rows("v", f"least(0.2, greatest(-0.2, v * {uniform('contrast', 0.9, 1.1)} + {uniform('brightness', -0.1, 0.1)}))"))
leaf("gaussian_blur", o.GaussianBlur(sigma=(0.5, 1.5)), [blur("b", "v", "yx", uniform("sigma", 0.5, 1.5), 6)], rows("(SELECT b.*, v.m FROM b JOIN v USING (volume_id, z, y, x))"))
_low = [
    "c AS MATERIALIZED (SELECT DISTINCT volume_id, 0 AS z, y, x, y * (7.0::DOUBLE / 3.0::DOUBLE) AS c_y, x * (7.0::DOUBLE / 3.0::DOUBLE) AS c_x FROM v WHERE y < 4 AND x < 4)",
    gather("g", "c", "v", "yx"),
    "e AS MATERIALIZED (SELECT volume_id, z, y, x, m, least(y * (3.0::DOUBLE / 7.0::DOUBLE), 3) AS c_y, least(x * (3.0::DOUBLE / 7.0::DOUBLE), 3) AS c_x FROM v)",
    gather("t", "e", "g", "yx", lambda i, _: f"least({i}, 3)", "o"),
]
leaf("simulate_low_resolution", o.SimulateLowResolution(zoom_range=(0.5, 0.5)), _low, rows("t JOIN v USING (volume_id, z, y, x)"))
leaf("median_blur", o.MedianBlur(ksize=3), ["b AS (SELECT c.volume_id, c.z, c.y, c.x, c.m, quantile_cont(w.v, 0.5) AS o FROM v c CROSS JOIN range(-1, 2) q(dy) CROSS JOIN range(-1, 2) r(dx) JOIN v w ON w.volume_id = c.volume_id AND w.y = " + fold_reflect("c.y + dy") + " AND w.x = " + fold_reflect("c.x + dx") + " GROUP BY ALL)"], rows("b"))
leaf("sharpen", o.Sharpen(), [blur("b", "v", "yx", uniform("sigma", 0.7, 1.5), 6)], rows("v JOIN b USING (volume_id, z, y, x)", f"v + {uniform('alpha', 0.2, 0.8)} * (v - o)"))
_clahe = [
    STATS,
    "q AS MATERIALIZED (SELECT volume_id, z, y, x, m, lo, hi, least(15, greatest(0, round_even((v - lo) / (hi - lo) * 15, 0)))::BIGINT AS b, y // 4 AS ty, x // 4 AS tx FROM v JOIN s USING (volume_id))",
    f"n AS MATERIALIZED (SELECT d.volume_id, ty, tx, b, coalesce(n, 0)::DOUBLE AS n, greatest(1, floor({uniform('clip_limit', 1.0, 3.0).replace('volume_id', 'd.volume_id')} * 16 / 16)) AS most FROM (SELECT DISTINCT volume_id FROM v) d CROSS JOIN range(2) p(ty) CROSS JOIN range(2) q(tx) CROSS JOIN range(16) r(b) LEFT JOIN (SELECT volume_id, ty, tx, b, count(*) AS n FROM q GROUP BY ALL) USING (volume_id, ty, tx, b))",
    "e AS (SELECT *, least(n, most) + sum(greatest(n - most, 0)) OVER (PARTITION BY volume_id, ty, tx) / 16 AS k FROM n)",
    "l AS MATERIALIZED (SELECT volume_id, ty, tx, b, sum(k) OVER (PARTITION BY volume_id, ty, tx ORDER BY b ROWS UNBOUNDED PRECEDING) / sum(k) OVER (PARTITION BY volume_id, ty, tx) AS f FROM e)",
    "c AS MATERIALIZED (SELECT volume_id, z, y, x, m, lo, hi, b, least(1, greatest(0, (y - 1.5) / 4)) AS fy, least(1, greatest(0, (x - 1.5) / 4)) AS fx FROM q)",
    "g AS (SELECT c.volume_id, z, y, x, m, lo, hi, sum((CASE WHEN l.ty = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN l.tx = 1 THEN fx ELSE 1 - fx END) * f) AS o FROM c JOIN l ON l.volume_id = c.volume_id AND l.b = c.b GROUP BY ALL)",
]
leaf("clahe_contrast", o.CLAHEContrast(grid=(2, 2), n_bins=16), _clahe, rows("g", "o * (hi - lo) + lo"))
_reference = [10.0, 10.5, 11.0, 11.2, 11.9, 12.0, 13.5, 14.0, 14.5, 15.0]
_histogram = [
    "q AS (" + " UNION ALL ".join(f"SELECT {k} AS k, quantile_cont(r, {k}.0 / 7) AS t FROM (SELECT unnest({_reference})::DOUBLE AS r)" for k in range(8)) + ")",
    "a AS (SELECT *, cume_dist() OVER (PARTITION BY volume_id ORDER BY v) AS f FROM v)",
    "b AS (SELECT *, least(floor(f * 7)::BIGINT, 6) AS k FROM a)",
]
leaf("histogram_match", o.HistogramMatch(reference=[_reference], blend=(0.5, 1.0), n_quantiles=8), _histogram, rows(f"(SELECT b.*, lo.t + (f * 7 - b.k) * (up.t - lo.t) AS t, {uniform('blend', 0.5, 1.0).replace('volume_id', 'b.volume_id')} AS w FROM b JOIN q lo ON lo.k = b.k JOIN q up ON up.k = b.k + 1)", "(1 - w) * v + w * t"))

# --- modality --------------------------------------------------------------------------------------------------------

_ghosts = " + ".join(f"{uniform(f'intensity{k}', 0.05, 0.15)} * (SELECT w.v FROM v w WHERE w.volume_id = c.volume_id AND w.x = c.x AND w.y = (((c.y - CASE WHEN {unit(f'sign{k}')} < 0.5 THEN 1 ELSE -1 END * {integer(f'shift{k}', 1, 3)}) % 8) + 8) % 8)".replace("|| volume_id ||", "|| c.volume_id ||") for k in range(2))
leaf("ghosting_artifact", o.GhostingArtifact(ghost_shift=(1, 3), num_ghosts=2), [], rows("v c", "v + " + _ghosts, z="c.z", y="c.y", x="c.x").replace("SELECT volume_id::BIGINT", "SELECT c.volume_id::BIGINT"))
_kspace = [
    "l AS (SELECT DISTINCT volume_id, y AS i FROM v)",
    field("f", "l", "lines0"),
    f"d AS MATERIALIZED (SELECT volume_id, i AS k FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY f, i) AS r FROM f) WHERE r <= greatest(1, round_even({uniform('fraction', 0.1, 0.4)} * 8, 0)))",
    "g AS (SELECT c.volume_id, c.z, c.y, c.x, c.v, c.m, sum(w.v * cos(2 * pi() * k * (c.y - w.y) / 8)) / 8 AS re, sum(w.v * sin(2 * pi() * k * (c.y - w.y) / 8)) / 8 AS im FROM v c JOIN d ON d.volume_id = c.volume_id JOIN v w ON w.volume_id = c.volume_id AND w.x = c.x GROUP BY ALL)",
]
leaf("kspace_dropout", o.KSpaceDropout(dropout_fraction=(0.1, 0.4)), _kspace, rows("g", "sqrt((v - re) * (v - re) + im * im)"))
_motion = [
    f"p AS MATERIALIZED (SELECT DISTINCT volume_id, radians({uniform('angle0', 1.0, 5.0)}) AS a, {uniform('dy0', 1.0, 4.0)} AS dy, {uniform('dx0', 1.0, 4.0)} AS dx FROM v)",
    "c AS MATERIALIZED (SELECT volume_id, z, y, x, " + bring_reflect("cos(a) * (y - 3.5) + sin(a) * (x - 3.5) + 3.5") + " AS c_y, " + bring_reflect("-sin(a) * (y - 3.5) + cos(a) * (x - 3.5) + 3.5") + " AS c_x FROM v JOIN p USING (volume_id))",
    gather("g", "c", "v", "yx"),
    "e AS MATERIALIZED (SELECT volume_id, z, y, x, " + bring_reflect("y - dy") + " AS c_y, " + bring_reflect("x - dx") + " AS c_x FROM v JOIN p USING (volume_id))",
    gather("t", "e", "g", "yx", fold_reflect, "o"),
]
leaf("mri_motion", o.MRIMotion(num_movements=(1, 1)), _motion, rows("v JOIN t USING (volume_id, z, y, x)", "(v + o) / 2"))
_r2 = "least(1, sqrt(((y - 3.5) / 3.5) * ((y - 3.5) / 3.5) + ((x - 3.5) / 3.5) * ((x - 3.5) / 3.5)))"
leaf("beam_hardening", o.BeamHardening(), [STATS], rows("v JOIN s USING (volume_id)", f"v - {uniform('alpha', 0.02, 0.08)} * (1 - {_r2} * {_r2}) * (hi - lo)"))
_metal = [STATS, f"p AS (SELECT v.*, lo, hi, y - {uniform('y0', 2.0, 6.0)} AS dy, x - {uniform('x0', 2.0, 6.0)} AS dx FROM v JOIN s USING (volume_id))"]
leaf("metal_streak", o.MetalStreak(), _metal, rows("p", f"v + {uniform('intensity', 0.1, 0.3)} * (hi - lo) * cos({integer('streaks0', 6, 12)} * atan2(dy, dx) + 2 * pi() * {unit('phase0')}) * exp(-sqrt(dy * dy + dx * dx) / (0.5 * sqrt(128) + 1e-8))"))
leaf("scatter_simulation", o.ScatterSimulation(sigma=(15.0, 40.0)), [blur("b", "v", "yx", uniform("sigma", 15.0, 40.0), 160)], rows("v JOIN b USING (volume_id, z, y, x)", f"v + {uniform('fraction', 0.1, 0.4)} * o"))
leaf("grid_artifact", o.GridArtifact(), [], rows("v", f"v * (1 + {uniform('amplitude', 0.03, 0.1)} * sin(2 * pi() * {uniform('frequency', 0.2, 0.45)} * x + 2 * pi() * {unit('phase')}))"))
leaf("slab_shift", o.SlabShift(max_shift=2, cval=-1.0), [f"c AS (SELECT *, {integer('shift', -2, 2)} AS s FROM v)"], rows("(SELECT c.volume_id, c.z, c.y, c.x, coalesce(w.v, -1) AS o, coalesce(w.m, 0) AS m FROM c LEFT JOIN v w ON w.volume_id = c.volume_id AND w.z = c.z - c.s AND w.y = c.y AND w.x = c.x)"), dims=3)
leaf("limited_angle_blur", o.LimitedAngleBlur(), [blur("b", "v", "z", f"20 / {uniform('arc', 15.0, 25.0)}", 6)], rows("(SELECT b.*, v.m FROM b JOIN v USING (volume_id, z, y, x))"), dims=3)
_slices = ["l AS (SELECT DISTINCT volume_id, z AS i FROM v)", field("f", "l", "which"), f"d AS (SELECT volume_id, i AS z, row_number() OVER (PARTITION BY volume_id ORDER BY f, i) <= {integer('slices', 1, 3)} AS gone FROM f)"]
leaf("slice_dropout", o.SliceDropout(num_slices=(1, 3), cval=-1.0, affect_mask=True), _slices, rows("v JOIN d USING (volume_id, z)", "CASE WHEN gone THEN -1 ELSE v END", "CASE WHEN gone THEN 0 ELSE m END"), dims=3)
_compress = [
    f"c AS MATERIALIZED (SELECT *, (y - 3.5) / {uniform('scale', 0.85, 1.15)} + 3.5 AS r FROM v)",
    "e AS MATERIALIZED (SELECT volume_id, z, y, x, least(7, greatest(0, r)) AS c_y FROM c)",
    gather("g", "e", "v", "y", lambda i, _: f"least({i}, 7)"),
    "k AS (SELECT c.volume_id, c.z, c.y, c.x, w.m FROM c JOIN v w ON w.volume_id = c.volume_id AND w.z = c.z AND w.x = c.x AND r BETWEEN 0 AND 7 AND w.y = floor(r + 0.5))",
]
leaf("compression_variation", o.CompressionVariation(), _compress, rows("(SELECT g.*, coalesce(k.m, 0) AS m FROM g LEFT JOIN k USING (volume_id, z, y, x))"), dims=3)
_recon = [
    f"p AS (SELECT DISTINCT volume_id, {uniform('amplitude', 0.05, 0.2)} AS a, {integer('planes', 1, 3)} AS n FROM v)",
    "c AS MATERIALIZED (SELECT v.volume_id, v.z, v.y, v.x, k * w AS d, a * pow(0.6, k - 1) AS f, v.x - w * k * 1.5 AS r FROM v JOIN p USING (volume_id) CROSS JOIN range(1, 4) q(k) CROSS JOIN (VALUES (1), (-1)) t(w) WHERE k <= n)",
    "g AS (SELECT c.volume_id, c.z, c.y, c.x, sum(f * w.v * (1 - abs(r - w.x))) AS o FROM c JOIN v w ON w.volume_id = c.volume_id AND w.z = c.z - d AND w.y = c.y AND r BETWEEN 0 AND 7 AND abs(r - w.x) < 1 GROUP BY ALL)",
]
leaf("recon_streak", o.ReconStreak(), _recon, rows("(SELECT v.*, coalesce(o, 0) AS o FROM v LEFT JOIN g USING (volume_id, z, y, x))", "v + o"), dims=3)

# --- plans -----------------------------------------------------------------------------------------------------------

_flip_gamma_noise = Compose([o.RandomFlip(p=0.5), o.GammaCorrection(gamma=(0.7, 1.4)), o.GaussianNoise(std=0.01, p=0.5)], seed=SEED)
_compose = [
    STATS,
    f"a AS MATERIALIZED (SELECT volume_id, z, y, CASE WHEN {unit('gate', '0.0')} < 0.5 AND {unit('flip1', '0.0')} < 0.5 THEN 7 - x ELSE x END AS x, m, pow((v - lo) / (hi - lo), {uniform('gamma', 0.7, 1.4, '0.1')}) * (hi - lo) + lo AS v FROM v JOIN s USING (volume_id))",
    "b AS MATERIALIZED (SELECT *, y * 8 + x AS i FROM a)",
    field("nr", "b", "noise.r", path="0.2"), field("na", "nr", "noise.a", path="0.2"),
]
_composed = f"v + CASE WHEN {unit('gate', '0.2')} < 0.5 THEN 0.01 * sqrt(-2 * ln(nr)) * cos(2 * pi() * na) ELSE 0 END"
leaf("compose_gate", _flip_gamma_noise, _compose, rows("na", _composed))
_bright = lambda path: f"(v * {uniform('contrast', 0.9, 1.1, path)} + {uniform('brightness', -0.1, 0.1, path)})"
_wave = lambda path, value: f"({value} * (1 + {uniform('amplitude', 0.03, 0.1, path)} * sin(2 * pi() * {uniform('frequency', 0.2, 0.45, path)} * x + 2 * pi() * {unit('phase', path)})))"
leaf("one_of", OneOf([o.BrightnessContrast(brightness=0.1, p=0.0), o.GridArtifact(), o.RandomFlip(p_per_axis=1.0)], weights=(1, 2, 1)), [f"c AS (SELECT *, {unit('pick')} AS u FROM v)"],
     rows("c", f"CASE WHEN u < 0.25 THEN {_bright('0.0')} WHEN u < 0.75 THEN {_wave('0.1', 'v')} ELSE v END", x="CASE WHEN u >= 0.75 THEN 7 - x ELSE x END"))
_some = ["l AS (SELECT volume_id, i FROM (SELECT DISTINCT volume_id FROM v) CROSS JOIN range(3) r(i))", field("f", "l", "children"), f"d AS (SELECT volume_id, bool_or(i = 0) AS c0, bool_or(i = 1) AS c1, bool_or(i = 2) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY f, i) AS r FROM f) WHERE r <= {integer('n', 1, 2)} GROUP BY volume_id)"]
leaf("some_of", SomeOf([o.BrightnessContrast(brightness=0.1), o.GridArtifact(), o.BrightnessContrast(contrast=(2.0, 2.0))], n=(1, 2)), [*_some, f"e AS (SELECT v.* EXCLUDE (v), CASE WHEN c0 THEN {_bright('0.0')} ELSE v END AS v, c1, c2 FROM v JOIN d USING (volume_id))"],
     rows("e", f"CASE WHEN c1 THEN {_wave('0.1', 'v')} ELSE v END * CASE WHEN c2 THEN 2 ELSE 1 END"))
_strict = VolumeValidator(intensity_bounds=(-0.3, 0.3), strict_bounds=True)
_guarded = o.BrightnessContrast(brightness=0.2, contrast=(0.7, 0.9))
_try = lambda path: f"(v * {uniform('contrast', 0.7, 0.9, path)} + {uniform('brightness', -0.2, 0.2, path)})"
_ok = lambda name: f"(min({name}) OVER w >= -0.3 AND max({name}) OVER w <= 0.3)"
leaf("guard_revert", Guard(_guarded, _strict, on_fail="revert"), [f"c AS (SELECT *, {_try('0.0')} AS a FROM v)", f"e AS (SELECT *, {_ok('a')} AS ok FROM c WINDOW w AS (PARTITION BY volume_id))"], rows("e", "CASE WHEN ok THEN a ELSE v END"))
leaf("guard_retry", Guard(_guarded, _strict, on_fail="retry", retries=3), [f"c AS (SELECT *, {_try('0.0')} AS a, {_try('0.1')} AS b, {_try('0.2')} AS d FROM v)", f"e AS (SELECT *, {_ok('a')} AS ka, {_ok('b')} AS kb, {_ok('d')} AS kd FROM c WINDOW w AS (PARTITION BY volume_id))"], rows("e", "CASE WHEN ka THEN a WHEN kb THEN b WHEN kd THEN d ELSE v END"))

for _name, _preset in PRESETS.items():
    leaf(f"preset_{_name}", _preset(SEED), None, None, dims=3 if _name == "dbt" else 2)

# --- tables, targets and checks --------------------------------------------------------------------------------------


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("voxels_roundtrip", f"WITH {V3} {rows('v', 'v')}")
def voxels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxel_rows(vol.from_voxels(vol.to_voxels(stacks(spark, sf_dir)), 3))


T2 = f"""{V2},
k AS (SELECT volume_id, y::DOUBLE AS y, x::DOUBLE AS x FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY v DESC, i) AS r FROM v) WHERE r = 1),
b AS (SELECT volume_id, min(y)::DOUBLE AS y0, min(x)::DOUBLE AS x0, max(y)::DOUBLE AS y1, max(x)::DOUBLE AS x1 FROM v WHERE m > 0 GROUP BY volume_id)"""


def target_rows(df: DataFrame) -> DataFrame:
    point = df.select("volume_id", F.lit("kp").alias("kind"), F.explode("keypoints").alias("t")).select("volume_id", "kind", F.col("t.coord").alias("lo"), F.col("t.coord").alias("hi"), "t.label")
    box = df.select("volume_id", F.lit("box").alias("kind"), F.explode("bboxes").alias("t")).select("volume_id", "kind", "t.lo", "t.hi", "t.label")
    return point.unionAll(box).select("volume_id", "kind", "label", *(six(F.col(c)[i]).alias(f"{c}_{a}") for c in ("lo", "hi") for i, a in enumerate("yx")))


def _target_sql(point: str, box: str, kept: str = "TRUE") -> str:
    names = ("lo_y", "lo_x", "hi_y", "hi_x")
    return f"SELECT volume_id, kind, label, {', '.join(f'{shown(n)} AS {n}' for n in names)} FROM ({point} UNION ALL {box}) WHERE {kept}"


_shift_sql = f"WITH {T2} " + _target_sql(
    "SELECT volume_id, 'kp' AS kind, 'peak' AS label, y - 1.5 AS lo_y, x + 2 AS lo_x, y - 1.5 AS hi_y, x + 2 AS hi_x FROM k WHERE y - 1.5 >= 0 AND x + 2 < 8",
    "SELECT volume_id, 'box', 'foreground', a0, b0, a1, b1 FROM (SELECT *, least(7, greatest(0, y0 - 1.5)) AS a0, least(7, greatest(0, x0 + 2)) AS b0, least(7, greatest(0, y1 - 1.5)) AS a1, least(7, greatest(0, x1 + 2)) AS b1 FROM b) WHERE (a1 - a0) * (b1 - b0) > 0 AND (a1 - a0) * (b1 - b0) >= 0.5 * (y1 - y0) * (x1 - x0)",
)


@query("prune_targets", _shift_sql)
def prune_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, move = images(spark, sf_dir), vol.translate_map([-1.5, 2.0])
    df = df.withColumns({"keypoints": vol.moved_points(F.col("keypoints"), move), "bboxes": vol.moved_boxes(F.col("bboxes"), move, 2)})
    return target_rows(vol.prune_targets(df, 0.5))


_c, _s = "cos(radians(30.0::DOUBLE))", "sin(radians(30.0::DOUBLE))"
_turn_y, _turn_x = lambda y, x: f"({_c} * ({y} - 3.5) - {_s} * ({x} - 3.5) + 3.5)", lambda y, x: f"({_s} * ({y} - 3.5) + {_c} * ({x} - 3.5) + 3.5)"
_ends = [("y0", "x0"), ("y0", "x1"), ("y1", "x0"), ("y1", "x1")]
_all = lambda f: ", ".join(f(*e) for e in _ends)
_warp_sql = f"WITH {T2} " + _target_sql(
    f"SELECT volume_id, 'kp' AS kind, 'peak' AS label, {_turn_y('y', 'x')} AS lo_y, {_turn_x('y', 'x')} AS lo_x, {_turn_y('y', 'x')} AS hi_y, {_turn_x('y', 'x')} AS hi_x FROM k",
    f"SELECT volume_id, 'box', 'foreground', least({_all(_turn_y)}), least({_all(_turn_x)}), greatest({_all(_turn_y)}), greatest({_all(_turn_x)}) FROM b",
)


@query("warp_targets", _warp_sql)
def warp_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    c, s = math.cos(math.radians(30.0)), math.sin(math.radians(30.0))
    df, move = images(spark, sf_dir), vol.affine_map([[c, -s], [s, c]], F.col("shape"), [0.0, 0.0])
    return target_rows(df.withColumns({"keypoints": vol.moved_points(F.col("keypoints"), move), "bboxes": vol.moved_boxes(F.col("bboxes"), move, 2)}))


_flip_sql = f"WITH {T2}, q AS (SELECT *, {unit('flip0')} < 0.5 AS fy, {unit('flip1')} < 0.5 AS fx FROM (SELECT DISTINCT volume_id FROM v)) " + _target_sql(
    "SELECT volume_id, 'kp' AS kind, 'peak' AS label, CASE WHEN fy THEN 7 - y ELSE y END AS lo_y, CASE WHEN fx THEN 7 - x ELSE x END AS lo_x, CASE WHEN fy THEN 7 - y ELSE y END AS hi_y, CASE WHEN fx THEN 7 - x ELSE x END AS hi_x FROM k JOIN q USING (volume_id)",
    "SELECT volume_id, 'box', 'foreground', CASE WHEN fy THEN 7 - y1 ELSE y0 END, CASE WHEN fx THEN 7 - x1 ELSE x0 END, CASE WHEN fy THEN 7 - y0 ELSE y1 END, CASE WHEN fx THEN 7 - x0 ELSE x1 END FROM b JOIN q USING (volume_id)",
)


@query("flip_targets", _flip_sql)
def flip_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_rows(augment(images(spark, sf_dir), o.RandomFlip(axes=("x", "y")), SEED))


_checks = VolumeValidator(intensity_bounds=(-0.25, 0.35), min_foreground_fraction=0.2, max_foreground_loss=0.3, max_intensity_shift=0.3)
_validate_sql = f"""WITH {V2}, c AS (SELECT *, {unit('flip1')} AS u FROM v WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5),
a AS (SELECT volume_id, min(v) AS lo, max(v) AS hi, avg(v) AS mean, avg((m <> 0)::INT) AS share, list(DISTINCT m) AS labels FROM c GROUP BY volume_id),
r AS (SELECT volume_id, avg(v) AS r_mean, stddev_pop(v) AS r_sd, avg((m <> 0)::INT) AS r_share, list(DISTINCT m) AS r_labels FROM v GROUP BY volume_id),
i AS (SELECT volume_id, unnest([
  CASE WHEN lo < -0.25 OR hi > 0.35 THEN 'intensity_bounds|warning' END, CASE WHEN share < 0.2 THEN 'min_foreground|error' END,
  CASE WHEN len(list_filter(r_labels, lambda x: x <> 0 AND NOT list_contains(labels, x))) > 0 THEN 'mask_labels|error' END,
  CASE WHEN r_share > 0 AND 1 - share / r_share > 0.3 THEN 'foreground_loss|error' END,
  CASE WHEN r_sd > 0 AND abs(mean - r_mean) > 0.3 * r_sd THEN 'intensity_shift|warning' END]) AS found FROM a JOIN r USING (volume_id))
SELECT volume_id, split_part(found, '|', 1) AS "check", split_part(found, '|', 2) AS severity FROM i WHERE found IS NOT NULL"""


@query("validate_report", _validate_sql)
def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = images(spark, sf_dir).withColumns({"image_before": F.col("image"), "mask_before": F.col("mask")})
    after = augment(before, o.CenterCrop(size=(4, 4)), SEED)
    found = vol.issues(_checks, reference="image_before", reference_mask="mask_before")
    return after.select("volume_id", F.explode(found).alias("i")).select("volume_id", "i.check", "i.severity")


@query("volume_properties", f"WITH {V2} SELECT volume_id, 2 AS ndim, FALSE AS is_3d, TRUE AS has_mask, 1 AS num_keypoints, (max(m) > 0)::INT AS num_bboxes, TRUE AS has_keypoints, max(m) > 0 AS has_bboxes, ['MR', 'CT', 'DX', 'DBT'][(min(tag) % 4 + 1)::INT] AS modality, 0 AS faults FROM v GROUP BY volume_id")
def volume_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vol.derived(vol.checked(images(spark, sf_dir)))
    return df.select("volume_id", "ndim", "is_3d", "has_mask", "num_keypoints", "num_bboxes", "has_keypoints", "has_bboxes", "modality", F.size(vol.faults()).alias("faults"))


_steps_sql = """SELECT * FROM (VALUES ('', 'Compose', 0), ('0', 'RandomFlip', 1), ('1', 'GammaCorrection', 1), ('2', 'GaussianNoise', 1)) t(path, name, depth)"""


@query("plan_steps", _steps_sql)
def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_steps(spark, _flip_gamma_noise).select(F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "name", "depth")


_summary_sql = f"WITH {', '.join([V2, *_compose])} SELECT volume_id, {shown('avg(o)')} AS mean, {shown('min(o)')} AS low, {shown('max(o)')} AS high, (min(o) = max(o)) AS bad FROM (SELECT volume_id, {_composed} AS o FROM na) GROUP BY volume_id"


@query("plan_statistics", _summary_sql)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's mean, extremes and validity after a plan of a flip, a gamma correction and noise."""
    df = augment(images(spark, sf_dir), _flip_gamma_noise)
    s = vol.statistics(F.col("image"))
    return df.select("volume_id", six(s["mean"]).alias("mean"), six(s["low"]).alias("low"), six(s["high"]).alias("high"), (F.size(vol.issues(VolumeValidator())) > 0).alias("bad"))

