import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe import operators as o
from lumenframe import queries as q
from lumenframe import query_sources as qs
from lumenframe.functions import volumes as vol
from lumenframe.functions.draws import Draws
from lumenframe.plans.apply import augment
from lumenframe.plans.node import Compose
from lumenframe.plans.sample import Sample
from lumenframe.sources import adapt
from lumenframe.streaming.augment import augment_stream, read_volumes

SF = "/root/testdata/sf0.001"


def table(spark, n=6, extra=None):
    rng = np.random.default_rng(4)
    rows = [(i, [4, 5], rng.random(20).astype(np.float32).tolist(), (rng.random(20) > 0.5).astype(int).tolist(), f"x{i}") for i in range(n)]
    return spark.createDataFrame(rows, "volume_id long, shape array<int>, image array<float>, mask array<int>, note string")


PLAN = Compose([o.RandomFlip(p=0.5), o.GaussianNoise(std=0.1), o.Resize(size=(6, 5))], seed=5)


def test_augment_is_the_plan_on_each_row_whatever_the_partitions(spark):
    df = table(spark)
    rows = {r.volume_id: r for r in augment(df, PLAN).collect()}
    for r in df.collect():
        want = PLAN(Sample(np.array(r.image, np.float32).reshape(4, 5), np.array(r["mask"], np.int32).reshape(4, 5), (1.0, 1.0)), Draws(5, "0", r.volume_id))
        assert np.array_equal(np.array(rows[r.volume_id].image, np.float32), want.image.ravel()) and rows[r.volume_id].shape == [6, 5] and rows[r.volume_id].note == f"x{r.volume_id}"
    for n in (1, 5):
        assert {r.volume_id: r.image for r in augment(df.repartition(n), PLAN).collect()} == {k: r.image for k, r in rows.items()}
    assert {r.volume_id: r.image for r in augment(df, PLAN, epoch=1).collect()} != {k: r.image for k, r in rows.items()}


def test_augment_of_odd_tables(spark):
    df = table(spark, 2).unionByName(spark.createDataFrame([(9, [2, 2], None, None, None)], "volume_id long, shape array<int>, image array<float>, mask array<int>, note string"))
    assert next(r for r in augment(df, PLAN).collect() if r.volume_id == 9).image is None
    assert augment(df.limit(0), PLAN).count() == 0
    assert augment(df.withColumn("image", F.col("image").cast("array<double>")), PLAN).schema["image"].dataType.simpleString() == "array<double>"
    assert "MapInArrow" not in augment(df, Compose([o.GaussianBlur(sigma=0.0)]))._jdf.queryExecution().toString()


def test_no_shuffle_in_a_plan(spark):
    assert "Exchange" not in augment(spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("volume_id"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").alias("image")), PLAN)._jdf.queryExecution().toString()


def test_invariants(spark):
    bad = table(spark, 1).withColumn("image", F.slice("image", 1, 3)).withColumn("spacing", F.array(F.lit(1.0)))
    assert vol.volumes(bad).select(vol.faults().alias("f")).first().f == ["image does not fit shape", "spacing must have one value an axis"]
    with pytest.raises(Exception, match="does not fit"):
        vol.checked(vol.volumes(bad)).collect()


def test_validator_column_agrees_with_the_validator(spark):
    from lumenframe.plans.validate import VolumeValidator

    v = VolumeValidator(intensity_bounds=(0.05, 0.95), min_foreground_fraction=0.5)
    df = table(spark).withColumn("image", F.when(F.col("volume_id") == 0, F.transform("image", lambda _: F.lit(float("nan")).cast("float"))).otherwise(F.col("image")))
    for r in df.withColumn("found", vol.issues(v)).collect():
        want = v.validate(Sample(np.array(r.image).reshape(4, 5), np.array(r["mask"]).reshape(4, 5), (1.0, 1.0)))
        assert [(i.check, i.severity) for i in r.found] == [(i.check, i.severity) for i in want.issues]


def test_stream(spark, tmp_path):
    vol.volumes(table(spark)).select(*vol.COLUMNS).repartition(3).write.parquet(str(tmp_path / "in"))
    augment_stream(read_volumes(spark, str(tmp_path / "in"), files_per_batch=1), PLAN, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True).awaitTermination()
    got = {r.volume_id: r.image for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.volume_id: r.image for r in augment(table(spark), PLAN).collect()}


def test_other_column_names_and_channels(spark):
    df = table(spark).select(F.col("volume_id").alias("id"), F.array(F.lit(1), F.lit(4), F.lit(5)).alias("size"), F.col("image").alias("scan"), F.col("mask").cast("array<smallint>").alias("label"), "note")
    out = adapt.augment_columns(df, PLAN, volume_id="id", shape="size", channel="first")
    assert out.dtypes == df.dtypes and out.first().size == [1, 6, 5]
    assert {r.id: r.scan for r in out.collect()} == {r.volume_id: r.image for r in augment(table(spark), PLAN).collect()}
    with pytest.raises(KeyError):
        adapt.augment_columns(df, PLAN, image="nothing", shape="size", volume_id="id")


def test_samples_in_memory():
    image, mask = np.random.default_rng(0).random((1, 8, 8)).astype(np.float32), np.ones((1, 8, 8), np.uint8)
    t = adapt.SampleTransform(Compose([o.RandomFlip(p_per_axis=1.0)]), channel="first")
    a, b = t((image, mask))
    assert a.shape == (1, 8, 8) and b.dtype == np.uint8 and np.array_equal(a, image[..., ::-1])
    out = adapt.MonaiMapTransform(Compose([o.Pad(size=(10, 10))]))({"image": image[0], "label": mask[0], "id": 3})
    assert out["image"].shape == (10, 10) and out["id"] == 3 and np.array_equal(t(image), image[..., ::-1])
    with pytest.raises(KeyError):
        t({"other": 1})
    with pytest.raises(TypeError):
        t({"image": image, "metadata": 3})
    with pytest.raises(ValueError):
        t((image,))
    with pytest.raises(ValueError):
        adapt.SampleTransform(PLAN, channel="last")(image)

    class Image:
        def __init__(self, data):
            self.data, self.spacing = data, (1.0, 1.0)

        def set_data(self, data):
            self.data = data

    subject = {"scan": Image(image), "seg": Image(mask), "name": "s"}
    moved = adapt.TorchIOTransform(Compose([o.RandomFlip(p_per_axis=1.0)]))(subject)
    assert np.array_equal(moved["scan"].data, image[..., ::-1]) and np.array_equal(subject["scan"].data, image)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    cols = sorted(a.columns)
    if cols != sorted(b.columns) or len(a) != len(b):
        return False
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    return all((a[c] == b[c]).all() if a[c].dtype == object or a[c].dtype.kind not in "fi" else np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6) for c in cols)


ALL, SQL = q.QUERIES | qs.QUERIES, q.ORACLE_SQL | qs.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ALL))
def test_queries_against_sql(spark, name):
    got = ALL[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        assert same(got, con.execute(SQL[name]).fetchdf())
