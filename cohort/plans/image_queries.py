"""Image queries on pictures that Spark makes from the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohort.operators import augment, fingerprint, profile
from cohort.plans.inputs import PIXELS_SQL, rounded, vector_images
from cohort.plans.registry import query


@query("a5_pixel_moments", f"""WITH {PIXELS_SQL},
cell AS (SELECT label, unnest(p) / 255.0::DOUBLE AS x FROM pixels),
found AS (SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM cell GROUP BY label)
SELECT label, channel, n, mean, std FROM found, (VALUES ('R'), ('G'), ('B')) c(channel)""")
def pixel_moments(spark, folder):
    sums = profile.pixel_sums(vector_images(spark, folder), ["label"])
    return rounded(profile.channel_moments(sums, ["label"]), "mean", "std")


@query("w7_base_transform", f"""WITH {PIXELS_SQL}
SELECT vec_id, 1 AS variant, round((p[1] / 255 - 0.485) / 0.229, 4) AS first_r,
  round((p[1] / 255 - 0.456) / 0.224, 4) AS first_g,
  round((p[64] / 255 - 0.406) / 0.225, 4) AS last_b, 192 AS length FROM pixels""")
def base_transform(spark, folder):
    done = augment.transform_images(vector_images(spark, folder), "vec_id", size=8)
    value = F.col("tensor")
    return rounded(done.select(
        "vec_id", "variant", value[0].cast("double").alias("first_r"),
        value[64].cast("double").alias("first_g"), value[191].cast("double").alias("last_b"),
        F.size("tensor").alias("length")), "first_r", "first_g", "last_b", digits=4)


@query("w11_image_prints")
def image_prints(spark, folder):
    """Perceptual hash of every picture; resize and cosine transform have no SQL form."""
    return fingerprint.image_prints(vector_images(spark, folder)).select("vec_id", "print")
