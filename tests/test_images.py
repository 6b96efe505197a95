import os

import numpy as np
import pytest
from conftest import picture, png
from pyspark.sql import functions as F

from cohort.operators import augment, pairs, profile
from cohort.operators.fingerprint import image_prints
from cohort.sources import images


def test_scan_takes_label_and_side_from_the_path(spark, image_folder):
    rows = images.scan_images(spark, image_folder).collect()
    assert len(rows) == 16
    assert {r.label for r in rows} == {"glioma", "notumor"}
    assert sum(r.original_split == "train" for r in rows) == 8


def test_broken_files_are_quarantined(spark, image_folder):
    frame = images.decode_images(spark, image_folder)
    bad = images.quarantined(frame).collect()
    assert [os.path.basename(r.path) for r in bad] == ["broken.png"] and bad[0].error
    modes = {r["mode"]: r["count"] for r in images.readable(frame).groupBy("mode").count()
             .collect()}
    assert modes == {"L": 1, "RGB": 14}


def test_copies_are_found_by_fingerprint(spark, image_folder):
    prints = image_prints(images.decode_images(spark, image_folder)).select(
        "path", "label", "original_split", "print")
    assert prints.where(F.col("print").isNull()).count() == 1
    cross = pairs.cross_split_pairs(pairs.side_groups(prints, "path"))
    names = {(os.path.basename(r.first_train), os.path.basename(r.first_test), r.distance)
             for r in cross.collect()}
    assert ("glioma_Tr_0.png", "copy.png", 0) in {(a, b, d) for a, b, d in names if d == 0}
    assert all(a == "glioma_Tr_0.png" for a, _, _ in names)
    assert all(len(r.print) == 64 for r in prints.where(F.col("print").isNotNull()).collect())


def test_pixel_moments_equal_numpy(spark, tmp_path):
    pictures = [picture(i, side) for i, side in ((1, 48), (2, 24))]
    for i, p in enumerate(pictures):
        (tmp_path / f"{i}.png").write_bytes(png(p))
    frame = images.decode_images(spark, str(tmp_path))
    moments = profile.channel_moments(profile.pixel_sums(frame)).collect()
    pixels = np.concatenate([p.reshape(-1, 3) for p in pictures]) / 255.0
    for r in moments:
        x = pixels[:, profile.CHANNELS.index(r.channel)]
        assert (r.n, r.mean, r.std) == (x.size, pytest.approx(x.mean()), pytest.approx(x.std()))


def test_drift_limit(spark):
    moments = spark.createDataFrame([("train", "R", 0.50, 0.2), ("test", "R", 0.53, 0.21)],
                                    "split string, channel string, mean double, std double")
    found = {r.stat: r.status for r in profile.drift(moments).collect()}
    assert found == {"mean": "DRIFT", "std": "OK"}


def test_base_transform_of_a_flat_picture(spark, tmp_path):
    (tmp_path / "flat.png").write_bytes(png(np.full((10, 20, 3), 255, np.uint8)))
    (tmp_path / "bad.png").write_bytes(b"x")
    rows = augment.transform_images(images.decode_images(spark, str(tmp_path)), size=8).collect()
    assert len(rows) == 1
    tensor = np.array(rows[0].tensor).reshape(3, 8, 8)
    expected = (1 - np.array(augment.MEAN)) / np.array(augment.STD)
    assert np.allclose(tensor, expected[:, None, None], atol=1e-5)


@pytest.mark.parametrize("mode", ["conservative", "aggressive"])
def test_variants_do_not_depend_on_partitioning(spark, image_folder, mode):
    frame = images.decode_images(spark, image_folder).where("label = 'glioma'")
    one, two = (augment.transform_images(f, mode=mode, variants=3, size=32).orderBy(
        "path", "variant").collect() for f in (frame.coalesce(1), frame.repartition(5)))
    assert one == two and len(one) == 3 * 8
    assert len({tuple(r.tensor[:200]) for r in one}) > 12
    assert all(np.isfinite(r.tensor).all() and len(r.tensor) == 3 * 32 * 32 for r in one)


def test_every_augmentation_step_runs():
    x = picture(3) / 255.0
    for mode in ("conservative", "aggressive"):
        always = {k: (1.0 if k in ("affine", "flip", "light", "clahe", "blur", "noise",
                                   "elastic", "cutout") else v)
                  for k, v in augment.MODES[mode].items()}
        out = augment.vary(x, np.random.default_rng(0), always)
        assert out.shape == x.shape and np.isfinite(out).all() and not np.allclose(out, x)


def test_unknown_mode_is_an_error(spark, image_folder):
    with pytest.raises(ValueError):
        augment.transform_images(images.decode_images(spark, image_folder), mode="wild")


def test_manifest_renames_collisions(spark, tmp_path):
    rows = spark.createDataFrame(
        [(f"/{d}/{n}", "a", "train") for d in ("k", "l", "m") for n in ("x.jpg", "y.jpg")]
        + [("/k/x_1.jpg", "a", "train"), ("/l/x.jpg2", "b", "train")],
        "path string, label string, split string")
    done = images.split_manifest(rows)
    targets = [r.destination for r in done.collect()]
    assert len(set(targets)) == len(targets) == 8
    assert "train/a/x_1.jpg" in targets and "train/b/x.jpg2" in targets
    assert {r.destination for r in done.where("path = '/k/x_1.jpg'").collect()} == {
        "train/a/x_1.jpg"}
    folder = str(tmp_path / "out")
    images.write_split(done, folder)
    assert spark.read.parquet(folder).where("split = 'train' and label = 'a'").count() == 7
    with pytest.raises(Exception):
        images.write_split(done, folder)
    images.write_split(done, folder, force=True)
