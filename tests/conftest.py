import os
import pathlib
import struct
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent))

from cohort.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder


def png(pixels: np.ndarray) -> bytes:
    """PNG bytes of (h, w) grey or (h, w, 3) RGB pixels."""
    h, w = pixels.shape[:2]
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines))
            + chunk(b"IEND", b""))


def picture(seed: int, side: int = 48) -> np.ndarray:
    """Smooth random RGB picture."""
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(0, 255, (6, 6, 3))
    grown = np.kron(coarse, np.ones((side // 6, side // 6, 1)))
    return np.clip(grown + rng.normal(0, 2, grown.shape), 0, 255).astype(np.uint8)


@pytest.fixture(scope="session")
def image_folder(tmp_path_factory):
    """Training and Testing folders with a copy, a near copy, a grey and a broken file."""
    root = tmp_path_factory.mktemp("images")
    seed = 0
    for side, count in (("Training", 4), ("Testing", 2)):
        for label in ("glioma", "notumor"):
            folder = root / side / label
            folder.mkdir(parents=True)
            for i in range(count):
                (folder / f"{label}_{side[:2]}_{i}.png").write_bytes(png(picture(seed)))
                seed += 1
    first = picture(0)
    (root / "Testing" / "glioma" / "copy.png").write_bytes(png(first))
    brighter = np.clip(first.astype(int) + 3, 0, 255).astype(np.uint8)
    (root / "Testing" / "glioma" / "near.PNG").write_bytes(png(brighter))
    (root / "Testing" / "notumor" / "grey.png").write_bytes(png(picture(99)[:, :, 0]))
    (root / "Testing" / "notumor" / "broken.png").write_bytes(b"not an image")
    (root / "Testing" / "notumor" / "notes.txt").write_bytes(b"text")
    return str(root)
