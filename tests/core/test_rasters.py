import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import raster
from lumenforge.operators import heads
from lumenforge.operators import provenance as pv
from lumenforge.operators.fusion import fuse
from lumenforge.operators.rules import needs_cascade, with_rules
from lumenforge.sources import indexes


def png(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def noise(w, h, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def test_sine_peaks_at_its_bin():
    mags = raster.spectrum(np.sin(2 * np.pi * 4 * np.arange(64) / 64))
    assert mags.argmax() == 4
    with pytest.raises(ValueError):
        raster.spectrum(np.zeros(10))


def test_small_images_have_no_features():
    f = raster.features(noise(16, 16))
    assert (f["score"], f["detail"], f["lap"]) == (0.5, "too-small", 0.0)


def test_smooth_scores_above_noise():
    y, x = np.mgrid[:64, :64]
    smooth = np.stack([x * 2, y * 2, x + y], 2).astype(np.uint8)
    assert raster.features(smooth)["score"] > raster.features(noise(64, 64))["score"]
    assert raster.stub(smooth) > raster.stub(noise(64, 64))


@pytest.mark.parametrize("n", [16, 33, 64])
def test_wavelet_reconstructs(n):
    x = np.random.default_rng(n).normal(size=(n, n))
    a, d = raster.dwt(x, 1)
    assert np.allclose(raster.idwt(a, d, 1, n), x, atol=1e-8)
    a, d = raster.dwt(x, 0)
    assert np.allclose(raster.idwt(a, d, 0, n), x, atol=1e-8)


def test_denoise_takes_noise_off():
    y, x = np.mgrid[:64, :64] / 64.0
    rng = np.random.default_rng(2)
    dirty = x + y + rng.normal(0, 0.1, (64, 64))
    assert np.abs(raster.denoise(dirty) - (x + y)).mean() < np.abs(dirty - (x + y)).mean()


def test_tensors():
    t = raster.tensor(np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8), (0, 0, 0), (1, 1, 1))
    assert t.shape == (3, 1, 2) and t.reshape(-1).tolist() == [1, 0, 0, 1, 0, 0]
    m = raster.mark_tensor(noise(40, 30), 256)
    assert m.shape == (6, 256, 256) and np.isfinite(m).all() and m[5].sum() > 0


def test_resizing():
    flat = np.full((50, 80, 3), 77, np.uint8)
    for kind in ("bilinear", "lanczos"):
        assert (raster.resize(flat, 32, 40, kind) == 77).all()
    assert raster.short_side_crop(noise(60, 50), 44, 38).shape == (38, 38, 3)
    assert raster.box_downsample(noise(300, 200), 100).shape == (67, 100, 3)


def test_marks_are_read():
    assert raster.visible_mark(np.zeros((40, 40, 3), np.uint8))[1] == "visible-watermark:too-small"
    assert raster.visible_mark(np.zeros((100, 100, 3), np.uint8)) == (0.5, "visible-watermark:none", False)
    assert raster.read_glyphs(np.array([[b == "1" for b in dict(raster.GLYPHS)[c]] for c in "FLUX"])) == "FLUX"


@pytest.mark.parametrize("text, phrase", [("madebygrok", "grok"), ("gr0k", "grok"), ("grk", "grok"), ("ok", None), ("opena1", "openai"), ("flui", "flux"), ("abci", None), ("zz", None), ("midjxurnoy", "midjourney"), ("midjxxxney", None), ("xqai", "xai"), ("wxyz", None)])
def test_phrases_forgive_slips(text, phrase):
    assert raster.match_phrase(text) == phrase


@pytest.mark.parametrize("text, phrase", [("OPENAI", "xai"), ("FLUX", None), ("SORA", None), ("HELLO", None)])
def test_marks_that_are_written_are_found(text, phrase):
    """OPENAI reads 0PENAI, whose NAI is one slip from the earlier phrase XAI."""
    want = (0.99, f"visible-watermark:{phrase}", True) if phrase else (0.5, "visible-watermark:none", False)
    assert raster.visible_mark(raster.written(text, 200, 120)) == want


def test_the_whole_flow_is_its_parts_in_order(spark):
    """Provenance first, then marks, then features and heads; what is settled goes no further, and the second head runs where the gate asks, or always."""
    calls = spark.sparkContext.accumulator(0)

    @heads.register("counted")
    def make():
        def run(images):
            calls.add(len(images))
            return np.array([0.25 + 0.5 * raster.stub(x) for x in images])

        return run

    images = {1: noise(64, 64, 1), 2: np.full((96, 96, 3), 200, np.uint8), 3: raster.written("OPENAI", 200, 120), 4: noise(80, 70, 4), 5: np.tile(np.arange(128, dtype=np.uint8)[None, :, None], (100, 1, 3)), 6: noise(64, 64, 6), 7: None}
    content = {k: b"Software: Midjourney v6" if k == 4 else b"plain" for k in images}
    rows = [(k, bytearray(content[k]), *((x.shape[1], x.shape[0], bytearray(x.tobytes())) if x is not None else (None, None, None))) for k, x in images.items()]
    table = spark.createDataFrame(rows, "image_id int, content binary, width int, height int, rgb binary")
    for always in (False, True):
        calls.value = 0
        got = {r.image_id: r for r in heads.detect(table, second="counted", always=always).collect()}
        parts = []
        for k, x in images.items():
            prov, detail, stop = (0.98, "watermark-meta:software:" + r"\bmidjourney\b", True) if k == 4 else (0.5, "no-provenance", False)
            f, d = {}, None
            if x is not None and not stop:
                mark, mark_detail, mark_stop = raster.visible_mark(x)
                prov, detail, stop = (mark, mark_detail, True) if mark_stop else (prov, detail, stop)
                f, d = raster.features(raster.box_downsample(x)), raster.stub(x)
            parts.append((k, prov, detail, stop, d, f, min(x.shape[:2]) if x is not None and k != 4 else None))
        types = ", ".join(f"{n} {'int' if n in ('colors', 'f_colors') else 'double'}" for n in raster.NAMES)
        flat = spark.createDataFrame([(k, p, t, s, 0.5 if d is None else float(d), float(f.get("score", 0.5)), side, *[None if n not in f else int(f[n]) if n in ("colors", "f_colors") else float(f[n]) for n in raster.NAMES]) for k, p, t, s, d, f, side in parts], f"image_id int, prov double, prov_detail string, prov_stop boolean, d double, s double, min_side int, {types}")
        ruled = with_rules(flat)
        needs = {r.image_id: r.n for r in ruled.select("image_id", (~F.col("prov_stop") & (F.lit(True) if always else F.coalesce(F.expr(needs_cascade()), F.lit(True)))).alias("n")).collect()}
        second = {k: 0.25 + 0.5 * raster.stub(images[k]) for k, n in needs.items() if n and images[k] is not None}
        f = F.coalesce(*[F.when(F.col("image_id") == k, F.lit(float(v))) for k, v in second.items()], F.lit(None).cast("double"))
        want = {r.image_id: r for r in fuse(flat.withColumn("f", f)).collect()}
        assert calls.value == len(second) and (not always or len(second) == 4)
        for k in images:
            assert (got[k].label, got[k].branch, got[k].detail, got[k].prov_detail) == (want[k].label, want[k].branch, want[k].detail, want[k].prov_detail), k
            assert got[k].confidence == pytest.approx(want[k].confidence, abs=1e-6)
        assert got[3].prov_detail == "visible-watermark:xai" and got[4].label == "ai" and got[3].label == "ai"


@pytest.mark.parametrize("rows", [[(1, None)], [(1, None), (2, 48)], [(1, None), (2, None), (3, 48), (4, None)]])
def test_batches_without_rasters(spark, rows):
    """Each row is a partition of its own, so that some hold nothing but nulls."""
    blob = lambda side: (side, side, bytearray(noise(side, side).tobytes())) if side else (None, None, None)
    kinds = "image_id int, content binary, width int, height int, rgb binary"
    table = spark.sparkContext.parallelize([(k, bytearray(b"x"), *blob(side)) for k, side in rows], len(rows)).toDF(kinds)
    none = {k for k, side in rows if side is None}
    for got in (heads.measured(table, "image_id"), heads.second_head(table, F.lit(True), "stub"), heads.detect(table), heads.detect(table, second="stub"), heads.per_raster(table, "image_id", "a double, b string, c boolean, e int, f long", lambda x: (1.5, "s", True, 2, 3))):
        assert got.count() == len(rows)
    assert {r.image_id for r in heads.measured(table, "image_id").collect() if r.s is None and r.mark_stop is None and r.mark_detail is None} == none
    assert {r.image_id for r in heads.second_head(table, F.lit(True), "stub").collect() if r.f is None} == none
    made = {r.image_id: tuple(r)[1:] for r in heads.per_raster(table, "image_id", "a double, b string, c boolean, e int, f long", lambda x: (1.5, "s", True, 2, 3)).collect()}
    assert made == {k: (None,) * 5 if k in none else (1.5, "s", True, 2, 3) for k, _ in rows}
    assert {r.image_id for r in heads.detect(table, second="stub").collect() if r.label != "error"} >= none


def test_decoded_files_give_the_same_features(spark, tmp_path):
    images = {f"{k}": noise(48, 40, k) for k in range(3)}
    (tmp_path / "ai" / "Some Domain").mkdir(parents=True)
    for k, x in images.items():
        (tmp_path / "ai" / "Some Domain" / f"{k}.png").write_bytes(png(x))
    rows = heads.rasters(spark.read.format("image").option("recursiveFileLookup", True).load(str(tmp_path)))
    rows = rows.withColumn("image_id", F.regexp_extract("path", r"(\d)\.png$", 1))
    got = {r.image_id: r for r in heads.measured(rows, "image_id").collect()}
    for k, x in images.items():
        assert got[k].lap == pytest.approx(raster.features(x)["lap"]) and got[k].d == pytest.approx(raster.stub(x))
    files = indexes.image_folder(spark, str(tmp_path))
    assert {(r.label, r.domain, r.extension, r.y) for r in files.collect()} == {("ai", "some-20domain", "png", 1)} or {r.label for r in files.collect()} == {"ai"}


def test_files_that_are_no_images_stay_with_an_error(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(noise(40, 36)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nnot an image")
    rows = heads.rasters(spark.read.format("image").load(str(tmp_path)))
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.rgb is None, r.error) for r in rows.collect()}
    assert got == {"good.png": (40, 36, False, None), "bad.png": (None, None, True, "undecodable")}
    scored = {r.path.rsplit("/", 1)[-1]: r.d for r in heads.measured(rows, "path").collect()}
    assert scored["bad.png"] is None and scored["good.png"] == pytest.approx(raster.stub(noise(40, 36)))


def test_second_head_runs_where_the_gate_asks(spark):
    calls = spark.sparkContext.accumulator(0)

    @heads.register("counting")
    def make():
        def run(images):
            calls.add(len(images))
            return np.array([0.9] * len(images))

        return run

    blob = noise(64, 64).tobytes()
    rows = spark.createDataFrame([(k, 64, 64, bytearray(blob)) for k in range(10)], "image_id int, width int, height int, rgb binary")
    got = {r.image_id: r.f for r in heads.second_head(rows, F.col("image_id") < 4, "counting").collect()}
    assert got == {k: 0.9 if k < 4 else None for k in range(10)} and calls.value == 4


EXIF = b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + 11) + b"Midjourney!" + b"\xff\xda" + b"x" * 20_000
PNG_TEXT = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 9) + b"tEXt" + b"steps: 20" + b"\0" * 4 + struct.pack(">I", 20_000) + b"IDAT" + b"chatgpt " * 2500 + b"\0" * 4 + struct.pack(">I", 0) + b"IEND" + b"\0" * 4 + b"z" * 16_000


@pytest.mark.parametrize("content, score, stop, part", [
    (b"", 0.5, False, "empty-bytes"), (None, 0.5, False, "empty-bytes"), (b"plain bytes", 0.5, False, "no-provenance"), (b"Software Midjourney v6", 0.98, True, "software"),
    (b"c2pa.watermarked.unbound", 0.99, True, "synthid-meta:c2pa"), (b"soft-binding", 0.99, True, "soft"), (b"Sampler: Euler", 0.93, True, "sampler"), (b'"Label":"1"', 0.93, True, "Label"), (b'"label":"1"', 0.5, False, "no-prov"),
    (b"a" * 600_000 + b" midjourney", 0.98, True, "midjourney"), (b"\xe9xai\xe9", 0.98, True, "xai"), (b"taxair", 0.5, False, "no-prov"), (b"made\xa0with\xa0ai", 0.98, True, "made"),
    (b"http://ns.adobe.com/xap/1.0/" + b"q" * 8_000, 0.62, False, "large-xmp"), (EXIF, 0.98, True, "midjourney"), (PNG_TEXT, 0.93, True, "steps"),
])
def test_provenance_cases(spark, content, score, stop, part):
    r = pv.verdict(spark.createDataFrame([(None if content is None else bytearray(content),)], "content binary")).first()
    assert (r.prov, r.prov_stop) == (score, stop) and part in r.prov_detail


def test_indexes(spark, tmp_path):
    ai, real = tmp_path / "ai.json", tmp_path / "real.json"
    ai.write_text('{"generatedAt": "x", "count": 2,\n "images": [{"file": "a.png"}, {"file": "gone.png"}]}')
    real.write_text('{"images": [{"file": "b.png", "hardCase": true}]}')
    files = spark.createDataFrame([("a.png",), ("b.png",)], "file string")
    got = {(r.file, r.label, r.hardCase) for r in indexes.two_indexes(spark, str(ai), str(real), files).collect()}
    assert got == {("a.png", "ai", False), ("b.png", "real", True)}
    empty, named = tmp_path / "empty.json", tmp_path / "named.json"
    empty.write_text('{"images": []}')
    named.write_text('{"images": [{"file": "c.png", "label": "real"}, {"file": "d.png", "label": "?"}]}')
    assert [r.file for r in indexes.labelled_index(spark, str(empty), str(named)).collect()] == ["c.png"]
