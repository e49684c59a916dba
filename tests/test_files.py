"""Sources and sinks: series, scene arrays, pixels by seek, segments by block, configuration."""

import numpy as np

from chronotile.operators import kernels
from chronotile.plans import workflows
from chronotile.schema import Grid
from chronotile.sources import files


def test_series(spark, tmp_path):
    (tmp_path / "a.csv").write_text("730500,1,2,3,4,5,6,7,0,1\n730496,2,2,3,4,5,6,7,4,2\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [r["date"] for r in rows.orderBy("seq").collect()] == [730496, 730500]
    files.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "b.txt").write_text("﻿0\n735040\n0\n")
    assert [r["break_date"] for r in files.read_breaks(spark, str(tmp_path / "b.txt")).collect()] == [735040]


def test_stack(spark, tmp_path):
    grid = Grid(4, 6, 2, 1)
    for name, fill in (("LT05xxxxx2000032xx", 0), ("LE07xxxxx2000040xx", 255), ("LT05xxxxx1999365xx", 0)):
        a = np.zeros((4, 3, 8), np.int16) + np.arange(8)
        a[:, :, 7] = fill
        a[0, 0, 7] = 0
        np.save(tmp_path / f"{name}.npy", a)
    assert [r["date"] for r in files.list_scenes(spark, str(tmp_path)).collect()] == [730119, 730151, 730159]
    rows = files.read_stack(spark, str(tmp_path), grid, block_x=2, low=730120).collect()
    assert len(rows) == 12 + 1 and {r["date"] for r in rows} == {730151, 730159}
    assert {r["pos"] for r in rows if r["date"] == 730159} == {4}
    assert {r["pos"] for r in rows} == {r * 6 + c for r in range(4) for c in (4, 5, 6)}
    assert files.read_stack(spark, str(tmp_path), grid, low=800000).collect() == []


def test_pixel_by_seek(spark, tmp_path):
    a = np.arange(2 * 3 * 8, dtype="<i2").reshape(2, 3, 8)
    (tmp_path / "LT2000032AA.bip").write_bytes(a.tobytes())
    (tmp_path / "LT2000040AA.bip").write_bytes((a + 300).astype("<i2").tobytes())  # fill
    rows = files.read_bip(spark, str(tmp_path), 2, 3, 2, 1).collect()
    assert len(rows) == 1 and rows[0]["pos"] == 4 and rows[0]["date"] == 730151 and rows[0]["blue"] == 24


def test_segments_by_block(spark, tmp_path):
    grid, path = Grid(2, 4, 2, 1), str(tmp_path / "segments")
    rows = spark.createDataFrame([(p, 0) for p in range(1, 9)], "pos long, seg int")
    blocks = spark.createDataFrame([(1,), (2,)], "block_id long")
    assert files.unfinished(blocks, path).count() == 2
    files.write_segments(rows.filter("pos in (1, 2, 5, 6)"), grid, path)
    assert [r["block_id"] for r in files.unfinished(blocks, path).collect()] == [2]
    files.write_segments(rows.filter("pos in (3, 4)"), grid, path)
    assert sorted(r["pos"] for r in files.read_segments(spark, path).collect()) == [1, 2, 3, 4, 5, 6]
    files.report(spark, str(tmp_path / "report"), blocks=2)
    assert spark.read.json(str(tmp_path / "report")).first()["blocks"] == "2"


def test_config():
    c = files.load_config("# grid\nn_rows: 53\nn_cols: 53 # wide\nname: 'x'\nshare: 0.5\n")
    assert c == {"n_rows": 53, "n_cols": 53, "name": "x", "share": 0.5} and Grid.of(c).n_rows == 53


def _obs(spark, jump):
    from test_kernels import series

    rows = []
    for pos in range(1, 17):
        days, bands, qa = series(jump_at=150 if pos in jump else None, seed=pos)
        rows += [(pos, k, int(d), *map(int, bands[:, k]), int(qa[k])) for k, d in enumerate(days)]
    from chronotile.schema import OBS

    return spark.createDataFrame(rows, OBS)


def test_bad_series_does_not_end_a_job(spark):
    rows = _obs(spark, ()).filter("pos <= 2").selectExpr("pos", "seq", "date", *[f"if(pos = 1, 20000, {b}) as {b}" for b in ("blue", "green", "red", "nir", "swir1", "swir2")], "thermal", "qa")
    got = {r["pos"]: r["status"] for r in kernels.detect(rows).collect()}
    assert got == {1: "no model", 2: "ok"}


def test_object_based_chain(spark):
    jump = {6, 7, 10, 11}
    out = workflows.object_based(_obs(spark, jump), Grid(4, 4), 728000, 41).collect()
    broken = {r["pos"] for r in out if r["t_break"]}
    assert jump <= broken and len(broken) < 16


def test_land_cover_chain(spark):
    found = kernels.detect(_obs(spark, ())).filter("status = 'ok'").drop("status")
    labels = spark.createDataFrame([(p, p % 2 + 1) for p in range(1, 17)], "pos long, cls int")
    out = workflows.classify_years(found, labels, [1994, 1996, 2030], 1995, trees=5, depth=4).collect()
    assert {r["cls"] for r in out if r["year"] == 2030} == {255}
    assert {r["cls"] for r in out if r["year"] == 1996} <= {1, 2}


def test_tiff_round_trip_and_variants():
    import struct
    import zlib

    from chronotile.sources import tiff

    r = np.random.default_rng(1)
    place = tiff.Place(500_010.0, 4_000_020.0, 30.0, 30.0, 32614)
    for dtype in ("u1", "i2", "u2", "i4", "f4"):
        a = (r.random((70, 33)) * 200).astype(dtype)
        got, where = tiff.read(tiff.write(a, place, strip=16))
        assert (got == a).all() and where == place
    assert tiff.read(tiff.write(np.zeros((1, 1), np.int16)))[1] is None
    # Tiles, big-endian, deflate with horizontal prediction.
    a = r.integers(0, 5000, (20, 24)).astype(">u2")
    tiles = [zlib.compress(np.diff(np.pad(a, ((0, 12), (0, 8)))[r0 : r0 + 16, c0 : c0 + 16].astype(">u2"), axis=1, prepend=0).astype(">u2").tobytes()) for r0 in (0, 16) for c0 in (0, 16)]
    entries = [(256, 4, [24]), (257, 4, [20]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2]), (322, 3, [16]), (323, 3, [16]), (324, 4, None), (325, 4, [len(t) for t in tiles]), (339, 3, [1])]
    body = b"".join(tiles)
    offsets = (8 + np.cumsum([0, *map(len, tiles)])[:-1]).tolist()
    at = 8 + len(body)
    table, more, start = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, code, values in entries:
        raw = struct.pack(f">{len(values or offsets)}{'H' if code == 3 else 'I'}", *(values or offsets))
        table += struct.pack(">HHI", tag, code, len(values or offsets)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", start + len(more)))
        more += raw if len(raw) > 4 else b""
    got, _ = tiff.read(struct.pack(">2sHI", b"MM", 42, at) + body + struct.pack(">H", len(entries)) + table + b"\0" * 4 + more)
    assert (got == a).all()

    def packed(data):  # LZW of clear codes and single bytes, so that no code is longer than nine bits
        codes = [256] + [c for k, b in enumerate(data) for c in ((256, b) if k % 200 == 199 else (b,))] + [257]
        bits = "".join(f"{c:09b}" for c in codes)
        return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")

    data = bytes(r.integers(0, 256, 1000).tolist())
    assert tiff.lzw(packed(data)) == data
    assert tiff.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def _scene_files(folder, name, suffixes, shape=(4, 5), word=0, fill=255, place=None):
    from chronotile.sources import tiff

    folder.mkdir(parents=True, exist_ok=True)
    for k, s in enumerate(suffixes):
        a = np.full(shape, 8000 + k, np.uint16)
        if s == suffixes[-1]:
            a[:] = word
            a[0, 0] = fill
        (folder / f"{name}{s}").write_bytes(tiff.write(a, place))


def test_scenes_of_three_archives(spark, tmp_path):
    import tarfile

    from chronotile.sources import ingest, tiff

    grid, place = Grid(4, 5), tiff.Place(300.0, 900.0, 30.0, 30.0, 32614)
    hls = tmp_path / "hls"
    for name, bands in (("HLS.L30.T14SKF.2000032T170000.v2.0", ("B02", "B03", "B04", "B05", "B06", "B07")), ("HLS.S30.T14SKF.2000032T171000.v2.0", ("B02", "B03", "B04", "B8A", "B11", "B12")), ("HLS.L30.T14SKF.2001001T170000.v2.0", ("B02",))):
        _scene_files(hls / name, name, [*(f".{b}.tif" for b in bands), ".Fmask.tif"], word=32 if "S30" in name else 0, place=place)
    rows = ingest.read_scenes(spark, str(hls), "hls", grid).collect()
    assert len(rows) == 2 * 19 and {(r["date"], r["seq"], r["qa"]) for r in rows} == {(730151, 1, 0), (730151, 2, 1)}  # the third lacks bands
    assert {(r["blue"], r["swir2"], r["thermal"]) for r in rows} == {(8000, 8005, 0)} and min(r["pos"] for r in rows) == 2
    assert ingest.read_scenes(spark, str(hls), "hls", grid, high=730150).collect() == []
    cropped = ingest.read_scenes(spark, str(hls), "hls", Grid(2, 2), bounds=(330.0, 810.0, 390.0, 870.0)).collect()
    assert sorted({r["pos"] for r in cropped}) == [1, 2, 3, 4]

    def tarred(folder, name, members, word, fill):
        inside = tmp_path / "inside" / name
        _scene_files(inside, "", members, word=word, fill=fill)
        folder.mkdir(exist_ok=True)
        with tarfile.open(folder / f"{name}.tar", "w") as tar:
            for f in sorted(inside.iterdir()):
                tar.add(f, f.name)

    c2 = tmp_path / "c2"
    scene = "LC08_L2SP_027033_20200203_20200823_02_T1"
    tarred(c2, scene, [*(f"{scene}_SR_B{k}.TIF" for k in range(2, 8)), f"{scene}_ST_B10.TIF", f"{scene}_QA_PIXEL.TIF"], word=1 << 6, fill=1)
    rows = ingest.read_scenes(spark, str(c2), "collection2", grid, clear_threshold=0.5).collect()
    assert len(rows) == 19 and {r["qa"] for r in rows} == {0} and {r["blue"] for r in rows} == {int(10000 * (8000 * 2.75e-5 - 0.2))}
    assert {r["thermal"] for r in rows} == {int(10 * (8006 * 0.00341802 + 149))} and {r["date"] for r in rows} == {737458}

    ard, scene = tmp_path / "ard", "LT05_CU_027009_19990203_20190101_C01_V01"
    tarred(ard, f"{scene}_SR", [*(f"{scene}_SRB{k}.tif" for k in (1, 2, 3, 4, 5, 7)), f"{scene}_PIXELQA.tif"], word=1 << 2, fill=1)
    tarred(ard, f"{scene}_BT", [f"{scene}_BTB6.tif"], word=2900, fill=2900)
    rows = ingest.read_scenes(spark, str(ard), "ard", grid).collect()
    assert len(rows) == 19 and {(r["qa"], r["blue"], r["swir2"], r["thermal"]) for r in rows} == {(1, 8000, 8005, 2900)}
    (ard / "LT05_CU_027009_19990303_20190101_C01_V01_SR.tar").write_bytes(b"no tar")
    assert len(ingest.read_scenes(spark, str(ard), "ard", grid).collect()) == 19


def test_shapes():
    import struct

    from chronotile.sources import ingest

    points = [(10.0, 20.0), (100.0, 20.0), (100.0, 95.0), (10.0, 20.0)]
    body = struct.pack("<I4dII I", 5, 10, 20, 100, 95, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in points)
    shp = b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body
    assert ingest.shapes(shp) == [points] and ingest.extent(points) == (0.0, 0.0, 120.0, 120.0)


def test_command_line(spark, tmp_path):
    """From scenes to maps: stack, tile (twice: the second run has nothing left to do) and export."""
    from chronotile import __main__ as cli
    from chronotile.sources import tiff

    name, shape = "HLS.L30.T14SKF.{}T170000.v2.0", ["--rows", "4", "--cols", "5", "--blocks-y", "2"]
    for k in range(3):
        day = f"{2000 + k}032"
        _scene_files(tmp_path / "in" / name.format(day), name.format(day), [".B02.tif", ".B03.tif", ".B04.tif", ".B05.tif", ".B06.tif", ".B07.tif", ".Fmask.tif"])
    cli.main(["stack", *shape, "--source", str(tmp_path / "in"), "--kind", "hls", "--out", str(tmp_path / "obs")], spark)
    assert files.read_obs(spark, str(tmp_path / "obs")).count() == 3 * 19 and files.read_obs(spark, str(tmp_path / "obs"), [2], low=730517).count() == 2 * 10
    for _ in range(2):
        cli.main(["tile", *shape, "--obs", str(tmp_path / "obs"), "--cm-interval", "365", "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/cold")).count() == 19 and spark.read.parquet(str(tmp_path / "out/cm")).count() == 19 * 3
    assert spark.read.json(str(tmp_path / "out/report")).first()["blocks"] == "0"
    cli.main(["tile", *shape, "--obs", str(tmp_path / "obs"), "--method", "sccd", "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out/sccd")).count() == 19
    flat = [[0.0] * 8] * 7
    segs = spark.createDataFrame([(7, 0, 730000, 730400, 730416, 30, 8, 100, flat, [1.0] * 7, [0.0, 0.0, 500.0, -900.0, 500.0, 0.0, 0.0])], "pos long, seg int, t_start int, t_end int, t_break int, num_obs int, category smallint, change_prob smallint, coefs array<array<float>>, rmse array<float>, magnitude array<float>")
    files.write_segments(segs, Grid(4, 5, 1, 2), str(tmp_path / "segments"))
    cli.main(["export", *shape, "--segments", str(tmp_path / "segments"), "--out", str(tmp_path / "maps"), "--place", "300", "900", "30", "30", "32614"], spark)
    image, place = tiff.read((tmp_path / "maps/images/break_map_2000.tif").read_bytes())
    assert image.shape == (4, 5) and image[1, 1] == 1297 and image.sum() == 1297 and place.epsg == 32614
    assert tiff.read((tmp_path / "maps/images/first_year_0.tif").read_bytes())[0][1, 1] == 2000


def test_changes_and_rasters(spark, tmp_path):
    grid = Grid(2, 4, 2, 1)
    files.write_changes(spark.createDataFrame([(1, 730100), (1, 730000), (2, -5)], "pos long, break_date int"), grid, str(tmp_path / "changes"))
    assert {r["pos"]: r["break_dates"] for r in files.read_changes(spark, str(tmp_path / "changes")).collect()} == {1: [730000, 730100]}
    np.save(tmp_path / "classes.npy", np.arange(8).reshape(2, 4))
    assert {(r["pos"], r["cls"]) for r in files.read_raster(spark, str(tmp_path / "classes.npy"), 4).collect()} == {(k + 1, k) for k in range(8)}


def test_nested_config_and_header():
    c = files.load_config("grid:\n  n_rows: 5 # five\n  n_cols: 6\nyears:\n  - 1999\n  - 2000\nflat:\n- a\nlast: true\n")
    assert c == {"grid": {"n_rows": 5, "n_cols": 6}, "years": [1999, 2000], "flat": ["a"], "last": True}
    assert files.envi_header("ENVI\nsamples = 3\nlines   = 2\nmap info = {UTM, 1}\n") == {"samples": 3, "lines": 2, "map info": "{UTM, 1}"}
