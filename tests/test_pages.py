"""Journal pages: images, transcription, the note that comes of them, and the command line."""

import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import __main__ as cli
from vellum.functions import image
from vellum.operators import ingest


def png(pixels, filters):
    """A PNG file with one filter for each row, written the plain way."""
    height, width, n = pixels.shape
    raw, zero = bytearray(), np.zeros(n, int)
    for y in range(height):
        raw.append(filters[y])
        for x in range(width):
            a = pixels[y, x - 1].astype(int) if x else zero
            b = pixels[y - 1, x].astype(int) if y else zero
            c = pixels[y - 1, x - 1].astype(int) if x and y else zero
            for k in range(n):
                p = a[k] + b[k] - c[k]
                near = min((abs(p - v), i, v) for i, v in enumerate((a[k], b[k], c[k])))[2]
                raw.append((int(pixels[y, x, k]) - (0, a[k], b[k], (a[k] + b[k]) // 2, near)[filters[y]]) % 256)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return image.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_files(channels):
    rng = np.random.default_rng(channels)
    pixels = rng.integers(0, 256, (9, 7, channels), dtype=np.uint8)
    assert (image.read_png(png(pixels, [random.Random(y).randrange(5) for y in range(9)])) == pixels).all()
    assert (image.read_png(image.write_png(pixels[..., 0]))[..., 0] == pixels[..., 0]).all()
    for bad in (b"", b"x" * 50, png(pixels, [0] * 9)[:20]):
        with pytest.raises((ValueError, struct.error, IndexError)):
            image.read_png(bad)


def ruled(height=300, width=400):
    page = np.full((height, width), 230, np.uint8)
    page[30:270:24, 20:380] = 20
    page[31:270:24, 20:380] = 20
    return page


def test_tilted_pages_are_straightened():
    page = ruled()
    assert image.tilt(page) == 0.0
    for angle in (-7, 5, 12):
        tilted = image.rotated(page, -angle)
        found = image.tilt(tilted)
        assert abs(abs(found) - abs(angle)) <= 1
        assert abs(image.tilt(image.rotated(tilted, found))) <= 1
    assert image.tilt(np.full((60, 60), 9, np.uint8)) == 0.0


def test_contrast_and_size():
    dull = np.tile(np.linspace(100, 140, 256).astype(np.uint8), (256, 1))
    assert image.evened(dull).std() > dull.std()
    assert image.resized(dull, 0.5).shape == (128, 128) and (image.resized(dull, 1.0) == dull).all()
    assert image.prepared(np.zeros((40, 3000, 3), np.uint8)).shape == (27, 2048)
    assert image.gray(np.full((2, 2, 3), 77, np.uint8)).tolist() == [[77, 77], [77, 77]]


def test_an_entry_of_two_pages(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    paths = []
    for i in range(2):
        path = tmp_path / f"scan {i}.png"
        path.write_bytes(image.write_png(ruled()))
        paths.append(str(path))
    seen = tmp_path / "seen"

    def vision(images, instruction):
        seen.write_text(f"{len(images)} {'Transcribe' in instruction}")
        return "```json\n" + json.dumps({"text": "one\n\ntwo three", "summary": "s", "written_date": "04/03/26", "title": "Morning"}) + "\n```"

    made = ingest.entry(spark, paths, str(vault), vision=vision, now=F.to_timestamp(F.lit("2024-01-02 03:04:05"))).first()
    assert (made.page_id, made.n_words) == ("04-03-26 - Morning", 3) and seen.read_text() == "2 True"
    text = (vault / "processed" / "04-03-26 - Morning.md").read_text()
    assert text.startswith('---\nid: 04-03-26 - Morning\ntitle: "Morning"\ndate: 2024-01-02T03:04:05') and "> one\n>\n> two three\n" in text and '"[[04-03-26 - Morning - p2.png]]"' in text
    assert sorted(os.listdir(vault / "attachments")) == ["04-03-26 - Morning - p1.png", "04-03-26 - Morning - p2.png"]
    (tmp_path / "no.png").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="PNG"):
        ingest.entry(spark, [str(tmp_path / "no.png")], str(vault))


def test_answers_that_are_no_json(spark):
    df = spark.createDataFrame([("p", "just words", ["a.png"])], "page string, answer string, files array<string>")
    row = ingest.pages(df).first()
    assert row.page_id == "Untitled Entry" and row.n_words == 2 and row.images == ["Untitled Entry.png"] and "> just words" in row.text


def test_the_command_line(spark, tmp_path, capsys):
    vault = tmp_path / "vault"
    vault.mkdir()
    (vault / "a.md").write_text("# River\n\n" + "river walks in autumn " * 30)
    base = ["--vault", str(vault), "--store", str(tmp_path / "store")]
    assert cli.main([*base, "embed"], spark) == 0 and "1 chunks" in capsys.readouterr().out
    assert cli.main([*base, "query", "river", "walks", "in", "autumn"], spark) == 0 and "a.md" in capsys.readouterr().out
    assert cli.main([*base, "query", "nothing alike zebra"], spark) == 0 and "nothing found" in capsys.readouterr().out
    assert cli.main(["--vault", str(tmp_path / "none"), "embed"], spark) == 2
    assert cli.main([*base, "page", str(tmp_path / "none.png")], spark) == 2
    assert cli.main([*base, "watch", "--rounds", "1"], spark) == 0
    assert cli.parser().parse_args([]).command is None
