"""Image archives as files, against the same ones in memory."""

import gzip
import io
import json
import os
import tarfile

from palisade.sources import images


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.SYMTYPE
                info.linkname = "../../etc/passwd"
                t.addfile(info)
            elif name.endswith("/"):
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_files_give_what_contents_give(spark, tmp_path):
    one = tar([("etc/", b""), ("./etc/os-release", b"ID=alpine\n"), ("lib/apk/db/installed", b"P:a\nV:1\n" * 5000), ("app/go.sum", b"x" * 50), ("app/link", None), ("big/go.sum", os.urandom(3000))] + [(f"f/{i}", b"y") for i in range(60)])
    two = tar([("app/.wh.go.sum", b"")])
    image = lambda *layers: tar([*((f"{i}/layer.tar", x) for i, x in enumerate(layers)), ("manifest.json", json.dumps([{"Layers": [f"{i}/layer.tar" for i in range(len(layers))]}]).encode())])
    made = {"plain": image(one, two), "inner": image(gzip.compress(one), two), "outer": gzip.compress(image(one, two)), "both": gzip.compress(image(gzip.compress(one), gzip.compress(two))), "none": image(), "broken": b"no tar", "empty": b"", "half": image(one, two)[:9000]}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    archives = spark.createDataFrame([(n, f"file://{tmp_path}/{n}") for n in made] + [("plain2", f"{tmp_path}/plain"), ("missing", f"{tmp_path}/no"), ("null", None)], "image string, path string").repartition(3)
    args = (images.APK + images.RELEASE, ("go.sum",), 1000)
    got = {}
    for r in images.file_entries(archives, *args).collect():
        got.setdefault(r.image, []).append(tuple(r)[1:])
    want = {}
    for r in images.entries(spark.createDataFrame([(n, bytearray(x)) for n, x in made.items()], "image string, content binary"), *args).collect():
        want.setdefault(r.image, []).append(tuple(r)[1:])
    assert set(got) == {"plain", "inner", "outer", "both", "plain2"} and set(want) == set(got) - {"plain2"}
    for n in want:
        assert sorted(got[n], key=str) == sorted(want[n], key=str)
    assert sorted(got["plain2"], key=str) == sorted(got["plain"], key=str) and len(got["plain"]) == 67
    images.BATCH_ROWS, old = 7, images.BATCH_ROWS
    try:
        assert images.file_entries(archives, *args).count() == sum(map(len, got.values()))
    finally:
        images.BATCH_ROWS = old
