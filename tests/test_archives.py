"""The archive source against the operator that opens whole archives."""

import io
import random
import tarfile
import zipfile

import pytest
import zstandard

from siltstone.sources import archives, files


def pack_zip(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


def pack_tar(entries, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in entries:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    draw = random.Random(4)
    where = tmp_path_factory.mktemp("archives")
    body = lambda n: bytes(draw.choices(range(32, 127), k=n))
    many = [(f"d/{i:03d}.txt", body(draw.randint(0, 3000))) for i in range(150)]
    inner = pack_zip([("x.txt", b"inner x"), ("deep.zip", pack_zip([("y.txt", b"deep y")]))])
    (where / "sub").mkdir()
    put = lambda name, data: (where / name).write_bytes(data)
    put("many.zip", pack_zip([*many, ("in.zip", inner), ("../out.txt", b"leaves"), ("bomb.txt", b"0" * 2_000_000), ("dir/", b""), ("Thumbs.db", b"junk"), ("é.txt", "ä".encode("cp1252"))]))
    put("sub/plain.tar", pack_tar([*many[:60], ("n" * 150 + ".txt", b"long name"), ("/abs.txt", b"absolute")]))
    put("packed.tar.gz", pack_tar(many[:20], "w:gz"))
    put("packed.tar.zst", zstandard.compress(pack_tar(many[:20])))
    put("note.md", b"# plain")
    put("sub/.hidden", b"hidden")
    put("broken.zip", pack_zip(many[:5])[:-30])
    put("broken.tar.gz", b"not a tar")
    return where


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("task_bytes", [10_000, 1 << 24])
def test_rows_equal_members(spark, folder, task_bytes):
    out = archives.read(spark, str(folder), task_bytes)
    assert rows(out) == rows(files.members(files.scan(spark, str(folder))))
    assert out.rdd.getNumPartitions() > (15 if task_bytes == 10_000 else 0)


def test_empty_files_and_empty_folders(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    assert [tuple(r)[1:5] for r in archives.read(spark, f"file://{tmp_path}").collect()] == [("empty.txt", 0, b"", "")]
    (tmp_path / "none").mkdir()
    assert archives.read(spark, str(tmp_path / "none")).count() == 0


def test_filters_decide_what_is_opened(spark, folder):
    whole = rows(files.members(files.scan(spark, str(folder))))
    found = archives.read(spark, str(folder)).where("member = 'd/007.txt'")
    assert rows(found) == [r for r in whole if r[1] == "d/007.txt"]
    start = archives.read(spark, str(folder), 10_000).where("member like 'd/01%' and path like '%many.zip'")
    assert rows(start) == [r for r in whole if r[1] and r[1].startswith("d/01") and r[0].endswith("many.zip")]
    nested = archives.one(spark, f"archive://{folder}/many.zip#in.zip!x.txt")
    assert [(r.member, r.text) for r in nested.collect()] == [("in.zip!x.txt", "inner x")] and nested.rdd.getNumPartitions() == 1
    assert archives.one(spark, f"archive://{folder}/many.zip#nothing").count() == 0


def test_one_member_reads_its_own_bytes(tmp_path, monkeypatch):
    draw = random.Random(1)
    entries = [(f"{i:04d}.bin", draw.randbytes(20_000)) for i in range(500)]
    (tmp_path / "big.zip").write_bytes(pack_zip(entries, zipfile.ZIP_STORED))
    taken = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            out = super().read(n)
            taken.append(len(out))
            return out

        def readinto(self, b):
            n = super().readinto(b)
            taken.append(n)
            return n

    monkeypatch.setattr(archives, "opened", lambda system, path: Counted(path))
    reader = archives.ArchiveReader({"path": str(tmp_path), "taskbytes": str(1 << 20)})
    assert 9 <= len(reader.partitions()) <= 11
    list(reader.pushFilters([archives.EqualTo(("member",), "0321.bin")]))
    (piece,) = reader.partitions()
    taken.clear()
    (batch,) = reader.read(piece)
    assert batch.column(3)[0].as_py() == entries[321][1]
    assert sum(taken) < 20_000 + 150 * 500  # the member and the directory, of ten megabytes
