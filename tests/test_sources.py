import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import dicom, nifti

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("shape,spacing", [((6, 8, 10), [2.0, 0.5, 0.5]), ((8, 12), [0.7, 0.7])])
def test_nifti_round_trip(spark, tmp_path, shape, spacing):
    image = RNG.random(shape).astype(np.float32)
    df = spark.createDataFrame([(7, list(shape), image.ravel().tolist(), spacing, None)], "volume_id long, shape array<int>, image array<float>, spacing array<double>, metadata map<string,string>")
    assert nifti.save_nifti(df, f"file://{tmp_path}").first().name == "7.nii.gz"
    row = nifti.load_nifti(spark, str(tmp_path)).first()
    assert row.shape == list(shape) and np.array_equal(np.array(row.image, np.float32), image.ravel()) and np.allclose(row.spacing, spacing) and len(row.affine) == 16
    assert np.allclose(row.affine, np.diag([*spacing[::-1], 1.0][:3] + [1.0] if len(shape) == 3 else [0.7, 0.7, 1.0, 1.0]).ravel())


def test_nifti_kinds():
    assert nifti.decode(nifti.encode(np.ones((2, 3)), [1, 1], compress=False))[0].shape == (2, 3)
    data = bytearray(nifti.encode(np.arange(6.0).reshape(1, 2, 3), [1, 1, 1], compress=False))
    struct.pack_into("<2f", data, 112, 2.0, 1.0)
    assert nifti.decode(bytes(data))[0].ravel().tolist() == [1, 3, 5, 7, 9, 11]
    with pytest.raises(ValueError):
        nifti.decode(b"nothing")


def element(group, number, kind, value):
    if isinstance(value, str):
        value = value.encode() + b" " * (len(value) % 2)
    head = struct.pack("<HH2s", group, number, kind)
    return head + (struct.pack("<HI", 0, len(value)) if kind in dicom.LONG else struct.pack("<H", len(value))) + value


def file_of(k, series="1.2.3", pixels=True, rows=16, slope="1", syntax="1.2.840.10008.1.2.1"):
    data = np.full((rows, 16), 1024 + 100 * k, np.uint16)
    body = [
        (0x0008, 0x0060, b"CS", "CT"), (0x0008, 0x0070, b"LO", "TestVendor"), (0x0010, 0x0020, b"LO", "P1"), (0x0018, 0x0050, b"DS", "3"), (0x0020, 0x000E, b"UI", series), (0x0020, 0x0013, b"IS", str(9 - k)), (0x0020, 0x0032, b"DS", f"0\\0\\{1.5 * k}"),
        (0x0020, 0x0037, b"DS", "1\\0\\0\\0\\1\\0"), (0x0028, 0x0010, b"US", struct.pack("<H", rows)), (0x0028, 0x0011, b"US", struct.pack("<H", 16)), (0x0028, 0x0030, b"DS", "0.5\\0.5"), (0x0028, 0x0100, b"US", struct.pack("<H", 16)), (0x0028, 0x0103, b"US", struct.pack("<H", 0)),
        (0x0028, 0x1050, b"DS", "40\\80"), (0x0028, 0x1051, b"DS", "400"), (0x0028, 0x1052, b"DS", "-1024"), (0x0028, 0x1053, b"DS", slope),
    ]
    if pixels:
        body.append((0x7FE0, 0x0010, b"OW", data.tobytes()))
    return b"\0" * 128 + b"DICM" + element(2, 0x0010, b"UI", syntax) + b"".join(element(*e) for e in body)


def test_dicom_series(spark, tmp_path):
    folder = tmp_path / "a" / "b"
    folder.mkdir(parents=True)
    for k in (3, 0, 4, 1, 2):
        (folder / (f"s{k}.dcm" if k else "IM0")).write_bytes(file_of(k))
    (folder / "no.dcm").write_bytes(b"nothing")
    (folder / "empty.dcm").write_bytes(file_of(0, pixels=False))
    (folder / "notes.txt").write_bytes(file_of(0, "9.9"))
    row = dicom.load_dicom_series(spark, str(tmp_path)).first()
    assert row.shape == [5, 16, 16] and row.spacing == [1.5, 0.5, 0.5] and row.image[:: 16 * 16] == [0.0, 100.0, 200.0, 300.0, 400.0]
    assert row.modality == "CT" and row.metadata["vendor"] == "TestVendor" and row.metadata["num_slices"] == "5" and (row.window_center, row.window_width) == (40.0, 400.0)
    (folder / "other.dcm").write_bytes(file_of(0, "7.7"))
    with pytest.raises(ValueError):
        dicom.load_dicom_series(spark, str(tmp_path))
    both = dicom.stacked(dicom.load_slices(spark, str(tmp_path))).orderBy(F.size("shape")).collect()
    assert [r.shape for r in both] == [[16, 16], [5, 16, 16]] and both[0].spacing == [0.5, 0.5]


def test_dicom_errors(spark, tmp_path):
    (tmp_path / "x.dcm").write_bytes(b"nothing")
    with pytest.raises(FileNotFoundError):
        dicom.load_dicom_series(spark, str(tmp_path))
    with pytest.raises(ValueError, match="not supported"):
        dicom.decode("x", file_of(0, syntax="1.2.840.10008.1.2.4.50"))
    assert dicom.unreadable(spark, str(tmp_path)).first().fault.startswith(("no pixel data", "not a DICOM"))


def test_files_on_a_file_system(spark, tmp_path):
    from lumenframe.sources import files

    df = spark.createDataFrame([(f"f{k}.bin", bytes([k]) * k) for k in range(30)], "name string, content binary").repartition(3)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        got = sorted((r.name, r.bytes) for r in files.write_files(df, folder).collect())
        assert got == sorted((f"f{k}.bin", k) for k in range(30))
    assert all((tmp_path / d / f"f{k}.bin").read_bytes() == bytes([k]) * k for d in "ab" for k in range(30))
    assert files.shared_dir(spark).startswith("file://")


def test_series_without_an_id_and_faulty_ones(spark, tmp_path):
    for k in range(6):
        folder = tmp_path / f"d{k % 2}"
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.dcm").write_bytes(file_of(k, series=""))
    (tmp_path / "x1.dcm").write_bytes(file_of(1, "5.5"))
    (tmp_path / "x2.dcm").write_bytes(file_of(2, "5.5", rows=8))
    slices = dicom.load_slices(spark, str(tmp_path))
    assert sorted(r.image[:: 16 * 16] for r in dicom.stacked(slices).collect()) == [[0.0, 200.0, 400.0], [100.0, 300.0, 500.0]]
    assert [(r.key, r.fault) for r in dicom.faulty_series(slices).collect()] == [("5.5", "slices of a series differ in size")]
    with pytest.raises(ValueError):
        dicom.load_dicom_series(spark, str(tmp_path / "x*.dcm"))


def test_many_files_are_few_tasks_and_nothing_on_the_driver(spark, tmp_path):
    for k in range(400):
        folder = tmp_path / f"d{k % 7}" / "in it" if k % 2 else tmp_path
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.dcm").write_bytes(file_of(k % 5, f"1.{k}") if k % 10 else b"nothing")
    for odd in ("_hidden/a.dcm", ".hidden/a.dcm", "_a.dcm", ".a.dcm", "_k=1/a b%20é.DCM", "d1/x._COPYING_", "empty.dcm", "notes.txt"):
        (tmp_path / odd).parent.mkdir(exist_ok=True)
        (tmp_path / odd).write_bytes(b"" if odd == "empty.dcm" else file_of(3, odd))
    (tmp_path / "gone.dcm").symlink_to(tmp_path / "nowhere")
    (tmp_path / "link.dcm").symlink_to(tmp_path / "_a.dcm")
    whole, other = (dicom.load_slices(spark, p) for p in (f"file://{tmp_path}", f"{tmp_path}*"))  # a pattern goes through Spark's reader
    assert whole.inputFiles() == [] and whole.rdd.getNumPartitions() == other.rdd.getNumPartitions() == 4
    assert sorted(whole.collect(), key=lambda r: r.path) == sorted(other.collect(), key=lambda r: r.path)
    bad = [sorted(map(tuple, dicom.unreadable(spark, p).collect())) for p in (str(tmp_path), f"{tmp_path}*")]
    assert bad[0] == bad[1] and len(bad[0]) == 40
    assert whole.count() == 362
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        dicom.load_slices(spark, str(tmp_path / "missing"))
