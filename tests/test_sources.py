"""File layouts with their edge rows, listings, vocabularies and region files."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaspark.operators import pixels
from qaspark.sinks import writers
from qaspark.sources import annotations, files, regions, registry


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "qa.csv", ',question,answer,img_id\n0,"a, ""b""\nc",đỏ,12\n1,q2,xanh,1234567890123\n2,q3,,000045\n')
    rows = annotations.read_qa_csv(spark, path, "img").orderBy("row_idx").collect()
    assert [r.question for r in rows] == ['a, "b"\nc', "q2", "q3"]
    assert [r.img_path for r in rows] == ["img/000000000012.jpg", "img/1234567890123.jpg", "img/000000000045.jpg"]
    with pytest.raises(ValueError, match="img_id"):
        annotations.read_qa_csv(spark, write(tmp_path / "bad.csv", "question,answer\na,b\n"))


def test_map_layout(spark, tmp_path):
    doc = {
        "images": {"1": "one.jpg", "2": "two.jpg"},
        "annotations": {"10": {"image_id": 2, "question": "q10", "answer": "a"}, "11": {"image_id": 1, "question": "q11", "answer": "b"}},
    }
    path = write(tmp_path / "map.json", doc)
    rows = annotations.read_qa_json_map(spark, path, "d").orderBy("row_idx").collect()
    assert [(r.row_idx, r.question_id, r.img_path) for r in rows] == [(0, "10", "d/two.jpg"), (1, "11", "d/one.jpg")]
    doc["annotations"]["12"] = {"image_id": 9, "question": "q", "answer": "c"}
    broken = write(tmp_path / "broken.json", doc)
    with pytest.raises(Exception, match="no image with id 9"):
        annotations.read_qa_json_map(spark, broken).collect()
    assert annotations.read_qa_json_map(spark, broken, on_missing="drop").count() == 2


def test_list_layout(spark, tmp_path):
    path = write(tmp_path / "list.json", [
        {"question": "Đây là phòng nào?", "image_id": "524822", "image_name": "COCO_val2014_000000524822.jpg",
         "explanation": ["một", "hai"], "answer": "phòng khách", "question_id": "524822007"},
        {"question": "q", "image_id": "1", "image_name": "x.jpg", "explanation": [], "answer": "a", "question_id": "2"},
    ])
    rows = annotations.read_qa_json_list(spark, path, "coco").withColumn(
        "text", annotations.explanation_text(F.col("explanations"))).orderBy("row_idx").collect()
    assert [(r.row_idx, r.img_path, r.text) for r in rows] == [(0, "coco/COCO_val2014_000000524822.jpg", "một | hai"), (1, "coco/x.jpg", "")]


@pytest.mark.parametrize("empty_at", [0, 1, 2])
def test_tables_layout_keeps_rows_aligned(spark, tmp_path, empty_at):
    notes = [{"id": i, "image_id": i, "question": f"q{i}", "answers": [f"a{i}", "other"]} for i in range(3)]
    notes[empty_at]["answers"] = []
    doc = {"images": [{"id": 0, "filename": "old.jpg"}, {"id": 0, "filename": "new.jpg"}, {"id": 1, "filename": "1.png"}], "annotations": notes}
    rows = annotations.read_qa_json_tables(spark, write(tmp_path / "t.json", doc), "d").collect()
    expected = {0: "d/new.jpg", 1: "d/1.png", 2: "d/2.jpg"}
    assert {(r.question, r.answer, r.img_path) for r in rows} == {
        (f"q{i}", f"a{i}", expected[i]) for i in range(3) if i != empty_at}


def test_single_answer_tables(spark, tmp_path):
    doc = {"images": [{"id": 5, "filename": "f.jpg"}], "annotations": [{"id": 1, "image_id": 5, "question": "q", "answer": ""}]}
    row = annotations.read_qa_json_tables_single(spark, write(tmp_path / "s.json", doc), "").first()
    assert (row.answer, row.img_path, row.question_id) == ("", "f.jpg", "1")


def test_registry(spark, tmp_path):
    root = tmp_path / "root"
    doc = lambda q, a: {"images": [{"id": 1, "filename": "f.jpg"}], "annotations": [{"id": 1, "image_id": 1, "question": q, "answer": a}]}
    write(root / "data/evjvqa/evjvqa_train.json", doc("q1", "b"))
    write(root / "data/evjvqa/evjvqa_val.json", doc("q2", "a"))
    rows = registry.read_dataset(spark, "evjvqa", str(root)).collect()  # no test split: left out
    assert {(r.split, r.question) for r in rows} == {("train", "q1"), ("val", "q2")}
    encoder = registry.fit_dataset_encoder(spark, "evjvqa", str(root)).collect()
    assert {r.answer: r.label for r in encoder} == {"a": 0, "b": 1}
    write(root / "data/openvivqa/vlsp2023_train_data.json", {
        "images": {"1": "x.jpg"}, "annotations": {"1": {"image_id": 1, "question": "where is the red cup", "answer": "the red cup is here"}}})
    cleaned = registry.read_split(spark, "openvivqa", "train", str(root)).first()
    assert cleaned.answer == "is here"
    with pytest.raises(Exception):  # both splits are needed
        registry.read_dataset(spark, "openvivqa", str(root)).collect()
    with pytest.raises(ValueError, match="vivqax"):
        registry.dataset("nope")
    assert len(registry.DATASETS) == 8
    with pytest.raises(FileNotFoundError):
        registry.read_dataset(spark, "viocrvqa", str(root))


def test_default_layout_by_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        annotations.read_qa(spark, "x.txt")
    assert annotations.read_qa(spark, write(tmp_path / "a.csv", "question,answer,img_id\nq,a,1\n")).count() == 1


def b64(values, dtype):
    return base64.b64encode(np.asarray(values, dtype=dtype).tobytes()).decode()


def test_regions_file(spark, tmp_path):
    lines = []
    for n in (3, 0, 2):
        boxes, feats = np.arange(n * 4).reshape(n, 4) / 2, np.arange(n * 5).reshape(n, 5) * 1.5
        cells = [f"img{n}", "120", "160", b64(range(n), "<i8"), b64([0.5] * n, "<f4"), b64(range(n), "<i8"), b64([0.25] * n, "<f4"),
                 str(n), b64(boxes, "<f4"), b64(feats, "<f4")]
        lines.append("\t".join(cells))
    path = write(tmp_path / "r.tsv", "\n".join(lines) + "\n")
    rows = {r.img_id: r for r in regions.read_regions_tsv(spark, path).collect()}
    assert rows["img3"].objects_id == [0, 1, 2] and rows["img3"].boxes[2] == [4.0, 4.5, 5.0, 5.5]
    assert len(rows["img2"].features) == 2 and rows["img2"].features[1] == [7.5, 9.0, 10.5, 12.0, 13.5]
    assert rows["img0"].boxes == [] and rows["img0"].objects_conf == []
    assert regions.read_regions_tsv(spark, path, topk=2).count() == 2
    assert regions.read_regions_tsv(spark, path, topk=-1).count() == 3
    out = str(tmp_path / "out")
    regions.write_regions_tsv(regions.read_regions_tsv(spark, path), out)
    again = {r.img_id: r for r in regions.read_regions_tsv(spark, out).collect()}
    assert again == rows


def test_regions_decode_what_is_asked_for(spark, tmp_path):
    cells = ["img", "120", "160", b64([1, 2], "<i8"), "not base64!", "", "", "2", b64(range(8), "<f4"), "not base64!"]
    read = regions.read_regions_tsv(spark, write(tmp_path / "r.tsv", "\t".join(cells) + "\n"))
    plan = read.select("img_id", "num_boxes")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "unbase64" not in plan and "features" not in plan.split("ReadSchema")[1]
    row = read.select("num_boxes", "objects_id", "boxes").first()  # broken fields beside them are not touched
    assert (row.num_boxes, row.objects_id, row.boxes) == (2, [1, 2], [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]])


def test_vocabulary_keeps_its_last_line(spark, tmp_path):
    for ending in ("", "\n"):
        path = write(tmp_path / f"v{len(ending)}.txt", "on,on top of\nhas, has a\nbuoy" + ending)
        rows = files.read_vocab(spark, path).orderBy("id").collect()
        assert [(r.id, r.name, r.synonyms) for r in rows] == [
            (0, "on,on top of", ["on", "on top of"]), (1, "has, has a", ["has", "has a"]), (2, "buoy", ["buoy"])]


def png(path, height, width, gray=None):
    rng = np.random.default_rng(1)
    pixels_ = rng.integers(0, 256, (height, width, 3), dtype=np.uint8) if gray is None else np.full((height, width, 3), gray, np.uint8)
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels_)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return pixels_


def test_listings(spark, tmp_path):
    for name in ("train/a.b.jpg", "train/c.png", "val/d.jpg", "deep/x/vivqa_obj36.tsv", "deep/other_obj36.tsv", "deep/y.tsv"):
        write(tmp_path / name, "x")
    listed = files.list_images(spark, str(tmp_path), "train").collect()
    assert {r.image_id for r in listed} == {"a", "c"}
    assert files.list_objects(spark, str(tmp_path / "deep")).count() == 3
    found = files.find_region_files(spark, str(tmp_path)).collect()
    assert [(r.file, r.image_dir) for r in found] == [("vivqa_obj36.tsv", f"{tmp_path}/data/vivqa/images")]
    plan = files.list_images(spark, str(tmp_path), "train")._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_patches_on_pixels(spark, tmp_path):
    original = png(tmp_path / "img" / "one.png", 40, 70)
    rasters = pixels.read_rasters(spark, str(tmp_path / "img"))
    for difficulty, action in ((0.1, "none"), (0.5, "blur"), (0.9, "mask")):
        row = pixels.apply_patches(rasters, F.lit(difficulty), size=16, ratio=0.5).first()
        got = np.frombuffer(row.data, np.uint8).reshape(40, 70, 3)[:, :, ::-1]
        assert row.action == action
        changed = (got != original).any(axis=2)
        assert not changed[32:].any() and not changed[:, 64:].any()  # edge remainder
        grid = changed[:32, :64].reshape(2, 16, 4, 16).any(axis=(1, 3))
        assert grid.sum() == (0 if action == "none" else 4)
        if action == "mask":
            assert (got[changed] == 128).all()
        if action == "blur":
            y, x = np.argwhere(grid)[0] * 16
            before, after = original[y:y + 16, x:x + 16].astype(float), got[y:y + 16, x:x + 16].astype(float)
            assert after.std() < before.std() / 2 and abs(after.mean() - before.mean()) < 12
    off = pixels.apply_patches(rasters, F.lit(0.9), apply_masking=False).first()
    assert off.action == "none"


def test_flat_image_does_not_change_under_blur(spark, tmp_path):
    png(tmp_path / "flat" / "f.png", 32, 32, gray=90)
    row = pixels.apply_patches(pixels.read_rasters(spark, str(tmp_path / "flat")), F.lit(0.5), ratio=1.0).first()
    assert set(row.data) == {90}


def test_split_writer_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([("q1", 1, "how?", "so", "train"), ("q2", 2, "why?", "as", "val")], "question_id string, image_id bigint, question string, answer string, split string")
    images = spark.createDataFrame([(1, "one.png", "train"), (2, "two.png", "val")], "image_id bigint, filename string, split string")
    with pytest.raises(ValueError):
        writers.write_splits(notes, images, str(tmp_path / "d"), source=str(tmp_path / "d"))
    writers.write_splits(notes, images, str(tmp_path / "d"), source=str(tmp_path / "in.json"))
    with pytest.raises(Exception):  # nothing is overwritten
        writers.write_splits(notes, images, str(tmp_path / "d"))
    back = annotations.read_qa_json_tables_single(spark, str(tmp_path / "d" / "split=train"), "img", multi_line=False).first()
    assert (back.question_id, back.img_path, back.answer) == ("q1", "img/one.png", "so")
    assert writers.run_folder("runs/", "vivqa", "exp1", 71) == "runs/vivqa-exp1-71"


def test_first_region_lines_in_file_order(spark, tmp_path):
    from qaspark.sources import regions

    line = "\t".join(["{}", "1", "1", "", "", "", "", "0", "", ""])
    for name in ("b", "a"):
        (tmp_path / f"{name}.tsv").write_text("".join(line.format(f"{name}{k}") + "\n" for k in range(50)))
    read = regions.read_regions_tsv(spark, str(tmp_path / "*.tsv"), topk=60)
    assert sorted(r.img_id for r in read.collect()) == sorted([f"a{k}" for k in range(50)] + [f"b{k}" for k in range(10)])


def test_csv_rejects_broken_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text("question,answer,img_id\na,b,1,2,3\n")
    with pytest.raises(Exception):
        annotations.read_qa_csv(spark, str(tmp_path / "x.csv")).collect()


def test_documents_of_another_layout_fail(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"data": []}))
    for read in (annotations.read_qa_json_tables, annotations.read_qa_json_tables_single, annotations.read_qa_json_map):
        with pytest.raises(Exception, match="neither images nor annotations"):
            read(spark, str(tmp_path / "x.json")).collect()
