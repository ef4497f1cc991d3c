"""Readers of files that have no counterpart in the driver tables."""

import json

from lexiloom.sources import readers as R


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_source_inventory(spark, tmp_path):
    for name in ("b/Card 10.PNG", "b/card 2.jpg", "b/notes.txt", ".hidden/x.png", "b/.x.png"):
        put(tmp_path / "in" / name, name)
    rows = R.source_inventory(spark, str(tmp_path / "in")).orderBy("sort_key").collect()
    assert [r.path for r in rows] == ["b/card 2.jpg", "b/Card 10.PNG"]
    assert all(len(r.sha256) == 64 for r in rows)


def test_scan_projects_keeps_going(spark, tmp_path):
    good = {
        "schema_version": 3, "project_id": "alpha", "name": "Alpha", "profile": "p", "source_language": "en", "target_language": "ko",
        "source_file": None, "created_at": "2026-07-26T10:00:00Z",
    }
    put(tmp_path / "alpha" / "project.json", good)
    put(tmp_path / "beta" / "project.json", "{broken")
    put(tmp_path / "gamma" / "project.json", {**good, "project_id": "other"})
    put(tmp_path / ".trash" / "project.json", good)
    projects, warnings = R.scan_projects(spark, str(tmp_path))
    assert [r.project_id for r in projects.collect()] == ["alpha"]
    assert sorted(r.folder for r in warnings.collect()) == ["beta", "gamma"]


def test_ocr_results_must_name_their_image(spark, tmp_path):
    block = {"type": "title", "text": "Hi", "bbox": [1, 2, 3, 4], "legibility": "clear"}
    put(tmp_path / "ocr" / "p1" / "Card 1.json", {"source_image": "01_input/images/Card 1.png", "ocr": {"blocks": [block, block], "warnings": ["w"]}})
    put(tmp_path / "ocr" / "p1" / "b.json", {"source_image": "01_input/images/c.png", "ocr": {"blocks": [block], "warnings": []}})
    blocks, problems = R.read_ocr_results(spark, str(tmp_path / "ocr") + "/*")
    assert [(r.project_id, r.source_file, r.block_order) for r in blocks.orderBy("block_order").collect()] == [("p1", "01_input/images/Card 1.png", n) for n in (1, 2)]
    assert [r.problem for r in problems.collect()] == ["source_mismatch"]


def test_job_records(spark, tmp_path):
    base = {"job_id": "j1", "project_id": "p", "kind": "source", "status": "running", "progress_message": "m", "progress_current": 1, "progress_total": 2,
            "error": None, "created_at": "2026-01-01T00:00:00Z", "started_at": None, "finished_at": None, "updated_at": "2026-01-01T00:00:00Z"}
    newer = {**base, "job_id": "j2", "created_at": "2026-01-02T00:00:00Z"}
    wrong = {**base, "job_id": "j3", "created_at": "2026-01-03T00:00:00Z", "progress_current": 5}
    put(tmp_path / "jobs.json", "\n".join(json.dumps(j) for j in (base, newer, wrong)))
    rows = R.read_job_records(spark, str(tmp_path / "jobs.json")).collect()
    assert [(r.job_id, r.status, r.interrupted) for r in rows] == [("j2", "interrupted", True)]


def test_glossary_table_problems(spark, tmp_path):
    head = "﻿" + "\t".join(("status", "source_term", "translation", "category", "note", "variants", "occurrences", "locations", "example", "candidate_id"))
    put(tmp_path / "g" / "p1" / "g.tsv", head + "\nkeep\tA\t\tterm\t\t\t1\tp1\t\"two\nlines\"\tterm-1\n\t\t\t\t\t\t\t\t\t\nshort\trow\n")
    put(tmp_path / "g" / "p2" / "g.tsv", "status\tother\n")
    rows, problems = R.read_glossary_tsv(spark, str(tmp_path / "g") + "/*")
    assert [(r.project_id, r.source_term, r.translation, r.example, r.record_no) for r in rows.collect()] == [("p1", "A", "", "two\nlines", 2)]
    assert sorted((r.project_id, r.record_no, r.problem) for r in problems.collect()) == [("p1", 4, "field_count"), ("p2", 1, "header")]
