"""Progress of a folder by the times of its files."""

import json
import os

import pytest

from evidentia.plans import folders


def test_progress_rate_and_newest_documents(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"e{i}").mkdir()
        eye = "LEFT" if i < 6 else "right"
        doc = {"lesions": {"HE": {"count": i % 2, "area": 5.0, "quadrants": {"superior_nasal": i}}}, "measurements": {"optic_disc_cup": {"eye_side": eye, "cup_disc_ratio": {"value": i / 10}}, "vessels": {"av_ratio": "none", "qc_flag": True}}}
        path = tmp_path / f"e{i}" / "analysis.json"
        path.write_text(json.dumps(doc) if i != 10 else "broken {")
        os.utime(path, (1000 + 10 * i, 1000 + 10 * i))
    pattern = f"file://{tmp_path}/*/analysis.json"
    state = folders.folder_progress(spark, pattern, 20, 5).first()
    assert (state.total, state.done, state.missing) == (20, 12, 8)
    assert state.rate == pytest.approx(0.1) and state.eta_seconds == pytest.approx(80)
    assert {r.entity for r in folders.recent_documents(spark, pattern, 4).collect()} == {"e8", "e9", "e10", "e11"}
    said = folders.summary_of_documents(folders.recent_documents(spark, pattern, 7)).first()
    assert (said.scanned, said.eye_left, said.eye_right, said.eye_unknown) == (6, 1, 5, 0)
    assert said.he_rate == pytest.approx(4 / 6) and said.he_sn == 5 + 6 + 7 + 8 + 9 + 11 and said.ex_rate == 0
    assert (said.cdr_n, said.cdr_p10, said.cdr_p50, said.cdr_p90) == (6, 0.5, 0.7, 0.9) and said.av_ratio_n == 0 and said.qc_rate == 1


def test_a_folder_without_documents(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    pattern = f"file://{tmp_path}/*.json*"
    (tmp_path / "a.json").write_text("[]")
    assert folders.folder_progress(spark, pattern, 3).first().done == 1
    said = folders.summary_of_documents(folders.recent_documents(spark, pattern, 5)).first()
    assert said.scanned == 0 and said.he_rate == 0 and said.cdr_n == 0 and said.cdr_p50 is None


def test_a_folder_is_read_to_any_depth(spark, tmp_path):
    for i in range(40):
        (tmp_path / "set" / f"entity=e{i}").mkdir(parents=True)
        (tmp_path / "set" / f"entity=e{i}" / "a.txt").write_text('{"lesions": {"HE": {"count": %d}}}' % (i % 2))
    (tmp_path / "set" / "_SUCCESS").write_text("")
    row = folders.folder_progress(spark, str(tmp_path / "set"), 50).first()
    assert (row.total, row.done, row.missing) == (50, 40, 10)
    said = folders.summary_of_documents(folders.recent_documents(spark, str(tmp_path / "set"), None)).first()
    assert (said.scanned, said.he_rate) == (40, 0.5)
