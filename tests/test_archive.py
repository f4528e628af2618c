"""Answers are kept one by one, by build, and asked for once."""

import json
from pathlib import Path

import pytest

from buildlens.operators import archive as AR


def prompts(spark, keys):
    return spark.createDataFrame([(k, f"p {k}") for k in keys], "case_key string, prompt string")


def asked(folder):
    return sorted(p.name for p in Path(folder).iterdir())


@pytest.fixture
def call(tmp_path):
    """Notes every call as a file, so that calls of dead tasks count as well."""
    notes = tmp_path / "calls"
    notes.mkdir()

    def run(system, prompt):
        (notes / f"{prompt} {len(list(notes.iterdir()))}").touch()
        if prompt.endswith("bad"):
            raise ValueError("refused")
        return json.dumps({"text": prompt, "tag": "T", "tag_type": "ok"})

    return run, notes


def test_answers_are_asked_for_once_by_build(spark, tmp_path, call):
    run, notes = call
    path = str(tmp_path / "kept")
    got = {r["case_key"]: tuple(r["ai_analysis"]) for r in AR.score_to_archive(prompts(spark, ["a", "b", "bad", "a"]), run, path, "7/x", slices=3).collect()}
    assert got == {"a": ("p a", "T", "ok"), "b": ("p b", "T", "ok"), "bad": ("Analysis failed: refused", "ANALYSIS ERROR", "warn")}
    assert len(asked(notes)) == 3
    more = AR.score_to_archive(prompts(spark, ["b", "c é%"]), run, path, "7/x", slices=5).collect()
    assert {r["case_key"] for r in more} == {"b", "c é%"} and len(asked(notes)) == 4
    assert AR.score_to_archive(prompts(spark, ["a"]), run, path, "8", slices=3).count() == 1 and len(asked(notes)) == 5
    assert AR.score_to_archive(prompts(spark, []), run, path, "9").count() == 0


def test_a_stop_in_a_slice_costs_the_call_in_flight(spark, tmp_path, call):
    run, notes = call
    path, stop = str(tmp_path / "kept"), tmp_path / "stop"
    stop.touch()

    def dies(system, prompt):
        if stop.exists() and len(list(notes.iterdir())) >= 12:
            raise SystemExit("the worker ends")
        return run(system, prompt)

    keys = [f"k{i}" for i in range(40)]
    with pytest.raises(Exception, match="ends|SystemExit|worker"):
        AR.score_to_archive(prompts(spark, keys), dies, path, "7", slices=4)
    before = AR.answers(spark, path, "7").count()
    assert before == len(asked(notes)) and before >= 12
    assert AR.score_to_archive(prompts(spark, keys), dies if not stop.unlink() else None, path, "7", slices=4).count() == 40
    assert sorted({n.rsplit(" ", 1)[0] for n in asked(notes)}) == sorted(f"p {k}" for k in keys) and len(asked(notes)) == 40


def test_a_task_tried_again_finds_the_answers_of_its_slice(tmp_path):
    store, top = AR._store(f"file:{tmp_path}")
    assert AR._finished(store, f"{top}/slice=1") == set()
    store.create_dir(f"{top}/slice=1")
    AR._write(store, f"{top}/slice=1", "a-0.json", {"key": "x", "raw": "r", "error": None})
    (tmp_path / "slice=1" / ".b-0.json.part").write_text('{"key": "y"')
    assert AR._finished(store, f"{top}/slice=1") == {"x"}


def test_other_builds_are_not_read(spark, tmp_path, call):
    path = str(tmp_path / "kept")
    for build in ("7", "8"):
        AR.score_to_archive(prompts(spark, ["a", "b"]), call[0], path, build, slices=2)
    files = AR.answers(spark, path, "7").inputFiles()
    assert len(files) == 2 and all("/build=7/" in f for f in files)
