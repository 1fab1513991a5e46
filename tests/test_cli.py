import json

from statements import layout, main_statement, words

from ledgerloom import cli


def test_curated_run_writes_only_what_is_proved(spark, tmp_path, capsys):
    path = str(tmp_path / "F1.parquet")
    words(spark, main_statement()).write.parquet(path)
    (tmp_path / "layout.json").write_text(json.dumps(layout()))
    base = [path, "--sections", "--layout", str(tmp_path / "layout.json"), "--section", "fees"]
    assert cli.main([*base, "--out", str(tmp_path / "good")]) == 0
    made = json.loads((tmp_path / "good" / "summary.json").read_text())
    assert made["fees"]["sum"] == "2020.40" and made["fees"]["reconciled"] and made["fees"]["row_count"] == 2
    answers = {"statements": {"F1.parquet": {"sections": {"fees": {"subtotal": "2020.41", "row_count": 2}}}}}
    (tmp_path / "answers.json").write_text(json.dumps(answers))
    assert cli.main([*base, "--expected", str(tmp_path / "answers.json"), "--out", str(tmp_path / "bad")]) == 1
    assert not (tmp_path / "bad").exists() and "FAIL" in capsys.readouterr().out
    assert cli.main([path, "--sections", "--layout", str(tmp_path / "layout.json"), "--section", "loans"]) == 2
