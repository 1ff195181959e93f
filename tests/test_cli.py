"""Command line without a cluster."""

import json

from folioscan import cli

TABLE = "| Rank | A |\n|---|---|\n| 1 | x |\n| 1 | y |\n"


def test_table(tmp_path, capsys):
    p = tmp_path / "t.md"
    p.write_text(TABLE)
    assert cli.main(["table", str(p), "--table-id", "tt", "--to", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["table_id"] == "tt"
    assert cli.main(["table", str(p), "--strict"]) == 1
    assert cli.main(["check", str(tmp_path)]) == 1
    p.write_text(TABLE.replace("1 | y", "2 | y"))
    assert cli.main(["check", str(tmp_path)]) == 0


def test_document(tmp_path, capsys):
    p = tmp_path / "d.md"
    p.write_text(TABLE + "\n" + TABLE.replace("A", "B"))
    for to in ("jsonl", "summary"):
        assert cli.main(["document", str(p), "--to", to]) == 0
        assert len(capsys.readouterr().out.splitlines()) == 2
    assert cli.main(["document", str(p), "--to", "embedding-markdown"]) == 0
    assert "Retrieval text" in capsys.readouterr().out
