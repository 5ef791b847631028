"""The entry module with and without the corpus operators, and the command line."""

import os
import shutil
import subprocess
import sys

from foliant import __main__ as command

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_corpus_operators(tmp_path):
    for name in ("foliant", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "foliant" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "chars_in", "chars_out", "tokens", "saved_pct"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("x,y,z\n1,2,3\n")
    (source / "b.html").write_text("<html><title>T</title><p>body   text</html>")
    assert command.run(spark, ["convert", str(source), "--output", f"{tmp_path}/out", "--chunk", "50", "--stats", "--stdout", "--report", f"{tmp_path}/r"]) == 0
    assert (tmp_path / "out" / "b.md").read_text() == "# T\n\nbody text\n" and (tmp_path / "out" / "a.part001.md").exists()
    assert "~" in capsys.readouterr().out
    (source / "c.pdf").write_bytes(b"%PDF-1.7")
    assert command.run(spark, ["convert", str(source), "--stdout"]) == 1
    assert command.run(spark, ["convert", str(source), "--ignore-errors", "--preset", "Fast Text"]) == 0
    assert command.run(spark, ["bundle", str(source), "--inbox", f"{tmp_path}/inbox", "--ignore-errors"]) == 0
    assert next((tmp_path / "inbox").glob("*/manifest.json")).exists()
    (tmp_path / "none").mkdir()
    assert command.run(spark, ["convert", str(tmp_path / "none")]) == 2
