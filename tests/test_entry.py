import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidemark import session

ROOT = Path(entry.__file__).parent
ASK = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def run_in(folder: Path) -> subprocess.CompletedProcess:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(folder)}
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def copy(tmp_path: Path) -> Path:
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_core_runs_without_the_subpackage(tmp_path):
    at = copy(tmp_path)
    shutil.rmtree(at / "tidemark" / "llm", ignore_errors=True)
    out = run_in(at)
    names, sql = (set(line.split()) for line in out.stdout.strip().splitlines())
    assert "p3_found" in names and not any(n.startswith(("p1_", "p4_", "p7_")) for n in names) and sql <= names


def test_a_broken_subpackage_is_no_missing_one(tmp_path):
    at = copy(tmp_path)
    if not (at / "tidemark" / "llm").exists():
        pytest.skip("the subpackage isn't there")
    (at / "tidemark" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    out = run_in(at)
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
