import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(callable(q) for q in queries.values())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_need_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['lumatable.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p5_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_core_never_imports_llm():
    for source in (ROOT / "lumatable").rglob("*.py"):
        if "llm" not in source.parts:
            assert "lumatable.llm" not in source.read_text(), source
