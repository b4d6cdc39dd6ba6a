import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(setup: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {setup}; import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd="/")
    assert "NAMES" in out.stdout, out.stderr[-2000:]
    return set(out.stdout.split("NAMES", 1)[1].split())


def test_the_entry_works_without_the_optional_part():
    core = names("sys.modules['parley.llm'] = None")
    assert {"pipeline_decisions", "dashboard_record", "stream_tables"} <= core
    assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in core)
    assert core <= names("pass")


def test_other_import_errors_are_not_hidden():
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['parley.plans.catalog'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120, cwd="/").returncode != 0
