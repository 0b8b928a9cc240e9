import importlib
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark, data):
    assert {r.status for r in entry.entry(spark).collect()} <= {"new", "changed", "unchanged", "deleted"}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_core_does_not_need_the_subpackage():
    """Everything but the subpackage llm imports without it, and so do the queries."""
    code = "import sys\nsys.modules['siltbed.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p8_ids' not in e.queries()"
    modules = [str(p.relative_to(ROOT).with_suffix("")).replace("/", ".") for p in (ROOT / "siltbed").rglob("*.py") if "llm" not in p.parts and p.name != "__init__.py"]
    code += "".join(f"\nimport {m}" for m in modules)
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert importlib.import_module("siltbed.plans.problems").QUERIES
