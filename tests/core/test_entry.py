import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm(tmp_path):
    """What is left when the llm folders and the pipeline go still imports and has its queries."""
    for name in ("__spark_entry__.py", "tessera"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "tessera" / "llm")], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_vote' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
