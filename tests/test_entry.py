"""The entry file works with and without the corpus operators, whatever keeps them from being imported."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def _copy(to: Path) -> Path:
    shutil.copytree(HERE / "leafmill", to / "leafmill", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            shutil.copy(HERE / name, to / name)
    return to


def _count(where: Path, before: str = "") -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # which may lead to another checkout
    done = subprocess.run([sys.executable, "-c", before + COUNT], cwd=where, env=env, capture_output=True, text=True, timeout=120, check=True)
    return done.stdout.split()


def _without(name: str) -> str:
    return f"import sys; sys.modules[{name!r}] = None; "


@pytest.mark.parametrize("case", ["deleted", "emptied", "no library", "no pipeline"])
def test_core_queries_stay(tmp_path, case, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", str(HERE))
    where, before = _copy(tmp_path), ""
    if case == "deleted":
        shutil.rmtree(where / "leafmill" / "llm", ignore_errors=True)
        (where / "corpus_pipeline.py").unlink(missing_ok=True)
    elif case == "emptied":
        shutil.rmtree(where / "leafmill" / "llm", ignore_errors=True)
        (where / "leafmill" / "llm" / "__pycache__").mkdir(parents=True)
    elif case == "no library":
        before = _without("tokenizers")
    else:
        (where / "corpus_pipeline.py").unlink(missing_ok=True)
    total, corpus, ok = _count(where, before)
    import __spark_entry__  # noqa: F401  (registers the queries)
    from leafmill.queries import catalog

    have = (HERE / "leafmill" / "llm" / "queries.py").exists()
    assert ok == "True" and int(corpus) == (13 if case == "no pipeline" and have else 0)
    assert int(total) == len(catalog.QUERIES) + int(corpus)
