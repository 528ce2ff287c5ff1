import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from seqloom.plans import registry

ROOT = Path(entry.__file__).parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_works_without_the_optional_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'display_target' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)


def test_nothing_else_imports_the_optional_operators():
    for path in (ROOT / "seqloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["req_id", "text"]


def test_works_where_the_optional_operators_cannot_be_imported(tmp_path):
    """A missing library of theirs leaves the other queries as they are."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'display_target' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
