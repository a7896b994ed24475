import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_everything_else_works_without_the_removable_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in ("tracefold/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / part, ignore_errors=True)
    (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q); print([k for k in q if k.startswith('op') or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "[]"


def test_nothing_outside_uses_the_removable_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "tracefold")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"tracefold\.llm|from \.llm|corpus_pipeline", f.read()), name


def test_sql_goes_with_queries():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == e.queries()["num_counter"](spark, "/root/testdata/sf0.001").columns
    assert df.count() > 100


def test_other_queries_work_without_a_library_of_the_removable_part():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print([k for k in e.queries() if k.startswith('op') or k == 'pipeline'], len(e.oracle_sql()) > 70)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert "True" in out.stdout
