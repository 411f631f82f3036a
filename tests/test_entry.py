import json
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = ("import json, __spark_entry__ as e; q = e.queries(); "
       "print(json.dumps([len(q), any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q), len(e.oracle_sql())]))")


def answer(folder):
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True,
                          env={**os.environ, "PYTHONPATH": str(folder)})
    return json.loads(done.stdout.splitlines()[-1])


def test_entry_without_the_optional_parts(tmp_path):
    """The queries of the library are there with and without the training-data folders and the pipeline."""
    sizes = []
    for name, gone in (("neither", ["sparktab/llm", "corpus_pipeline.py"]), ("no-llm", ["sparktab/llm"])):
        skip = {os.path.join(ROOT, g) for g in gone}
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=lambda at, names: [
            n for n in names if n in (".git", "tests", "__pycache__") or os.path.join(at, n) in skip])
        n, optional, twins = answer(copy)
        assert n > 150 and twins > 100 and not optional
        sizes.append(n)
    assert sizes[0] == sizes[1]
