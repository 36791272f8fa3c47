"""The entry point with and without the training-data subpackage."""
import json
import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def _names(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": folder})
    return json.loads(out.stdout.strip().splitlines()[-1])


def _copy(scratch, without):
    to = os.path.join(scratch, "copy")
    shutil.copytree(HERE, to, ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), HERE) in without])
    return to


def test_entry_without_training_data(scratch):
    whole, _ = _names(HERE)
    own = [q for q in whole if not q.startswith("op") and q != "pipeline"]
    llm = os.path.join("caravan", "llm")
    for without in ({llm, os.path.join("tests", "llm")}, {llm, os.path.join("tests", "llm"), "corpus_pipeline.py"}):
        names, oracles = _names(_copy(os.path.join(scratch, str(len(without))), without))
        assert names == own and oracles == own


def test_an_error_inside_the_subpackage_is_raised(scratch):
    to = _copy(scratch, set())
    if not os.path.isdir(os.path.join(to, "caravan", "llm")):
        return
    with open(os.path.join(to, "caravan", "llm", "queries.py"), "a") as f:
        f.write("\nimport no_such_module\n")
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=to, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": to})
    assert out.returncode != 0 and "no_such_module" in out.stderr
