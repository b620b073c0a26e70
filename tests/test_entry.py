"""The entry module works with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def ask(folder):
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    corpus, everything, whole = done.stdout.split()[-3:]
    assert whole == "True"
    return int(corpus), int(everything)


def test_entry_without_the_corpus_operators(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT / "cadastrum", bare / "cadastrum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", bare)
    without = ask(bare)
    assert without[0] == 0 and without[1] > 90
    if (ROOT / "cadastrum" / "llm").is_dir():
        assert ask(ROOT) == (13, without[1] + 14)
