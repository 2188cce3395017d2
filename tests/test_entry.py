"""The entry module without the training-data operators, or without what they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), set(s) <= set(q), 'hybrid_rrf' in q, sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("hidden", ["siltstone.llm", "public_tokenizers", "corpus_pipeline"])
def test_queries_without_a_module(hidden):
    hide = f"""
import builtins
real = builtins.__import__
def no(name, globals=None, locals=None, fromlist=(), level=0):
    full = name if not level else (globals or {{}}).get('__package__', '') + '.' + name
    if full == {hidden!r} or full.startswith({hidden!r} + '.') or (full + '.' + (fromlist or ('',))[0]) == {hidden!r}:
        raise ModuleNotFoundError(f'no {{full}}')
    return real(name, globals, locals, fromlist, level)
builtins.__import__ = no
"""
    said = subprocess.run([sys.executable, "-c", hide + SAY], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, paired, engine, ops, pipeline = said.stdout.split()
    assert paired == engine == "True" and int(n) > 60
    present = (ROOT / "siltstone/llm").exists() and hidden != "siltstone.llm"
    assert (int(ops) == 10) == present
