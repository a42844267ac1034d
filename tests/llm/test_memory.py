"""Python workers give freed memory back after a task."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORKER = """
import re, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from ledgerlens.llm import repetition

class Scan:                                     # keeps the function that the operator gives to Spark
    schema = None
    def mapInArrow(self, task, schema):
        self.task = task
        return self

def anon():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    for k in range(n):
        texts = [" ".join(f"w{(r * 7919 + k + j * (r + 3)) % 60013}" for j in range(500)) for r in range(4000)]
        yield pa.RecordBatch.from_pydict({"text": texts})

scan = Scan()
repetition.keep_good(scan)
for batch in scan.task(iter([pa.RecordBatch.from_pydict({"text": ["a b c"]})])):
    pass
before = anon()
held = list(batches(1))
mid = anon()
for batch in scan.task(iter(held)):
    del batch
print(round(before), round(mid), round(anon()))
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux's memory figures")
def test_worker_gives_memory_back():
    out = subprocess.run([sys.executable, "-c", WORKER, ROOT], capture_output=True, text=True, check=True)
    before, with_input, after = map(int, out.stdout.split())
    assert after < with_input + 10, (before, with_input, after)


def test_released_keeps_results_and_order(monkeypatch):
    from ledgerlens.llm import common

    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    rows = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(common.released(lambda batches: (b for b in batches))(iter(rows))) == rows
    assert calls == [1]
    assert list(common.released(lambda batches: iter(()))(iter(()))) == [] and calls == [1, 1]
    small, large = pa.table({"x": [1]}), pa.table({"x": list(range(common.RELEASE_BYTES // 8))})
    assert common.released_group(lambda t: t)(small) is small and calls == [1, 1]
    assert common.released_group(lambda t: t)(large) is large and calls == [1, 1, 1]
    common.release_memory()
