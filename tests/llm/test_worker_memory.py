"""What a Python worker keeps once a stage is done."""

import subprocess
import sys
from pathlib import Path

WRITE = """
import random, sys
import pyarrow as pa

r = random.Random(1)
pool = [f"w{i}" for i in range(3000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(10000)), pa.array([" ".join(r.choices(pool, k=350)) for _ in range(10000)])], ["node", "text"])
with pa.OSFile(sys.argv[1], "wb") as f, pa.ipc.new_file(f, batch.schema) as w:
    w.write_batch(batch)
"""
READ = """
import re, sys
import pyarrow as pa
import numpy, xxhash
from sparkloom.llm import similar

def mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def batches():
    with pa.OSFile(sys.argv[1]) as f:
        yield pa.ipc.open_file(f).get_batch(0)

before, rows = mb(), 0
for out in similar._sets(5)(batches()):
    rows += out.num_rows
del out
print(rows, mb() - before)
"""


def test_freed_memory_goes_back(tmp_path):
    """After 20 MB of texts a process kept 117 MB more than before, and 48 since."""
    repo = Path(__file__).resolve().parents[2]
    run = lambda code: subprocess.run([sys.executable, "-c", code, str(tmp_path / "t")], cwd=repo, capture_output=True, text=True, check=True, timeout=120).stdout
    run(WRITE)
    rows, kept = run(READ).split()
    assert int(rows) == 10000 and float(kept) < 80
