"""What Python workers keep."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_encoder_starts_no_threads():
    code = """
import os, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from barloom.llm.tokens import Encoder, default_path
encoder = Encoder(default_path("word_bpe_49k.json"))
before = len(os.listdir("/proc/self/task"))
encoder.encode(pa.array(["1%d x_%d \\u00e9\\u4e00%d" % (i, i, i) for i in range(2000)]))
print(len(os.listdir("/proc/self/task")) - before)
"""
    done = subprocess.run([sys.executable, "-c", code, str(REPO)], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "0", done.stderr
