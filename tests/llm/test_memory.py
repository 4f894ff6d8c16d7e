"""What a worker holds between slices of texts."""

import subprocess
import sys
from pathlib import Path

MEASURE = """
import random, re
import public_tokenizers
from poolscope.llm.tokens import WordEncoder

def anonymous():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(4)
enc = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
words = [f"w{i}" for i in range(20000)]
enc.encode([" ".join(words)])
before = anonymous()
for _ in range(3):
    enc.encode([" ".join(rng.choices(words, k=1200)) for _ in range(1000)])
print(anonymous() - before)
"""


def test_an_encoder_gives_freed_memory_back():
    """Three slices of 8 MB bring no new pieces, so next to nothing more is held after them."""
    out = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2])
    assert float(out.stdout) < 40
