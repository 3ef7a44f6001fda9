"""What the driver keeps of op2's training."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import random, re
from pathlib import Path
from ontoweave.llm import toxicity

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024

draw = random.Random(3)
words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9))) for _ in range(20_000)]
texts = [" ".join(draw.choices(words, k=draw.randrange(30, 700))) for _ in range(2400)]
before = held()
toxicity.Model().fit(texts, [i % 2 for i in range(len(texts))], whole=1, epochs=1)
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_training_gives_its_memory_back():
    repo = Path(__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", CODE], cwd=repo, capture_output=True, text=True, check=True, timeout=300).stdout
    assert int(said.split()[-1]) < 60  # MB; it was 121 when each text had arrays of its own
