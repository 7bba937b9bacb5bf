"""What an operator keeps in a Python worker goes when another operator's tasks come to it."""

import os
import subprocess
import sys

import pytest

pytest.importorskip("limen.llm")
pytest.importorskip("public_tokenizers")

from limen.llm import packing, substring, toxicity  # noqa: E402
from limen.llm.queries import tokenizer_file  # noqa: E402


def test_operators_empty_each_others_tables():
    toxicity.words_of(1, {"bad": 1.0}).features("some bad words")
    assert toxicity._words
    packing.encoder(tokenizer_file("byte_bpe_50k.json")).encode("some words")  # before: kept its table, and left the others'
    assert packing._encoders and not toxicity._words and not substring._hashes
    toxicity.words_alone()
    assert not packing._encoders


KEEPS = """
import re
from limen.llm import packing, toxicity
from limen.llm.queries import tokenizer_file

def used():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

path = tokenizer_file("byte_bpe_50k.json")
packing.encoder(path)
toxicity.words_alone()
before = used()
texts = [" ".join(f"word{i}x{j}" for j in range(100)) for i in range(300)]
encode = packing.encoder(path).encode
for t in texts:
    encode(t)
full = used()
del encode
toxicity.words_alone()
print(before, full, used())
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read from Linux")
def test_emptied_tables_go_back_to_the_system():
    said = subprocess.run([sys.executable, "-c", KEEPS], capture_output=True, text=True, check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    before, full, after = map(float, said.stdout.split())
    assert full - before > 10
    assert after - before < 0.25 * (full - before)  # before: the allocator kept what was freed
