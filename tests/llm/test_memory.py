"""What the pipeline's Python kernels hold: executors are stopped at a fixed memory, and their workers are used again."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from veldspar.llm import decontamination, near_dedup, tokens

MB = 1 << 20


class Docs:
    """Stands for a DataFrame of doc_id and text; mapInArrow() gives the kernel itself."""

    columns, schema = ["doc_id", "text"], "doc_id long, text string"

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


@pytest.fixture(scope="module")
def batches():
    """12 MB of text in batches of 4 MB."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(3000)])
    texts = [" ".join(words[rng.integers(0, 3000, 350)]) for _ in range(6000)]
    return [pa.RecordBatch.from_arrays([pa.array(range(k, k + 2000)), pa.array(texts[k : k + 2000])], names=["doc_id", "text"]) for k in range(0, 6000, 2000)]


def peak(kernel, batches):
    rows = 0
    tracemalloc.start()
    for batch in kernel(iter(batches)):
        rows += batch.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000
    return most / MB


def test_signatures_hold_little(spark, batches):
    assert peak(near_dedup.signatures(Docs(), 5), batches) < 64


def test_decontamination_holds_little(spark, batches, monkeypatch):
    items = decontamination.Items([1], ["one two three four five six seven eight nine ten eleven"], 10)
    sent = type("Sent", (), {"value": items})
    monkeypatch.setattr(decontamination, "tune", lambda _: None)
    monkeypatch.setattr(decontamination, "n_parts", lambda _: 1)
    monkeypatch.setattr(decontamination, "passes", lambda *_: iter([sent]))
    docs = Docs()
    docs.sparkSession = spark
    assert peak(decontamination.decontaminate(docs, None), batches) < 64


def test_encoder_block_holds_little(batches):
    """Arrays of the encoding of one block, without the dictionary of pieces that a worker keeps."""
    encoder = tokens.encoder_of(tokens.tokenizer_path())
    for batch in batches:
        encoder.encode(batch.column(1))

    def run(batches):
        for block in tokens.X.blocks(batches, 1):
            encoder.encode(block.column(1))
            yield block

    assert peak(run, batches) < 80


GIVEN_BACK = """
import re
import numpy as np, pyarrow as pa
from veldspar.llm import _text as X
anon = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
batch = pa.RecordBatch.from_arrays([pa.array(["a b"] * 10)], names=["text"])
before = anon()
for block in X.blocks(iter([batch]), 0):
    held = [np.ones(12_000) for _ in range(1500)]
    last = np.ones(1_000)
    del held
print(anon() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="Linux only")
def test_freed_memory_is_given_back():
    got = subprocess.run([sys.executable, "-c", GIVEN_BACK], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=60)
    assert float(got.stdout) < 40
