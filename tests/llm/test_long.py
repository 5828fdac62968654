"""Very long texts in bounded memory, and ids that many rows share."""

import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from tracewell.llm import token_files
from tracewell.llm.queries import tokenizer_path

PROBE = """
import random, resource, sys
import numpy as np, pyarrow as pa
from tracewell.llm import bpe, token_files, packing
from tracewell.llm.queries import tokenizer_path
rng = random.Random(1)
block = " ".join(rng.choice(["the", "Über", "rain,", "x9", "don't", "slowly", "12", "hill."]) for _ in range(200_000))
text = " ".join([block] * (int(sys.argv[2]) * 1_000_000 // len(block.encode()) + 1))
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
del text, block
path = tokenizer_path()
what = sys.argv[1]
if what == "op9":
    b = bpe.Bpe(path)
    memo = b.memo()
    memo.encode(pa.array(["warm up"]))
elif what == "op3":
    token_files.library_memo(path).encode(pa.array(["warm up"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if what == "op9":
    bpe.digest_texts(b, memo, batch.column(1))
else:
    token_files._packed(path, 2, batch, np.zeros(1, np.int32))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("what", ["op3", "op9"])
def test_a_long_text_takes_few_times_its_size(what):
    """50 MB of text: what the operator adds to the memory that holds it."""
    out = subprocess.run([sys.executable, "-c", PROBE, what, "50"], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) < 350, out.stdout


def test_files_of_ids_that_many_rows_share(spark, monkeypatch):
    """A third of the rows has no id, a third one id: files stay about even, and ids ascend over them."""
    monkeypatch.setattr(token_files, "FILE_ROWS", 50)
    rng = random.Random(4)
    rows = [(None, f"null {k}") for k in range(300)] + [(500, f"same {k}") for k in range(300)] + [(k, f"own {k}") for k in rng.sample(range(1000), 300)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_token_files(docs, tokenizer_path(), 2).orderBy("part").collect()
    assert max(f.n_docs for f in files) <= 150 and sum(f.n_docs for f in files) == 900
    ids = [i for f in files for i, _ in token_files.read_file(f.uri)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    report = token_files.read_token_files(spark.createDataFrame(files)).orderBy("start").collect()
    assert [r.start for r in report] == np.cumsum([0, *(r.n_tokens for r in report[:-1])]).tolist()


def test_long_texts_are_packed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 7)
    from tokenizers import Tokenizer

    texts = ["one two three " * 40, "", None, "short", "x " * 13, "y " * 7, "z " * 6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    library = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in token_files.token_file_report(docs, tokenizer_path()).collect()}
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].n_tokens, got[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
