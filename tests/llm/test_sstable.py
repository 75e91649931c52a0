import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from matchspark.llm import sstable
from matchspark.llm.encoding import TextEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library():
    rng = random.Random(1)
    letters = list(" \n\t.,'!aAbßéÉ1२語<|>\x1c\x85\xa0σΣİ") + ["the", "don't", " \n", "  ", "I'LL", "<|endoftext|>"]
    texts = ["", "a <|endoftext|> b", "<|startoftext|>x", "A<|ENDOFTEXT|>B"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = TextEncoder(public_tokenizers.path(name))
        got = [np.frombuffer(x, "<u2").tolist() for x in encode.batch(texts)]
        fresh = Tokenizer.from_file(public_tokenizers.path(name))
        assert got == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_and_lookup(spark, tmp_path):
    rng = random.Random(2)
    texts = {i * 7 - 50: " ".join(rng.choice(["Alpha", "beta,", "x\n", "ÉTÉ"]) for _ in range(rng.randint(0, 400))) for i in range(300)}
    texts[3000] = None
    rows = [(k, t, "s") for k, t in texts.items()] + [(13, "again", "s"), (None, "no id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    shards = sstable.write_shards(docs, f"file://{tmp_path}/t", PATH, 1).collect()
    got = sstable.read_shards(sstable.manifest(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    tk = Tokenizer.from_file(PATH)
    want, start = [], 0
    for k, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert sum(s.documents for s in shards) == len(want)
    opened = [sstable.Shard(s.path) for s in shards]
    for k in (-50, 13, 20, 3000):
        found = [v.tolist() for s in opened for v in s.get(k)]
        assert sorted(found) == sorted(tk.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows if i == k)
    assert not any(s.get(14) for s in opened)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.round_trip(docs, PATH, 1).count() == 0


def test_plain_paths_are_where_spark_takes_them_to_be(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(3, "some words"), (1, None)], "doc_id long, text string")
    shards = sstable.write_shards(docs, str(tmp_path / "plain"), public_tokenizers.path("word_bpe_49k.json"), 1)
    assert all(r.path.startswith("file:") for r in shards.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in sstable.read_shards(shards).collect())[0] == (1, 1)


def test_slices_hold_few_bytes_and_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sstable, "TEXT_BYTES", 10)
    for texts in ([], [None], ["é" * 30, "a", None, "b" * 9, "c" * 11, "", "d"], ["ab"] * 40):
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
        got = [part.column(1).to_pylist() for part in sstable.slices(batch)]
        assert sum(got, []) == texts and all(got)
        assert all(sum(len((t or "").encode()) for t in part[1:-1]) <= 10 for part in got)
