import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchspark.llm import encoding
from matchspark.llm.encoding import GroupIds, TextEncoder, WordIds

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def numbers(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u2").tolist()


@pytest.mark.parametrize("together", [1, 500, 12_000_000])
def test_groups_equal_the_library(monkeypatch, together):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    rng = random.Random(3)
    ends = ["", "", "", ".", ",", "&&&", "?!", "...", "'s", "….", "®,", "-", ")", "1", " "]
    word = lambda: "".join(rng.choice("etaoinshrdEéßçñµªº語あ𐐷́σΣİ") for _ in range(rng.randint(0 if rng.random() < 0.01 else 1, 9))) + rng.choice(ends)
    texts = ["".join(word() + rng.choice("     \n") for _ in range(rng.randint(0, 60))) + word() for _ in range(800)]
    texts += ["", "\n", " ", "a", "\na", "a\n", "a  b", "a\n\nb", "a <|endoftext|> b", "<|endoftext|>", "x\ty", "...", "\n...", "a " * 3000 + "b", None]
    got = [numbers(x) for x in TextEncoder(BYTES).batch(texts)]
    assert got == [x.ids for x in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_a_group_sends_each_word_once_and_keeps_nothing(monkeypatch):
    sent = []
    monkeypatch.setattr(GroupIds, "words", lambda self, words, real=GroupIds.words: sent.append(words) or real(self, words))
    encode = TextEncoder(BYTES)
    encode.batch(["First one, two. One two!\nTwo one", "one TWO three, one"] * 50)
    assert len(sent) == 1 and sorted(sent[0]) == sorted(["\nFirst", "one", "two", "One", "\nTwo", "\none", "TWO", "three"])
    assert not encode.words and not encode.first


def test_only_byte_level_vocabularies_that_keep_words_apart_are_grouped():
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    assert GroupIds.suits(Tokenizer.from_file(BYTES))
    assert not GroupIds.suits(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    for crossing in ("a.", "aĠ", ".Ġ", "Ċa", "©."):  # the last: the second byte of é and a dot
        vocab = {c: n for n, c in enumerate(["a", "Ġ", "Ċ", ".", "©", crossing])}
        made = Tokenizer(BPE(vocab, [(crossing[0], crossing[1])]))
        made.pre_tokenizer = ByteLevel(add_prefix_space=False)
        assert not GroupIds.suits(made), crossing
    for fine in ("..", "Ġa", "Ġ.", "aa"):
        vocab = {c: n for n, c in enumerate(["a", "Ġ", "Ċ", ".", fine])}
        made = Tokenizer(BPE(vocab, [(fine[0], fine[1])]))
        made.pre_tokenizer = ByteLevel(add_prefix_space=False)
        assert GroupIds.suits(made), fine


def test_packing_takes_few_documents_at_once(spark, monkeypatch, tmp_path):
    from matchspark.llm import packing

    class Noted:
        """An encoder that notes how many rows Spark handed over at once."""

        def __call__(self, path):
            return self

        def batch(self, texts):
            with open(f"{tmp_path}/{random.random()}", "w") as out:
                out.write(f"{len(texts)}")
            return [b"\x01\x00"] * len(texts)

    monkeypatch.setattr(packing, "ROWS", 40)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked, before = [], spark.conf.get(key, None)
    monkeypatch.setattr(packing, "encoder", Noted())
    monkeypatch.setattr(packing, "cut", lambda df, real=packing.cut: asked.append(spark.conf.get(key)) or real(df))
    docs = spark.createDataFrame([(i, "a b") for i in range(300)], "doc_id long, text string").coalesce(1)
    assert packing.pack(docs, BYTES).count() == 300
    assert int(asked[0]) == 40 and spark.conf.get(key, None) == before and asked[-1] != "40"
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 40


@pytest.mark.parametrize("together", [1, 300, 12_000_000])
def test_groups_of_words_equal_the_library(monkeypatch, together):
    monkeypatch.setattr(encoding, "TOGETHER", together)
    rng = random.Random(4)
    ends = ["", "", "", ".", ",", "&&&", "?!", "...", ":" * 8, "." * 9, "'s", "'LL", "….", "®,", "-", ")", "12", "/w>", "</w>"]
    letters = "etaoinETAOINd\u00e9\u00df\u00e7\u00f1\u00aa\u00ba\u03a3\u03c3\u03c2\u0130\u0131\u01c5\u0149\u2126\u212a\u8a9e\u3042\u1100\u1161\u11a8\uac01\u0958\u0915\u093c\U00010400\U00010437\u13a0Ww\u030a\u0301"
    spaces = [*"      \n\n", "  ", *"\t\r\v\f\x1c\x1f\x85\xa0\u1680\u180e\u2000\u200b\u2028\u3000\ufeff\0\x7f"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0 if rng.random() < 0.05 else 1, 9))) + rng.choice(ends)
    texts = ["".join(word() + rng.choice(spaces) for _ in range(rng.randint(0, 60))) + word() for _ in range(800)]
    texts += ["", "\n", " ", "a", "\na", "a\n", "a  b", "\u0301 \u0301a", "a <|endoftext|> b", "<|ENDOFTEXT|>", "<|x", "...", "\n...", "Ab " * 3000 + "b", None]
    got = [numbers(x) for x in TextEncoder(WORDS).batch(texts)]
    assert got == [x.ids for x in Tokenizer.from_file(WORDS).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_a_group_of_words_sends_each_word_once_and_keeps_nothing(monkeypatch):
    sent = []
    monkeypatch.setattr(WordIds, "runs", lambda self, words, library, real=WordIds.runs: sent.append(words) or real(self, words, library))
    encode = TextEncoder(WORDS)
    encode.batch(["First one, two. One two!\nTwo école", "one TWO three, one ÉCOLE"] * 50)
    assert [sorted(words) for words in sent] == [["first", "one", "three", "two"], ["ÉCOLE", "école"]]
    assert not encode.words and not encode.first


def test_only_vocabularies_with_known_steps_are_taken_by_words():
    from tokenizers import normalizers
    from tokenizers.pre_tokenizers import Whitespace

    assert WordIds.suits(Tokenizer.from_file(WORDS)) and not WordIds.suits(Tokenizer.from_file(BYTES))
    for part, other in [("normalizer", normalizers.Lowercase()), ("pre_tokenizer", Whitespace())]:
        made = Tokenizer.from_file(WORDS)
        setattr(made, part, other)
        assert not WordIds.suits(made), part
    made = Tokenizer.from_file(WORDS)
    made.model.end_of_word_suffix = None
    assert not WordIds.suits(made)


def test_marks_that_end_a_word_in_normal_form_go_with_what_follows():
    texts = ["\u0958, \u0936\u0941\u0958. \u0130, \u0130zm\u0130r, Wa\u0958", "\u095d!? e\u0301, \u00e9. W\u030a,"]
    assert [numbers(x) for x in TextEncoder(WORDS).batch(texts)] == [x.ids for x in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
