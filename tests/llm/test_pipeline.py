"""A run of the corpus pipeline against the same rules in plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int"


def documents():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for n in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
        rows.append((n, "\n".join(["shared footer of this source", *lines] if n % 2 else lines), "en", f"s{n % 2}", 1, 1))
    base = rows[0][1].split(" ")
    for n in range(100, 106):  # near copies of the first text
        copy = list(base)
        copy[n % len(copy)] = "changed"
        rows.append((n, " ".join(copy), "en", "s0", 1, 1))
    rows += [rows[3], rows[3], (None, rows[5][1], "en", "s1", 1, 1), (None, " ".join(word() for _ in range(40)) + " password=abcdefgh1", None, None, None, 2)]
    rows += [(200, None, "en", "s0", 1, 1), (201, "", "en", "s0", 1, 1), (202, "too few words", "en", "s0", 1, 1), (203, "one two three four five six seven eight " * 9, "en", "s0", 1, 1), (204, " ".join(f"w{i}" for i in range(20_000)), "en", "s9", 1, 1)]
    return rows


def plain(rows):
    """The rows before packing, by the rules of the four stages."""

    def good(text):
        words = (text or "").split()
        at = defaultdict(list)
        for i in range(len(words) - 7):
            at[tuple(words[i : i + 8])].append(i)
        again = len({i + j for x in at.values() if len(x) > 1 for i in x for j in range(8)})
        return len(words) >= 20 and 100 * again <= 30 * len(words)

    rows = [r for r in rows if good(r[1])]
    pages, seen = Counter(), Counter()
    for text, source in {(r[1], r[3]) for r in rows}:
        pages[source] += 1
        for line in set(text.split("\n")):
            seen[source, line] += 1
    common = {k for k, n in seen.items() if n >= 3 and n > 0.05 * pages[k[0]] and k[1].strip(" ")}
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x) not in common), *r[2:]) for r in rows]
    sets = [set(zip(*(r[1].lower().split()[i:] for i in range(5)))) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    groups = defaultdict(list)
    for r, n in zip(rows, label, strict=True):
        groups[n].append(r)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    return [(r[0], r[1].replace("password=abcdefgh1", "[assign]")) for r in first]


def test_run_equals_the_rules(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for doc_id, text in plain(rows):
        ids = np.array(encode(text, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want.update((doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for b in fill.values():
        ends = np.cumsum([n for _, n in sorted(b)]).tolist()
        assert [x for x, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
