"""SentencePiece pieces by unigram Viterbi over a double-array trie, and their decoding.

Text is used as it is: spaces become the marker U+2581 and one marker goes before the
text. No piece crosses from other characters into a marker, so the best path of a text is
that of its segments (markers and what follows them), and each segment is solved once in
a process. The new segments of a batch are solved side by side: one array step advances
all their trie states. Characters without a piece fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchspark.llm.text import crc_of_ids

MARK = "▁"
#: Segments of at most so many bytes are solved side by side and kept, so many in one table.
SHORT, TABLE = 64, 8192
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class DoubleArray:
    """Trie over UTF-8 bytes: the child of state s by byte b is base[s] + b + 1 if check says s."""

    def __init__(self, pieces: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, value in pieces.items():
            at = 0
            for b in piece:
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                at = tree[at][b]
            ends[at] = value
        size = 2 * len(tree) + 600
        self.base, self.check, self.value = array("i", [0] * size), array("i", [-1] * size), array("i", [-1] * size)
        todo, free, top = [(0, 0)], 1, 1
        self.check[0] = 0
        while todo:
            node, at = todo.pop()
            self.value[at] = ends.get(node, -1)
            codes = sorted(tree[node])
            if not codes:
                continue
            while self.check[free] != -1:
                free += 1
            base, tries = max(0, free - codes[0] - 1), 0
            while any(self.check[base + c + 1] != -1 for c in codes):
                tries += 1
                base = base + 1 if tries < 16 else top  # behind all that is used
            top = max(top, base + codes[-1] + 1)
            if top + 600 > len(self.check):
                self.base.extend([0] * size)
                self.check.extend([-1] * size)
                self.value.extend([-1] * size)
            self.base[at] = base
            for c in codes:
                self.check[base + c + 1] = at
                todo.append((tree[node][c], base + c + 1))


class Codec:
    """Ids of texts and texts of ids for a model file's pieces and scores."""

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.trie = DoubleArray({self.names[i].encode(): i for i in plain})
        self.unknown = min(self.scores[i] for i in plain) - 10
        if any(MARK in self.names[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece crosses into a marker")
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else self.names[i].encode() for i in range(n)]
        spare = [-1] * 300  # no state's child, so steps behind a segment's end find nothing
        self.base, self.check, self.value = (np.array([*x, *spare], np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.score_of = np.array(self.scores)
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def segment(self, text: str) -> list[int]:
        """Best path of one segment: highest sum of log scores; on a tie the shorter last piece."""
        data = text.encode("utf-8", "surrogatepass")
        base, check, value, scores, size = self.trie.base, self.trie.check, self.trie.value, self.scores, len(data)
        best, back = [float("-inf")] * size + [0.0], [(-1, size)] * size
        for at in range(size - 1, -1, -1):
            if data[at] & 0xC0 == 0x80:
                continue
            step = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            state, single = 0, False
            for end in range(at, size):
                child = base[state] + data[end] + 1
                if child >= len(check) or check[child] != state:
                    break
                state = child
                if (piece := value[state]) >= 0:
                    single |= end + 1 == at + step
                    if (score := scores[piece] + best[end + 1]) > best[at]:
                        best[at], back[at] = score, (piece, end + 1)
            if not single and (score := self.unknown + best[at + step]) > best[at]:
                best[at], back[at] = score, (-1, at + step)
        ids, at = [], 0
        while at < size:
            piece, end = back[at]
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in data[at:end]]
            at = end
        return ids

    def learn(self, segments: set[str]) -> None:
        """Solve the segments that are not known; the short ones of like lengths together."""
        new = segments.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = segments
        coded = sorted(((part.encode("utf-8", "surrogatepass"), part) for part in new), key=lambda x: len(x[0]))
        for at in range(0, len(coded), TABLE):
            some = coded[at : at + TABLE]
            self.known.update(zip((part for _, part in some), self.side_by_side([data for data, _ in some]), strict=True))

    def side_by_side(self, segments: list[bytes]) -> list[bytes]:
        """Ids (int32 bytes) of segments in order of length, by the same rule as ``segment``."""
        sizes = np.array([len(x) for x in segments])
        most = int(sizes[-1])
        codes = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in segments), np.uint8).reshape(-1, most).T.astype(np.int32)
        inner = codes & 0xC0 == 0x80
        step = np.select([codes < 0x80, codes < 0xE0, codes < 0xF0], [1, 2, 3], 4)
        codes[np.arange(most)[:, None] >= sizes] = 256
        best = np.full((most + 1, len(segments)), -np.inf)
        best[sizes, np.arange(len(segments))] = 0
        piece, end_of = np.full((most, len(segments)), -1, np.int32), np.zeros((most, len(segments)), np.int32)
        for at in range(most - 1, -1, -1):
            here = np.flatnonzero((sizes > at) & ~inner[at])
            walk, state, single = here, np.zeros(len(here), np.int32), np.zeros(len(segments), bool)
            for end in range(at, most):
                child = self.base[state] + codes[end, walk] + 1
                found = self.check[child] == state
                walk, state = walk[found], child[found]
                if not len(walk):
                    break
                ends = self.value[state]
                hit = ends >= 0
                at_end, ends = walk[hit], ends[hit]
                single[at_end[step[at, at_end] == end + 1 - at]] = True
                score = self.score_of[ends] + best[end + 1, at_end]
                better = score > best[at, at_end]
                won = at_end[better]
                best[at, won], piece[at, won], end_of[at, won] = score[better], ends[better], end + 1
            alone = here[~single[here]]
            after = at + step[at, alone]
            score = self.unknown + best[after, alone]
            better = score > best[at, alone]
            won = alone[better]
            best[at, won], piece[at, won], end_of[at, won] = score[better], -1, after[better]
        at, every, path = np.zeros(len(segments), np.int32), np.arange(len(segments)), []
        fallback, going = np.zeros(len(segments), bool), every
        while len(going):
            taken = np.full(len(segments), -2, np.int32)
            taken[going] = piece[at[going], going]
            fallback |= taken == -1
            path.append(taken)
            at[going] = end_of[at[going], going]
            going = going[at[going] < sizes[going]]
        table = np.array(path).T
        raw, lengths, width = np.ascontiguousarray(table).tobytes(), (4 * (table >= 0).sum(axis=1)).tolist(), 4 * len(path)
        out = [raw[i * width : i * width + n] for i, n in enumerate(lengths)]
        for i in np.flatnonzero(fallback):
            out[i] = np.array(self.segment(segments[i].decode("utf-8", "surrogatepass")), "<i4").tobytes()
        return out

    def batch(self, texts: list[str | None], group: int = 1000) -> list[np.ndarray]:
        """The ids of each text; ``group`` texts are taken together to meet new segments."""
        out = []
        for i in range(0, len(texts), group):
            split = [SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts[i : i + group]]
            every = set().union(*split)
            far = [part for part in every if len(part) > SHORT // 4 and len(part.encode("utf-8", "surrogatepass")) > SHORT]
            long = {part: np.array(self.segment(part), "<i4").tobytes() for part in far}
            self.learn(every.difference(long))
            known = self.known
            for parts in split:
                whole = not long or long.keys().isdisjoint(parts)
                ids = b"".join(map(known.__getitem__, parts) if whole else (long[x] if x in long else known[x] for x in parts))
                out.append(np.frombuffer(ids, "<i4"))
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes join to UTF-8 (wrong ones become U+FFFD), markers to spaces; the first one goes."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, n_ids, ids_crc32, restored`` for each row: the ids of the whole text and
    whether decoding gives it back (a text that itself holds the marker does not come back).

    Null and empty texts have no ids and are restored as empty. Other columns are not read.
    """
    names = ["doc_id", "ids", "n_ids", "ids_crc32", "restored"]

    def run(batches):
        model = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                ids = model.batch(texts)
                sizes = np.array([len(x) for x in ids])
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype("i4"), np.concatenate(ids))
                same = [model.decode(x.tolist()) == (text or "") for x, text in zip(ids, texts, strict=True)]
                cells = [part.column(0).cast(pa.int64()), lists, pa.array(sizes, pa.int64()), pa.array([crc_of_ids(x) for x in ids], pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, restored boolean")
