"""Exact and fast ids from public tokenizer files: each distinct word is encoded once.

Both vocabularies never merge across the start of a white-space run, so a text's ids are
the ids of its space-separated chunks in order. The chunks of a group of texts are told
apart in Arrow, and nothing is kept after the group; with a vocabulary of another form a
process keeps the ids of chunks that it has met. Texts with white space or markers for
which this does not hold are encoded whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from matchspark.llm.text import KEPT

#: White space other than space and line feed, and separators that libraries class differently.
ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85᠎​﻿]")
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")
CONTROL_SPACE = re.compile(r"[\x1c-\x1f\x85᠎​﻿]")
#: Punctuation that stands in a pre-token of its own after letters (the apostrophe does not).
TAIL = ".,!*$%&#|;:?"


#: Chunks that the library encodes at a time: what it keeps of each takes far more memory than its ids.
AT_ONCE = 5_000
#: Characters of texts whose distinct words are encoded together.
TOGETHER = 5_000_000


def strings(array: pa.Array) -> list[str]:
    """The strings of an array; faster than its own list for many short ones."""
    return array.to_numpy(zero_copy_only=False).tolist()


def parts(chunks: list[str]) -> list[list[str]]:
    return [chunks[i : i + AT_ONCE] for i in range(0, len(chunks), AT_ONCE)]


class ChunkIds(dict):
    """Chunk -> its ids as little-endian unsigned 16-bit bytes; emptied when it holds ``limit``.

    ``lead`` is what stands before a chunk in its text. ``learn`` encodes the new chunks of
    a batch together: words of letters, told apart by the ids that begin or end a word.
    """

    def __init__(self, tokenizer, lead: str, lower: bool, limit: int = 500_000):
        super().__init__()
        self.tokenizer, self.lead, self.lower, self.limit = tokenizer, lead, lower, limit
        glyph = tokenizer.encode(f"{lead}a", add_special_tokens=False).tokens[0].replace("a", "", 1)
        self.edge = np.zeros(65_536, bool)
        edges = [i for token, i in tokenizer.get_vocab().items() if (token.startswith(glyph) if lead else token.endswith(glyph))]
        self.edge[edges if glyph else []] = True

    def encode(self, text: str) -> bytes:
        return self.numbers(text).tobytes()

    def several(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, "<u2").tobytes() for x in found]

    def numbers(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self)
        if not new:
            return
        if len(self) + len(new) > self.limit:
            self.clear()
            new = chunks
        whole, parted, odd = {}, [], []
        for chunk in new:
            base = chunk
            if not chunk.isalpha():
                base = chunk.rstrip(TAIL)
                if not base.isalpha():
                    odd.append(chunk)
                    continue
            if base.isascii():
                low = base.lower() if self.lower else base
            elif normalize("NFC", base).lower().isalpha():
                low = base
            else:
                odd.append(chunk)
                continue
            if low == chunk:
                whole[low] = None
            else:
                if low not in self:
                    whole[low] = None
                parted.append((chunk, low, chunk[len(base) :]))
        for some in parts(odd):
            self.update(zip(some, self.several([chunk if chunk[0] == "\n" else self.lead + chunk for chunk in some]), strict=True))
        for some in parts(list(whole)):
            self.update(zip(some, self.together(some), strict=True))
        tails = {tail: self.encode(tail) if tail else b"" for tail in {tail for _, _, tail in parted}}
        self.update((chunk, self[low] + tails[tail]) for chunk, low, tail in parted)

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: with a lead, one id of each begins it; else one id of each ends it."""
        ids = self.numbers(self.lead + (self.lead or " ").join(words)) if words else np.zeros(0, "<u2")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self.several([self.lead + word for word in words])
        starts, ends = (at, np.r_[at[1:], len(ids)]) if self.lead else (np.r_[0, at[:-1] + 1], at + 1)
        raw = ids.tobytes()
        return [raw[2 * x : 2 * y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)] if words else []

    def __missing__(self, chunk: str) -> bytes:
        self.learn({chunk})
        return self[chunk]


def spread(ids: np.ndarray, starts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids[starts[p]:starts[p + 1]]`` of all picks one after the other, and where each begins and the last ends."""
    n = (starts[1:] - starts[:-1])[picks]
    at = np.zeros(len(picks) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    kind = np.int32 if max(len(ids), at[-1]) < 2**31 else np.int64
    places = np.repeat((starts[picks] - at[:-1]).astype(kind), n)
    places += np.arange(at[-1], dtype=kind)
    return ids[places], at


class GroupIds:
    """Ids of groups of texts with a byte-level vocabulary: each distinct word of a group goes to the library once.

    No token of the vocabulary holds a letter and what follows a word (``TAIL``, a space or
    a line feed), or a line feed and a letter after it. So no merge crosses these places, and
    the library's model encodes words in one string, without the search for words in it.
    """

    #: Words in a string for the model, texts whose ids are put together at a time, ids of what ``prepared`` puts before a text, how many times ``TOGETHER`` a group is.
    WORDS, TEXTS, LED, TIMES = 200, 200, 1, 1

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.tokenizer, self.model = tokenizer, Tokenizer(tokenizer.model)
        self.table, vocab = self.glyphs(), tokenizer.get_vocab()
        self.edge = np.zeros(65_536, bool)
        self.edge[[i for token, i in vocab.items() if token[0] in self.mapped(" \n")]] = True

    @staticmethod
    def glyphs() -> np.ndarray:
        """Byte -> the character that stands for it in tokens."""
        from tokenizers.pre_tokenizers import ByteLevel

        every = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x8000)]))
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)[0][0]
        table = np.zeros(256, "<u2")
        table[np.frombuffer(every.encode(), "u1")] = np.frombuffer(shown.encode("utf-16-le"), "<u2")
        return table

    def mapped(self, text: str) -> str:
        return self.table[np.frombuffer(text.encode(), "u1")].tobytes().decode("utf-16-le")

    @classmethod
    def suits(cls, tokenizer) -> bool:
        """Whether ids of this tokenizer can be found so."""
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        model, cut = tokenizer.model, tokenizer.pre_tokenizer
        if tokenizer.normalizer or not isinstance(cut, ByteLevel) or cut.add_prefix_space or not cut.use_regex or not isinstance(model, BPE):
            return False
        if model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
            return False
        byte = {chr(c): b for b, c in enumerate(cls.glyphs().tolist()) if c}
        after, added = {*TAIL.encode(), *b" \n"}, {token.content for token in tokenizer.get_added_tokens_decoder().values()}
        glyph = dict(zip(" \n", cls.glyphs()[[32, 10]].tobytes().decode("utf-16-le"), strict=True))
        seam = re.compile(f".[{re.escape(TAIL + glyph[' '] + glyph[chr(10)])}]|{glyph[chr(10)]}.")
        for token in filter(seam.search, tokenizer.get_vocab()):
            if token in added:
                continue
            raw = bytes(byte.get(c, 0xFF) for c in token)
            for n in range(1, len(raw)):
                if raw[n] in after or raw[n - 1] == 10:
                    one, two = raw[:n].decode("utf-8", "replace")[-1], raw[n:].decode("utf-8", "replace")[0]
                    letters = one.isalpha() or one == "\ufffd", two.isalpha() or two == "\ufffd"  # U+FFFD: a part of a character
                    if (letters[0] or one in TAIL and two in " \n") and raw[n] in after or one == "\n" and letters[1]:
                        return False
        return len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words of letters, strings for the model after each other; a word with a line feed before it has no space."""
        out = []
        for at in range(0, len(words), self.WORDS):
            text = (" " + " ".join(words[at : at + self.WORDS])).replace(" \n", "\n")
            out.append(np.array(self.model.encode_batch_fast([self.mapped(text)], add_special_tokens=False)[0].ids, "<u2"))
        return out

    def chunks(self, distinct: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, where each begins and the last ends, and which must not be encoded alone."""
        words: dict[str, int] = {}
        ends: dict[str, int] = {}
        chunks = strings(distinct)
        others, head, tail, bad = [], [], [], np.zeros(len(chunks), bool)
        for n, chunk in enumerate(chunks):
            word = chunk.rstrip(TAIL)
            if word.isalpha() or word[:1] == "\n" and word[1:].isalpha():
                head.append(words.setdefault(word, len(words)))
                tail.append(ends.setdefault(chunk[len(word) :], len(ends)))
            else:
                body = chunk.removeprefix("\n")
                bad[n] = not body or not body.isprintable()
                others.append("" if bad[n] else chunk if body != chunk else " " + chunk)
                head.append(-len(others))
                tail.append(-1)
        runs = self.words(list(words))
        flat = np.concatenate([*runs, np.zeros(0, "<u2")])
        starts = np.flatnonzero(self.edge[flat])
        if len(starts) != len(words):
            raise ValueError("words and their first ids differ in number")
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([*others, *ends], add_special_tokens=False)] if others or ends else []
        flat = np.concatenate([flat, np.array([i for x in alone for i in x], "<u2")])
        starts = np.r_[starts, len(flat) - sum(map(len, alone)) + np.cumsum([0, *map(len, alone)]), len(flat)]  # the last run is empty
        heads, tails = np.array(head, np.int64), np.array(tail, np.int64)
        heads = np.where(heads < 0, len(words) - 1 - heads, heads)
        tails = np.where(tails < 0, len(starts) - 2, tails + len(words) + len(others))
        flat, at = spread(flat, starts, np.stack([heads, tails], 1).ravel())
        return flat, at[::2], bad

    @staticmethod
    def prepared(text: str) -> str:
        """The text with a space before each chunk but the first; it gets a line feed before it, so that its first word has no space, and that id is dropped."""
        return "\n" + text.replace("\n", " \n")

    def __call__(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text as little-endian unsigned 16-bit bytes; None: encode it whole."""
        places, coded = [], []
        for i in range(0, len(texts), self.TEXTS):
            lists = pc.split_pattern(pa.array([self.prepared(text) for text in texts[i : i + self.TEXTS]], pa.large_string()), " ")
            places.append(lists.offsets.to_numpy())
            coded.append(lists.values.dictionary_encode())
            del lists  # only codes and distinct chunks stay
        coded = pa.chunked_array(coded).unify_dictionaries().chunks
        flat, starts, bad = self.chunks(coded[0].dictionary)
        out: list[bytes | None] = []
        for at, some in zip(places, coded, strict=True):
            picks = some.indices.to_numpy()
            whole = np.logical_or.reduceat(bad[picks], at[:-1])
            ids, begins = spread(flat, starts, picks)
            raw, bounds = ids.tobytes(), begins[at].tolist()
            out += [None if w else raw[2 * (x + self.LED) : 2 * y] for w, x, y in zip(whole.tolist(), bounds, bounds[1:], strict=False)]
        return out


class WordIds(GroupIds):
    """Ids of groups of texts with a vocabulary whose words end in a suffix: each distinct word of a group goes to the library once.

    White space parts words and has no ids. Words of ASCII letters, in lower case, go to the
    library's model, many in a string that is cut at spaces, without its normalizer and its
    search for words; those of other letters go so to the whole library, and whatever else
    stands between spaces goes to it alone.
    """

    WORDS, LED, TIMES = 200, 0, 4
    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    CUTS = [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.model = tokenizer, Tokenizer(tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = tokenizer.model.end_of_word_suffix
        self.edge = np.zeros(65_536, bool)
        self.edge[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    @classmethod
    def suits(cls, tokenizer) -> bool:
        """Whether ids of this tokenizer can be found so: it has just these steps, and no byte is left out."""
        from tokenizers.models import BPE

        model, normal, cut = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        if not normal or not cut or not isinstance(model, BPE) or model.dropout or not model.end_of_word_suffix:
            return False
        if json.loads(normal.__getstate__()).get("normalizers") != cls.NORMAL or json.loads(cut.__getstate__()).get("pretokenizers") != cls.CUTS:
            return False
        vocab = tokenizer.get_vocab()
        return all(chr(c) in vocab and chr(c) + model.end_of_word_suffix in vocab for c in cls.glyphs().tolist() if c)

    @staticmethod
    def prepared(text: str) -> str:
        """The text with spaces for other ASCII white space; rarer white space stays in its chunk, for the library."""
        for space in "\n\t\r\v\f":
            text = text.replace(space, " ")
        return text

    def alone(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of chunks, each of them encoded alone, and how many each has."""
        for some in parts(chunks):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            yield np.array([i for ids in found for i in ids], "<u2"), np.array([len(ids) for ids in found])

    def runs(self, words: list[str], library) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of letters, strings of them after each other, and how many each has."""
        for at in range(0, len(words), self.WORDS):
            some = words[at : at + self.WORDS]
            ids = np.array(library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            last = np.flatnonzero(self.edge[ids])
            if len(last) == len(some):
                yield ids, np.diff(last, prepend=-1)
            else:  # a word that the library cuts
                yield from self.alone(some)

    @staticmethod
    def last(distinct: pa.LargeStringArray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The distinct ends of ``n`` bytes, eight at most, and which each chunk has."""
        _, offsets, data = distinct.buffers()
        ends = np.frombuffer(offsets, np.int64)[distinct.offset + 1 :][: len(distinct)]
        raw = np.concatenate([np.zeros(8, "u1"), np.frombuffer(data or b"", "u1")])
        eight = np.lib.stride_tricks.sliding_window_view(raw, 8)[ends].view(">u8").ravel().astype("u8")
        shift = 8 * (8 - n).astype("u8")
        found, which = np.unique(np.where(n > 0, eight << np.minimum(shift, 56) >> np.minimum(shift, 56), 0), return_inverse=True)
        return [int(x).to_bytes(8, "big").lstrip(b"\0").decode() for x in found], which

    def chunks(self, distinct: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = pc.ascii_rtrim(distinct, TAIL)
        n = pc.subtract(pc.binary_length(distinct), pc.binary_length(words)).to_numpy()
        known = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & (n <= 8)
        words = words.filter(pa.array(known))
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words).dictionary_encode()
        plain = pc.string_is_ascii(words.dictionary).to_numpy(zero_copy_only=False)
        runs = [*self.runs(strings(words.dictionary.filter(pa.array(plain))), self.model)]
        runs += self.runs(strings(words.dictionary.filter(pa.array(~plain))), self.tokenizer)
        place = np.where(plain, plain.cumsum() - 1, plain.sum() + (~plain).cumsum() - 1)[words.indices.to_numpy()]
        # a word that normal form cuts may end in a mark, which goes together with what follows
        pieces = np.concatenate([np.zeros(0, np.int64), *(np.add.reduceat(self.edge[ids], each.cumsum() - each, dtype=np.int64) for ids, each in runs)])
        own = ~known
        own[known] = (pieces[place] != 1) & (n[known] > 0)
        others = strings(distinct.filter(pa.array(own)))
        ends, tails = self.last(distinct, np.where(own, 0, n))
        runs += [*self.alone(others), *self.alone(ends)]
        heads = np.zeros(len(distinct), np.int64)
        heads[known] = place
        heads[own] = len(plain) + np.arange(len(others))
        flat = np.concatenate([ids for ids, _ in runs])
        starts = np.concatenate([[0], *(each for _, each in runs)]).cumsum()
        flat, at = spread(flat, starts, np.stack([heads, len(plain) + len(others) + tails], 1).ravel())
        return flat, at[::2], np.zeros(len(distinct), bool)


class TextEncoder:
    """Ids of whole texts, as the tokenizers library gives them with ``add_special_tokens=False``.

    A text that holds the string of a special token is encoded whole, so that string gets
    the id that the library gives it. Null is the empty text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        #: How the strings of all special tokens begin; a text with it is encoded whole.
        special = tokenizer.get_added_tokens_decoder().values()
        self.mark = "" if any(token.normalized for token in special) else commonprefix([token.content for token in special]) if special else "\0"
        #: One kind keeps a word's leading space in its first id, the other drops white space.
        self.spaced = tokenizer.encode(" a", add_special_tokens=False).ids != tokenizer.encode("a", add_special_tokens=False).ids
        if tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        lower = tokenizer.encode("AB", add_special_tokens=False).ids == tokenizer.encode("ab", add_special_tokens=False).ids
        self.words = ChunkIds(tokenizer, " " if self.spaced else "", lower)
        self.first = ChunkIds(tokenizer, "", lower, 100_000)
        kind = GroupIds if self.spaced else WordIds
        self.groups = kind(tokenizer) if kind.suits(tokenizer) else None

    def forget(self) -> None:
        """Give up the chunks that it has met."""
        self.words.clear()
        self.first.clear()

    def marked(self, text: str) -> bool:
        return self.mark in text

    def chunks(self, text: str) -> tuple[str, list[str]] | None:
        """The text's first chunk and the others without their space; None: encode it whole."""
        if self.marked(text):
            return None
        if not self.spaced:
            return None if CONTROL_SPACE.search(text) else ("", text.split())
        flat = text.replace("\n", " ")
        if "  " in flat or flat[:1] == " " or flat[-1:] == " " or not flat.isprintable():
            return None
        head, *rest = text.replace("\n", " \n").split(" ")
        return head, rest

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 16-bit bytes."""
        return self.batch([text])[0]

    def grouped(self, texts: list[str]) -> list[bytes]:
        whole = [self.marked(text) for text in texts]
        found = self.groups(["" if w else text for text, w in zip(texts, whole, strict=True)])
        return [self.joined(text, None) if w or ids is None else ids for text, w, ids in zip(texts, whole, found, strict=True)]

    def batch(self, texts: list[str | None], group: int = 300) -> list[bytes]:
        """The ids of each text; ``group`` texts, or about ``TOGETHER`` characters (or ``TIMES`` as many), are taken together to meet new words."""
        out = []
        if self.groups:
            texts = [text or "" for text in texts]
            total = sum(map(len, texts))
            part, chars, most = [], 0, total / max(1, round(total / (self.groups.TIMES * TOGETHER)))
            for text in texts:
                part.append(text)
                chars += len(text)
                if chars >= most:
                    out += self.grouped(part)
                    part, chars = [], 0
            return out + self.grouped(part) if part else out
        for i in range(0, len(texts), group):
            part = [text or "" for text in texts[i : i + group]]
            split = [self.chunks(text) for text in part]
            self.words.learn(set().union(*(x[1] for x in split if x)))
            self.first.learn({x[0] for x in split if x and x[0]})
            out += [self.joined(text, x) for text, x in zip(part, split, strict=True)]
        return out

    def joined(self, text: str, split: tuple[str, list[str]] | None) -> bytes:
        if split:
            return (self.first[split[0]] if split[0] else b"") + b"".join(map(self.words.__getitem__, split[1]))
        if not self.spaced or self.marked(text) or ODD_SPACE.search(text):
            return self.words.encode(text)
        parts = CHUNK.findall(text)
        return b"".join(self.words[c[1:]] if c[0] == " " and c[1:2] not in ("", " ", "\n") else self.first[c] for c in parts)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self(text), "<u2")


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each file and Python process, so tasks share what it has met."""
    made = TextEncoder(path)
    KEPT.append(made.forget)  # the vocabulary itself stays: to read it again takes more memory than to keep it
    return made
