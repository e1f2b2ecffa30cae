"""BPE encoding and decoding with exact merges in linear time.

A word is matched once by an Aho-Corasick automaton over the vocabulary; the
encoder then takes the longest token at each position if the pair with the
token before it could stand in a finished merge sequence, falls back to shorter
prefixes of that token, and steps back over a position that none of them
passes. A position given up once is never tried again, so that the work is
linear in the word. Whether a pair may stand is decided by undoing the merges
on both sides of the boundary, and kept in a table. Decoding cuts the tokens'
strings out of one buffer by an offset table.

Defined cases: null and empty texts have no ids and decode to the empty text;
the strings of added tokens inside a text are those tokens; code points that
Python's Unicode tables do not know yet keep no case and count as symbols; other
columns are not read; repeated rows repeat their result; a table
without rows gives none.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, table

#: Pieces of words whose ids a worker keeps.
CACHE_WORDS = 500_000
#: Characters of text that are encoded at once.
BATCH_CHARS = 8_000_000
SUFFIX = "</w>"


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """A word-end BPE vocabulary: normalising, splitting, encoding and decoding."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        strings = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            strings[i] = s
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            strings[i] = s
        # Decoding: one buffer of all strings and where each begins.
        encoded = [s.encode() for s in strings]
        self.buffer, self.offsets = b"".join(encoded), array("q", [0])
        for e in encoded:
            self.offsets.append(self.offsets[-1] + len(e))
        # A word is a string over 512 letters: bytes, and bytes that end a word.
        own: list[str] = [""] * len(strings)
        for s, i in vocab.items():
            ends = s.endswith(SUFFIX) and s != SUFFIX
            body = [letters[c] for c in (s[: -len(SUFFIX)] if ends else s)]
            own[i] = "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)
        self.length = [len(s) for s in own]
        self.ids = ids = {s: i for i, s in enumerate(own) if s}
        self.most = max(self.length)
        self.left, self.right = list(range(len(own))), list(range(len(own)))
        self.pairs: dict[int, int] = {}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges):
            i, j = vocab[a], vocab[b]
            made = vocab[a + b]
            self.pairs[i << 20 | j] = made
            self.left[made], self.right[made] = i, j
        self.shorter = [-1] * len(own)
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            self.automaton.add_word(s, i)
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in ids:
                    self.shorter[i] = ids[s[:n]]
                    break
        self.automaton.make_automaton()
        self.fit: dict[int, int] = {}
        self.pieces_kept: dict[str, bytes] = {}
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^ \p{{L}}\p{{N}}]+").findall
        self.spaces = "".join(map(chr, [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a and b may be neighbours when all merges are done.

        The later made of the two is taken apart at the boundary, and no pair
        that met there may have had a merge earlier than what was made of it.
        """
        bound, x, y = 1 << 30, a, b
        while True:
            if self.pairs.get(x << 20 | y, bound) < bound:
                return False
            if x > y and self.right[x] != x or self.left[y] == y:
                if self.right[x] == x:
                    return True
                bound, x = x, self.right[x]
            else:
                bound, y = y + 1, self.left[y]

    def fitting(self, last: int, token: int) -> int:
        """The longest prefix of token, itself included, that may stand after last, or -1; kept in the table."""
        fit = token
        while fit >= 0 and not self.stands(last, fit):
            fit = self.shorter[fit]
        if len(self.fit) > 1_000_000:
            self.fit.clear()
        self.fit[last << 20 | token] = fit
        return fit

    def word(self, piece: str) -> list[int]:
        """Ids of one piece of the split."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        s = raw[:-1] + chr(ord(raw[-1]) + 256)
        n, length, shorter, fit = len(s), self.length, self.shorter, self.fit
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter_long(s):
            longest[end + 1 - length[i]] = i
        token = longest[0]
        if length[token] == n:
            return [token]
        out: list[int] = []
        at, last = 0, -1
        alive = bytearray(b"\1") * (n + 1)
        while at < n:
            if last >= 0 and token >= 0:
                fits = fit.get(last << 20 | token)
                token = self.fitting(last, token) if fits is None else fits
            if token < 0:  # nothing fits here: step back, and try less there
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = shorter[token]
                continue
            end = at + length[token]
            if not alive[end]:
                token = shorter[token]
                continue
            out.append(token)
            at, last, token = end, token, longest[end]
            if token < 0 and at < n:
                token = longest[at] = self.longest(s, at)
        return out

    def longest(self, s: str, at: int) -> int:
        """The longest token at a place where the automaton's own sequence of longest matches has no start."""
        rest = s[at : at + self.most]
        n = self.automaton.longest_prefix(rest)
        while (i := self.ids.get(rest[:n])) is None:
            n -= 1
        return i

    def piece(self, text: str) -> bytes:
        got = self.pieces_kept.get(text)
        if got is None:
            got = array("I", self.word(text)).tobytes()
            if len(text) <= 64:
                if len(self.pieces_kept) >= CACHE_WORDS:
                    self.pieces_kept.clear()
                self.pieces_kept[text] = got
        return got

    def chunk(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit numbers, of a run without white space."""
        if text.isalpha():
            return self.piece(text)
        if text[-1] in ".,!|" and text[:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join(map(self.piece, self.pieces(text)))

    def normalise(self, text: str) -> str:
        """Composed and lower-cased, every white space a plain space."""
        if text.isascii():
            odd = "\t\n\x0b\x0c\r"
        else:
            odd, text = self.spaces, unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for c in odd:
            if c in text:
                text = text.replace(c, " ")
        return text.lower()

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each whole text its ids, as little-endian unsigned 32-bit numbers, and what they decode to.

        Each distinct word of the batch is encoded and decoded once; the rest is
        done on dictionary-encoded columns.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        out, plain, at = [(b"", b"")] * len(texts), [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t and len(parts := self.split_added.split(t)) > 1:
                joined = b"".join(x for part in parts for x in self.part(part))
                out[k] = joined, self.decode(joined)
            elif t := self.normalise(t).strip(" "):
                plain.append(t)
                at.append(k)
        split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        words = split.values.dictionary_encode()
        ids = list(map(self.chunk, words.dictionary.to_pylist()))
        joined = []
        for values, between in ((ids, b""), (list(map(self.decode, ids)), b" ")):
            column = pa.LargeListArray.from_arrays(split.offsets, pa.array(values, pa.large_binary()).take(words.indices))
            joined.append(pc.binary_join(column, pa.scalar(between, pa.large_binary())).to_pylist())
        for k, x, y in zip(at, *joined, strict=True):
            out[k] = x, y
        return out

    def part(self, text: str) -> Iterator[bytes]:
        """Ids of what stands between added tokens, or of one of these."""
        if text in self.added:
            yield array("I", [self.added[text]]).tobytes()
        else:
            yield from map(self.chunk, filter(None, self.normalise(text).split(" ")))

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0][0]

    @property
    def strings(self) -> list[bytes]:
        """The table's strings, cut out of the buffer by the offsets."""
        made = self.__dict__.get("_strings")
        if made is None:
            made = self._strings = [self.buffer[a:b] for a, b in zip(self.offsets, self.offsets[1:], strict=False)]
        return made

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text: without a decoder in the vocabulary, the strings with a space between."""
        return b" ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def groups(column) -> Iterator[list[str | None]]:
    """The column's values in lists of a bounded number of characters, one value at least."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int, where asked for), n_tokens, ids_sha256, decoded_sha256 of every whole text.

    vocabulary: path of the vocabulary file on every executor; null: the
    installed public one, looked up by each executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(vocabulary or vocabulary_path())
        for b in batches:
            at = 0
            for texts in groups(b.column(1)):
                done = c.encode_batch(texts)
                ids = [x for x, _ in done]
                shas = [[hashlib.sha256(x).hexdigest() for x in part] for part in (ids, (y for _, y in done))]
                cols = [b.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), *(pa.array(x, pa.string()) for x in shas)]
                if keep_ids:  # straight from the bytes: lists of Python numbers would take nine times their room
                    data = b"".join(ids)
                    ends = array("i", [0])
                    for x in ids:
                        ends.append(ends[-1] + len(x) // 4)
                    values = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
                    cols.append(pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), values))
                at += len(texts)
                del done, ids
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text decoded from a list of ids; null ids decode to the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = codec(vocabulary or vocabulary_path())
        for b in batches:
            texts = [c.decode(array("I", x.as_py() or []).tobytes()).decode() for x in b.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), keep_ids=False)
