"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

The encoder doesn't merge its way up. An Aho-Corasick automaton finds the longest pieces; a sequence of pieces is the model's
encoding just if each piece next to its successor is what merging their joint text gives (no merge across a boundary can come
first, else it would come first in that pair as well). So it takes the longest piece, checks it with the piece before by
merging the pair again (remembered), and backtracks to shorter pieces where the check fails; a bit for each position says that
no valid sequence goes on from there. Words repeat, so each worker keeps encoded words, within a bound.
"""

from __future__ import annotations

import re
from array import array
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import tune

SPACE = "▁"
#: Entries that a worker's memories hold; they start anew when full. Results don't depend on it.
WORDS, PAIRS = 600_000, 1_000_000


class Pieces:
    """Encoder and decoder of one model. model: the bytes of a .model file of type BPE with identity normalisation."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with identity normalisation and kept white space")
        kinds = type(spec.pieces[0])
        self.prefix = norm.add_dummy_prefix
        self.unk, self.bos, self.eos = spec.trainer_spec.unk_id, spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [self.unk] * 256
        self.text: list[bytes] = []
        self.byte_ids: set[int] = set()
        self.hidden = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.NORMAL:
                self.rank[p.piece] = (-p.score, i)
            elif p.type == kinds.BYTE:
                self.byte[b := int(p.piece[3:-1], 16)] = i
                self.byte_ids.add(i)
            elif p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("user-defined and unused pieces aren't supported")
            self.text.append(bytes([b]) if p.type == kinds.BYTE else b"" if i in self.hidden else spec.trainer_spec.unk_surface.encode() if i == self.unk else p.piece.replace(SPACE, " ").encode())
        self.piece = [p.piece for p in spec.pieces]
        self.fallback = spec.trainer_spec.byte_fallback
        #: If no piece has a space mark after another character, text falls apart before each run of marks.
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank)
        self.spaced = any(p.startswith(SPACE * 2) for p in self.rank)
        self.pairs: dict[int, bool] = {}
        self.marked, self.bare = _Words(self, SPACE), _Words(self, "")
        self.newline = _packed([self.byte[10]]) if self.fallback and not any("\n" in p for p in self.rank) else None
        self.sizes = np.array([len(t) for t in self.text], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        self.auto = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            if self.merged(p) == [p]:  # a piece that merging never gives can't be in an encoding
                self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The pieces of text by merging adjacent pieces, best score first, then leftmost. For checks of short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i, (a, b) in enumerate(pairwise(parts)):
                if (r := self.rank.get(a + b)) is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the joint text of pieces a and b gives a and b again."""
        if (known := self.pairs.get(a << 20 | b)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.piece[a], self.piece[b]
            known = self.pairs[a << 20 | b] = self.merged(x + y) == [x, y]
        return known

    def run(self, text: str) -> list[int]:
        """The pieces of a text whose characters are all pieces."""
        fit, greedy, last, end = self.fit, [], -1, -1
        for e, (size, i) in self.auto.iter_long(text):
            if e - size != end or last >= 0 and not fit(last, i):
                break
            greedy.append(i)
            last, end = i, e
        else:
            if end == len(text) - 1:
                return greedy
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for e, hit in self.auto.iter(text):
            starts[e - hit[0] + 1].append(hit)  # at each start from short to long
        failed, out, at, pos = bytearray(n // 8 + 1), [], [len(starts[0])], 0
        while pos < n:
            tries, k = starts[pos], at[-1] - 1
            while k >= 0:
                size, i = tries[k]
                if not failed[pos + size >> 3] >> (pos + size & 7) & 1 and (not out or fit(out[-1][1], i)):
                    break
                k -= 1
            at[-1] = k
            if k >= 0:
                out.append((size, i))
                pos += size
                if pos < n:
                    at.append(len(starts[pos]))
            else:
                failed[pos >> 3] |= 1 << (pos & 7)  # any valid sequence up to here is the same one, so that no other can go on either
                at.pop()
                if not out:
                    raise AssertionError("no valid sequence")
                pos -= out.pop()[0]
        return [i for _, i in out]

    def segment(self, text: str) -> list[int]:
        """The ids of a part of the text, space marks included. Characters that are no piece become bytes, or unknown."""
        out: list[int] = []
        known = self.rank
        start, missing = 0, False
        for k, c in enumerate(text):
            if c in known:
                if missing:
                    missing = False
                continue
            if k > start:
                out += self.run(text[start:k])
            if self.fallback:
                out += [self.byte[b] for b in c.encode()]
            elif not missing:
                out.append(self.unk)
            start, missing = k + 1, True
        if start < len(text):
            out += self.run(text[start:])
        return out

    def ids(self, text: str | None, ends: bool = True) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers, with begin and end ids if `ends`."""
        if not text:
            out = []
        elif self.apart and self.prefix and SPACE not in text and not (self.spaced and ("  " in text or text[0] == " " or text[-1] == " ")):
            self.marked.trim()
            out = [*map(self.marked.__getitem__, text.split(" "))]
        else:
            text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            if self.apart:
                out = [self.marked[w[1:]] if w[:1] == SPACE != w[1:2] else self.bare[w] for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", text)]
            else:
                out = [_packed(self.segment(text))]
        if ends:
            out = [_packed([self.bos]), *out, _packed([self.eos])]
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids (a list or array). Control ids give nothing; bytes that aren't UTF-8 give U+FFFD each."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.sizes[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return ""
        joined = self.flat[np.repeat(self.begins[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()
        first = int(ids[int(np.flatnonzero(size)[0])])
        if self.prefix and joined[:1] == b" " and first not in self.byte_ids and first != self.unk:
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _each_bad_byte(joined)


def _each_bad_byte(data: bytes) -> str:
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    return made.tobytes()


class _Words(dict):
    """The packed ids of words that were seen; mark: the space mark that stands before each, or nothing."""

    def __init__(self, pieces: Pieces, mark: str):
        self.pieces, self.mark = pieces, mark

    def trim(self) -> None:
        for held in (self, self.pieces.bare):
            if len(held) > WORDS:
                held.clear()

    def __missing__(self, word: str) -> bytes:
        own = self.pieces
        if own.newline and "\n" in word:  # no piece holds it, so both sides stand alone; such words are seldom seen again
            head, *rest = word.split("\n")
            return b"".join([self[head] if head or self.mark else b"", *(own.newline + (own.bare[w] if w else b"") for w in rest)])
        if len(word) > 2 and word[-1] in ".,":  # often the word alone is known; a fitting pair makes the whole valid
            base, end = self[word[:-1]], own.rank[word[-1]][1]
            if own.fit(int.from_bytes(base[-4:], "little"), end):
                found = self[word] = base + _packed([end])
                return found
        found = self[word] = _packed(own.segment(self.mark + word))
        return found


_made: dict[str, Pieces] = {}


def _worker(model) -> Pieces:
    """One encoder for each worker process and model."""
    import hashlib

    key = hashlib.sha256(model.value).hexdigest()
    if key not in _made:
        _made[key] = Pieces(model.value)
    return _made[key]


def encode(documents: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",), ends: bool = True) -> DataFrame:
    """The columns of `carry`, ids (array of int) and decoded (what decode() makes of them), one row for each row of documents.

    A null or empty text has no ids but the begin and end ones, and decodes to "". model_path is read by the driver, and the
    model (at most 64 MB) is broadcast. No shuffle.
    """
    return _encoded(documents, model_path, carry, ends, "ids array<int>, decoded string", _lists, ["ids", "decoded"])


def sequences(documents: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode() with begin and end ids, but n_tokens, ids and exact: whether decoding the ids gives the text back."""
    return _encoded(documents, model_path, carry, True, "n_tokens long, ids array<int>, exact boolean", _checked, ["n_tokens", "ids", "exact"])


def _checked(pieces: Pieces, packed: list[bytes], texts: list[str | None]) -> list[pa.Array]:
    ids, decoded = _lists(pieces, packed, texts)
    return [pa.array([len(x) // 4 for x in packed], pa.int64()), ids, pa.array([a == (b or "") for a, b in zip(decoded.to_pylist(), texts, strict=True)], pa.bool_())]


def _lists(pieces: Pieces, packed: list[bytes], texts: list[str | None]) -> list[pa.Array]:
    offsets = pa.array(accumulate((len(x) // 4 for x in packed), initial=0), pa.int32())
    values = pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))])
    return [pa.ListArray.from_arrays(offsets, values), pa.array([pieces.decode(memoryview(x).cast("I")) for x in packed], pa.string())]


def _digests(pieces: Pieces, packed: list[bytes], texts: list[str | None]) -> list[pa.Array]:
    from hashlib import sha256

    return [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([sha256(x).hexdigest() for x in packed]), pa.array([sha256(pieces.decode(memoryview(x).cast("I")).encode()).hexdigest() for x in packed])]


def digests(documents: DataFrame, model_path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode() with begin and end ids, but n_tokens, ids_sha256 and decoded_sha256 instead of ids and decoded text."""
    return _encoded(documents, model_path, carry, True, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(documents, model_path, carry, ends, made, finish, names) -> DataFrame:
    spark = documents.sparkSession
    tune(spark)
    with open(model_path, "rb") as f:
        data = f.read()
    if len(data) > 64_000_000:
        raise ValueError("the model is larger than 64 MB")
    model = spark.sparkContext.broadcast(data)
    rows = documents.select(*dict.fromkeys((*carry, "text")))
    kinds = dict(rows.dtypes)

    def go(batches):
        pieces = _worker(model)
        for b in batches:
            for at in range(0, b.num_rows, 100):  # ids of 100 documents at a time
                part = b.slice(at, 100)
                texts = part.column("text").to_pylist()
                packed = [pieces.ids(t, ends) for t in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *finish(pieces, packed, texts)], names=[*carry, *names])

    return rows.mapInArrow(go, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), made]))
