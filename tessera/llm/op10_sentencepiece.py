"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model compiles into three parts. The normaliser replaces characters by the
model's map, adds the leading space and turns spaces into the visible mark. The
piece part has an arc for each
ordinary piece, and for a character without a piece an arc that writes its UTF-8
bytes. The joint part, for models of merged pairs, lets one piece follow
another only if merging the two together yields just these two; for unigram
models it lets everything follow everything. Composed with an input, a path's
weight is the sum of its arcs' weights, and the path of least weight is the
encoding. A sequence that every joint allows is unique in a model of merged
pairs, so there the path found is what merging in order of rank yields.

Where no piece reaches across the start of a word, which is tested when the
model compiles, the composition falls apart into words. Distinct words are solved
in sorted order, so that a word starts from the states it shares with the one
before, and are kept, up to a bounded number, for as long as a worker lives.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import chunks

MARK = "▁"
MODEL_BYTES = 64 << 20
CHARACTERS_KEPT = 2 << 20
CHUNK_BYTES = 1 << 20
JOINTS_KEPT = 1 << 18
RESULT = "n_pieces long, n_byte_pieces long, round_trip boolean, pieces array<int>"


def character_map(packed: bytes) -> dict[str, str]:
    """The strings that a model's normaliser replaces, from the double array that the model keeps them in.

    A unit of the array has a label, an offset to its children and whether a
    value hangs there; a value is a place among the replacements.
    """
    size = int.from_bytes(packed[:4], "little")
    units, replacements = np.frombuffer(packed[4 : 4 + size], "<u4").tolist(), packed[4 + size :]
    children = lambda at: at ^ (units[at] >> 10 << ((units[at] >> 9 & 1) * 8))
    found, ways = {}, [(children(0), b"")]
    while ways:
        base, read = ways.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            if units[at] >> 8 & 1:
                begin = units[children(at)] & 0x7FFFFFFF
                found[(read + bytes([label])).decode()] = replacements[begin : replacements.index(0, begin)].decode()
            ways.append((children(at), read + bytes([label])))
    return found


class Characters:
    """The normaliser's replacements compiled to patterns: the longest string that begins at a place is replaced."""

    def __init__(self, packed: bytes):
        self.by = character_map(packed)
        self.single = {ord(k): v for k, v in self.by.items() if len(k) == 1}
        several = sorted((k for k in self.by if len(k) > 1), key=len, reverse=True)
        one = "[" + "".join(re.escape(chr(c)) for c in sorted(self.single)) + "]"
        self.several = re.compile("|".join(map(re.escape, several))) if several else None
        self.every = re.compile("|".join([*map(re.escape, several), *([one] if self.single else [])]))

    def mapped(self, text: str) -> str:
        if self.several is None or self.several.search(text) is None:
            return text.translate(self.single)
        return self.every.sub(lambda m: self.by[m[0]], text)


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.characters = Characters(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.merges = proto.trainer_spec.model_type == 2
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.ids: dict[str, int] = {}
        self.byte_ids, self.unknown = {}, 0
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            text = p.piece.replace(MARK, " ").encode()
            if p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], text = i, bytes([value])
            elif p.type == kinds.NORMAL or p.type == kinds.USER_DEFINED:
                self.ids[p.piece] = i
            elif p.type == kinds.UNKNOWN:
                self.unknown, text = i, b" \xe2\x81\x87 "
            else:
                text = b""
            self.surface.append(text)
        self.texts = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.rarest = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.words: dict[str, bytes] = {}
        self.stored = 0
        self.joints: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        self.ends = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids
        if self.merges and any(len(p) == 1 and i < 0 for p, i in self.ends.items()):
            raise ValueError("a piece of the model has a character that is no piece")

    def merged(self, text: str) -> list[str]:
        """Merges neighbours, the best piece first and the leftmost of equals, as the model's rule says."""
        parts = list(text)
        while True:
            pairs = ((self.ids.get(a + b), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            best = max(((self.scores[i], -k) for i, k in pairs if i is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def joint(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow ``a``."""
        if len(self.joints) >= JOINTS_KEPT:
            self.joints.clear()
        left, right = self.texts[a], self.texts[b]
        known = self.joints[a << 32 | b] = self.merged(left + right) == [left, right]
        return known

    def whole(self, i: int) -> bool:
        """Whether merging the characters of a piece yields it."""
        known = self.reached[i] = self.merged(self.texts[i]) == [self.texts[i]]
        return known

    def _extend_merged(self, word: str, last: list[int], back: list[int]) -> None:
        """Appends the states of the composition with ``word``, in a model of merged pairs, beyond those there.

        The state after some characters is the last arc's piece, -1 for a
        character without a piece, and where that arc began; the joints leave
        one arc into each state, and each weighs nothing. ``ends`` has all ends
        of pieces, so arcs are tried from the shortest for as long as one can be.
        """
        ends, joints, reached = self.ends.get, self.joints.get, self.reached.get
        for end in range(len(last), len(word) + 1):
            begin = end - 1
            i = ends(word[begin:end])
            if i is None:
                last.append(-1)
                back.append(begin)
                continue
            while i is not None:
                if i >= 0:
                    u = last[begin]
                    ok = True if u < 0 else joints(u << 32 | i)
                    if ok is None:
                        ok = self.joint(u, i)
                    if ok:
                        ok = reached(i)
                        if self.whole(i) if ok is None else ok:
                            last.append(i)
                            back.append(begin)
                            break
                begin -= 1
                i = ends(word[begin:end]) if begin >= 0 else None

    def _extend_weighed(self, word: str, last: list[int], back: list[int], weights: list[float]) -> None:
        """The same in a unigram model: of the arcs into a state the one on the path of least weight stays."""
        for end in range(len(last), len(word) + 1):
            state = (float("inf"), 0, -1)
            for begin in range(max(0, end - self.longest), end):
                i = self.ids.get(word[begin:end])
                if i is not None:
                    state = min(state, (weights[begin] - self.scores[i], begin, i))
                elif begin == end - 1:
                    state = min(state, (weights[begin] - self.rarest, begin, -1))
            weights.append(state[0])
            back.append(state[1])
            last.append(state[2])

    def _ids(self, word: str, last: list[int], back: list[int]) -> bytes:
        """Ids on the path to the final state, as 32-bit integers."""
        arcs, end = [], len(word)
        while end:
            arcs.append((last[end], back[end], end))
            end = back[end]
        out: list[int] = []
        for i, begin, end in reversed(arcs):
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in word[begin:end].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of sorted normalised words; states that a word shares with the one before are kept."""
        found, before = [], ""
        last, back, weights = [-1], [0], [0.0]
        for word in words:
            same = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], back[same + 1 :], weights[same + 1 :]
            if self.merges:
                self._extend_merged(word, last, back)
            else:
                self._extend_weighed(word, last, back, weights)
            found.append(self._ids(word, last, back))
            before = word
        return found

    def normalise(self, text: str) -> str:
        if self.characters:
            text = self.characters.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (" " + text if self.prefix else text).replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as 32-bit integers."""
        normal = [self.normalise(t) for t in texts]
        cut = [_WORD.findall(t) for t in normal] if self.by_word else [[t] if t else [] for t in normal]
        if self.stored > CHARACTERS_KEPT:
            self.words.clear()
            self.stored = 0
        fresh = sorted({w for words in cut for w in words if w not in self.words})
        self.stored += sum(map(len, fresh))
        self.words.update(zip(fresh, self.solve(fresh), strict=True))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


_COMPILED: dict[str, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model, compiled once in a process."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _COMPILED:
        _COMPILED[name] = Transducer(model)
    return _COMPILED[name]


def read_model(path: str) -> bytes:
    """The model's bytes, which must be few enough to be sent to every executor."""
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_pieces, n_byte_pieces, round_trip and pieces of every row.

    ``round_trip`` tells whether decoding gives back the text as the model's
    normaliser leaves it. Null and empty texts have no pieces and round-trip.
    Text that is no valid UTF-8 is read with U+FFFD in its place. Rows are
    mapped one by one, so repeated rows, null keys and empty tables need no
    rule of their own; other columns are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            for begin, end in chunks(batch.column(1), CHUNK_BYTES):
                texts = [(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column(1)[begin:end]]
                yield _encoded(t, batch.column(0)[begin:end], texts)

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def _encoded(t: Transducer, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    ids = t.encode(texts)
    lengths = np.array([len(b) // 4 for b in ids], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(ids), np.int32)
    back = []
    for k, text in enumerate(texts):
        wanted = t.normalise(text).replace(MARK, " ")
        back.append(t.decode(flat[offsets[k] : offsets[k + 1]].tolist()) == (wanted[1:] if t.prefix else wanted))
    in_bytes = np.concatenate([[0], np.cumsum(t.is_byte[flat])])
    pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
    columns = [keys, pa.array(lengths), pa.array(in_bytes[offsets[1:]] - in_bytes[offsets[:-1]]), pa.array(back, pa.bool_()), pieces]
    return pa.RecordBatch.from_arrays(columns, ["key", "n_pieces", "n_byte_pieces", "round_trip", "pieces"])


def decode(encoded: DataFrame, model_path: str, *, key: str = "doc_id", pieces: str = "pieces") -> DataFrame:
    """``key`` and the text of every row's pieces; null pieces give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            texts = [t.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(key, pieces).mapInArrow(run, f"`{key}` {kind}, text string")
