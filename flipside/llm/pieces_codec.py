"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped as the model's normalizer asks, cut where no piece of the vocabulary can reach across
(between a character and a following space mark), and each segment is merged by an agenda: a heap of
adjacent symbol pairs that make a piece, best score first, leftmost first among equals; entries whose symbols
have changed since are skipped. What no piece covers falls back to its bytes, or to the unknown id.

Segments recur, so each task keeps those it has merged, at most ``memo`` of them at a time. Each newly merged
segment is checked against the sentencepiece library, batch by batch; ``agrees`` is false for a text with
a segment that the library encodes differently. Decoding is the library's.

Defined cases: null and empty texts have no tokens and decode to ''; runs of spaces and texts without any
are segments like others, whatever their length; rows that share an id get a row each; an empty table gives
an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, functions as F

from flipside.llm.common import map_arrow, texts, worker_memo

SPACE = "▁"
LONG = 200


class MergeVocabulary:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("a merge-type (BPE) vocabulary is needed")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix \
                or not rule.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normalizer with a leading space is supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.parts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.unknown = self.library.unk_id()
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None

    def merge(self, segment: str) -> list[int]:
        """The ids of an escaped segment."""
        score, symbols, n = self.score, list(segment), len(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (joined := pair + symbols[following]) in score:
                    heappush(agenda, (-score[joined], left, joined))
            if (previous := before[left]) >= 0 and (joined := symbols[previous] + pair) in score:
                heappush(agenda, (-score[joined], previous, joined))
        out, ids = [], self.ids
        for symbol in symbols:
            if not symbol:
                continue
            if (found := ids.get(symbol)) is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without its leading space mark."""
        if not text:
            return []
        if self.parts and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        escaped = SPACE + text.replace(" ", SPACE)
        if not self.parts:
            return [escaped[1:]]
        return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", escaped)]


class Encoder:
    """Encodes batches of texts; remembers segments."""

    def __init__(self, path: str, memo: int, check: bool = True):
        self.vocabulary, self.limit, self.check = MergeVocabulary(path), memo, check
        self.memo: dict[str, tuple[bytes, str]] = {}
        self.disputed: set[str] = set()

    def batch(self, batch_texts: list[str]) -> tuple[list[bytes], list[str], list[bool]]:
        """For each text: ids as little-endian unsigned 32-bit integers, decimal ids joined by commas, agreement."""
        v = self.vocabulary
        cut = [v.segments(t) for t in batch_texts]
        new = list(set().union(*cut).difference(self.memo))
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            self.disputed.clear()
            new = list(set().union(*cut))
        memo = self.memo
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            merged = [v.merge(SPACE + s) for s in some]
            if self.check:
                checked = [i for i, s in enumerate(some) if s]
                for i, ids in zip(checked, v.library.encode([some[i] for i in checked], num_threads=1)):
                    if ids != merged[i]:
                        self.disputed.add(some[i])
            for s, ids in zip(some, merged):
                memo[s] = array("I", ids).tobytes(), ",".join(map(str, ids))
        raw, said, agrees = [], [], []
        for segments in cut:
            found = [memo[s] for s in segments]
            raw.append(b"".join([x[0] for x in found]))
            said.append(",".join([x[1] for x in found]))
            agrees.append(not self.disputed or self.disputed.isdisjoint(segments))
        for s in [s for s in new if len(s) > LONG]:
            del memo[s]
        return raw, said, agrees


@worker_memo
def _encoder(path: str, memo: int) -> Encoder:
    return Encoder(path, memo)


@worker_memo
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _encode(path: str, memo: int):
    encoder = _encoder(path, memo)

    def step(batch):
        raw, _, agrees = encoder.batch(texts(batch, "text"))
        return {"id": batch["id"], "ids": [np.frombuffer(x, np.uint32) for x in raw], "agrees": agrees}

    return step


def _decode(path: str):
    library = _library(path)

    def step(batch):
        return {"id": batch["id"], "text": library.decode([x or [] for x in batch["ids"].to_pylist()], num_threads=1)}

    return step


def _digests(path: str, memo: int):
    encoder = _encoder(path, memo)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def step(batch):
        raw, said, agrees = encoder.batch(texts(batch, "text"))
        ids = [np.frombuffer(x, np.uint32).tolist() for x in raw]
        decoded = encoder.vocabulary.library.decode(ids, num_threads=1)
        return {"id": batch["id"], "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(x) for x in said],
                "decoded_sha256": [sha(x) for x in decoded], "agrees": agrees}

    return step


def _slim(df: DataFrame, id_col: str, other: str, name: str) -> tuple[DataFrame, str]:
    out = df.select(F.col(id_col).alias("id"), F.col(other).alias(name))
    return out, out.schema["id"].dataType.simpleString()


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 900_000) -> DataFrame:
    """id, ids (array of int), agrees."""
    out, kind = _slim(df, id_col, text_col, "text")
    return map_arrow(out, f"id {kind}, ids array<int>, agrees boolean", _encode, model_path, memo).withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text."""
    out, kind = _slim(df, id_col, ids_col, "ids")
    return map_arrow(out, f"id {kind}, text string", _decode, model_path).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = 900_000) -> DataFrame:
    """Encodes and decodes in one pass and returns digests only: id, n_tokens, ids_sha256 (of decimal ids joined
    by commas), decoded_sha256, agrees. The ids themselves don't leave the task."""
    out, kind = _slim(df, id_col, text_col, "text")
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return map_arrow(out, schema, _digests, model_path, memo).withColumnRenamed("id", id_col)
