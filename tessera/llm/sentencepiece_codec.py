"""SentencePiece models in the tokenizers library: encoding and decoding of documents.

The model's protobuf is read directly: pieces with scores and kinds, the kind of
model, the normaliser.  From it a tokenizer is rebuilt: the character map, the
marker for spaces, unigram scores or - for BPE models - the merges that the
scores imply, and byte fallback.  The pieces come from a given model file (a
parameter); nothing is trained.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.tokens import chunks

MARK = "▁"
#: Kinds of pieces and of models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The pieces of a text between which no merge can happen in a separable model.
CUT = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
#: Distinct cuts that a task remembers; beyond that it keeps those of the texts at hand.
REMEMBERED = 500_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap = norm.get(2, b"")
            model.dummy_prefix, model.remove_extra_spaces, model.escape_spaces = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    return model


def separable(model: Model) -> bool:
    """Whether texts can be cut before runs of markers and around line ends: no piece reaches over such a place."""
    names = [p for p, _, k in model.pieces if k in (NORMAL, USER_DEFINED)]
    plain = model.kind == BPE and model.dummy_prefix and model.escape_spaces and not model.remove_extra_spaces and not model.charsmap
    return plain and ("<0x0A>", BYTE) in [(p, k) for p, _, k in model.pieces] and model.byte_fallback and not any(MARK in p.lstrip(MARK) or "\n" in p for p in names)


def build_tokenizer(model: Model):
    """A tokenizer of the tokenizers library that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((p for p, _, k in model.pieces if k == UNKNOWN), None)
    if model.kind == UNIGRAM:
        unk_id = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p: s for p, s, k in model.pieces if k in (NORMAL, USER_DEFINED, UNUSED)}
        merges = []
        for piece, score in usable.items():
            cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
            merges += [(-score, ids[a], ids[b], a, b) for a, b in cuts if a in usable and b in usable]
        core = models.BPE(ids, [m[3:] for m in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=2000)
    else:
        raise ValueError(f"unsupported kind of model: {model.kind}")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if separable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(CUT), "isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])]
    )
    return tokenizer


class Codec:
    """Encodes and decodes batches; what a separable model cuts is encoded once for each distinct cut."""

    def __init__(self, data: bytes, threads: int = 2, verify: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        model = parse_model(data)
        self.tokenizer, self.separable, self.threads, self.judge = build_tokenizer(model), separable(model), threads, None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.judge = SentencePieceProcessor(model_proto=data)
        self.ids: dict[str, bytes] = {}  # little-endian 32-bit integers of a cut
        self.odd: set[str] = set()  # cuts that don't decode to themselves
        self.wrong: set[str] = set()  # cuts about which the library disagrees
        if self.separable:  # cuts carry their markers already
            from tokenizers import Tokenizer

            self.cuts = Tokenizer(self.tokenizer.model)
            self.find = re.compile(CUT).findall

    def _learn(self, new: list[str]) -> None:
        """Encode, decode and verify distinct cuts, many in a line: a line end between two of them keeps them apart."""
        line_end = self.cuts.token_to_id("<0x0A>")
        self.ids["\n"] = np.array([line_end], "<i4").tobytes()
        new = [c for c in new if c != "\n"]
        blocks = [new[i : i + 512] for i in range(0, len(new), 512)]
        found = self.cuts.encode_batch_fast(["\n".join(b) for b in blocks], add_special_tokens=False)
        told = self.judge.encode(["\n" + "\n".join(b).replace(MARK, " ") for b in blocks], num_threads=self.threads) if self.judge else [None] * len(blocks)
        for block, encoding, other in zip(blocks, found, told, strict=True):
            ids = np.asarray(encoding.ids, "<i4")
            # in front the decoder strips a blank, and the library sets a marker before the first line end
            back = self.tokenizer.decode([line_end, *encoding.ids], skip_special_tokens=False)[1:].split("\n")
            self.odd.update(c for c, t in zip(block, back, strict=True) if t != c.replace(MARK, " "))
            ends = np.r_[np.flatnonzero(ids == line_end), len(ids)]
            starts = np.r_[0, ends[:-1] + 1]
            if other is not None and other[2:] != encoding.ids:
                theirs = np.asarray(other[2:], "<i4")
                cuts = np.r_[np.flatnonzero(theirs == line_end), len(theirs)]
                pairs = zip(block, starts, ends, np.r_[0, cuts[:-1] + 1], cuts, strict=True)
                self.wrong.update(c for c, i, j, k, m in pairs if not np.array_equal(ids[i:j], theirs[k:m]))
            self.ids.update((c, ids[i:j].tobytes()) for c, i, j in zip(block, starts.tolist(), ends.tolist(), strict=True))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool | None]]:
        """Ids as little-endian 32-bit integers, whether they decode to the text, and whether the sentencepiece library agrees."""
        if not self.separable:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            same = [a == b for a, b in zip(ids, self.judge.encode(texts, num_threads=self.threads), strict=True)] if self.judge else [None] * len(ids)
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            return [np.asarray(x, "<i4").tobytes() for x in ids], [a == b for a, b in zip(texts, back, strict=True)], same
        cut = [self.find(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        here = set().union(*cut)
        if len(self.ids) > REMEMBERED:  # frequent cuts are here too
            self.ids = {c: self.ids[c] for c in here if c in self.ids}
            self.odd &= here
            self.wrong &= here
        if new := list(here.difference(self.ids)):
            self._learn(new)
        ids = [b"".join(map(self.ids.__getitem__, x)) for x in cut]
        # the cuts of a text are the text, but that a marker in it reads as a space
        round_trip = [MARK not in t and self.odd.isdisjoint(x) for t, x in zip(texts, cut, strict=True)]
        return ids, round_trip, [self.wrong.isdisjoint(x) if self.judge else None for x in cut]


def encode_documents(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: bool = True
) -> DataFrame:
    """One row for each document: doc_id, token_ids, n_tokens, ids_sha256, round_trip, parity.

    ``round_trip``: decoding gives the text back.  ``parity``: the ids are those
    of the sentencepiece library (null unless ``verify``); it is asked about every
    distinct cut of a separable model, otherwise about every text.  ``ids_sha256`` is of
    the ids as little-endian 32-bit integers.  Null texts count as empty and have
    no tokens.  Rows that repeat are encoded each; other columns are ignored; an
    empty table gives an empty result.  The driver reads the model and sends its
    bytes (their size does not depend on the data).
    """
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, threads, verify)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, round_trip, same = codec.encode(texts)
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                values = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                        pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array(round_trip, pa.bool_()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "token_ids", "n_tokens", "ids_sha256", "round_trip", "parity"],
                )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, token_ids array<int>, n_tokens int, ids_sha256 string, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, model_file: str, ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, token_ids) to (doc_id, text); null ids give an empty text."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = build_tokenizer(parse_model(shared.value))
        for batch in batches:
            texts = tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", ids_col)
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
