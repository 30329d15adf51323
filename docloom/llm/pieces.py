"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised (a dummy blank in front, blanks written as U+2581) and cut into units, which are encoded one by one: the symbols of a unit start as
its characters, an agenda holds the adjacent pairs whose union is a piece, and the pair of the best score (the leftmost of equals) is joined until none is
left; what is no piece then falls back to its bytes, or to the unknown piece. A unit ends between two characters that stand side by side in no piece of the
vocabulary, so no union reaches over its end and cutting changes nothing.

A worker keeps the ids of short units that it has met (at most ``KEPT`` units, about 130 MB, then it starts anew) from task to task, which changes no result. Every
Arrow batch is checked against the sentencepiece library: ids and decoded text of each row must be the library's, or the job fails with the row named.

The vocabulary file's path is a parameter; the driver reads it (checked size) and sends its bytes to the executors once.
"""

from __future__ import annotations

import heapq
import os
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textscan import pieces as slices

MOST_VOCABULARY_BYTES = 16 << 20
BLANK = "▁"
#: Units of at most SHORT characters are kept, at most KEPT of them in a task.
SHORT, KEPT = 32, 1 << 19
NEVER = float("inf")
# Numbers of model and piece types in the file format.
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Kept(dict):
    """Ids of short units that were met, by unit; what is missing is made."""

    def __init__(self, make: Callable[[str], list[int]]):
        super().__init__()
        self.make = make

    def __missing__(self, unit: str) -> list[int]:
        ids = self.make(unit)
        if len(unit) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[unit] = ids
        return ids


class Vocabulary:
    """A merge-type vocabulary: encodes and decodes single texts."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format_

        model = format_.ModelProto.FromString(raw)
        if model.trainer_spec.model_type != BPE:
            raise ValueError("not a merge-type vocabulary")
        if not {p.type for p in model.pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.all_blanks = spec.remove_extra_whitespaces
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.byte = [self.id_of_byte(model, b) for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.high = {i: b for b, i in enumerate(self.byte or []) if b >= 128}
        shown = {NORMAL: lambda p: p.piece.replace(BLANK, " "), UNKNOWN: lambda p: model.trainer_spec.unk_surface, CONTROL: lambda p: "", BYTE: lambda p: chr(int(p.piece[1:-1], 16))}
        self.surface = [shown[p.type](p) for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.dummy = [p.type == NORMAL and p.piece.startswith(BLANK) for p in model.pieces]
        # A unit ends between two characters that stand side by side in no piece.
        within = {pair for p in self.id for pair in zip(p, p[1:], strict=False)}
        letters = sorted({c for pair in within for c in pair})
        self.number = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        at = {c: n for n, c in enumerate(letters, 1)}
        self.across = len(letters) + 1
        self.apart = np.ones(self.across**2, dtype=bool)
        self.apart[[at[x] * self.across + at[y] for x, y in within]] = False
        self.kept = _Kept(self._unit)

    @staticmethod
    def id_of_byte(model, b: int) -> int:
        name = f"<0x{b:02X}>"
        return next(i for i, p in enumerate(model.pieces) if p.type == BYTE and p.piece == name)

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return BLANK + text.replace(" ", BLANK) if text else ""

    def units(self, text: str) -> list[str]:
        """text cut wherever no piece goes on, so that no union of symbols reaches over a cut."""
        number = self.number[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        cut = (np.flatnonzero(self.apart.take(number[:-1] * self.across + number[1:])) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)] if text else []

    def symbols(self, unit: str) -> list[str]:
        """The unit's symbols when the agenda is empty. A short unit's agenda is a list in order of place, whose least entry a scan finds; a long one's is a heap."""
        return self._listed(unit) if len(unit) <= SHORT else self._heaped(unit)

    def _listed(self, unit: str) -> list[str]:
        cost = self.cost.get
        part = list(unit)
        agenda = [cost(a + b, NEVER) for a, b in zip(unit, unit[1:], strict=False)]
        while agenda and (least := min(agenda)) != NEVER:
            i = agenda.index(least)
            part[i] += part.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(part[i] + part[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost(part[i - 1] + part[i], NEVER)
        return part

    def _heaped(self, unit: str) -> list[str]:
        part, cost, n = list(unit), self.cost, len(unit)
        before, after, agenda = list(range(-1, n - 1)), [*range(1, n), -1], []
        for a, pair in enumerate(map("".join, zip(unit, unit[1:], strict=False))):
            if pair in cost:
                agenda.append((cost[pair], a, a + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            # An entry is stale when one of its symbols has been joined to another since.
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            for left, right in ((before[a], a), (a, after[a])):
                if left >= 0 and right >= 0 and (pair := part[left] + part[right]) in cost:
                    heapq.heappush(agenda, (cost[pair], left, right, len(pair)))
        return [p for p in part if p]

    def _unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for s in self.symbols(unit):
            known = self.id.get(s)
            if known is not None:
                out.append(known)
            elif self.byte:
                out += [self.byte[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.kept.__getitem__, self.units(self.normalised(text)))))
        if not self.byte:  # one unknown piece stands for a run of them
            ids = [i for at, i in enumerate(ids) if i != self.unknown or not at or ids[at - 1] != i]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of bytes as UTF-8 (U+FFFD for each byte of what is none), the dummy blank in front dropped."""
        if self.high.keys().isdisjoint(ids):
            out = "".join([self.surface[i] for i in ids])
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.high:
                    run.append(self.high[i])
                else:
                    parts += [_bytes(run), self.surface[i]]
                    run = bytearray()
            out = "".join([*parts, _bytes(run)])
        # Only a blank that the first piece itself carries is the dummy one; control pieces in front don't count.
        first = next((i for i in ids if i not in self.silent), self.unknown)
        if not self.strip or not self.dummy[first]:
            return out
        return out.lstrip(" ") if self.all_blanks else out[1:]


def _bytes(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (4, 3, 2, 1):
                try:
                    out.append(run[at : at + size].decode())
                    at += len(run[at : at + size])
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=1)
def loaded(raw: bytes) -> Vocabulary:
    """The vocabulary of a worker, with the units it has kept so far."""
    return Vocabulary(raw)


def _lists(ids: list[list[int]]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(i) for i in ids], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=at[-1])))


def encoded(spark: SparkSession, docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) of every row of docs: the ids of its whole text, without begin or end, and their decoded text.

    A null text is empty; an empty text has no ids. Repeated rows repeat, null keys stay, other columns are not read, an empty table stays empty. Raises
    ValueError for a vocabulary that is no merge-type one or too large, and fails the job for a row in which the library's ids or text differ.
    """
    if os.path.getsize(vocabulary) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to send to executors")
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    Vocabulary(raw.value)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(raw.value)
        for batch in batches:
            for a, b, _, _ in slices(batch.column(1)):
                names, texts = batch.column(0).slice(a, b - a), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids = [own.encode(t) for t in texts]
                decoded = [own.decode(i) for i in ids]
                checked(own, names, texts, ids, decoded)
                yield pa.RecordBatch.from_arrays([names, _lists(ids), pa.array(decoded, pa.string())], [key, "ids", "decoded"])

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def checked(own: Vocabulary, names: pa.Array, texts: list[str], ids: list[list[int]], decoded: list[str]) -> None:
    """Raises ValueError that names the first row whose ids or decoded text are not the library's."""
    want = own.library.encode(texts, num_threads=1)
    for what, mine, theirs in (("ids", ids, want), ("decoded text", decoded, own.library.decode(want, num_threads=1) if want else [])):
        if mine != theirs:
            at = next(i for i, (m, t) in enumerate(zip(mine, theirs, strict=True)) if m != t)
            raise ValueError(f"{what} of {names[at]} differ from the library's")


def id_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
