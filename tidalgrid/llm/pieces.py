"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Texts are cut into marked words, which no piece of the vocabulary crosses. The distinct words of a batch are sorted, so
equal prefixes are neighbours, and traversed depth first as a trie: a stack keeps the forward state of each character of
the current word, and a word takes over the states of the prefix that it shares with the one before.

A state is the best score of a prefix with the last piece of that segmentation, over all pieces that end there. The
vocabulary's model merges pairs, so a free maximum of summed scores would not give its ids: a transition between two pieces is
forbidden, scored minus infinity, unless merging their joined text gives back these two. Of all transitions into a state one
at most is allowed, and the search for the maximum ends there. Characters without a piece become byte pieces.

Null texts count as empty and have no ids. Decoding gives back the text, but U+2581 reads as a blank, as in the library.
Rows are encoded one by one, repeated or not; columns of the input named like results are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidalgrid.llm.common import small_batches

MARK = "▁"
#: Words, and pairs of pieces, that a worker remembers.
MEMO = 200_000
#: Scores of a forbidden transition, and of a character that is written as bytes.
NEVER, BYTES = float("-inf"), -1e6
_PACKERS = [struct.Struct(f"<{n}i").pack for n in range(128)]
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Memo:
    """Remembered words in two generations: when the younger is full it becomes the older, and what is asked again returns."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> set[str]:
        """The words that aren't remembered; the others are in ``now`` afterwards."""
        if len(self.now) > MEMO:
            self.now, self.before = {}, self.now
        words = words.difference(self.now)
        old = words.intersection(self.before)
        self.now.update((w, self.before[w]) for w in old)
        return words - old


class Pieces:
    """A vocabulary with its merges, and the trie pass over sorted words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.id = {p: i for i, (p, s) in enumerate(zip(self.text, special, strict=True)) if not s}
        self.score = [sp.get_score(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.unbyte = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.bytes_of = [bytes([self.unbyte[i]]) if i in self.unbyte else b"" if i in self.silent else p.encode() for i, p in enumerate(self.text)]
        #: Pieces by their letters from last to first: (id or None, longer suffixes).
        self.suffixes: dict[str, list] = {}
        for piece, i in self.id.items():
            at = self.suffixes
            for c in piece[:0:-1]:
                at = at.setdefault(c, [None, {}])[1]
            at.setdefault(piece[0], [None, {}])[0] = i
        #: Letters that some piece holds together with a full stop or comma after them; after others these start a word.
        self.joined = {x for p in self.id for x, y in zip(p, p[1:]) if y in ".,"}  # noqa: B905
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, tuple] = {}
        self.memo, self.parts = Memo(), Memo()

    def merges(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merges the best pair, leftmost on ties, until none is left: (pieces, score of each merge, and before each merge
        and at the end the first piece and the last one)."""
        parts, scores = list(text), []
        firsts, lasts = [parts[0]], [parts[-1]]
        while True:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts, scores, firsts, lasts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            scores.append(best[0])
            firsts.append(parts[0])
            lasts.append(parts[-1])

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side; a is -1 at the start and after bytes.

        The merges inside a and inside b go on as if alone until a merge across their border scores best.
        """
        if len(self.pairs) > 2 * MEMO:
            self.pairs.clear()
        if (right := self.alone.get(b)) is None:
            right = self.alone[b] = self.merges(self.text[b])
        ok = len(right[0]) == 1
        if ok and a >= 0:
            if (left := self.alone.get(a)) is None:
                left = self.alone[a] = self.merges(self.text[a])
            ok = self.border_holds(left[1], left[3], right[1], right[2])
        self.pairs[(a << 32) + b] = ok
        return ok

    def border_holds(self, a: list[float], lasts: list[str], b: list[float], firsts: list[str]) -> bool:
        i = j = 0
        while True:
            across = self.id.get(lasts[i] + firsts[j])
            x = a[i] if i < len(a) else NEVER
            y = b[j] if j < len(b) else NEVER
            if across is not None and self.score[across] > x and self.score[across] >= y:
                return False
            if x == y == NEVER:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of sorted words. State j of the stack: the best score of the first j characters, and of that segmentation the
        start of the last piece and its id, or -1 for bytes."""
        scores, starts, lasts, before = [0.0], [0], [-1 << 32], ""  # pieces are kept shifted, as the keys of pairs need them
        known, suffixes, follows, own = self.pairs.get, self.suffixes, self.follows, self.score
        for word in words:
            shared = 0
            for x, y in zip(before, word):  # noqa: B905  the shorter ends it
                if x != y:
                    break
                shared += 1
            del scores[shared + 1 :], starts[shared + 1 :], lasts[shared + 1 :]
            for j in range(shared, len(word)):
                best, start, last = NEVER, j, -1 << 32
                i, at = j, suffixes
                # the pieces that end here, from short to long; a forbidden transition scores NEVER
                while i >= 0 and (node := at.get(word[i])) is not None:
                    piece, at = node
                    if piece is not None:
                        ok = known(lasts[i] + piece)
                        if follows(lasts[i] >> 32, piece) if ok is None else ok:
                            best, start, last = scores[i] + own[piece], i, piece << 32
                            break  # one transition at most is allowed, so this is the maximum
                    i -= 1
                scores.append(best if last >= 0 else scores[j] + BYTES)
                starts.append(start)
                lasts.append(last)
            ids: list[int] = []
            j = len(word)
            while j:
                i, piece = starts[j], lasts[j]
                if piece >= 0:
                    ids.append(piece >> 32)
                else:
                    ids.extend(self.byte[b] for b in reversed(word[i:j].encode()))
                j = i
            ids.reverse()
            yield word, _PACKERS[len(ids)](*ids) if len(ids) < 128 else struct.pack(f"<{len(ids)}i", *ids)
            before = word

    def cut(self, marked: str) -> list[str]:
        """Marked words of a text that no piece crosses."""
        return [x for w in _WORD.findall(marked) for x in self.cut_stop(w)]

    def cut_stop(self, word: str) -> tuple[str, ...]:
        if word[-1] in ".," and len(word) > 1 and word[-2].isalnum() and word[-2] not in self.joined:
            return word[:-1], word[-1]
        return (word,)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as packed 32-bit integers. Texts with single blanks only are looked up by blank-separated words."""
        plain = [bool(t) and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts]
        words = [t.split(" ") if p else None for t, p in zip(texts, plain, strict=True)]
        asked: set[str] = set()
        asked.update(*(ws for ws in words if ws))
        new = {w: self.cut(MARK + w) if "\n" in w else self.cut_stop(MARK + w) for w in self.memo.missing(asked)}
        odd = [None if p or not t else self.cut(MARK + t.replace(" ", MARK)) for t, p in zip(texts, plain, strict=True)]
        parts = {x for xs in new.values() for x in xs}.union(x for xs in odd if xs for x in xs)
        part = self.parts.now
        part.update(self.encode_sorted(sorted(self.parts.missing(parts))))
        self.memo.now.update((w, part[xs[0]] if len(xs) == 1 else b"".join([part[x] for x in xs])) for w, xs in new.items())
        word, part = self.memo.now.__getitem__, part.__getitem__
        return [b"".join(map(word, ws)) if ws else b"".join(map(part, xs or ())) for ws, xs in zip(words, odd, strict=True)]

    def ids(self, text: str | None) -> list[int]:
        return list(memoryview(self.encode([text])[0]).cast("i"))

    def decode(self, ids) -> str:
        own = self.bytes_of
        return b"".join([own[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, text: str = "text", out: str = "piece_ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text``."""

    def run(own: Pieces, batch: pa.RecordBatch) -> list[pa.Array]:
        return [_lists(own.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()))]

    return _mapped(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], run, model)


def decode_pieces(docs: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with the text of ``ids``; null ids read as empty."""

    def run(own: Pieces, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([own.decode(x.as_py() or []) for x in batch.column(batch.schema.get_field_index(ids))], pa.string())]

    return _mapped(docs, [T.StructField(out, T.StringType())], run, model)


def encode_and_decode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids`` and ``decoded``, the text read back from them, in one pass."""

    def run(own: Pieces, batch: pa.RecordBatch) -> list[pa.Array]:
        packed = own.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
        return [_lists(packed), pa.array([own.decode(memoryview(x).cast("i")) for x in packed], pa.string())]

    return _mapped(docs, [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], run, model)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row for each document: number of pieces, digests of the packed ids and of the decoded text, whether the text came
    back."""

    def run(own: Pieces, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(1).to_pylist()
        packed = own.encode(texts)
        decoded = [own.decode(memoryview(x).cast("i")) for x in packed]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [
            pa.array([len(x) // 4 for x in packed], pa.int64()),
            pa.array([sha(x) for x in packed]),
            pa.array([sha(x.encode()) for x in decoded]),
            pa.array([x == (t or "") for x, t in zip(decoded, texts, strict=True)]),
        ]

    added = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType())]
    return _mapped(docs.select("doc_id", "text"), added, run, model).drop("text")


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _mapped(docs: DataFrame, added: list[T.StructField], run: Callable[[Pieces, pa.RecordBatch], list[pa.Array]], model: str | None) -> DataFrame:
    small_batches(docs.sparkSession)
    path = model or default_model()
    keep = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*keep, *added])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, *run(pieces(path), batch)], names=schema.fieldNames())

    return docs.mapInArrow(batches, schema)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and the text decoded from these."""
    return encode_and_decode(docs)
