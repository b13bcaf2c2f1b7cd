"""SentencePiece encoding and decoding by batched Viterbi.

Text is cut into words that begin at a run of spaces; no piece crosses such a
cut, so the best path of a text is that of its words.  Distinct words of equal
length advance together through the lattice: hashes of all their substrings
that end at a place probe the sorted piece keys, one maximum over the lengths
gives the best score, and back pointers are kept.  Bytes that no piece covers
become byte pieces, so decoding gives back the text exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm import words
from pagewise.llm.common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bits of the filter in front of the sorted keys; lattice cells worked on at once.
FILTER_BITS, CELLS = 20, 200_000
#: Bytes of text whose distinct words are segmented once: the words of a
#: longer run repeat more often.
PIECE = 1 << 20


class Vocabulary:
    """Piece tables as arrays; small (one row a piece), shipped with the tasks.

    ``scores='model'`` takes the model's own log-probabilities (unigram
    models).  BPE models keep merge ranks instead; ``scores='zipf'`` turns
    rank r into the log-probability of Zipf's law, -log(r + 2.7) less its
    normaliser.
    """

    def __init__(self, model_file: str = MODEL, scores: str = "zipf"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if not all(sp.is_byte(int(i)) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in plain]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("a piece has a space after other characters")
        value = np.array([sp.get_score(i) for i in plain])
        if scores == "zipf":
            rank = np.argsort(np.argsort(-value, kind="stable"), kind="stable")
            value = -np.log(rank + 2.7) - np.log(np.sum(1 / (np.arange(len(rank)) + 2.7)))
        raw = [x.replace(SPACE, " ").encode() for x in names]  # inside, a space stands for the mark
        self.bytes_of = np.full(n, b"", dtype=object)
        self.bytes_of[plain] = raw
        self.bytes_of[self.byte_ids] = [bytes([b]) for b in range(256)]
        ends = np.cumsum([len(x) for x in raw])
        keys = words.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(plain, np.int32)[order], value[order]
        self.longest = max(map(len, raw))
        self.byte_score = float(value.min()) - 10.0
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.lengths = np.array([len(x) for x in self.bytes_of])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf: no piece) and ids of substring hashes."""
        score, ids = np.full(h.shape, -np.inf), np.zeros(h.shape, np.int32)
        maybe = np.nonzero(self.seen[h >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        where = tuple(x[hit] for x in maybe)
        score[where], ids[where] = self.scores[at[hit]], self.ids[at[hit]]
        return score, ids

    def segment(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best pieces of equally long words (one a row of bytes): the ids of
        all rows one after the other, and every row's number of ids."""
        n, length = w.shape
        up, down = words.powers(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((w.astype(np.uint64) + np.uint64(1)) * up[:-1], axis=1, out=sums[:, 1:])
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int16), np.zeros((n, length + 1), np.int32)
        rows = np.arange(n)
        for j in range(1, length + 1):
            i = np.arange(max(0, j - self.longest), j)
            size = (j - i).astype(np.uint64)
            score, ids = self.probe(words.mix((sums[:, j:j + 1] - sums[:, i]) * down[i] + size))
            one = score[:, -1] == -np.inf
            score[one, -1], ids[one, -1] = self.byte_score, self.byte_ids[w[one, j - 1]]
            total = best[:, i] + score
            pick = np.argmax(total, axis=1)
            best[:, j], back[:, j], piece[:, j] = total[rows, pick], j - i[pick], ids[rows, pick]
        at, columns = np.full(n, length), []
        while (alive := at > 0).any():
            columns.append(np.where(alive, piece[rows, at], -1))
            at = at - np.where(alive, back[rows, at], 0)
        ids = np.stack(columns[::-1], axis=1)
        return ids[ids >= 0], (ids >= 0).sum(axis=1)

    def encode(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece of text, and where each row's ids begin."""
        sizes = np.diff(offsets)
        begin = offsets[:-1] + np.cumsum(sizes > 0) - (sizes > 0)  # a space in front of every text
        data = np.full(len(text) + int((sizes > 0).sum()), 32, np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[begin[sizes > 0]] = False
        data[keep] = text
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begin[sizes > 0]] = True
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        stops = np.append(starts[1:], len(data))
        _, head, which = np.unique(words.span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        lengths = (stops - starts)[head]
        counts, parts, slot = np.zeros(len(head), np.int64), [], np.zeros(len(head), np.int64)
        done = 0
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
            length = int(lengths[order[a]])
            step = max(1, CELLS // (length * min(length, self.longest)))
            for c in range(a, b, step):
                some = order[c:min(b, c + step)]
                ids, n = self.segment(data[starts[head[some]][:, None] + np.arange(length)])
                slot[some] = done + np.cumsum(n) - n
                counts[some] = n
                parts.append(ids)
                done += len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        each = counts[which]
        ends = np.cumsum(each)
        ids = flat[np.repeat(slot[which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        word_of_row = np.searchsorted(starts, np.append(begin, len(data)))
        return ids.astype(np.int32), np.concatenate([[0], ends])[word_of_row]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of id sequences."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        data = self.flat[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.concatenate([[0], ends])[offsets]
        full = at[1:] > at[:-1]
        keep = np.ones(len(data), dtype=bool)
        keep[at[:-1][full]] = False  # the space in front
        return data[keep], at - np.concatenate([[0], np.cumsum(full)])


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (replaced if there).  Null and empty
    texts have no ids."""
    vocabulary = vocabulary or Vocabulary()
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns(
        {"n_tokens": F.lit(0).cast("long"), "ids": F.array().cast("array<int>")}).schema

    def encode(batches):
        for batch in batches:
            for row, text, offsets in words.pieces(batch.column("text"), PIECE):
                ids, at = vocabulary.encode(text, offsets)
                own = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in kept), pa.array(np.diff(at), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=[*kept, "n_tokens", "ids"])

    return bounded_batches(docs).select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(encode, schema)


def decode_documents(coded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Every column but ids of ``coded``, with ``decoded``, the text of ids
    (null ids: empty)."""
    vocabulary = vocabulary or Vocabulary()
    kept = [c for c in coded.columns if c not in ("decoded", "ids")]
    schema = coded.select(*[F.col(f"`{c}`") for c in kept]).withColumn("decoded", F.lit("")).schema

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = batch.slice(at, 1000)
                lists = own.column("ids")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                data, offsets = vocabulary.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
                texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), texts.cast(pa.string())], names=[*kept, "decoded"])

    return coded.select(*[F.col(f"`{c}`") for c in kept], "ids").mapInArrow(decode, schema)


def round_trips(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, the decoded text's SHA-256 and whether it equals
    the text (null: empty).  Encodes and decodes in one pass over the rows."""
    vocabulary = vocabulary or Vocabulary()

    def work(batches):
        for batch in batches:
            for row, text, offsets in words.pieces(batch.column("text"), PIECE):
                ids, at = vocabulary.encode(text, offsets)
                data, ends = vocabulary.decode(ids, at)
                back = [data[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = [x == text[a:b].tobytes() for x, a, b in zip(back, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(same)), pa.array(np.diff(at), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                     pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "exact"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")
