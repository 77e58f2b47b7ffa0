"""SentencePiece encoding and decoding with forward values shared along a trie.

Texts are cut into marked words: a run of spaces, each written as the mark, and what follows up to
the next space. No piece reaches beyond such a word, so each distinct word is segmented once. The
distinct words of a chunk are sorted, which lists the leaves of their trie depth-first; going from
one word to the next keeps the forward values of their common prefix and computes the others.

The forward value of a prefix is the last piece of its segmentation and where that piece begins:

- unigram models: the piece that ends the best-scored segmentation (Viterbi);
- BPE models: the one piece P for which the segmentation of what precedes P, followed by P, is what
  merging gives. A row of pieces is what merging gives if and only if that holds for each pair of
  neighbours, so the last two pieces decide it.

A character that no piece covers is written as its bytes' pieces, or as the unknown piece if the model
has none. Null texts encode as no ids and decode as empty. Every text that does not itself contain the
mark comes back as it was if the model has byte pieces and no normaliser; the mark comes back as a space.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import chunks, freed

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a worker keeps from chunk to chunk: two generations of this many.
KEPT_WORDS = 300_000
#: Pairs of pieces whose standing side by side is remembered; then all are found anew.
KEPT_PAIRS = 1_000_000
UNKNOWN_PENALTY = 10.0


@dataclass
class Model:
    """Pieces by text with id and score; byte_ids: 256 ids or none; texts: bytes by id, for decoding."""

    kind: str
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: int
    texts: list[bytes]
    dummy_prefix: bool = True
    least: float = 0.0
    pairs: dict = field(default_factory=dict)
    ending: dict = field(default_factory=dict)

    def __post_init__(self):
        """ending: a trie of the pieces read backwards; the empty key holds the piece."""
        self.least = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        for p in self.ids:
            if self.kind != "bpe" or len(p) == 1 or merged(self, list(p)) == [p]:  # others never come out
                node = self.ending
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p


def load(path: str = MODEL, kind: str = "bpe", dummy_prefix: bool = True) -> Model:
    """Read a model file; kind ("bpe" or "unigram") and dummy_prefix say how it was made."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids, texts = {}, {}, [-1] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            texts.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i):
            texts.append(b"")
        elif sp.is_unknown(i):
            texts.append(" ⁇ ".encode())
        else:
            ids[p], scores[p] = i, sp.get_score(i)
            texts.append(p.replace(MARK, " ").encode())
    return Model(kind, ids, scores, [] if -1 in byte_ids else byte_ids, sp.unk_id(), texts, dummy_prefix)


def merged(m: Model, symbols: list[str]) -> list[str]:
    """BPE by its definition: merge the neighbours that make the best-scored piece, leftmost first."""
    symbols = list(symbols)
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = m.scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]


def follow(m: Model, left: str, right: str) -> bool:
    """Whether merging the characters of both leaves the two pieces side by side."""
    if (known := m.pairs.get((left, right))) is None:
        if len(m.pairs) > KEPT_PAIRS:
            m.pairs.clear()
        known = m.pairs[left, right] = merged(m, list(left + right)) == [left, right]
    return known


def ending_at(m: Model, word: str, i: int) -> list[str]:
    """The pieces that word[:i] ends with, shortest first."""
    node, out = m.ending, []
    for a in range(i - 1, -1, -1):
        node = node.get(word[a])
        if node is None:
            break
        if "" in node:
            out.append(node[""])
    return out


def last_piece(m: Model, word: str, i: int, last: list[str], best: list[float]) -> tuple[str, float]:
    """The forward value of word[:i], from those of its shorter prefixes."""
    found = ending_at(m, word, i)
    if m.kind == "bpe":
        for p in reversed(found):
            a = i - len(p)
            if a == 0 or m.pairs.get((last[a], p)) or follow(m, last[a], p):
                return p, 0.0
        return word[i - 1], 0.0
    score, piece = best[i - 1] + m.least, word[i - 1]
    for p in found:
        if best[i - len(p)] + m.scores[p] > score:
            score, piece = best[i - len(p)] + m.scores[p], p
    return piece, score


def segmented(m: Model, words: Iterable[str]):
    """(word, pieces) of sorted distinct words; forward values of common prefixes are used again."""
    before, last, best = "", [""], [0.0]
    for w in words:
        same, most = 0, min(len(before), len(w))
        while same < most and before[same] == w[same]:
            same += 1
        del last[same + 1 :], best[same + 1 :]
        for i in range(same + 1, len(w) + 1):
            piece, score = last_piece(m, w, i, last, best)
            last.append(piece)
            best.append(score)
        out, i = [], len(w)
        while i:
            out.append(last[i])
            i -= len(last[i])
        yield w, out[::-1]
        before = w


def ids_of(m: Model, pieces: list[str]) -> bytes:
    out = []
    for p in pieces:
        if p in m.ids:
            out.append(m.ids[p])
        else:
            out += [m.byte_ids[b] for b in p.encode()] if m.byte_ids else [m.unknown]
    return np.array(out, "<i4").tobytes()


class Encoder:
    """Encodes chunks of texts; keeps the ids of recent words."""

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        m = self.model
        marked = [(MARK if m.dummy_prefix and t else "") + t.replace(" ", MARK) for t in texts]
        cut = [WORD.findall(t) for t in marked]
        distinct = set().union(*cut)
        known = {}
        missing = []
        for w in distinct:
            got = self.new.get(w)
            if got is None and (got := self.old.get(w)) is not None:
                self.new[w] = got
            if got is None:
                missing.append(w)
            else:
                known[w] = got
        for w, pieces in segmented(m, sorted(missing)):
            known[w] = self.new[w] = ids_of(m, pieces)
            if len(self.new) > KEPT_WORDS:
                self.new, self.old = {}, self.new
        return [b"".join(map(known.__getitem__, c)) for c in cut]


def decoded(m: Model, ids: np.ndarray) -> bytes:
    out = b"".join(map(m.texts.__getitem__, ids.tolist()))
    return out[1:] if m.dummy_prefix and out[:1] == b" " else out


def texts_in(column: pa.Array):
    """Runs of texts of a few MB each."""
    for row, _, offs in chunks(column):
        yield row, ["" if t is None else t for t in column.slice(row, len(offs) - 1).to_pylist()]


def encoded(docs: DataFrame, model: Model, ids: bool = True, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, round_trip; if asked ids and decoded."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * ids + ["decoded"] * decode
    schema += ", ids array<int>" * ids + ", decoded string" * decode

    def run(batches):
        enc = Encoder(shared.value)
        for b in batches:
            freed()
            for row, texts in texts_in(b.column("text")):
                found = enc.encode(texts)
                each = [np.frombuffer(x, "<i4") for x in found]
                back = [decoded(shared.value, x) for x in each]
                size = np.array([len(x) for x in each])
                cols = [
                    b.column("doc_id").slice(row, len(texts)),
                    pa.array(size, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([x == t.encode() for x, t in zip(back, texts, strict=True)]),
                ]
                if ids:
                    first = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                    cols.append(pa.ListArray.from_arrays(first, pa.array(np.frombuffer(b"".join(found), "<i4"))))
                if decode:
                    cols.append(pa.array([x.decode(errors="replace") for x in back], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
