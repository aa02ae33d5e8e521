"""Encoding a corpus with a public byte-level BPE, by dynamic programming over byte prefixes.

For each byte prefix of a piece of text exactly one token can stand last in a valid encoding. That token is stored per
prefix: reading it backwards from the end gives the ids, text appended goes on from the stored prefixes, and after an
edit only what follows the first changed byte of a piece is computed again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebed.session import Scratch

#: bytes a vocabulary file may have to be sent to the executors; public ones have 1 to 2 MB
VOCABULARY_BOUND = 16 * 1024 * 1024
#: entries of a worker's memory of pieces and of token pairs; it is emptied when full, results don't depend on it
MEMORY = 200_000
#: fixed value: the splitting pattern of the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PrefixEncoder:
    """Last tokens of byte prefixes under one vocabulary of ranked byte strings (id = rank)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.size = {i: len(b) for b, i in self.ranks.items()}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.longest = max(self.size.values(), default=1)
        self.pattern = regex.compile(pattern)
        self.suffixes = ahocorasick.Automaton()
        for b, i in self.ranks.items():
            self.suffixes.add_word(b.decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def merged(self, text: bytes) -> list[int]:
        """The ids of a short byte string by merging its lowest-ranked pair until none is left: the definition."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, last: int) -> bool:
        """Whether ``last`` can follow ``before``: alone, the two must encode to themselves. before -1: at the start."""
        key = (before, last)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            want = [last] if before < 0 else [before, last]
            ok = self.pairs[key] = self.merged(b"".join(self.bytes[i] for i in want)) == want
        return ok

    def prefixes(self, piece: bytes, stored: list[int] = ()) -> list[int]:
        """The last token of each byte prefix; ``stored`` holds those of a prefix of the piece, known already."""
        lasts = [-1, *stored]
        start = len(stored)
        lasts += [-1] * (len(piece) - start)
        # a token that ends behind the stored part can begin at most its own length before it
        skip = max(0, start - self.longest)
        done = start
        for end, token in self.suffixes.iter(piece[skip:].decode("latin-1")):
            i = skip + end + 1
            if i <= done:
                continue
            at = i - self.size[token]
            if self.fits(lasts[at] if at else -1, token) and (not at or lasts[at] >= 0):
                lasts[i] = token
                done = i
        return lasts[1:]

    def ids_of(self, lasts: list[int]) -> list[int]:
        """The ids of the whole piece, read backwards from its last prefix."""
        out, i = [], len(lasts)
        while i:
            token = lasts[i - 1]
            out.append(token)
            i -= self.size[token]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text or ""):
            known = self.known.get(piece)
            if known is None:
                known = self.ids_of(self.prefixes(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(self.known) >= MEMORY:
                        self.known.clear()
                    self.known[piece] = known
            ids += known
        return ids

    def table(self, text: str | None) -> list[int]:
        """The prefix tokens of a text, piece after piece: one for each byte."""
        return [t for piece in self.pattern.findall(text or "") for t in self.prefixes(piece.encode("utf-8", "surrogatepass"))]

    def updated(self, old: str | None, table: list[int], new: str | None) -> tuple[list[int], list[int]]:
        """(prefix tokens, ids) of ``new``, from those of ``old``; only bytes from the first change of a piece on are computed.

        Splitting is cheap and done anew, so pieces that an append joins or parts differently come out right; equal
        pieces at either end keep their prefixes, and the first changed piece keeps those of its common bytes.
        """
        a = [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(old or "")]
        b = [p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(new or "")]
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = next((i for i, (x, y) in enumerate(zip(a[head:][::-1], b[head:][::-1])) if x != y), min(len(a), len(b)) - head)
        cut = sum(map(len, a[:head]))
        out = list(table[:cut])
        for n, piece in enumerate(b[head : len(b) - tail]):
            common = 0
            if n == 0 and head < len(a):
                first = a[head]
                common = next((i for i, (x, y) in enumerate(zip(first, piece)) if x != y), min(len(first), len(piece)))
            out += self.prefixes(piece, list(table[cut : cut + common]))
        kept = sum(map(len, a[len(a) - tail :])) if tail else 0
        out += list(table[len(table) - kept :]) if kept else []
        ids, at = [], 0
        for piece in b:
            ids += self.ids_of(out[at : at + len(piece)])
            at += len(piece)
        return out, ids


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary, pattern)


def _shared_vocabulary(df: DataFrame, path: str | None):
    """The vocabulary's bytes as a broadcast value: its size is fixed and checked, executors need no file."""
    with open(path or default_vocabulary(), "rb") as f:
        data = f.read(VOCABULARY_BOUND + 1)
    if len(data) > VOCABULARY_BOUND:
        raise ValueError(f"the vocabulary has over {VOCABULARY_BOUND} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, type=pa.list_(pa.int32()))


#: rows encoded at a time inside a batch, so that a batch of long texts stays small in memory
SLICE = 512


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_prefixes: bool = False) -> DataFrame:
    """id and ids (ARRAY<INT>) of each row; an empty list for an empty or null text.

    Special tokens' strings are ordinary text. Every row is encoded whole, whatever its length; repeated rows give
    repeated results. With ``with_prefixes`` also prefix_tokens, one id for each byte, for later updates.
    """
    shared = _shared_vocabulary(docs, vocabulary)
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, PATTERN)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column(1).to_pylist()
                columns, names = [batch.column(0), _lists([encoder.encode(t) for t in texts])], [id_col, "ids"]
                if with_prefixes:
                    columns.append(_lists([encoder.table(t) for t in texts]))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {id_type}, ids array<int>" + ", prefix_tokens array<int>" * with_prefixes
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(encode, schema)


def update_texts(stored: DataFrame, changed: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """id, ids, prefix_tokens of texts that were appended to or edited.

    ``stored`` has id, text and prefix_tokens of earlier texts, ``changed`` id and the new text; ids that aren't
    stored are encoded from nothing. Equal to encoding the new texts anew.
    """
    shared = _shared_vocabulary(stored, vocabulary)
    id_type = changed.schema[id_col].dataType.simpleString()

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, PATTERN)
        for batch in batches:
            olds, tables, news = (batch.column(i).to_pylist() for i in (1, 2, 3))
            both = [encoder.updated(o, t or [], n) for o, t, n in zip(olds, tables, news)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([b[1] for b in both]), _lists([b[0] for b in both])], names=[id_col, "ids", "prefix_tokens"])

    old = stored.select(id_col, F.col("text").alias("old_text"), "prefix_tokens")
    joined = changed.select(id_col, F.col("text").alias("new_text")).join(old, id_col, "left")
    return joined.select(id_col, "old_text", "prefix_tokens", "new_text").mapInArrow(update, f"`{id_col}` {id_type}, ids array<int>, prefix_tokens array<int>")


def appended_ids(docs: DataFrame, scratch: Scratch, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of each text with its repository's name appended on a line of its own, gone on with from the text's stored prefixes.

    A null text or name counts as empty; repeated rows count once.
    """
    once = docs.select("doc_id", "text", "repo").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "repo")).alias("v")).select("doc_id", "v.text", "v.repo")
    once = scratch.keep(once, "texts")
    stored = scratch.keep(encode_texts(once, vocabulary=vocabulary, with_prefixes=True).drop("ids"), "prefixes").join(once.select("doc_id", "text"), "doc_id")
    changed = once.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("repo", F.lit(""))).alias("text"))
    return update_texts(stored, changed, vocabulary=vocabulary).select("doc_id", "ids")
