"""Token counts as a sentencepiece BPE model gives them, with a shortcut for words that are one token.

A BPE merge joins two neighbouring pieces into a piece of the vocabulary. If no piece has a character other than the
space mark in front of a space mark, no merge crosses from one word into the next mark, so the words (each with the
marks in front of it) can be counted alone. This is
read off the vocabulary when the model is loaded; a model of another make has its texts encoded whole. For each piece that is a word, the model is asked once whether it
encodes alone as one token; such words are counted by lookup, and only the others are merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS = 400_000
RUNS = re.compile(" +[^ ]*")


class WordCounter:
    """Counts the tokens of texts; ``model`` is the file's content."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        other = (self.encoder.is_control, self.encoder.is_unknown, self.encoder.is_byte)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.get_piece_size()) if not any(f(i) for f in other)]
        #: The normaliser must leave all but the space as it is.
        plain = self.encoder.normalize("a\u3000\uff42 \t\n  c") == MARK + "a\u3000\uff42 \t\n  c".replace(" ", MARK)
        self.apart = plain and all(MARK not in p.lstrip(MARK) for p in pieces)
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
        #: The words that alone are one token; the lone mark of a trailing space is one token too.
        self.single = {w: 1 for w, ids in zip(words, self.encoder.encode(words), strict=True) if len(ids) == 1} | {"": 1}
        self.known = dict(self.single)

    def _learn(self, words: set[str]) -> None:
        """Merge the words that are not known yet; what is kept is bounded."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = dict(self.single)
        todo = [w for w in words if w not in self.known]
        self.known.update(zip(todo, map(len, self.encoder.encode(todo)), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        """The tokens of each text; a null counts as empty, which has none."""
        if not self.apart:
            return [len(x) for x in self.encoder.encode([t or "" for t in texts])]
        return [self._count(t.replace(MARK, " ")) if t else 0 for t in texts]

    def _count(self, text: str) -> int:
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in RUNS.findall(" " + text)]
        else:
            words = text.split(" ")
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            return sum(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(model: bytes) -> WordCounter:
    return WordCounter(model)


def count_tokens(df: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``model`` is the content of a sentencepiece file, half a megabyte, and travels with the tasks. A null text counts
    as empty: no bytes and no tokens. Rows are independent, so repeated ids and rows each get their own count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            n = counter.counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.octet_length(words).cast("long").alias("n_bytes"), words.alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
