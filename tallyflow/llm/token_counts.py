"""Token counts of a sentencepiece BPE model without encoding whole texts: most words are one token, as is proved once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import text_chunks

SPACE = "▁"
#: A text with more tokens is over the limit.
LIMIT = 4096
#: Counts of words that need merges are remembered for so many words of at most so many characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


class WordCounter:
    """Counts the tokens of words, a word being a run of spaces and what follows up to the next space.

    That words can be counted alone is proved of the vocabulary: the model puts a space before a text and leaves all else as it
    is, no piece has a space after another character, and no piece is matched before the merges. So no merge joins two words.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        own = {p.piece for p in proto.pieces if p.type == 4}
        inner = [p.piece for p in proto.pieces if p.type == 1 and SPACE in p.piece.lstrip(SPACE)]
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if own or inner or not plain or proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{model_file}: words can't be counted alone with this model")
        candidates = [p.piece[1:] for p in proto.pieces if p.type == 1 and p.piece[0] == SPACE and len(p.piece) > 1 and p.piece[1] != SPACE]
        #: The words that encode alone as one token.
        self.single = {w for w, ids in zip(candidates, self.model.encode(candidates), strict=True) if len(ids) == 1}
        self.known: dict[str, int] = {}

    def word(self, word: str, spaces: int = 1) -> int:
        """Tokens of so many spaces followed by word, which has no space."""
        if spaces == 1 and word in self.single:
            return 1
        key = word if spaces == 1 else " " * (spaces - 1) + word
        if (n := self.known.get(key)) is None:
            n = len(self.model.encode(key)) if key else 1  # the model adds the first space; of a space alone it makes one token
            if len(key) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[key] = n
        return n

    def text(self, text: str) -> int:
        """Tokens of any text."""
        if not text:
            return 0
        total, spaces = 0, 0
        for w in text.replace(SPACE, " ").split(" "):
            spaces += 1
            if w:
                total += self.word(w, spaces)
                spaces = 0
        return total + (self.word("", spaces) if spaces else 0)


@functools.lru_cache(2)
def load(model_file: str) -> WordCounter:
    """One for each process: later tasks of a Python worker find it made."""
    return WordCounter(model_file)


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens. No token is added at the ends; strings such as "<s>" are ordinary text.
    Each text is counted by itself, so nulls, repeated rows and empty tables need no rule of their own.
    """
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_file)
        for batch in text_chunks(batches, "text", 4 << 20):
            texts = pc.fill_null(batch.column("text"), "")
            odd = pc.or_(pc.match_substring_regex(texts, f"  |{SPACE}|^ | $"), pc.equal(texts, ""))
            easy = pc.filter(texts, pc.invert(odd))
            counts = np.zeros(len(texts), np.int64)
            if len(easy):
                split = pc.split_pattern(easy, " ")
                coded = split.flatten().dictionary_encode()
                each = np.array([counter.word(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                sizes = pc.list_value_length(split).to_numpy()
                counts[~odd.to_numpy(zero_copy_only=False)] = np.add.reduceat(each, np.r_[0, np.cumsum(sizes)[:-1]])
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                counts[i] = counter.text(texts[i].as_py())
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
