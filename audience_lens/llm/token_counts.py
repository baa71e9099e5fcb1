"""Token counts with the whole-token shortcut.

A piece vocabulary whose strings never hold a space mark behind another character splits every text
into pre-tokens (a run of spaces with the word behind it, or a line feed) that no merge crosses, so a
text's count is the sum over its pre-tokens. ``whole_pieces`` proves, once per model and without any
text, which vocabulary strings encode alone as one token; pre-tokens among them count 1 by look-up and
only the rest is merged, each distinct string once per bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.common import arrow_map, record, small, table, texts

MARK = "▁"  # the model's own sign for a space
PRE_TOKEN = re.compile(" *[^ \n]+| +")
MEMO = 400_000  # strings a worker remembers before it starts anew
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@lru_cache(2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _merged(model: sentencepiece.SentencePieceProcessor, strings: list[str]) -> list[int]:
    """Tokens of each pre-token. The model puts a space mark before what it is given: a leading space
    stands for that mark; other strings are read behind a line feed, whose two tokens are taken off."""
    asked = [s[1:] if s[0] == " " else "\n" + s for s in strings]
    return [len(ids) if s[0] == " " and s != " " else 1 if s == " " else len(ids) - 2
            for s, ids in zip(strings, model.encode(asked, num_threads=1))]


@lru_cache(2)
def whole_pieces(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as exactly one token; raises for a vocabulary to which the
    split into pre-tokens doesn't apply."""
    model = _model(path)
    strings = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")
        strings.append(piece.replace(MARK, " "))
    if len(model.encode("\na")) != 3:
        raise ValueError("a line feed must be a token of its own")
    return frozenset(s for s, n in zip(strings, _merged(model, strings)) if n == 1)


def count_texts(batch: list[str], path: str, memo: dict[str, int]) -> list[int]:
    """Token counts of texts; ``memo`` keeps counts of strings between calls."""
    whole, split = whole_pieces(path), []
    for text in batch:
        split.append(PRE_TOKEN.findall(" " + text.replace(MARK, " ")) if text else [])
    if len(memo) > MEMO:
        memo.clear()
    new = [*set().union(*split).difference(memo)]
    memo.update((s, 1) for s in new if s in whole)
    rest = [s for s in new if s not in whole]
    if rest:
        memo.update(zip(rest, _merged(_model(path), rest)))
    return [sum(map(memo.__getitem__, words)) + text.count("\n") for text, words in zip(batch, split)]


def token_counts(docs: DataFrame, path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, UTF-8 bytes, tokens, and whether they are over ``limit``.

    Null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows are counted
    each; other columns are ignored; an empty table gives an empty result.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                            ("over_limit", pa.bool_())])
        for batch in small(batches):
            text = texts(batch)
            n = count_texts(text, path, memo)
            yield record(schema, [batch.column("doc_id"), [len(t.encode()) for t in text], n,
                                  [x > limit for x in n]])

    whole_pieces(path)  # a vocabulary that doesn't fit fails here, before any job
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     task, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
