"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text where its content says so, so that documents sharing a
passage share its chunks. Documents are dealt by range of their smallest chunk hash (sampled splitters;
a hash of the document breaks ties, so a group of copies of any size spreads over several tasks), which
brings copies and near copies together; a task then encodes and decodes each distinct chunk once.

Chunks are cut anywhere, so their ends need repair. A position between a visible ASCII character and a
following space always ends a pre-token, whatever is before or behind it; no merge crosses it, and the
pre-token pattern looks back at nothing. Between the first and the last such position of a chunk its
own ids therefore agree exactly with those of the whole text. What lies outside them is joined with the
next chunk's and re-encoded, growing over further chunks until both ends stand on such positions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.llm.byte_bpe import END, END_ID, ids_of, token_bytes
from audience_lens.llm.common import arrow_map, record, small, table, texts

CHUNK_BITS = 9  # a cut every 512 bytes on average
MEMO_BYTES = 48 << 20  # text whose chunks a task remembers
SYNC = re.compile(rb"[!-~](?= )")
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where a hash of the last 32 bytes has its top bits 0, between characters."""
    raw = np.frombuffer(data, np.uint8)
    h, width, base = _GEAR[raw], 1, 0x9E3779B1
    while width < 32 and width < len(h):
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint32(base)
        h, width, base = wider, width * 2, base * base & 0xFFFFFFFF
    inside = np.flatnonzero((h[:-1] >> np.uint32(32 - CHUNK_BITS) == 0) & (raw[1:] & 0xC0 != 0x80)) + 1
    return [*inside.tolist(), len(data)]


def chunks(data: bytes) -> list[bytes]:
    if not data:
        return []
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Coder:
    """Encodes and decodes texts; chunks seen before are not encoded again."""

    def __init__(self) -> None:
        self.memo: dict[bytes, tuple[bytes, bytes, bytes, bytes]] = {}
        self.held = self.hits = 0

    def _run(self, data: bytes) -> tuple[bytes, bytes]:
        """Ids (little-endian) and decoded bytes of a piece of text."""
        ids = ids_of(data.decode())
        known = token_bytes()
        return ids.astype("<u4").tobytes(), b"".join([known[i] for i in ids.tolist()])

    def _chunk(self, data: bytes) -> tuple[bytes, bytes, bytes, bytes]:
        """What comes before the first sure position, ids and decoded bytes up to the last, the rest."""
        if (found := self.memo.get(data)) is not None:
            self.hits += 1
            return found
        sure = [m.end() for m in SYNC.finditer(data)]
        if sure:
            found = (data[:sure[0]], *self._run(data[sure[0]:sure[-1]]), data[sure[-1]:])
        else:
            found = (data, b"", b"", b"")
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        self.memo[data] = found
        self.held += 8 * len(data)
        return found

    def segment(self, data: bytes) -> tuple[list[bytes], list[bytes]]:
        ids, back, loose = [], [], b""
        for chunk in chunks(data):
            head, body, decoded, tail = self._chunk(chunk)
            loose += head
            if len(head) == len(chunk) and not SYNC.search(chunk):
                continue  # no sure position: the join grows over the next chunk
            if loose:
                for out, part in zip((ids, back), self._run(loose)):
                    out.append(part)
            ids.append(body)
            back.append(decoded)
            loose = tail
        if loose:
            for out, part in zip((ids, back), self._run(loose)):
                out.append(part)
        return ids, back

    def text(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes that decoding them gives."""
        ids, back = [], []
        for k, own in enumerate(text.split(END)):
            if k:
                ids.append(END_ID.to_bytes(4, "little"))
                back.append(token_bytes()[END_ID])
            more, again = self.segment(own.encode())
            ids += more
            back += again
        return b"".join(ids), b"".join(back)


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        route = [min((xxhash.xxh3_64_intdigest(c) >> 1 for c in chunks(t.encode())), default=0) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(route, pa.int64())],
                                         ["doc_id", "text", "route"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])
    for batch in small(batches):
        n, ids_sha, back_sha = [], [], []
        for text in texts(batch):
            ids, back = coder.text(text)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            back_sha.append(hashlib.sha256(back.decode(errors="replace").encode()).hexdigest())
        yield record(schema, [batch.column("doc_id"), n, ids_sha, back_sha])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    for batch in small(batches):
        both = [coder.text(t) for t in texts(batch)]
        yield record(schema, [batch.column("doc_id"), [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in both],
                              [b.decode(errors="replace") for _, b in both]])


def _routed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    routed = arrow_map(narrow, _routes, "doc_id long, text string, route long")
    return routed.repartitionByRange("route", F.xxhash64("doc_id")).sortWithinPartitions("route")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row. Null text counts as empty (no ids, empty text), a null id
    stays null, repeated rows are kept, other columns are ignored, an empty table gives no rows."""
    return arrow_map(_routed(docs, id_col, text_col), _ids, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encode_documents``, with counts and digests made in the task instead of ids and texts."""
    return arrow_map(_routed(docs, id_col, text_col), _digests,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
