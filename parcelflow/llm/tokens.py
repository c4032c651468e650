"""Token ids: encoding, and a file format of bit planes with a chunk index."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, scratch, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids in a block that is transposed at once, and ids after which a chunk ends at the next document.
BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
#: Words whose ids a task keeps (some 200 MB at most); later ones are encoded again.
MOST_WORDS = 800_000
MODES = ("byte", "bit")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The character that byte-level BPE shows for each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Encoder:
    """Encodes whole texts with the ``tokenizers`` library and remembers the ids of words.

    Byte-level BPE splits a text before a single space, and around a single
    line break, that stands between two other characters, and before a mark
    that follows a letter and ends such a word. So a word with the space
    before it always gets the same ids. Texts with other white space next to
    these, with the strings of special tokens, or with another kind of
    vocabulary are encoded as a whole.
    """

    _CUT = "\x00"
    _MARKS = frozenset(",.;:!?")

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_words = most_words
        #: Ids of a word, None if a text with it has to be encoded whole. The frequent words come early and stay.
        self.words: dict[str, bytes | None] = {}
        kind, self.model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.by_word = self.tokenizer.normalizer is None and type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex
        self.chars = _byte_chars()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _ids(self, word: str) -> bytes:
        """Of a word that no split goes through if it is all letters: the model alone makes its ids."""
        if word.removeprefix(" ").isalpha():
            shown = word.encode().decode("latin-1").translate(self.chars)
            return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return self._whole([word])[0]

    def _learn(self, words: list[str]) -> dict[str, bytes | None]:
        known, got = self.words, {}
        for word in words:
            body = word.removeprefix(" ")
            if word == "\n":
                got[word] = self._whole([word])[0]
            elif not body or body != body.strip():
                got[word] = None
            elif body[-1] in self._MARKS and body[-2:-1].isalpha():
                stem, mark = word[:-1], body[-1]
                for x in (stem, mark):
                    if x not in got:
                        got[x] = known.get(x) or self._ids(x)
                got[word] = got[stem] + got[mark]
            elif word not in got:
                got[word] = self._ids(word)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = self._CUT
        parts = [text.replace(" ", cut + " ").replace("\n", f"{cut}\n{cut}").split(cut) if self.by_word and cut not in text and not any(s in text for s in self.special) else None for text in texts]
        known, here = self.words, set().union(*(p for p in parts if p))
        got = self._learn(list(here.difference(known)))
        if len(known) + len(got) <= self.most_words:
            known.update(got)
        else:
            known = {x: got[x] if x in got else known[x] for x in here}
        out = []
        for text, p in zip(texts, parts, strict=True):
            ids = [known[x] for x in p] if p else [None]
            out.append(self._whole([text])[0] if None in ids else b"".join(ids))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, at_once: int = 128) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of the rows of (doc_id, text) batches, in their order; null is an empty text."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    enc = encoder(path)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, at_once):
            some = [x or "" for x in texts.slice(at, at_once).to_pylist()]
            for doc, got in zip(ids.slice(at, at_once).to_pylist(), enc.encode(some), strict=True):
                yield doc, got + end


def planes_of(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """The block's planes: 4 of bytes or 32 of bits, the lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if mode == "byte":
        return [np.ascontiguousarray(x).tobytes() for x in octets]
    bits = [(octet >> k) & 1 for octet in octets for k in range(8)]
    return [np.packbits(b, bitorder="little").tobytes() for b in bits]


def ids_of(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    if mode == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    out = np.zeros(n, dtype="<u4")
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return out


def pack_chunk(ids: np.ndarray, block_ids: int = BLOCK_IDS, mode: str = "byte", level: int = 3) -> tuple[bytes, list[int], list[int]]:
    """Payload, ids of each block, and compressed bytes of each plane of each block."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    frames, counts = [], []
    for at in range(0, len(ids), block_ids):
        block = ids[at : at + block_ids]
        counts.append(len(block))
        frames += [press.compress(p) for p in planes_of(block, mode)]
    return b"".join(frames), counts, [len(f) for f in frames]


def unpack_chunk(payload: bytes, counts: list[int], sizes: list[int], mode: str = "byte") -> np.ndarray:
    import zstandard

    unpress, at, out = zstandard.ZstdDecompressor(), 0, []
    each = len(sizes) // len(counts) if counts else 0
    for b, n in enumerate(counts):
        planes = []
        for size in sizes[b * each : (b + 1) * each]:
            planes.append(unpress.decompress(payload[at : at + size]))
            at += size
        out.append(ids_of(planes, n, mode))
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


#: One row a chunk: its shard and number there, ids of the shard before it, the documents in it, and its blocks.
CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids long, mode string, doc_ids array<long>, doc_ids_n array<long>, block_ids array<int>, plane_bytes array<int>, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("mode", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("doc_ids_n", pa.list_(pa.int64())), ("block_ids", pa.list_(pa.int32())), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, mode: str = "byte", chunk_ids: int = CHUNK_IDS, block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Writes the ids of all rows to ``path`` in ascending order of ``id_col``.

    A shard is a range of ids; it is a Parquet file whose rows are chunks.
    A chunk holds whole documents, at least ``chunk_ids`` ids but for the
    last of a shard: the ids in blocks of ``block_ids``, each transposed into
    byte or bit planes (``mode``) that are compressed one by one with
    zstandard, and the index of its blocks and documents. Null ids come
    first; repeated rows follow each other, by text; a null text is empty.
    An empty table gives an empty folder of chunks. Memory is bounded by a
    chunk and the longest document.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        first, chunk, held, docs_in = 0, 0, [], []

        def full() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            payload, counts, sizes = pack_chunk(ids, block_ids, mode)
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "mode": mode, "doc_ids": [d for d, _ in docs_in], "doc_ids_n": [n for _, n in docs_in], "block_ids": counts, "plane_bytes": sizes, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        size = 0
        for doc, ids in encoded(batches, vocabulary):
            held.append(ids)
            docs_in.append((doc, len(ids) // 4))
            size += len(ids) // 4
            if size >= chunk_ids:
                yield full()
                first, chunk, size, held, docs_in = first + size, chunk + 1, 0, [], []
        if docs_in:
            yield full()

    ordered.mapInArrow(pack, CHUNK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, columns: str = "doc_id long, start long, n_tokens long, ids array<long>", row=None) -> DataFrame:
    """One row a document of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens and its ids.

    ``row`` makes other ``columns`` from (doc_id, start, ids). Shards get
    their first places from their sums, one row a shard.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    first, bases = 0, []
    for r in totals:
        bases.append((r["shard"], first))
        first += r["n"]
    row = row or (lambda doc, start, ids: (doc, start, len(ids), ids.tolist()))
    names = [c.split()[0] for c in columns.split(",") if " " in c.strip()] if "<" not in columns else ["doc_id", "start", "n_tokens", "ids"]
    base_of = spark.sparkContext.broadcast(dict(bases))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                ids = unpack_chunk(c["payload"], c["block_ids"], c["plane_bytes"], c["mode"])
                at, start, out = 0, base_of.value[c["shard"]] + c["first"], []
                for doc, n in zip(c["doc_ids"], c["doc_ids_n"], strict=True):
                    out.append(row(doc, start + at, ids[at : at + n]))
                    at += n
                yield pa.RecordBatch.from_pydict({k: list(v) for k, v in zip(names, zip(*out, strict=True), strict=True)})

    return chunks.select("shard", "first", "mode", "doc_ids", "doc_ids_n", "block_ids", "plane_bytes", "payload").mapInArrow(unpack, columns)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    digest = lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.tobytes()))
    return read_ids(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


QUERIES = {"op7_token_ids": op7_token_ids}
SQL: dict[str, str] = {}
