"""Token-id output: byte or bit planes of fixed-size id blocks, each compressed with zstandard, with a chunk index.

A data set is a Parquet table in which each row is a chunk: whole documents in ascending doc_id order, together some
CHUNK_IDS ids. `payload` holds the chunk's blocks one after the other; a block is BLOCK_IDS ids (the last may be
shorter) as little-endian uint32, transposed into planes (plane k of byte planes: byte k of every id; plane k of bit
planes: bit k of every id, packed), each compressed by itself. The index columns say where everything is: shard and
chunk (the order of chunks), shard_start (ids of the shard before the chunk), n_ids, doc_ids, doc_tokens,
plane_bytes (compressed sizes, block by block, plane by plane). Parquet reads the index without the payload.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.llm.grouping import slices
from feedlake.llm.scratch import new_path, table

#: Ids of a block; ids at which a chunk is closed; zstandard level; words whose ids a worker keeps.
BLOCK_IDS, CHUNK_IDS, LEVEL, KEPT_WORDS = 16_384, 262_144, 3, 1_200_000
#: The id after each document.
END_ID = 1
SCHEMA = "shard int, chunk int, shard_start long, n_ids long, doc_ids array<long>, doc_tokens array<int>, plane_bytes array<int>, payload binary"


#: Marks that can end a piece and begin no contraction or special token: the tokenizer splits before them.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Words that are encoded in one call.
TOGETHER = 256
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


class WordIds(dict):
    """A piece of text without blanks to its token ids, as little-endian uint32 bytes.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its pieces, and
    those of a piece of letters and marks are the letters' and the marks'. Pieces are told apart and cut by Arrow's
    string kernels, once for each distinct piece of a slice. New words of letters are encoded many at a time; each ends
    with the only token that can end a word, which tells them apart. A tokenizer without these properties encodes whole
    texts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.by_pieces = self._splits_as_expected()

    def _splits_as_expected(self) -> bool:
        """Whether this tokenizer drops white space, lower-cases, splits before MARKS and ends each word, and only there,
        with a token that ends words; tried on samples. Texts of any other are encoded whole."""
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        word = ids("thand")
        same = [ids(x) == word + ids("of") for x in ("thand of", " thand\n\tof ", "THAND Of", "Thand\u00a0\u3000of")]
        marks = [ids(f"thand{m}{n}") == word + ids(m + n) for m in MARKS for n in ("", "!", ".,")]
        ends = [self.ends[x].tolist() == [False] * (len(x) - 1) + [True] for x in map(ids, ("a", "thand", "zqxjkvzzqw", "über", "你好")) if x]
        return bool(word) and all(same) and all(marks) and all(ends)

    def _one(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _is_word(text: str) -> bool:
        """Letters that stay letters when they are composed and lower-cased."""
        return text.isalpha() and text.lower().isalpha() and (text.isascii() or unicodedata.normalize("NFC", text).isalpha())

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, known or not."""
        new = [p for p in pieces if p not in self]
        cut = {p: w for p in new if (w := p.rstrip(MARKS)) and self._is_word(w)}
        words = list({w for w in cut.values() if w not in self})
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            raw = ids.tobytes()
            if len(ends) == len(some) and ends[-1] == len(ids):
                self.update({w: raw[4 * a : 4 * b] for w, a, b in zip(some, [0, *ends], ends, strict=False)})
        for p in new:
            if p not in self:
                word = cut.get(p)
                if word in self and word != p:
                    marks = p[len(word) :]
                    if marks not in self:
                        self[marks] = self._one(marks)
                    self[p] = self[word] + self[marks]
                else:  # no word, or letters that turn into other characters
                    self[p] = self._one(p)
        return [self[p] for p in pieces]

    def encode_all(self, texts: list) -> list[np.ndarray]:
        """The ids of each text, with the end id. What is known is forgotten when it gets too much."""
        if not texts:
            return []
        if not self.by_pieces:
            return [np.array([*e.ids, END_ID], "<u4") for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        if len(self) > KEPT_WORDS:
            self.clear()
        self[""] = b""
        lists = pc.split_pattern(pa.array([(t or "").replace("\n", " ") for t in texts], pa.large_string()), " ")
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        letters = pc.ascii_lower(pc.ascii_rtrim(distinct, characters=MARKS))
        simple = pc.and_(pc.string_is_ascii(distinct), pc.or_(pc.ascii_is_alpha(letters), pc.equal(pc.binary_length(letters), 0)))
        # each piece has two parts: letters and marks, or itself and nothing
        one = pc.if_else(simple, letters, distinct).dictionary_encode()
        two = pc.if_else(simple, pc.ascii_ltrim(distinct, characters=LETTERS), "").dictionary_encode()
        first, second = self._ids(one.dictionary.to_pylist()), self._ids(two.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in (*first, *second)], np.int64)
        flat, begin = np.frombuffer(b"".join((*first, *second)), "<u4"), np.cumsum(size) - size
        piece = coded.indices.to_numpy(zero_copy_only=False)
        part = np.stack([one.indices.to_numpy(zero_copy_only=False)[piece], two.indices.to_numpy(zero_copy_only=False)[piece] + len(first)], axis=1).ravel()
        n = size[part]
        where = np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids = flat[where]
        before = np.concatenate([[0], np.cumsum(n)])
        ends = before[2 * np.cumsum(per_text)]
        return np.split(np.insert(ids, ends, END_ID), (ends + np.arange(1, len(ends) + 1))[:-1])

    @classmethod
    def of_worker(cls, path: str) -> WordIds:
        """One for all tasks of a Python worker. Functions travel by value and have no module of their own there, so it
        is kept on the tokenizers module."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("_feedlake_words", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]


def pack_ids(ids: np.ndarray, bits: bool = False) -> tuple[bytes, list[int]]:
    """(payload, compressed size of each plane of each block)."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    parts = []
    for at in range(0, len(ids), BLOCK_IDS):
        octets = ids[at : at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1) if bits else octets.T
        parts += [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return b"".join(parts), [len(p) for p in parts]


def unpack_ids(payload: bytes, sizes: list[int], n_ids: int, bits: bool = False) -> np.ndarray:
    """The ids of a chunk."""
    expand, planes = zstandard.ZstdDecompressor(), 32 if bits else 4
    ends = np.cumsum(sizes)
    raw = [np.frombuffer(expand.decompress(payload[e - s : e]), np.uint8) for e, s in zip(ends.tolist(), sizes, strict=True)]
    out = []
    for at in range(0, len(raw), planes):
        n = min(BLOCK_IDS, n_ids - len(out) * BLOCK_IDS)
        block = np.stack(raw[at : at + planes])
        octets = np.packbits(np.unpackbits(block, axis=1, count=n).T, axis=1, bitorder="little") if bits else block.T
        out.append(np.ascontiguousarray(octets).view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the data set at path.

    Documents are range-partitioned and sorted by doc_id (nulls first; equal ids by a hash of the text), so a hot or
    repeated id is split by its texts. Only doc_id and text are moved, once, before they are encoded. Null and empty
    texts give the end id alone. Every document is in one chunk; a document longer than a chunk has one of its own.
    Other columns are ignored. An empty table gives a data set without chunks.
    """

    def each(batches):
        words, shard, chunk, before = WordIds.of_worker(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        held, ids_of, n = [], [], 0

        def close():
            ids = np.concatenate(held)
            payload, sizes = pack_ids(ids, bits)
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "shard_start": [before], "n_ids": [len(ids)], "doc_ids": [ids_of], "doc_tokens": [[len(x) for x in held]], "plane_bytes": [sizes], "payload": [payload]})

        for batch in batches:
            names, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for doc_id, ids in ((names[a + i], x) for a, b in slices(texts, 4_000_000) for i, x in enumerate(words.encode_all(texts[a:b]))):
                if n and n + len(ids) > CHUNK_IDS:
                    yield close()
                    chunk, before, held, ids_of, n = chunk + 1, before + n, [], [], 0
                held.append(ids)
                ids_of.append(None if doc_id is None else int(doc_id))
                n += len(ids)
        if held:
            yield close()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text: pandas would make floats of ids beside a null
    ordered.mapInPandas(each, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, bits: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a data set without chunks has none."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def each(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = unpack_ids(row.payload, list(row.plane_bytes), row.n_ids, bits)
                n = np.asarray(row.doc_tokens, np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].astype("<u4").tobytes()) for e, k in zip(ends, n, strict=True)]
                yield pd.DataFrame({"doc_id": list(row.doc_ids), "start": row.before + row.shard_start + ends - n, "n_tokens": n, "ids_crc32": crc})

    read = chunks.withColumn("doc_ids", F.col("doc_ids").cast("array<string>")).join(shards, "shard")
    return read.mapInPandas(each, "doc_id string, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_byte_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and read them back."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)
