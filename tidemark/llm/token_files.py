"""Token ids in fixed-width files: every id takes the fewest bits that the vocabulary needs.

A file is a header, the document ids with their starts, the byte offsets of the blocks, and the blocks: so many ids
each, packed bit by bit, low bits first. Offsets make any range of ids readable without the rest. Files travel as the
binary column of a Parquet table, the one container that executors can write to any shared store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.bpe import PLAIN, SPLIT, Words, lay, loaded, read_spec
from tidemark.llm.common import frugal, pieces, work_dir

MAGIC = b"TMB1"
#: magic, bits of an id, ids in a block, ids, documents, blocks
HEADER = struct.Struct("<4sIIQQQ")
#: Ids in a block, and about how many a file holds.
BLOCK, FILE = 1 << 14, 1 << 20
END = 2
#: Marks that often follow a word; each is a piece of its own behind letters.
MARKS = ".,;:!?"
#: Words that the library is asked for at a time, and bytes of text that are encoded together.
TOGETHER, BYTES = 500, 16_000_000


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids, bits: int) -> bytes:
    """Ids as a stream of `bits` bits each, the last byte filled up with zeros."""
    import numpy as np

    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):  # the same stream, as whole machine words
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int):
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_file(docs: list[tuple[int | None, bytes]], bits: int, block: int = BLOCK) -> bytes:
    """One file of (document id, ids as little-endian unsigned 32-bit integers), in the given order."""
    import numpy as np

    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id is beyond the vocabulary")
    starts = np.append(0, np.cumsum([len(x) // 4 for _, x in docs])).astype("<u8")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.append(0, np.cumsum([len(x) for x in blocks])).astype("<u8")
    known = np.array([i is not None for i, _ in docs], np.uint8)
    names = np.array([i or 0 for i, _ in docs], "<i8")
    return b"".join([HEADER.pack(MAGIC, bits, block, len(ids), len(docs), len(blocks)), names.tobytes(), known.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file; `ids(i, j)` unpacks only the blocks that hold that range."""

    def __init__(self, data: bytes):
        import numpy as np

        magic, self.bits, self.block, self.n_ids, self.n_docs, blocks = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.known = np.frombuffer(data, np.uint8, self.n_docs, at := at + 8 * self.n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at := at + self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (self.n_docs + 1)).astype(np.int64)
        self.data, self.at = data, at + 8 * (blocks + 1)

    def ids(self, start: int, stop: int):
        import numpy as np

        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.data[self.at + self.offsets[k] : self.at + self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def doc(self, k: int):
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Library:
    """The tokenizers library, asked once for each word while the word is remembered.

    These tokenizers split at white space whatever stands around it, so the ids of a text of plain characters are
    those of its words in a row. Other texts go to the library whole.
    """

    def __init__(self, spec: bytes):
        import json

        import numpy as np
        import regex
        from tokenizers import Tokenizer

        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("a tokenizer without word ends")
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.normalizer = None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.plain = regex.compile(PLAIN).fullmatch
        special = [regex.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special)).search if special else lambda text: None
        #: Whether a token is the last of a word, by id; the split pattern says how many words a plain one has.
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])
        self.split = regex.compile(SPLIT).findall
        self.words = Words()

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words):
        """The number of ids of each plain word, and all ids.

        Lower case is all that normalising does to plain words. Letters, and the marks behind them, are pieces of their
        own: each distinct one is asked for once, and the pieces found are told apart by their last tokens.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        lower = pc.utf8_lower(words)
        parts = pc.extract_regex(lower, f"^(?P<core>.*?)(?P<marks>[{MARKS}]*)$")
        letters = pc.utf8_is_alpha(pc.struct_field(parts, "core"))
        core = pc.if_else(letters, pc.struct_field(parts, "core"), lower)
        marks = pc.if_else(letters, pc.struct_field(parts, "marks"), "")
        coded = pa.concat_arrays([core, marks]).dictionary_encode()
        asked, place = coded.dictionary, np.asarray(coded.indices).reshape(2, -1).T.ravel()
        pieces = np.ones(len(asked), np.int64)
        odd = np.flatnonzero(~np.asarray(pc.utf8_is_alpha(asked)))
        pieces[odd] = [len(self.split(w)) for w in asked.take(pa.array(odd)).to_pylist()]
        ids, sizes = [], []
        for k in range(0, len(asked), TOGETHER):
            some = pieces[k : k + TOGETHER]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], asked.slice(k, len(some))), " ")[0].as_py()
            found = np.array(self.bare.encode(text, add_special_tokens=False).ids, "<u4")
            ends = np.append(0, np.flatnonzero(self.last[found]) + 1)
            sizes.append(np.diff(ends[np.append(0, np.cumsum(some))]))
            ids.append(found)
        size = np.concatenate(sizes)
        start = np.cumsum(size) - size
        return size[place].reshape(-1, 2).sum(1), lay(np.concatenate(ids), start[place], size[place])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        plain = [bool(self.plain(t)) and not self.special(t) for t in texts]
        easy = iter(self.words.join([t for t, p in zip(texts, plain, strict=True) if p], self._learn))
        return [next(easy) if p else self._whole(t) for t, p in zip(texts, plain, strict=True)]


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Write the ids of all texts, each closed by `end`, as files in ascending order of the document ids.

    The texts are dealt out by ranges of ids once; each task then packs its range into files of about FILE ids (a
    document is never cut, so a very long one has a larger file). Rows without id come first, as nulls do in Spark.
    """
    spec = read_spec(docs.sparkSession, tokenizer)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        library = loaded(Library, spec.value)
        bits = width(max(library.size, end + 1))
        part, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        names = ["part", "number", "before", "n_ids", "data"]

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([before]), pa.array([size]), pa.array([write_file(held, bits)], pa.binary())], names=names)

        for b in pieces(batches, "text", BYTES):
            for name, ids in zip(b.column("id").to_pylist(), library.encode_batch(b.column("text").to_pylist()), strict=True):
                held.append((name, ids + end.to_bytes(4, "little")))
                size += len(ids) // 4 + 1
                if size >= FILE:
                    yield full()
                    number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield full()

    ordered.mapInArrow(frugal(run), "part long, number long, before long, n_ids long, data binary").write.option("compression", "zstd").parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files with `start`: the number of ids in all files before. Only a row for each part is put in order."""
    table = spark.read.schema("part long, number long, before long, n_ids long, data binary").parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # A part is a task of the writing job, so this table has as many rows as that had tasks.
    return table.join(F.broadcast(parts), "part").select("part", "number", (F.col("base") + F.col("before")).alias("start"), "data")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids (little-endian unsigned 32-bit integers) of every document in the files."""
    return _read(spark, path, id_col, lambda ids: ids.tobytes(), "ids binary")


def _read(spark: SparkSession, path: str, id_col: str, make, column: str) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.binary() if column.endswith("binary") else pa.int64()
        for b in batches:
            for start, data in zip(b.column("start").to_pylist(), b.column("data"), strict=True):
                f = TokenFile(data.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.doc_ids, mask=f.known == 0),
                        pa.array(start + f.starts[:-1], pa.int64()),
                        pa.array(f.starts[1:] - f.starts[:-1], pa.int64()),
                        pa.array([make(f.doc(k)) for k in range(f.n_docs)], kind),
                    ],
                    names=[id_col, "start", "n_tokens", name],
                )

    return files(spark, path).select("start", "data").mapInArrow(frugal(run), f"`{id_col}` long, start long, n_tokens long, {column}")


def checksums(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files."""
    import zlib

    return _read(spark, path, id_col, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files of docs into the shared folder and read them back: id, start, n_tokens, ids_crc32.

    Defined cases: a null text is empty, and holds the end id alone; a null id stays null and comes first; repeated ids
    follow one another, ordered by text; other columns are ignored; an empty table has no files and gives no rows.
    """
    path = work_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, id_col, text)
    return checksums(docs.sparkSession, path, id_col)
