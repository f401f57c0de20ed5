"""Token ids in a binary format: ids by a public tokenizer, coded by canonical Huffman codes of their global counts.

Documents are dealt out by ranges of their ids, so a task's documents follow those of the task before. It tokenizes them
once and keeps the ids in files of the shared folder with their counts; from the summed counts, a row for each id of the
vocabulary, comes one code for all; each file of ids then becomes a file of coded blocks.

A file: MAGIC; the sizes of the next two parts; code lengths, zlib; documents (id, n_tokens) as an Arrow stream; blocks.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .huffman import BLOCK, MAX_BITS, Coder, lengths
from .shared import new_path, open_fs, remove, written
from .words import tidy

MAGIC = b"LXTOK01\n"
#: A new file is begun beyond so many ids.
ROTATE = 1 << 25
#: Pieces of text whose ids a task remembers, beside as many that it met before these.
MEMO = 400_000
#: Letters, and after them punctuation, that the splitting rule of byte-level BPE takes for one part each. Letters that any
#: version of Unicode knows; no apostrophe, which the rule joins with some letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict[str, Encoder] = {}


def _alphabet() -> dict[int, int]:
    """The characters that stand for bytes in byte-level BPE: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in own else next(rest) for b in range(256)}


class _Whole(Exception):
    """A text has to go to the library whole."""


class Encoder(dict):
    """Ids of texts by a tokenizer file of the tokenizers library, without special tokens.

    Where the file is a byte-level BPE without a normalizer, its splitting rule never joins characters across a single
    space or around a single line feed between other characters. So such pieces of a text are tokenized by the library once
    and remembered, as packed ids by piece: words of letters by its BPE model itself, other pieces by the tokenizer. Texts
    with other white space or with the text of an added token, and all texts under other tokenizers, go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        t = self.tokenizer = Tokenizer.from_file(path)
        self.size = t.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        rule = json.loads(t.pre_tokenizer.__getstate__()) if t.pre_tokenizer else {}
        self.by_piece = type(t.model).__name__ == "BPE" and t.normalizer is None and t.post_processor is None and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        self.added = [a.content for a in t.get_added_tokens_decoder().values()] + ["\0"]
        self.by_piece = self.by_piece and not any(c.isspace() or c == "\0" for a in self.added[:-1] for c in a)
        self.before: dict[str, bytes] = {}
        self.alphabet = _alphabet()
        self.space, self.code = " ".translate(self.alphabet), "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize, self.feed = t.model.tokenize, self.whole("\n")

    def _packed(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, space: bool) -> bytes:
        """The ids of letters, or of a space and letters, by the BPE model."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.tokenize(self.space + word if space else word)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        """A piece stands for a space and itself, one that begins a text (after \\0) or a line (after \\n) for itself."""
        found = self.before.get(piece)
        if found is None:
            first = piece[:1]
            if first == "\n":
                found = self.feed + self["\0" + piece[1:]]
            else:
                body = piece[1:] if first == "\0" else piece
                if plain := _PLAIN.fullmatch(body):
                    tail = plain[2]
                    found = self[piece[: -len(tail)]] + self["\0" + tail] if tail else self._word(body, body is piece)
                elif body.split() != [body]:  # empty, or has white space in it
                    raise _Whole
                else:
                    found = self.whole(body if first == "\0" else " " + body)
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        if not text:
            return b""
        if self.by_piece and not any(a in text for a in self.added):
            try:
                return b"".join(map(self.__getitem__, ("\0" + text).replace("\n", " \n").split(" ")))
            except _Whole:
                pass
        return self.whole(text)


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = "part int, nth int, path string, docs long, ids long"


def _tokenize(tokenizer: str, end_id: int, folder: str):
    """Of a task's documents, in their order, files of ids; a row for each file, with the counts of its ids."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        encoder, rows, out = _encoder(tokenizer), [], None
        end = encoder._packed([end_id])
        counts = np.zeros(0, np.int64)

        def close() -> None:
            out.close()
            sink.close()
            rows.append({"part": part, "nth": len(rows), "path": f"{folder}/{name}", "docs": n_docs, "ids": n_ids, "counts": counts.tobytes()})

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                piece = batch.slice(i, 500)
                part = piece.column("part")[0].as_py()
                packed = [encoder.encode(t or "") + end for t in piece.column("text").to_pylist()]
                whole = np.frombuffer(b"".join(packed), encoder.dtype)
                table = pa.RecordBatch.from_arrays([piece.column("id"), pa.array(packed, pa.binary())], ["id", "ids"])
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, n_docs, n_ids, counts = f"{uuid.uuid4().hex}.arrow", 0, 0, np.zeros(max(encoder.size, end_id + 1), np.int64)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out = pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                out.write_batch(table)
                n_docs += piece.num_rows
                n_ids += len(whole)
                counts += np.bincount(whole, minlength=len(counts))
                if n_ids >= ROTATE:
                    close()
                    out = None
        if out is not None:
            close()
        schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("counts", pa.binary())])
        yield pa.RecordBatch.from_pylist(rows, schema)
        tidy()

    return save


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = np.zeros(0, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            more = np.frombuffer(batch.column("counts")[i].as_py(), np.int64)
            c = c + more if len(c) else more
    ids = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(c[ids])], ["token", "n"])


def _code(folder: str, lens: bytes, narrow: bool):
    """Files of coded blocks from files of ids."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        coder = Coder(np.frombuffer(lens, np.uint8))
        packed = zlib.compress(lens)
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                src, at = open_fs(r["path"])
                name = f"{uuid.uuid4().hex}.tok"
                fs.create_dir(base, recursive=True)
                ids, sizes, left, blocks = [], [], np.empty(0, np.uint32), []
                with src.open_input_stream(at) as f, pa.ipc.open_stream(f) as stream:
                    for part in stream:
                        each = [np.frombuffer(x, np.uint16 if narrow else np.uint32) for x in part.column("ids").to_pylist()]
                        ids.append(part.column("id"))
                        sizes += [len(x) for x in each]
                        left = np.concatenate([left, *each]).astype(np.uint32)
                        while len(left) >= BLOCK:
                            blocks.append(coder.encode(left[:BLOCK]))
                            left = left[BLOCK:]
                if len(left):
                    blocks.append(coder.encode(left))
                sink = pa.BufferOutputStream()
                table = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(sizes, pa.int64())], ["id", "n_tokens"])
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(table)
                docs = sink.getvalue().to_pybytes()
                with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                    f.write(MAGIC + struct.pack("<QQ", len(packed), len(docs)) + packed + docs)
                    for b in blocks:
                        f.write(b)
                r["path"] = f"{folder}/{name}"
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return save


def read_file(f) -> tuple[pa.RecordBatch, Iterator[np.ndarray]]:
    """The documents (id, n_tokens) of an open file, and its blocks' ids one by one."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    n, m = struct.unpack("<QQ", f.read(16))
    coder = Coder(np.frombuffer(zlib.decompress(f.read(n)), np.uint8))
    docs = pa.ipc.open_stream(pa.py_buffer(f.read(m))).read_next_batch()

    def blocks() -> Iterator[np.ndarray]:
        while head := f.read(12):
            yield coder.decode(head + f.read(struct.unpack_from("<III", head)[1]))

    return docs, blocks()


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, at = open_fs(path)
            with fs.open_input_stream(at, compression=None) as f:
                docs, blocks = read_file(f)
                sizes, crcs = docs.column("n_tokens").to_pylist(), []
                held = np.empty(0, np.uint32)
                for n in sizes:
                    crc = 0
                    while n:
                        if not len(held):
                            held = next(blocks)
                        crc = zlib.crc32(held[:n].astype("<u4").tobytes(), crc)
                        got = min(n, len(held))
                        held, n = held[got:], n - got
                    crcs.append(crc)
            n = np.array(sizes, np.int64)
            yield pa.RecordBatch.from_arrays([docs.column("id"), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Files of the ids of all texts in ascending order of id_col; a row each: part, nth (their order), path, docs, ids.

    A text's ids are the tokenizer's, without special tokens, and end_id. Null text is empty and gives end_id alone. Null
    ids come first; rows with equal ids are in the order of their texts' hashes and texts. An empty table gives no file.
    Other columns of docs take no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    raw = new_path(spark, "ids")
    files = written(dealt.mapInArrow(_tokenize(tokenizer, end_id, raw), FILES + ", counts binary"), "id-files")
    n = max(1, files.count())
    some = files.select("counts").repartition(math.isqrt(n - 1) + 1)
    counts = some.mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    table = np.zeros(max((r["token"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        table[r["token"]] = r["n"]
    lens = lengths(table, max(max_bits, int(np.ceil(np.log2(max(2, len(counts)))))))
    narrow = _encoder(tokenizer).size <= 1 << 16
    coded = files.drop("counts").repartition(n).mapInArrow(_code(new_path(spark, "tokens"), lens.tobytes(), narrow), FILES)
    coded = written(coded, "token-files")
    remove(spark, raw)
    return coded


def read(files: DataFrame, id_type: str) -> DataFrame:
    """From the files: id, start (ids of all documents before), n_tokens, ids_crc32, a file a task. The files' list, a few
    dozen bytes for some 10 MB of ids, is summed up on the driver."""
    spark, start, rows = files.sparkSession, 0, []
    for r in files.select("part", "nth", "path", "ids").orderBy("part", "nth").toLocalIterator():
        rows.append((r["path"], start))
        start += r["ids"]
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_checked, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
