"""BPE encoding and decoding over a distinct-word table.

White space never joins tokens of this vocabulary, so a text is the sequence of its words. Words are split in Arrow
kernels, each distinct word of a task is encoded once by the tokenizers library, and ids come back to their
positions through the word's place in the table; pieces come from the ids through the id-to-piece table. Everything
after the table is a gather over Arrow arrays: no loop over the words of a text, and no shuffle at all. One global
table would have to shuffle a row for each word position (README, "BPE").

Defined cases: a null or empty text has no tokens; special-token strings in a text are encoded as the library does by
default; repeated rows are encoded one by one; an empty table gives an empty result; a very long text is cut at white
space into blocks, its digests are fed block by block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternsift.llm.common import slim

#: Words a task's table holds at most; beyond, it starts again (a word met later is then encoded again).
TABLE_WORDS = 400_000
#: Characters of text that are split at a time.
BLOCK_CHARS = 4_000_000


class WordTable:
    """Distinct word -> its ids and decoded pieces, grown batch by batch."""

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.limit = limit
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pieces = self.tok.get_vocab(with_added_tokens=True)
        table: list[str | None] = [None] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            table[i] = piece
        self.pieces = pa.array(table, pa.string())
        self.known: dict[str, np.ndarray] = {}

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all words end to end, how many each has, and each word's pieces joined by a blank."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
            fresh = words
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            for w, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False)):
                self.known[w] = np.array(e.ids, dtype="<u4")
        ids = [self.known[w] for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        pieces = pc.binary_join(pa.ListArray.from_arrays(offsets, self.pieces.take(pa.array(flat))), " ")
        return flat, counts, pieces

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """For each text its ids and its decoded words as an array of strings to be joined by a blank."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = pc.dictionary_encode(lists.flatten())
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, counts, pieces = self.look_up(words.dictionary.to_pylist())
        starts = np.cumsum(counts) - counts
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            at = index[a:b]
            at = at[counts[at] > 0]
            n = counts[at]
            ends = np.cumsum(n)
            where = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            yield flat[where], pieces.take(pa.array(at))


def _joined(words: pa.Array) -> bytes:
    if not len(words):
        return b""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
    return whole[0].as_py().encode()


def _blocks(text: str, size: int) -> Iterator[str]:
    """A long text in pieces that are cut at ASCII white space, or whole where it has none."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(c, start, start + size) for c in " \n\t\r\x0b\x0c")
        if cut < start:
            cut = min((x for x in (text.find(c, start + size) for c in " \n\t\r\x0b\x0c") if x >= 0), default=len(text))
        yield text[start : cut + 1]
        start = cut + 1
    yield text[start:]


def _groups(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about size characters."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, keep: list[str], with_ids: bool, with_decoded: bool, block: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    table = WordTable(path)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text"))
        for lo, hi in _groups(texts, block):
            part, n_tokens, ids_sha, dec_sha, all_ids, all_text = texts.slice(lo, hi - lo), [], [], [], [], []
            if hi - lo == 1 and len(part[0].as_py() or "") > block:
                todo = [table.encode(pa.array(list(_blocks(part[0].as_py(), block))))]
            else:
                todo = [[x] for x in table.encode(part)]
            for chunks in todo:
                h, d, n, first, kept_ids, kept_text = hashlib.sha256(), hashlib.sha256(), 0, True, [], []
                for ids, words in chunks:
                    raw, text = ids.tobytes(), _joined(words)
                    if not len(words):
                        continue
                    n += len(ids)
                    h.update(raw)
                    d.update(text if first else b" " + text)
                    first = False
                    if with_ids:
                        kept_ids.append(ids)
                    if with_decoded:
                        kept_text.append(text.decode())
                n_tokens.append(n)
                ids_sha.append(h.hexdigest())
                dec_sha.append(d.hexdigest())
                all_ids.append(np.concatenate(kept_ids).astype(np.int32) if kept_ids else np.empty(0, np.int32))
                all_text.append(" ".join(kept_text))
            columns = [batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep]
            columns += [pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_decoded:
                columns.append(pa.array(all_text, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """The kept columns, n_tokens, digests of the ids and of the decoded text, and the ids and the decoded text if asked for."""
    base = slim(docs, *keep).withColumn("_text", F.col("text")) if "text" in keep else slim(docs, *keep, "text").withColumnRenamed("text", "_text")
    names = list(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != "_text")
    schema = f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    return base.mapInArrow(lambda it: encode_batches(it, path, names, with_ids, with_decoded), schema)
