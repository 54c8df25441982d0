"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. Texts are cut into pre-tokens in the JVM. A task groups documents into blocks of bounded size; a block numbers its
   distinct words by (hash bucket, word), so that a document becomes the numbers of its words in order: the positions.
2. Words leave their block once each, packed by hash bucket, and meet the words of all other blocks there: the
   distinct-word shuffle. A bucket encodes each distinct word once and sends ids back, packed, in the order received.
3. A block's ids, bucket by bucket, are then in the order of its word numbers: joined back on the block, they are
   gathered by position into documents.
4. ``decoded``: the ids are looked up in the token-byte table, whose size is that of the vocabulary file.

A word that is in every block has one entry a block in its bucket, however often it occurs. Texts are read once: blocks
are written to the shared folder in files by block, where the ids meet them without a second shuffle.

A bucket keeps at most ``MOST_KNOWN`` words at hand: one that holds more (as the number of buckets follows
spark.sql.shuffle.partitions, only a setting far too low for the corpus makes it) forgets them and may encode a word
again, so that its memory stays bounded.

Defined cases: null text is the empty text: no ids. A null doc_id stays null. Equal documents are encoded each. Rows
with the same doc_id stay apart (a row is a position in its block). Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.llm.shared import bucketed, cut, forget, text_of
from trestle.llm.vocab import encoder, token_bytes

#: A block is closed when it has so many pre-tokens or documents; the last piece of 500 documents may go beyond.
BLOCK_WORDS, BLOCK_DOCS = 800_000, 20_000
#: Words that a bucket keeps with their ids, at most.
MOST_KNOWN = 1 << 20
#: Stands for a null doc_id inside of blocks.
NO_ID = -(2**63)
DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def java_pattern(pattern: str) -> str:
    """(?U): white space, letters and digits by their Unicode properties."""
    return "(?U)" + pattern


def _packed(*parts: np.ndarray | bytes) -> bytes:
    """Arrays of known types end to end, each after its length, compressed."""
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x for p in raw for x in (len(p).to_bytes(8, "little"), p)))


def _unpacked(data: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int):
    """(number, doc_ids, words per document, words by number as bytes, their buckets, numbers) of each block."""
    part, seq, held, n_words, n_docs = TaskContext.get().partitionId(), 0, [], 0, 0

    def block():
        words = pa.concat_arrays([b.column(1).flatten().cast(pa.large_binary()) for b in held])
        sizes = np.concatenate([pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
        found = words.dictionary_encode()
        own = found.dictionary.to_pylist()
        home = np.fromiter((zlib.crc32(w) % buckets for w in own), np.int64, len(own))
        by_word = pc.sort_indices(found.dictionary).to_numpy()
        order = by_word[np.argsort(home[by_word], kind="stable")]
        number = np.empty(len(own), np.uint32)
        number[order] = np.arange(len(own), dtype=np.uint32)
        return (part << 32) + seq, ids, sizes, [own[k] for k in order.tolist()], home[order], number[found.indices.to_numpy(zero_copy_only=False)]

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            piece = batch.slice(lo, 500)
            held.append(piece)
            n_words += len(piece.column(1).flatten())
            n_docs += piece.num_rows
            if n_words >= BLOCK_WORDS or n_docs >= BLOCK_DOCS:
                yield block()
                seq, held, n_words, n_docs = seq + 1, [], 0, 0
    if held:
        yield block()


def _pre_tokens(docs: DataFrame, pattern: str) -> DataFrame:
    found = F.regexp_extract_all(text_of(docs), F.lit(java_pattern(pattern)), F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), found.alias("words"))


def block_table(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Blocks, written once to the shared folder in files by ``home`` (the block): ``kind`` 0 has the documents of a
    block as numbers of its words, in order; ``kind`` 1 has its distinct words of one ``bucket``, in the order of their
    numbers."""

    def each(batches):
        for number, ids, sizes, words, home, at in _blocks(batches, buckets):
            edge = np.searchsorted(home, np.arange(buckets + 1))
            some = [k for k in range(buckets) if edge[k] < edge[k + 1]]
            data = []
            for k in some:
                own = words[edge[k] : edge[k + 1]]
                data.append(_packed(np.fromiter(map(len, own), "<u4", len(own)), b"".join(own)))
            at = at.astype("<u2") if len(words) <= 1 << 16 else at
            data.append(_packed(ids.astype("<i8"), sizes.astype("<u4"), bytes([at.itemsize]), at))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*some, -1], pa.int32()), pa.array([number] * len(data), pa.int64()), pa.array(data, pa.binary()), pa.array([1] * len(some) + [0], pa.int32())],
                names=["bucket", "home", "packed", "kind"],
            )

    found = _pre_tokens(docs, pattern).mapInArrow(each, "bucket int, home long, packed binary, kind int")
    # packed already
    return bucketed(found, "home", "blocks", buckets, "none", "kind")


def encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same rows with ids for words (numbers of ids, then ids); within a bucket each distinct word is encoded once."""

    def encode(batches):
        own, bucket, known = encoder(path, pattern), None, {}
        for batch in batches:
            out = []
            for b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                sizes, raw = _unpacked(data)
                ids, at = [], 0
                for n in np.frombuffer(sizes, "<u4").tolist():
                    word = raw[at : at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        if len(known) >= MOST_KNOWN:
                            known.clear()
                        found = known[word] = own.encode_ordinary(word.decode())
                    ids.append(found)
                flat = np.fromiter((i for x in ids for i in x), "<u4")
                flat = flat.astype("<u2") if own.max_token_value < 1 << 16 else flat
                out.append(_packed(np.fromiter(map(len, ids), "<u4", len(ids)), bytes([flat.itemsize]), flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["bucket", "home", "packed"])

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(encode, "bucket int, home long, packed binary")


def _gather(starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[starts[k] : starts[k] + sizes[k]] for all k, end to end."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


def _documents(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, lists of ids) of each block: the ids that came back are gathered by position."""
    counts, values = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    for data in right.sort_by("bucket").column("packed").to_pylist():
        sizes, width, ids = _unpacked(data)
        counts.append(np.frombuffer(sizes, "<u4").astype(np.int64))
        values.append(np.frombuffer(ids, f"<u{width[0]}").astype(np.int32))
    sizes, flat = np.concatenate(counts), np.concatenate(values)
    starts = np.cumsum(sizes) - sizes
    for data in left.column("packed").to_pylist():
        doc_ids, n_words, width, at = _unpacked(data)
        ends = np.cumsum(np.frombuffer(n_words, "<u4").astype(np.int64))
        at = np.frombuffer(at, f"<u{width[0]}")
        per_word = np.concatenate([[0], np.cumsum(sizes[at])])
        offsets = np.concatenate([[0], per_word[ends]]).astype(np.int32)
        parts = [_gather(starts[at[k : k + 500_000]], sizes[at[k : k + 500_000]], flat) for k in range(0, len(at), 500_000)]
        yield pa.array(np.frombuffer(doc_ids, "<i8")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([flat[:0], *parts]), pa.int32()))


def _assembled(docs: DataFrame, path: str, pattern: str, finish, schema: str) -> DataFrame:
    """``finish`` (a table of a block's documents from their ids) inside the task that gathers the block. The result is
    written to the shared folder, and the blocks are removed."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_table(docs, pattern, buckets)
    back = encode_words(blocks.filter("kind = 1").select("bucket", "home", "packed"), path, pattern)
    own = blocks.filter("kind = 0").select("home", "packed")

    def assemble(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([finish(*x) for x in _documents(left, right)])

    whole = own.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(assemble, schema)
    out = cut(whole.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))), "blocks-encoded")
    forget(blocks)
    return out


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of every document."""
    return _assembled(docs, path, pattern, lambda ids, lists: pa.table({"doc_id": ids, "ids": lists}), "doc_id long, ids array<int>")


def _bytes(lists: pa.Array, path: str) -> pa.Array:
    """The bytes of lists of ids, joined with the token-byte table."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]))
    pieces = token_bytes(path).take(lists.flatten())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pieces), pa.scalar(b"", pa.large_binary()))


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``bytes``: the ids' bytes, joined with the token-byte table inside each task."""

    def decode(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(batch.column(1), path).cast(pa.binary())], names=["doc_id", "ids", "bytes"])

    return tokens.mapInArrow(decode, "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, and hashes of the ids and of the decoded bytes, for each document: encoded, decoded and hashed within
    the task that gathers a block, so that ids and bytes never cross to the JVM."""
    sha = lambda x: hashlib.sha256(x or b"").hexdigest()

    def finish(doc_ids: pa.Array, lists: pa.Array) -> pa.Table:
        out = []
        for lo in range(0, len(lists), 200):
            some = lists.slice(lo, 200)
            sizes = pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]))
            lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, some.flatten().cast(pa.large_string())), pa.scalar(",", pa.large_string()))
            ids_sha = [sha(x) for x in lines.cast(pa.large_binary()).to_pylist()]
            out.append(pa.table([doc_ids.slice(lo, 200), pa.array(sizes), pa.array(ids_sha), pa.array([sha(x) for x in _bytes(some, path).to_pylist()])], names=DIGESTS))
        return pa.concat_tables(out)

    return _assembled(docs, path, pattern, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
