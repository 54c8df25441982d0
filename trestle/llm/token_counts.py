"""Token counts of flat token files that have no index.

A token file is little-endian uint16 ids end to end; an end-of-document id closes each document. ``scan`` reads a
file in blocks of fixed size, in any order and on any executor: a block reports the lengths between its own
separators, and what stands before the first and after the last. A prefix scan over the blocks of a file gives each
document its place in the file and carries open tails over blocks without a separator.

Defined cases: null or empty text is a document without tokens (two separators in a row); tokens after a file's last
separator belong to no closed document and are not counted; repeated rows are documents of their own; an empty table
gives no files and no counts; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trestle.llm.shared import cut, fresh_path, text_of
from trestle.llm.vocab import encoder

BLOCK_BYTES = 1 << 22


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(docs: DataFrame, path: str, pattern: str, eod: int) -> DataFrame:
    """Encode the texts into flat files in the shared folder; the manifest: file, n_bytes, place, doc_id.

    A file's name is new in every attempt of a task, so a task that runs again never touches a file that the manifest
    names.
    """
    folder = fresh_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sink, ids, n_bytes = encoder(path, pattern), None, [], 0
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, batch.num_rows, 200):
                coded = own.encode_ordinary_batch(texts.slice(lo, 200).to_pylist(), num_threads=1)
                if sink is None:
                    system, place = _open(folder)
                    system.create_dir(place, recursive=True)
                    name = f"{uuid.uuid4().hex}.bin"
                    sink = system.open_output_stream(f"{place}/{name}")
                for tokens in coded:
                    raw = np.array([*tokens, eod], dtype="<u2").tobytes()
                    sink.write(raw)
                    n_bytes += len(raw)
            ids.append(batch.column(0).cast(pa.int64()))
        if sink is not None:
            sink.close()
            ids = pa.concat_arrays(ids)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"] * n), pa.array(np.full(n, n_bytes)), pa.array(np.arange(n)), ids], names=["file", "n_bytes", "place", "doc_id"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return cut(rows.mapInArrow(write, "file string, n_bytes long, place long, doc_id long"), "tokens-manifest")


def scan(files: DataFrame, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``place``, ``n_tokens`` of every closed document in ``files`` (file, n_bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(block_bytes).cast("long"))
    blocks = files.filter("n_bytes > 0").select("file", "n_bytes", F.posexplode(starts).alias("block", "start")).repartition("file", "block")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, block, start in zip(batch["file"], batch["block"], batch["start"], strict=True):
                system, place = _open(name)
                with system.open_input_file(place) as f:
                    f.seek(int(start))
                    ids = np.frombuffer(f.read(block_bytes), "<u2")
                at = np.flatnonzero(ids == eod)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - int(at[-1]) - 1 if len(at) else len(ids)
                yield pd.DataFrame({"file": [name], "block": [block], "n_ends": [len(at)], "head": [head], "tail": [tail], "inner": [(np.diff(at) - 1).astype(np.int64)]})

    found = cut(blocks.mapInPandas(search, "file string, block int, n_ends long, head long, tail long, inner array<long>"), "tokens-blocks")
    # prefix scan over block summaries only: documents closed before a block, and tokens left open before it
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("tail").over(before), F.lit(0))
    # the carry restarts at the last block with a separator: its own tail counts, nothing earlier
    marked = found.drop("inner").withColumn("closed", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("tails", total)
    reset = F.coalesce(F.max(F.when(F.col("n_ends") > 0, F.col("tails"))).over(before), F.lit(0))
    carried = marked.withColumn("open", F.col("tails") - reset).select("file", "block", "closed", "open")
    each = found.filter("n_ends > 0").join(carried, ["file", "block"])
    counts = F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))
    return each.select("file", "closed", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("closed") + F.col("k")).alias("place"), "n_tokens")


def token_counts(docs: DataFrame, path: str, pattern: str, eod: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_tokens`` through flat files: written, scanned, and named by the manifest."""
    manifest = write_files(docs, path, pattern, eod)
    counts = scan(manifest.select("file", "n_bytes").distinct(), eod, block_bytes)
    return manifest.select("file", "place", "doc_id").join(counts, ["file", "place"]).select("doc_id", "n_tokens")
