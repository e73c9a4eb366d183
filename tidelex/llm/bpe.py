"""BPE encoding and decoding of whole texts with the streaming transducer of bpe_stream.py.

Ids leave the transducer a piece of the text after another and go on into the digest and into the decoder, which
turns the same ids back to text as it receives them: neither all ids nor the decoded text are held.

Edge cases: null text is empty and has no ids; both digests are then those of no bytes. The names of
added tokens inside a text are that token, as the library reads them by default. Repeated rows and ties
need nothing: each row stands alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.llm import textkit as K
from tidelex.llm.bpe_stream import WordEncoder
from tidelex.llm.shared import small_batches

def encoder(path: str) -> WordEncoder:
    """Made once in each Python process."""
    return K.model(("bpe", path), lambda: WordEncoder(path))


def bpe_round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of ``docs(doc_id, text)``."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            for part in K.slices(batch, "text"):
                n, ids_sha, text_sha, rest = [], [], [], []
                for text in part.column("text").to_pylist():
                    decoder, count, ids_hash, text_hash, held = own.decoder(), 0, hashlib.sha256(), hashlib.sha256(), []
                    for ids in own.stream(text or ""):
                        decoded = decoder.push(memoryview(ids).cast("I"))
                        count += len(ids) // 4
                        ids_hash.update(ids)
                        text_hash.update(decoded.encode())
                        if with_ids:
                            held.append((ids, decoded))
                    n.append(count)
                    ids_sha.append(ids_hash.hexdigest())
                    text_sha.append(text_hash.hexdigest())
                    if with_ids:
                        rest.append((memoryview(b"".join(x for x, _ in held)).cast("I").tolist(), "".join(x for _, x in held)))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    columns += [pa.array([x[0] for x in rest], pa.list_(pa.int64())), pa.array([x[1] for x in rest], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids)
