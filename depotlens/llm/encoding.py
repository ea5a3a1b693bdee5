"""Encoding of the whole corpus with a byte-level BPE: chunks shared across documents are encoded once.

1. Every text is cut into content-defined chunks: a rolling hash over its bytes picks cuts, preferably before a space that follows a
   visible character, where the tokenizer's own pattern always splits; where no such place comes, at any character.
2. Chunks travel by content hash; equal chunks meet in one task and are encoded once there.  Of a chunk that a task sends very often,
   the further copies meet apart, once for each sending task, so no task gets all copies of a hot chunk.
3. Joins are repaired.  A cut inside a pre-token changes the tokens around it.  The task that cuts still has the text: from the
   last sure split before the cut it re-encodes a growing window until the pre-tokens of the window and those of the chunk behind
   end at the same place.  From there on both agree exactly, since the split depends on nothing before it.  What the window replaces
   travels with the chunk as tokens to drop and tokens to put in.
4. The ids of a document's chunks, less what was dropped, are concatenated.

The tokenizer's files are named by a path and loaded once in a worker; nothing is trained.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.arrow import slices

#: Chunks of at least and at most so many bytes; one safe place in SAFE_ONE_IN and one other in
#: ANY_ONE_IN (powers of two, the second the larger) may be a cut.
MIN_BYTES, MAX_BYTES, SAFE_ONE_IN, ANY_ONE_IN = 256, 4096, 64, 1024
#: Bytes that the rolling hash sees.
WINDOW = 16
#: Copies of one chunk that a task sends to the common place; chunks whose copies a task counts at one time.
COMMON_COPIES, COUNTED = 32, 1 << 18


def default_tokenizer() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers, without its ending."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")[: -len(".tiktoken")]


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of ``path``.tiktoken: special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def _gear() -> np.ndarray:
    """256 fixed pseudo-random words, from the multiplicative rule below."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each byte; windows that begin before the data see zeros."""
    h = _GEAR[data]
    # The hash over 2w bytes is the hash over the w bytes before, shifted w bits, plus that over the last w.
    w = 1
    while w < WINDOW:
        back = h[:-w] << np.uint32(w)
        h[w:] += back
        w *= 2
    return h


#: The buffer is hashed in stretches of this many bytes, which stay in the processor's cache.
_STRETCH = 1 << 16


def _candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Safe and other places to cut; a place is chosen by the bytes before it, so that equal stretches are cut alike."""
    safe, other = [], []
    for a in range(0, len(data), _STRETCH):
        lead = min(a, WINDOW + 1)
        part = data[a - lead : a + _STRETCH]
        mixed = (rolling_hash(part) * np.uint32(0x2C1B3C6D)) >> np.uint32(12)
        at = np.flatnonzero((mixed & np.uint32(SAFE_ONE_IN - 1)) == 0) + 1  # places behind a chosen byte
        at = at[(at >= max(lead, 2)) & (at < len(part))]
        before, two_back, here = part[at - 1], part[at - 2], part[at]
        # A character that is surely no white space: visible ASCII, or two bytes with a lead above C2.
        visible = ((before > 32) & (before < 127)) | ((before >= 128) & (two_back >= 0xC3) & (two_back <= 0xDF))
        safe.append(at[(here == 32) & visible] + (a - lead))
        rare = (mixed[at - 1] & np.uint32(ANY_ONE_IN - 1)) == 0
        other.append(at[rare & (here & 0xC0 != 0x80)] + (a - lead))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *safe]), np.concatenate([none, *other])


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[int], list[bool]]]:
    """For each text in the buffer, the places where chunks end (its length last) and whether each is safe."""
    safe, other = _candidates(data)
    s_range, o_range = np.searchsorted(safe, offsets), np.searchsorted(other, offsets)
    out = []
    for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        ends, kinds, at = [], [], a
        if z - a > MIN_BYTES:
            s, o = safe[s_range[k] : s_range[k + 1]].tolist(), other[o_range[k] : o_range[k + 1]].tolist()
            i = j = 0
            while z - at > MIN_BYTES:
                while i < len(s) and s[i] < at + MIN_BYTES:
                    i += 1
                while j < len(o) and o[j] < at + MAX_BYTES // 2:
                    j += 1
                nxt_safe = s[i] if i < len(s) and s[i] <= at + MAX_BYTES else None
                nxt_other = o[j] if j < len(o) and o[j] <= at + MAX_BYTES else None
                if nxt_safe is not None and (nxt_other is None or nxt_safe <= nxt_other):
                    at = nxt_safe
                    kinds.append(True)
                elif nxt_other is not None:
                    at = nxt_other
                    kinds.append(False)
                elif z - at <= MAX_BYTES:
                    break
                else:
                    at += MAX_BYTES
                    while data[at] & 0xC0 == 0x80:
                        at -= 1
                    kinds.append(False)
                ends.append(at - a)
        ends.append(z - a)
        kinds.append(True)
        out.append((ends, kinds))
    return out


def _splits(text: str) -> list[tuple[str, int]]:
    """Pre-tokens of a text, each with its end in characters."""
    split, end = [], 0
    for _, (a, z) in _splitter().pre_tokenize_str(text):
        split.append((text[a:z], z))
        end = z
    return split


def _sure(split: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Pre-tokens that stay whatever follows: the last may grow, and an apostrophe with one letter may become 're, 've or 'll."""
    n = len(split) - 1
    if n > 0 and split[n - 1][0] == "'" and split[n][0] in ("r", "v", "l"):
        n -= 1
    return split[:n]


def repair(chunks: list[str], safe: list[bool], encode) -> list[tuple[int, int, list[int]]]:
    """For each chunk: tokens to drop at its head and at its tail, and tokens to put in before what is left of it.

    ``safe[i]`` tells that the tokenizer splits after chunk i in any case.  A head of -1 drops all tokens of the chunk.  Pre-tokens are
    encoded one by one: a stretch of them may split otherwise when it stands alone.
    """
    out: list[tuple[int, int, list[int]]] = [(0, 0, [])] * len(chunks)
    carry = ""  # text from the last sure split on, while the join before the chunk is open
    for i, text in enumerate(chunks):
        head, put, at = 0, [], 0
        if carry:
            size, at = 64, None
            while at is None:
                piece, whole = text[:size], size >= len(text)
                own, true = _splits(piece), _splits(carry + piece)
                # What follows may change the end of either, unless the chunk ends safely there.
                if not (whole and safe[i]):
                    own, true = _sure(own), _sure(true)
                starts = {0, *(z for _, z in own)}
                at = next((z - len(carry) for _, z in true if z >= len(carry) and z - len(carry) in starts and z - len(carry) < len(text)), None)
                if at is not None:
                    put = [x for t, z in true if z <= len(carry) + at for x in encode(t)]
                    head = sum(len(encode(t)) for t, z in own if z <= at)
                elif whole:
                    break
                else:
                    size *= 4
            if at is None:  # nothing agrees inside this chunk: all of it joins what is carried on
                carry += text
                out[i] = (-1, 0, encode(carry) if safe[i] else [])
                if safe[i]:
                    carry = ""
                continue
        tail, carry = 0, ""
        if not safe[i]:
            rest = _splits(text[at:])
            open_ = [t for t, _ in rest[len(_sure(rest)) :]]
            carry, tail = "".join(open_), sum(len(encode(t)) for t in open_)
        out[i] = (head, tail, put)
    return out


_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("head", T.IntegerType()), T.StructField("tail", T.IntegerType()), T.StructField("put", T.BinaryType()), T.StructField("chunk", T.BinaryType()), T.StructField("salt", T.IntegerType()),
])
_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("ids", T.BinaryType())])


def _kind(path: str) -> np.dtype:
    """Ids in transit: two bytes each if the vocabulary allows it, else four."""
    return np.dtype("<u2" if encoder(path).max_token_value < 1 << 16 else "<u4")


def _pack(ids: list[int], kind: np.dtype) -> bytes:
    return np.array(ids, kind).tobytes()


def _chunk(path: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind = encoder(path).encode_ordinary, _kind(path)
        own = 1 + (TaskContext.get().partitionId() if TaskContext.get() else 0)
        copies: dict[bytes, int] = {}
        for b in slices(batches, "text"):
            ids, col = b.column("doc_id"), b.column("text")
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in col.to_pylist()]
            offsets = np.cumsum([0, *map(len, raw)])
            data = np.frombuffer(b"".join(raw), np.uint8)
            doc, no, head, tail, put, chunk, salt = [], [], [], [], [], [], []
            for k, (ends, kinds) in enumerate(_cuts(data, offsets) if len(data) else [([0], [True])] * len(raw)):
                cut = [0, *ends]
                parts = [raw[k][x:y] for x, y in zip(cut, cut[1:])]
                if all(kinds):
                    fixes = [(0, 0, b"")] * len(parts)
                else:
                    fixes = [(x, y, _pack(z, kind)) for x, y, z in repair([p.decode("utf-8", "surrogatepass") for p in parts], kinds, encode)]
                doc += [ids[k].as_py()] * len(parts)
                no += range(len(parts))
                for (x, y, z), p in zip(fixes, parts):
                    head.append(x)
                    tail.append(y)
                    put.append(z)
                    chunk.append(p)
                    n = copies[p] = copies.get(p, 0) + 1
                    salt.append(own if n > COMMON_COPIES else 0)
            if len(copies) > COUNTED:
                copies.clear()
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(head, pa.int32()), pa.array(tail, pa.int32()), pa.array(put, pa.binary()), pa.array(chunk, pa.binary()), pa.array(salt, pa.int32())], names=_PIECES.names)

    return run


def _encode(path: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path).encode_ordinary, _kind(path)
        last, ids = None, b""
        for b in slices(batches, "chunk"):  # sorted by content, so equal chunks follow each other
            out = []
            for x, y, put, chunk in zip(b.column("head").to_pylist(), b.column("tail").to_pylist(), b.column("put").to_pylist(), b.column("chunk").to_pylist()):
                if x < 0:
                    out.append(put)
                    continue
                if chunk != last:
                    last, ids = chunk, _pack(encode(chunk.decode("utf-8", "surrogatepass")), kind)
                out.append(put + ids[x * kind.itemsize : len(ids) - y * kind.itemsize])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("no"), pa.array(out, pa.binary())], names=_ENCODED.names)

    return run


def _assemble(path: str) -> callable:
    """Sorted by document and chunk: joins the ids of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(path)
        whole = lambda parts: np.frombuffer(b"".join(parts), kind).astype(np.int32)
        held_doc, held = None, []
        for b in slices(batches, "ids"):
            docs, lists = [], []
            for doc, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if doc != held_doc or not held:
                    if held:
                        docs.append(held_doc)
                        lists.append(whole(held))
                    held_doc, held = doc, []
                held.append(ids)
            if docs:
                yield _lists(docs, lists)
        if held:
            yield _lists([held_doc], [whole(held)])

    return run


def _lists(docs: list, lists: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))], names=["doc_id", "ids"])


def encode_corpus(documents: DataFrame, tokenizer: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every document's text without special tokens.

    ``doc``: unique bigint; a null one is kept as a document of its own only once.  A null and an empty text give an empty list;
    texts of any length are encoded whole, blank ones like any other; strings of special tokens are ordinary text.  Repeated texts
    meet as chunks.  Any vocabulary goes: ids travel as two bytes or four.  Extra columns are ignored; an empty table gives none.
    """
    path = tokenizer or default_tokenizer()
    encoded = _meeting(documents, path, doc, text).mapInArrow(_encode(path), _ENCODED)
    whole = encoded.repartition("doc_id").sortWithinPartitions("doc_id", "no")
    return whole.mapInArrow(_assemble(path), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def _pieces(documents: DataFrame, path: str, doc: str, text: str) -> DataFrame:
    docs = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_chunk(path), _PIECES)


def _meeting(documents: DataFrame, path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces where their chunks are encoded: equal chunks follow each other, and hot ones are spread."""
    pieces = _pieces(documents, path, doc, text).withColumn("content", F.xxhash64("chunk"))
    return pieces.repartition("content", "salt").sortWithinPartitions("content", "salt", "chunk").drop("content", "salt")


def reuse(documents: DataFrame, tokenizer: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: how many chunks and bytes there are, how many of them are distinct, and how many bytes of distinct whole texts, which
    is what encoding each text once would come to."""
    chunks = _pieces(documents, tokenizer or default_tokenizer(), doc, text).groupBy("chunk").agg(F.count("*").alias("n"))
    size = F.octet_length("chunk").cast("bigint")
    figures = chunks.agg(F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(size * F.col("n")).alias("chunk_bytes"), F.sum(size).alias("distinct_bytes"))
    texts = documents.groupBy(text).agg(F.lit(1)).agg(F.sum(F.octet_length(text).cast("bigint")).alias("distinct_text_bytes"))
    return figures.withColumn("one", F.lit(1)).join(texts.withColumn("one", F.lit(1)), "one").drop("one")
