"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer by chunk reuse.

Texts are cut where a rolling hash of the last characters says so, hence equal passages of
different documents give equal chunks. Each distinct chunk is encoded once. Two chunks that meet
in a document are joined exactly: a place where white space follows something else is a boundary
of the tokenizer's words whatever stands around it, so encodings on both sides must agree there.
Between the last such place of a chunk and the first one of the next chunk the text is encoded
again; a chunk without such a place extends the stretch until one agrees.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codelode.functions.fingerprints import fingerprint128
from codelode.plans.scratch import cut

WINDOW, MASK = 16, 511  # characters that the rolling hash sees; a cut in 512 characters on average
SHORTEST, LONGEST = 256, 4096
#: A chunk is hot if it holds at least this part of all chunk places; so there are at most as many hot chunks.
HOT_PARTS = 256
#: White space that every engine takes for white space, after something that none does.
_JOINT = re.compile(r"(?<=\S)[ \n]")
_TAIL = 32

@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """tiktoken's encoding of a file of ranks; once per process."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 1 << 12, dtype=np.uint64)


def chunks(text: str) -> list[str]:
    """The text cut at places that depend on the characters before them only, within length bounds."""
    n = len(text)
    if n <= SHORTEST * 2:
        return [text]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gear = _GEAR[codes & 0xFFF]
    rolled = gear.copy()
    for j in range(1, WINDOW):
        rolled[j:] += gear[:-j] << np.uint64(j)
    marks = np.flatnonzero(((rolled >> np.uint64(20)) & np.uint64(MASK)) == 0) + 1
    out, start, k = [], 0, 0
    while n - start > SHORTEST * 2:
        k = int(np.searchsorted(marks, start + SHORTEST, "left"))
        end = min(int(marks[k]) if k < len(marks) else n, start + LONGEST)
        if n - end < SHORTEST:
            break
        out.append(text[start:end])
        start = end
    out.append(text[start:])
    return out


def _chunker(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys, seqs, texts = [], [], [], []
        for doc, key, text in zip(pdf["doc"], pdf["key"], pdf["text"]):
            parts = chunks(text)
            ids += [doc] * len(parts)
            keys += [key] * len(parts)
            seqs += range(len(parts))
            texts += parts
            if len(texts) > 20_000:
                yield pd.DataFrame({"doc": ids, "key": keys, "seq": np.array(seqs, np.int32), "text": texts})
                ids, keys, seqs, texts = [], [], [], []
        yield pd.DataFrame({"doc": ids, "key": keys, "seq": np.array(seqs, np.int32), "text": texts})


def parts_of(text: str) -> tuple[str, str, str] | None:
    """(head, middle, tail) cut at joints, or None if the chunk has none to cut at."""
    first = _JOINT.search(text)
    if not first:
        return None
    q, p = first.start(), 0
    back = _TAIL
    while True:  # the last joint
        low = max(len(text) - back, 0)
        places = [m.start() for m in _JOINT.finditer(text, low)]
        if places or not low:
            p = places[-1] if places else q
            break
        back *= 4
    return text[:q], text[q:p], text[p:]


def stored_as(encoding) -> str:
    """The type of stored ids: two bytes where they suffice."""
    return "<u2" if encoding.n_vocab <= 1 << 16 else "<u4"


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        kind = stored_as(enc)
        for pdf in batches:
            split = [parts_of(t) for t in pdf["text"]]
            middles = [enc.encode_ordinary(s[1]) if s else [] for s in split]
            yield pd.DataFrame(
                {
                    "h1": pdf["h1"],
                    "h2": pdf["h2"],
                    "n": pdf["n"],
                    "solid": [s is None for s in split],
                    "head": [s[0] if s else t for s, t in zip(split, pdf["text"])],
                    "middle": [np.asarray(m, kind).tobytes() for m in middles],
                    "tail": [s[2] if s else "" for s in split],
                }
            )

    return run


def join_chunks(pieces: list[tuple[bool, str, bytes, str]], encode, kind: str = "<u4") -> np.ndarray:
    """Ids of the text that the chunks (solid, head, ids of the middle stored as kind, tail) make."""
    out, open_text = [], ""
    for solid, head, middle, tail in pieces:
        open_text += head
        if solid:
            continue
        out += [np.asarray(encode(open_text), np.int32), np.frombuffer(middle, kind).astype(np.int32)]
        open_text = tail
    out.append(np.asarray(encode(open_text), np.int32))
    return np.concatenate(out)


def _assembler(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, kind = encoder(path).encode_ordinary, stored_as(encoder(path))
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                ids = [join_chunks([(p["solid"], p["head"], p["middle"], p["tail"]) for p in pieces], encode, kind) for pieces in part["pieces"]]
                yield pd.DataFrame({"doc": part["doc"], "ids": ids})

    return run


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of each text, without special tokens; strings of such tokens are ordinary text.

    A null and an empty text give an empty list. A row repeated with its id gives one row; one id with
    several texts gives a row for each. Rows with a null id are encoded like others (equal texts give
    one row). Texts of any length are encoded whole; other columns are ignored.
    """
    path = path or vocabulary()
    rows = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    none = rows.where("text is null or text = ''").select("doc", F.array().cast("array<int>").alias("ids")).distinct()
    full = rows.where("text <> ''").select("doc", F.xxhash64("text").alias("key"), "text")
    h1, h2 = fingerprint128(F.col("text"))
    # written once: the distinct chunks and the places of all chunks are both read from it
    placed = cut(full.mapInPandas(_chunker, "doc long, key long, seq int, text string").select("doc", "key", "seq", h1.alias("h1"), h2.alias("h2"), "text"))
    distinct = placed.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    encoded = cut(distinct.mapInPandas(_encode(path), "h1 long, h2 long, n long, solid boolean, head string, middle binary, tail string"))
    places = placed.select("doc", "key", "seq", "h1", "h2")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    most = max(total // HOT_PARTS, 1000)
    cold = encoded.where(F.col("n") < most).drop("n")
    # at most HOT_PARTS chunks of LONGEST characters, however large the corpus
    hot = F.broadcast(encoded.where(F.col("n") >= most).drop("n").withColumn("is_hot", F.lit(True)))
    marked = places.join(hot, ["h1", "h2"], "left")
    columns = ["doc", "key", "seq", "solid", "head", "middle", "tail"]
    met = marked.where("is_hot").select(columns).unionByName(marked.where("is_hot is null").select("doc", "key", "seq", "h1", "h2").join(cold, ["h1", "h2"]).select(columns))
    whole = met.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("seq", "solid", "head", "middle", "tail"))).alias("pieces"))
    ids = whole.select("doc", "pieces").mapInPandas(_assembler(path), "doc long, ids array<int>")
    return ids.unionByName(none).withColumnRenamed("doc", doc_id)
