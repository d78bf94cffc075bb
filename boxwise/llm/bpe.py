"""Byte-level BPE encoding and decoding.

Encoding splits a text into pieces with the vocabulary's pattern, turns each
piece into byte symbols in a doubly linked list, and applies the merge of
lowest rank first from a priority queue; queue entries whose symbols have
changed since are stale and skipped. Decoding concatenates the vocabulary
strings of the ids. The tokenizer file is read by the driver, whose size is that
of one vocabulary, and broadcast; its path is a parameter.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

# Fixed value: the split pattern of the byte-level pre-tokenizer. White space is
# spelled out as in the Unicode White_Space property.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|"
           r"[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")

CACHE_PIECES = 400_000   # memory bound of one task's piece cache
LONGEST_CACHED = 64
OUT_BYTES = 8_000_000    # size at which a batch is handed back


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Coder:
    """Encoder and decoder of one tokenizer file's content."""

    def __init__(self, content: str):
        import regex
        spec = json.loads(content)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_id = [vocab[s] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.added = added
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    heappush(queue, (found[0], i, new, ids[k], found[1]))
            p = before[i]
            if p >= 0:
                found = merges.get((ids[p], new))
                if found:
                    heappush(queue, (found[0], p, ids[p], new, found[1]))
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode("utf-8")))
        packed = ids.tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def plain(self, text: str) -> bytes:
        get, make = self.cache.get, self.piece
        return b"".join([get(p) or make(p) for p in self.find(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as unsigned 32-bit integers, little-endian."""
        if self.special is None or not self.special.search(text):
            out = self.plain(text)
        else:
            out = b"".join(array("I", [self.added[x]]).tobytes() if x in self.added else self.plain(x)
                           for x in self.special.split(text) if x)
        return out if little_endian() else swapped(out)

    def decode(self, packed: bytes) -> str:
        """The concatenated vocabulary strings; bytes that form no UTF-8 become
        U+FFFD, unknown ids nothing."""
        ids = array("I")
        ids.frombytes(packed if little_endian() else swapped(packed))
        strings = self.strings
        try:
            out = b"".join([strings[i] for i in ids])
        except IndexError:
            out = b"".join(strings[i] for i in ids if i < len(strings))
        return out.decode("utf-8", "replace")


def little_endian() -> bool:
    import sys
    return sys.byteorder == "little"


def swapped(packed: bytes) -> bytes:
    ids = array("I")
    ids.frombytes(packed)
    ids.byteswap()
    return ids.tobytes()


def _coded(df: DataFrame, source: str, tokenizer: str, outputs: list[StructField], work,
           keep_source: bool = True) -> DataFrame:
    """``df`` with further columns, ``work(coder, value) -> tuple`` of one row's
    values; columns of ``df`` with the name of an output are replaced."""
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    names = [o.name for o in outputs]
    keep = [c for c in df.columns if c not in names and (keep_source or c != source)]
    at = len(keep)
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source__"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        coder = Coder(content.value)
        kinds = [pa.binary() if o.dataType == BinaryType() else pa.string() for o in outputs]
        for batch in batches:
            done, pending, held = 0, [], 0
            values = batch.column(at)

            def cut(end, done, pending):
                own = batch.slice(done, end - done)
                cols = [own.column(i) for i in range(at)]
                new = [pa.array([p[i] for p in pending], kinds[i]) for i in range(len(outputs))]
                return pa.RecordBatch.from_arrays(cols + new, names=keep + names)

            for i in range(batch.num_rows):
                row = work(coder, values[i].as_py())
                pending.append(row)
                held += sum(len(x) for x in row if x is not None)
                if held >= OUT_BYTES:
                    yield cut(i + 1, done, pending)
                    done, pending, held = i + 1, [], 0
            if pending:
                yield cut(batch.num_rows, done, pending)

    schema = StructType([f for f in df.schema.fields if f.name != "__source__"] + outputs)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids of the whole
    text). A null text has no ids; special strings of the vocabulary in a text
    become their own id."""
    return _coded(df, text_col, tokenizer, [StructField(ids_col, BinaryType())],
                  lambda coder, t: (coder.encode(t or ""),))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids``; null ids give the empty text."""
    return _coded(df, ids_col, tokenizer, [StructField(text_col, StringType())],
                  lambda coder, x: (coder.decode(bytes(x or b"")),))


def encode_and_decode(df: DataFrame, tokenizer: str, text_col: str = "text",
                      ids_col: str = "ids", decoded_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """Both columns in one pass over the rows: each text's ids, and the text that
    decoding these ids gives."""
    def both(coder: Coder, t: str | None):
        ids = coder.encode(t or "")
        return ids, coder.decode(ids)
    return _coded(df, text_col, tokenizer,
                  [StructField(ids_col, BinaryType()), StructField(decoded_col, StringType())], both, keep_text)


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Null and empty
    texts have 0 tokens; repeated rows give repeated results; an empty table
    gives none."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    coded = encode_and_decode(rows, tokenizer, keep_text=False)
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
