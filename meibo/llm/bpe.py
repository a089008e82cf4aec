"""Byte-level BPE encoding and decoding by a table of distinct words.

Spark splits texts into the tokenizer's words. A task numbers the distinct words of each chunk of
documents (``CHUNK_BYTES`` of text) and writes a document as the numbers of its words. The chunks' words
are dealt by word, so that each distinct word of the whole corpus meets in one place and is encoded
once; its ids go back to the chunks that hold it, and are joined to the documents by position. No table
of all words exists anywhere: a task holds the words of one chunk, or a batch of sorted words.
Decoding joins ids to their pieces, a table as large as the vocabulary.

A chunk is named by the hash of its content. Should a lost task be run again over rows in another order,
its chunks have other names, and a chunk without its words ends the job with an error.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import table, tidy

_SPACE = r"\p{IsWhite_Space}"
#: How a byte-level tokenizer splits a text into words (published with its vocabulary).
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{IsWhite_Space}})|{_SPACE}+"
#: Characters that Spark's regular expressions may not know yet, so that the tokenizer splits their texts.
_UNKNOWN = r"[ࡰ-\x{10FFFF}&&\p{Cn}]"
#: Bytes of text in a chunk, about; a longer text is a chunk of its own.
CHUNK_BYTES = 32 << 20
#: Texts whose words are looked at together.
TEXTS = 512
#: Numbers below these are written in one and two bytes, others in four; none reaches 2^27.
ONE, TWO = 224, 224 + 24 * 256
#: Words whose ids are sent back to their chunks at once.
SENT_WORDS = 1 << 18


def default_tokenizer() -> str:
    """The place of the tokenizer file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[str, ...]:
    """Strings that are a token of their own wherever a text has them, longest first."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted((a["content"] for a in json.load(f)["added_tokens"]), key=len, reverse=True))


def split_text(text: str, path: str) -> list[str]:
    """The words of one text by the tokenizer itself, special tokens being words of their own."""
    import regex

    special = special_tokens(path)
    parts = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str
    out: list[str] = []
    for part in parts:
        out += [part] if part in special else [part[a:b] for _, (a, b) in split(part)] if part else []
    return out


def words_and_rest(text: Column, path: str) -> tuple[Column, Column]:
    """(words of a text, null) or, for a text with special tokens or characters that Spark may not know, (null, the text)."""
    odd = F.regexp_like(text, F.lit(_UNKNOWN))
    for s in special_tokens(path):
        odd = odd | F.contains(text, F.lit(s))
    return F.when(~odd, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.when(odd, text)


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The bytes of every id, from the vocabulary's printable stand-ins."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    vocab = spec["model"]["vocab"] | special
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece.encode() if piece in special else bytes(byte[c] for c in piece)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte plane by byte plane, compressed."""
    wide = np.ascontiguousarray(numbers, dtype="<i8").view(np.uint8).reshape(-1, 8)
    used = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(wide[:, :used].T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def _coded(numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Texts (their word numbers end to end, and where each ends) as bytes: the first byte of all numbers, then the other ones."""
    numbers = numbers.astype(np.int32)
    size = 1 + (numbers >= ONE).astype(np.int8) + (numbers >= TWO)
    rest = np.where(size == 3, numbers - TWO, numbers - ONE)
    first = np.where(size == 1, numbers, np.where(size == 2, ONE + (rest >> 8), ONE + (TWO - ONE) // 256 + (rest >> 24))).astype(np.uint8)
    second, wide = (rest[size == 2] & 255).astype(np.uint8), rest[size == 3]
    wide = np.stack([(wide >> 16) & 255, (wide >> 8) & 255, wide & 255]).astype(np.uint8)
    twos, fours = (np.concatenate(([0], np.cumsum(size == k)))[np.concatenate(([0], ends))] for k in (2, 3))
    pack, out, a = zstandard.ZstdCompressor(level=1).compress, [], 0
    for k, b in enumerate(ends.tolist()):
        more = wide[:, fours[k] : fours[k + 1]].tobytes()
        out.append((b - a).to_bytes(4, "little") + pack(first[a:b].tobytes() + second[twos[k] : twos[k + 1]].tobytes() + more))
        a = b
    return out


def _decoded(data: bytes) -> np.ndarray:
    """The word numbers of one text of ``_coded``."""
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), dtype=np.uint8) if n else np.zeros(0, dtype=np.uint8)
    out, top = raw[:n].astype(np.int64), ONE + (TWO - ONE) // 256
    two, four = np.flatnonzero((out >= ONE) & (out < top)), np.flatnonzero(out >= top)
    high, middle, low = raw[n + len(two) :].reshape(3, -1).astype(np.int64)
    out[two] = ONE + ((out[two] - ONE) << 8) + raw[n : n + len(two)]
    out[four] = TWO + ((out[four] - top) << 24) + (high << 16) + (middle << 8) + low
    return out


def _table(words: pa.Array) -> bytes:
    """The words of a chunk in the order of their numbers."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.string())])) as out:
        out.write_batch(pa.record_batch([words], ["word"]))
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _split_batch(batch: pa.RecordBatch, path: str) -> tuple[list[pa.Array], np.ndarray]:
    """The words of all texts of a batch, end to end, and how many each text has."""
    words, rest = batch.column("words"), batch.column("rest")
    sizes = np.diff(words.offsets.to_numpy())
    parts, low = [], 0
    for k in np.flatnonzero(rest.is_valid().to_numpy(zero_copy_only=False)).tolist():
        own = split_text(rest[k].as_py(), path)
        parts += [words.slice(low, k - low).flatten(), pa.array(own, pa.string())]
        sizes[k], low = len(own), k + 1
    return [*parts, words.slice(low).flatten()], sizes


def numbered(df: DataFrame, path: str, text_col: str, carried: list[str]) -> DataFrame:
    """(chunk, words, numbers, c0, c1, ...): a row with ``words`` for each chunk, and one for each document.

    A chunk's words are numbered from the most frequent on, so that most numbers take one or two bytes.
    """
    words, rest = words_and_rest(F.coalesce(text_col, F.lit("")), path)
    names = [f"c{k}" for k in range(len(carried))]
    source = df.select(words.alias("words"), rest.alias("rest"), *(F.col(c).alias(n) for c, n in zip(carried, names, strict=True)))
    types = [source.schema[n].dataType.simpleString() for n in names]

    kinds: list[pa.DataType] = []

    def chunk(held: list[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        every = pa.concat_arrays([coded.dictionary for _, coded, _ in held]).dictionary_encode()
        own = np.split(every.indices.to_numpy(), np.cumsum([len(coded.dictionary) for _, coded, _ in held])[:-1])
        counts = np.zeros(len(every.dictionary), dtype=np.int64)
        for (_, coded, _), word in zip(held, own, strict=True):
            counts[word] += np.bincount(coded.indices.to_numpy(), minlength=len(word))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        # by the bytes that a number takes, then by the alphabet
        order = pc.sort_indices(every.dictionary).to_numpy()
        order = order[np.argsort((rank[order] >= ONE).astype(np.int8) + (rank[order] >= TWO), kind="stable")]
        rank[order] = np.arange(len(order), dtype=np.int32)
        docs = [_coded(rank[word][coded.indices.to_numpy()], np.cumsum(sizes)) for (_, coded, sizes), word in zip(held, own, strict=True)]
        text = _table(every.dictionary.take(pa.array(order)))
        digest = xxhash.xxh3_64(text)
        for part in docs:
            for d in part:
                digest.update(d)
        name, columns = digest.intdigest() >> 1, ["chunk", "words", "numbers", *names]
        none = lambda n: pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text], pa.binary()), none(1), *(pa.nulls(1, t) for t in kinds)], columns)
        for (rest, _, _), part in zip(held, docs, strict=True):
            n = rest.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), none(n), pa.array(part, pa.binary()), *rest.columns[1:]], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            kinds[:] = [whole.column(n).type for n in names]
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                found, sizes = _split_batch(batch, path)
                words = pa.concat_arrays(found)
                size += words.nbytes
                # the words themselves are let go, and a copy of the columns carried along does not hold the batch
                rest = pa.table([sizes, *(batch.column(n) for n in names)], ["n", *names]).take(pa.array(np.arange(batch.num_rows)))
                held.append((rest.combine_chunks().to_batches()[0], words.dictionary_encode(), sizes))
                batch = found = words = rest = None
                if size > CHUNK_BYTES:
                    yield from chunk(held)
                    held, size = [], 0
            whole = None  # before the next batch is read
        if held:
            yield from chunk(held)

    schema = ", ".join(["chunk long, words binary, numbers binary", *(f"{n} {t}" for n, t in zip(names, types, strict=True))])
    return source.mapInArrow(tidy(run), schema).repartition("chunk")


def encoded_words(chunks: DataFrame, path: str) -> DataFrame:
    """(chunk, word_numbers, sizes, ids): the ids of every chunk's words, each distinct word being encoded once."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("chunk").to_pylist(), batch.column("words"), strict=True):
                if data.is_valid:
                    raw = zstandard.ZstdDecompressor().decompress(data.as_py())
                    words = pa.ipc.open_stream(raw).read_all().column("word").combine_chunks()
                    for low in range(0, len(words), 1 << 16):
                        part = words.slice(low, 1 << 16)
                        number = pa.array(np.arange(low, low + len(part), dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), name)), number], ["word", "chunk", "number"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = _tokenizer(path), (None, [])
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            chunk, number, size = (np.concatenate([h[k] for h in held]) for k in range(3))
            ids = np.concatenate([h[3] for h in held])
            start = np.cumsum(size) - size
            order = np.argsort(chunk, kind="stable")
            cuts = np.flatnonzero(np.diff(chunk[order], prepend=chunk[order[0]] - 1))
            rows = []
            for own in np.split(order, cuts[1:]):
                n = size[own]
                at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((int(chunk[own[0]]), _packed(number[own]), _packed(n), _packed(ids[at])))
            held.clear()
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "word_numbers", "sizes", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = words[1:] if words[0] == last[0] else words
            ids = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            if len(new) < len(words):
                ids.insert(0, last[1])
            last = (words[-1], ids[-1])
            index, n = coded.indices.to_numpy(), np.array([len(x) for x in ids])
            flat = np.array([i for x in ids for i in x], dtype=np.int64)
            size = n[index]
            at = np.repeat((np.cumsum(n) - n)[index] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            held.append((batch.column("chunk").to_numpy(), batch.column("number").to_numpy(), size, flat[at]))
            if sum(len(h[0]) for h in held) >= SENT_WORDS:
                yield sent()
        if held:
            yield sent()

    words = chunks.mapInArrow(tidy(unpack), "word string, chunk long, number int")
    words = words.repartition("word").sortWithinPartitions("word")
    return words.mapInArrow(tidy(encode), "chunk long, word_numbers binary, sizes binary, ids binary")


def _joined(df: DataFrame, path: str, text_col: str, carried: list[str], new: dict[str, tuple[str, pa.DataType]], make: Callable) -> DataFrame:
    """``carried`` and the columns ``new``, made by ``make(ids of all words, their starts and sizes) -> (numbers -> values)``."""
    fields = [df.schema[c] for c in carried]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} {t}" for n, (t, _) in new.items()])
    chunks = numbered(df, path, text_col, carried)

    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        own = docs.filter(docs.column("numbers").is_valid())
        parts = [[_unpacked(x) for x in words.column(c).to_pylist()] for c in ("word_numbers", "sizes", "ids")]
        number, size, ids = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts)
        n = int(number.max()) + 1 if len(number) else 0
        first, count = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        first[number], count[number] = np.cumsum(size) - size, size
        one = make(ids, first, count)
        rows = []
        for data in own.column("numbers"):
            numbers = _decoded(data.as_py())
            if len(numbers) and (numbers.max() >= n or (first[numbers] < 0).any()):
                raise RuntimeError("a chunk's words are missing: its task was run again over rows in another order; checkpoint the input")
            rows.append(one(numbers))
        made = [pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(new), new.values(), strict=True)]
        return pa.table([*(own.column(f"c{k}") for k in range(len(carried))), *made], [*carried, *new])

    words = encoded_words(chunks, path)
    return chunks.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(join, schema)


def encode_column(df: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with ``ids`` (array<int>) in place of any column of that name.

    A null or empty text has no ids. Repeated rows get equal ids; an empty table gives an empty one; texts
    of any length are encoded whole, their words being held at once. Special tokens' strings are encoded as those tokens.
    """
    path = path or default_tokenizer()

    def make(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> Callable:
        def one(numbers: np.ndarray) -> tuple:
            n = count[numbers]
            at = np.repeat(first[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return (ids[at].astype(np.int32),)

        return one

    carried = [c for c in (df.columns if keep is None else keep) if c != "ids"]
    return _joined(df, path, text_col, carried, {"ids": ("array<int>", pa.list_(pa.int32()))}, make)


def round_trip(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens`` and the digests of its ids and of the text decoded from them.

    A null or empty text has no tokens and the digests of the empty string. Repeated rows get equal results,
    an empty table gives an empty one, and texts of any length are taken whole. Columns of the names of the
    new ones are replaced. The ids of a chunk's words are joined to their pieces once, and to the documents by position.
    """
    path = path or default_tokenizer()

    def make(ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> Callable:
        piece, every = pieces(path), ids.tolist()
        spans = [(a, a + n) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        decoded = [b"".join([piece[i] for i in every[a:b]]) for a, b in spans]
        shown = [("".join([f"{i}," for i in every[a:b]])).encode() for a, b in spans]

        def one(numbers: np.ndarray) -> tuple[int, str, str]:
            own = numbers.tolist()
            text = b"".join([decoded[k] for k in own]).decode("utf-8", "replace")
            listed = b"".join([shown[k] for k in own])[:-1]
            return int(count[numbers].sum()), hashlib.sha256(listed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return one

    new = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _joined(df, path, text_col, [c for c in df.columns if c not in (*new, text_col)], new, make)


def decode_ids(ids: list[int], piece: list[bytes]) -> str:
    """Ids joined to their pieces; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([piece[i] for i in ids]).decode("utf-8", "replace")


def decode_column(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` made from ``ids_col``; null ids give null, no ids an empty text."""
    path = path or default_tokenizer()
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decoded string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, piece) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return df.select(*[f.name for f in kept]).mapInArrow(tidy(decode), schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_bpe": op6_bpe}
