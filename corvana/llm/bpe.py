"""BPE encoding and decoding over a distinct-word table.

encode: the words of all texts are counted in Spark; each distinct word is encoded once by the tokenizers library;
the ids come back to the documents by the words' positions. The words of most weight (at most `HEAD_WORDS` of them, a
fixed bound) travel as a broadcast dictionary. All other words are rare by construction, so no key is hot: their
(block, word) pairs are joined to the word table by a shuffle and meet the texts of their block of documents there.
decode: ids join the id-to-piece table, which the vocabulary bounds.

A word is a pre-token of the vocabulary's own pattern where a run of text has only plain characters, and a whole run
between white space otherwise, which the library then splits itself. Both cuts leave the ids as they are, since neither
the normalizer nor the pattern looks across them.

Defined results: null and empty text have no ids, and decode to the empty text. Repeated rows and ties each give their
own row. Texts are never cut. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

#: At most so many words are broadcast; about 20 MB.
HEAD_WORDS = 200_000
#: UTF-8 bytes of text in a block of documents.
BLOCK_BYTES = 6_000_000
#: Words that one worker counts before it hands its counts on.
COUNTED_WORDS = 400_000
#: Characters that a task bundles by block before it hands them on.
BUNDLE_CHARS = 40_000_000

#: ASCII and Latin-1 letters but for `<|`, which may begin a special token: there a word is what the pattern below takes.
PLAIN = re.compile(r"[\t-\r -;=-~À-ÖØ-öø-ÿŒœ]*+(?:<(?!\|)[\t-\r -;=-~À-ÖØ-öø-ÿŒœ]*+)*+")
#: The vocabulary's own pattern, after lower-casing, for plain characters.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿœ]+|[0-9]|[!-/:-@\[-`{-~]+")
PIECES, SINGLE = PIECE.findall, PIECE.fullmatch
RUNS = re.compile(r"[^\t-\r ]+").findall


def words_of(text: str) -> list[str]:
    """Words whose ids, one word after the other, are the ids of the text."""
    if PLAIN.fullmatch(text):
        return PIECES(text.lower())
    words: list[str] = []
    for run in RUNS(text):
        if PLAIN.fullmatch(run):
            words += PIECES(run.lower())
        else:
            words.append(run)
    return words


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes plain letters: each UTF-8 byte as a printable character, others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (k for k in range(256) if k not in shown)
    letter = {k: chr(k) for k in shown} | {k: chr(256 + n) for n, k in enumerate(others)}
    return {k: "".join(letter[x] for x in chr(k).encode()) for k in (*range(0xC0, 0x100), 0x152, 0x153)}


def word_encoder(path: str) -> Callable[[str], bytes]:
    """A word's ids as little-endian unsigned 32-bit numbers. A single lower-case pre-token goes to the library's model at
    once; any other word through the library's whole chain."""
    made, letters = tokenizer(path), byte_letters()
    model, whole = made.model, made.encode

    def encode(word: str) -> bytes:
        if SINGLE(word) and "<|" not in word:
            ids = [x.id for x in model.tokenize(word if word.isascii() else word.translate(letters))]
        else:
            ids = whole(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    return encode


def code(word: str) -> int:
    """A word's 64-bit code, by which the rare words of a block are joined; 2 ** -64 is the chance that two words share it."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


class Joined(dict):
    """Words to ids: the broadcast words, and the rare words of a block by their codes."""

    def __init__(self, known: dict[str, bytes], own: dict[int, bytes]):
        super().__init__(known)
        self.own = own

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.own[code(word)]
        return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; counted in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(words_of(text))
                    if len(seen) > COUNTED_WORDS:
                        yield packed(seen)
                        seen = Counter()
        if seen:
            yield packed(seen)

    def packed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """The word table: each distinct word with its ids as little-endian unsigned 32-bit numbers."""
    columns = [f.name for f in words.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            ws = batch.column(columns.index("word")).to_pylist()
            ids = [encode(w) for w in ws]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([code(w) for w in ws], pa.int64()), pa.array(ids, pa.binary())], names=[*columns, "code", "ids"])

    return words.mapInArrow(run, T.StructType([*words.schema.fields, T.StructField("code", T.LongType()), T.StructField("ids", T.BinaryType())]))


def head_bound(words: DataFrame, most: int) -> int:
    """The least count for which at most `most` words occur that often, from the histogram of counts."""
    total, least = 0, None
    histogram = words.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(most + 1)
    for row in histogram.toLocalIterator():
        total += row["k"]
        if total > most:
            break
        least = row["n"]
    return least if least is not None else 1 << 62


def encode(docs: DataFrame, path: str, finish: Callable[[list[np.ndarray]], list[pa.Array]], fields: str, head_words: int = HEAD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Encode docs(doc_id, text): `finish` turns each document's ids into the columns that `fields` names, after doc_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = saved(encoded_words(word_counts(docs), path), "words")
    least = head_bound(words, head_words)
    head = words.where(F.col("n") >= least).select("word", "ids").toPandas()  # at most head_words rows
    heads = spark.sparkContext.broadcast(dict(zip(head["word"], map(bytes, head["ids"]), strict=True)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-size // block_bytes))
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, held = heads.value, {}, 0
        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    own = set(map(code, set(words_of(text)).difference(known)))
                    held += len(own)
                    found.setdefault(b, set()).update(own)
            if held > COUNTED_WORDS:
                yield listed(found)
                found, held = {}, 0
        if found:
            yield listed(found)

    def listed(found: dict[int, set]) -> pa.RecordBatch:
        b = np.repeat(np.array(list(found), np.int32), [len(x) for x in found.values()])
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array([w for x in found.values() for w in x], pa.int64())], names=["block", "code"])

    # Rare words hardly come twice in a block but in one task: what still does is met once by `meet`, and needs no shuffle of its own.
    pairs = blocked.select("block", "text").mapInArrow(rare, "block int, code long")
    tail = words.where(F.col("n") < least).select("code", "ids")
    blockwise = pairs.join(tail, "code").select("block", "code", "ids")

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for doc, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(b, []).append((doc, text or ""))
                size += len(text or "")
            if size > BUNDLE_CHARS:
                yield bundles(held)
                held, size = {}, 0
        if held:
            yield bundles(held)

    def bundles(held: dict[int, list]) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3).compress
        blobs = [press(pickle.dumps(x, protocol=5)) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "bundle"])

    def meet(texts, found):
        own = dict(zip(found["code"].to_pylist(), found["ids"].to_pylist(), strict=True))
        ids_of = Joined(heads.value, own).__getitem__
        lift, out = zstandard.ZstdDecompressor().decompress, []
        for bundle in texts["bundle"].to_pylist():
            docs = pickle.loads(lift(bundle))
            for at in range(0, len(docs), 200):
                part = docs[at : at + 200]
                ids = [np.frombuffer(b"".join(map(ids_of, words_of(text))), np.uint32) for _, text in part]
                out.append(pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), *finish(ids)], names=names))
        return pa.Table.from_batches(out, schema=None if out else empty)

    schema = f"doc_id long, {fields}"
    names = [x.split()[0] for x in schema.split(", ")]
    empty = pa.schema([("doc_id", pa.int64()), *zip(names[1:], [x.type for x in finish([])], strict=True)])
    texts = blocked.select("doc_id", "block", "text").mapInArrow(bundled, "block int, bundle binary")
    return texts.groupBy("block").cogroup(blockwise.groupBy("block")).applyInArrow(meet, schema)


def pieces_table(path: str) -> list[str]:
    """The id-to-piece table, dense over the ids."""
    made = tokenizer(path)
    pieces = made.get_vocab(with_added_tokens=True)
    out = [""] * (max(pieces.values(), default=-1) + 1)
    for piece, k in pieces.items():
        out[k] = piece
    return out


def decoded(ids: np.ndarray, pieces: np.ndarray) -> str:
    """Ids joined to their pieces. A vocabulary without a decoder puts one space between pieces, as the library does."""
    return " ".join(pieces[ids].tolist())


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add to rows, which have an array of ids, the decoded text. Null gives null."""
    table_ = rows.sparkSession.sparkContext.broadcast(pieces_table(path))

    @F.pandas_udf("string")
    def back(column):
        pieces = np.array(table_.value, object)
        return column.map(lambda x: None if x is None else decoded(np.asarray(x, np.int64), pieces))

    return rows.withColumn(text, back(ids))


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, an array of each whole text's ids."""
    return encode(docs, path, lambda ids: [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], "ids array<int>")


def op2(spark, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    pieces = spark.sparkContext.broadcast(pieces_table(path))

    def digests(ids: list[np.ndarray]) -> list[pa.Array]:
        names = np.array(pieces.value, object)
        numbers = np.array([str(k) for k in range(len(names))], object)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(" ".join(numbers[x].tolist())) for x in ids], pa.string()),
            pa.array([sha(decoded(x, names)) for x in ids], pa.string()),
        ]

    return encode(table(spark, sf_dir, "documents"), path, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
