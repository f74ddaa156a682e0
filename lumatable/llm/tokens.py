"""Encoding of a corpus with a public tokenizer, each shared stretch of text only once.

Texts are cut into chunks where a rolling hash over the last characters says so, so that equal stretches of different documents
give equal chunks. Hashes tell which texts and chunks are shared; each of these is encoded at one place and its ids are joined to
the others, all the rest is encoded where it stands. A cut before white space that follows another character always is a
border of the pattern that splits text before the merges, so ids on both sides stay as they are. At any other cut the join is
repaired: the text is split again from a border before the cut until a border is met that the right chunk has too; from
there on both splittings agree, as they look at nothing behind them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatable.runtime import materialize, salted_lookup, ship, spread, table

#: Characters the rolling hash covers; one in so many borders, and in long stretches one in so many other places, become cuts; longest chunk.
WINDOW, BORDER_EVERY, OTHER_EVERY, LONGEST = 8, 48, 1_024, 4_096
_BASE, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Characters before a cut on which the splitting may depend beyond the last piece: the longest contraction.
_CONTEXT = 3

# Fixed value: the pattern that splits text before the merges, as the rank files' documentation gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value: the white space of Unicode, as `\s` of the pattern has it.
_WHITE = np.array([*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_IS_WHITE = np.zeros(0x3002, dtype=bool)  # the last place stands for all characters beyond
_IS_WHITE[_WHITE] = True


def default_ranks() -> str:
    """The file of the byte-level vocabulary of 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding(hashlib.sha256(ranks).hexdigest()[:12], pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


class Vocabulary:
    """A rank file sent once to each executor; well under a megabyte."""

    def __init__(self, spark: SparkSession, ranks: str | None = None):
        ship(spark)
        with open(ranks or default_ranks(), "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())

    def get(self):
        return _encoding(self.sent.value)


def _rolling(c: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash of the WINDOW characters before each place."""
    h = np.zeros(len(places), dtype=np.uint32)
    for j in range(WINDOW, 0, -1):
        h *= _BASE
        h += c[places - j]
    return (h * _MIX) >> np.uint32(8)


def cuts(text: str) -> list[tuple[int, bool]]:
    """Where to cut a text: (place, whether it is a sure border), without its start and with its end.

    Sure borders are cut where the hash of what stands before says so; stretches without such a cut for LONGEST characters, as scripts
    without spaces have them, in the same way at other places.
    """
    n = len(text)
    if n <= WINDOW:
        return [(n, True)]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sure = _borders(c)
    places = np.nonzero(sure[WINDOW:])[0] + WINDOW
    out, last = [], 0
    for p in [*places[_rolling(c, places) % np.uint32(BORDER_EVERY) == 0].tolist(), n]:
        if p - last > LONGEST:
            inner = np.arange(max(last, WINDOW), p)
            for q in [*inner[_rolling(c, inner) % np.uint32(OTHER_EVERY) == 0].tolist(), p]:
                while q - last > LONGEST:
                    last += LONGEST
                    out.append((last, bool(sure[last])))
                if last < q < p:
                    out.append((q, bool(sure[q])))
                    last = q
        if p < n:
            out.append((p, True))
            last = p
    return [*out, (n, True)]


def _borders(c: np.ndarray) -> np.ndarray:
    """Whether a cut before each character is a sure border: at white space that ends every piece before it, where no white space of any
    kind stands before, as a run of white space is split by what follows it. Cuts before the rarer kinds are only less sure."""
    out = (c == 32) | (c == 10) | (c == 13) | (c == 9)
    out[1:] &= ~_IS_WHITE[np.minimum(c[:-1], len(_IS_WHITE) - 1)]
    return out


def pieces(text: str) -> list[str]:
    return _pattern().findall(text)


def repair(texts: list[str | None], ids: list[np.ndarray], sure: list[bool], encode) -> list[int]:
    """The ids of a document from its chunks' ids. `sure` tells of each chunk whether its end is a sure border; `texts` may
    hold None for chunks with sure borders on both sides. `encode` gives the ids of a text."""
    out: list[int] = []
    tail = ""  # text from a border in the last chunk, where that chunk's end is not a sure border
    tail_ids = 0
    i = 0
    while i < len(ids):
        if not tail:
            out.extend(ids[i])
            text = texts[i]
        else:
            # encode again from the border until the splitting meets one of the right side's own borders
            text, right_ids, more = texts[i], list(ids[i]), 1
            while (joined := _agree(tail, text, encode)) is None and not sure[i] and i + 1 < len(ids):
                # no border of the right side is met: take more chunks to the right, twice as many each time
                step = min(more, len(ids) - i - 1)
                k = next((j for j in range(step) if sure[i + j]), step)
                text = "".join([text, *texts[i + 1 : i + 1 + k]])
                i, more = i + k, more * 2
                right_ids = None
            if tail_ids:
                del out[-tail_ids:]
            if joined is None:
                out.extend(x for p in pieces(tail + text) for x in encode(p))
            else:
                fresh, passed = joined
                out.extend(fresh)
                out.extend(right_ids[passed:] if right_ids is not None else _after(text, passed, encode))
            text = tail + text
        if sure[i]:
            tail, tail_ids = "", 0
        else:
            own = pieces(text)
            keep, length = 0, 0
            while keep < len(own) and length <= _CONTEXT:
                keep += 1
                length += len(own[-keep])
            tail = "".join(own[len(own) - keep :])
            tail_ids = sum(len(encode(p)) for p in own[len(own) - keep :])
        i += 1
    return out


def _after(text: str, n_ids: int, encode) -> list[int]:
    return [x for p in pieces(text) for x in encode(p)][n_ids:]


def _agree(tail: str, text: str, encode) -> tuple[list[int], int] | None:
    """Ids from the start of `tail` to the first border that `text` alone has too, and the number of ids `text` alone has up
    to there; None where no such border lies before the last pieces of `text`."""
    borders, at, passed = {0: 0}, 0, 0
    for p in pieces(text):
        at += len(p)
        passed += len(encode(p))
        borders[at] = passed
    fresh, place = [], -len(tail)
    for p in pieces(tail + text):
        if place >= 0 and place in borders and place < len(text):
            return fresh, borders[place]
        fresh.extend(encode(p))
        place += len(p)
    return None


CUTS = "doc_id bigint, text_key string, hashes array<binary>, ends array<int>, sure array<boolean>"
#: Characters whose ids or cuts a task gathers before it gives them on.
GATHERED_CHARS = 4_000_000
#: Share of all rows from which a key counts as hot, and texts and cuts up to which, once counted, their list is sent to all tasks: some 40 MB.
HOT, MOST_ENTRIES = 0.01, 800_000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of documents; null counts as the empty text, rows without a doc_id are dropped."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return spread(docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.md5(text).alias("text_key")))


def cut_rows(docs: DataFrame) -> DataFrame:
    """Where each text of (doc_id, text, text_key) is cut, and the hash of each chunk; the chunks themselves stay where they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            hashes, ends, sure = [], [], []
            for text in b.column("text").to_pylist():
                found = cuts(text) if text else []
                starts = [0, *(e for e, _ in found[:-1])]
                hashes.append([xxhash.xxh3_128_digest(text[a:e].encode("utf-8", "surrogatepass")) for a, (e, _) in zip(starts, found, strict=False)])
                ends.append([e for e, _ in found])
                sure.append([s for _, s in found])
            lists = (pa.array(hashes, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int32())), pa.array(sure, pa.list_(pa.bool_())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *lists], names=["doc_id", "text_key", "hashes", "ends", "sure"])

    return docs.mapInArrow(split, CUTS)


#: What the encoding pass gives: whole texts, chunks that other places share, and the pieces of texts that hold such chunks.
WHOLE, SHARED, PIECE = 0, 1, 2
ENCODED = "kind int, doc_id bigint, text_key string, n_docs bigint, seq int, sure boolean, piece string, h binary, ids array<int>"


def _segments(text: str, ends: list[int], sure: list[bool], hashes: list[bytes], owned: dict[int, bool]) -> Iterator[tuple]:
    """(seq, end is sure, text where a border is not sure, hash of a shared chunk, text to encode here) of a text with shared chunks;
    neighbouring chunks of its own go together."""
    start, before, open_from = 0, True, None
    for k, end in enumerate(ends):
        if k in owned:
            yield k, sure[k], text[start:end] if not (sure[k] and before) else None, hashes[k], text[start:end] if owned[k] else None
        else:
            if open_from is None:
                open_from, open_sure = start, before
            if k + 1 == len(ends) or k + 1 in owned:
                yield k, sure[k], text[open_from:end] if not (sure[k] and open_sure) else None, None, text[open_from:end]
                open_from = None
        start, before = end, sure[k]


def encode_corpus(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text), without special tokens; their strings in a text are ordinary text.

    Empty and null texts give an empty list. Repeated rows come out once; a doc_id with different texts has a row for each;
    rows without a doc_id are dropped.

    Only hashes are shuffled to find what is shared: of equal texts one is encoded, and of the chunks that stand in several texts, or
    several times in one, each is encoded at one place. All other stretches are encoded where they are read.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(spark, ranks)
    texts = keyed(docs)
    cut = materialize(cut_rows(texts).groupBy("doc_id", "text_key").agg(*(F.first(c).alias(c) for c in ("hashes", "ends", "sure")), (F.count(F.lit(1)) > 1).alias("repeated")), "cuts")
    firsts = materialize(cut.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs")), "firsts")
    chunks = materialize(cut.join(firsts, ["text_key", "doc_id"]).select("text_key", F.posexplode("hashes").alias("seq", "h")), "chunks")
    shared = materialize(chunks.groupBy("h").agg(F.min(F.struct("text_key", "seq")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    hot = shared.where(F.col("n") > chunks.count() * HOT).select("h")  # at most 1 / HOT chunks
    uses = salted_lookup(chunks, shared.drop("n"), "h", hot, spread="text_key")
    owned = F.map_from_entries(F.collect_list(F.struct("seq", (F.struct("text_key", "seq") == F.col("owner")).alias("owns"))))
    plans = uses.groupBy("text_key").agg(owned.alias("owned"))
    # texts without shared chunks need no list of cuts
    todo = firsts.join(plans, "text_key", "left").join(cut, ["text_key", "doc_id"]).select("doc_id", "text_key", "n_docs", "owned", "repeated", *(F.when(F.col("owned").isNotNull(), F.col(c)).alias(c) for c in ("hashes", "ends", "sure")))
    todo = materialize(todo, "todo")
    entries, repeated = todo.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("ends")), F.lit(0)), F.coalesce(F.bool_or("repeated"), F.lit(False))).first()  # one row
    if entries <= MOST_ENTRIES:
        todo = F.broadcast(todo)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rows, ids, chars = vocabulary.get(), [], [], 0
        numbers = lambda t: np.array(enc.encode_ordinary(t), dtype=np.int32)

        def gathered() -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([0 if i is None else len(i) for i in ids])]).astype(np.int32)
            values = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([i is None for i in ids], pa.bool_()))
            types = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate(types)), lists], names=[c.split()[0] for c in ENCODED.split(", ")])

        def put(row: tuple, text: str | None) -> None:
            nonlocal chars
            rows.append(row)
            ids.append(None if text is None else numbers(text))
            chars += len(text or "") + len(row[6] or "")

        for b in batches:
            for doc_id, text, key, n_docs, owns, hashes, ends, sure in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "text_key", "n_docs", "owned", "hashes", "ends", "sure")), strict=True):
                if owns is None:
                    put((WHOLE, doc_id, key, n_docs, None, None, None, None), text)
                else:
                    for seq, end_sure, piece, h, here in _segments(text, ends, sure, hashes, dict(owns)):
                        put((PIECE, doc_id, key, n_docs, seq, end_sure, piece, h), here if h is None else None)
                        if h is not None and here is not None:
                            put((SHARED, None, None, None, None, None, None, h), here)
                if chars >= GATHERED_CHARS:
                    yield gathered()
                    rows, ids, chars = [], [], 0
        if rows:
            yield gathered()

    here = texts.join(todo, ["doc_id", "text_key"])
    if repeated:  # rows that the table holds more than once are met by key, all others stay where they are
        here = here.where("not repeated").unionByName(here.where("repeated").dropDuplicates(["doc_id", "text_key"]))
    encoded = materialize(here.mapInArrow(encode, ENCODED), "encoded")
    pieces = encoded.where(F.col("kind") == PIECE)
    known = encoded.where(F.col("kind") == SHARED).select("h", F.col("ids").alias("shared_ids"))
    asked = pieces.where("h is not null").drop("ids")
    met = salted_lookup(asked, known, "h", hot, spread="text_key").withColumnRenamed("shared_ids", "ids")
    every = met.unionByName(pieces.where("h is null")).groupBy("doc_id", "text_key", "n_docs").agg(F.sort_array(F.collect_list(F.struct("seq", "ids", "sure", "piece"))).alias("parts"), F.bool_or(~F.col("sure")).alias("unsure"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def mend(ids: pd.Series, sure: pd.Series, pieces: pd.Series) -> pd.Series:
        enc = vocabulary.get()
        one = lru_cache(maxsize=100_000)(lambda p: tuple(enc.encode_ordinary(p)))
        return pd.Series([None if i is None else repair(list(t), list(i), list(s), one) for i, s, t in zip(ids, sure, pieces, strict=True)], dtype=object)

    of = lambda f: F.when(F.col("unsure"), F.transform("parts", lambda x: x[f]))
    plain = F.when(~F.col("unsure"), F.flatten(F.transform("parts", lambda x: x["ids"])))
    mended = every.select("doc_id", "text_key", "n_docs", F.coalesce(plain, mend(of("ids"), of("sure"), of("piece"))).alias("ids"))
    done = encoded.where(F.col("kind") == WHOLE).select("doc_id", "text_key", "n_docs", "ids").unionByName(mended)
    several = cut.join(firsts.where("n_docs > 1").select("text_key"), "text_key", "left_semi").select("doc_id", "text_key")
    many = firsts.where(F.col("n_docs") > cut.count() * HOT).select("text_key")  # at most 1 / HOT texts
    copies = salted_lookup(several, done.where("n_docs > 1").select("text_key", "ids"), "text_key", many, spread="doc_id")
    return done.where("n_docs = 1").select("doc_id", "ids").unionByName(copies.select("doc_id", "ids"))


def count_tokens(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of documents (doc_id, text); empty and null texts have none. Repeated doc_ids keep the largest count."""
    vocabulary = Vocabulary(docs.sparkSession, ranks)

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in vocabulary.get().encode_ordinary_batch(["" if t is None else t for t in texts], num_threads=1)], dtype="int32")

    return spread(docs.select("doc_id", "text")).select("doc_id", count(F.col("text")).alias("n_tokens")).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p8_ids: doc_id and token ids of each document."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))
