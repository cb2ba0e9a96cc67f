"""Token ids in files with keyed access.

A file set is a Parquet folder with one row per shard: documents in ascending order of their ids,
their token ids as raw little-endian integers, and a minimal perfect hash index from document keys
to offsets with stored fingerprints. Each shard states its smallest and largest id and is a row
group of its own, so that a reader opens the one it needs. Spark's writer commits whole tasks, so a
lost executor leaves no half-written shard, and any store that Spark reaches will do.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starwake.llm.packed import U64, mixed
from starwake.llm.stored import small_batches
from starwake.session import fresh_path

END_ID = 1
#: Bytes of text in a range of documents, about, and of token ids in a shard.
SHARD_BYTES = 8_000_000
#: Encoded words that a Python worker remembers in each of two generations.
REMEMBERED = 300_000
#: Words that the tokenizer gets at once.
AT_ONCE = 5_000
#: Characters of text that are split into words at once.
SLICE_CHARS = 8_000_000
#: What is split off the end of words of letters.
TAIL = string.punctuation
#: Ranges whose sizes are summed up together.
BLOCK = 4_096

SHARD_SCHEMA = (
    "range bigint, part bigint, n_docs bigint, n_null bigint, low bigint, low_run bigint, high bigint, "
    "high_run bigint, n_tokens bigint, width int, ids binary, keys binary, pilots binary, offsets binary, "
    "prints binary"
)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts word by word and remembers words.

    White space separates tokens of this kind of vocabulary and is dropped, so a text's ids are
    those of its words in order. A word is split once more where letters are followed by punctuation
    only, which is where its pre-tokenizer splits too, if it has nothing but letters after the
    tokenizer's own normalisation. Words of letters are encoded many at a time: each ends with
    the one token that carries the end mark. Arrow numbers words, splits them and gathers their ids;
    each different word or part is looked up once. They are kept in two generations: when the young
    one is full, it becomes the old one, and words met again move back.
    """

    def __init__(self, path: str, width: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype(width)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        mark = self.tokenizer.model.end_of_word_suffix
        if mark:
            self.last[[at for token, at in vocabulary.items() if token.endswith(mark)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _missing(self, words: list[str]) -> list[str]:
        """Those of different words that are not remembered; all others are known then."""
        known, old = self.known, self.old
        new = [word for word in words if word not in known]
        if old:
            known.update((word, old[word]) for word in new if word in old)
            new = [word for word in new if word not in known]
        return new

    def _all_letters(self, cores: list[str]) -> list[bool]:
        """Whether normalisation leaves letters only: a capital may become a letter and a mark."""
        known, old = self.known, self.old
        new = [core for core in dict.fromkeys(cores) if core not in known and core not in old and core.isalpha()]
        found = new
        if self.tokenizer.normalizer is not None:
            normal = self.tokenizer.normalizer.normalize_str
            found = normal(" ".join(new)).split(" ")
            if len(found) != len(new):
                found = [normal(core) for core in new]
        good = {core for core, one in zip(new, found) if one.isalpha()}
        return [core.isalpha() and (core in good or core in known or core in old) for core in cores]

    def _encode(self, words: list[str]) -> None:
        size = self.width.itemsize
        for low in range(0, len(words), AT_ONCE):
            part = words[low : low + AT_ONCE]
            found = [one.ids for one in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            raw = np.array(list(chain.from_iterable(found)), dtype=self.width).tobytes()
            end = 0
            for word, ids in zip(part, found):
                begin, end = end, end + len(ids) * size
                self.known[word] = raw[begin:end]

    def _encode_letters(self, words: list[str]) -> None:
        size = self.width.itemsize
        parts = [words[low : low + 100] for low in range(0, len(words), 100)]
        for low in range(0, len(parts), AT_ONCE // 100):
            some = parts[low : low + AT_ONCE // 100]
            lines = [" ".join(part) for part in some]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(found.ids, dtype=np.int64)
                ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else ids
                if len(ends) != len(part) or ends[-1] != len(ids):
                    self._encode(part)
                    continue
                raw = ids.astype(self.width).tobytes()
                bounds = [0, *(ends * size).tolist()]
                for word, begin, end in zip(part, bounds, bounds[1:]):
                    self.known[word] = raw[begin:end]

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Raw ids of different words."""
        if len(self.known) > REMEMBERED:
            self.old, self.known = self.known, {}
        cores = pc.ascii_rtrim(words, TAIL)
        narrow = pc.string_is_ascii(cores)
        letters = pc.and_(narrow, pc.ascii_is_alpha(cores)).to_numpy(zero_copy_only=False).copy()
        keys = pc.if_else(narrow, pc.ascii_lower(cores), cores)
        wide = np.flatnonzero(~narrow.to_numpy(zero_copy_only=False))
        letters[wide] = self._all_letters(_strings(cores.take(pa.array(wide))))
        split = letters & pc.not_equal(cores, words).to_numpy(zero_copy_only=False)
        numbered = keys.filter(pa.array(letters)).dictionary_encode()
        found = _strings(numbered.dictionary)
        self._encode_letters(self._missing(found))
        tailed = words.filter(pa.array(split))
        kept = pc.utf8_length(cores.filter(pa.array(split))).to_numpy().tolist()
        tails = [word[length:] for word, length in zip(_strings(tailed), kept)]
        # A space before it tells such a word from the letters of others.
        rest = [f" {word}" if word.isalpha() else word for word in _strings(words.filter(pa.array(~letters)))]
        place = {word: at for at, word in enumerate(dict.fromkeys(chain(["", *rest], tails)))}
        self._encode(self._missing(list(place)))

        # The others' ids, the empty word's first, and those of letters after them.
        ids = [self.known[word] for word in chain(place, found)]
        first, second = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        first[letters] = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(place)
        first[~letters] = [place[word] for word in rest]
        second[split] = [place[tail] for tail in tails]
        pool = pa.array(ids, pa.large_binary())
        return pc.binary_join_element_wise(
            pool.take(pa.array(first)), pool.take(pa.array(second)), pa.scalar(b"", pa.large_binary())
        )

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Raw ids of texts, some megabytes of them at once."""
        begin, held = 0, 0
        for at, text in enumerate(texts):
            if held and held + len(text) > SLICE_CHARS:
                yield from self._encode_slice(texts[begin:at])
                begin, held = at, 0
            held += len(text) + 1
        if begin < len(texts):
            yield from self._encode_slice(texts[begin:])
        pa.default_memory_pool().release_unused()

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        """Words are numbered at once; each different one is looked up once, and the ids are gathered
        by number."""
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        parts = pc.split_pattern(spaced, " ")
        numbered = parts.flatten().dictionary_encode()
        raw = self._ids_of(numbered.dictionary).take(numbered.indices)
        _, offsets, data = raw.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        bounds = ends[parts.offsets.to_numpy()].tolist()
        held = memoryview(data or b"")
        return [held[begin:end].tobytes() for begin, end in zip(bounds, bounds[1:])]


def _encoder(path: str, width: str) -> WordEncoder:
    """The encoder of this Python worker, which Spark uses for many tasks: words stay remembered."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_starwake_encoders", {})
    if (path, width) not in kept:
        kept[path, width] = WordEncoder(path, width)
    return kept[path, width]


# Minimal perfect hashing -----------------------------------------------------------------------

_PER_BUCKET = 4


def _slots(keys: np.ndarray, pilot: np.ndarray | int, size: int) -> np.ndarray:
    return (mixed(keys + (np.asarray(pilot, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)) % U64(size)).astype(
        np.int64
    )


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of a minimal perfect hash over different keys, and each key's slot.

    Keys are dealt to buckets of about four; from the largest bucket on, the smallest pilot is
    taken that sends all keys of a bucket to free slots.
    """
    size = len(keys)
    buckets = max(1, -(-size // _PER_BUCKET))
    pilots, slots = np.zeros(buckets, dtype=np.uint32), np.zeros(size, dtype=np.int64)
    of = _buckets(keys, buckets)
    order = np.argsort(of, kind="stable")
    bound = np.searchsorted(of[order], np.arange(buckets + 1))
    taken = np.zeros(size, dtype=bool)
    trials = np.arange(64)
    for bucket in np.argsort(-np.diff(bound), kind="stable"):
        members = order[bound[bucket] : bound[bucket + 1]]
        if not len(members):
            break
        begin = 0
        while True:
            tried = _slots(keys[members][None, :], (begin + trials)[:, None], size)
            free = ~taken[tried].any(axis=1)
            if len(members) > 1:
                ordered = np.sort(tried, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if free.any():
                first = int(free.argmax())
                pilots[bucket] = begin + first
                slots[members] = tried[first]
                taken[tried[first]] = True
                break
            begin += len(trials)
    return pilots, slots


def index_keys(ids: np.ndarray, nth: np.ndarray, null: np.ndarray | bool = False) -> np.ndarray:
    """64-bit keys of (document id, how many documents with the id came before in the shard)."""
    keys = mixed(mixed(ids.astype(np.int64).view(U64)) + nth.astype(U64) * U64(0xD6E8FEB86659FD93))
    return np.where(null, mixed(keys ^ U64(0x2545F4914F6CDD1D)), keys)


class ShardReader:
    """Keyed access to the ids of one shard row."""

    def __init__(self, row) -> None:
        self.ids = np.frombuffer(row.ids, dtype=f"<u{row.width}")
        self.pilots = np.frombuffer(row.pilots, dtype=np.uint32)
        self.offsets = np.frombuffer(row.offsets, dtype=np.int64)
        self.prints = np.frombuffer(row.prints, dtype=np.uint32)
        self.size = len(self.prints)

    def find(self, ids: np.ndarray, nth: np.ndarray, null: np.ndarray | bool = False) -> np.ndarray:
        """Slots of keys, -1 for keys that the shard does not hold (but for 1 of 2^32)."""
        if not self.size or not len(ids):
            return np.full(len(ids), -1, dtype=np.int64)
        keys = index_keys(ids, nth, null)
        slot = _slots(keys, self.pilots[_buckets(keys, len(self.pilots))], self.size)
        return np.where(self.prints[slot] == (keys >> U64(32)).astype(np.uint32), slot, -1)

    def get(self, slot: int) -> np.ndarray:
        return self.ids[self.offsets[2 * slot] : self.offsets[2 * slot + 1]]


class _Shard:
    """Documents gathered for one shard, in order."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.nth: list[int] = []
        self.tokens: list[bytes] = []
        self.held = 0

    def add(self, doc: int | None, raw: bytes) -> None:
        again = bool(self.ids) and self.ids[-1] == doc
        self.nth.append(self.nth[-1] + 1 if again else 0)
        self.ids.append(doc)
        self.tokens.append(raw)
        self.held += len(raw)

    def row(self, number: int, part: int, width: int) -> pd.DataFrame:
        null = np.array([doc is None for doc in self.ids])
        ids = np.array([doc or 0 for doc in self.ids], dtype=np.int64)
        nth = np.array(self.nth, dtype=np.int64)
        keys = index_keys(ids, nth, null)
        pilots, slots = build_index(keys)
        ends = np.cumsum([len(one) // width for one in self.tokens], dtype=np.int64)
        offsets = np.zeros((len(ids), 2), dtype=np.int64)
        offsets[slots, 0] = np.concatenate([[0], ends[:-1]])
        offsets[slots, 1] = ends
        prints = np.zeros(len(ids), dtype=np.uint32)
        prints[slots] = (keys >> U64(32)).astype(np.uint32)
        named = ids[~null]
        low, high = (int(named[0]), int(named[-1])) if len(named) else (None, None)
        row = {
            "range": number,
            "part": part,
            "n_docs": len(ids),
            "n_null": int(null.sum()),
            "low": low,
            "low_run": int((named == low).sum()) if len(named) else 0,
            "high": high,
            "high_run": int((named == high).sum()) if len(named) else 0,
            "n_tokens": int(ends[-1]),
            "width": width,
            "ids": b"".join(self.tokens),
            "keys": np.stack([ids, nth], 1).tobytes(),
            "pilots": pilots.tobytes(),
            "offsets": offsets.tobytes(),
            "prints": prints.tobytes(),
        }
        return pd.DataFrame([row]).astype({"low": "Int64", "high": "Int64"})


# Writing and reading ---------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    width: int = 2,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode all documents and write them below ``path`` in ascending order of their ids.

    Null texts count as empty and have the end id only. Null ids come first. Rows that share an id
    are ordered by the hashes of their texts and told apart by how many came before. ``width`` is the
    bytes of one token id. Without rows no shard is written. Other columns are not read.

    Texts are range-partitioned by (id, hash), so rows of a hot id spread too; each task encodes its
    range in order and cuts it into shards of about ``shard_bytes``, whatever the lengths of texts. A
    very long text is encoded whole and is a shard of its own. The driver holds nothing per shard.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
    )
    total = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    ranged = rows.repartitionByRange(int(total // shard_bytes) + 1, *order).sortWithinPartitions(*order)
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path, f"<u{width}")
        number, part, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            docs = [None if pd.isna(doc) else int(doc) for doc in batch["_id"].astype(object)]
            for doc, raw in zip(docs, encoder.encode([text or "" for text in batch["_text"]])):
                shard.add(doc, raw + end)
                if shard.held >= shard_bytes:
                    yield shard.row(number, part, width)
                    part, shard = part + 1, _Shard()
        if shard.ids:
            yield shard.row(number, part, width)

    with small_batches(spark, rows=10_000):
        (
            ranged.select(F.col("_id").cast("string").alias("_id"), "_text")
            .mapInPandas(packed, SHARD_SCHEMA)
            .write.mode("overwrite")
            .option("compression", "none")
            # Each shard is a row group, so that statistics of its ids spare its payload.
            .option("parquet.block.size", 1 << 16)
            .option("parquet.page.size.row.check.min", 1)
            .option("parquet.page.size.row.check.max", 1)
            .option("parquet.block.size.row.check.min", 1)
            .option("parquet.block.size.row.check.max", 1)
            .parquet(path)
        )


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Of each shard, what came before: ``start`` (token ids), ``before_low`` and ``before_null``
    (documents of its smallest id, and of the null id).

    Sums run within blocks of ranges and over blocks, so that no window holds all shards.
    """
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path).drop("ids", "keys", "pilots", "offsets", "prints")
    shards = rows.withColumn("_block", F.floor(F.col("range") / BLOCK))
    before = (Window.unboundedPreceding, -1)
    blocks = shards.groupBy("_block").agg(F.sum("n_tokens").alias("_of"))
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_of").over(Window.orderBy("_block").rowsBetween(*before)), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("_block").orderBy("range", "part").rowsBetween(*before)
    placed = shards.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(blocks, "_block")
    starts = placed.select("range", "part", (F.col("_base") + F.col("_in")).alias("start"))
    # The documents of one id lie in a row of shards: each but the last ends with them.
    null = shards.where(F.col("n_null") > 0).withColumn("_id", F.lit(None).cast("bigint"))
    named = shards.where(F.col("low").isNotNull())
    own = ["range", "part", "_id"]
    ends = named.withColumn("_id", F.col("high")).select(*own, F.col("high_run").alias("_add"), F.lit(1).alias("_last"))
    ends = ends.union(null.select(*own, "n_null", F.lit(1)))
    asks = named.withColumn("_id", F.col("low")).select(*own, F.lit(0).cast("bigint"), F.lit(0))
    asks = asks.union(null.select(*own, F.lit(0).cast("bigint"), F.lit(0)))
    earlier = Window.partitionBy("_id").orderBy("range", "part", "_last").rowsBetween(*before)
    runs = (
        ends.union(asks)
        .withColumn("_before", F.coalesce(F.sum("_add").over(earlier), F.lit(0)))
        .where(F.col("_last") == 0)
        .groupBy("range", "part")
        .agg(
            F.coalesce(F.max(F.when(F.col("_id").isNotNull(), F.col("_before"))), F.lit(0)).alias("before_low"),
            F.coalesce(F.max(F.when(F.col("_id").isNull(), F.col("_before"))), F.lit(0)).alias("before_null"),
        )
    )
    return starts.join(runs, ["range", "part"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a file set, looked up by key through the index of its shard.

    ``doc_id``, ``nth`` (documents with the same id before it), ``start`` (ids of all documents
    before it), ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers).
    """

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                reader = ShardReader(row)
                keys = np.frombuffer(row.keys, dtype=np.int64).reshape(-1, 2)
                null = np.arange(len(keys)) < row.n_null
                slots = reader.find(keys[:, 0], keys[:, 1], null)
                if (slots < 0).any():
                    raise ValueError(f"shard {row.range}.{row.part}: a key is not in the index")
                begin = reader.offsets[2 * slots]
                sums = [zlib.crc32(reader.get(slot).astype("<u4").tobytes()) for slot in slots]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(keys[:, 0], dtype="Int64").mask(null),
                        "nth": keys[:, 1],
                        "range": row.range,
                        "part": row.part,
                        "first": np.arange(len(keys)) < row.n_null + row.low_run,
                        "begin": begin,
                        "n_tokens": reader.offsets[2 * slots + 1] - begin,
                        "ids_crc32": np.array(sums, dtype=np.int64),
                    }
                )

    schema = (
        "doc_id bigint, nth bigint, range bigint, part bigint, first boolean, begin bigint, "
        "n_tokens bigint, ids_crc32 bigint"
    )
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).drop("low", "high")
    found = shards.mapInPandas(looked_up, schema)
    earlier = F.when(F.col("doc_id").isNull(), F.col("before_null")).when(F.col("first"), F.col("before_low"))
    return found.join(shard_starts(spark, path), ["range", "part"]).select(
        "doc_id",
        (F.col("nth") + F.coalesce(earlier, F.lit(0))).alias("nth"),
        (F.col("start") + F.col("begin")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def shards_of(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """The shards that may hold documents of these ids: others are skipped by their statistics."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    near = F.lit(False)
    for one in wanted:
        near = near | ((F.col("low") <= one) & (F.col("high") >= one))
    return shards.where(near)


def lookup(spark: SparkSession, path: str, wanted: list[int]) -> dict[int, np.ndarray]:
    """Token ids of a few documents, by key: only shards whose ids span a key are opened, and their
    index gives the place.

    For use from a program that needs single documents; ``wanted`` is a short list, and documents
    that share an id give the first one's ids.
    """
    keys = np.array(wanted, dtype=np.int64)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                reader = ShardReader(row)
                near = keys[(keys >= row.low) & (keys <= row.high)]
                for key, slot in zip(near, reader.find(near, np.zeros(len(near), dtype=np.int64))):
                    if slot >= 0:
                        ids = reader.get(slot).astype("<u4").tobytes()
                        yield pd.DataFrame({"doc_id": [key], "range": row.range, "part": row.part, "ids": [ids]})

    schema = "doc_id bigint, range bigint, part bigint, ids binary"
    found = shards_of(spark, path, wanted).mapInPandas(taken, schema)
    first: dict[int, np.ndarray] = {}
    for row in sorted(found.collect(), key=lambda row: (row["range"], row["part"])):
        first.setdefault(row["doc_id"], np.frombuffer(row["ids"], dtype="<u4"))
    return first


def token_digest(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` as token files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(spark, path)
