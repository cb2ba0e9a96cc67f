"""URL filters: rules of hosts and path beginnings, found in sorted arrays of 64-bit digests.

The index is a few files of raw numbers and bytes in the shared folder. Spark brings them to every
executor, where tasks map them into memory: a list of rules may be larger than a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm.columns import plain, plain_name
from starwake.llm.text import ascii_lower
from starwake.session import fresh_path
from starwake.sources.files import child_names

#: Rules of a shard, about. A shard is built in one task's memory.
SHARD_RULES = 500_000
#: Spark's xxhash64 has this seed.
SEED = 42
ALLOW, BLOCK = "allow", "block"
#: Between host and path in a key; no rule's host holds it.
GAP = "\0"
_MAGIC = b"urlrules"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lowered; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class UrlIndex:
    """Names of the shards' files in order of digests, and the shapes that keys have.

    ``shapes`` has, for each number of labels in a rule's host, the lengths of the paths in bytes.
    The lengths are distinct, so a list of b bytes has fewer than the root of 2b of them.
    """

    files: tuple[str, ...]
    shapes: dict[int, tuple[int, ...]]
    bits: int


def _shard(digests: np.ndarray, verdicts: np.ndarray, keys: list[bytes]) -> bytes:
    """A file: mark, number of rules, sorted digests, ends of keys, verdicts, keys."""
    ends = np.cumsum([len(key) for key in keys], dtype="<i8")
    parts = [_MAGIC, np.array([len(keys)], dtype="<i8"), digests.astype("<i8"), ends, verdicts]
    return b"".join([part if isinstance(part, bytes) else part.tobytes() for part in parts] + keys)


def _write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests, verdicts, keys = [], [], []
    for batch in batches:
        digests.append(batch.column("_digest").to_numpy())
        verdicts.append(np.array(batch.column("_allow").to_pylist(), dtype=np.uint8))
        keys += [key.encode() for key in batch.column("_key").to_pylist()]
    if keys:
        whole = _shard(np.concatenate(digests), np.concatenate(verdicts), keys)
        yield pa.record_batch([pa.array([whole], pa.binary())], names=["_file"])


def build_index(
    rules: DataFrame,
    host_col: str = "host",
    path_col: str = "path",
    verdict_col: str = "verdict",
    bits: int = 64,
    shard_rules: int = SHARD_RULES,
) -> UrlIndex:
    """Writes the digest arrays of a table of rules and hands them to all executors.

    Hosts are lowered (A-Z). Rules without a host, with a null, or with a verdict other than
    ``allow`` and ``block`` are left out; a missing path fits every path. Of repeated rules one
    stays, and ``block`` wins over ``allow``. An empty table gives an index in which nothing is
    found. ``bits`` below 64 shortens digests, so that tests meet collisions.

    Tasks sort ranges of digests and write them; the driver sees names and lengths only.
    """
    spark = rules.sparkSession
    host = ascii_lower(F.col(host_col).cast("string"))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    allow = F.col(verdict_col) == ALLOW
    kept = rules.where(
        (host != "") & ~F.contains(host, F.lit(GAP)) & F.col(verdict_col).isin(ALLOW, BLOCK)
    )
    keyed = (
        kept.select(F.concat(host, F.lit(GAP), path).alias("_key"), allow.alias("_allow"))
        .groupBy("_key")
        .agg(F.bool_and("_allow").alias("_allow"))
        .withColumn("_digest", F.shiftright(F.xxhash64("_key"), 64 - bits))
    )
    rule_host, rule_path = F.split("_key", GAP, 2)[0], F.split("_key", GAP, 2)[1]
    labels = (F.size(F.split(rule_host, r"\.", -1))).alias("_labels")
    shapes: dict[int, tuple[int, ...]] = {}
    lengths = keyed.groupBy(labels).agg(F.collect_set(F.octet_length(rule_path)).alias("_lengths"))
    for row in lengths.collect():
        shapes[row["_labels"]] = tuple(sorted(row["_lengths"]))
    if not shapes:
        return UrlIndex((), {}, bits)
    shards = 1 + keyed.count() // shard_rules
    out = fresh_path(spark, "url-index")
    # The text writer puts bytes down as they are, and one newline behind a row: with one row a
    # task, each file is a shard.
    (
        keyed.repartitionByRange(shards, "_digest")
        .sortWithinPartitions("_digest", "_key")
        .mapInArrow(_write_shard, "_file binary")
        .select(F.col("_file").cast("string"))
        .write.text(out)
    )
    sized = spark.read.format("binaryFile").load(out).where(F.col("length") > 0).select("path")
    names = {row["path"].rsplit("/", 1)[-1] for row in sized.collect()}
    files = [name for name in child_names(spark, out) if name in names]
    for name in files:
        spark.sparkContext.addFile(f"{out}/{name}")
    return UrlIndex(tuple(files), shapes, bits)


class MappedShard:
    """One file of an index, mapped into memory."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[: len(_MAGIC)].tobytes() != _MAGIC:
            raise ValueError(f"{path} is no shard of a URL index")
        n = int(raw[8:16].view("<i8")[0])
        at = 16 + 8 * n
        self.digests = raw[16:at].view("<i8")
        self.ends = raw[at : at + 8 * n].view("<i8")
        self.allows = raw[at + 8 * n : at + 9 * n]
        self.keys = raw[at + 9 * n :]

    def key(self, row: int) -> bytes:
        begin = int(self.ends[row - 1]) if row else 0
        return self.keys[begin : int(self.ends[row])].tobytes()


class Prober:
    """Finds keys in the shards of an index."""

    def __init__(self, index: UrlIndex, paths: list[str]) -> None:
        self.index = index
        self.shards = [MappedShard(path) for path in paths]
        self.firsts = np.array([shard.digests[0] for shard in self.shards], dtype=np.int64)

    def candidates(self, host: bytes, path: bytes) -> Iterator[tuple[int, int, int]]:
        """Digest, length of the host and of the path of all keys that a rule for this URL can have.

        The digest of a longer path goes on from that of the shorter one.
        """
        at, labels = len(host), 0
        most = max(self.index.shapes, default=0)
        while at > 0 and labels < most:
            at = host.rfind(b".", 0, at)
            labels += 1
            if labels not in self.index.shapes:
                continue
            begin, state = at + 1, xxhash.xxh64(host[at + 1 :] + GAP.encode(), seed=SEED)
            if begin == len(host):
                continue
            done = 0
            for length in self.index.shapes[labels]:
                if length > len(path):
                    break
                state.update(path[done:length])
                done = length
                yield state.intdigest(), len(host) - begin, length

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """The longest rule of each URL and its verdict; of rules of one length that with the
        longer host."""
        where: list[tuple[int, bytes, int]] = []
        digests: list[int] = []
        for at, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            host_bytes, path_bytes = host.encode(), path.encode()
            for digest, of_host, of_path in self.candidates(host_bytes, path_bytes):
                digests.append(digest)
                tail = host_bytes[len(host_bytes) - of_host :]
                where.append((at, tail + GAP.encode() + path_bytes[:of_path], of_host))
        out: list[tuple[str, str] | None] = [None] * len(hosts)
        best = [(-1, -1)] * len(hosts)
        if not self.shards or not digests:
            return out
        wanted = np.array(digests, dtype=np.uint64).view(np.int64) >> (64 - self.index.bits)
        shard_of = np.searchsorted(self.firsts, wanted, side="right") - 1
        for number, shard in enumerate(self.shards):
            asked = np.flatnonzero(shard_of == number)
            left = np.searchsorted(shard.digests, wanted[asked], side="left")
            right = np.searchsorted(shard.digests, wanted[asked], side="right")
            for probe, lo, hi in zip(*(x[right > left].tolist() for x in (asked, left, right)), strict=True):
                at, key, of_host = where[probe]
                for row in range(lo, hi):
                    if shard.key(row) == key:
                        rule = key.replace(GAP.encode(), b"", 1).decode()
                        if (len(rule), of_host) > best[at]:
                            best[at] = len(rule), of_host
                            out[at] = rule, ALLOW if shard.allows[row] else BLOCK
        return out


def _judging(index: UrlIndex, otherwise: str):
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        prober = Prober(index, [SparkFiles.get(name) for name in index.files])
        for hosts, paths in parts:
            found = prober.judge(hosts.tolist(), paths.tolist())
            rows = [(None, otherwise) if one is None else one for one in found]
            yield pd.DataFrame(rows, columns=["rule", "verdict"])

    return F.pandas_udf(judge, "rule string, verdict string")


def judge_urls(
    pages: DataFrame, index: UrlIndex, url_col: str = "url", otherwise: str = ALLOW
) -> DataFrame:
    """Adds ``_host``, ``_path``, ``_rule`` and ``_verdict`` to the rows of ``pages``, whose columns
    are named c0, c1, ... in order.

    A rule fits a URL if its host is the URL's host or ends it behind a dot, and its path begins the
    URL's path. The longest rule (code points of host and path) wins, then the one with the longer
    host. Without a rule the verdict is ``otherwise``: a URL that no list names.

    Null URLs and URLs without ``://`` have empty host and path, and no rule. Repeated rows are
    judged each. An empty table gives an empty result. Of very long hosts only as many labels are
    tried as rules have; a long path is hashed once for each of these.
    """
    rows = plain(pages)
    url = F.col(plain_name(pages, url_col)).cast("string")
    split = rows.withColumns({"_host": host_of(url), "_path": path_of(url)})
    judged = split.withColumn("_judged", _judging(index, otherwise)("_host", "_path"))
    return judged.withColumns({"_rule": F.col("_judged.rule"), "_verdict": F.col("_judged.verdict")}).drop(
        "_judged"
    )
