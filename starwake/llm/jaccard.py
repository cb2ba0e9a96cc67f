"""Similarity join of documents on their sets of word shingles, with set-relation skipping.

Two documents link when the Jaccard similarity of their sets is at least a threshold. Sets meet in
inverted lists of the rare tokens at their front, as in any prefix filter. Two relations of sets
spare most of the work:

* Lists are cut into blocks by size. Each entry knows from its position how many tokens it can still
  share and how many it needs; entries and whole lists that cannot reach the threshold with a set of
  another component are skipped.
* The answers of all sets of a list are derived from those of one leader. A set that links with it is
  answered: it belongs to the component. For two sets x, y at least as large as the leader B, if x
  does not link with B then x and y can only link by a token outside of B, because |x & y & B| <=
  |x & B| is below what a link needs. So only what differs from B is indexed for the next round, and
  a group of near copies costs about one comparison per copy, not all pairs. Lists led by sets of one
  component share the smallest of them as leader, so a set is indexed anew once per component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.llm import packed
from starwake.llm.columns import plain, plain_name, restored
from starwake.llm.components import connected
from starwake.llm.packed import U64, mixed
from starwake.llm.stored import Scratch, filtered_joins, small_batches

SHINGLE = 5
#: Links need 100 * shared >= PERCENT * united.
PERCENT = 80
#: Tokens that a bucket of token hashes holds, about.
BUCKET_TOKENS = 1_000_000
#: Entries of lists that a task holds before it hands them on.
FRAME_ENTRIES = 200_000
#: Pairs between components per entry up to which a list's pairs are all compared.
DIRECT = 8
#: Times that the sets of a round's lists are compared with leaders, at most.
STEPS = 4
#: Tokens that a task gathers before it sends them to their buckets.
CHUNK_TOKENS = 500_000

_FACTORS = mixed(np.arange(1, 2 * SHINGLE + 1, dtype=np.uint64)) | U64(1)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text: sorted 64-bit hashes of its distinct shingles.

    Words are runs other than ``[\\x20\\x09-\\x0D]``, A-Z lowered. Fewer words than a shingle count
    as one; no words give an empty set.
    """
    for low, high in packed.slices(texts):
        words = packed.find_words(texts[low:high], ~packed.BLANK)
        hashes, first = words.hash, words.first
        full = len(hashes) - SHINGLE + 1
        tokens = np.zeros(0, dtype=U64)
        if full > 0:
            tokens = hashes[:full] * _FACTORS[0]
            for step in range(1, SHINGLE):
                tokens += hashes[step : step + full] * _FACTORS[step]
            tokens = mixed(tokens)
        for begin, end in zip(first[:-1], first[1:]):
            if end - begin >= SHINGLE:
                yield np.unique(tokens[begin : end - SHINGLE + 1])
            elif end > begin:
                few = (hashes[begin:end] * _FACTORS[SHINGLE : SHINGLE + end - begin]).sum(keepdims=True)
                yield mixed(few + U64(end - begin))
            else:
                yield tokens[:0]


def _prints(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = mixed(tokens).sum(dtype=U64)
    two = mixed(tokens ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _measure(docs: DataFrame) -> DataFrame:
    """``_id``, ``_n`` (set size) and two prints of every row's set."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(s), *_prints(s)) for s in shingle_sets(packed.encoded(batch["_text"]))]
            frame = pd.DataFrame(rows, columns=["_n", "_p1", "_p2"])
            frame.insert(0, "_id", batch["_id"].array)
            yield frame

    return docs.mapInPandas(measured, "_id bigint, _n bigint, _p1 bigint, _p2 bigint")


# Which tokens do other sets have? ---------------------------------------------------------------


def _by_bucket(
    runs: list[tuple[int, np.ndarray]], buckets: int, low_bits: bool
) -> Iterator[dict]:
    """Rows (bucket, names, sizes and tokens of a part of each set) for sets with their names.

    With many buckets a part is one token, so what stands beside it decides how much is shuffled: counts
    take as few bytes as the largest of a row needs, and low bits go without the sizes of their sets.
    """
    names = np.array([name for name, _ in runs], dtype=np.int64)
    sizes = np.array([len(tokens) for _, tokens in runs], dtype=np.int32)
    flat = np.concatenate([tokens for _, tokens in runs])
    owner = np.repeat(np.arange(len(runs), dtype=np.int32), sizes)
    bucket = ((flat >> U64(32)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    flat, owner, bucket = flat[order], owner[order], bucket[order]
    bound = np.searchsorted(bucket, np.arange(buckets + 1))
    for at in range(buckets):
        a, b = bound[at], bound[at + 1]
        if a == b:
            continue
        first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        of = owner[a:b][first]
        part = flat[a:b]
        counts = np.diff(np.append(first, b - a))
        yield {
            "_bucket": at,
            "_names": names[of].tobytes(),
            "_sizes": b"" if low_bits else sizes[of].tobytes(),
            "_counts": counts.astype(np.min_scalar_type(counts.max())).tobytes(),
            "_tokens": (part.astype(np.uint32) if low_bits else part).tobytes(),
        }


_BUCKET_SCHEMA = "_bucket int, _names binary, _sizes binary, _counts binary, _tokens binary"


class _Bucket:
    """All parts of sets in one bucket, one part per name."""

    def __init__(self, frame: pd.DataFrame, kind: type) -> None:
        names = np.frombuffer(b"".join(frame["_names"]), dtype=np.int64)
        sizes = np.frombuffer(b"".join(frame["_sizes"]), dtype=np.int32)
        counts = [
            np.frombuffer(raw, dtype=f"u{8 * len(raw) // len(of)}").astype(np.int32)
            for raw, of in zip(frame["_counts"], frame["_names"])
        ]
        counts = np.concatenate(counts)
        tokens = np.frombuffer(b"".join(frame["_tokens"]), dtype=kind)
        self.names, first = np.unique(names, return_index=True)
        self.sizes = sizes[first] if len(sizes) else sizes
        self.owner = np.full(len(names), -1, dtype=np.int32)
        self.owner[first] = np.arange(len(first), dtype=np.int32)
        owner = np.repeat(self.owner, counts)
        self.tokens, self.owner = tokens[owner >= 0], owner[owner >= 0]

    def frequencies(self) -> np.ndarray:
        """Of each token, how many different sets have it."""
        order = np.argsort(self.tokens, kind="stable")
        first = np.flatnonzero(np.diff(self.tokens[order], prepend=0) != 0)
        if len(order) and (not len(first) or first[0] != 0):
            first = np.append(0, first)
        owners = self.owner[order]
        run = np.diff(np.append(first, len(order)))
        # Low bits can join two tokens of one set: such a run counts its different owners only.
        same = np.minimum.reduceat(owners, first) == np.maximum.reduceat(owners, first) if len(first) else run
        out = np.empty(len(order), dtype=np.int32)
        out[order] = np.repeat(np.where(same, 1, run), run)
        return out


def _send(docs: DataFrame, buckets: int) -> DataFrame:
    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for tokens in shingle_sets(packed.encoded(batch["_text"])):
                if len(tokens):
                    runs.append((_prints(tokens)[0], tokens))
                    held += len(tokens)
                if held >= CHUNK_TOKENS:
                    yield pd.DataFrame(list(_by_bucket(runs, buckets, low_bits=True)))
                    runs, held = [], 0
        if runs:
            yield pd.DataFrame(list(_by_bucket(runs, buckets, low_bits=True)))

    return docs.mapInPandas(sent, _BUCKET_SCHEMA)


def _need(size: Column) -> Column:
    """Tokens that a set of this size shares with any set it links with, at least."""
    return F.ceil(size * PERCENT / 100)


def _sharing_sets(docs: DataFrame, buckets: int) -> DataFrame:
    """First prints of sets and how many of their tokens (``_often``) some other set has too.

    Tokens are dealt to buckets by their hashes; 32 further bits stand for them there, which can
    only find too many tokens shared. Buckets send back counts of the sets that share any in them, at
    most one for each shared token; they are packed as the tokens are and summed up in as many parts
    as there are buckets, so a part holds no more of them than a bucket holds tokens.
    """

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = _Bucket(frame, np.uint32)
        shared = np.bincount(bucket.owner[bucket.frequencies() > 1], minlength=len(bucket.names))
        some = np.flatnonzero(shared)
        part = (bucket.names[some].view(U64) % U64(buckets)).astype(np.int64)
        some, part = some[np.argsort(part, kind="stable")], np.sort(part)
        rows = []
        for low, high in zip(first := np.flatnonzero(np.diff(part, prepend=-1)), [*first[1:], len(part)]):
            chosen = some[low:high]
            row = (bucket.names[chosen], shared[chosen].astype(np.int32))
            rows.append((int(part[low]), *(one.tobytes() for one in row)))
        return pd.DataFrame(rows, columns=["_part", "_names", "_counts"])

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(frame["_names"]), dtype=np.int64)
        counts = np.frombuffer(b"".join(frame["_counts"]), dtype=np.int32)
        order = np.argsort(names, kind="stable")
        first = np.flatnonzero(np.diff(names[order], prepend=~names[order][:1]))
        often = np.add.reduceat(counts[order].astype(np.int64), first)
        return pd.DataFrame({"_p1": names[order][first], "_often": often})

    return (
        _send(docs, buckets)
        .groupBy("_bucket")
        .applyInPandas(counted, "_part bigint, _names binary, _counts binary")
        .groupBy("_part")
        .applyInPandas(summed, "_p1 bigint, _often bigint")
    )


def _ordered_sets(texts: DataFrame, buckets: int) -> DataFrame:
    """``_rep``, ``_n``, ``_k`` and ``_shared``: the k tokens that another of these sets has, the
    rarest first. ``texts`` has rows of the classes' first ids, with the prints of their classes; a row
    whose set has other prints shares the id only."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in batches:
            sets = shingle_sets(packed.encoded(batch["_text"]))
            for tokens, rep, p1, p2 in zip(sets, batch["_rep"], batch["_p1"], batch["_p2"]):
                if len(tokens) and _prints(tokens) == (p1, p2):
                    runs.append((rep, tokens))
                    held += len(tokens)
                if held >= CHUNK_TOKENS:
                    yield pd.DataFrame(list(_by_bucket(runs, buckets, low_bits=False)))
                    runs, held = [], 0
        if runs:
            yield pd.DataFrame(list(_by_bucket(runs, buckets, low_bits=False)))

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = _Bucket(frame, U64)
        often = bucket.frequencies()
        shared = np.flatnonzero(often > 1)
        shared = shared[np.argsort(bucket.owner[shared], kind="stable")]
        bound = np.searchsorted(bucket.owner[shared], np.arange(len(bucket.names) + 1))
        some = np.flatnonzero(np.diff(bound))
        return pd.DataFrame(
            {
                "_rep": bucket.names[some],
                "_n": bucket.sizes[some].astype(np.int64),
                "_t": [bucket.tokens[shared[bound[at] : bound[at + 1]]].tobytes() for at in some],
                "_f": [often[shared[bound[at] : bound[at + 1]]].tobytes() for at in some],
            }
        )

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shared = []
            for parts in batch["_parts"]:
                tokens = np.frombuffer(b"".join(part["_t"] for part in parts), dtype=U64)
                often = np.frombuffer(b"".join(part["_f"] for part in parts), dtype=np.int32)
                shared.append(tokens[np.lexsort((tokens, often))])
            yield pd.DataFrame(
                {
                    "_rep": batch["_rep"],
                    "_n": batch["_n"],
                    "_k": [len(one) for one in shared],
                    "_shared": [one.tobytes() for one in shared],
                }
            )

    parts = (
        texts.mapInPandas(sent, _BUCKET_SCHEMA)
        .groupBy("_bucket")
        .applyInPandas(ranked, "_rep bigint, _n bigint, _t binary, _f binary")
        .groupBy("_rep", "_n")
        .agg(F.collect_list(F.struct("_t", "_f")).alias("_parts"))
    )
    ordered = parts.mapInPandas(joined, "_rep bigint, _n bigint, _k bigint, _shared binary")
    return ordered.where(F.col("_k") >= _need(F.col("_n")))


# Lists, leaders and answers ----------------------------------------------------------------------


def _band(size: np.ndarray) -> np.ndarray:
    """Blocks of sizes; sets that link are in the same block or in adjacent ones."""
    return np.floor(np.log(size) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)


_LIST_SCHEMA = "_scope bigint, _token bigint, _band bigint, _rep bigint, _n bigint, _need bigint, _left bigint, _before bigint"
_LIST = ["_scope", "_token", "_band"]


class _Entries:
    """Entries of lists, gathered until there are enough for a frame."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.held = 0

    def add(
        self, scope: int, band: int, rep: int, n: int, need: int, tokens: np.ndarray, left: int, before: int
    ) -> None:
        """A set under some tokens; ``left`` can be shared from the first one on, ``before`` are rarer."""
        self.parts.append((scope, band, rep, n, need, tokens, left, before))
        self.held += len(tokens)

    def frames(self, least: int = FRAME_ENTRIES) -> Iterator[pd.DataFrame]:
        if not self.held or self.held < least:
            return
        counts = [len(part[5]) for part in self.parts]
        columns = {
            name: np.repeat(np.array([part[at] for part in self.parts], dtype=np.int64), counts)
            for at, name in ((0, "_scope"), (1, "_band"), (2, "_rep"), (3, "_n"), (4, "_need"))
        }
        columns["_token"] = np.concatenate([part[5] for part in self.parts]).view(np.int64)
        columns["_left"] = np.concatenate([part[6] - np.arange(len(part[5])) for part in self.parts])
        columns["_before"] = np.concatenate([part[7] + np.arange(len(part[5])) for part in self.parts])
        self.parts, self.held = [], 0
        yield pd.DataFrame(columns)[_ENTRY]


_ENTRY = [*_LIST, "_rep", "_n", "_need", "_left", "_before"]


def _first_lists(ordered: DataFrame) -> DataFrame:
    """Entries of the first lists: a set under each shared token of its prefix.

    The tokens that no other set has come first in the order and need no list. ``_need`` is how many
    tokens the set shares with any set it links with, ``_left`` how many it has from this token on, and
    ``_before`` how many rarer ones.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = _Entries()
        for batch in batches:
            bands = _band(batch["_n"].to_numpy())
            for rep, n, k, band, raw in zip(batch["_rep"], batch["_n"], batch["_k"], bands, batch["_shared"]):
                need = -(-n * PERCENT // 100)
                tokens = np.frombuffer(raw, dtype=U64)[: max(0, k - need + 1)]
                entries.add(0, band, rep, n, need, tokens, k, n - k)
                entries.add(0, band + 1, rep, n, need, tokens, k, n - k)
                yield from entries.frames()
        yield from entries.frames(0)

    return ordered.mapInPandas(listed, _LIST_SCHEMA)


def _with_sets(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """Adds the sets of ``_rep`` and ``_lead``, for Python to compare."""
    own = ordered.select(F.col("_rep").alias("_r1"), F.col("_n"), F.col("_shared"))
    led = ordered.select(
        F.col("_rep").alias("_r2"), F.col("_n").alias("_lead_n"), F.col("_shared").alias("_lead_shared")
    )
    return (
        pairs.join(own, F.col("_rep") == F.col("_r1"))
        .drop("_r1")
        .join(led, F.col("_lead") == F.col("_r2"))
        .drop("_r2")
    )


def _linked(pairs: DataFrame, ordered: DataFrame) -> DataFrame:
    """The pairs that link, as ``_a`` and ``_b``."""

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = []
            for one, other in zip(batch["_shared"], batch["_lead_shared"]):
                left, right = np.frombuffer(one, dtype=U64), np.frombuffer(other, dtype=U64)
                both.append(len(np.intersect1d(left, right, assume_unique=True)))
            shared = np.array(both, dtype=np.int64)
            united = batch["_n"].to_numpy() + batch["_lead_n"].to_numpy() - shared
            yield batch.loc[100 * shared >= PERCENT * united, ["_rep", "_lead"]]

    found = _with_sets(pairs, ordered).mapInPandas(linked, "_rep bigint, _lead bigint")
    return found.select(F.col("_rep").alias("_a"), F.col("_lead").alias("_b"))


def _outside(members: DataFrame, ordered: DataFrame) -> DataFrame:
    """Entries of the next lists: sets under their tokens outside the leader.

    A partner is no smaller than the leader, nor than PERCENT of the set, so a link needs
    PERCENT / (100 + PERCENT) of both sizes in shared tokens, of which the set can share no more
    inside the leader than it shares with the leader. The rest has to come from outside: this is
    ``_need``, and sets the length of the prefix, rarest first.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = _Entries()
        columns = ["_next", "_band", "_rep", "_n", "_lead_n", "_shared", "_lead_shared"]
        for batch in batches:
            for scope, band, rep, n, lead_n, one, other in zip(*(batch[name] for name in columns)):
                own, lead = np.frombuffer(one, dtype=U64), np.frombuffer(other, dtype=U64)
                out = own[~np.isin(own, lead, assume_unique=True)]
                partner = max(lead_n, -(-n * PERCENT // 100))
                inside = len(own) - len(out)
                need = max(1, -(-(n + partner) * PERCENT // (100 + PERCENT)) - inside)
                entries.add(scope, band, rep, n, need, out[: max(0, len(out) - need + 1)], len(out), n - len(own))
                yield from entries.frames()
        yield from entries.frames(0)

    return _with_sets(members, ordered).mapInPandas(listed, _LIST_SCHEMA)


def _live(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries that can still link with an entry of their list in another component, with ``_comp``.

    Of each list two numbers are enough: the most tokens left of any entry, and the most left of
    those in other components than that one. An entry that needs more than the entries of other
    components have left is skipped, and with it whole lists of one component.
    """
    met = lists.join(comps, F.col("_rep") == F.col("_node"), "left").drop("_node")
    placed = met.withColumn("_comp", F.coalesce("_comp", "_rep"))
    of_comp = placed.groupBy(*_LIST, "_comp").agg(F.max("_left").alias("_left"))
    top = of_comp.groupBy(*_LIST).agg(F.max(F.struct("_left", "_comp")).alias("_top"))
    second = (
        of_comp.join(top, _LIST)
        .where(F.col("_comp") != F.col("_top._comp"))
        .groupBy(*_LIST)
        .agg(F.first("_top").alias("_top"), F.max("_left").alias("_second"))
    )
    others = F.when(F.col("_comp") == F.col("_top._comp"), F.col("_second")).otherwise(F.col("_top._left"))
    return placed.join(second, _LIST).where(F.col("_need") <= others).select(*_ENTRY, "_comp")


def _led(entries: DataFrame, direct: int) -> DataFrame:
    """Entries with the leader and the centre of their list, with their sizes and components.

    The smallest set of a list names a component; the leader is the smallest set which that
    component has in any list of the scope and block. It is no larger than any set of the list and
    serves all lists that the component leads. The centre is the set with the fewest tokens rarer
    than that of the list: of edited copies the least edited one, which links with the most others.

    ``_whole`` marks lists with at most ``direct`` times as many pairs between components as entries;
    ``_big`` is the component with the most entries of a list.
    """
    of_comp = entries.groupBy(*_LIST, "_comp").agg(
        F.min(F.struct("_n", "_rep")).alias("_small"),
        F.min(F.struct("_before", "_rep", "_n")).alias("_central"),
        F.count(F.lit(1)).alias("_of"),
    )
    square = F.col("_of") * F.col("_of")
    lists = of_comp.groupBy(*_LIST).agg(
        F.min(F.struct("_small", "_comp")).alias("_first"),
        F.min(F.struct("_central", "_comp")).alias("_middle"),
        F.max(F.struct("_of", "_comp")).alias("_most"),
        F.sum("_of").alias("_all"),
        F.sum(square).alias("_squares"),
    )
    chosen = of_comp.groupBy("_scope", "_band", "_comp").agg(F.min("_small").alias("_chosen"))
    between = (F.col("_all") * F.col("_all") - F.col("_squares")) / 2
    leads = (
        lists.withColumn("_comp", F.col("_first._comp"))
        .join(chosen, ["_scope", "_band", "_comp"])
        .select(
            *_LIST,
            F.col("_comp").alias("_lead_comp"),
            F.col("_chosen._rep").alias("_lead"),
            F.col("_chosen._n").alias("_lead_n"),
            F.col("_middle._comp").alias("_centre_comp"),
            F.col("_middle._central._rep").alias("_centre"),
            F.col("_middle._central._n").alias("_centre_n"),
            F.col("_most._comp").alias("_big"),
            (between <= direct * F.col("_all")).alias("_whole"),
        )
    )
    return entries.join(leads, _LIST)


def _pairs_with(led: DataFrame, name: str) -> DataFrame:
    """Pairs of entries with the leader or centre of their list, if it is in another component."""
    n, other = F.col("_n"), F.col(f"{name}_n")
    close = 100 * F.least(n, other) >= PERCENT * F.greatest(n, other)
    return led.where((F.col("_comp") != F.col(f"{name}_comp")) & close).select(
        "_rep", F.col(name).alias("_lead")
    )


def _pairs_between(whole: DataFrame) -> DataFrame:
    """Pairs of entries of different components that can reach what both need.

    One of each pair is not of the list's largest component, so the join looks at no more than four
    times the pairs that the list has between components, which ``_whole`` bounds by its entries.
    """
    other = whole.select(
        *_LIST,
        F.col("_rep").alias("_other"),
        F.col("_comp").alias("_other_comp"),
        F.col("_need").alias("_other_need"),
        F.col("_left").alias("_other_left"),
    )
    met = whole.where(F.col("_comp") != F.col("_big")).join(other, _LIST)
    able = (F.col("_need") <= F.col("_other_left")) & (F.col("_other_need") <= F.col("_left"))
    return met.where((F.col("_comp") != F.col("_other_comp")) & able).select(
        F.greatest("_rep", "_other").alias("_rep"), F.least("_rep", "_other").alias("_lead")
    )


def _links(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (``_a``, ``_b``) that join all sets which any chain of links joins.

    Each round compares the sets of a list with its leader and centre and takes components, again as long as
    these steps find links, as larger components share leaders. Then what differs from the leader
    makes up the lists of the next round. A leader is no member of the scope it opens, so scopes
    shrink and the rounds end. From the second step on, a list that has few pairs between components
    for its length is done with once these pairs are compared.
    """
    lists, direct = scratch.stored(_first_lists(ordered)), 0
    entries = lists.count()
    edges = ordered.select(F.col("_rep").alias("_a"), F.col("_rep").alias("_b")).limit(0)
    comps = edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_comp"))
    while True:
        for _ in range(STEPS):
            live = scratch.stored(_live(lists, comps))
            left = live.count()
            if not left:
                return edges
            # Few entries left may be compared more freely: never more pairs than DIRECT times all entries.
            led = scratch.stored(_led(live, direct and max(direct, entries // left)))
            whole, long = led.where("_whole"), led.where(~F.col("_whole") & (F.col("_rep") != F.col("_lead")))
            pairs = _pairs_with(long, "_lead").union(_pairs_with(long, "_centre"))
            if direct:
                pairs = pairs.union(_pairs_between(whole))
            found = scratch.stored(_linked(pairs.distinct(), ordered))
            direct = DIRECT
            lists = led.where(~F.col("_whole")).select(*_ENTRY)
            if found.isEmpty():
                break
            edges = scratch.stored(edges.union(found))
            comps = connected(edges, scratch)
        if long.isEmpty():
            return edges
        members = long.select(
            F.xxhash64("_scope", "_band", "_lead").alias("_next"), "_rep", "_lead", "_band"
        ).distinct()
        lists = scratch.stored(_outside(members, ordered))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` (size of its set) and ``component_id`` of every row.

    The component is the smallest id reachable by links, the document's own if there is none.
    Documents without words have an empty set and link with nothing; a null id has a null component
    and links with nothing. Repeated rows and rows with equal sets are one class, compared once.
    Rows that share an id but not their sets are taken as linked. An empty table gives an empty
    result.

    Sets are hashed to 64 bits a shingle. Texts are read three times and only the texts of
    documents that share most of their shingles with others are shuffled. Very long texts are
    sliced; Python tasks get batches of bounded bytes.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    alike = ["_p1", "_p2", "_n"]
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        measured = scratch.kept(_measure(rows))
        sized = measured.where(F.col("_n") > 0).where(F.col("_id").isNotNull())
        # Classes are told apart by their prints. Their names are numbers, fixed once stored.
        grouped = sized.groupBy(*alike).agg(F.min("_id").alias("_first"))
        classes = scratch.stored(grouped.withColumn("_rep", F.monotonically_increasing_id()))
        total = measured.agg(F.sum("_n").alias("n")).first()["n"] or 0
        links = _class_links(rows, classes, int(total), scratch)
        twice = (
            sized.join(classes, alike)
            .groupBy("_id")
            .agg(
                F.min("_rep").alias("_low"),
                F.max("_rep").alias("_high"),
                F.collect_set("_rep").alias("_all"),
            )
            .where(F.col("_low") != F.col("_high"))
            .select(F.col("_low").alias("_a"), F.explode("_all").alias("_b"))
        )
        comps = connected(links.union(twice), scratch)
        named = classes.join(comps, F.col("_rep") == F.col("_node"), "left").withColumn(
            "_comp", F.coalesce("_comp", "_rep")
        )
        least = named.groupBy("_comp").agg(F.min("_first").alias("_least"))
        answered = scratch.kept(named.join(least, "_comp").select(*alike, "_least"))
    own = F.when(F.col("_n") > 0, F.col("_least"))
    return measured.join(answered, alike, "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_n").alias("n_shingles"),
        F.when(F.col("_id").isNotNull(), F.coalesce(own, "_id")).alias("component_id"),
    )


def _class_links(rows: DataFrame, classes: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    sharing = scratch.stored(_sharing_sets(rows, -(-total // BUCKET_TOKENS) or 1))
    enough = classes.join(sharing, "_p1").where(F.col("_often") >= _need(F.col("_n")))
    chosen = scratch.stored(enough.select("_rep", "_first", "_p1", "_p2", "_n"))
    kept = chosen.agg(F.count(F.lit(1)).alias("sets"), F.sum("_n").alias("tokens")).first()
    buckets = -(-int(kept["tokens"] or 0) // BUCKET_TOKENS) or 1
    with filtered_joins(rows.sparkSession, kept["sets"]):
        ordered = scratch.stored(_ordered_sets(_texts_of(rows, chosen), buckets))
    return _links(ordered, scratch)


def _texts_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the first ids of these classes, with the names and prints of the classes."""
    named = chosen.where(F.col("_n") > 0).select(F.col("_first").alias("_id"), "_rep", "_p1", "_p2")
    return rows.join(named, "_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of linked ones, the one of the smallest id; all others stay.

    Rows that repeat the id that stays are that document and stay with it, as do documents without
    words and null ids.
    """
    found = similar_documents(docs, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone"))
    same = F.col(plain_name(docs, id_col)) == F.col("_gone")
    return restored(plain(docs).join(gone.distinct(), same, "left_anti"), docs)
