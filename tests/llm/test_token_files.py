import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from starwake.llm import token_files
from starwake.session import fresh_path
from tests.llm.corpus import documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = (
    "it's  don't ÉÀ ß İ ſ x́y ́ éa 12ab a1, ., .,. <|endoftext|> a<|startoftext|>b ,a. ΑΣ ΑΣ. ʼn ǅ ﬁ "
    "한글 　x\x85y\x1cz​ q Hello,World. (a) a.b 'S 'sfoo ' \n end. İ. İ, Aİ, B İ. Kaya geldi Åﬃ. Ⅷ, ª. ²a"
)


def tag(text):
    """Spark's hash of a text, by which documents of one id are ordered."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start, seen = [], 0, {}
    for doc, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, tag(row[1]))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, seen.get(doc, 0), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        seen[doc] = seen.get(doc, 0) + 1
        start += len(ids)
    return out


def digest(spark, rows, **options):
    got = token_files.token_digest(documents(spark, rows), PATH, **options).collect()
    return [(r.doc_id, r.nth, r.start, r.n_tokens, r.ids_crc32) for r in sorted(got, key=lambda r: r.start)]


ROWS = [
    (5, ODD), (3, None), (-4, ""), (7, "same text"), (7, "same text"), (7, "Another."), (None, "no id"),
    (None, None), (0, "zero"), (-(1 << 63), "least"), (2**62, " ".join(words(1, 20_000))), (2**62 + 1, "next"),
    *[(100 + at, " ".join(words(at, 30))) for at in range(60)],
]


@pytest.mark.parametrize("shard_bytes", [2_000, 8_000_000])
def test_round_trip(spark, shard_bytes):
    assert digest(spark, ROWS, shard_bytes=shard_bytes) == expected(ROWS)


def test_one_id_over_many_shards(spark):
    rows = [(7, " ".join(words(at, 40))) for at in range(150)] + [(None, " ".join(words(at, 40))) for at in range(90)]
    rows += [(at, "few words") for at in (6, 8, 8)]
    assert digest(spark, rows, shard_bytes=1_500) == expected(rows)


def test_words_like_the_tokenizer(spark):
    """Random words from letters that change when lowered or composed, with and without marks."""
    rng = random.Random(11)
    letters = "aZ.,İıßẞÅÅǆﬁſKΣσς́9'’-한éᾼͅªⅨ "
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(4_000)]
    tokenizer = Tokenizer.from_file(PATH)
    encoder = token_files.WordEncoder(PATH, "<u2")
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        for text, raw in zip(part, encoder.encode(part)):
            assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_kept_over_generations(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder, tokenizer = token_files.WordEncoder(PATH, "<u2"), Tokenizer.from_file(PATH)
    for at in range(40):
        text = " ".join(["the", "of", *words(at % 13, 20)])
        raw = next(encoder.encode([text]))
        assert np.frombuffer(raw, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.old) <= 2 * (50 + 24)


def test_keyed_access(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(documents(spark, ROWS), path, PATH, shard_bytes=3_000)
    got = token_files.lookup(spark, path, [5, 130, 999, -(1 << 63), 0])
    tokenizer = Tokenizer.from_file(PATH)
    assert set(got) == {5, 130, -(1 << 63), 0}
    assert got[5].tolist() == tokenizer.encode(ODD, add_special_tokens=False).ids + [1]
    assert got[0].tolist() == tokenizer.encode("zero", add_special_tokens=False).ids + [1]


def test_a_lookup_reads_one_payload(spark):
    rows = [(at, " ".join(words(at, 200))) for at in range(400)]
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(documents(spark, rows), path, PATH, shard_bytes=8_000)
    every = spark.read.parquet(path).count()
    near = token_files.shards_of(spark, path, [123])
    assert every > 20 and near.count() == 1
    pushed = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "LessThanOrEqual(low,123)" in pushed
    # The reader itself skips row groups: without any filter above the scan the same row comes out.
    import pyarrow.dataset as ds

    groups = [g for f in ds.dataset(path.removeprefix("file:"), format="parquet").get_fragments() for g in f.split_by_row_group()]
    assert len(groups) == every


def test_empty_table(spark):
    assert token_files.token_digest(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_index_is_minimal_and_perfect(size):
    keys = token_files.index_keys(np.arange(size) * 7 - 3, np.zeros(size, dtype=np.int64))
    pilots, slots = token_files.build_index(keys)
    assert sorted(slots) == list(range(size))
    again = token_files._slots(keys, pilots[token_files._buckets(keys, len(pilots))], size)
    assert (again == slots).all()


class Counted:
    """A tokenizer that notes what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.normalizer, self.asked = tokenizer, tokenizer.normalizer, []

    def encode_batch_fast(self, texts, **options):
        self.asked += [word for text in texts for word in text.split()]
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_follows_them():
    encoder, some = token_files.WordEncoder(PATH, "<u2"), sorted({*words(3, 40), "éa", "straße"})
    encoder.tokenizer = Counted(encoder.tokenizer)
    text = " ".join(word + end for end in ("", "!", "???", ").", "$$$", ";") for word in (*some, *map(str.title, some)))
    raw = next(encoder.encode([text]))
    assert np.frombuffer(raw, "<u2").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    asked = encoder.tokenizer.asked
    assert len(asked) == len(set(asked)) <= 2 * len(some) + 5
