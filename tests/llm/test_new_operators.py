"""Prefix trie, word BPE and spelling variants against plain versions and the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import prefix_trie, registry, spelling, word_bpe
from tidemark.llm.shared import WorkTables, table

FILE = public_tokenizers.path(registry.WORDS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def _nodes(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[1], r[0], r[3], r[7]))


def _trie(spark, rows):
    turns = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string, n_convs string")
    own = WorkTables(spark, "test").keep(prefix_trie.conversations(turns))
    return _nodes(prefix_trie.build(prefix_trie.with_shared_heads(own)))


def test_trie(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, sf_dir, "conversations").collect()]
    assert _nodes(registry.op11_prefix_trie(spark, sf_dir)) == brute.prefix_trie(rows)


def test_trie_edges(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, conversations without turns of their own, copies, a long one."""
    rows = [(0, 0, "user", "a b"), (0, 1, "bot", "c"), (0, 2, "user", "d"), (1, 0, "user", "own one"), (2, None, None, "null first"), (2, 0, "user", None), (2, 0, "bot", "tie"), (2, 0, "bot", "tie"), (None, 0, "user", "x"), (25, 0, "user", "no base"), (-3, 1, "user", "below nought")]
    rows += [(100 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)] + [(7, t, "user", "word " * (t % 5) + ("" if t % 3 else "\n\t ")) for t in range(500)] + [(8, t, "user", "word " * (t % 5) + ("" if t % 3 else "\n\t ")) for t in range(400)]
    assert _trie(spark, rows) == brute.prefix_trie(rows)
    assert _trie(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_trie_random(spark, seed):
    """Few different turns, so that branches, ends and spines of ranges are many."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ub"), rng.choice(["x", "y y", ""])) for c in range(300) for t in range(rng.randint(1, 7))]
    assert _trie(spark, rows) == brute.prefix_trie(rows)


def test_trie_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 3)
    monkeypatch.setattr(prefix_trie, "HUB_LEAST", 2)
    monkeypatch.setattr(prefix_trie, "HUB_SHARE", 10**6)
    rows = [(c, 0, "u", "same" if c % 2 else f"own {c}") for c in range(200)]
    assert _trie(spark, rows) == brute.prefix_trie(rows)


def _library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_word_bpe(spark, sf_dir, library):
    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op12_word_bpe(spark, sf_dir).collect()}
    assert got == {k: _library_row(library, t) for k, t in texts.items()}


def test_word_bpe_edges(spark, library):
    """Nulls, special tokens in texts, letters of every kind, pieces without a blank of up to 100,000 symbols in rows of their own."""
    rng = random.Random(4)
    texts = [None, "", " \n\t", "A", "don't I'LL x's", "<|endoftext|>", "a<|startoftext|>B<|endoftext|> <|endof", "ΑΣ ΟΔΟΣ ẞ İ ǅ", "é é Ᲊ\U00010d50 日本語テキスト 🎉🎉", "x" * 5000, "=" * 9001, "日本" * 6000]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "theandofin", "=-_", "日本語でx") for n in (4097, 30_000, 100_000)] + ["words " * 50 + "y" * 8000 + " more, " + "z" * 4500 + "!"] * 2
    df = spark.createDataFrame([(i % 20, t, 1, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, uid int, seg string, ids array<int>")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_bpe.encode_decode(df, word_bpe.read_tokenizer(FILE)).collect())
    assert got == sorted((i % 20, *_library_row(library, t)) for i, t in enumerate(texts))
    assert word_bpe.encode_decode(df.limit(0), word_bpe.read_tokenizer(FILE)).count() == 0
    full = word_bpe.encode_decode(df.limit(10), word_bpe.read_tokenizer(FILE), with_ids=True)
    back = {r.doc_id: r.decoded for r in word_bpe.decode(full, word_bpe.read_tokenizer(FILE)).collect()}
    assert back == {i: library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(texts[:10])}


def test_tree_concatenation_is_plain_merging():
    """Halves at every place, and windows that must grow: always the ids of merging the whole."""
    codec, rng = word_bpe.Codec(word_bpe.read_tokenizer(FILE)), random.Random(6)
    for _ in range(400):
        symbols = codec.symbols("".join(rng.choice(rng.choice(["ab", "aeiourtn", "thein", "=-", "日本語"])) for _ in range(rng.randint(2, 120))))
        whole = codec._merge_long(symbols)
        assert codec.encode(symbols) == whole == codec.merge(symbols)
        cut = rng.randint(1, len(symbols) - 1)
        assert codec.join(codec.merge(symbols[:cut]), codec.merge(symbols[cut:])) == whole


def _groups(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_spelling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    counts = {w: n for w, n in brute.spelling_words(docs).items() if len(w) >= 5 and n >= 3}
    assert _groups(registry.op13_spelling(spark, sf_dir)) == sorted(brute.spelling_groups(counts))


def test_spelling_edges(spark):
    """Nulls, ties of counts, capitals outside of A to Z, a very frequent word, long runs that differ by one letter."""
    long = "".join(random.Random(2).choices("abc", k=20_000))
    texts = [None, "", "1 2 3", "hello " * 500, "Hello HELLO hallo hallo hallo hellö hellö HELLÖ", "ÀÉÎÕÜ " * 3 + "àéîõü " * 6, "abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg", f"{long} " * 9, f"{long[:9000]}x{long[9000:]} " * 3, f"{long[:15_000]}{long[15_001:]} " * 3, "ab×cd " * 4, "naïve naive naïve naive naive naïve"]
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, "hello hello")] * 2
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, word string, run string")
    count = lambda d: spelling.count_words(spelling.with_planted_slips(spelling.letter_runs(d)))
    counts = {w: n for w, n in brute.spelling_words(rows).items() if len(w) >= 5 and n >= 3}
    assert _groups(spelling.group_variants(count(df))) == sorted(brute.spelling_groups(counts), key=lambda r: r[0])
    assert spelling.group_variants(count(df.limit(0))).count() == 0


@pytest.mark.parametrize("broadcast", [0, 10_000])
def test_spelling_random(spark, monkeypatch, broadcast):
    """A dense vocabulary: every pair at a distance of one, each once, and chains of forms."""
    monkeypatch.setattr(spelling, "BROADCAST_CHILDREN", broadcast)
    rng = random.Random(broadcast)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))): 2 ** rng.randint(0, 12) for _ in range(700)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute.spelling_groups(words)
    assert _groups(spelling.group_variants(df)) == sorted(want)
    pairs = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df, WorkTables(spark, "test")).collect()]
    assert len(pairs) == len(set(pairs)) == sum(r[4] for r in want) // 2
