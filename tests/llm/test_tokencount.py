import pytest
import tokenizers
from tokenizers import models

from cohortlake.llm import tokencount


@pytest.fixture(scope="module")
def scores():
    return tokencount.piece_scores(tokencount.VOCABULARY)


def reference(scores):
    vocab = [("<unk>", -30.0), *scores.items(), *((f"<0x{i:02X}>", -1e6) for i in range(256))]
    return tokenizers.Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def counted(trie, *words):
    trie.learn(set(words))
    return trie.count(list(words))


def test_counts_are_those_of_a_full_unigram_search(scores):
    trie, other = tokencount.Trie(scores), reference(scores)
    words = ["the", "therefore", "thereé", "日本x", "𝒳y", "a" * 40, "Überraschung", "x1y2z3", "!!!", "naïveté"]
    for w in words:
        assert counted(trie, w.encode()) == len(other.encode(tokencount.MARK + w).tokens), w


def test_a_word_alone_counts_as_in_the_trie(scores):
    trie = tokencount.Trie(scores)
    for w in ("hello", "internationalisation", "é" * 30):
        assert trie._alone(tokencount.MARK + w) == counted(trie, w.encode())
    long = "abé" * 5000
    trie.longest = 16  # the longest of these pieces is shorter, and the window moves often
    assert trie.count([long.encode()]) == len(reference(scores).encode(tokencount.MARK + long).tokens)


def test_prefixes_are_shared(scores):
    trie = tokencount.Trie(scores)
    trie.learn({b"abcdef", b"abcdeg", b"abcdegh", b"abcde"})
    assert trie.nodes == len(tokencount.MARK + "abcdef") + 2
    trie.learn({b"abcdefgh"})
    assert trie.nodes == len(tokencount.MARK + "abcdef") + 4  # a later batch goes on from the stored prefix


def test_a_full_trie_starts_anew(scores, monkeypatch):
    words = [f"w{i}x{i % 7}".encode() for i in range(400)]
    whole = counted(tokencount.Trie(scores), *words)
    monkeypatch.setattr(tokencount, "NODES", 50)
    trie = tokencount.Trie(scores)
    assert sum(counted(trie, w) for w in words) == whole and trie.nodes < 100


def test_query_against_a_full_unigram_search(spark, scores, tmp_path):
    from cohortlake.llm import queries

    texts = ["The cat sat.  On the mat", None, "", "ÜBER naïve 日本 x" * 3, "a" * 700 + " b", "The cat sat.  On the mat"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    other = reference(scores)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op2_tokens(spark, str(tmp_path)).collect()}
    words = {i: (t or "").split() for i, t in enumerate(texts)}
    assert got == {i: (len(ws), sum(len(other.encode(tokencount.MARK + w).tokens) for w in ws)) for i, ws in words.items()}


def test_table(spark, scores):
    docs = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (2, None, 5), (3, "", 5), (4, " \n\t ", 5), (None, "x" * 3000 + " y", 5)], "doc_id long, text string, tokens int")
    rows = tokencount.token_counts(docs).collect()
    trie = tokencount.Trie(scores)
    assert len(rows) == 6
    for r in rows:
        words = (r.text or "").encode().split()
        assert (r.tokens.n_words, r.tokens.n_tokens) == (len(words), counted(trie, *words))
    assert tokencount.token_counts(docs.limit(0)).count() == 0
