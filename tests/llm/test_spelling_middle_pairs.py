"""Spelling variants, fill-in-the-middle and byte pairs against plain versions."""

import base64
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmeadow.llm import byte_pairs, fill_middle, queries, spelling

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = "doc_id long, text string, word string, n long, output string, form string, ids binary, size int"


def odd_spelling_rows():
    rnd = random.Random(3)
    base = ["kettle", "kettles", "kittle", "settle", "Übermut", "aaaaaa", "aaaaaaa", "aaaaaaaa", "bananas", "banana", "x" * 70, "x" * 71, "x" * 500]
    rows = []
    for i in range(60):
        words = []
        for w in base:
            words += [w.upper() if rnd.random() < 0.3 else w] * (1 + len(w) % 2 + 40 * (w in ("kettle", "bananas", "aaaaaaa")))
        if i % 3 == 0:
            words += ["kettel", "kettlé", "bannanas", "ketle"] * 2
        rnd.shuffle(words)
        rows.append((i if i % 7 else None, " ".join(words) + "," + "short ab 12 ÷×÷×÷×" * (i % 4)))
    return rows + [(1, None), (2, ""), (1, "kettle"), (1, "kettle")]


@pytest.mark.parametrize("slip, shard_words, filter_bytes", [(None, spelling.SHARD_WORDS, spelling.FILTER_BYTES), (7, 3, 100)])
def test_spellings_equal_all_pairs(spark, slip, shard_words, filter_bytes):
    rows = odd_spelling_rows()
    docs = spark.createDataFrame([(i, t, "w", 1, "o", "f", b"", 3) for i, t in rows], ODD).repartition(4)
    got = spelling.group_spellings(docs, slip=slip, shard_words=shard_words, filter_bytes=filter_bytes)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found))
    assert set(found) == brute.spellings(brute.spelling_words(rows, slip))
    assert any(f is not None for _, f, *_ in found)


def test_spellings_of_documents_equal_all_pairs(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    words = brute.spelling_words(rows, 199)
    got = list(map(tuple, queries.op11_spelling(spark, "/root/testdata/sf0.001").collect()))
    assert len(got) == len(words) and set(got) == brute.spellings(words)


def test_spellings_of_nothing(spark, no_docs):
    assert spelling.group_spellings(no_docs).count() == 0
    assert spelling.group_spellings(spark.createDataFrame([(1, None), (None, "a b c")], "doc_id long, text string")).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}", i) for i in range(40)] + [("side", "w038", 1)]
    got = spelling.with_roots(spark.createDataFrame(chain, "word string, form string, form_n long")).collect()
    assert len(got) == 41 and {r["root"] for r in got} == {"w040"}


def test_filters_hold_all_their_words_and_few_others():
    words = sorted({"".join(random.Random(i).choices(spelling.LETTERS, k=9)) for i in range(20_000)})
    shards = spelling.Shards({9: len(words)}, 5_000)
    keys = spelling.word_keys(words)
    place = shards.of(9, keys)
    assert shards.count == 4 and set(place.tolist()) == {0, 1, 2, 3}
    found = []
    for s in range(4):
        bits = spelling.filter_bits(keys[place == s])
        found.append((s, len(bits), bits.tobytes()))
    filters = spelling.Filters(shards, found)
    assert len(filters.holds(9, keys)) == len(words)
    others = spelling.word_keys([w[::-1] + "a" for w in words])
    assert len(filters.holds(9, others)) < 0.01 * len(words)
    assert len(filters.holds(8, keys)) == 0


MIDDLE = ["", "\n", "\n\n", "a", "a\nb", "a\nb\n", "é\n日本\n😀x\n" * 40, "x<P>y", "<", "<S", ">P>", "<S>", "a\n<M\n>", "line\n" * 3000, "w " * 20_000, "\n" * 40_000]


@pytest.mark.parametrize("rate, suffix_first", [(100, 50), (60, 0), (100, 100)])
def test_fill_in_middle_equals_plain_version(spark, rate, suffix_first):
    rows = [(i * 31 + k, t) for i, t in enumerate(MIDDLE) for k in range(6)] + [(None, "a\nb\nc"), (None, None), (3, None), (3, "a\nb\nc"), (3, "a\nb\nc")]
    docs = spark.createDataFrame([(i, t, "w", 1, "o", "f", b"", 3) for i, t in rows], ODD).repartition(3)
    got = fill_middle.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    got = got.withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute.fill_in_middle(i, t, rate, suffix_first) for i, t in rows)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)


def test_fill_in_middle_of_nothing(spark, no_docs):
    assert fill_middle.fill_in_middle(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab\n<PSM>é日😀", max_size=300), st.integers(2, 40))
def test_outlines_of_any_chunks(text, longest):
    data, marks = text.encode(), tuple(m.encode() for m in fill_middle.MARKS)
    ends = fill_middle.chunk_ends(np.frombuffer(data, np.uint8), max(4, longest)).tolist()
    chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
    assert b"".join(chunks) == data and all(c.decode() for c in chunks)
    outline = fill_middle.Outline([fill_middle.summarise(c, marks) for c in chunks], data[-1:] == b"\n", marks, 2)
    units = [u for u in text.split("\n")]
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    assert outline.lines == len(units) and outline.marked == any(m in text for m in fill_middle.MARKS)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert outline.end_of(k) == (len(head.encode()), len(head))


def test_shared_passages_become_shared_chunks():
    rnd = random.Random(5)
    passage = " ".join(str(rnd.random()) for _ in range(3000))
    cache = fill_middle.SummaryCache(fill_middle.MARKS)
    cache.outline(("one start " + passage).encode())
    stored = len(cache.kept)
    cache.outline(("quite another start\n" + passage).encode())
    assert stored > 20 and cache.hits >= stored - 3


def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TOOL = byte_pairs.BytePairs(RANKS, PATTERN)
RANK_OF, LIBRARY = library()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab 'st\n\x1c\x85　é日1", max_size=600))
def test_byte_pairs_of_any_text(text):
    (ids,) = TOOL.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert TOOL.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "eraniotsl", "日本", "\x00\xff", "=-"])
def test_long_pieces_equal_one_merge_at_a_time(letters):
    rnd = random.Random(letters)
    for size in (3, 60, 255, 256, 257, 700):
        piece = "".join(rnd.choices(letters, k=size)).encode()
        want = brute.byte_pairs(piece, RANK_OF)
        assert np.frombuffer(TOOL.encode_pieces([piece])[0], "<u4").tolist() == want
        assert byte_pairs.merge_long(TOOL.byte_symbol[np.frombuffer(piece, np.uint8)], TOOL.table).tolist() == want or piece in RANK_OF


def test_byte_pairs_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    encoded = byte_pairs.encode_documents(odd_docs.withColumn("decoded", F.lit(1)).withColumn("ids", F.lit(2)), RANKS, PATTERN)
    got = byte_pairs.decode_documents(encoded.withColumn("decoded", F.lit(5)), RANKS, PATTERN).collect()
    want = Counter((r[0], tuple(LIBRARY.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)
    assert byte_pairs.decode_documents(byte_pairs.encode_documents(no_docs, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_byte_pairs_of_documents_equal_the_library(spark):
    import hashlib

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()
        want[doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), brute.sha256(text or "")] += 1
    assert Counter(map(tuple, queries.op13_byte_pairs(spark, "/root/testdata/sf0.001").collect())) == want
