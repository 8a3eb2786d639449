"""Token counts, pieces, fingerprints, shards and packing."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vecmeadow.llm import fingerprints, packing, sentencepieces, sharding, token_counts, worker
from vecmeadow.session import scratch_table

COUNTS, IDS, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TRICKY = [
    "", "  ", " \n\n a  b\t\tc ", "x\x1cy !\x1c?", "<|endoftext|> a<|endoftext|>b  <|startoftext|><|STARTOFTEXT|>", "a\u00a0 b\u2003c",
    "İstanbul ΟΔΟΣ ΣΑΣ.", "é e\u0301 \u0301x", "it's 'S don't  '  ve", "日本語 text\u200b", " a\u0085b", "1 22 333 a1b2",
]


@pytest.mark.parametrize("path, pattern", [(COUNTS, None), (IDS, None), (IDS, public_tokenizers.PATTERN)])
def test_chunks_give_the_ids_of_whole_texts(path, pattern):
    whole = [e.ids for e in Tokenizer.from_file(path).encode_batch(TRICKY, add_special_tokens=False)]
    ids = worker.ChunkEncoder(path, False, pattern).encode(TRICKY)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == whole
    assert worker.ChunkEncoder(path, True, pattern).encode(TRICKY) == [len(w) for w in whole]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_chunks_of_any_text(text):
    whole = [e.ids for e in Tokenizer.from_file(IDS).encode_batch([text], add_special_tokens=False)]
    encoder = worker.encoder(IDS, False, public_tokenizers.PATTERN)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole[0]


def test_token_counts_and_cache(spark, odd_docs, odd_rows):
    cache = scratch_table(spark, "cache")
    tokenizer = Tokenizer.from_file(COUNTS)
    want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert Counter(map(tuple, token_counts.count_tokens(odd_docs, COUNTS, cache).collect())) == want
    stored = spark.read.parquet(cache)
    distinct = stored.count()
    assert distinct == stored.select("content").distinct().count() < len(odd_rows)
    # A second run finds every text in the cache; more texts add only themselves; another version adds its own.
    assert Counter(map(tuple, token_counts.count_tokens(odd_docs, COUNTS, cache).collect())) == want
    assert spark.read.parquet(cache).count() == distinct
    token_counts.count_tokens(spark.createDataFrame([(1, "new words"), (2, "new  words")], "doc_id long, text string"), COUNTS, cache).collect()
    assert spark.read.parquet(cache).count() == distinct + 1
    token_counts.count_tokens(odd_docs, IDS, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def library_of(path):
    """The library's own unigram segmentation over the same pieces and log scores."""
    import sentencepiece

    def varint(n):
        out = b""
        while True:
            byte, n = n & 127, n >> 7
            out += bytes([byte | (128 if n else 0)])
            if not n:
                return out

    with open(path, "rb") as file:
        message = list(sentencepieces._fields(file.read()))
    scores = sentencepieces.zipf_scores(sentencepieces.read_model(path)[2])
    out, number = b"", 0
    for n, value in message:
        if n == 1:
            piece = dict(sentencepieces._fields(value))
            body = b"\x0a" + varint(len(piece[1])) + piece[1] + b"\x15" + struct.pack("<f", scores[number]) + b"\x18" + varint(piece.get(3, 1))
            number += 1
        elif n == 2:
            body = b""
            for k, v in sentencepieces._fields(value):
                if isinstance(v, int):
                    body += varint(k << 3) + varint(1 if k == 3 else v)
                else:
                    body += (varint(k << 3 | 5) if k in (10, 15, 51) else varint(k << 3 | 2) + varint(len(v))) + v
        else:
            body = value
        out += varint(n << 3 | 2) + varint(len(body)) + body
    return sentencepiece.SentencePieceProcessor(model_proto=out), scores


def test_pieces_against_the_library():
    model = sentencepieces.Model.load(PIECES)
    library, scores = library_of(PIECES)
    rng = random.Random(1)
    syllables = ["the", "er", "tion", "ß", "ung", "é", "日", "😀", "##", "Q", " ", "  ", "\n", "x1"]
    texts = ["", " ", "  a  b ", "日本語 😀", "\n\ttab", "a" * 50] + ["".join(rng.choices(syllables, k=rng.randint(1, 40))) for _ in range(300)]
    got = [np.frombuffer(i, "<u4").tolist() for i in sentencepieces.Encoder(model).encode(texts)]
    want = library.encode(texts, num_threads=1)
    # The library adds in single precision, so of equally good segmentations it may take another.
    for g, w in zip(got, want):
        assert g == w or abs(sum(scores[i] for i in g) - sum(scores[i] for i in w)) < 1e-3
    assert sum(g == w for g, w in zip(got, want)) > 0.95 * len(texts)
    assert [model.decode(g) for g in got] == texts == [library.decode(g) for g in got]


def test_best_segmentation_by_trying_all():
    pieces = ["<unk>", "▁a", "▁ab", "b", "bc", "c", "▁", "a", "▁▁"]
    scores = np.array([0, -2.0, -2.5, -1.5, -1.0, -1.7, -3.0, -2.2, -3.5])
    model = sentencepieces.Model.of(pieces, scores, np.array([2] + [1] * 8))

    def best(text):
        if not text:
            return 0.0
        tries = [scores[i] + best(text[len(p) :]) for i, p in enumerate(pieces) if i and text.startswith(p)]
        return max([*tries, *([] if any(text[0] == p for p in pieces[1:]) else [model.unknown_score + best(text[1:])])])

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("abcd ", k=rng.randint(1, 9)))
        marked = "▁" + text.replace(" ", "▁")
        ids = np.frombuffer(sentencepieces.Encoder(model).encode([text])[0], "<u4")
        assert sum(scores[i] if i else model.unknown_score for i in ids) == pytest.approx(best(marked)) or "d" in text


def test_pieces_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sentencepieces.summarise_documents(odd_docs, PIECES).collect()
    assert len(rows) == len(odd_rows) and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (5, 6)} == {0}
    encoded = sentencepieces.encode_documents(odd_docs, PIECES)
    back = sentencepieces.decode_documents(encoded, PIECES).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in odd_rows)
    assert sentencepieces.summarise_documents(no_docs, PIECES).count() == 0


def test_spans_and_extensions():
    texts = ["abcabcabc", "xabcab", "", "ééabé"]
    p = fingerprints.Prefixes(texts)
    whole = "".join(texts)
    n = len(whole)
    by_hash = defaultdict(set)
    for size in range(n):
        at = np.arange(n - size + 1)
        for i, key in enumerate(zip(*(h.tolist() for h in p.spans(at, at + size)))):
            by_hash[key, size].add(whole[i : i + size])
    assert all(len(v) == 1 for v in by_hash.values())
    for i in range(n):
        for j in range(n):
            assert p.extension(i, j, min(n - i, n - j)) == brute.same_start(whole[i:], whole[j:])


def test_fingerprints(spark, odd_docs, odd_rows, no_docs):
    rows = fingerprints.fingerprint_documents(odd_docs, part_bytes=2000).collect()
    assert len(rows) == len(odd_rows)
    unique = {i: t or "" for i, t, *_ in odd_rows if i is not None and i != 10 and i != 2}
    of = {r.doc_id: r for r in rows}
    order = sorted(unique, reverse=True)
    for i, following in zip(order, order[1:]):
        if 2 < i <= 9 or i > 11:  # neighbours without a repeated id between them
            want = brute.edited(unique[i], unique[following])
            assert (of[i].n_chars, of[i].edited_sha256) == (len(unique[i]), brute.sha256(want))
            assert of[i].same_start_edited == brute.same_start(unique[i], want)
            assert of[i].same_start_next == brute.same_start(unique[i], unique[following])
    assert of[1].fingerprint == of[2].fingerprint != of[4].fingerprint and of[5].fingerprint == ""
    assert fingerprints.fingerprint_documents(no_docs).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in one] == [(3, brute.sha256("aba"), 1.0)]


def test_likeness_estimates_the_share_of_common_spans():
    rng = random.Random(3)
    a = "".join(rng.choices("abcdefgh ", k=6000))
    b = a[:4500] + "".join(rng.choices("abcdefgh ", k=1500))
    row = fingerprints.fingerprint_pairs([a, b])[0]
    spans = [{t[i : i + fingerprints.SPAN] for i in range(len(t) - fingerprints.SPAN + 1)} for t in (a, b)]
    assert abs(row[5] - len(spans[0] & spans[1]) / len(spans[0] | spans[1])) < 0.2


def leaves(hashes: list[tuple[int, int]], limit: int, depth=0):
    """(prefix bits, bytes) of the buckets of (hash, bytes) rows."""
    if not hashes:
        return
    if sum(b for _, b in hashes) <= limit or len({h for h, _ in hashes}) == 1:
        yield hashes, depth
        return
    for bit in (0, 1):
        yield from leaves([x for x in hashes if x[0] >> (sharding.BITS - 1 - depth) & 1 == bit], limit, depth + 1)


@pytest.mark.parametrize("limit, step", [(100, 1), (1000, 4), (10**9, 4), (1, 2)])
def test_shards(spark, limit, step):
    rng = random.Random(limit)
    docs = [(i % 150 if rng.random() < 0.3 else i, "x" * rng.randint(0, 60)) for i in range(200)] + [(None, "yy"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sharding.assign_shards(df, limit, step=step).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in found) == Counter((i, len(t or "")) for i, t in docs)
    hashed = {r.doc_id: r.h for r in df.select("doc_id", sharding.hash_bits(df.doc_id).alias("h")).collect()}
    want = {}
    for rows, depth in leaves([(hashed[i], len(t or "")) for i, t in docs], limit):
        for h, _ in rows:
            want[h] = (format(h, "060b")[:depth], sum(b for _, b in rows), len(rows))
    for r in found:
        assert (r.shard, r.shard_bytes, r.shard_docs) == want[hashed[r.doc_id]] and r.depth == len(r.shard)
        assert r.fits == (r.shard_bytes <= limit)


def test_shards_of_odd_rows(spark, odd_docs, odd_rows, no_docs, tmp_path):
    found = sharding.assign_shards(odd_docs, 1000)
    assert found.count() == len(odd_rows)
    assert sharding.assign_shards(no_docs).count() == 0
    named = odd_docs.where("doc_id < 9")
    sharding.write_shards(named, sharding.assign_shards(named, 500), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == named.count()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_takes_the_tightest_window(lengths):
    lengths.sort(reverse=True)
    where, offsets = packing.best_fit(lengths, 64)
    assert offsets == [o for _, o in brute.best_fit(lengths, 64)]
    fill = defaultdict(list)
    for window, offset, length in zip(where, offsets, lengths):
        fill[window].append((offset, length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_packing(spark, odd_docs, odd_rows, no_docs):
    tokenizer = Tokenizer.from_file(IDS)
    rows = packing.pack(odd_docs, IDS, window=128, group_pieces=50, pattern=public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 128):
            piece = ids[start : start + 128]
            want[i, start, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack(no_docs, IDS).count() == 0
