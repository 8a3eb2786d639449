"""Classifiers, the URL filter and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecmeadow.llm import quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, modulus, rest", [("op4_quality", "quality", 5, 0), ("op10_toxicity", "toxic", 3, 1)])
def test_held_out_accuracy(spark, name, label, modulus, rest):
    rows = queries.QUERIES[name](spark, SF).collect()
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    of = {r.doc_id: r[label] for r in labels.collect()}
    tested = [(r.predicted, of[r.doc_id]) for r in rows if r.held_out and r.doc_id in of]
    assert sum(p == y for p, y in tested) >= 0.93 * len(tested)


def test_pairwise_loss_orders_what_is_separable():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - 2 * x[:, 2] > 0.8).astype(int)
    model = quality.fit_ranking(x, y)
    assert model.utility(x)[y == 1].min() > np.quantile(model.utility(x)[y == 0], 0.98)
    assert ((model.score(x) >= quality.THRESHOLD) == (y == 1)).mean() > 0.97
    assert (quality.fit_ranking(x, np.ones(300)).score(x) == 0.5).all()


def plain_kernel(s: str, t: str) -> float:
    """Normalised kernel of two words by enumerating their subsequences."""

    def vector(word):
        word = "\x02" + word + "\x03"
        out = defaultdict(float)
        for i in range(len(word)):
            for k in range(i + 2, min(len(word), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = vector(s), vector(t)
    return sum(a[u] * b[u] for u in a if u in b) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))


def test_kernel_by_enumeration():
    words = ["idiot", "idxiot", "a", "moron", "aaaa", "worthless", "ñandú"]
    found = toxicity.kernel(words, words)
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert found[i, j] == pytest.approx(plain_kernel(s, t), abs=1e-9)


def test_gapped_insults():
    rng = np.random.default_rng(2)
    syllables = ["the", "er", "an", "tion", "ou", "st", "ing", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    insults = ["idiot", "moron", "scumbag", "pathetic"]
    texts, labels = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words[rng.integers(40)] = insults[i // 3 % 4]
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 3 == 0))
    scorer = toxicity.Scorer(model := toxicity.fit_machine(texts, np.array(labels)))
    bad = ["the er i d i o t an", "ha mo.ron!", "SCUM-BAG er", "an path*etic the", "idiot"]
    good = ["the er an tion", "", " a b c d ", "thean st stion"]
    assert (model.score(scorer.worst(bad)) >= toxicity.THRESHOLD).all()
    assert (model.score(scorer.worst(good)) < toxicity.THRESHOLD).all()


def prose(rng, n: int) -> list[str]:
    syllables = ["the", "er", "an", "tion", "ou", "st", "ing", "ha"]
    return ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]


def insulting(rng, insults, count: int):
    texts, labels = [], []
    for i in range(count):
        words = prose(rng, 40)
        if i % 3 == 0:
            words[rng.integers(40)] = insults[i // 3 % len(insults)]
        texts.append(" ".join(words[:20]) + ". " + " ".join(words[20:]) + ".")
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_insults_over_white_space():
    rng = np.random.default_rng(5)
    scorer = toxicity.Scorer(model := toxicity.fit_machine(*insulting(rng, ["idiot", "moron", "scumbag", "pathetic"], 600)))
    parts = ["the id iot an", "ha mor on!", "er an scum bag st", "path etic", "the i  d  i  o  t an", "mo ro n er"]
    assert (model.score(scorer.worst(parts)) >= toxicity.THRESHOLD).all()
    clean = [" ".join(prose(rng, 60)) + "." for _ in range(300)]
    assert (model.score(scorer.worst(clean)) < toxicity.THRESHOLD).mean() >= 0.99


def test_insults_of_several_words():
    rng = np.random.default_rng(6)
    texts, labels = insulting(rng, ["kill red dogs", "blue mud face"], 600)
    # Each word alone is as frequent in clean documents.
    words = "kill red dogs blue mud face".split()
    texts = [t if y else f"{t} {' the '.join(rng.permutation(words))}." for t, y in zip(texts, labels)]
    scorer = toxicity.Scorer(model := toxicity.fit_machine(texts[:450], labels[:450]))
    found = model.score(scorer.worst(texts[450:])) >= toxicity.THRESHOLD
    assert found[labels[450:] == 1].mean() >= 0.9 and found[labels[450:] == 0].mean() <= 0.1


def test_runs_by_enumeration():
    rng = np.random.default_rng(7)
    model = toxicity.fit_machine(*insulting(rng, ["idiot", "moron"], 300))
    table = model.dense()
    texts = [" ".join(prose(rng, 30)) + ". a b " + " ".join(prose(rng, 10)) for _ in range(50)] + ["id iot", "a", "", "so aaaa aaaa aaaa"]
    for text, found in zip(texts, toxicity.Scorer(model).worst(texts)):
        values = model.values(toxicity.words_of(text), table).tolist()
        values += [v for s in toxicity._sentences(text) for v in model._plain_values(sorted(toxicity._bare_runs(s)), table)]
        assert found == pytest.approx(max(values, default=toxicity.LOWEST), abs=1e-7)


def test_held_out_toxic_recall(spark):
    large = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op10_toxicity"](spark, large).where("held_out").collect()
    of = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").where("toxic is not null").collect()}
    for toxic, least in ((1, 0.85), (0, 0.95)):
        found = [r.predicted == toxic for r in rows if of.get(r.doc_id) == toxic]
        assert found and sum(found) >= least * len(found)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_on_odd_rows(spark, module, odd_docs, odd_rows, no_docs):
    label = "quality" if module is quality else "toxic"
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (8, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for frame in (labels, labels.where("false"), labels.where(f"{label} = 1")):
        model = module.train(odd_docs, frame)
        rows = module.score_documents(odd_docs, model).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert sorted(rows[0].asDict()) == sorted(odd_docs.columns)
    assert module.score_documents(no_docs, module.train(no_docs, labels)).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_templates_of_any_depth(spark):
    """Variable segments merge at every depth, a lone deep url ends early, and other columns do not matter."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    urls = [f"http://h.com/a/b/c/d/e/f/g/h/i/{word(i)}" for i in range(300)] + ["http://k.com/" + "z/" * 3000]
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, template string, shape string")
    rows = url_filter.judge_urls(df, RULES).collect()
    assert len(rows) == len(urls)
    of = {r.page_id: r.template for r in rows}
    assert {of[i] for i in range(300)} == {"/a/b/c/d/e/f/g/h/i/*"}
    assert of[300] == "/*" * 3000


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    after = rest[cut:]
    path = after[: min([i for c in "?#" if (i := after.find(c)) >= 0], default=len(after))]
    best = None
    for rule, verdict in RULES:
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules_and_parts(spark):
    urls = [
        None, "", "no scheme/path", "http://A.Example.NET/en/1?x=1#y", "https://example.net/en", "x://net/", "http://notnet/", "http://net",
        "http://a.b.org/fr/q#://z", "http://É.org/fr/", "http://h.example.com?/de/", "http://h.example.com/de/1/2", "a://b://c/d", "://x.net/\n/y",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string")
    rows = url_filter.judge_urls(df, RULES).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path, best = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]) and r.verdict == (best[1] if best else r.verdict)
    assert url_filter.judge_urls(df.where("false"), RULES).count() == 0


def test_templates(spark):
    urls = []
    for i in range(400):
        # Under one host /bad/ is labelled bad, /ok/ good; /mix/ has no label and other tails.
        urls += [f"http://h.com/bad/{i}", f"http://h.com/ok/{i}.html", f"http://h.com/mix/page/{i}/x"]
        urls += [f"http://g.com/u{'abcdefghij'[i % 10]}{i}x/profile" for _ in range(2)]
    rules = [("h.com/bad/1", "block"), ("h.com/ok/1", "allow"), ("g.com/ua", "block")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = url_filter.judge_urls(df, rules).collect()
    by = defaultdict(Counter)
    for r in rows:
        by["/".join(r.path.split("/")[:2]) if r.host == "h.com" else r.host][r.verdict, r.template] += 1
    assert {v for v, _ in by["/bad"]} == {"block"} and {v for v, _ in by["/ok"]} == {"allow"} and {v for v, _ in by["/mix"]} == {"allow"}
    assert {t for _, t in by["/bad"]} == {"/bad/{n}"} and {t for _, t in by["g.com"]} == {"/*/profile"}


def test_op2_rules(spark):
    rows = queries.QUERIES["op2_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, best = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")


def test_join_stage_keeps_one_of_each_group(spark, odd_docs):
    kept = corpus_pipeline.one_of_each_group(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    rows = kept.select("doc_id", "text").collect()
    base = [r for r in rows if (r.text or "").lower().startswith("w0 w1")]
    assert len(base) == 1 and base[0].doc_id in (1, 2, 3, 4, None)
    # All other texts stay, those that repeat an id and those without an id too.
    others = Counter((r.doc_id, r.text) for r in rows if r not in base and r.doc_id not in (8, 9))
    want = {r[:2] for r in map(tuple, odd_docs.select("doc_id", "text").collect()) if not (r[1] or "").lower().startswith("w0 w1")}
    assert others == Counter(w for w in want if w[0] not in (8, 9))
    assert sum(r.doc_id in (8, 9) for r in rows) == 1  # the same words


def test_rows_of_one_id_with_other_texts_all_stay(spark):
    rows = [(1, "one two three four five six seven"), (1, "eight nine ten eleven twelve"), (1, "one two three four five six seven")]
    rows += [(2, "one two three four five six seven"), (2, "a b c d e f"), (3, None), (3, "")]
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(r.text for r in kept) == Counter({r[1]: 1 for r in rows})


def test_stages_on_odd_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= before, name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.select("doc_id").count() >= before


def test_pipeline(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        before, docs = docs, out
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    rows = corpus_pipeline.run(spark, small)
    assert rows.select("doc_id").distinct().count() == docs.count()
    covered = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert covered.where("n <> all").isEmpty()


def test_subsequences_are_sorted_by_value(monkeypatch):
    """The same vectors as by a stable sort of places, to the last bit, without that sort."""

    def by_places(words):
        keys, weights = [], []
        for number, word in enumerate(words):
            marked = [np.array([ord(c)], np.uint64) for c in "\x02" + (word.strip(toxicity.EDGES) or word) + "\x03"]
            for last in range(2, toxicity.SPAN):
                for middle in range(1, last):
                    for at in range(len(marked) - last):
                        mixed = sum(c * m for c, m in zip((marked[at], marked[at + middle], marked[at + last]), toxicity.MIXERS))
                        keys.append((number << toxicity.FEATURE_BITS) | int(toxicity._feature(mixed)[0]))
                        weights.append(toxicity.DECAY ** (last - 2))
        order = np.argsort(np.array(keys), kind="stable")
        return np.array(keys)[order], np.array(weights)[order]

    words = ["banana", "aaaaaaaa", "a", "(x-y)", "naïve 😀 text", "..."]
    keys, weights = by_places(words)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    word, weights = keys[first] >> toxicity.FEATURE_BITS, np.add.reduceat(weights, first)
    norm = np.sqrt(np.bincount(word, weights * weights, minlength=len(words)))
    monkeypatch.setattr(np, "argsort", None)
    found = toxicity.subsequences(words)
    assert found[0].tolist() == word.tolist() and found[1].tolist() == (keys[first] & ((1 << toxicity.FEATURE_BITS) - 1)).tolist()
    assert found[2].tolist() == (weights / norm[word]).tolist()
