"""BPE, WARC, licences, toxicity and language against libraries, round trips and brute force."""

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rillgraph.llm import bpe, common, langid, licenses, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, extra string"


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.read_ranks(f.read())


def test_bpe_is_tiktoken(ranks):
    ours = bpe.ByteBPE(ranks, public_tokenizers.PATTERN, remembered=50)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", " ", "aaaaaaa" * 50, "<|endoftext|>", "naïve  café\r\n\t日本語 🙂", "x" * 20_000]
    texts += ["".join(rng.choice("aab the\n1é語'") for _ in range(rng.randrange(80))) for _ in range(400)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    assert ours.encode(None) == []


def test_bpe_frames(spark, ranks):
    df = spark.createDataFrame([(1, "hello there", "en", "x"), (None, None, None, None), (1, "hello there", "en", "x"), (2, "", "en", "y")], DOCS)
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in out] == ["hello there", "", "hello there", ""]
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df.withColumnRenamed("extra", "IDS"), PATH, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    for r in queries.op1_bpe(spark, SF).collect():
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_warc_round_trip(spark, tmp_path):
    long = "é<b>語</b>\r\n\r\nWARC/1.1 " * 400
    rows = [(1, "http://a", long), (2, "http://b", long), (3, "u\r\nX: y", "short"), (4, None, "short"), (5, "v", None), (None, "w", long), (7, "z", ""), (1, "http://a", long), (1, "http://a", "other " * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archive(df, path, segment_chars=700, chunk_chars=128, records_per_file=5)
    records = warc.read_archive(spark, path, common.saved).collect()
    assert sorted(bytes(r.payload).decode() for r in records if r.record_type == "response") == sorted([long, "short", "short", "", long, "", long, "other " * 100])
    out = warc.digests(warc.read_archive(spark, path, common.saved, with_payload=False)).collect()
    assert all(r.problem is None for r in out)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in out)
    n = len(long.encode())
    assert got == sorted([("1", n, "response", None), ("2", n, "revisit", 1), ("3", 5, "response", None), ("4", 5, "response", None), ("5", 0, "response", None), ("None", n, "response", None), ("7", 0, "response", None), ("1", n, "response", None), ("1", 600, "response", None)])
    assert warc.digests(warc.read_archive(spark, path, common.saved)).where("payload_digest is null").count() == 0


def test_warc_faults(spark, tmp_path):
    whole = warc.records("urn:page:1:d", "u", "x" * 1000, hashlib.sha256(b"x" * 1000).hexdigest(), None, 400, 100)
    end = "\r\n\r\n"
    bad = [whole[0], whole[2]]  # the second segment is missing
    cut = warc.records("urn:page:2:d", "u", "y", "0", None, 400, 100)[0][:-4]
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(end.join(bad).encode() + end.encode()) + gzip.compress(cut.encode()))
    out = {r.record_id: r.problem for r in warc.read_archive(spark, str(tmp_path), common.saved).collect()}
    assert out == {"urn:page:1:d": "a segment is missing", "urn:page:2:d": "the record is cut short"}
    assert warc.unframed(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    (tmp_path / "a.txt.gz").unlink()
    good = warc.records("urn:page:3:d", "u", "z" * 200, "0", None, 4000, 100)[0] + end
    (tmp_path / "b.warc").write_bytes(good.encode() + good.encode().replace(b"Content-Length: ", b"Content-Length: abc"))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress((good * 50).encode())[:-20])
    odd = [r.problem for r in warc.read_archive(spark, str(tmp_path), common.saved).collect()]
    assert sum(p is None for p in odd) >= 1 and any("isn't a number" in p for p in odd if p) and any("broken" in p for p in odd if p)
    for broken in (b"1_0\r\nabc\r\n0\r\n\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unframed(broken)


def test_licences_against_rules(spark):
    scan = licenses.Scanner().scan
    mit = " ".join(licenses.SENTENCES[s] for s in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    assert [(m["licence"], m["rule"]) for m in scan("Intro.\n" + mit + "\nMore.")] == [("MIT", "mit-text")]
    wrapped = "\n".join("# " + mit[i : i + 60] for i in range(0, 120, 60)) + mit[120:]
    assert [m["rule"] for m in scan(licenses.SENTENCES["mit-grant"].replace(" any ", "\nany "))] == ["mit-grant"] and wrapped
    assert [m["licence"] for m in scan("Prose. Released under the MIT License. Prose, 4.0.\nLicensed under CC BY-NC 4.0.")] == ["MIT", "CC-BY-NC-4.0"]
    assert [m["rule"] for m in scan(" ".join(licenses.SENTENCES[s] for s in ("bsd-redistribution", "bsd-source", "bsd-binary")))] == ["bsd-2"]
    grant = licenses.SENTENCES["mit-grant"].split()
    assert [m["rule"] for m in scan("\n".join(" ".join(grant[i : i + 4]) for i in range(0, len(grant), 4)))] == ["mit-grant"]
    named = {"SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "Licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0", "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0"}
    for line, licence in named.items():
        assert [m["licence"] for m in scan(f"Intro.\n{line}\nMore.")] == [licence], line
    header = f'{licenses.SENTENCES["mpl2-subject"]}\n{licenses.SENTENCES["mpl2-copy"]} https://mozilla.org/MPL/2.0/.'
    assert [m["licence"] for m in scan(header)] == ["MPL-2.0"]
    agpl = " ".join(licenses.SENTENCES[x] for x in ("agpl3-redistribute", "gpl-hope", "agpl-details"))
    assert [m["rule"] for m in scan(agpl)] == ["agpl3-notice"]
    far = licenses.SENTENCES["apache-header"] + " A. B. C. D. " + licenses.SENTENCES["apache-use"]
    assert [m["rule"] for m in scan(far)] == ["apache-header-short"]
    assert scan(None) == scan("") == scan("We licensed nothing.") == []
    # single-sentence notices, by plain search for whole sentences
    plain = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    got = {r.doc_id: r for r in queries.op3_licenses(spark, "/root/testdata/sf0.01").collect()}
    docs = common.documents(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert set(filter(None, got[d.doc_id].licences.split(";"))) == {v for k, v in plain.items() if k in d.text}
        for span in filter(None, got[d.doc_id].spans.split(";")):
            lo, hi = map(int, span.split("-"))
            assert d.text[lo:hi] in plain


def test_ordered_rules_against_brute_force():
    """Matches over random sentence sequences: all ways to place a rule, greedy choice of the documented order."""
    rng = random.Random(6)
    known = {x: f"sentence {x}" for x in "abcd"}
    rules = [("r1", "L1", ("a", "b", "c")), ("r2", "L2", ("a", "b")), ("r3", "L3", ("b",)), ("r4", "L4", ("c", "a"))]
    scanner = licenses.Scanner(known, rules, gap=1)
    for _ in range(200):
        row = [rng.choice("abcdxx") for _ in range(rng.randrange(12))]
        text = "\n".join(f"Sentence {x}." if x in known else f"Other {i}." for i, x in enumerate(row))
        possible = []
        for order, (_, _, steps) in enumerate(rules):
            for at in range(len(row)):
                places, ok = [at], row[at] == steps[0]
                for step in steps[1:]:
                    nxt = next((j for j in range(places[-1] + 1, min(places[-1] + 3, len(row))) if row[j] == step), None)
                    if nxt is None:
                        ok = False
                        break
                    places.append(nxt)
                if ok:
                    possible.append((-len(steps), at, order, places))
        taken, want = set(), []
        for _, at, order, places in sorted(possible):
            if taken.isdisjoint(places):
                taken.update(places)
                want.append((at, rules[order][0]))
        assert [m["rule"] for m in scanner.scan(text)] == [r for _, r in sorted(want)], row


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    v = rng.random((1000, 40)) * (rng.random((1000, 40)) < 0.1) * (np.arange(40) % 7 + 0.2)
    v[::50] = v[0]  # ties
    v[3] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    example, term = np.nonzero(v)
    index = toxicity.BlockMaxIndex(term, example, v[example, term], 40, 1000, block=16)
    q = v[:60]
    query, term = np.nonzero(q)
    got, who = index.nearest(query, term, q[query, term], 60, 7)
    full = np.round(q @ v.T, 5)
    for i in range(60):
        want = sorted((-s, j) for j, s in enumerate(full[i]) if s > 0)[:7]
        assert np.allclose(got[i, : len(want)], [-s for s, _ in want], atol=2e-5) and (who[i, len(want) :] == -1).all()
        assert np.allclose(full[i, who[i, : len(want)]], got[i, : len(want)], atol=2e-5)
    assert index.read < index.all
    x, y = toxicity.isotonic(np.array([0, 1, 1, 2, 3.0]), np.array([0, 1, 0, 0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()


def test_toxicity_equals_full_scan(spark):
    """Evidence and scores of the query against plain TF-IDF cosines with every example, worked out with dictionaries."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in common.documents(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    learnt = sorted(i for i in labels if i in docs and not common.held_out_id(i))
    own = {i: toxicity.terms(t) for i, t in docs.items()}
    vocabulary = {t for i in learnt for t in own[i]}
    weight = {}
    n, p = len(learnt), sum(labels[i] for i in learnt)
    counts, hits, seen = Counter(t for i in docs for t in own[i]), Counter(t for i in learnt if labels[i] for t in own[i]), Counter(t for i in learnt for t in own[i])
    for t in vocabulary:
        a, b = hits[t], seen[t] - hits[t]
        c, d = p - a, n - p - b
        chi = n * (a * d - b * c) ** 2 / max((a + b) * (c + d) * (a + c) * (b + d), 1)
        phi = math.sqrt(max(chi - 2 * math.log(len(vocabulary)), 0) / n)
        weight[t] = math.log((1 + len(docs)) / (1 + counts[t])) * (toxicity.BASE + phi)

    def vector(i):
        v = {t: (1 + math.log(m)) * weight[t] for t, m in own[i].items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items() if x > 0}

    examples = {i: vector(i) for i in learnt}
    out = {r.doc_id: r for r in toxicity.score(common.documents(spark, sf).select("doc_id", "text"), toxicity.fit(common.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    votes, cosines = {}, {}
    for i in docs:
        v = vector(i)
        cosines[i] = sorted(((-sum(x * e[t] for t, x in v.items() if t in e), j) for j, e in examples.items()))
        near = [(s, j) for s, j in ((-s, j) for s, j in cosines[i][:3]) if s > 0]
        got = out[i].evidence
        assert np.allclose([e.similarity for e in got], [s for s, _ in near], atol=2e-5)
        w = [(1 / (1.05 - min(-s, 1)), labels[j]) for s, j in cosines[i][:15] if s < 0]
        votes[i] = sum(x * y for x, y in w) / sum(x for x, _ in w) if w else None
    # the score rises with the votes and is a probability
    pairs = sorted((v, out[i].score) for i, v in votes.items() if v is not None)
    assert all(x[1] <= y[1] + 1e-6 for x, y in zip(pairs, pairs[1:], strict=False) if y[0] - x[0] > 1e-3)
    assert all(0 <= r.score <= 1 for r in out.values())
    learnt_scores = [(out[i].score, labels[i]) for i in learnt]
    assert np.mean([(s >= 0.5) == y for s, y in learnt_scores]) >= 0.95


def test_language_is_kernel_ridge():
    """With every example a landmark, margins are those of kernel ridge regression, worked out with sets."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(40)) for a in ("abcdef ", "cdefgh ", "жзиклм ") for _ in range(12)]
    langs = ["a"] * 12 + ["b"] * 12 + ["c"] * 12
    sets = [set(langid.grams(t).tolist()) for t in texts]
    model = langid.Model([np.array(sorted(s), np.int64) for s in sets], langs, landmarks=36, ridge=0.5)
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if c == x else -1.0 for c in "abc"] for x in langs])
    alpha = np.linalg.solve(k + 0.5 * np.eye(36), y)
    for t in ["abcabc", "hhgg cd", "зик", "xyz qq", "a" * 5000, *texts[::5]]:
        s = set(langid.grams(t).tolist())
        want = np.array([len(s & b) / math.sqrt(len(s) * len(b)) for b in sets]) @ alpha
        got, own, size = model.margins(t)
        assert np.allclose(got, want, atol=1e-6) and size == len(s)
    (lang, score, known), = model.predict(["今天天气"])
    assert known < model.cut and score < 0.2
    assert langid.grams("12 !") is None and len(langid._Slots(np.arange(10_000, dtype=np.int64) << 21)(np.array([5 << 21, 7, 5 << 21, -1]))[0]) == 1


def test_toxicity_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op4_toxicity(spark, sf).collect()
    assert len(out) == common.documents(spark, sf).count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == common.held_out_id(r.doc_id) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in test]) >= 0.95
    langs = {r.doc_id: r.lang for r in common.documents(spark, sf).collect()}
    out = queries.op5_langid(spark, sf).collect()
    assert len(out) == len(langs) and np.mean([r.lang_pred == langs[r.doc_id] for r in out if r.held_out]) >= 0.93


def test_learned_operators_on_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "12 !!", "en", "b"), (4, "der hund und die katze " * 3000, "de", None), (6, "der hund und die katze", "de", None)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df.select("doc_id", "text", "lang"))
    out = {(r.doc_id, r.text and r.text[:9]): r.lang_pred for r in langid.predict(df, model).collect()}
    assert out[(2, None)] == out[(3, "")] == out[(None, "12 !!")] == "und" and out[(4, "der hund ")] == "de"
    none = langid.fit(df.limit(0).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), labels)
    assert toxicity.score(df, model).count() == 7
    empty = toxicity.fit(df.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0
