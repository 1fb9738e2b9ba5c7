"""Classifiers, license scan, fingerprints and chat formatting."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockflow.llm import chat, fingerprint, licenses, quality, toxicity
from stockflow.llm.common import fold

SF = "/root/testdata/sf0.01"


def accuracy(scores, labels, label):
    rows = scores.join(labels, "doc_id").filter("held_out").select("predicted", label).collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows), len(rows)


@pytest.mark.parametrize("scorer,label,least", [(quality.quality_scores, "quality", 0.93), (toxicity.toxicity_scores, "toxic", 0.95)])
def test_held_out_accuracy(spark, scorer, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = scorer(docs, labels)
    assert scores.columns == ["doc_id", "held_out", "score", "predicted"]
    got, n = accuracy(scores, labels, label)
    assert n > 50 and got >= least
    assert scores.filter("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_rows_teach_nothing(spark):
    """Labels of fold 0 may be anything without a change."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs, x).collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("op,keep", [(quality.quality_scores, quality.keep_quality), (toxicity.toxicity_scores, toxicity.keep_harmless)])
def test_classifier_odd_input(spark, odd, none, op, keep):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (7, 0, 1), (8, 1, 0), (8, None, 0), (None, 1, 1), (6, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = op(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 7}) == 1
    assert keep(odd, labels).columns == odd.columns
    assert op(none, labels).count() == keep(none, labels).count() == 0
    assert op(odd, labels.limit(0)).count() == odd.count()  # nothing to learn from


def test_network_reads_the_whole_text():
    """The end of a long text counts as much as its beginning."""
    net = quality.ByteConvNet(3)
    plain = "abcdefgh " * 20000
    assert net.score(plain) != net.score(plain[:-2000] + "#!$" * 667)
    assert net.score("") == net.score(None)


def test_training_reads_the_whole_text():
    """Chunks cover every byte of a text, as scoring does, and a gradient in blocks is that of one block."""
    raw = bytes(np.random.default_rng(1).integers(1, 256, 50_003).astype(np.uint8))
    parts = quality._chunks(raw)
    step = quality.STEP * quality.STRIDE
    assert b"".join(c[:step] for c in parts[:-1]) + parts[-1].rstrip(b"\0") == raw
    net = quality.ByteConvNet(2)
    text = "wörd and more " * 3000
    pooled = np.concatenate([net._winners(np.frombuffer(c, np.uint8)[None])[1] for c in quality._chunks(text.encode())])
    assert 1 / (1 + np.exp(-net.dense(pooled).mean())) == pytest.approx(net.score(text), abs=1e-3)
    data = np.frombuffer(b"".join(parts[:40]), np.uint8).reshape(-1, quality.CHUNK + quality.STRIDE)
    doc, size, y = np.repeat([0, 1], [7, 33]), np.array([7, 33]), np.array([1.0, 0.0])
    whole, old = net._gradient(data, doc, size, y), quality.BLOCK
    try:
        quality.BLOCK = 3
        parted = net._gradient(data, doc, size, y)
    finally:
        quality.BLOCK = old
    assert all(np.allclose(whole[k], parted[k], atol=1e-5) for k in whole)


def test_network_gradient():
    r = np.random.default_rng(0)
    net = quality.ByteConvNet(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = r.integers(1, 256, (3, quality.CHUNK + quality.STRIDE)).astype(np.uint8)
    doc, size, y = np.array([0, 0, 1]), np.array([2, 1]), np.array([1.0, 0.0])

    def loss():
        pooled = np.stack([net.responses(d).max(0) for d in data])
        logit = np.bincount(doc, net.dense(pooled)) / size
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))
    g = net._gradient(data, doc, size, y)
    for k, at in (("conv", (3, 5)), ("w1", (2, 3)), ("b1", (1,)), ("w2", (4,)), ("emb", (data[0, 0], 1)), ("bias", (7,)), ("b2", (0,))):
        old, eps = net.p[k][at], 1e-5
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        slope = (up - loss()) / (2 * eps)
        net.p[k][at] = old
        assert g[k][at] == pytest.approx(slope, abs=2e-4)


def kinds_of_votes(n, shares, hit, miss, each=8, seed=2):
    """Votes of ``each`` voters for every kind of toxic row; a kind's voters see only that kind."""
    r = np.random.default_rng(seed)
    kind = r.choice(len(shares) + 1, n, p=[1 - sum(shares), *shares])
    sees = np.repeat(np.arange(1, len(shares) + 1), each)
    return kind, (r.random((n, sees.size)) < np.where(kind[:, None] == sees, hit, miss)).astype(np.uint8), r


def test_label_model_learns_accuracies():
    """Eight good voters, one random and a copy of the first; the annotator errs in 25%."""
    kind, votes, r = kinds_of_votes(4000, [0.1], 0.6, 0.03)
    votes = np.column_stack([votes, r.random(4000) < 0.3, votes[:, 0]]).astype(np.uint8)
    label = np.where(r.random(4000) < 0.25, 1 - kind, kind)
    m = toxicity.LabelModel(votes, np.ones(4000))
    toxic = m.toxic_classes(votes, label, np.ones(4000))
    assert toxic.tolist() == [False, True]
    assert np.mean((m.posterior(votes, toxic) > 0.5) == kind) > 0.97
    good = m.rates[:, 0, 1:8]
    assert np.all(np.abs(good[1] - 0.6) < 0.08) and np.all(np.abs(good[0] - 0.03) < 0.02)
    assert abs(math.log(m.rates[1, 0, 8] / m.rates[0, 0, 8])) < 0.25
    assert m.correlation[0, 9] > 0.9 and m.correlation[0, 1] < 0.2
    assert {(i, p) for i, p in enumerate(m.parent.tolist()) if p >= 0} == {(9, 0)}  # the copy hangs on its original
    lone, both = np.zeros((2, 1, 10), np.uint8)
    lone[0, 0] = both[0, [0, 9]] = 1
    assert m.posterior(both, toxic)[0] < 0.2  # seen twice, told once
    assert min(np.diff(m.likelihood)) > -1e-6  # expectation-maximisation never falls


def test_label_model_finds_kinds():
    """Three kinds of toxic rows that share no voter, the rarest in 2% of all rows."""
    kind, votes, r = kinds_of_votes(6000, [0.06, 0.03, 0.02], 0.5, 0.01)
    label = np.where(r.random(6000) < 0.25, kind == 0, kind > 0).astype(int)
    m = toxicity.LabelModel(votes, np.ones(6000))
    toxic = m.toxic_classes(votes, label, np.ones(6000))
    assert toxic.tolist() == [False, True, True, True]
    assert np.mean((m.posterior(votes, toxic) > 0.5) == (kind > 0)) > 0.98


def test_label_model_does_not_follow_labels():
    """Random voters tell nothing, whatever the labels; good ones tell the same with other labels."""
    r = np.random.default_rng(3)
    votes, label = (r.random((4000, 30)) < 0.1).astype(np.uint8), (r.random(4000) < 0.3).astype(int)
    m = toxicity.LabelModel(votes, np.ones(4000))
    q = m.posterior(votes, m.toxic_classes(votes, label, np.ones(4000)))
    assert not q.any() or abs(np.corrcoef(q, label)[0, 1]) < 0.05
    kind, votes, r = kinds_of_votes(4000, [0.1], 0.6, 0.03)
    m = toxicity.LabelModel(votes, np.ones(4000))
    one, other = (m.posterior(votes, m.toxic_classes(votes, np.where(r.random(4000) < e, 1 - kind, kind), np.ones(4000)))
                  for e in (0.0, 0.25))
    assert np.array_equal(one, other)


def test_label_model_without_votes():
    for n, m in ((1, 3), (5, 0), (3, 16)):
        model = toxicity.LabelModel(np.zeros((n, m), np.uint8), np.ones(n))
        assert not model.toxic_classes(np.zeros((n, m), np.uint8), np.zeros(n, int), np.ones(n)).any()


def plain_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None),
            ",".join(sorted({x for _, x in hits})))


def test_licenses(spark, odd, none):
    texts = ["CC BY cc-by CC  BY-NC 4.0", "cc " * 50 + "by", "All rights reserved. all rights reserved",
             "the GNU General Public License, version 3. General public License", "Released under the MIT License.",
             "Licensed under the Apache License, Version 2.0.", "the license of the apache tribe", "x " * 300_000 + "cc by"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df = df.unionByName(odd.select("doc_id", "text")).unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = licenses.license_report(df).collect()
    want = sorted((plain_phrases(r.text) for r in df.collect()), key=str)
    assert sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    by = {r.doc_id: r for r in rows if r.n_words and r.n_words != 0}
    labels = {x for r in rows for x in r.labels.split(",")}
    assert {"mit", "apache-2.0", "cc-by-nc-4.0", "gpl-3.0", "cc-by", "gpl", "reserved"} <= labels
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in rows) and by
    assert licenses.license_report(none).count() == 0


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_fingerprints(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")
                                                                                            .filter("doc_id > 100"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    far, prints = [], {}
    for k, (i, t) in enumerate(rows):
        n, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        e = t[:len(t) - h] + n[:h]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b = shingles(t), shingles(e)
        far.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(far)) < 0.01 and np.std(far) < 0.07
    odd_rows = fingerprint.edited_fingerprints(odd).collect()
    assert len(odd_rows) == odd.count()
    assert len({r.fingerprint for r in odd_rows if r.n_chars == 0}) == 1
    assert fingerprint.edited_fingerprints(none).count() == 0


def test_chunk_borders_join_neighbours(spark, monkeypatch):
    """Many small chunks give the same neighbours as one."""
    monkeypatch.setattr(fingerprint, "CHUNK_ROWS", 3)
    ids = [None, -5, 0, 1, 1, 2, 9, 10, 400, 401, 402, 1 << 60]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = fingerprint.with_next(df, ["doc_id"]).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert len(rows) == len(ids)
    assert sorted((str(r.doc_id), str(r.next_doc_id)) for r in rows) == sorted(
        (str(a), str(b)) for a, b in zip(ids, ids[1:] + ids[:1]))


def test_escape_round_trip():
    for t in ["</s>", "<\\s>", "[INST] \\[INST] [\\\\/INST]", "<s><\\\\/s>", "plain [x] <b>", "[/TURN][ROLE]", "\\"]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat(spark):
    big = (1 << 60) + 1
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", None), (1, 2, "assistant", "yes [INST]"), (1, 2, "assistant", "yes [INST]"),
            (2, None, None, "sys"), (2, 0, "tool [ROLE]", "ü漢\U0001f600 \\[/INST]"), (None, 0, "user", ""), (big, 1, "assistant", "z" * 200_000),
            (big, 0, "system", "  lead and trail \n")]
    rows += [(7, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.unionByName(chat.probe_conversation(df))
    formatted = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.conversation_digests(formatted).collect()}
    by = {}
    say = "</s>[INST] ok [/INST]"
    for c, t, role, x in rows + [(-1, 0, "user", say), (-1, 1, "assistant", say)]:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(by)
    template = chat.Template(chat.VOCABULARY)
    for c, own in by.items():
        own.sort(key=lambda r: r[:3])
        full = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(full.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        parts = sorted((p for p in formatted.filter(F.col("conv_id").eqNullSafe(F.lit(c))).collect()), key=lambda p: p.turn_no)
        ids = [i for p in parts for i in p.ids]
        text = template.render(ids)
        assert len(text) == r.formatted_chars and text.startswith("<s>") and text.count("<s>") == 1
        masked = "".join(chat.unescape(template.render(ids[p.loss_start:p.loss_end])) for p in parts if p.loss_start is not None)
        assert masked == loss
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0
