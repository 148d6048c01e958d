"""The registered queries that SQL cannot express, on whole small tables against plain loops."""

import re
import zlib

import numpy as np
import pytest
import pyarrow.dataset as ds
import xxhash

from fitspark.llm import queries, quality, toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(d):
    return ds.dataset(f"{d}/documents.parquet").to_table().to_pylist()


def test_op3_components_are_those_of_all_pairs(spark):
    rows = documents(MEDIUM)

    def fingerprint(t):
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))

    fp = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    ids = sorted(fp)
    values = np.array([fp[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1
        for j in near:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    want = {ids[i]: (f"{fp[ids[i]]:016x}", ids[top(i)]) for i in range(len(ids))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, MEDIUM).collect()} == want


def test_op4_keeps_by_base_rule_and_verdict(spark):
    text = {r["doc_id"]: r["text"] or "" for r in documents(MEDIUM)}
    scored, _ = quality.quality_scores(queries.documents(spark, MEDIUM))
    good = {r["doc_id"]: r["good"] for r in scored.collect()}
    rows = queries.op4_quality(spark, MEDIUM).collect()
    for r in rows:
        n = len(WORDS.findall(text[r["doc_id"]]))
        failed = n < 50 or 100 * r["n_repeat_words"] > 50 * n
        assert (r["n_words"], r["base_failed"], r["kept"]) == (n, failed, not failed and good[r["doc_id"]])
    assert len(rows) == len(text)


def test_op5_scores_are_those_of_a_plain_convolution(spark):
    rows = documents(SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    m = toxicity.fit(queries.documents(spark, SMALL), labels)
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    assert len(got) == len(rows)

    def score(text):
        pad = (0,) * toxicity.PARTS
        words = [tuple(int(x) for x in b) for b in toxicity.buckets_of(text)] or [pad]
        vectors = [sum(m.embedding[b].astype(np.float64) for b in w) for w in [*words, *[pad] * toxicity.PAD]]
        hidden = []
        for w in m.filters:
            for f in range(toxicity.FILTERS):
                hidden.append(max(sum(float(vectors[i + j] @ w[j, :, f].astype(np.float64)) for j in range(len(w))) for i in range(len(words))))
        z = sum(max(h + b, 0) * v for h, b, v in zip(hidden, m.bias.astype(np.float64), m.weight.astype(np.float64))) + m.offset
        return 1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -30, 30)))

    short = sorted(rows, key=lambda r: len(r["text"] or ""))[:40]
    for r in short:
        assert got[r["doc_id"]]["score"] == pytest.approx(score(r["text"] or ""), abs=1e-4)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and g["predicted"] == int(g["score"] >= 0.3)


def test_op6_takes_what_plain_loops_aim_at(spark):
    rows = documents(MEDIUM)
    size = {r["doc_id"]: len(WORDS.findall(r["text"] or "")) for r in rows}
    of = {}
    for r in rows:
        of.setdefault(r["source"], []).append(size[r["doc_id"]])
    names = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sum(of[s])]
        if not above:
            break
        capped |= {s: 2.0 * sum(of[s]) for s in above}
    target = capped | share
    taken = dict.fromkeys(names, 0)
    source = {r["doc_id"]: r["source"] for r in rows}
    got = queries.op6_mixing(spark, MEDIUM).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sum(of[s])) and r["target"] == pytest.approx(target[s]) and r["taken"] in {k * r["size"] for k in (0, 1, 2)}
        taken[s] += r["taken"]
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.02), s
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_mixing(spark, MEDIUM).collect()))
