import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitspark.llm import components, exact_dedup, line_dedup, simhash
from fitspark.llm.components import connected_components

WS = r"[\x20\x09-\x0D]"


def roots(n, links):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# ------------------------------------------------------------------ Golomb codes and exact duplicates


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=300), st.integers(0, 2**20))
def test_golomb_round_trip(values, low):
    v = np.array(sorted(values), np.int64) + low
    code, k = exact_dedup.golomb_encode(v, low, low + 2**40)
    assert (exact_dedup.golomb_decode(code, len(v), k, low) == v).all()


def test_golomb_is_short():
    v = np.sort(np.random.default_rng(0).choice(2**30, 10_000, replace=False))
    code, _ = exact_dedup.golomb_encode(v, 0, 2**30)
    assert len(code) * 8 / len(v) < np.log2(2**30 / 10_000) + 2.2


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(WS, "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return groups


@pytest.mark.parametrize("bits", [48, 4])  # four bits: nearly everything is suspect
def test_exact_equals_brute_force(docs, edge, bits):
    for df in (docs.select("doc_id", "text"), edge):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        groups = brute_exact(rows)
        got = exact_dedup.exact_dedup(df, fingerprint_bits=bits).collect()
        assert len(got) == len(rows)
        text_of = dict(rows)
        for r in got:
            if r["doc_id"] is None:
                continue
            g = groups[re.sub(WS, "", text_of[r["doc_id"]] or "")]
            n, null, keep = min(g)
            assert (r["keep_id"], r["group_size"]) == (None if null else keep, len(g))
        assert sum(r["kept"] for r in got) == len(groups)


def test_exact_owners_and_blocks_may_be_many(docs, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(docs).collect()))
    light = docs.select(F.expr("xxhash64(text) & 281474976710655L").alias("fp"), F.monotonically_increasing_id().alias("uid"))
    twice = {r["fp"] for r in light.groupBy("fp").count().where("count > 1").collect()}
    got = exact_dedup.suspect_fingerprints(light.repartition(5), per_owner=7)
    assert {r["fp"] for r in got.collect()} == twice
    assert want


def test_messages_stay_large_however_many_owners_there_are(spark):
    light = spark.range(40_000).select(F.expr("xxhash64(id div 3) & 281474976710655L").alias("fp"), F.col("id").alias("uid")).repartition(6)
    twice = {r["fp"] for r in light.groupBy("fp").count().where("count > 1").collect()}
    sizes = {}
    for per_message in (1, 100):  # one group of owners, and groups of them
        bounds = {"fingerprint_bits": 48, "per_owner": 100, "per_block": 1000, "per_message": per_message}
        blocks, _ = exact_dedup.exchanged(light, **bounds)
        sizes[per_message] = blocks.agg(F.avg("n")).first()[0]
        # A block of a group stays within its ten owners.
        assert per_message == 1 or blocks.groupBy("block").agg((F.max("owner") - F.min("owner")).alias("d")).agg(F.max("d")).first()[0] < 10
        assert {r["fp"] for r in exact_dedup.suspect_fingerprints(light, **bounds).collect()} == twice
    assert sizes[1] < 20 < sizes[100]


def test_exact_documents_keep_columns(edge, empty):
    got = exact_dedup.exact_documents(edge)
    assert got.columns == edge.columns
    texts = [re.sub(WS, "", r["text"] or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len(brute_exact([(r["doc_id"], r["text"]) for r in edge.collect()]))
    assert exact_dedup.exact_documents(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


# ------------------------------------------------------------------ lines


def brute_lines(rows):
    """Units to remove of (doc_id, text), as (doc_id, line, start, stop, n_words, keep_doc_id, keep_start)."""
    units = []
    for i, t in sorted(rows):
        at = 0
        for line, body in enumerate(t.split("\n")):
            parts = re.findall(r"[^.!?]*[.!?]+|[^.!?]+", body)
            here = [(at, p, len(parts) == 1, False) for at, p in zip(itertools.accumulate([at, *map(len, parts)]), parts)]
            here += [(at, body, True, True)] * (len(parts) > 1)
            for start, u, whole, extra in here:
                words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in u))
                n = max(len(words), len(u) // 8)
                if words and n >= (15 if extra else 3):
                    units.append(dict(id=i, line=line, start=start, stop=start + len(u), n=n, key=" ".join(words), whole=whole, extra=extra))
            at += len(body) + 1
    first = {}
    for u in sorted(units, key=lambda u: (u["id"], u["start"])):
        u["first"] = first.setdefault(u["key"], (u["id"], u["start"]))
        u["again"] = u["first"] != (u["id"], u["start"])
    lines = {(u["id"], u["line"]) for u in units if u["again"] and u["whole"] and u["n"] >= 15}
    out = {(u["id"], u["line"], u["start"], u["stop"], u["n"], *u["first"]) for u in units if u["again"] and u["whole"] and u["n"] >= 15}
    for _, of in itertools.groupby((u for u in units if not u["extra"]), key=lambda u: u["id"]):
        for again, run in itertools.groupby(of, key=lambda u: u["again"]):
            run = list(run)
            if again and sum(u["n"] for u in run) >= 25:
                out |= {(u["id"], u["line"], u["start"], u["stop"], u["n"], *u["first"]) for u in run if (u["id"], u["line"]) not in lines}
    return out


def test_lines_equal_brute_force(spark, docs, edge):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.choice([1, 2, 9]))) + rng.choice([".", "!", "...", ""])
    some = [sentence() for _ in range(12)]  # few, so that most of them and some lines repeat
    made = [(i, rng.choice([" ", "  "]).join(rng.choice(some) for _ in range(rng.randint(0, 5))).replace(". ", rng.choice([". ", ".\n", ".\n\n"]))) for i in range(80)]
    made += [(100 + i, "漢字かな交じり文。" * k + "\nend") for i, k in enumerate((14, 14, 30, 30))]
    for df in (docs.select("doc_id", "text"), edge.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.createDataFrame(made, "doc_id long, text string")):
        got = [tuple(r) for r in line_dedup.line_dedup(df).drop("uid").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_lines([(r["doc_id"], r["text"] or "") for r in df.collect()])


def test_repeated_rows_and_null_ids_lose_their_lines(edge, empty):
    got = line_dedup.line_dedup(edge, line_words=5).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_doc_id"]) for r in got if r["n_words"] == 6) == [(False, 1, 1), (False, 2, 1), (False, 10, 1), (True, 0, 1)]
    assert line_dedup.line_dedup(empty).count() == 0


def test_short_lines_stay(spark):
    rows = spark.createDataFrame([(i, f"All rights reserved. Call us.\n" + "A!! B!! " * 40 + f"\nOnly here {i} " + "x " * 40) for i in range(3)], "doc_id long, text string")
    assert {r["line"] for r in line_dedup.line_dedup(rows).collect()} == {1}  # the long line goes whole; its short sentences make no run
    assert line_dedup.line_dedup(rows, line_words=1000).count() == 0


def test_removed_units_leave_the_rest(spark, edge, empty):
    rows = spark.createDataFrame([(1, "a b c d e\nkept one", 1), (2, "first\na b c  D e\nlast", 2), (3, None, 3), (1, "a b c d e\nkept one", 4)], "doc_id long, text string, line_uid long")
    cut = line_dedup.without_repeats(rows, line_words=5)
    assert cut.columns == ["doc_id", "text", "line_uid", "removed_spans"]
    got = {r["line_uid"]: r for r in cut.collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["a b c d e\nkept one", "first\n\nlast", None]
    assert got[2]["removed_spans"][0].asDict() == {"start": 6, "stop": 16} and got[1]["removed_spans"] is None
    assert got[4]["text"] == "\nkept one" and got[4]["doc_id"] == 1  # a repeated row loses its unit, the first does not
    assert line_dedup.without_repeats(empty).count() == 0 and line_dedup.without_repeats(edge).count() == edge.count()


def test_passages_inside_lines_are_found(spark):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words[:60]))
    rows = spark.createDataFrame([(1, "One more start " + passage + " and an end."), (2, "Other words first, " + passage + " other end."), (3, " ".join(words[100:200]) + ".")], "doc_id long, text string")
    got = line_dedup.line_dedup(rows).collect()
    assert {(r["doc_id"], r["keep_doc_id"]) for r in got} == {(2, 1)} and sum(r["n_words"] for r in got) >= 40


# ------------------------------------------------------------------ SimHash


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("n", [3, 5])
def test_fingerprints(docs, n):
    for r in docs.limit(60).collect():
        assert simhash.fingerprint(r["text"], n) == brute_fingerprint(r["text"], n)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=12), st.integers(0, 5), st.randoms())
def test_tree_finds_all_neighbours(values, radius, rng):
    near = [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for v in values for _ in range(4)]
    tree, added = simhash.BKTree(), []
    for v in near:
        assert sorted(tree.near_then_add(v, radius)) == [i for i, w in enumerate(added) if (v ^ w).bit_count() <= radius]
        added.append(v)


@pytest.mark.parametrize("most", [2, 512])  # two: every shard is dealt again to the last level
def test_links_connect_as_all_pairs_do(spark, most):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values[:20]):
        for _ in range(6):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.append(v)
    values = sorted(set(values))
    want = roots(len(values), [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 3])
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fp long"), max_shard=most).collect()
    at = {v: i for i, v in enumerate(signed)}
    assert roots(len(values), [(at[r["a"]], at[r["b"]]) for r in edges]) == want


@pytest.mark.parametrize("last", [50_000, 30, 0])
def test_components_of_a_chain_and_of_nothing(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_EDGES", last)
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (200, 201), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(chain).collect()}
    assert len(got) == 103 and len({got[i] for i in range(101)}) == 1 and got[200] == got[201] != got[0]
    assert connected_components(chain.where("a is null")).count() == 0


def test_groups_of_edge_cases(edge, empty):
    got = simhash.simhash_groups(edge, shingle=3).collect()
    assert len(got) == edge.count() and simhash.simhash_groups(empty).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {i for i, r in by.items() if r["fp"] == 0} >= {3, 4, 5} and len({by[i]["component_id"] for i in (3, 4, 5)}) == 1
    assert {by[i]["component_id"] for i in (1, 2, 10)} == {1} and {r["component_id"] for r in got if r["doc_id"] is None} == {1, 3}
    left = simhash.near_documents(edge, shingle=3)
    assert left.columns == edge.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(1) == 2 and ids.count(None) == 2 and not {2, 10, 4, 5} & set(ids) and 3 in ids


def test_edited_copies_join_by_similarity(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    rows, at = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows.append((at, " ".join(words)))
        for k in (2, 5):  # 10 and 25 of 296 shingles change
            edited = list(words)
            for i in range(k):
                edited[20 + i * 55] = "changed"
            rows.append((at + k, " ".join(edited)))
        rows.append((at + 8, " ".join(words[:150] + [rng.choice(vocabulary) for _ in range(150)])))  # half is other text
        at += 10
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    joined = sum(got[a + k] == a for a in range(0, 250, 10) for k in (2, 5))
    assert joined >= 44 and all(got[a + 8] == a + 8 for a in range(0, 250, 10))
    assert all(got[i] // 10 == i // 10 for i in got)


def test_sampled_shards_may_be_small(spark, docs):
    wide = lambda most: {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs, similarity=0.8, max_shard=most).collect()}
    base = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    groups = lambda x: len({c for _, c in x})
    assert groups(wide(512)) <= groups(wide(2)) <= groups(base)


def test_similar_texts_are_grouped_as_all_pairs_are(spark, docs, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    licence = [word() for _ in range(30)]  # in many texts that are not similar otherwise
    made = []
    for _ in range(60):
        words = [word() for _ in range(rng.choice([9, 40, 70, 150]))] + rng.choice([[], licence])
        made.append(words)
        for _ in range(3):
            cut = rng.randint(0, len(words) // 8)
            made.append(words[cut:] if rng.random() < 0.5 else words[: len(words) - cut] + [word() for _ in range(cut // 2)])
    hot = [word() for _ in range(90)]
    made += [[*hot[:k], word(), *hot[k + 1 :]] for k in range(80)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, " ".join(w)) for i, w in enumerate(made)] + [(None, " ".join(made[0] + ["end"]))]
    grams = [frozenset(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    fps = [simhash.fingerprint(t or "", 5) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    alike = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert sum((fps[i] ^ fps[j]).bit_count() > 12 for i, j in alike) > 20
    root = roots(len(rows), near + alike)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None) for r in set(root)}
    want = sorted((rows[i][0] is None, rows[i][0] or 0, least[root[i]]) for i in range(len(rows)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for ranked in (20_000, 100):  # whatever the sample, the groups are the same
        monkeypatch.setattr(simhash, "RANKED_DOCS", ranked)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_groups(frame, similarity=0.8).collect()) == want
